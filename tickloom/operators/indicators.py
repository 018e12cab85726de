"""Technical indicators.

Windows where a value depends on a fixed number of rows; one grouped function per ticker where it depends on the value
before it. A ticker's daily series is small (ten thousand rows in forty years), so a group is bounded; tickers spread
over the cluster. All recursive indicators of a ticker come from one pass, so that the table is shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runs import runs
from ..functions.scalars import TICKER
from ..sources.bars import ordered
from .joins import beside

# ---- windows


def true_range(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(ordered())
    gap = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return bars.withColumn("tr", gap)


def atr_sma(bars: DataFrame, p: int = 14) -> DataFrame:
    last = ordered().rowsBetween(-(p - 1), 0)
    return true_range(bars).withColumn("atr", F.when(F.count("tr").over(last) == p, F.avg("tr").over(last)))


def cci(bars: DataFrame, p: int = 20) -> DataFrame:
    """Typical price against its mean, in units of 0.015 mean absolute deviations; a flat window gives 0."""
    last = ordered().rowsBetween(-(p - 1), 0)
    tp = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    seen = tp.withColumn("_all", F.collect_list("_tp").over(last)).withColumn("_mean", F.avg("_tp").over(last))
    spread = F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / p
    value = F.when(spread == 0, 0.0).otherwise((F.col("_tp") - F.col("_mean")) / (0.015 * spread))
    return seen.withColumn("cci", F.when(F.size("_all") == p, value)).drop("_tp", "_all", "_mean")


def directional_movement(bars: DataFrame) -> DataFrame:
    up = F.col("high") - F.lag("high").over(ordered())
    down = F.lag("low").over(ordered()) - F.col("low")
    moved = bars.withColumn("_up", up).withColumn("_down", down)
    pdm = F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).when(F.col("_up").isNotNull(), 0.0)
    ndm = F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).when(F.col("_up").isNotNull(), 0.0)
    return moved.withColumn("plus_dm", pdm).withColumn("minus_dm", ndm).drop("_up", "_down")


def bollinger(bars: DataFrame, p: int = 20, k: float = 2.0) -> DataFrame:
    """Mean and k population deviations of the p closes before the row; sums are taken in order of date, so that a number
    is the same to its last bit however the rows are spread."""
    before = ordered().rowsBetween(-p, -1)
    total = lambda f: F.aggregate("_before", F.lit(0.0), lambda a, x: a + f(x))
    seen = bars.withColumn("_before", F.collect_list("close").over(before)).withColumn("bb_mid", F.when(F.size("_before") == p, total(lambda x: x) / p))
    apart = lambda x: (x - F.col("bb_mid")) * (x - F.col("bb_mid"))
    banded = seen.withColumn("_dev", F.sqrt(total(apart) / p))
    return banded.withColumn("bb_low", F.col("bb_mid") - k * F.col("_dev")).withColumn("bb_high", F.col("bb_mid") + k * F.col("_dev")).drop("_before", "_dev")


def rgvb(bars: DataFrame) -> DataFrame:
    return bars.withColumn("rgvb", F.when(F.col("close") > F.lag("close").over(ordered()), 1).otherwise(0))


# ---- recursions over arrays whose last axis is time: one ticker's, or those of several, padded at their ends; each returns
# values end-aligned by row, NaN before the first


def _tr(h, l, c):  # noqa: E741
    out = h - l
    before = c[..., :-1]
    out[..., 1:] = np.maximum(out[..., 1:], np.maximum(np.abs(h[..., 1:] - before), np.abs(l[..., 1:] - before)))
    return out


def _seed(x: np.ndarray, i: int, j: int, f) -> np.ndarray | float:
    """f over rows i to j of each ticker, on its own, so that the sum doesn't depend on which others are beside it."""
    return f(x[i:j]) if x.ndim == 1 else np.array([f(row[i:j]) for row in x])


def _smooth(x: np.ndarray, start: int, seed, step) -> np.ndarray:
    """seed at row start, then step(previous, x[row]) at each later row: for all tickers at once."""
    out = np.full(x.shape, np.nan)
    if start >= x.shape[-1]:
        return out
    if x.ndim == 1:
        # plain floats: a numpy scalar at every step costs several times as much
        out[start:] = list(accumulate(x[start + 1 :].tolist(), step, initial=float(seed)))
        return out
    rows, at = np.ascontiguousarray(x.T), np.full(x.T.shape, np.nan)
    at[start] = v = seed
    for i in range(start + 1, len(rows)):
        at[i] = v = step(v, rows[i])
    return np.ascontiguousarray(at.T)


def _too_short(x: np.ndarray, n: int) -> np.ndarray | None:
    return np.full(x.shape, np.nan) if x.shape[-1] < n else None


def atr_values(h, l, c, p=14, method="WILDER"):  # noqa: E741
    tr = _tr(h, l, c)
    if method == "WILDER":
        step = lambda v, x: (v * (p - 1) + x) / p
    elif method == "EMA":
        step = lambda v, x: v + (x - v) * 2 / (p + 1)
    else:
        raise ValueError(method)
    if (none := _too_short(tr, p)) is not None:
        return none
    return _smooth(tr, p - 1, _seed(tr, 0, p, np.mean), step)


def rsi_values(c, p=14):
    d = np.diff(c, prepend=c[..., :1])
    gain, loss = np.where(d > 0, d, 0.0), np.where(d < 0, -d, 0.0)
    step = lambda v, x: (v * (p - 1) + x) / p
    if (none := _too_short(c, p + 1)) is not None:
        return none
    g, s = (_smooth(x, p, _seed(x, 1, p + 1, np.mean), step) for x in (gain, loss))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(g), np.nan, np.where(s == 0, 100.0, 100 - 100 / (1 + g / s)))


def di_values(h, l, c, p=14):  # noqa: E741
    up, down = np.diff(h, prepend=h[..., :1]), -np.diff(l, prepend=l[..., :1])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = _tr(h, l, c)
    step = lambda v, x: v - v / p + x
    if (none := _too_short(c, p + 1)) is not None:
        return none, none.copy()
    sp, sm, st = (_smooth(x, p, _seed(x, 1, p + 1, np.sum), step) for x in (plus, minus, tr))
    with np.errstate(divide="ignore", invalid="ignore"):
        pick = lambda x: np.where(np.isnan(st), np.nan, np.where(st == 0, 0.0, 100 * x / st))
        return pick(sp), pick(sm)


def dx_values(plus, minus):
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.abs(plus + minus)
        return np.where(np.isnan(total), np.nan, np.where(total == 0, 0.0, 100 * np.abs(plus - minus) / total))


def adx_values(dx, p=14):
    if (none := _too_short(dx, 2 * p)) is not None:
        return none
    return _smooth(dx, 2 * p - 1, _seed(dx, p, 2 * p, np.mean), lambda v, x: (v * (p - 1) + x) / p)


def ema_values(c, p, smoothing=2.0, variant="reference"):
    """variant `reference`: the value at row p-1+k takes in close[k], so it lags by p-1 rows; `textbook`: close[p-1+k]."""
    if (none := _too_short(c, p)) is not None:
        return none
    x = c if variant == "textbook" else np.concatenate([c[..., :p], c[..., 1 : c.shape[-1] - p + 1]], -1)
    a = smoothing / (p + 1)
    return _smooth(x, p - 1, _seed(c, 0, p, np.mean), lambda v, y: y * a + v * (1 - a))


def macd_values(c, variant="reference"):
    """EMA12 - EMA26. `reference` pairs the two by their place in their own series: EMA12 at t-15, EMA26 at t-1."""
    fast, slow = ema_values(c, 12, variant=variant), ema_values(c, 26, variant=variant)
    if variant == "textbook":
        return fast - slow
    out, n = np.full(c.shape, np.nan), c.shape[-1]
    if n > 26:
        out[..., 26:] = fast[..., 11 : n - 15] - slow[..., 25:-1]
    return out


def supertrend_values(h, l, c, p=7, k=3.0):  # noqa: E741
    atr = atr_values(h, l, c, p)
    st, side = np.full(c.shape, np.nan), np.zeros(c.shape, np.int8)
    if c.shape[-1] < p:
        return st, side
    mid = (h + l) / 2
    hi, lo, close = (np.ascontiguousarray(np.atleast_2d(x[..., p - 1 :]).T) for x in (mid + k * atr, mid - k * atr, c))
    fu, fl = hi[0], lo[0]
    value = np.where(close[0] < fu, fu, fl)
    line = [value]
    for i in range(1, len(close)):
        nu = np.where((hi[i] < fu) | (close[i - 1] > fu), hi[i], fu)
        nl = np.where((lo[i] > fl) | (close[i - 1] < fl), lo[i], fl)
        value = np.where(((value == fu) & (close[i] <= nu)) | ((value == fl) & (close[i] <= nl)), nu, nl)
        line.append(value)
        fu, fl = nu, nl
    st[..., p - 1 :] = np.array(line).T.reshape(st[..., p - 1 :].shape)
    side[..., p - 1 :] = np.where(c[..., p - 1 :] > st[..., p - 1 :], 1, -1)
    return st, side


EMA_PERIODS = (5, 10, 12, 20, 26, 50, 100, 200)
RECURSIVE = ("atr", "rsi", "plus_di", "minus_di", "dx", "adx", *(f"ema{p}" for p in EMA_PERIODS), "macd", "st", "st_side")


def _recursions(h: np.ndarray, l: np.ndarray, c: np.ndarray, which: list[str], variant: str, p: dict) -> dict[str, np.ndarray]:  # noqa: E741
    """The chosen recursive indicators over rows in order of date; +-DI, DX and ADX share their sums."""
    out = {}
    if {"plus_di", "minus_di", "dx", "adx"} & set(which):
        out["plus_di"], out["minus_di"] = di_values(h, l, c, p["adx"])
        out["dx"] = dx_values(out["plus_di"], out["minus_di"])
        out["adx"] = adx_values(out["dx"], p["adx"])
    if {"st", "st_side"} & set(which):
        out["st"], out["st_side"] = supertrend_values(h, l, c, p["st"], p["st_k"])
    for name in which:
        if name == "atr":
            out[name] = atr_values(h, l, c, p["atr"], p["atr_method"])
        elif name == "rsi":
            out[name] = rsi_values(c, p["rsi"])
        elif name == "macd":
            out[name] = macd_values(c, variant)
        elif name.startswith("ema"):
            out[name] = ema_values(c, int(name[3:]), p["smoothing"], variant)
    return {name: out[name] for name in which}


DEFAULTS = {"rsi": 14, "atr": 14, "adx": 14, "st": 7, "st_k": 3.0, "smoothing": 2.0, "atr_method": "WILDER"}


def recursive(bars: DataFrame, which: Iterable[str] = RECURSIVE, variant: str = "reference", periods: dict | None = None, keep: Iterable[str] = (*TICKER, "period_date")) -> DataFrame:
    """The columns `keep` of bars and the chosen recursive indicators; NULL before a series' first value.

    One shuffle by ticker; tickers that lie side by side go through the steps of a recursion together, padded to one length.
    """
    which, keep = list(which), list(keep)
    p = DEFAULTS | (periods or {})

    def several(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
        sizes = np.array([g.num_rows for g in groups])
        t = pa.concat_batches(groups)
        real = np.arange(sizes.max()) < sizes[:, None]
        padded = []
        for name in ("high", "low", "close"):
            padded.append(np.full(real.shape, np.nan))
            padded[-1][real] = t.column(name).to_numpy(zero_copy_only=False).astype(float)
        columns = [t.column(c) for c in keep]
        for name, v in _recursions(*padded, which, variant, p).items():
            # NaN becomes NULL
            v = v[real]
            columns.append(pa.array(v.astype(np.int32), mask=v == 0) if name == "st_side" else pa.array(v, from_pandas=True))
        return pa.RecordBatch.from_arrays(columns, names=[*keep, *which])

    schema = bars.select(*keep).schema
    for name in which:
        schema = schema.add(name, "integer" if name == "st_side" else "double")
    needed = [c for c in bars.columns if c in {*keep, *TICKER, "period_date", "high", "low", "close"}]
    return runs(bars.select(*needed), TICKER, ["period_date"], several, schema)


def indicators(bars: DataFrame, variant: str = "reference") -> DataFrame:
    """bars with every enabled indicator: windows by ticker, then the recursive ones in one pass over the same partitions."""
    windowed = rgvb(bollinger(cci(bars)))
    return recursive(windowed, variant=variant, keep=windowed.columns)


#: Rows before the first value of each indicator.
WARM_UP = {"cci": 19, "atr": 13, "rsi": 14, "plus_di": 14, "adx": 27, "macd": 26, "bb_mid": 20, "st": 6, "rgvb": 0} | {f"ema{p}": p - 1 for p in EMA_PERIODS}

#: The same for every column of indicators(), and those that go on from a fixed number of rows before.
ALL_WARM_UP = WARM_UP | {"minus_di": 14, "dx": 14, "bb_low": 20, "bb_high": 20, "st_side": 6}
WINDOWED = ("cci", "bb_mid", "bb_low", "bb_high", "rgvb")


def indicators_long(wide: DataFrame, names: Iterable[str]) -> DataFrame:
    """One row for each ticker, date and indicator that has a value."""
    names = list(names)
    each = F.stack(F.lit(len(names)), *[x for n in names for x in (F.lit(n), F.col(n).cast("double"))]).alias("indicator", "value")
    return wide.select(*TICKER, F.col("period_date").alias("date"), each).where("value is not null")


def indicator_integrity(bars: DataFrame, long: DataFrame) -> DataFrame:
    """Tickers and indicators whose number of values isn't bars less warm-up."""
    expected = bars.groupBy(*TICKER).agg(F.count("*").alias("n"))
    warm = F.create_map(*[F.lit(x) for kv in WARM_UP.items() for x in kv])
    have = long.groupBy(*TICKER, "indicator").agg(F.count("*").alias("values"))
    return have.join(expected, TICKER).withColumn("expected", F.greatest(F.col("n") - F.element_at(warm, F.col("indicator")), F.lit(0))).select(*TICKER, "indicator", "values", "expected")


def _stale(days: np.ndarray, stored: list[dict]) -> Iterator[tuple[str, int, float | None]]:
    """Indicator, the row from which it is to be made, and the stored value to go on from (None: made from the bars), for
    what isn't up to date. days: a ticker's dates in order; stored: for each of its indicators, the last stored date, the
    number of rows and the last value."""
    had = {r["indicator"]: r for r in stored}
    known = days[~np.isnat(days)]
    for name, warm in ALL_WARM_UP.items():
        if len(days) <= warm:
            continue
        r = had.get(name)
        if r is None or r["had_last"] is None or not len(known):
            yield name, 0, None
            continue
        end = np.datetime64(r["had_last"], "D")
        then = int(np.searchsorted(known, end, "right"))
        if r["had"] != max(then - warm, 0):
            yield name, 0, None
        elif end != known[-1]:
            resumes = name in WINDOWED or name.startswith("ema")
            yield name, len(days) - len(known) + then if resumes else 0, r["had_value"] if name.startswith("ema") else None


def refresh_indicators(bars: DataFrame, stored: DataFrame) -> DataFrame:
    """Indicator rows to write (ticker, date, indicator, value), given the stored ones of the same form.

    A ticker's indicator without stored rows, or with another number of them than its bars up to the last stored date
    give, is made in full; so is a smoothed one (RSI, +-DI, DX, ADX, ATR, SuperTrend, MACD) that ends before the last bar.
    Of an EMA that ends earlier only the later rows are made, from its last stored value on; of a windowed one, from the
    bars. Tickers with too few bars for an indicator have no rows of it.

    Stored rows are counted by ticker and indicator first, and the counts come to the bars as one list a ticker. From there
    on a bar is one row with all its indicators, dealt and sorted once; it falls into one row for each at the very end.
    """
    had = stored.groupBy(*TICKER, "indicator").agg(F.max("date").alias("had_last"), F.count("*").alias("had"), F.max_by("value", "date").alias("had_value"))
    lists = had.groupBy(*TICKER).agg(F.collect_list(F.struct("indicator", "had_last", "had", "had_value")).alias("all"))
    needed = bars.where("exchange is not null and symbol is not null").select(*TICKER, "period_date", "high", "low", "close")
    told = beside(needed, {"_had": lists.withColumn("period_date", F.lit(None).cast("date"))}, {})
    # a ticker's list stays on its first bar only
    told = told.withColumn("_had", F.when(F.row_number().over(ordered()) == 1, F.col("_had.all")))
    windowed = rgvb(bollinger(cci(told))).withColumn("rgvb", F.col("rgvb").cast("double"))
    names = sorted(ALL_WARM_UP)
    a = {p: DEFAULTS["smoothing"] / (p + 1) for p in EMA_PERIODS}

    def several(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.concat_batches(groups)
        sizes = np.array([g.num_rows for g in groups])
        starts = np.cumsum(sizes) - sizes
        days = t.column("period_date").to_numpy(zero_copy_only=False).astype("datetime64[D]")
        close = t.column("close").to_numpy(zero_copy_only=False).astype(float)
        todo = [list(_stale(days[i : i + n], t.column("_had")[i].as_py() or [])) for i, n in zip(starts, sizes)]
        made = {n: np.full(t.num_rows, np.nan) for n in names if n not in WINDOWED}
        write = {n: np.zeros(t.num_rows, bool) for n in names}
        whole = [k for k, stale in enumerate(todo) if any(n not in WINDOWED and v is None for n, _, v in stale)]
        if whole:
            real = np.arange(sizes[whole].max()) < sizes[whole, None]
            rows = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in whole])
            padded = []
            for c in ("high", "low", "close"):
                padded.append(np.full(real.shape, np.nan))
                padded[-1][real] = t.column(c).to_numpy(zero_copy_only=False).astype(float)[rows]
            which = sorted({n for k in whole for n, _, v in todo[k] if n not in WINDOWED and v is None})
            for n, v in _recursions(*padded, which, "reference", DEFAULTS).items():
                made[n][rows] = np.where(v[real] == 0, np.nan, v[real]) if n == "st_side" else v[real]
        for stale, i, n in zip(todo, starts, sizes):
            for name, at, value in stale:
                write[name][i + at : i + n] = True
                if value is not None:
                    p = int(name[3:])
                    for k in range(i + at, i + n):
                        made[name][k] = value = float(close[k - p + 1] * a[p] + value * (1 - a[p]))
        columns = [t.column(c) for c in (*TICKER, "period_date")]
        for n in names:
            if n in WINDOWED:
                columns.append(pc.if_else(pa.array(write[n]), t.column(n), pa.scalar(None, pa.float64())))
            else:
                columns.append(pa.array(made[n], mask=~write[n] | np.isnan(made[n])))
        return pa.RecordBatch.from_arrays(columns, names=[*TICKER, "period_date", *names])

    schema = f"exchange string, symbol string, period_date date, {', '.join(f'{n} double' for n in names)}"
    wide = runs(windowed.select(*TICKER, "period_date", "high", "low", "close", *WINDOWED, "_had"), TICKER, ["period_date"], several, schema)
    return indicators_long(wide, names).select(*TICKER, "date", "indicator", "value")
