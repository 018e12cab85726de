"""Registered queries: indicators (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..registry import register
from ..session import written
from ..sources.bars import numbered
from .fixtures import BARS_SQL, bars, r4

KEY = ["exchange", "symbol", "period_date"]
K = "exchange, symbol, period_date"
RECURSE = f"with recursive {BARS_SQL}"
TR = "greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) as tr"


@register("t1_true_range", f"with {BARS_SQL} select {K}, round(case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end, 4) as tr from b")
def t1(spark, d):
    return ind.true_range(bars(spark, d)).select(*KEY, r4("tr").alias("tr"))


@register("t2_atr_sma", f"with {BARS_SQL}, t as (select *, {TR} from b) select {K}, case when rn >= 13 then round(avg(tr) over (partition by exchange, symbol order by period_date rows 13 preceding), 4) end as atr from t")
def t2_sma(spark, d):
    return ind.atr_sma(bars(spark, d)).select(*KEY, r4("atr").alias("atr"))


def _wilder(step: str) -> str:
    return f"""{RECURSE}, t as (select exchange, symbol, period_date, rn, {TR} from b),
r(exchange, symbol, rn, v) as (
  select exchange, symbol, 13::bigint, avg(tr) from t where rn < 14 group by 1, 2 having count(*) = 14
  union all select r.exchange, r.symbol, t.rn, {step} from r join t on t.exchange = r.exchange and t.symbol = r.symbol and t.rn = r.rn + 1)
select {K}, round(v, 4) as atr from r join t using (exchange, symbol, rn)"""


@register("t2_atr_wilder", _wilder("(r.v * 13 + t.tr) / 14"))
def t2_wilder(spark, d):
    return ind.recursive(bars(spark, d), ["atr"]).where("atr is not null").select(*KEY, r4("atr").alias("atr"))


@register("t2_atr_ema", _wilder("r.v + (t.tr - r.v) * 2 / 15"))
def t2_ema(spark, d):
    return ind.recursive(bars(spark, d), ["atr"], periods={"atr_method": "EMA"}).where("atr is not null").select(*KEY, r4("atr").alias("atr"))


@register(
    "t3_rsi",
    f"""{RECURSE}, t as (select *, greatest(close - pc, 0) as g, greatest(pc - close, 0) as l from b where rn > 0),
r(exchange, symbol, rn, g, l) as (
  select exchange, symbol, 14::bigint, avg(g), avg(l) from t where rn <= 14 group by 1, 2 having count(*) = 14
  union all select r.exchange, r.symbol, t.rn, (r.g * 13 + t.g) / 14, (r.l * 13 + t.l) / 14 from r join t on t.exchange = r.exchange and t.symbol = r.symbol and t.rn = r.rn + 1)
select {K}, round(case when r.l = 0 then 100 else 100 - 100 / (1 + r.g / r.l) end, 4) as rsi from r join b using (exchange, symbol, rn)""",
)
def t3(spark, d):
    return ind.recursive(bars(spark, d), ["rsi"]).where("rsi is not null").select(*KEY, r4("rsi").alias("rsi"))


@register(
    "t4_cci",
    f"""with {BARS_SQL}, t as (select *, (high + low + close) / 3 as tp from b),
m as (select *, avg(tp) over w as mean, list(tp) over w as l from t window w as (partition by exchange, symbol order by period_date rows 19 preceding)),
s as (select *, list_sum(list_transform(l, lambda x: abs(x - mean))) / 20 as md from m)
select {K}, case when rn >= 19 then round(case when md = 0 then 0 else (tp - mean) / (0.015 * md) end, 4) end as cci from s""",
)
def t4(spark, d):
    return ind.cci(bars(spark, d)).select(*KEY, r4("cci").alias("cci"))


@register(
    "t5_directional_movement",
    f"""with {BARS_SQL}, t as (select *, high - ph as up, pl - low as down from b)
select {K}, round(case when up is null then null when up > down and up > 0 then up else 0 end, 4) as plus_dm,
  round(case when up is null then null when down > up and down > 0 then down else 0 end, 4) as minus_dm from t""",
)
def t5(spark, d):
    return ind.directional_movement(bars(spark, d)).select(*KEY, r4("plus_dm").alias("plus_dm"), r4("minus_dm").alias("minus_dm"))


DI = f"""{RECURSE}, t as (select exchange, symbol, period_date, rn, greatest(high - low, abs(high - pc), abs(low - pc)) as tr,
    case when high - ph > pl - low and high > ph then high - ph else 0 end as p, case when pl - low > high - ph and pl > low then pl - low else 0 end as m from b where rn > 0),
r(exchange, symbol, rn, p, m, tr) as (
  select exchange, symbol, 14::bigint, sum(p), sum(m), sum(tr) from t where rn <= 14 group by 1, 2 having count(*) = 14
  union all select r.exchange, r.symbol, t.rn, r.p - r.p / 14 + t.p, r.m - r.m / 14 + t.m, r.tr - r.tr / 14 + t.tr from r join t on t.exchange = r.exchange and t.symbol = r.symbol and t.rn = r.rn + 1),
di as (select exchange, symbol, rn, case when tr = 0 then 0 else 100 * p / tr end as p, case when tr = 0 then 0 else 100 * m / tr end as m from r),
dx as (select *, case when p + m = 0 then 0 else 100 * abs(p - m) / abs(p + m) end as x from di)"""


@register("t6_directional_indicators", f"{DI} select {K}, round(p, 4) as plus_di, round(m, 4) as minus_di from di join b using (exchange, symbol, rn)")
def t6(spark, d):
    return ind.recursive(bars(spark, d), ["plus_di", "minus_di"]).where("plus_di is not null").select(*KEY, r4("plus_di").alias("plus_di"), r4("minus_di").alias("minus_di"))


@register("t7_dx", f"{DI} select {K}, round(x, 4) as dx from dx join b using (exchange, symbol, rn)")
def t7(spark, d):
    return ind.recursive(bars(spark, d), ["dx"]).where("dx is not null").select(*KEY, r4("dx").alias("dx"))


@register(
    "t8_adx",
    f"""{DI}, a(exchange, symbol, rn, v) as (
  select exchange, symbol, 27::bigint, avg(x) from dx where rn < 28 group by 1, 2 having count(*) = 14
  union all select a.exchange, a.symbol, dx.rn, (a.v * 13 + dx.x) / 14 from a join dx on dx.exchange = a.exchange and dx.symbol = a.symbol and dx.rn = a.rn + 1)
select {K}, round(v, 4) as adx from a join b using (exchange, symbol, rn)""",
)
def t8(spark, d):
    return ind.recursive(bars(spark, d), ["adx"]).where("adx is not null").select(*KEY, r4("adx").alias("adx"))


def _ema(name: str, p: int, variant: str = "reference") -> str:
    take = "e.rn + 1" if variant == "textbook" else f"e.rn + 1 - {p - 1}"
    return f"""{name}(exchange, symbol, rn, n, v) as (
  select exchange, symbol, {p - 1}::bigint, any_value(n), avg(close) from b where rn < {p} group by 1, 2 having count(*) = {p}
  union all select e.exchange, e.symbol, e.rn + 1, e.n, b.close * 2 / {p + 1} + e.v * (1 - 2.0 / {p + 1}) from {name} e join b on b.exchange = e.exchange and b.symbol = e.symbol and b.rn = {take} where e.rn + 1 < e.n)"""


_EMAS = "select * from (" + " union all ".join(f"select exchange, symbol, rn, {p} as period, v from e{p}" for p in ind.EMA_PERIODS) + ") x"


@register("t9_ema", f"{RECURSE}, {', '.join(_ema(f'e{p}', p) for p in ind.EMA_PERIODS)} select {K}, period::int as period, round(v, 4) as ema from ({_EMAS}) join b using (exchange, symbol, rn)")
def t9(spark, d):
    wide = ind.recursive(bars(spark, d), [f"ema{p}" for p in ind.EMA_PERIODS])
    each = F.stack(F.lit(len(ind.EMA_PERIODS)), *[x for p in ind.EMA_PERIODS for x in (F.lit(p), F.col(f"ema{p}"))]).alias("period", "ema")
    return wide.select(*KEY, each).where("ema is not null").select(*KEY, "period", r4("ema").alias("ema"))


@register("t9_ema_textbook", f"{RECURSE}, {_ema('e', 20, 'textbook')} select {K}, round(v, 4) as ema from e join b using (exchange, symbol, rn)")
def t9_textbook(spark, d):
    return ind.recursive(bars(spark, d), ["ema20"], "textbook").where("ema20 is not null").select(*KEY, r4("ema20").alias("ema"))


@register("t10_macd", f"{RECURSE}, {_ema('f', 12)}, {_ema('s', 26)} select {K}, round(f.v - s.v, 4) as macd from b join f on f.exchange = b.exchange and f.symbol = b.symbol and f.rn = b.rn - 15 join s on s.exchange = b.exchange and s.symbol = b.symbol and s.rn = b.rn - 1".replace(f"select {K}", "select b.exchange, b.symbol, b.period_date"))
def t10(spark, d):
    return ind.recursive(bars(spark, d), ["macd"]).where("macd is not null").select(*KEY, r4("macd").alias("macd"))


@register(
    "t11_bollinger",
    f"""with {BARS_SQL}, t as (select *, avg(close) over w as m, stddev_pop(close) over w as s from b window w as (partition by exchange, symbol order by period_date rows between 20 preceding and 1 preceding))
select {K}, round(m, 4) as bb_mid, round(m - 2 * s, 4) as bb_low, round(m + 2 * s, 4) as bb_high from t where rn >= 20""",
)
def t11(spark, d):
    return ind.bollinger(bars(spark, d)).where("bb_mid is not null").select(*KEY, *[r4(c).alias(c) for c in ("bb_mid", "bb_low", "bb_high")])


@register(
    "t12_supertrend",
    f"""{RECURSE}, t as (select exchange, symbol, period_date, rn, high, low, close, pc, {TR} from b),
a(exchange, symbol, rn, v) as (
  select exchange, symbol, 6::bigint, avg(tr) from t where rn < 7 group by 1, 2 having count(*) = 7
  union all select a.exchange, a.symbol, t.rn, (a.v * 6 + t.tr) / 7 from a join t on t.exchange = a.exchange and t.symbol = a.symbol and t.rn = a.rn + 1),
bands as (select t.*, (high + low) / 2 + 3.0 * v as hi, (high + low) / 2 - 3.0 * v as lo from t join a using (exchange, symbol, rn)),
r(exchange, symbol, rn, fu, fl, st, close) as (
  select exchange, symbol, rn, hi, lo, case when close < hi then hi else lo end, close from bands where rn = 6
  union all select exchange, symbol, rn, fu, fl, case when (pst = pfu and close <= fu) or (pst = pfl and close <= fl) then fu else fl end, close from (
    select x.exchange, x.symbol, x.rn, x.close, r.st as pst, r.fu as pfu, r.fl as pfl,
      case when x.hi < r.fu or x.pc > r.fu then x.hi else r.fu end as fu, case when x.lo > r.fl or x.pc < r.fl then x.lo else r.fl end as fl
    from r join bands x on x.exchange = r.exchange and x.symbol = r.symbol and x.rn = r.rn + 1))
select b.exchange, b.symbol, b.period_date, round(st, 4) as st, case when r.close > st then 1 else -1 end as st_side from r join b using (exchange, symbol, rn)""",
)
def t12(spark, d):
    return ind.recursive(bars(spark, d), ["st", "st_side"]).where("st is not null").select(*KEY, r4("st").alias("st"), "st_side")


@register("t13_rgvb", f"with {BARS_SQL} select {K}, case when close > pc then 1 else 0 end as rgvb from b")
def t13(spark, d):
    return ind.rgvb(bars(spark, d)).select(*KEY, "rgvb")


_WARM = "values " + ", ".join(f"('{k}', {v})" for k, v in sorted(ind.WARM_UP.items()))


@register("t14_indicator_integrity", f"with {BARS_SQL}, w(indicator, warm) as ({_WARM}) select exchange, symbol, indicator, greatest(n - warm, 0) as values, greatest(n - warm, 0) as expected from (select exchange, symbol, count(*) as n from bars group by 1, 2), w where n > warm")
def t14(spark, d):
    df = bars(spark, d)
    return ind.indicator_integrity(df, ind.indicators_long(ind.indicators(df), sorted(ind.WARM_UP)))


@register("t16_indicators_long", f"with {BARS_SQL} select exchange, symbol, period_date as date, 'rgvb' as indicator, round(case when close > pc then 1 else 0 end, 4)::double as value from b union all select exchange, symbol, period_date, 'bb_mid', round(avg(close) over (partition by exchange, symbol order by period_date rows between 20 preceding and 1 preceding), 4) from b qualify rn >= 20")
def t16(spark, d):
    wide = ind.rgvb(ind.bollinger(bars(spark, d)))
    return ind.indicators_long(wide, ["rgvb", "bb_mid"]).withColumn("value", r4("value"))


_ALL = f"""{RECURSE}, t as (select *, {TR}, greatest(close - pc, 0) as g, greatest(pc - close, 0) as l,
    case when high - ph > pl - low and high > ph then high - ph else 0 end as p, case when pl - low > high - ph and pl > low then pl - low else 0 end as m from b),
atr(exchange, symbol, rn, v) as (
  select exchange, symbol, 13::bigint, avg(tr) from t where rn < 14 group by 1, 2 having count(*) = 14
  union all select r.exchange, r.symbol, t.rn, (r.v * 13 + t.tr) / 14 from atr r join t on t.exchange = r.exchange and t.symbol = r.symbol and t.rn = r.rn + 1),
rsi(exchange, symbol, rn, g, l) as (
  select exchange, symbol, 14::bigint, avg(g), avg(l) from t where rn between 1 and 14 group by 1, 2 having count(*) = 14
  union all select r.exchange, r.symbol, t.rn, (r.g * 13 + t.g) / 14, (r.l * 13 + t.l) / 14 from rsi r join t on t.exchange = r.exchange and t.symbol = r.symbol and t.rn = r.rn + 1),
sums(exchange, symbol, rn, p, m, tr) as (
  select exchange, symbol, 14::bigint, sum(p), sum(m), sum(tr) from t where rn between 1 and 14 group by 1, 2 having count(*) = 14
  union all select r.exchange, r.symbol, t.rn, r.p - r.p / 14 + t.p, r.m - r.m / 14 + t.m, r.tr - r.tr / 14 + t.tr from sums r join t on t.exchange = r.exchange and t.symbol = r.symbol and t.rn = r.rn + 1),
di as (select exchange, symbol, rn, case when tr = 0 then 0 else 100 * p / tr end as p, case when tr = 0 then 0 else 100 * m / tr end as m from sums),
dx as (select *, case when p + m = 0 then 0 else 100 * abs(p - m) / abs(p + m) end as x from di),
adx(exchange, symbol, rn, v) as (
  select exchange, symbol, 27::bigint, avg(x) from dx where rn < 28 group by 1, 2 having count(*) = 14
  union all select a.exchange, a.symbol, dx.rn, (a.v * 13 + dx.x) / 14 from adx a join dx on dx.exchange = a.exchange and dx.symbol = a.symbol and dx.rn = a.rn + 1),
{", ".join(_ema(f"e{p}", p) for p in ind.EMA_PERIODS)},
atr7(exchange, symbol, rn, v) as (
  select exchange, symbol, 6::bigint, avg(tr) from t where rn < 7 group by 1, 2 having count(*) = 7
  union all select a.exchange, a.symbol, t.rn, (a.v * 6 + t.tr) / 7 from atr7 a join t on t.exchange = a.exchange and t.symbol = a.symbol and t.rn = a.rn + 1),
bands as (select t.exchange, t.symbol, t.rn, close, pc, (high + low) / 2 + 3.0 * v as hi, (high + low) / 2 - 3.0 * v as lo from t join atr7 using (exchange, symbol, rn)),
st(exchange, symbol, rn, fu, fl, st, close) as (
  select exchange, symbol, rn, hi, lo, case when close < hi then hi else lo end, close from bands where rn = 6
  union all select exchange, symbol, rn, fu, fl, case when (pst = pfu and close <= fu) or (pst = pfl and close <= fl) then fu else fl end, close from (
    select x.exchange, x.symbol, x.rn, x.close, r.st as pst, r.fu as pfu, r.fl as pfl,
      case when x.hi < r.fu or x.pc > r.fu then x.hi else r.fu end as fu, case when x.lo > r.fl or x.pc < r.fl then x.lo else r.fl end as fl
    from st r join bands x on x.exchange = r.exchange and x.symbol = r.symbol and x.rn = r.rn + 1)),
w as (select *, avg((high + low + close) / 3) over last20 as mean, list((high + low + close) / 3) over last20 as l20, avg(close) over before as bm, stddev_pop(close) over before as bs
  from b window last20 as (partition by exchange, symbol order by period_date rows 19 preceding), before as (partition by exchange, symbol order by period_date rows between 20 preceding and 1 preceding)),
c as (select *, list_sum(list_transform(l20, lambda x: abs(x - mean))) / 20 as md from w),
wide as (select b.exchange, b.symbol, b.period_date, b.rn, b.n,
    atr.v as atr, case when rsi.l = 0 then 100 else 100 - 100 / (1 + rsi.g / rsi.l) end as rsi, dx.p as plus_di, dx.m as minus_di, dx.x as dx, adx.v as adx,
    {", ".join(f"e{p}.v as ema{p}" for p in ind.EMA_PERIODS)}, f.v - s.v as macd, st.st as st, (case when st.close > st.st then 1 when st.st is not null then -1 end)::double as st_side,
    case when b.rn >= 19 then case when md = 0 then 0 else ((b.high + b.low + b.close) / 3 - mean) / (0.015 * md) end end as cci,
    case when b.rn >= 20 then bm end as bb_mid, case when b.rn >= 20 then bm - 2 * bs end as bb_low, case when b.rn >= 20 then bm + 2 * bs end as bb_high, (case when b.close > b.pc then 1 else 0 end)::double as rgvb
  from b join c using (exchange, symbol, rn) {" ".join(f"left join {x} using (exchange, symbol, rn)" for x in ("atr", "rsi", "dx", "adx", *(f"e{p}" for p in ind.EMA_PERIODS), "st"))}
  left join e12 f on f.exchange = b.exchange and f.symbol = b.symbol and f.rn = b.rn - 15 and b.rn >= 26 left join e26 s on s.exchange = b.exchange and s.symbol = b.symbol and s.rn = b.rn - 1)"""
_NAMES = sorted(ind.ALL_WARM_UP)


@register("t15_indicators", f"{_ALL} select {K}, {', '.join(f'round({n}, 4) as {n}' for n in _NAMES)} from wide")
def t15(spark, d):
    return ind.indicators(bars(spark, d)).select(*KEY, *[r4(F.col(n).cast("double")).alias(n) for n in _NAMES])


_RESUMED = ", ".join(f"'{n}'" for n in _NAMES if n in ind.WINDOWED or n.startswith("ema"))


@register(
    "t17_refresh_indicators",
    f"""{_ALL}, long as (select exchange, symbol, period_date as date, rn, n, indicator, value from (unpivot wide on {", ".join(_NAMES)} into name indicator value value))
select exchange, symbol, date, indicator, round(value, 4) as value from long where symbol::int % 4 >= 2 or (symbol::int % 4 = 1 and (rn = n - 1 or indicator not in ({_RESUMED})))""",
)
def t17(spark, d):
    """A quarter of the tickers is up to date, one lacks the last bar, one lacks a row within, one has nothing stored."""
    df = written(bars(spark, d).select(*KEY, "high", "low", "close"), "bars")
    of = F.col("symbol").cast("int") % 4
    gap = F.when((of == 1) & (F.col("idx") == F.col("n") - 1), "last").when((of == 2) & (F.col("idx") == F.col("n") - 2), "within")
    stored = ind.indicators_long(ind.indicators(numbered(df.where(of < 3))).where(gap.isNull()), _NAMES)
    return ind.refresh_indicators(df, stored).withColumn("value", r4("value"))
