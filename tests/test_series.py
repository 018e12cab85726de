"""Next earnings, missing days, refreshed indicators, saved sets and caps, on small tables by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind
from tickloom.operators import joins, labels, normalize, quality

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(k)


def test_next_earnings_by_scanning(spark):
    rng = random.Random(4)
    days = [("X", s, day(rng.randrange(60)), n) for n, s in enumerate("AABBBCD" * 12)] + [("X", "A", None, 999)]
    rows = [("X", s, rng.choice([None, *range(5, 50)]), rng.choice([None, *range(5, 60)])) for s in "AAAABBC" * 3] + [("X", "C", 20, 25)]
    rows = [(x, s, a if a is None else day(a), b if b is None else day(b)) for x, s, a, b in rows]
    low = dt.date(1, 1, 1)

    def scan(symbol, at):
        mine = sorted((r[2:] for r in rows if r[1] == symbol), key=lambda r: (r[0] or low, r[1] or low))
        if not mine:
            return None
        inputs = [a for a, _ in mine if a]
        for k in range(len(mine) - 2, -1, -1):
            a, b = mine[k]
            early = mine[0][0] is not None and at is not None and at < mine[0][0]
            cut = max(inputs) if early else at
            if at and a and b and mine[k + 1][1] and a <= cut and b < at:
                return mine[k + 1][1]
        return mine[0][1]

    asked = spark.createDataFrame(days, "exchange string, symbol string, period_date date, at int")
    known = spark.createDataFrame(rows, "exchange string, symbol string, input_date date, earnings_date date")
    out = joins.next_earnings(asked, known)
    assert out.columns == ["exchange", "symbol", "period_date", "at", "next_date"]
    assert {r["at"]: r["next_date"] for r in out.collect()} == {n: scan(s, at) for _, s, at, n in days}
    assert joins.next_earnings(asked.limit(0), known).count() == 0
    assert {r["next_date"] for r in joins.next_earnings(asked, known.limit(0)).collect()} == {None}


def test_missing_days(spark):
    calendar = spark.createDataFrame([(day(k), n) for n, k in enumerate((0, 1, 2, 5, 6, 7, 8))], "date date, ordinal int")
    have = spark.createDataFrame([("X", "A", day(1)), ("X", "A", day(6)), ("X", "B", day(3)), ("X", "C", None)], "exchange string, symbol string, period_date date")
    assert sorted((r["symbol"], r["period_date"], r["ordinal"]) for r in quality.find_gaps(have, calendar).collect()) == [("A", day(2), 2), ("A", day(5), 3)]


def test_caps_without_tickers(spark):
    bars = spark.createDataFrame([("X", str(i), float(i), 1.0) for i in range(5)], "exchange string, symbol string, high double, volume double")
    out = spark.range(120_000).select(F.lit("X").alias("exchange"), F.when(F.col("id") < 119_999, F.concat(F.lit("Z"), F.col("id").cast("string"))).otherwise("4").alias("symbol"))
    assert normalize.caps(bars, {"high": "max"}, exclude=out).first()["high_cap"] == 3.0


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(6)
    rows = []
    for s, n in (("A", 260), ("B", 260), ("C", 40), ("D", 260), ("E", 3)):
        close = 100.0
        for k in range(n):
            close += rng.uniform(-3, 3)
            rows.append(("X", s, day(k), close + rng.random(), close - rng.random(), close, k))
    return spark.createDataFrame(rows, "exchange string, symbol string, period_date date, high double, low double, close double, k int")


def long_of(df):
    return ind.indicators_long(ind.indicators(df), sorted(ind.ALL_WARM_UP))


def test_indicators_keep_the_columns(spark, bars):
    more = bars.withColumn("note", F.when(F.col("k") % 2 == 0, F.lit(2**60 + 1)))
    out = ind.indicators(more)
    assert out.columns[: len(more.columns)] == more.columns and out.count() == more.count()
    assert out.where("note is null").count() == more.where("note is null").count() and out.where(f"note = {2**60 + 1}").count() > 0
    plan = ind.indicators(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_refresh(spark, bars):
    whole = {(r["symbol"], r["date"], r["indicator"]): r["value"] for r in long_of(bars).collect()}
    # A lacks its last five days, B all of one indicator and a row of another, C has nothing, D everything
    stored = long_of(bars.where("symbol = 'A' and k < 255")).unionByName(long_of(bars.where("symbol = 'D'")))
    stored = stored.unionByName(long_of(bars.where("symbol = 'B'")).where(f"indicator <> 'rsi' and not (indicator = 'ema20' and date = date'{day(100)}')"))
    got = {(r["symbol"], r["date"], r["indicator"]): r["value"] for r in ind.refresh_indicators(bars, stored).collect()}
    goes_on = {*ind.WINDOWED, *(f"ema{p}" for p in ind.EMA_PERIODS)}
    want = {k: v for k, v in whole.items() if k[0] in "CE" or (k[0] == "B" and k[2] in ("rsi", "ema20")) or (k[0] == "A" and (k[2] not in goes_on or k[1] >= day(255)))}
    assert got == pytest.approx(want)
    # what is written on top of what is stored gives the whole
    assert ind.refresh_indicators(bars, long_of(bars)).count() == 0


def test_refresh_deals_bars_once(spark, bars):
    """Stored rows are dealt as counts, bars once; single indicators' rows meet no join, which would move them all."""
    stored = bars.select("exchange", "symbol", F.col("period_date").alias("date"), F.lit("rsi").alias("indicator"), F.col("close").alias("value"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ind.refresh_indicators(bars, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Join" not in plan and "CoGroup" not in plan
    assert plan.count("Exchange") == 3  # of counts, of lists of them, of bars with these
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_refresh_of_odd_rows(spark, bars):
    whole = {(r["symbol"], r["date"], r["indicator"]): r["value"] for r in long_of(bars).collect()}
    ema5 = F.col("indicator") == "ema5"
    # A's last value of an EMA is lost, B has a row without a date, D is stored up to a day that it has no bar of; a bar has no ticker
    a = long_of(bars.where("symbol = 'A' and k < 250")).withColumn("value", F.when(~ema5 | (F.col("date") < day(249)), F.col("value")))
    b = long_of(bars.where("symbol = 'B'")).withColumn("date", F.when(~ema5 | (F.col("date") > day(100)), F.col("date")))
    d = long_of(bars.where("symbol = 'D'")).withColumn("date", F.when(ema5 & (F.col("date") == day(259)), day(300)).otherwise(F.col("date")))
    more = bars.unionByName(bars.where("symbol = 'A' and k = 7").withColumn("symbol", F.lit(None).cast("string")))
    got = {(r["symbol"], r["date"], r["indicator"]): r["value"] for r in ind.refresh_indicators(more, a.unionByName(b).unionByName(d)).collect()}
    goes_on = {*ind.WINDOWED, *(f"ema{p}" for p in ind.EMA_PERIODS)}
    want = {k: v for k, v in whole.items() if k[0] in "CE" or (k[0] == "A" and (k[2] not in goes_on or k[1] >= day(250)))}
    assert got == pytest.approx(want)


def test_sample_that_is_short_fails(spark):
    rows = [("X", str(i), DAY, "POSITIVE" if i < 3 else "NEGATIVE") for i in range(60)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, period_date date, cls string")
    assert labels.balanced_sample(df, 18).count() == 18
    assert labels.balanced_sample(df, 60, allow_short=True).count() == 53
    for short in (df, df.where("cls = 'NEGATIVE'")):
        with pytest.raises(Exception, match="not enough instances"):
            labels.balanced_sample(short, 60).collect()


def test_saved_sets(spark, tmp_path):
    path = str(tmp_path / "sets")
    df = spark.createDataFrame([("X", str(i), day(i), "train" if i < 7 else "test") for i in range(10)], "exchange string, symbol string, period_date date, part string")
    assert labels.read_sets(spark, path, "n") is None
    assert labels.save_sets(df.limit(4), path, "n") == 1
    assert labels.save_sets(df, path, "n", 3) == 3
    assert labels.save_sets(df.where("part = 'test'"), path, "n") == 3  # the latest, in place of what was there
    assert labels.save_sets(df, path, "m") == 1
    n = {(r["set_id"], r["part"]): r["count"] for r in labels.read_sets(spark, path, "n").groupBy("set_id", "part").count().collect()}
    assert n == {(1, "train"): 4, (3, "test"): 3}
    assert labels.read_sets(spark, path, "m", 1).count() == 10 and labels.read_sets(spark, path, "m", 2).count() == 0


def test_longest_gaps_are_those_of_the_missing_days(spark):
    """Against the missing days themselves, with bars on weekends, repeated bars, and first and last bars on closed days."""
    from tickloom.operators import calendar as cal

    rng = random.Random(4)
    start = dt.date(2020, 1, 1)
    rows = [("X", f"S{k}", start + dt.timedelta(days=rng.randrange(600))) for k in range(12) for _ in range(rng.choice((2, 8, 30)))]
    bars = spark.createDataFrame(rows + rows[:3], "exchange string, symbol string, period_date date")
    days = cal.market_days(spark, 2020, 2021)
    listed = {r["date"]: r["ordinal"] for r in days.collect()}
    gaps, brute = set(), {}
    for k in range(12):
        own = {d for _, s, d in rows if s == f"S{k}"}
        run = 0
        for d in sorted(x for x in listed if min(own) <= x <= max(own)):
            run = 0 if d in own else run + 1
            if d not in own:
                gaps.add((f"S{k}", d, listed[d]))
            brute[f"S{k}"] = max(brute.get(f"S{k}", 0), run)
    assert {tuple(r) for r in quality.find_gaps(bars, days).select("symbol", "period_date", "ordinal").collect()} == gaps
    for out in (quality.longest_gaps(bars, cal.calendar(spark, 2020, 2021), 20), quality.damaged_tickers(quality.find_gaps(bars, days), 20)):
        assert {r["symbol"]: r["longest"] for r in out.collect()} == {s: n for s, n in brute.items() if n > 20}
    plan = quality.longest_gaps(bars, cal.calendar(spark, 2020, 2021), 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan.split("Window")[0] and "explode" not in plan.split("Window")[0]


def test_weeks_of_streams_are_not_joined(spark):
    from tickloom.operators import interest as gi

    day = dt.date(2020, 1, 1)  # a Wednesday
    rows = [("X", "A", day + dt.timedelta(days=k + 5 * s), s, float(k)) for s in (0, 1, 2) for k in range(20)]
    out = gi.week_blocks(spark.createDataFrame(rows, "exchange string, symbol string, date date, stream int, relative_interest double"))
    weeks = {}
    for _, _, d, s, _ in rows:
        weeks.setdefault((s, d + dt.timedelta(days=(5 - d.weekday()) % 7)), []).append(d)
    keep = set()
    for (s, end), own in weeks.items():
        ends = [e for t, e in weeks if t == s]
        if not (len(own) < 7 and (s > 0 and end == min(ends) or s < 2 and end == max(ends))):
            keep |= {(s, d, end) for d in own}
    assert {(r["stream"], r["date"], r["week_end"]) for r in out.collect()} == keep
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_no_frame_runs_to_the_end_of_a_ticker(spark):
    """A frame without an end costs as many rows as follow, for every row; the next real day comes from the reverse order."""
    from tickloom import registry

    for name in ("c7_fill_option_gaps", "j12_real_neighbours"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedfollowing" not in plan
    cols = "ticker string, expiration_date date, period_date date, open double, high double, low double, close double"
    bars = spark.createDataFrame([("O", day(20), day(k), *[float(k)] * 4) for k in (0, 4, 9)], cols)
    gaps = spark.createDataFrame([("O", day(20), day(k)) for k in (1, 2, 7, 15)], "ticker string, expiration_date date, period_date date")
    got = {r["period_date"]: r["high"] for r in quality.fill_option_gaps(bars, gaps).collect()}
    assert got == pytest.approx({day(0): 0, day(1): 1, day(2): 2, day(4): 4, day(7): 7, day(9): 9, day(15): 4.5, day(21): 0})


def test_reduced_instances_are_labelled_once(spark):
    from tickloom import registry
    from tickloom.functions.scalars import is_fibonacci

    plan = registry.queries()["l9_reduce_descending"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan and "SQRT" not in plan
    told = spark.range(-3, 1000).where(is_fibonacci(F.col("id"))).collect()
    assert [r["id"] for r in told] == [0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987]
