"""Joins on ticker, and joins to the latest or the then-known row."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TICKER


def latest_minute(symbols: DataFrame, minute: DataFrame) -> DataFrame:
    last = minute.groupBy(*TICKER).agg(F.max("timestamp").alias("latest"))
    return symbols.join(last, TICKER, "left")


def semi(df: DataFrame, t: DataFrame) -> DataFrame:
    return df.join(t.select(*TICKER), TICKER, "left_semi")


def anti(df: DataFrame, t: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or TICKER
    return df.join(t.select(*keys), keys, "left_anti")


def join_latest(df: DataFrame, t: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with t's row of greatest `order` per key (ties: the greatest row)."""
    rest = [c for c in t.columns if c not in keys]
    last = t.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_l"))
    return df.join(last.select(*keys, "_l.*"), keys)


def with_vix(bars: DataFrame, vix: DataFrame) -> DataFrame:
    """bars with the index values of the day; one row a day, some ten thousand at most."""
    cols = [F.col(c).alias(f"vix_{c}") for c in ("open", "high", "low", "close")]
    return bars.join(F.broadcast(vix.select("period_date", *cols)), "period_date", "left")


def splits_in_range(instances: DataFrame, splits: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """instances with the splits after start up to end: ticker equality with two inequalities."""
    s = splits.withColumnsRenamed({c: f"_{c}" for c in TICKER})
    cond = (instances["exchange"] == s["_exchange"]) & (instances["symbol"] == s["_symbol"]) & (s["date"] > instances[start]) & (s["date"] <= instances[end])
    return instances.join(s, cond).drop("_exchange", "_symbol")


def volume_plus_interest(daily: DataFrame, interest: DataFrame) -> DataFrame:
    gi = interest.withColumnRenamed("date", "period_date")
    return daily.join(gi, [*TICKER, "period_date"]).select(*TICKER, "period_date", (F.col("volume") + F.col("relative_interest")).alias("weight"))


def _filed_within(instances: DataFrame, reports: DataFrame, preceding: int) -> DataFrame:
    """preceding_reports() by a range join: for few instances, as it makes a row for each report in range first."""
    r = reports.withColumnsRenamed({c: f"_{c}" for c in TICKER})
    cond = (instances["exchange"] == r["_exchange"]) & (instances["symbol"] == r["_symbol"]) & r["filed"].between(F.date_sub(instances["period_date"], preceding + 1), instances["period_date"])
    found = instances.join(r, cond).drop("_exchange", "_symbol")
    nth = F.row_number().over(Window.partitionBy(*TICKER, "period_date").orderBy(F.desc("period"), F.desc("filed")))
    return found.withColumn("_n", nth).where(F.col("_n") <= math.ceil(preceding / 90) + 1).drop("_n")


def report_changes(reports: DataFrame, preceding: int) -> DataFrame:
    """Ticker and period_date of the days on which the reports of the last preceding + 1 days change: two for each report.

    What a day has is what the last such day up to it has, so that reports are chosen once for each of these days and not
    for each bar.
    """
    day = F.explode(F.array("filed", F.date_add("filed", preceding + 2))).alias("period_date")
    return reports.where("exchange is not null and symbol is not null and filed is not null").select(*TICKER, day).distinct()


def beside(days: DataFrame, last: dict[str, DataFrame], on_day: dict[str, DataFrame]) -> DataFrame:
    """days (ticker, period_date, any others) with a column for each table (ticker, period_date, others) by its name.

    last: a struct of the others in the ticker's last row up to the day (one a day; rows without a date hold for all days),
    null before the first. on_day: an array of such structs, those of the day itself. One series of all a ticker and one
    sort, without a join.
    """
    series = days.withColumn("_asked", F.lit(True))
    for name, t in (last | on_day).items():
        said = F.struct(*[c for c in t.columns if c not in (*TICKER, "period_date")]).alias(name)
        keyed = t if name in last else t.where("exchange is not null and symbol is not null and period_date is not null")
        series = series.unionByName(keyed.select(*TICKER, "period_date", said), allowMissingColumns=True)
    by_day = Window.partitionBy(*TICKER).orderBy("period_date")
    so_far, today = (by_day.rangeBetween(x, Window.currentRow) for x in (Window.unboundedPreceding, Window.currentRow))
    found = {name: F.last(name, True).over(so_far) for name in last} | {name: F.collect_list(name).over(today) for name in on_day}
    return series.repartition(*TICKER).withColumns(found).where("_asked").select(*days.columns, *found)


def as_of(days: DataFrame, states: DataFrame) -> DataFrame:
    """days (ticker, period_date, any others) with the other columns of the ticker's last state (ticker, period_date,
    others; one a day) up to the day, null before the first."""
    said = [c for c in states.columns if c not in (*TICKER, "period_date")]
    return beside(days, {"_state": states}, {}).select(*days.columns, *[F.col("_state")[c].alias(c) for c in said])


def preceding_reports(instances: DataFrame, reports: DataFrame, preceding: int) -> DataFrame:
    """instances with the reports filed in [anchor - preceding - 1, anchor], the last ceil(preceding / 90) + 1 by period."""
    rest = [c for c in reports.columns if c not in TICKER]
    had = _filed_within(report_changes(reports, preceding), reports, preceding)
    lists = had.groupBy(*TICKER, "period_date").agg(F.collect_list(F.struct(*rest)).alias("_reports"))
    states = report_changes(reports, preceding).join(lists, [*TICKER, "period_date"], "left")
    return as_of(instances, states).select(*instances.columns, F.inline("_reports"))


def next_earnings(days: DataFrame, earnings: DataFrame) -> DataFrame:
    """days (ticker, period_date, any others) with next_date, the next earnings date as known on the day.

    Of a ticker's rows in order of (input_date, earnings_date), the last but one and earlier are scanned backwards,
    those not yet known on the day left out (on a day before all of them, those not known by the last input date); the
    first with an earnings date before the day gives the date of the row after it; if there is none, the first row's.

    Days and earnings go into one series a ticker: a row can answer from the later of its input date and the day after
    its earnings date on, and before the first input date from the day after its earnings date on. Rows without either
    date never answer. A ticker without earnings has no next date.
    """
    w = Window.partitionBy(*TICKER).orderBy("input_date", "earnings_date")
    rows = earnings.select(*TICKER, "input_date", "earnings_date", F.row_number().over(w).alias("_i"), F.lead("earnings_date").over(w).alias("_next"))
    whole = F.struct(*days.columns)
    none = F.lit(None)
    row = F.when(F.col("input_date").isNotNull() & F.col("earnings_date").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("_next").alias("next")))
    past = F.date_add("earnings_date", 1)
    kinds = F.array(
        F.struct(F.greatest("input_date", past).alias("at"), row.alias("known"), none.cast("struct<i:int,next:date>").alias("early")),
        F.struct(past.alias("at"), none.cast("struct<i:int,next:date>").alias("known"), row.alias("early")),
    )
    first = F.when(F.col("_i") == 1, F.struct(F.col("input_date").alias("from"), F.col("earnings_date").alias("date"))).alias("_first")
    events = rows.select(*TICKER, F.inline(kinds), first, "_next").select(*TICKER, F.col("at"), *[F.when(F.col("_next").isNotNull() & F.col("at").isNotNull(), F.col(c)).alias(c) for c in ("known", "early")], "_first")
    asked = days.select(*TICKER, F.col("period_date").alias("at"), whole.alias("_day"))
    series = asked.unionByName(events, allowMissingColumns=True)
    so_far = Window.partitionBy(*TICKER).orderBy("at", F.col("_day").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ticker = Window.partitionBy(*TICKER)
    seen = series.select("_day", "at", F.max("known").over(so_far).alias("_known"), F.max("early").over(so_far).alias("_early"), F.max("_first").over(ticker).alias("_f")).where("_day is not null")
    best = F.when(F.col("at") < F.col("_f.from"), F.col("_early.next")).otherwise(F.col("_known.next"))
    return seen.select("_day.*", F.coalesce(best, F.col("_f.date")).alias("next_date")).select(*TICKER, "period_date", *[c for c in days.columns if c not in (*TICKER, "period_date")], "next_date")
