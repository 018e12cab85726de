"""Search interest: weeks, streams, months, scaling and coverage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runs import each_run
from ..functions.scalars import TICKER


def week_blocks(daily: DataFrame) -> DataFrame:
    """daily (ticker, date, stream, value) with week_end (Saturday), without a stream's partial first week if it is not
    stream 0, and without its partial last week if it is not the ticker's last stream."""
    end = F.when(F.dayofweek("date") == 7, F.col("date")).otherwise(F.next_day("date", "Sat"))
    # Three windows over one order of the rows, made before them as Spark would sort for each: no join of rows with their
    # weeks. The exchange (the keys turned round, as
    # Spark would leave out one by a partitioning that is there) keeps what sorted the rows before out of this sort's tasks.
    week, stream, ticker = (Window.partitionBy(*TICKER, *more) for more in (["stream", "week_end"], ["stream"], []))
    rows = daily.withColumn("week_end", end).repartition(*reversed(TICKER)).sortWithinPartitions(*TICKER, "stream", "week_end").withColumn("_n", F.count("*").over(week))
    marked = rows.withColumn("_first", F.min("week_end").over(stream)).withColumn("_last", F.max("week_end").over(stream)).withColumn("_top", F.max("stream").over(ticker))
    bad = (F.col("_n") < 7) & (((F.col("stream") > 0) & (F.col("week_end") == F.col("_first"))) | ((F.col("stream") < F.col("_top")) & (F.col("week_end") == F.col("_last"))))
    return marked.where(~bad).drop("_n", "_first", "_last", "_top")


def merge_streams(blocks: DataFrame) -> DataFrame:
    """One value per ticker and date: that of the lowest stream. The exchange keeps the groups out of the tasks that sort blocks."""
    return blocks.repartition(*TICKER, "date").groupBy(*TICKER, "date").agg(F.min_by("relative_interest", "stream").alias("relative_interest"))


def monthly(gi: DataFrame) -> DataFrame:
    """The last value of each month."""
    return gi.groupBy(*TICKER, F.trunc("date", "month").alias("month")).agg(F.max_by("relative_interest", "date").alias("value"))


def relative_interest(daily: DataFrame, months: DataFrame) -> DataFrame:
    """Daily interest times its month's, over 100."""
    rows = daily.withColumn("month", F.trunc("date", "month")).join(months, [*TICKER, "month"])
    return rows.select(*TICKER, "date", (F.col("relative_interest") * F.col("value") / 100).alias("relative_interest"))


def scale_daily(daily: DataFrame, months: DataFrame) -> DataFrame:
    """Daily interest scaled by the month's value over 100, carried forward where a month has none."""
    m = months.select(*TICKER, F.col("month").alias("date"), "value")
    rows = daily.withColumn("_real", F.lit(True)).join(m, [*TICKER, "date"], "full")
    carried = F.last("value", True).over(Window.partitionBy(*TICKER).orderBy("date"))
    return rows.withColumn("_v", carried).where("_real").select(*TICKER, "date", (F.col("relative_interest") * F.col("_v") / 100).alias("relative_interest"))


def project_months(daily: DataFrame, months: DataFrame, max_gap: int = 190) -> DataFrame:
    """Months with daily data but no monthly value get sum * factor, factor the mean of value / sum over known months
    within max_gap days; projected months join the pool, in order; all are scaled down if any exceeds 100.

    A ticker's months (some hundred at most) go through one grouped function, as each step needs the one before.
    """
    sums = daily.groupBy(*TICKER, F.trunc("date", "month").alias("month")).agg(F.sum("relative_interest").alias("total"))
    rows = sums.join(months, [*TICKER, "month"], "left")

    def run(t: pa.RecordBatch) -> pa.RecordBatch:
        days = t.column("month").cast(pa.int32()).to_numpy()
        total, values = (t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("total", "value"))
        known = ~np.isnan(values)
        for i in np.flatnonzero(~known):
            near = known & (total > 0) & (np.abs(days - days[i]) < max_gap)
            if near.any():
                share = values[near] / total[near]
                values[i], known[i] = total[i] * np.add.accumulate(share)[-1] / len(share), True
        top = max(values[known], default=0)
        if top > 100:
            values = values * (100 / top)
        value = pa.array(values, mask=~known | np.isnan(values))
        return pa.RecordBatch.from_arrays([*(t.column(c) for c in (*TICKER, "month")), value], names=[*TICKER, "month", "value"])

    return each_run(rows, TICKER, ["month"], run, "exchange string, symbol string, month date, value double")


def preceding_interest(inst: DataFrame, gi: DataFrame, preceding: int, offset: int = 2) -> DataFrame:
    """inst (ticker, date) with the `preceding` values that end offset + 1 rows before the date's own row, scaled so that
    the greatest is 100; rows whose date has no interest are left out."""
    w = Window.partitionBy(*TICKER).orderBy("date").rowsBetween(-(preceding + offset), -(offset + 1))
    lists = gi.withColumn("values", F.collect_list("relative_interest").over(w)).select(*TICKER, "date", "values")
    found = inst.join(lists, [*TICKER, "date"])
    top = F.array_max("values")
    return found.withColumn("values", F.when(top > 0, F.transform("values", lambda v: v * 100 / top)).otherwise(F.col("values")))


def expand_periods(gi: DataFrame, kind: str) -> DataFrame:
    """Weekly or monthly points as a row for each day of the period from date on."""
    end = F.date_add("date", 6) if kind == "weekly" else F.last_day("date")
    return gi.withColumn("date", F.explode(F.sequence("date", end)))


def interest_periods(gi: DataFrame, weeks: int = 34) -> DataFrame:
    """Sum, zeros and mean of each span of weeks, counted back from the ticker's last date (period 0)."""
    last = F.max("date").over(Window.partitionBy(*TICKER))
    rows = gi.withColumn("period", F.floor(F.datediff(last, "date") / (7 * weeks)).cast("int"))
    v = F.col("relative_interest")
    return rows.groupBy(*TICKER, "period").agg(F.sum(v).alias("total"), F.count_if(v == 0).alias("zeros"), F.avg(v).alias("mean"))


def zero_pct(gi: DataFrame, k: int = 183) -> DataFrame:
    """Share of zeros among the last k points of each ticker."""
    back = F.row_number().over(Window.partitionBy(*TICKER).orderBy(F.desc("date")))
    rows = gi.withColumn("_b", back).where(F.col("_b") <= k)
    return rows.groupBy(*TICKER).agg((F.count_if(F.col("relative_interest") == 0) / k).alias("zero_pct"))


def interest_coverage(symbols: DataFrame, bars: DataFrame, gi: DataFrame) -> DataFrame:
    """symbols with status: no bars, not started, partial (interest ends before the bars), or up to date."""
    b = bars.groupBy(*TICKER).agg(F.max("period_date").alias("_b"))
    g = gi.groupBy(*TICKER).agg(F.max("date").alias("_g"))
    status = F.when(F.col("_b").isNull(), "NO_DATA").when(F.col("_g").isNull(), "NOT_STARTED").when(F.col("_g") < F.col("_b"), "PARTIAL").otherwise("UP_TO_DATE")
    return symbols.join(b, TICKER, "left").join(g, TICKER, "left").select(*symbols.columns, status.alias("status"))


def max_stream(gi: DataFrame) -> DataFrame:
    return gi.groupBy(*TICKER, "type").agg(F.max("stream").alias("stream"))


def match_topics(tickers: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Tickers with the topics whose title is their name, white space and case apart."""
    key = lambda c: F.lower(F.regexp_replace(c, r"[\s.,]+", ""))
    s = suggestions.select(key("title").alias("_t"), "topic_id")
    return tickers.withColumn("_t", key("name")).join(s, "_t").drop("_t")


def split_interest(df: DataFrame, keywords: list[str]) -> DataFrame:
    """The list column `value` as one int column per keyword, with is_partial false where unset."""
    return df.select("date", *[F.get("value", F.lit(i)).cast("int").alias(k) for i, k in enumerate(keywords)], F.coalesce("is_partial", F.lit(False)).alias("is_partial"))


