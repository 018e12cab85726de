"""Company filings: quarters, numbers, reports, balance checks.

Filings grow with the companies, but lie so tightly in files that Spark takes a table of millions of them for a few MB and
would send it whole through the driver; joins of filings ask for a merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TICKER


def edgar_quarters(sub: DataFrame, num: DataFrame) -> DataFrame:
    """Filings that have numbers: ticker, period, quarter 1..4 (a year's report is 4) and filing date, once each."""
    fp = F.col("fp")
    quarter = F.when(fp == "FY", 4).otherwise(F.substring(fp, 2, 1).cast("int"))
    own = num.where("version like 'us-gaap%'").select("adsh").distinct()
    return sub.join(own.hint("merge"), "adsh", "left_semi").select(*TICKER, "adsh", "period", quarter.alias("quarter"), "filed").where("quarter between 1 and 4").dropDuplicates([*TICKER, "period", "quarter"])


def edgar_nums(num: DataFrame, sub: DataFrame, tag: DataFrame) -> DataFrame:
    """Numbers of the company as a whole under standard tags, with their ticker. Standard tags are a vocabulary of bounded size."""
    clean = num.where("coalesce(coreg, '') = '' and version like 'us-gaap%'")
    kept = tag.where("custom = 0 and abstract = 0").select("tag", "version")
    return clean.join(F.broadcast(kept), ["tag", "version"]).join(sub.select("adsh", *TICKER).hint("merge"), "adsh").select(*TICKER, "adsh", "tag", "ddate", "value").distinct()


def financial_reports(nums: DataFrame, quarters: DataFrame) -> DataFrame:
    """One row per ticker and period, with a map of its tags' values (the greatest, where a tag repeats)."""
    one = nums.groupBy(*TICKER, "ddate", "tag").agg(F.max("value").alias("value"))
    joined = quarters.join(one.withColumnRenamed("ddate", "period").hint("merge"), [*TICKER, "period"])
    entries = F.sort_array(F.collect_list(F.struct("tag", "value")))
    return joined.groupBy(*TICKER, "period", "quarter", "filed").agg(F.map_from_entries(entries).alias("nums"))


def balance_check(num: DataFrame, parts: DataFrame) -> DataFrame:
    """Per filing, date and total: the reported total, the signed sum of its parts, and whether they agree.

    parts (total, tag, sign) lists what adds up to what; some hundred rows, so it is broadcast.
    """
    sums = num.join(F.broadcast(parts), "tag").groupBy("adsh", "ddate", "total").agg(F.sum(F.col("sign") * F.col("value")).alias("summed"))
    told = num.select("adsh", "ddate", F.col("tag").alias("total"), F.col("value").alias("reported"))
    return told.join(sums, ["adsh", "ddate", "total"]).withColumn("balanced", F.abs(F.col("reported") - F.col("summed")) < 0.005)


def balance_status(checks: DataFrame, leftovers: DataFrame) -> DataFrame:
    """Per filing: 1 balanced without leftovers, 3 with leftovers that are all zero, 2 with others, -1 unbalanced without
    leftovers, else 0. leftovers: adsh, value."""
    c = checks.groupBy("adsh").agg(F.bool_and("balanced").alias("_ok"))
    rest = leftovers.groupBy("adsh").agg(F.bool_and(F.col("value") == 0).alias("_zero"))
    ok, some = F.col("_ok"), F.col("_zero").isNotNull()
    status = F.when(ok & ~some, 1).when(ok & F.col("_zero"), 3).when(ok, 2).when(~some, -1).otherwise(0)
    return c.join(rest, "adsh", "left").select("adsh", status.alias("status"))


def missing_tags(tags: DataFrame, tree: DataFrame) -> DataFrame:
    return tags.select("tag").distinct().join(tree.select("tag"), "tag", "left_anti")


def unstaged(symbols: DataFrame, staging: DataFrame, source: str) -> DataFrame:
    """Tickers of which a source's statements were never staged."""
    return symbols.join(staging.where(F.col("source") == source).select(*TICKER), TICKER, "left_anti")


def stage_financials(old: DataFrame, df: DataFrame, source: str) -> DataFrame:
    """Staged statements with a source's values under its prefix; new values replace old ones, others stay."""
    keys = [*TICKER, "period", "date"]
    named = df.select(*keys, *[F.col(c).alias(f"{source}_{c}") for c in df.columns if c not in keys])
    fresh = [c for c in named.columns if c not in keys]
    joined = old.join(named.withColumnsRenamed({c: f"_new_{c}" for c in fresh}), keys, "full")
    return joined.select(*keys, *[c for c in old.columns if c not in keys and c not in fresh], *[F.coalesce(f"_new_{c}", c).alias(c) if c in old.columns else F.col(f"_new_{c}").alias(c) for c in fresh])


def latest_filing(reports: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*TICKER).orderBy(F.desc("period"), F.desc("filed")))
    return reports.withColumn("_n", nth).where("_n = 1").drop("_n")
