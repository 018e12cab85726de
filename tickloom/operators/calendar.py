"""Market calendar: holidays by region from date rules, and market days with ordinals.

The calendar is a small dimension (366 rows a year and region), so it is broadcast wherever it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARED, US, CANADA = "CANADA_US_SHARED", "US", "CANADA"


def _nth(day: str, month: int, n: int) -> Column:
    """The nth such weekday of a month of the column y."""
    return F.date_add(F.next_day(F.date_sub(F.make_date("y", F.lit(month), F.lit(1)), 1), day), 7 * (n - 1))


def _fixed(month: int, day: int, saturday: int = 0, sunday: int = 0) -> Column:
    """A date of the year, moved by so many days when on a weekend."""
    d = F.make_date("y", F.lit(month), F.lit(day))
    return F.date_add(d, F.when(F.dayofweek(d) == 7, saturday).when(F.dayofweek(d) == 1, sunday).otherwise(0))


def _good_friday() -> Column:
    """Two days before Easter by the Gregorian computus."""
    y = F.col("y")
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = y % 19, div(y, 100), y % 100
    d = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * div(c, 4) - d - c % 4) % 7
    f = d + e - 7 * div(a + 11 * d + 22 * e, 451) + 114
    return F.date_sub(F.make_date(y, div(f, 31), f % 31 + 1), 2)


def _rules() -> list[tuple[str, str, Column, Column]]:
    """(region, name, date, whether it is kept that year)"""
    y, always = F.col("y"), F.lit(True)
    memorial = F.date_sub(F.next_day(F.date_sub(F.make_date("y", F.lit(6), F.lit(1)), 1), "Mon"), 7)
    boxing = F.make_date("y", F.lit(12), F.lit(26))
    boxed = F.date_add(boxing, F.when(F.dayofweek(boxing).isin(1, 7), 2).when(F.dayofweek(boxing) == 2, 1).otherwise(0))
    return [
        (US, "new_year", _fixed(1, 1, 0, 1), always),
        (CANADA, "new_year", _fixed(1, 1, 2, 1), always),
        (US, "martin_luther_king", _nth("Mon", 1, 3), y > 1997),
        (SHARED, "presidents_family", _nth("Mon", 2, 3), y >= 2008),
        (US, "presidents", _nth("Mon", 2, 3), y < 2008),
        (SHARED, "good_friday", _good_friday(), always),
        (US, "memorial", memorial, always),
        (CANADA, "victoria", F.date_sub(memorial, 7), always),
        (US, "juneteenth", _fixed(6, 19, -1, 1), y >= 2022),
        (CANADA, "canada", _fixed(7, 1, 2, 1), always),
        (US, "independence", _fixed(7, 4, -1, 1), always),
        (CANADA, "civic", _nth("Mon", 8, 1), always),
        (SHARED, "labour", _nth("Mon", 9, 1), always),
        (CANADA, "truth_reconciliation", _fixed(9, 30, 2, 1), y > 2022),
        (CANADA, "thanksgiving", _nth("Mon", 10, 2), always),
        (US, "thanksgiving", _nth("Thu", 11, 4), always),
        (US, "christmas", _fixed(12, 25, -1, 1), always),
        (CANADA, "christmas", _fixed(12, 25, 2, 1), always),
        (CANADA, "boxing", boxed, always),
    ]


def _years(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))


def holidays(spark: SparkSession, first: int, last: int, region: str | None = None) -> DataFrame:
    """region, name and date of the holidays of some years; a region includes the shared ones."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("region"), F.lit(n).alias("name"), d.alias("date"), k.alias("kept")) for r, n, d, k in _rules()])).alias("h")
    rows = _years(spark, first, last).select(each).where("h.kept").select("h.region", "h.name", "h.date")
    if region is None:
        return rows
    return rows.where(F.col("region").isin(region, SHARED)).withColumn("region", F.lit(region))


def half_days(spark: SparkSession, first: int, last: int) -> DataFrame:
    """The days after US Thanksgiving and before US Christmas."""
    both = holidays(spark, first, last).where((F.col("region") == US) & F.col("name").isin("thanksgiving", "christmas"))
    return both.select("name", F.when(F.col("name") == "thanksgiving", F.date_add("date", 1)).otherwise(F.date_sub("date", 1)).alias("date"))


def market_days(spark: SparkSession, first: int, last: int, region: str = US) -> DataFrame:
    """Market days with their ordinal, from 1, over whole years."""
    days = _years(spark, first, last).select(F.explode(F.sequence(F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31)))).alias("date"))
    open_ = days.where(~F.dayofweek("date").isin(1, 7)).join(F.broadcast(holidays(spark, first, last, region).select("date")), "date", "left_anti")
    return open_.select("date", F.row_number().over(Window.orderBy("date")).alias("ordinal"))


def calendar(spark: SparkSession, first: int, last: int, region: str = US) -> DataFrame:
    """Every day with last_md, the last market day up to it, and its ordinal (both null before the first)."""
    days = _years(spark, first, last).select(F.explode(F.sequence(F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31)))).alias("date"))
    marked = days.join(market_days(spark, first, last, region).withColumn("_md", F.col("date")), "date", "left")
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("date", F.last("_md", True).over(so_far).alias("last_md"), F.last("ordinal", True).over(so_far).alias("ordinal"))


def last_market_day(df: DataFrame, col: str, cal: DataFrame, strictly: bool = False) -> DataFrame:
    """df with last_md: the last market day on or before col, or strictly before it."""
    key = F.date_sub(F.col(col), 1) if strictly else F.col(col)
    side = F.broadcast(cal.select(F.col("date").alias("_d"), "last_md"))
    return df.withColumn("_k", key).join(side, F.col("_k") == F.col("_d"), "left").drop("_k", "_d")


def market_day_diff(df: DataFrame, a: str, b: str, cal: DataFrame) -> DataFrame:
    """df with md_diff: the market days from a to b."""
    x = F.broadcast(cal.select(F.col("date").alias(a), F.col("ordinal").alias("_a")))
    y = F.broadcast(cal.select(F.col("date").alias(b), F.col("ordinal").alias("_b")))
    return df.join(x, a, "left").join(y, b, "left").withColumn("md_diff", F.col("_b") - F.col("_a")).drop("_a", "_b")


def advance(df: DataFrame, col: str, k: int, cal: DataFrame) -> DataFrame:
    """df with advanced: the market day k market days after col's last market day."""
    place = F.broadcast(cal.select(F.col("date").alias(col), F.col("ordinal").alias("_o")))
    days = F.broadcast(cal.where("date = last_md").select(F.col("ordinal").alias("_t"), F.col("date").alias("advanced")))
    return df.join(place, col, "left").join(days, F.col("_o") + k == F.col("_t"), "left").drop("_o", "_t")
