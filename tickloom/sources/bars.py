"""Daily bars: reading, deriving them from trade lines, and rolling up intraday prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import TICKER

def ordered() -> WindowSpec:
    """A ticker's rows by date."""
    return Window.partitionBy(*TICKER).orderBy("period_date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_bars(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Daily bars of each supplier: price is extended price over quantity, in order of (order, line, part) in a day."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    lines = lineitem.select("l_suppkey", F.to_date("l_shipdate").alias("period_date"), price.alias("p"), order.alias("o"), F.col("l_quantity").alias("v"))
    days = lines.groupBy("l_suppkey", "period_date").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").cast("double").alias("volume"), F.count("*").alias("transactions")
    )
    names = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("EX"), F.col("s_nationkey").cast("string")).alias("exchange"))
    return days.join(names, "l_suppkey").select("exchange", F.col("l_suppkey").cast("string").alias("symbol"), "period_date", "open", "high", "low", "close", "volume", "transactions", F.lit(False).alias("artificial"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_bars(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"))


#: The same bars for the SQL side; queries start with "with " + BARS_SQL.
BARS_SQL = """bars as (
  select 'EX' || s_nationkey as exchange, cast(l_suppkey as varchar) as symbol, cast(l_shipdate as date) as period_date,
    first(l_extendedprice / l_quantity order by l_orderkey, l_linenumber, l_partkey) as open,
    max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
    last(l_extendedprice / l_quantity order by l_orderkey, l_linenumber, l_partkey) as close,
    cast(sum(l_quantity) as double) as volume, count(*) as transactions, false as artificial
  from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2, 3),
b as (select *, row_number() over w - 1 as rn, count(*) over (partition by exchange, symbol) as n,
    lag(close) over w as pc, lag(high) over w as ph, lag(low) over w as pl, lag(open) over w as po
  from bars window w as (partition by exchange, symbol order by period_date))"""


def read_daily(spark: SparkSession, path: str, min_date: str | None = None, last_k: int | None = None) -> DataFrame:
    """Bars at a path, after min_date, the last k of each ticker. The date filter reaches the scan."""
    df = spark.read.parquet(path)
    return take_daily(df, min_date, last_k)


def take_daily(df: DataFrame, min_date: str | None = None, last_k: int | None = None) -> DataFrame:
    if min_date:
        df = df.where(F.col("period_date") > F.lit(min_date).cast("date"))
    if last_k:
        back = F.row_number().over(Window.partitionBy(*TICKER).orderBy(F.desc("period_date")))
        df = df.withColumn("_back", back).where(F.col("_back") <= last_k).drop("_back")
    return df


def rollup_intraday(df: DataFrame, keys: list[str], ts: str, price: Column) -> DataFrame:
    """One row per key: first open, highest, lowest and last price by time."""
    rows = df.select(*keys, F.col(ts).alias("_ts"), price.alias("_p"))
    by = F.struct("_ts", "_p")
    return rows.groupBy(*keys).agg(F.min_by("_p", by).alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", by).alias("close"))


def numbered(df: DataFrame) -> DataFrame:
    """df with idx, the 0-based place of a bar in its ticker's series, and n, the ticker's number of bars."""
    return df.withColumn("idx", F.row_number().over(ordered()) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*TICKER)))


def date_bounds(df: DataFrame) -> DataFrame:
    return df.groupBy(*TICKER).agg(F.min("period_date").alias("first_date"), F.max("period_date").alias("last_date"))
