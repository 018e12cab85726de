"""Tables that stand for market data, derived from the given tables by plain arithmetic, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.bars import BARS_SQL, bars, numbered, table

__all__ = ["BARS_SQL", "bars", "table", "written_bars"]


def r4(c: Column | str) -> Column:
    """Four decimals, half up in floating point, so that both engines agree on ties (registry turns SQL's round alike)."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 10000 + 0.5) / 10000


def _bars(spark: SparkSession, d: str, rows: DataFrame | None) -> DataFrame:
    return bars(spark, d) if rows is None else rows


def _numbered(spark: SparkSession, d: str, rows: DataFrame | None) -> DataFrame:
    """The bars' places in their series: rows may have them already."""
    rows = _bars(spark, d, rows)
    return rows if "idx" in rows.columns else numbered(rows)


def sid() -> Column:
    return F.col("symbol").cast("int")


def written_bars(spark: SparkSession, d: str) -> DataFrame:
    """The numbered bars as a table of their own, for plans that start from them in several places: deriving them shuffles the
    trade lines, numbering them shuffles and sorts them once more."""
    return written(numbered(bars(spark, d)), "bars")


def written_days(spark: SparkSession, d: str) -> DataFrame:
    """Ticker and period_date of the bars as a table of their own, for plans that ask for no prices."""
    return written(bars(spark, d).select("exchange", "symbol", "period_date"), "days")


def vix(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return _bars(spark, d, rows).groupBy("period_date").agg(*[(F.avg(c) / 50).alias(c) for c in ("open", "high", "low", "close")])


VIX_SQL = "vix as (select period_date, avg(open) / 50 as open, avg(high) / 50 as high, avg(low) / 50 as low, avg(close) / 50 as close from bars group by 1)"


def interest(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    rows = _numbered(spark, d, rows).where("idx % 3 <> 0")
    return rows.select("exchange", "symbol", F.col("period_date").alias("date"), ((sid() * 7 + F.col("idx") * 13) % 101).cast("double").alias("relative_interest"))


INTEREST_SQL = "interest as (select exchange, symbol, period_date as date, cast((symbol::int * 7 + rn * 13) % 101 as double) as relative_interest from b where rn % 3 <> 0)"


def splits(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    rows = _numbered(spark, d, rows).where(F.col("idx") % 97 == sid() % 97)
    return rows.select("exchange", "symbol", F.col("period_date").alias("date"), F.lit(1.0).alias("split_from"), (2 + F.col("idx") % 3).cast("double").alias("split_to"))


SPLITS_SQL = "splits as (select exchange, symbol, period_date as date, 1.0::double as split_from, (2 + rn % 3)::double as split_to from b where rn % 97 = symbol::int % 97)"


def earnings(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    rows = _numbered(spark, d, rows).where("idx % 60 = 10")
    return rows.select("exchange", "symbol", F.date_sub("period_date", 20).alias("input_date"), F.expr("date_add(period_date, cast(idx % 7 as int))").alias("earnings_date"))


EARNINGS_SQL = "earnings as (select exchange, symbol, period_date - 20 as input_date, period_date + (rn % 7)::int as earnings_date from b where rn % 60 = 10)"


def minute_bars(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.lit("EV").alias("exchange"), F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("timestamp"), F.col("value").alias("close"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    return lab.select(F.concat(F.lit("EX"), (F.col("doc_id") % 5).cast("string")).alias("exchange"), (F.col("doc_id") % 50).cast("string").alias("symbol"), "doc_id", F.col("toxic").alias("truth"), ((F.col("quality") * 40 + F.col("doc_id") % 30) / 100.0).cast("double").alias("prediction"))


PREDICTIONS_SQL = "predictions as (select 'EX' || (doc_id % 5) as exchange, (doc_id % 50)::varchar as symbol, doc_id, toxic as truth, ((quality * 40 + doc_id % 30) / 100.0)::double as prediction from labels)"


def contracts(spark: SparkSession, d: str) -> DataFrame:
    """Contract tickers of parts: letters from the part, a date, a strike."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"))
    day = F.expr("date_add(date'2020-01-01', cast((k * 37) % 2000 as int))")
    letters = F.concat(F.expr("chr(cast(65 + k % 26 as int))"), F.expr("chr(cast(65 + k % 7 as int))"))
    t = F.concat(F.when(F.col("k") % 2 == 0, "O:").otherwise(""), letters, F.date_format(day, "yyMMdd"), F.when(F.col("k") % 3 == 0, "P").otherwise("C"), F.lpad(((F.col("k") % 400) * 500).cast("string"), 8, "0"))
    return p.select("k", t.alias("ticker"))


CONTRACTS_SQL = """contracts as (select k, ticker, regexp_replace(ticker, '^O:', '') as t from (
  select p_partkey as k, case when p_partkey % 2 = 0 then 'O:' else '' end || chr((65 + p_partkey % 26)::int) || chr((65 + p_partkey % 7)::int)
    || strftime(date '2020-01-01' + ((p_partkey * 37) % 2000)::int, '%y%m%d') || case when p_partkey % 3 = 0 then 'P' else 'C' end
    || lpad(((p_partkey % 400) * 500)::varchar, 8, '0') as ticker from part)),
parsed as (select k, ticker, substr(t, 1, 2) as underlying, strptime('20' || substr(t, 3, 6), '%Y%m%d')::date as expiration_date,
    case when substr(t, 9, 1) = 'C' then 'CALL' else 'PUT' end as contract_type, substr(t, 10)::double / 1000 as strike from contracts)"""
