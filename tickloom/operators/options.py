"""Option contracts: tickers, searches, strike bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERN = r"^(?:O:)?(\D+)(\d+)(\D)(\d+)$"


def parse_contract(df: DataFrame, col: str, as_of_year: int) -> DataFrame:
    """df with underlying, expiration_date, contract_type and strike; a year beyond as_of_year's two digits is 19xx."""
    part = lambda k: F.regexp_extract(col, PATTERN, k)
    digits = F.when(F.length(part(2)) == 7, F.substring(part(2), 2, 6)).otherwise(part(2))
    yy = F.substring(digits, 1, 2).cast("int")
    year = F.when(yy > as_of_year % 100, 1900 + yy).otherwise(2000 + yy)
    date = F.make_date(year, F.substring(digits, 3, 2).cast("int"), F.substring(digits, 5, 2).cast("int"))
    kind = F.when(part(3) == "C", "CALL").otherwise("PUT")
    return df.withColumn("underlying", part(1)).withColumn("expiration_date", date).withColumn("contract_type", kind).withColumn("strike", part(4).cast("double") / 1000)


def format_contract(underlying: Column, expiration: Column, kind: Column, strike: Column) -> Column:
    return F.concat(F.lit("O:"), underlying, F.date_format(expiration, "yyMMdd"), F.substring(kind, 1, 1), F.lpad(F.round(strike * 1000).cast("long").cast("string"), 8, "0"))


def find_contracts(df: DataFrame, underlying: str, week_of: str, kind: str | None = None, strike: float | None = None, above: float | None = None, below: float | None = None) -> DataFrame:
    """Contracts that expire in the week (Monday to Saturday) of a date, by strike and type, in order of strike."""
    diff = F.datediff("expiration_date", F.trunc(F.lit(week_of).cast("date"), "week"))
    out = df.where((F.col("underlying") == underlying) & (diff >= 0) & (diff < 6))
    for cond in (kind and F.col("contract_type") == kind, strike is not None and F.col("strike") == strike, above is not None and F.col("strike") > above, below is not None and F.col("strike") < below):
        if cond is not None and cond is not False:
            out = out.where(cond)
    return out.orderBy("strike")


def candidate_contracts(contracts: DataFrame, as_of: str, first: str, last: str, kind: str, empty: DataFrame, collected: DataFrame) -> DataFrame:
    """Expired contracts of a type in an expiry window that are neither known to be empty nor collected."""
    day = F.lit(as_of).cast("date")
    rows = contracts.where((F.col("expiration_date") < day) & (F.col("contract_type") == kind) & F.col("expiration_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows.join(empty.select("ticker"), "ticker", "left_anti").join(collected.select("ticker").distinct(), "ticker", "left_anti")


def pair_contracts(pairs: DataFrame, contracts: DataFrame) -> DataFrame:
    """pairs (underlying, target) with contracts that expire on the target week's Friday, up to five weeks later.

    All pairs of an underlying use the least extension at which any of its contracts matches.
    """
    friday = F.date_add(F.trunc("target", "week"), 4)
    each = pairs.withColumn("extension", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("expiration_date", F.date_add(friday, 7 * F.col("extension")))
    found = each.join(contracts, ["underlying", "expiration_date"])
    least = found.groupBy("underlying").agg(F.min("extension").alias("extension"))
    return found.join(least, ["underlying", "extension"])


def strike_band(contracts: DataFrame, bars: DataFrame, pad: float = 10.0) -> DataFrame:
    """Per underlying: the least low less pad and the greatest high plus pad, widened to the next listed strikes."""
    edge = bars.groupBy(F.col("symbol").alias("underlying")).agg((F.min("low") - pad).alias("lo"), (F.max("high") + pad).alias("hi"))
    beyond = contracts.select("underlying", "strike").join(edge, "underlying").groupBy("underlying", "lo", "hi").agg(F.max(F.when(F.col("strike") < F.col("lo"), F.col("strike"))).alias("_l"), F.min(F.when(F.col("strike") > F.col("hi"), F.col("strike"))).alias("_h"))
    return beyond.select("underlying", F.coalesce("_l", "lo").alias("low_strike"), F.coalesce("_h", "hi").alias("high_strike"))


def new_contracts(landed: DataFrame, stored: DataFrame) -> DataFrame:
    """Landed contracts that expire after all that is stored of their underlying."""
    top = stored.groupBy("underlying").agg(F.max("expiration_date").alias("_t"))
    return landed.join(top, "underlying", "left").where("_t is null or expiration_date > _t").drop("_t")


def duplicate_contracts(contracts: DataFrame) -> DataFrame:
    return contracts.groupBy("underlying", "expiration_date", "contract_type", "strike").agg(F.count("*").alias("n")).where("n > 1")


def consolidate_options(dump: DataFrame, computed: DataFrame, exchanges: DataFrame, as_of_year: int) -> DataFrame:
    """Dump bars of contracts not yet computed, with the contract's facts and its underlying's exchange."""
    fresh = dump.join(computed.select("ticker").distinct(), "ticker", "left_anti")
    return parse_contract(fresh, "ticker", as_of_year).join(exchanges.select(F.col("symbol").alias("underlying"), "exchange"), "underlying")


def strike_band_weekly(contracts: DataFrame, bars: DataFrame, cal: DataFrame, following: int, pad: float = 15.0) -> DataFrame:
    """Each contract whose strike lies in the band of its underlying's lows and highs in the week that holds the market
    day following - 1 market days before it expires."""
    from .calendar import advance

    week = F.trunc("advanced", "week")
    placed = advance(contracts, "expiration_date", -(following - 1), cal).withColumn("_w", week)
    lows = bars.groupBy(F.col("symbol").alias("underlying"), F.trunc("period_date", "week").alias("_w")).agg((F.min("low") - pad).alias("lo"), (F.max("high") + pad).alias("hi"))
    return placed.join(lows, ["underlying", "_w"]).where(F.col("strike").between(F.col("lo"), F.col("hi"))).drop("_w", "advanced")
