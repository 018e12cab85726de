"""Caps of price and volume columns, and values scaled by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TICKER

PRICES = ("open", "high", "low", "close")


def caps(bars: DataFrame, methods: dict[str, str] | None = None, k: float = 2.5, exclude: DataFrame | None = None) -> DataFrame:
    """One row with a cap for each column: the mean of the tickers' means plus k deviations (`stddev`), or the `max`.

    Tickers of `exclude`, however many, don't count.
    """
    methods = methods or {"high": "stddev", "volume": "stddev"}
    if exclude is not None:
        bars = bars.join(exclude.select(*TICKER), TICKER, "left_anti")
    means = bars.groupBy(*TICKER).agg(*[F.avg(c).alias(f"avg_{c}") for c in methods], *[F.max(c).alias(f"max_{c}") for c in methods])
    how = {"stddev": lambda c: F.avg(f"avg_{c}") + k * F.stddev_pop(f"avg_{c}"), "max": lambda c: F.max(f"max_{c}")}
    return means.agg(*[how[m](c).alias(f"{c}_cap") for c, m in methods.items()])


def normalize(bars: DataFrame, caps: DataFrame, offset: float = 0.0) -> DataFrame:
    """Prices over the high cap and volume over its cap, less the offset. caps is one row."""
    one = bars.crossJoin(F.broadcast(caps))
    scaled = {c: F.col(c) / F.col("high_cap") - offset for c in PRICES} | {"volume": F.col("volume") / F.col("volume_cap") - offset}
    return one.withColumns(scaled).drop("high_cap", "volume_cap")


def denormalize(bars: DataFrame, caps: DataFrame, offset: float = 0.0) -> DataFrame:
    one = bars.crossJoin(F.broadcast(caps))
    scaled = {c: (F.col(c) + offset) * F.col("high_cap") for c in PRICES} | {"volume": (F.col("volume") + offset) * F.col("volume_cap")}
    return one.withColumns(scaled).drop("high_cap", "volume_cap")


def normalize_vix(vix: DataFrame, top: float = 100.0) -> DataFrame:
    """Index values over 100; a higher value is an error."""
    checked = vix.where(F.assert_true(F.greatest(*PRICES) <= top).isNull())
    return checked.withColumns({c: F.col(c) / top for c in PRICES})


def normalize_financials(reports: DataFrame, unit: float = 1e6) -> DataFrame:
    """Values of the map `nums` over a million; null is 0."""
    return reports.withColumn("nums", F.transform_values("nums", lambda k, v: F.coalesce(v, F.lit(0.0)) / unit))
