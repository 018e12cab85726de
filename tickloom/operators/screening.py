"""Screens of tickers, tiers and weights of predictions, and accuracies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TICKER
from ..sources.bars import ordered
from .labels import change


def _anchored(bars: DataFrame, as_of, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return bars.withColumn("_v", value).where((F.col("period_date") == day) & ~F.col("artificial") & keep(F.col("_v"))).select(*TICKER, F.col("_v").alias("value"))


def price_moving(bars: DataFrame, as_of, change: float = 1.0) -> DataFrame:
    """Tickers whose close over the day before's is strictly beyond `change` (above it from 1 on, else below it)."""
    return _anchored(bars, as_of, F.col("close") / F.lag("close").over(ordered()), lambda v: v > change if change >= 1 else v < change)


def volume_sma_moving(bars: DataFrame, as_of, days: int, change: float = 1.0, variant: str = "reference") -> DataFrame:
    """Tickers whose volume is above `change` times a mean. `reference` sums days + 1 volumes before and divides by days."""
    n = days + 1 if variant == "reference" else days
    before = ordered().rowsBetween(-n, -1)
    mean = F.when(F.count("volume").over(before) == n, F.sum("volume").over(before) / days)
    return _anchored(bars.withColumn("_m", mean), as_of, F.col("volume") / F.col("_m"), lambda v: F.col("volume") > F.col("_m") * change)


def chain(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.join(o.select(*TICKER), TICKER, "left_semi")
    return first


def tier(preds: DataFrame) -> DataFrame:
    p = F.col("prediction")
    return preds.withColumn("tier", F.when(p > 0.5, 1).when(p > 0.45, 2).otherwise(3)).withColumn("rounded", (p >= 0.5).cast("int"))


def weight(preds: DataFrame, accuracy: DataFrame) -> DataFrame:
    """The best tier that has any prediction, with weight = prediction * accuracy * factor, ascending."""
    tiered = tier(preds)
    best = tiered.agg(F.min("tier").alias("_best"))
    rows = tiered.crossJoin(F.broadcast(best)).where("tier = _best").join(accuracy, TICKER, "left")
    w = F.col("prediction") * F.coalesce("accuracy", F.lit(1.0)) * F.coalesce("factor", F.lit(1.0))
    return rows.withColumn("weight", w).select(*TICKER, "prediction", "tier", "weight").orderBy("weight", *TICKER)


def accuracy_by(preds: DataFrame, keys: list[str], stored: DataFrame | None = None) -> DataFrame:
    """Sum and count of right predictions (columns prediction, truth) by key, added to what is stored."""
    right = ((F.col("prediction") >= 0.5) == (F.col("truth") == 1)).cast("double")
    new = preds.groupBy(*keys).agg(F.sum(right).alias("sum"), F.count("*").alias("count"))
    if stored is not None:
        new = new.unionByName(stored.select(*keys, "sum", "count")).groupBy(*keys).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    return new


def combine_metrics(m: DataFrame) -> DataFrame:
    """Metrics over slices: counts summed, all else averaged."""
    counted = F.col("name").rlike("^(true|false)_")
    return m.groupBy("name").agg(F.sum("value").alias("_s"), F.avg("value").alias("_a")).select("name", F.when(counted, F.col("_s")).otherwise(F.col("_a")).alias("value"))


def label_grid(bars: DataFrame, grid: list[tuple[int, float]]) -> DataFrame:
    """Class counts at each (following, value) of a grid, in one pass over bars."""
    rows = bars
    for f in sorted({f for f, _ in grid}):
        rows = change(rows, f).withColumnRenamed("change", f"_c{f}")
    sums = [F.count_if(F.col(f"_c{f}") >= v if v >= 0 else F.col(f"_c{f}") <= v).alias(f"p{i}") for i, (f, v) in enumerate(grid)]
    totals = [F.count(f"_c{f}").alias(f"n{i}") for i, (f, _) in enumerate(grid)]
    one = rows.agg(*sums, *totals)
    each = F.stack(F.lit(len(grid)), *[x for i, (f, v) in enumerate(grid) for x in (F.lit(f), F.lit(float(v)), F.col(f"p{i}"), F.col(f"n{i}"))]).alias("following", "value", "positive", "total")
    return one.select(each)


def score(features: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn over Arrow batches of feature rows (pandas in, pandas out)."""

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return features.mapInPandas(run, schema)


def weight_sections(weights: DataFrame, layout: DataFrame) -> DataFrame:
    """Mean absolute weight of each input section, whole and by thirds. layout: section, first, last (some dozen rows)."""
    placed = weights.join(F.broadcast(layout), F.col("index").between(F.col("first"), F.col("last")))
    third = F.least(F.floor(3 * (F.col("index") - F.col("first")) / (F.col("last") - F.col("first") + 1)), F.lit(2))
    rows = placed.withColumn("third", third.cast("int")).withColumn("_w", F.abs("weight"))
    return rows.groupBy("section").agg(F.avg("_w").alias("mean"), *[F.avg(F.when(F.col("third") == k, F.col("_w"))).alias(f"third{k + 1}") for k in range(3)])
