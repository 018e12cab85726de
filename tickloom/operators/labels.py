"""Labels, usable anchors, range shapes, samples and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import TICKER, is_fibonacci
from ..sources.bars import numbered, ordered


def change(bars: DataFrame, following: int, percentage: bool = True, any_day: bool = False, rising: bool = True, norm_max: float | None = None, offset: float = 0.0) -> DataFrame:
    """bars with `change`: the low `following` rows on (or the best low before it) against the high of the row before.

    With norm_max the change is scaled back from normalised values, percentages too.
    """
    base = F.lag("high").over(ordered())
    if any_day:
        ahead = ordered().rowsBetween(1, following - 1)
        low = (F.max if rising else F.min)("low").over(ahead)
        low = F.when(F.lead("low", following).over(ordered()).isNotNull(), low)
    else:
        low = F.lead("low", following).over(ordered())
    moved = F.when(base == 0, 0.0).otherwise(low / base - 1) if percentage else low - base
    if norm_max is not None:
        moved = (moved + offset) * norm_max
    return bars.withColumn("change", moved)


def label(bars: DataFrame, following: int, value: float, percentage: bool = True, any_day: bool = False) -> DataFrame:
    """bars with change and cls: POSITIVE where the change reaches value (from above, or from below if value < 0)."""
    moved = change(bars, following, percentage, any_day, value >= 0)
    hit = F.col("change") >= value if value >= 0 else F.col("change") <= value
    return moved.withColumn("cls", F.when(F.col("change").isNull(), None).when(hit, "POSITIVE").otherwise("NEGATIVE"))


def selections(bars: DataFrame, preceding: int, following: int, max_period: int = 0) -> DataFrame:
    """Bars that can be anchors: enough rows before for the range and the indicators, and enough after."""
    return numbered(bars).where((F.col("idx") >= preceding + 1 + max_period) & (F.col("idx") < F.col("n") - following))


def enough_rows(bars: DataFrame, preceding: int, following: int) -> DataFrame:
    return bars.groupBy(*TICKER).agg(F.count("*").alias("n")).where(F.col("n") >= preceding + following + 1)


def class_counts(instances: DataFrame, drop_without_positive: bool = False) -> DataFrame:
    counts = instances.groupBy(*TICKER).agg(F.count_if(F.col("cls") == "POSITIVE").alias("positive"), F.count_if(F.col("cls") == "NEGATIVE").alias("negative"))
    return counts.where("positive > 0") if drop_without_positive else counts


def instance_ratio(instances: DataFrame) -> DataFrame:
    return instances.agg(F.avg((F.col("cls") == "POSITIVE").cast("double")).alias("ratio"))


def drop_histogram(bars: DataFrame, following: int) -> DataFrame:
    """For each whole percentage: how many anchors dropped by it, and how many by more."""
    base, low = F.lag("high").over(ordered()), F.lead("low", following).over(ordered())
    drop = F.floor(100 * F.when((1 - low / base) > 0, 1 - low / base).when(low.isNotNull() & base.isNotNull(), 0.0)).cast("int")
    counts = bars.select(drop.alias("pct")).where("pct is not null").groupBy("pct").agg(F.count("*").alias("n"))
    return counts.withColumn("exceeding", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("pct")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def mixed(*cols: Column, seed: int = 0) -> Column:
    """A number that orders rows as if at random, the same on every run."""
    return F.xxhash64(*cols, F.lit(seed))


def hash_range(c: Column) -> Column:
    """The one of 4,096 equal ranges that a 64-bit hash falls into; ranges are in the order of the hashes."""
    return F.shiftright(c, 52)


def key_ranges(df: DataFrame, order: list[str], ranges: int = 256) -> DataFrame:
    """df with `_range`: near-equal ranges of its rows in the order of the columns, cut at keys of a fixed sample."""
    keys = df.select(F.struct(*order).alias("_k"))
    few = keys.orderBy(F.xxhash64("_k"), "_k").limit(8 * ranges).agg(F.sort_array(F.collect_list("_k")).alias("_all"))
    cuts = few.select(F.expr("filter(_all, (x, i) -> i % 8 = 7)").alias("_cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda x: x <= F.struct(*order)))).drop("_cuts")


def ranked(df: DataFrame, group: list[str], ranges: list[str], order: list) -> DataFrame:
    """df with `_nth`, the number from 1 by `order` inside its group, and `_n`, the group's count.

    Rows are numbered inside ranges, and ranges after each other, so that no task holds a whole group. `ranges` are few
    values that rise with the order; rows of one order key must share them.
    """
    counts = df.groupBy(*group, *ranges).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*(group or [F.lit(1)]))
    before = F.sum("_c").over(w.orderBy(*ranges)) - F.col("_c")
    keys = [*group, *ranges]
    starts = counts.select(*[F.col(k).alias(f"{k}_of") for k in keys], before.alias("_before"), F.sum("_c").over(w).alias("_n"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.withColumn("_own", own)
    same = [rows[k].eqNullSafe(starts[f"{k}_of"]) for k in keys]
    return rows.join(F.broadcast(starts), same).withColumn("_nth", F.col("_before") + F.col("_own")).drop("_before", "_own", *[f"{k}_of" for k in keys])


def reduce_instances(inst: DataFrame, sims: DataFrame, top: float = 0.5, bottom: float = 0.03, method: str = "FIBONACCI", share: float = 0.5, cls: str = "NEGATIVE", descending: bool = False) -> DataFrame:
    """inst with one class thinned by similarity rank: both ends stay whole, only the middle slice loses rows.

    FIBONACCI keeps the places in the slice (from 0, with `descending` from its other end) that are Fibonacci numbers,
    RANDOM a share, ALL none. Tickers without similarities, and other classes, stay as they are.
    """
    keys = [*TICKER, "period_date"]
    ranked = inst.where(F.col("cls") == cls).join(sims.select(*keys, "value"), keys)
    w = Window.partitionBy(*TICKER)
    place = ranked.withColumn("_r", F.row_number().over(w.orderBy("value", "period_date")) - 1).withColumn("_n", F.count("*").over(w))
    lo, hi = F.floor(F.col("_n") * bottom), F.col("_n") - F.ceil(F.col("_n") * top) - 1
    middle = place.where((F.col("_r") >= lo) & (F.col("_r") < hi)).withColumn("_at", F.col("_r") - lo).withColumn("_m", hi - lo)
    if method == "FIBONACCI":
        at = F.col("_m") - 1 - F.col("_at") if descending else F.col("_at")
        gone = middle.where(~is_fibonacci(at))
    elif method == "RANDOM":
        shuffled = middle.withColumn("_s", F.row_number().over(w.orderBy(mixed("exchange", "symbol", "period_date"))))
        gone = shuffled.where(F.col("_s") > F.floor(F.col("_m") * share))
    else:
        gone = middle
    return inst.join(gone.select(*keys), keys, "left_anti")


def balanced_sample(inst: DataFrame, n: int, ratio: float = 1 / 6, min_per_ticker: int = 0, seed: int = 0, allow_short: bool = False) -> DataFrame:
    """ceil(n * ratio) positives and ceil(n * (1 - ratio)) negatives; each ticker's first min_per_ticker come first.

    Where both classes together give fewer than n rows, the query fails, unless allow_short.
    """
    order = mixed("exchange", "symbol", "period_date", seed=seed)
    own = F.row_number().over(Window.partitionBy(*TICKER, "cls").orderBy(order, "period_date"))
    first = inst.withColumn("_first", (own > min_per_ticker).cast("int")).withColumn("_o", order).withColumn("_range", hash_range(order))
    positives, negatives = math.ceil(n * ratio), math.ceil(n * (1 - ratio))
    want = F.when(F.col("cls") == "POSITIVE", positives).otherwise(negatives)
    rows = ranked(first, ["cls"], ["_first", "_range"], ["_o", *TICKER, "period_date"])
    found = rows.where(F.col("_nth") <= want).select(*inst.columns)
    if allow_short:
        return found
    counts = inst.agg(F.count_if(F.col("cls") == "POSITIVE").alias("p"), F.count_if(F.coalesce(F.col("cls") != "POSITIVE", F.lit(True))).alias("q"))
    have = F.least("p", F.lit(positives)) + F.least("q", F.lit(negatives))
    enough = counts.where(F.assert_true(have >= n, F.concat(F.lit("not enough instances: "), have.cast("string"), F.lit(f" of {n}"))).isNull()).select(F.lit(True).alias("_enough"))
    return found.crossJoin(F.broadcast(enough)).drop("_enough")


def split(inst: DataFrame, train: float, validation: float, seed: int = 0) -> DataFrame:
    """inst with `part`: train, validation or test, by floors of each class's count."""
    order = mixed("exchange", "symbol", "period_date", seed=seed)
    rows = ranked(inst.withColumn("_range", hash_range(order)), ["cls"], ["_range"], [order, *TICKER, "period_date"])
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + validation))
    return rows.withColumn("part", F.when(F.col("_nth") <= a, "train").when(F.col("_nth") <= b, "validation").otherwise("test")).select(*inst.columns, "part")


def assign_windows(counts: DataFrame, sets: int, target: float) -> DataFrame:
    """Ticker windows of near-equal size: tickers in order of closeness to the target ratio and size, dealt back and forth."""
    total = F.col("positive") + F.col("negative")
    ratio = F.col("positive") / total
    bucket = F.when(F.abs(ratio - target) <= 0.02, 0).when(F.abs(ratio - target) <= 0.05, 1).otherwise(2)
    order = ["_bucket", "_less", *TICKER]
    rows = ranked(key_ranges(counts.withColumn("_bucket", bucket).withColumn("_less", -total), order), [], ["_range"], order)
    k = (F.col("_nth") - 1) % (2 * sets)
    return rows.withColumn("window", F.when(k < sets, k).otherwise(2 * sets - 1 - k).cast("int")).select(*counts.columns, "window")


def page(symbols: DataFrame, size: int, i: int) -> DataFrame:
    """Page i (from 0) of the tickers, in order."""
    rows = ranked(key_ranges(symbols, TICKER), [], ["_range"], TICKER)
    return rows.where(F.floor((F.col("_nth") - 1) / size) == i).select(*symbols.columns)


def range_type(bars: DataFrame, preceding: int) -> DataFrame:
    """bars with the shape of the `preceding` rows from each row on: its way from the first row's open to the first row's
    close, and whether the range went above or below both. Rows too near the end have none."""
    ahead = ordered().rowsBetween(0, preceding - 1)
    top, bottom = F.max("high").over(ahead), F.min("low").over(ahead)
    full = F.count("*").over(ahead) == preceding
    falls = F.col("open") > F.col("close")
    upper, lower = F.greatest("open", "close"), F.least("open", "close")
    better, worse = F.col("_top") > upper, F.col("_bottom") < lower
    more = F.when(better & worse, "WITHBETTERHIGHANDWORSELOW").when(better, "WITHBETTERHIGH").when(worse, "WITHWORSELOW").otherwise("")
    rows = bars.withColumn("_top", top).withColumn("_bottom", bottom).withColumn("_full", full)
    return rows.withColumn("shape", F.when(F.col("_full"), F.concat(F.when(falls, "DECREASING").otherwise("INCREASING"), more))).drop("_top", "_bottom", "_full")


def range_type_counts(bars: DataFrame, preceding: int) -> DataFrame:
    return range_type(bars, preceding).where("shape is not null").groupBy("shape").agg(F.count("*").alias("n"))


def numbered_evenly(df: DataFrame, keys: list[str], buckets: int = 256) -> DataFrame:
    """df with `rank` from 0 without gaps and `total`: rows are numbered inside hash buckets, and buckets after each other."""
    rows = df.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("total"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) - 1
    return rows.withColumn("_i", inside).join(F.broadcast(starts), "_b").withColumn("rank", F.col("_start") + F.col("_i")).drop("_b", "_i", "_start")


def set_slice(df: DataFrame, keys: list[str], parts: int, i: int) -> DataFrame:
    """Part i (from 0) of df cut into near-equal parts."""
    rows = numbered_evenly(df, keys)
    return rows.where(F.floor(F.col("rank") * parts / F.col("total")) == i).drop("rank", "total")


def save_sets(sets: DataFrame, path: str, network: str, set_id: int | None = None) -> int:
    """Save the instances of a network's set (ticker, period_date and `part`, as split() gives); the set's number.

    One that is there under the same network and number is replaced, others stay. Without a number the network's latest
    is taken, or 1.
    """
    spark = sets.sparkSession
    if set_id is None:
        saved = read_sets(spark, path, network)
        set_id = (saved.agg(F.max("set_id")).first()[0] if saved is not None else None) or 1
    rows = sets.select(*TICKER, "period_date", "part", F.lit(network).alias("network"), F.lit(set_id).alias("set_id"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("network", "set_id").parquet(path)
    return set_id


def read_sets(spark: SparkSession, path: str, network: str, set_id: int | None = None) -> DataFrame | None:
    """The saved instances of a network, or of one of its sets: only these partitions are read. None if none was saved."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    schema = "exchange string, symbol string, period_date date, part string, network string, set_id int"
    saved = spark.read.schema(schema).parquet(path).where(F.col("network") == network)
    return saved if set_id is None else saved.where(F.col("set_id") == set_id)
