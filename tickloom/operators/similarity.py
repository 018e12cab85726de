"""Vector similarity with built-in functions, and sums of distances within groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runs import each_run, runs


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def inner(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def size(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    return inner(a, b) / (size(a) * size(b))


def theta(a: Column, b: Column) -> Column:
    """Angle plus ten degrees, in radians; the cosine is held to [-1, 1]."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))) + math.radians(10)


def triangle(a: Column, b: Column) -> Column:
    """The triangle's area; the angle is turned into radians a second time, as the measure is in use."""
    return size(a) * size(b) * F.sin(F.radians(theta(a, b))) / 2


def sector(a: Column, b: Column) -> Column:
    r = euclidean(a, b) + F.abs(size(a) - size(b))
    return math.pi * r * r * theta(a, b) / 360


METRICS = {"cosine": cosine, "inner_product": inner, "euclidean": euclidean, "magnitude": lambda a, b: F.abs(size(a) - size(b)), "theta": theta, "triangle": triangle, "sector": sector, "ts_ss": lambda a, b: triangle(a, b) * sector(a, b)}


def similarity(df: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    return df.withColumn(metric, METRICS[metric](F.col(a), F.col(b)))


#: Vectors of a block at most, about; and values of one tile of differences.
BLOCK, TILE = 2048, 1 << 21
#: Vectors of a group at most that is done at once.
SMALL = 1024


def _cross(x, y):
    """The sums of distances from each row of x to all of y and the other way, by direct differences in bounded tiles."""
    import numpy as np

    left, right = np.zeros(len(x)), np.zeros(len(y))
    width = max(1, x.shape[1])
    n = max(1, min(len(y), TILE // width))
    m = max(1, TILE // (width * n))
    for i in range(0, len(x), m):
        for j in range(0, len(y), n):
            d = np.sqrt(((x[i : i + m, None, :] - y[None, j : j + n, :]) ** 2).sum(2))
            left[i : i + m] += d.sum(1)
            right[j : j + n] += d.sum(0)
    return left, right


def _block_sums(rows: DataFrame, groups: list[str], block: int) -> DataFrame:
    """The group columns, i and s: sums of distances of vectors (i, v, fresh) over all pairs of a group with a fresh one.

    A group of at most SMALL vectors is one block. A larger one has 16 blocks, and more as its count grows, so that a block
    stays bounded and a large group spreads over many tasks; each pair of blocks is done at once. In a pair of blocks, only
    fresh rows meet rows that are not. Pairs of blocks lie sorted in a task, which does one after the other: a call of
    Python for each would take longer than the work where groups are small and many.
    """
    import numpy as np
    import pyarrow as pa

    def with_group(left: DataFrame, right: DataFrame) -> DataFrame:
        of = right.withColumnsRenamed({g: f"_of_{g}" for g in groups})
        return left.join(of, [left[g].eqNullSafe(of[f"_of_{g}"]) for g in groups]).drop(*[f"_of_{g}" for g in groups])

    n, small = F.count("*"), min(block, SMALL)
    blocks = F.when(n <= small, 1).otherwise(F.greatest(F.least(n, F.lit(16)), F.ceil(n / block)))
    count = rows.groupBy(*groups).agg(blocks.cast("int").alias("m"))
    rows = with_group(rows, count).withColumn("b", F.pmod(F.xxhash64("i"), F.col("m")).cast("int"))
    # a pair of blocks is left out if neither holds a fresh row
    some = rows.where("fresh").select(*groups, F.col("b").alias("o")).distinct().groupBy(*groups).agg(F.collect_set("o").alias("_with"))
    other = F.when(F.array_contains("_with", F.col("b")), F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.col("_with"))
    pair = F.explode(F.transform(other, lambda o: F.struct(F.least("b", o).alias("lo"), F.greatest("b", o).alias("hi")))).alias("p")
    dealt = with_group(rows, some).select(*groups, "i", "v", "fresh", "b", pair).select(*groups, "i", "v", "fresh", "b", "p.lo", "p.hi")

    def work(t: pa.Table) -> pa.RecordBatch:
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        b, fresh = np.asarray(t.column("b")), np.asarray(t.column("fresh"))
        v = t.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        at, sums = [], []

        def add(x, y, both=True):
            if len(x) and len(y):
                left, right = _cross(v[x], v[y])
                at.extend([x, y] if both else [x])
                sums.extend([left, right] if both else [left])

        new, old = np.flatnonzero((b == lo) & fresh), np.flatnonzero((b == lo) & ~fresh)
        if lo == hi:
            add(new, new, False)
            add(new, old)
        else:
            add(new, np.flatnonzero(b == hi))
            add(old, np.flatnonzero((b == hi) & fresh))
        rows = t.select([*groups, "i"]).take(pa.array(np.concatenate([np.zeros(0, np.int64), *at])))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate([np.zeros(0), *sums]))], names=[*groups, "i", "s"])

    return each_run(dealt, [*groups, "lo", "hi"], [], work, rows.select(*groups, "i").schema.add("s", "double"))


def _plain(vectors: DataFrame, groups: list[str], vec_id: str, vec: str, fresh: bool) -> DataFrame:
    return vectors.select(*groups, F.col(vec_id).alias("i"), F.col(vec).cast("array<double>").alias("v"), F.lit(fresh).alias("fresh"))


def distance_sums(vectors: DataFrame, group: str | list[str], vec_id: str, vec: str, block: int = BLOCK) -> DataFrame:
    """The group's columns, id and the sum of Euclidean distances from each vector to all others of its group.

    Ids need only be unique inside a group; group columns and ids may be of any type. A group is cut by id into 16 blocks
    or more, of about `block` vectors at most; each pair of blocks is one task's work, so that a large group spreads over
    many tasks and none holds it whole.
    """
    groups = [group] if isinstance(group, str) else group
    parts = _block_sums(_plain(vectors, groups, vec_id, vec, True), groups, block)
    return parts.groupBy(*groups, "i").agg(F.sum("s").alias("value")).withColumnRenamed("i", vec_id)


def _matrix(lists):
    """Vectors of an Arrow column as rows padded with zeros, their lengths, and whether one can be compared: it is not null and has no null."""
    import numpy as np

    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    out = np.zeros((len(lists), int(size.max(initial=0))))
    flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    whole = np.asarray(lists.is_valid())
    return out, size, whole & (np.bincount(row, np.asarray(flat.is_null()), len(lists)) == 0)


def self_pairs(vectors: DataFrame, group: list[str], vec_id: str, vec: str, block: int = 512) -> DataFrame:
    """All pairs of a group's vectors, each once: the group's columns, a < b (ids) and their Euclidean distance.

    As many rows as pairs: where only sums are asked for, distance_sums() makes none of them. A group is dealt by id into
    blocks of about `block` vectors; each pair of blocks is done at once, so that a large group spreads over as many tasks
    as there are, and none holds more than two blocks and a part of their pairs. Vectors of different lengths, null ones
    and those with a null have no distance.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = vectors.select(*group, F.col(vec_id).alias("_i"), F.col(vec).cast("array<double>").alias("_v")).where(F.col("_i").isNotNull())
    count = rows.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("_m"))
    dealt = rows.join(count, group).withColumn("_b", F.pmod(F.xxhash64("_i"), F.col("_m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_o")
    dealt = dealt.select(*group, "_i", "_v", "_b", other).select(*group, "_i", "_v", "_b", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"))

    def work(t: pa.RecordBatch) -> pa.RecordBatch:
        lo, hi = t.column("_lo")[0].as_py(), t.column("_hi")[0].as_py()
        b, ids = np.asarray(t.column("_b")), t.column("_i")
        v, size, whole = _matrix(t.column("_v"))
        place = np.asarray(pc.rank(ids, tiebreaker="dense")).astype(np.int64)
        left, right = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        at, far, known = [], [], []
        step = max(1, TILE // max(1, v.shape[1] * len(right)))
        for k in range(0, len(left), step):
            x = left[k : k + step]
            i, j = np.nonzero(place[x, None] < place[None, right] if lo == hi else np.ones((len(x), len(right)), bool))
            one, two = x[i], right[j]
            far.append(np.sqrt(((v[x, None, :] - v[None, right, :]) ** 2).sum(2))[i, j])
            known.append((size[one] == size[two]) & whole[one] & whole[two])
            at.append(np.where(place[one] < place[two], [one, two], [two, one]))
        a, z = np.concatenate([np.zeros((2, 0), np.int64), *at], axis=1)
        told = [t.column(c).take(pa.array(a)) for c in group]
        apart = pa.array(np.concatenate([np.zeros(0), *far]), mask=~np.concatenate([np.zeros(0, bool), *known]))
        return pa.RecordBatch.from_arrays([*told, ids.take(pa.array(a)), ids.take(pa.array(z)), apart], names=[*group, "a", "b", "distance"])

    schema = vectors.select(*group, F.col(vec_id).alias("a"), F.col(vec_id).alias("b")).schema.add("distance", "double")
    together = lambda groups: pa.concat_batches([work(g) for g in groups])
    return runs(dealt, [*group, "_lo", "_hi"], [], together, schema, 2 * block)


def check_range(vectors: DataFrame, vec: str, low: float = 0.0, high: float = 1.25) -> DataFrame:
    """Rows with a value outside [low, high]."""
    return vectors.where(F.exists(vec, lambda x: (x < low) | (x > high)))


def update_distance_sums(stored: DataFrame, old: DataFrame, new: DataFrame, group: str | list[str], vec_id: str, vec: str, block: int = BLOCK) -> DataFrame:
    """Sums after adding vectors: only new against all is computed, in blocks, and added to what is stored."""
    groups = [group] if isinstance(group, str) else group
    parts = _block_sums(_plain(old, groups, vec_id, vec, False).unionByName(_plain(new, groups, vec_id, vec, True)), groups, block)
    had = stored.select(*groups, F.col(vec_id).alias("i"), F.col("value").alias("s"))
    return had.unionByName(parts).groupBy(*groups, "i").agg(F.sum("s").alias("value")).withColumnRenamed("i", vec_id)


def check_similarity_dates(stored: DataFrame, inst: DataFrame) -> DataFrame:
    """Tickers whose stored dates differ from their negative instances' dates, with the counts on each side."""
    keys = ["exchange", "symbol", "period_date"]
    neg = inst.where("cls = 'NEGATIVE'").select(*keys, F.lit(1).alias("_i"))
    both = neg.join(stored.select(*keys, F.lit(1).alias("_s")), keys, "full")
    sums = both.groupBy("exchange", "symbol").agg(F.count_if(F.col("_s").isNull()).alias("missing"), F.count_if(F.col("_i").isNull()).alias("extra"))
    return sums.where("missing > 0 or extra > 0")


def rekey_sums(stored: DataFrame, inst: DataFrame) -> DataFrame:
    """stored with the date of the nth negative instance on its nth row."""
    w = Window.partitionBy("exchange", "symbol").orderBy("period_date")
    s = stored.withColumn("_n", F.row_number().over(w)).drop("period_date")
    i = inst.where("cls = 'NEGATIVE'").select("exchange", "symbol", "period_date", F.row_number().over(w).alias("_n"))
    return s.join(i, ["exchange", "symbol", "_n"]).drop("_n")
