"""Sharding by longest processing time first: the largest group of equal texts goes to the least-loaded shard.

The schedule needs sizes only. Groups that weigh much are scheduled one by one; the others are first dealt by hash into
a fixed number of bundles, which then stand for groups. What reaches the driver is bounded by the number of bundles
plus the number of groups that can be heavy, whatever the corpus.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

BUNDLES = 1 << 16
PART = 100_000  # rows that are numbered in one task, about
REPEATED = 8192  # rows alike are dealt out by number above this share of all rows
HEAVY_PARTS = 512  # a group is heavy above 1/(shards * HEAVY_PARTS) of all bytes, so there are fewer than that many


def schedule(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Shard of each named size: the largest first (ties by name), each to the least-loaded shard (ties: the lowest)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


def assign(docs: DataFrame, shards: int = 16, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of docs, by the law `bytes`: shards of nearly equal size.

    size is the text's UTF-8 bytes plus 1 (null: 1); rows of equal text share a shard (null and empty texts count as
    equal). slot numbers a shard's rows from 0 without a gap. Repeated rows each get a slot; a null doc_id is kept.
    A text, or a group of equal ones, that is larger than a shard's even share has a shard to itself as far as the
    schedule goes: the others fill the remaining shards, and only that one exceeds the mean. An empty table gives an empty
    result. Other columns of docs are left out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.encode(text, "utf-8")
    own = F.monotonically_increasing_id().alias("_no")
    rows = materialise(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("_key"), own), "shard-rows")
    groups = materialise(rows.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    heavy = F.col("bytes") * (shards * HEAVY_PARTS) > int(total)
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("_key"), F.lit(bundles)).cast("string"))
    named = groups.select(F.when(heavy, F.col("_key")).otherwise(bundle).alias("name"), "bytes")
    sizes = [(r["name"], int(r["bytes"])) for r in named.groupBy("name").agg(F.sum("bytes").alias("bytes")).toLocalIterator()]
    plan = schedule(sizes, shards)
    table = spark.createDataFrame(pa.table({"_name": pa.array(list(plan), pa.string()), "shard": pa.array(list(plan.values()), pa.int32())}))
    big = table.where("_name not like 'b%' or length(_name) = 32")
    dealt = rows.join(F.broadcast(big.withColumnRenamed("shard", "_big")), F.col("_key") == F.col("_name"), "left").drop("_name")
    dealt = dealt.withColumn("_b", F.when(F.col("_big").isNull(), bundle)).join(F.broadcast(table), F.col("_b") == F.col("_name"), "left")
    placed = dealt.select("doc_id", "size", "text_crc32", F.coalesce("_big", "shard").alias("shard"), "_no")
    # slots: a shard's rows are numbered in parts of bounded size, and each part starts where the earlier ones end. Rows that
    # are alike in all go to one part, unless there are more of them than a part takes: then by their number in the table.
    parts = max(64, -(-int(n) // (shards * PART)))
    alike = rows.groupBy("doc_id", "text_crc32").agg(F.count("*").alias("_n")).where(F.col("_n") > max(PART, int(n) // REPEATED))
    many = F.broadcast(alike.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc")))  # fewer than REPEATED rows
    placed = placed.join(many, placed["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_crc32") == F.col("_crc")), "left")
    salt = F.when(F.col("_crc").isNotNull(), F.xxhash64("_no")).otherwise(0)
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32", salt), F.lit(parts))).drop("_id", "_crc")
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "_no")) - 1
    slotted = placed.withColumn("_in", inside).join(starts, ["shard", "_part"])
    return slotted.select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_in")).cast("long").alias("slot"))
