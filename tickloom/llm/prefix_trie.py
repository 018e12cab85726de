"""The trie of all conversations' prefixes: one row for each distinct sequence of first turns.

A turn becomes a 20-byte id: 16 bytes of the SHA-256 of role and text, and the text's length. Turns stand in columns by
place, WIDTH to a row, so that one Spark SQL ROLLUP over these columns aggregates all prefixes together; grouping_id tells
their depth. A long conversation goes on in further rows (blocks), which are keyed by the node that the block before ends
at: 128 bits from all turns up to there and their places, so that all blocks are rolled up at once and none waits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.labels import key_ranges
from ._common import materialise

WIDTH = 8
COLUMNS = [f"t{k}" for k in range(1, WIDTH + 1)]
CHUNK = 512  # ids of conversations that stand in one string before a node's digest is made
_RUN = 1024  # blocks of a conversation whose keys are summed up in one step


def turn_id(role: Column, text: Column) -> Column:
    """20 bytes that stand for a turn: equal turns have equal ids, and the last four bytes are the text's UTF-8 length."""
    size = F.octet_length(text)
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.unhex(F.sha2(both, 256)), 1, 16), F.unhex(F.lpad(F.hex(size.cast("long")), 8, "0")))


def _size(turn: Column) -> Column:
    """The text's length that a turn id holds; 0 for none."""
    return F.coalesce(F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("long"), F.lit(0))


def _half(place: Column, turn: Column, which: int) -> Column:
    """One of the two 64-bit values whose exclusive-or over a prefix's turns is the prefix's key."""
    return F.xxhash64(F.lit(which), place.cast("long"), turn, F.lit(which))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1) and turn for every turn, in the order of turn (null first; ties by turn id).

    A conversation that lies in several key ranges is numbered in each of them, and the ranges after each other; the
    starts that this needs are fewer than ranges, as each cut between ranges divides one conversation at most.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").alias("at"), turn_id(role, text).alias("turn"))
    ranged = materialise(key_ranges(rows, ["conv_id", "at", "turn"], 64), "trie-turns")
    own = F.row_number().over(Window.partitionBy("conv_id", "_range").orderBy(F.asc_nulls_first("at"), "turn"))
    counts = ranged.groupBy("conv_id", "_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("_range")) - F.col("n")
    starts = counts.withColumn("before", before).where("before > 0").drop("n")
    placed = ranged.withColumn("own", own).join(F.broadcast(starts), ["conv_id", "_range"], "left")
    return placed.select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("place"), "turn")


def rebuilt(placed: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """conv_id, len, place and turn of rebuilt conversations, with one more row without place and turn for each of them.

    Conversation c takes the first h turns of c - c % family (all if fewer, none if absent), then its own after the
    first h; h is crc32(decimal c) % most.
    """
    c = F.col("conv_id")
    own = placed.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", c - c % family).withColumn("h", F.crc32(c.cast("string").cast("binary")) % most)
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = own.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = materialise(plan.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "taken", "len"), "trie-plan")
    start = placed.where((F.col("place") < most) & (c % family == 0)).withColumnRenamed("conv_id", "base")
    first = start.join(plan, "base").where("place <= taken").select("conv_id", "len", "place", "turn")
    rest = placed.join(plan, "conv_id").where("place > h").select("conv_id", "len", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn")
    return first.unionByName(rest).unionByName(plan.select("conv_id", "len", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn")))


def blocks(sequences: DataFrame, name: str = "trie") -> DataFrame:
    """One row for each WIDTH turns of a conversation: conv_id, len, block (from 0), before, ka, kb, sum_a, sum_b, size, t1 to t8.

    ka and kb are the key of the node that the block before ends at, and before the bytes of the texts up to there; sum_a,
    sum_b and size are those of the block itself. A conversation without turns has block 0 with no turn.
    """
    place, turn = F.col("place"), F.col("turn")
    block = F.coalesce(((place - 1) / WIDTH).cast("long"), F.lit(0)).alias("block")
    slot = F.pmod(place - 1, F.lit(WIDTH))
    columns = [F.max(F.when(slot == k, turn)).alias(c) for k, c in enumerate(COLUMNS)]
    keys = [F.coalesce(F.bit_xor(F.when(turn.isNotNull(), _half(place, turn, w))), F.lit(0)).alias(n) for w, n in ((1, "sum_a"), (2, "sum_b"))]
    rows = materialise(sequences.groupBy("conv_id", "len", block).agg(*columns, *keys, F.sum(_size(turn)).alias("size")), f"{name}-blocks")
    # keys up to a block: runs of blocks first, then the blocks of a run, so that no window holds a whole conversation
    full = rows.where(f"len > (block + 1) * {WIDTH}").select("conv_id", F.col("block"), F.floor(F.col("block") / _RUN).alias("run"), "sum_a", "sum_b", "size")
    total = {"sum_a": F.bit_xor, "sum_b": F.bit_xor, "size": F.sum}
    ahead = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = full.groupBy("conv_id", "run").agg(*[f(k).alias(k) for k, f in total.items()]).select("conv_id", "run", *[F.coalesce(f(k).over(ahead), F.lit(0)).alias(f"run_{k}") for k, f in total.items()])
    inside = Window.partitionBy("conv_id", "run").orderBy("block")
    upto = full.select("conv_id", "run", "block", *[f(k).over(inside).alias(f"in_{k}") for k, f in total.items()]).join(runs, ["conv_id", "run"])
    prior = upto.select("conv_id", (F.col("block") + 1).alias("block"), F.col("in_sum_a").bitwiseXOR(F.col("run_sum_a")).alias("ka"), F.col("in_sum_b").bitwiseXOR(F.col("run_sum_b")).alias("kb"), (F.col("in_size") + F.col("run_size")).alias("before"))
    zero = F.lit(0).cast("long")
    later = rows.where("block > 0").join(prior, ["conv_id", "block"])
    return rows.where("block = 0").withColumns({"ka": zero, "kb": zero, "before": zero}).unionByName(later)


def _rolled(rows: DataFrame, measures: str) -> DataFrame:
    """Every prefix of rows in one ROLLUP: depth, ka and kb (its key), up_a and up_b (its parent's), before (bytes before its last turn), last (its last turn), and the measures."""
    found = rows.sparkSession.sql(
        f"select block, ka, kb, before, {', '.join(COLUMNS)}, grouping_id() as gid, {measures} from {{rows}} group by block, ka, kb, before, rollup({', '.join(COLUMNS)})",
        rows=rows,
    )
    level = (F.lit(WIDTH) - F.bit_count("gid")).cast("long")  # rolled-up columns have their bit set
    found = found.withColumn("level", level).withColumn("last", F.get(F.array(F.lit(None), *COLUMNS), F.col("level").cast("int")))
    found = found.where("last is not null or (level = 0 and block = 0)")  # a shorter conversation fills no deeper level
    depth = F.col("block") * WIDTH + F.col("level")

    def keyed(which: int, prior: str, short: int) -> Column:
        key = F.col(prior)
        for k, c in enumerate(COLUMNS):
            place = F.col("block") * WIDTH + k + 1
            key = key.bitwiseXOR(F.when(F.col("level") - short > k, _half(place, F.col(c), which)).otherwise(0))
        return key

    sizes = sum((F.when(F.col("level") - 1 > k, _size(F.col(c))).otherwise(0) for k, c in enumerate(COLUMNS)), F.col("before"))
    kept = [c for c in found.columns if c not in {"block", "ka", "kb", "before", *COLUMNS, "gid", "level"}]
    return found.select(depth.alias("depth"), keyed(1, "ka", 0).alias("ka"), keyed(2, "kb", 0).alias("kb"), keyed(1, "ka", 1).alias("up_a"), keyed(2, "kb", 1).alias("up_b"), sizes.alias("before"), *kept)


def _ends(rows: DataFrame) -> DataFrame:
    """depth, ka, kb and ends_sha256 of the nodes at which conversations end.

    Ids are joined in strings of at most CHUNK ids first; a node's strings are hashed one after the other, so that a node
    at which very many conversations end costs one task some bytes an id and no memory.
    """
    at = rows.where(f"len <= (block + 1) * {WIDTH}").select(F.col("len").alias("depth"), F.col("ka").bitwiseXOR(F.col("sum_a")).alias("ka"), F.col("kb").bitwiseXOR(F.col("sum_b")).alias("kb"), "conv_id")
    part = F.floor(F.col("conv_id") / CHUNK).alias("part")
    parts = at.groupBy("depth", "ka", "kb", part).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    text = parts.select("depth", "ka", "kb", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    schema = text.select("depth", "ka", "kb").schema.add("ends_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if k != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=schema.names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, state.hexdigest()), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=schema.names)

    return text.repartition("depth", "ka", "kb").sortWithinPartitions("depth", "ka", "kb", "part").mapInArrow(run, schema)


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of all sequences (conv_id, len, place, turn, as rebuilt() gives them), one row a node.

    conv_id: the node's smallest member; depth; parent_conv_id: the parent's smallest member; n_convs; n_children;
    n_leaves; saved_tokens: over the node's subtree, bytes of each node's last text for every member but one;
    ends_sha256: of the ascending ids of the conversations that end here.

    A conversation is the smallest member of the nodes from some depth of its path on, down to its end. So a subtree's
    sums are sums over members: each brings the bytes above the nodes that it is the smallest of, and one leaf if it is
    the smallest of a leaf.
    """
    rows = materialise(blocks(sequences), "trie-rows")
    nodes = materialise(_rolled(rows, "min(conv_id) as conv_id, count(*) as n_convs, max(len) as reach"), "trie-nodes")
    leaf = F.when(F.col("reach") == F.col("depth"), 1).otherwise(0).cast("long")
    # of each conversation: the bytes above its own nodes (all of them if it has none), and whether it has a leaf
    none = F.lit(None).cast("struct<depth:long,bytes:long>")
    told = rows.select("conv_id", "size", none.alias("top"), F.lit(0).cast("long").alias("leaf")).unionByName(
        nodes.select("conv_id", F.lit(0).cast("long").alias("size"), F.struct("depth", F.col("before").alias("bytes")).alias("top"), leaf.alias("leaf"))
    )
    conv = told.groupBy("conv_id").agg(F.sum("size").alias("all"), F.min("top").alias("top"), F.max("leaf").alias("leaf"))
    conv = materialise(conv.select("conv_id", F.coalesce("top.bytes", "all").alias("above"), F.col("top.depth").alias("first"), "leaf"), "trie-conversations")
    sums = _rolled(rows.join(conv, "conv_id"), "sum(above) as above, sum(leaf) as n_leaves")

    key = ["depth", "ka", "kb"]
    long = lambda x: F.lit(x).cast("long")
    parts = [
        nodes.select(*key, "up_a", "up_b", "conv_id", "before", "n_convs", long(0).alias("n_children"), long(0).alias("above"), long(0).alias("n_leaves"), F.lit(None).cast("string").alias("ends")),
        nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("ka"), F.col("up_b").alias("kb")).agg(F.count("*").alias("n_children")),
        sums.select(*key, "above", "n_leaves"),
        _ends(rows).withColumnRenamed("ends_sha256", "ends"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    single = [F.max(c).alias(c) for c in ("up_a", "up_b", "conv_id", "before", "n_convs", "ends")]
    node = materialise(every.groupBy(*key).agg(*single, *[F.sum(c).alias(c) for c in ("n_children", "above", "n_leaves")]), "trie-merged")

    # the parent of a node is its conversation's own node one higher up, but for the first of the conversation's nodes
    top = node.select("depth", "ka", "kb", F.col("conv_id").alias("parent_conv_id"))
    first = node.join(conv.select("conv_id", F.col("first").alias("depth"), F.col("above").alias("own_above")), ["conv_id", "depth"]).where("depth > 0")
    tied = first.select("conv_id", "depth", (F.col("depth") - 1).alias("up"), "up_a", "up_b").join(
        top.select(F.col("depth").alias("up"), F.col("ka").alias("up_a"), F.col("kb").alias("up_b"), "parent_conv_id"), ["up", "up_a", "up_b"]
    )
    tied = materialise(tied.select("conv_id", "parent_conv_id"), "trie-parents")
    about = conv.join(tied, "conv_id", "left").select("conv_id", F.col("above").alias("own_above"), "first", F.col("parent_conv_id").alias("top_parent"))
    whole = node.join(about, "conv_id")
    return whole.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("top_parent")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("above") - F.col("own_above") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def prefixes(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """trie() of the rebuilt conversations of a table with conv_id, turn, role and text.

    Null role or text is empty; rows whose conv_id is null belong to no conversation and make no node; repeated rows are
    turns of their own. Conversations without turns after rebuilding are members of the root alone. An empty table has no
    node. Other columns are left out.
    """
    return trie(rebuilt(materialise(numbered(conversations), "trie-places"), family, most))
