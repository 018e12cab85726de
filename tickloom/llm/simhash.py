"""SimHash near-duplicates: classes of documents whose 64-bit fingerprints link at a few differing bits.

Candidates come from a segment-popcount embedding: a fingerprint becomes the vector of the bit counts of its 32 two-bit
segments. Manhattan distance between vectors never exceeds Hamming distance between fingerprints, so points within
Manhattan distance 3 are all that must be looked at. The range join goes by grids: the 32 axes form 6 groups; of two
points within distance 3 at least 3 groups agree, so the points share a cell of one of the 20 grids that 3 groups span.
Points of crowded cells are cut by the fingerprints' own bits in the same way, 3 of 6 groups of bits, and cells that are
crowded still by the bits that are left, down to cells of nine free bits at most. Pairs of a cell are held to the Manhattan
distance first, and what passes is verified by the Hamming distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, materialise, slices, words

GROUPS = 6
#: Axes (two-bit segments) of each group, by segment number.
AXES = [range(32 * g // GROUPS, 32 * (g + 1) // GROUPS) for g in range(GROUPS)]
CROWD = 256  # points of a cell above which it is cut by bits


def fingerprints(docs: DataFrame, keys: list[str], shingle: int = 3) -> DataFrame:
    """The columns `keys` and fp (long): bit b is 1 if over half of the shingles' XXH64 have it.

    A-Z are lower-cased; shingles are `shingle` words joined by a space, repeats included; a text of fewer words is one
    shingle; a text that is null or has no word has fingerprint 0.
    """
    schema = docs.select(*keys).schema.add("fp", "long")

    def run(batches):
        for rows, buf, offs in slices(batches, "_text"):
            low = LOWER[buf]
            s, e, doc = words(low, offs)
            n = len(offs) - 1
            first = np.searchsorted(doc, np.arange(n + 1))
            fp = np.zeros(n, np.int64)
            # words end to end with one space between: word i starts at at[i]
            size = e - s + 1
            at = np.concatenate([[0], np.cumsum(size)])
            line = np.full(int(at[-1]), 32, np.uint8)
            own = np.repeat(s - at[:-1], size) + np.arange(int(at[-1]))
            inner = np.ones(len(line), bool)
            inner[at[1:] - 1] = False
            line[inner] = low[own[inner]]
            data = line.tobytes()
            begin, stop = at[:-1].tolist(), (at[1:] - 1).tolist()
            for i in range(n):
                a, b = int(first[i]), int(first[i + 1])
                if a == b:
                    continue
                k = min(shingle, b - a)
                h = np.fromiter((xxhash.xxh64_intdigest(data[x:y], 42) for x, y in zip(begin[a : b - k + 1], stop[a + k - 1 : b])), np.uint64, b - a - k + 1)
                ones = np.zeros(64, np.int64)
                for c in range(0, len(h), 1 << 16):
                    ones += np.unpackbits(h[c : c + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                fp[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], pa.array(fp)], names=[*keys, "fp"])

    return docs.select(*keys, F.col("text").alias("_text")).mapInArrow(run, schema)


def embedding(fp: Column) -> Column:
    """The 32 segment counts of a fingerprint, in two bits each: none 00, one 01, two 11.

    Written so, the Manhattan distance of two vectors is the number of bits in which they differ.
    """
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _masks(axes: list[int]) -> list[list[int]]:
    """The axes of each grid that half of 6 groups of the given axes span."""
    groups = [axes[len(axes) * g // GROUPS : len(axes) * (g + 1) // GROUPS] for g in range(GROUPS)]
    return [[axis for g in chosen for axis in g] for chosen in combinations(groups, GROUPS - 3)]


def _bits(axes: list[int]) -> int:
    """The bits of the embedding that the axes take up, as a signed 64-bit number."""
    bits = sum(3 << (2 * axis) for axis in axes)
    return bits - (1 << 64) if bits >> 63 else bits


_COARSE = _masks(list(range(32)))


def _bit_masks(free: list[int]) -> list[list[int]]:
    """Half of 6 groups of the given bits, in all 20 ways."""
    groups = [free[len(free) * g // GROUPS : len(free) * (g + 1) // GROUPS] for g in range(GROUPS)]
    return [[bit for g in chosen for bit in g] for chosen in combinations(groups, GROUPS - 3)]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << bit for bit in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _cuts() -> list[dict[int, list[int]]]:
    """For each level of cells that are cut by bits: the masks of a cell, and those of the cells that it is cut into.

    Two fingerprints that differ in 3 bits of a cell's free ones at most agree in 3 of 6 groups of these at least. Level 0
    cuts all 64 bits, level 1 the 32 or so that are left then, level 2 the 16 or so; 9 at most are left at the end.
    """
    out, now = [], {0: list(range(64))}
    for _ in range(3):
        level, next_ = {}, {}
        for mask, free in now.items():
            held = [bit for bit in range(64) if bit not in set(free)]
            level[mask] = []
            for chosen in _bit_masks(free):
                finer = _signed(held + chosen)
                level[mask].append(finer)
                next_[finer] = [bit for bit in free if bit not in set(chosen)]
        out.append(level)
        now = next_
    return out


_CUTS = _cuts()


def _cells(points: DataFrame) -> DataFrame:
    """One row for each fingerprint and grid: fp, grid number, cell."""
    e = F.col("_e")
    grids = F.posexplode(F.array(*[e.bitwiseAND(F.lit(_bits(m))) for m in _COARSE])).alias("_k", "cell")
    made = points.withColumn("_e", embedding(F.col("fp"))).select(*points.columns, grids)
    return made.select(*points.columns, F.col("_k").cast("long").alias("grid"), "cell")


def _finer(rows: DataFrame, level: int) -> DataFrame:
    """fp, grid and cell of the 20 cells that each row's cell is cut into by bits. A cell's grid is its mask, which no number of a coarse grid equals."""
    table = [(mask, finer) for mask, fine in _CUTS[level].items() for finer in fine]  # 8,000 rows at most
    cuts = rows.sparkSession.createDataFrame(pa.table({"grid": pa.array([m for m, _ in table], pa.int64()), "_finer": pa.array([f for _, f in table], pa.int64())}))
    own = rows.select("fp", "grid").distinct()
    return own.join(F.broadcast(cuts), "grid").select("fp", F.col("_finer").alias("grid"), F.col("fp").bitwiseAND(F.col("_finer")).alias("cell")).distinct()


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _near(a: Column, b: Column, bits: int) -> Column:
    """Within `bits`: Manhattan distance of the embeddings first, then Hamming distance of the fingerprints."""
    return (_distance(embedding(a), embedding(b)) <= bits) & (_distance(a, b) <= bits)


def components(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """fp and root: the least fp of its component. edges: a, b. Alternates large-star and small-star until edges rest.

    Every round is a grouping of edges by one end that keeps a minimum, written to the shared folder; no component is
    gathered anywhere. Edges come to rest after a number of rounds that grows with the logarithm of the nodes.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), f"{name}-edges")
    before = None
    while True:
        # large star: every neighbour above a node is tied to the least of the node's neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # small star: every neighbour below a node, and the node, are tied to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a > b").distinct()
        edges = materialise(small, f"{name}-edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "fp")
    return nodes.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _crowded(cells: DataFrame, name: str) -> DataFrame:
    """fp, grid, cell, hub (the cell's least point) and n (its points) where a cell has more points than one."""
    hub = cells.groupBy("grid", "cell").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return materialise(cells.join(hub, ["grid", "cell"]).select("fp", "grid", "cell", "hub", "n"), name)


def link(points: DataFrame, bits: int = 3, name: str = "simhash", crowd: int = CROWD) -> DataFrame:
    """fp and root for distinct fingerprints (column fp): root is equal exactly where a chain of links joins them.

    First every point is tied to the least point of each of its cells, where the distance allows: as many rows as
    points and grids. The components of these ties swallow dense groups. Cells whose points are all in one component
    need no more; in the others, points of different components are compared.

    Of points in coarse cells with more than `crowd` of them, pairs are sought in cells cut by bits instead: 20 for each
    point, and 20 more for each of those that is crowded too. A cell of the last cut has 512 points at most.
    """
    if bits > 3:
        raise ValueError("the grids hold for 3 differing bits at most")
    crowded = _crowded(_cells(points.select("fp")), f"{name}-cells")
    ties, asked, dense = crowded, crowded.where(F.col("n") <= crowd), crowded.where(F.col("n") > crowd).withColumn("grid", F.lit(0).cast("long"))
    for level in range(len(_CUTS)):
        if dense.isEmpty():
            break
        fine = _crowded(_finer(dense, level), f"{name}-cells-{level}")
        last = level + 1 == len(_CUTS)
        ties, asked = ties.unionByName(fine), asked.unionByName(fine if last else fine.where(F.col("n") <= crowd))
        dense = fine.where(F.col("n") > crowd)
    ties = ties.where((F.col("fp") != F.col("hub")) & _near(F.col("fp"), F.col("hub"), bits)).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    rough = materialise(components(ties, crowded.select("fp").distinct(), name), f"{name}-rough")
    cell = asked.select("fp", "grid", "cell").join(rough, "fp")
    split = cell.groupBy("grid", "cell").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("grid", "cell")
    cell = materialise(cell.join(split, ["grid", "cell"]), f"{name}-split-cells")
    left, right = cell.select("grid", "cell", F.col("fp").alias("a"), F.col("root").alias("ra")), cell.select("grid", "cell", F.col("fp").alias("b"), F.col("root").alias("rb"))
    near = left.join(right, ["grid", "cell"]).where((F.col("ra") < F.col("rb")) & _near(F.col("a"), F.col("b"), bits))
    more = near.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    tops = rough.select(F.col("root").alias("fp")).distinct()
    over = components(more, tops, name).withColumnRenamed("fp", "mid").withColumnRenamed("root", "top")
    final = rough.withColumnRenamed("root", "mid").join(over, "mid").select("fp", "top")
    return points.select("fp").join(final, "fp", "left").select("fp", F.coalesce("top", "fp").alias("root"))


def classes(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) for every row of docs.

    Texts are whole. Null and empty texts have fingerprint 0 and link like any other. Repeated rows each get their row;
    a null doc_id is never a component_id unless it is alone. Other columns of docs are left out.
    """
    fps = materialise(fingerprints(docs, ["doc_id"], shingle), "simhash-fp")
    points = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    roots = link(points, bits)
    tops = points.join(roots, "fp")
    least = tops.groupBy("root").agg(F.min("least").alias("component_id"))
    member = tops.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """docs with one document of each class: the one with the smallest doc_id; of rows that repeat that id, one.

    Rows whose doc_id is null cannot be named as copies of anything; they stay.
    """
    found = classes(docs, shingle, bits).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_tl_rows"))
    first = docs.join(found, "doc_id")
    # a row stands for all that repeat its id: the one with the least text
    again = first.where("_tl_rows > 1").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("_tl_row")).select("_tl_row.*")
    parts = (docs.where("doc_id is null"), first.where("_tl_rows = 1"), again)
    out = [part.select(docs.columns) for part in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
