import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import simhash

from .conftest import SCHEMA


def fingerprint(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(fps):
    """Smallest index that a chain of links reaches, for each fingerprint."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_against_all_pairs(spark, docs, corpus):
    fps = [fingerprint(t) for t in corpus]
    want = sorted((i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, least_reachable(fps))))
    assert sorted(map(tuple, simhash.classes(docs.repartition(3)).collect())) == want


def test_manhattan_is_a_lower_bound(spark):
    rng = random.Random(5)
    pairs = [(a - (1 << 63), (a ^ sum(1 << rng.randrange(64) for _ in range(5)) & (1 << 64) - 1) - (1 << 63)) for a in (rng.getrandbits(64) for _ in range(200))]
    pairs = [(a, max(min(b, (1 << 63) - 1), -(1 << 63))) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", simhash._distance(simhash.embedding(F.col("a")), simhash.embedding(F.col("b"))).alias("m"), simhash._distance(F.col("a"), F.col("b")).alias("h")).collect()

    def counts(x):
        return [((x >> 2 * k) & 1) + ((x >> 2 * k + 1) & 1) for k in range(32)]

    for r in got:
        assert r["m"] == sum(abs(x - y) for x, y in zip(counts(r["a"]), counts(r["b"]))) <= r["h"]


@pytest.mark.parametrize("crowd", [1, 20, simhash.CROWD])
def test_crowded_cells(spark, crowd):
    """Two dense groups that nothing links, one that a single chain links, and one of a hub with all its neighbours."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    far = base ^ 0xF0F0
    fps = {base ^ sum(1 << b for b in rng.sample(range(20, 64), rng.randint(0, 3))) for _ in range(150)}
    fps |= {far ^ sum(1 << b for b in rng.sample(range(20, 64), rng.randint(0, 2))) for _ in range(100)}
    fps |= {base ^ 0x7 << 17, base ^ 0x3F << 17, rng.getrandbits(64)}
    fps = sorted(fps, key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    roots = {r["fp"]: r["root"] for r in simhash.link(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=crowd).collect()}
    least = least_reachable(fps)
    pairs = {(c, roots[x]) for x, c in zip(signed, least)}
    assert len(pairs) == len(set(least)) == len(set(roots.values())) and len(roots) == len(signed)


@pytest.mark.parametrize("crowd", [2, simhash.CROWD])
def test_points_of_one_embedding(spark, crowd):
    """Every segment holds one bit, so that popcounts part nothing; near copies differ in up to three bits."""
    rng = random.Random(4)
    fps = {sum(rng.choice((1, 2)) << 2 * k for k in range(32)) for _ in range(700)}
    fps |= {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for x in rng.sample(sorted(fps), 100)}
    fps = sorted(fps, key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    roots = {r["fp"]: r["root"] for r in simhash.link(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=crowd).collect()}
    least = least_reachable(fps)
    assert len({(c, roots[x]) for x, c in zip(signed, least)}) == len(set(least)) == len(set(roots.values())) < len(fps)


def test_cuts_by_bits_miss_no_near_pair():
    rng = random.Random(6)
    for level, cut in enumerate(simhash._CUTS):
        for mask, fine in rng.sample(sorted(cut.items()), min(len(cut), 20)):
            free = [b for b in range(64) if not mask >> b & 1]
            assert abs(len(free) - (64, 32, 16)[level]) <= level and all((f & mask) == mask for f in fine)
            for _ in range(50):
                flipped = sum(1 << b for b in rng.sample(free, 3))
                assert any(not f & flipped for f in fine)
    assert max((~f & (1 << 64) - 1).bit_count() for fine in simhash._CUTS[-1].values() for f in fine) == 9


def test_links_of_made_fingerprints(spark):
    rng = random.Random(3)
    fps = [0, 1, 7, 15, 31, (1 << 64) - 1]
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(12):
            f ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))})
            fps.append(f)
    fps = sorted(set(fps), key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    roots = {r["fp"]: r["root"] for r in simhash.link(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    least = least_reachable(fps)
    classes = {}
    for x, c in zip(signed, least):
        classes.setdefault(c, set()).add(roots[x])
    assert len(roots) == len(signed)
    assert all(len(v) == 1 for v in classes.values())
    assert len(set(roots.values())) == len(set(least))


def test_nulls_repeats_and_empty(spark):
    rows = [(5, None), (4, ""), (None, " \n"), (4, ""), (9, "one two three four five six"), (9, "one two three four five six"), (None, "one two three four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = sorted(map(tuple, simhash.classes(df).collect()), key=str)
    assert [g[2] for g in got if g[0] in (4, 5)] == [4, 4, 4]
    assert {g[1] for g in got if g[0] in (4, 5)} == {"0" * 16}
    assert len(got) == 7
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 4, 9]
    assert simhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
