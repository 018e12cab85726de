import heapq
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tickloom.llm import sharding

from .conftest import SCHEMA


def test_law(spark, docs, corpus):
    got = sharding.assign(docs.withColumn("shard", F.lit("x")).repartition(3), 4).collect()
    assert len(got) == len(corpus)
    place, slots, load = {}, defaultdict(list), Counter()
    for r in got:
        t = (corpus[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
        assert place.setdefault(t, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    groups = Counter()
    for t in corpus:
        groups[(t or "").encode()] += len((t or "").encode()) + 1
    best = [0] * 4  # longest processing time first over the groups themselves
    for size in sorted(groups.values(), reverse=True):
        heapq.heappush(best, heapq.heappop(best) + size)
    assert max(load.values()) <= max(best) * 1.01


def test_few_bundles_keep_groups_together(spark, docs, corpus):
    got = sharding.assign(docs, 4, bundles=3).collect()
    place = {}
    assert all(place.setdefault(corpus[r["doc_id"]] or "", r["shard"]) == r["shard"] for r in got)


def test_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "")], "doc_id long, text string")
    got = sharding.assign(df, 2).collect()
    assert sorted(r["slot"] for r in got if r["shard"] == got[0]["shard"])[0] == 0 and len(got) == 4
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).count() == 0


def test_schedule():
    assert sharding.schedule([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_placement_is_longest_first(spark):
    """Every row's shard, from a schedule by hand: the next largest group or bundle goes to the least-loaded shard."""
    import hashlib
    import random

    from pyspark.sql import functions as F

    rng = random.Random(7)
    texts = [rng.choice(["", None, "é" * 40]) if k % 9 == 0 else "x" * rng.randint(1, 400) + str(k % 50) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shards, bundles = 5, 13
    key = {t: hashlib.md5((t or "").encode()).hexdigest() for t in set(texts)}
    hashed = spark.createDataFrame([(v,) for v in set(key.values())], "k string").select("k", F.pmod(F.xxhash64("k"), F.lit(bundles)).alias("b")).collect()
    bundle = {r["k"]: f"b{r['b']}" for r in hashed}
    group = {}
    for t in texts:
        group[key[t]] = group.get(key[t], 0) + len((t or "").encode()) + 1
    heavy = {k for k, v in group.items() if v * shards * sharding.HEAVY_PARTS > sum(group.values())}
    loads, place, sizes = [0] * shards, {}, {}
    for k, v in group.items():
        name = k if k in heavy else bundle[k]
        sizes[name] = sizes.get(name, 0) + v
    for name in sorted(sizes, key=lambda n: (-sizes[n], n)):
        s = min(range(shards), key=lambda x: (loads[x], x))
        place[name] = s
        loads[s] += sizes[name]
    got = {r["doc_id"]: r["shard"] for r in sharding.assign(df, shards, bundles).collect()}
    assert got == {i: place[key[t] if key[t] in heavy else bundle[key[t]]] for i, t in enumerate(texts)}


def test_very_many_rows_alike_are_spread_over_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 50)
    monkeypatch.setattr(sharding, "REPEATED", 4)
    rows = [(1, "same")] * 900 + [(None, None)] * 700 + [(k, f"text {k}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.assign(df, 3).collect()
    assert len(got) == len(rows)
    for shard in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in got if r["doc_id"] == 1 and r["size"] == 5}) == 1
