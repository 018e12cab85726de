"""The trie of prefixes against sequences held in a dictionary."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import prefix_trie

pytestmark = pytest.mark.usefixtures("short_plans")
SCHEMA = "conv_id long, turn long, role string, text string"


def turn_id(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16] + len(text.encode()).to_bytes(4, "big")


def brute(rows, family=5, most=9):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, turn_id(r, x), r, x))
    for turns in convs.values():
        turns.sort()
    paths = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        base = convs.get(c - (c % family if c >= 0 else -(-c % family)), [])
        paths[c] = tuple(t[3:] for t in [*base[:h], *turns[h:]])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            if p:
                saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode())
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def nodes(df):
    return sorted(map(tuple, prefix_trie.prefixes(df).collect()), key=lambda r: r[:2])


def made(rng, n, turns, kinds=2, most=12):
    """Conversations of few different turns, so that prefixes are shared deep down."""
    return [(c, k, rng.choice(["user", None]), rng.choice(["é", "long text", "", None][:kinds])) for c in rng.sample(range(-60, 3000), n) for k in range(rng.randint(1, turns))]


@pytest.mark.parametrize("turns,kinds", [(9, 1), (30, 3)])
def test_against_dictionary(spark, turns, kinds):
    rng = random.Random(turns + kinds)
    rows = made(rng, 120, turns, kinds)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert nodes(df) == brute(rows)


def test_long_conversations_go_on_in_further_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_RUN", 3)  # so that keys are summed up over several runs of blocks
    rng = random.Random(4)
    stem = [("user", f"turn {k}") for k in range(150)]
    rows = []
    for c, cut in ((0, 150), (10, 150), (20, 149), (30, 64), (40, 8), (50, 9), (60, 7), (70, 65)):
        rows += [(c, k, *stem[k]) for k in range(cut)] + [(c, 1000 + k, "user", f"own {c % 3}") for k in range(rng.randint(0, 20))]
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_one_conversation_and_one_node_hold_most(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)  # ids of a node come in many strings
    rows = [(5, k, "user", f"t{k % 7}") for k in range(250)] + [(5 * c, 0, "user", "same") for c in range(3, 300)] + [(10**12 + 5, 0, "user", "same")]
    assert nodes(spark.createDataFrame(rows, SCHEMA).repartition(9)) == brute(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(0, None, "user", "first"), (0, 1, None, None), (0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (None, 3, "user", "x"), (5, 0, "", ""), (7, 2, "a", "bc"), (11, 2, "ab", "c"), (12, None, None, None), (13, 1, None, "z" * 5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("depth", "place", "n_convs", "_range"):
        df = df.withColumn(c, F.lit("mine"))
    assert nodes(df) == brute(rows)
    assert prefix_trie.prefixes(df.limit(0)).count() == 0
    assert prefix_trie.prefixes(df.where("conv_id is null")).count() == 0


def test_conversations_without_turns_are_members_of_the_root(spark):
    lost = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:6]
    rows = [(c, 0, "user", "gone") for c in lost]  # their base is absent, and they take no turn of their own
    got = nodes(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert got == [(min(lost), 0, None, len(lost), 0, 1, 0, hashlib.sha256(",".join(map(str, sorted(lost))).encode()).hexdigest())]
