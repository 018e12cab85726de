import random

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import decontaminate as d

from .conftest import SCHEMA, rows


def grams(text, n):
    w = text.encode().lower().split()
    n = min(n, len(w))
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(texts, items):
    out = []
    for i, t in enumerate(texts):
        for item, x in items:
            want = grams(x or "", 5)
            n = min(5, len((x or "").split()))
            w = (t or "").encode().lower().split()
            have = {b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            shared = len(want & have)
            if want and shared >= -(-8 * len(want) // 10):
                out.append((i, item, len(want), shared))
    return sorted(out)


def test_against_all_pairs(spark, corpus, monkeypatch):
    rng = random.Random(2)
    items = []
    for k, t in enumerate([x for x in corpus if x and len(x.split()) > 30][:20]):
        w = t.split()
        a = rng.randrange(len(w) - 25)
        part = w[a : a + rng.randint(5, 25)]
        if k % 3 == 0:
            part[rng.randrange(len(part))] = "other"
        items.append((k, " ".join(part).encode().upper().decode()))  # A-Z only
    items += [(100, "x"), (101, corpus[0].split()[0] + " " + corpus[0].split()[1]), (102, ""), (103, None), (0, items[0][1]), (104, "never there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    df = spark.createDataFrame(rows(corpus), SCHEMA).withColumn("item_id", F.lit("x"))
    want = brute(corpus, sorted(set(items), key=str))
    assert len(want) > 10
    assert sorted(tuple(r)[:4] for r in d.contained(df, bench).collect()) == want
    left = {r["doc_id"] for r in d.clean(df, bench).collect()}
    assert left == set(range(len(corpus))) - {w[0] for w in want}
    monkeypatch.setattr(d, "LISTED", 3)  # too many ids to broadcast
    assert {r["doc_id"] for r in d.clean(df, bench).collect()} == left
    monkeypatch.setattr(d, "_bloom", lambda *_: (np.full(1 << 10, 2**64 - 1, np.uint64), 16))  # a filter that stops nothing
    assert sorted(tuple(r)[:4] for r in d.contained(df, bench).collect()) == want


def test_several_filters(spark, docs, corpus, monkeypatch):
    items = [(k, " ".join((t or "").split()[3:23])) for k, t in enumerate(corpus)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, d.contained(docs, bench).collect()))
    assert len(want) > 10
    made = []
    one = d._bloom
    monkeypatch.setattr(d, "_bloom", lambda signatures, many: made.append(many) or one(signatures, many))
    monkeypatch.setattr(d, "BITS", 11)  # 2,048 bits, and 128 signatures for each filter
    monkeypatch.setattr(d, "KNOWN", 3)
    assert sorted(map(tuple, d.contained(docs, bench).collect())) == want
    assert len(made) > 2


def test_filter_passes_all_it_holds():
    h = np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64)
    bloom = np.zeros(1 << 14, np.uint64)
    for at in d._spots(h[:1000], 5, 20):
        np.bitwise_or.at(bloom, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    passed = d._maybe(bloom, 20, h, 5)
    assert set(range(1000)) <= set(passed) and len(passed) < 1010


def test_no_signature_is_too_short():
    """Of any size, an item's signature is longer than the shingles that a text at the threshold can lack."""
    for size in [*range(1, 140), 500, 1000]:
        text = " ".join(f"w{k}" for k in range(size + 4 if size > 1 else 3)).encode()
        _, own, h = d._signature(text, 0.8)
        assert own == size and len(h) >= min(size, size - d.need(size, 0.8) + 1)


def test_null_ids_and_very_long_text(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    long_ = "filler words go on " * 200_000 + passage
    df = spark.createDataFrame([(None, passage), (1, long_), (1, long_[:50]), (2, passage[:40])], "doc_id long, text string")
    got = d.contained(df, spark.createDataFrame([(None, passage), (5, passage + " more")], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in got) == [(0, 0), (0, 5), (1, 0), (1, 5)]


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contained(docs, none).count() == 0
    assert d.clean(docs, none).count() == docs.count()
    assert d.contained(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
