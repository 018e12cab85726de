import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import suffix_dedup

from .conftest import SCHEMA, rows


def brute(items, length=100):
    """(id, n_bytes, n_removed, n_spans, sha) by a dictionary of all strings, in order of id and start."""
    seen, out = set(), []
    for i, text in items:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("part,block", [(suffix_dedup.PART, suffix_dedup.BLOCK), (2, 3), (1, 1)])
def test_against_all_strings(spark, docs, corpus, part, block):
    got = suffix_dedup.digests(docs.repartition(4), part=part, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(enumerate(corpus)))


@pytest.mark.parametrize("length,seed", [(40, 16), (12, 12), (33, 1)])
def test_other_lengths(spark, docs, corpus, length, seed):
    got = suffix_dedup.digests(docs, length, seed).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(enumerate(corpus)), length)


def test_repeated_and_null_ids(spark, corpus):
    t = corpus[0] + " " + corpus[1]
    data = [(1, t), (1, t), (1, corpus[1] + corpus[2]), (None, corpus[2] * 2), (None, corpus[2] * 2), (2, t), (3, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("_rank", F.lit(1))
    got = suffix_dedup.digests(df).collect()
    assert len(got) == 7
    assert sum(r["n_removed"] for r in got if r["doc_id"] == 2) == len(t.encode())
    ones = sorted(r["n_removed"] for r in got if r["doc_id"] == 1)
    assert ones[-1] == len(t.encode())  # one of the two alike rows goes whole
    assert [r["n_removed"] for r in got if r["doc_id"] == 3] == [0]


def test_empty_table(spark):
    assert suffix_dedup.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    assert suffix_dedup.remove(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_remove_keeps_characters_whole(spark, docs, corpus):
    extra = docs.withColumn("_id", F.lit("mine")).withColumn("h", F.lit(2))
    out = {r["doc_id"]: r for r in suffix_dedup.remove(extra).collect()}
    assert out[0].asDict().keys() == dict(zip(extra.columns, extra.columns)).keys()
    want = {r[0]: r for r in brute(list(enumerate(corpus)))}
    for i, t in enumerate(corpus):
        if t is None:
            assert out[i]["text"] is None
            continue
        left = len(out[i]["text"].encode())
        assert want[i][1] - want[i][2] <= left <= want[i][1] - want[i][2] + 6 * want[i][3]
        assert out[i]["n_chars"] == len(out[i]["text"])


def test_difference_cover():
    for v in (7, 32, 64):
        d = suffix_dedup.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))
        assert len(d) < v


def _random_block(seed):
    """Texts at random places of random documents, with shared passages, in buckets that hold texts with no common string too."""
    rng = random.Random(seed)
    shared = [bytes(rng.choice(b"abc") for _ in range(rng.randint(100, 130))) for _ in range(3)]
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 30))) + rng.choice([*shared, b"a" * 120]) + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(12)]
    bucket, doc, place = np.sort([rng.randrange(4) for _ in texts]), np.array([rng.randrange(9) for _ in texts]), np.array([1000 * i + rng.randrange(500) for i in range(len(texts))])
    return texts, bucket, doc, place


def _repeats(texts, bucket, doc, place, cover, v):
    begin = np.cumsum([0, *map(len, texts)])
    suffix, gone = suffix_dedup.repeats(np.frombuffer(b"".join(texts), np.uint8), begin, bucket, doc, place, 100, cover, v)
    return {(int(np.searchsorted(begin, s, "right")) - 1, int(s)) for s in suffix[gone]}


def _earlier_equal(texts, bucket, doc, place):
    begin, first, out = np.cumsum([0, *map(len, texts)]), {}, set()
    every = [(doc[i], place[i] + k, i, k) for i, t in enumerate(texts) for k in range(len(t) - 99)]
    for _, _, i, k in sorted(every):
        key = (bucket[i], texts[i][k : k + 100])
        if key in first:
            out.add((i, int(begin[i]) + k))
        first.setdefault(key, (i, k))
    return out


@pytest.mark.parametrize("v", [1, 7, 32, 64])
def test_block_against_a_dictionary(v):
    for seed in range(40):
        block = _random_block(seed)
        assert _repeats(*block, suffix_dedup.difference_cover(v), v) == _earlier_equal(*block)


def test_the_cover_is_needed():
    """Samples at one residue alone leave most pairs of places without a common offset: equal strings are missed."""
    found = wanted = 0
    for seed in range(20):
        block = _random_block(seed)
        less, all_ = _repeats(*block, [0], 32), _earlier_equal(*block)
        assert less <= all_
        found, wanted = found + len(less), wanted + len(all_)
    assert found < wanted / 2
