"""Token counts against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import bpe, token_counts

from .conftest import SCHEMA, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(None, PATH)


def counted(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def odd():
    rng = random.Random(3)
    out = ["aaaa" * k for k in range(30)] + [" " * k + "x" for k in range(12)] + ["!?" * k for k in range(9)] + ["<|endoftext|>", "a<|endoftext|>b<|endoftext|><|endoftext|>", "<|endoftext", "日本語" * 50, "\r\n\t \n", "don't we'll I'VE", "é" * 300]
    return out + ["".join(rng.choice("abcdeé 1!\n中'") for _ in range(rng.randint(0, 200))) for _ in range(400)]


def test_against_library(spark, corpus, vocabulary):
    texts = corpus + odd()
    df = spark.createDataFrame(rows(texts), SCHEMA).withColumn("n_tokens", F.lit("mine")).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count(df, vocabulary, ["doc_id"]).collect()}
    want = counted([t or "" for t in texts])
    assert got == {i: (len((t or "").encode()), n, n > 512) for i, (t, n) in enumerate(zip(texts, want))}
    assert token_counts.count(df.limit(0), vocabulary, ["doc_id"]).count() == 0


@pytest.mark.parametrize("long,batch,cached", [(3, 1 << 20, 1 << 20), (10**9, 10, 500), (1024, 1, 0)])
def test_bounds_change_nothing(vocabulary, corpus, monkeypatch, long, batch, cached):
    for name, value in (("LONG", long), ("BATCH", batch), ("CACHED", cached)):
        monkeypatch.setattr(token_counts, name, value)
    merger = token_counts.Merger(bpe.Codec(vocabulary))
    texts = [t or "" for t in corpus] + odd()[:120]
    got = []
    for k in range(0, len(texts), 10):
        got += merger.tokens(texts[k : k + 10])
    assert got == counted(texts)


def test_every_piece_merges_as_the_queue_does(vocabulary):
    rng = random.Random(9)
    codec = bpe.Codec(vocabulary)
    pieces = ["".join(rng.choice("theraniosx ") for _ in range(rng.randint(1, 60))).encode() for _ in range(500)] + [b"a" * k for k in range(1, 70)]
    assert token_counts.Merger(codec).counts(pieces).tolist() == [len(codec.merged(p)) for p in pieces]


def test_very_long_texts_and_repeats(spark, vocabulary):
    words = "".join(f"word{k % 977} and {k} " for k in range(100_000))
    data = [(1, words), (1, words), (None, "ab" * 100_000), (2, None)]
    got = [(r["doc_id"], r["n_tokens"]) for r in token_counts.count(spark.createDataFrame(data, "doc_id long, text string"), vocabulary, ["doc_id"], limit=3).collect()]
    assert got == [(i, n) for (i, _), n in zip(data, counted([t or "" for _, t in data]))]


def test_merges_out_of_order_are_refused(vocabulary):
    codec = bpe.Codec(vocabulary)
    (a, b), (rank, new) = next(iter(codec.merge.items()))
    codec.merge[(new, new)] = (rank - 1, max(codec.bytes) - 1)
    with pytest.raises(ValueError):
        token_counts.Merger(codec)
    codec.merge = {}
    assert token_counts.Merger(codec).counts([b"abc", b"d"]).tolist() == [3, 1]
    assert np.array_equal(token_counts.Merger(codec).counts([]), [])
