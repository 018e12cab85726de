import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, " ", "Hello  world!\n\n it's 12,345 tests'll", "naïve Ünïcode — 日本語 🙂🙃", "<|endoftext|>a<|endoftext|><|endoftext|> b", "a" * 5000, "the" * 3000 + "<|endof", "\x00\x01 tab\t\t\r\n\x0b x", "don't DON'T 's ' s", " " * 300 + "x" + "\n" * 50, "ab cd　ef  g", "é" * 700]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.read_vocabulary(spark, PATH)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_as_the_library(spark, vocabulary, corpus):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    texts = TEXTS + corpus
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r[0]: tuple(r)[1:] for r in bpe.digests(df, vocabulary, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))), text
    coded = bpe.encode(df, vocabulary, ["doc_id"])
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(coded, vocabulary, ["doc_id"]).collect()} == {i: x or "" for i, x in enumerate(texts)}


def test_empty_and_repeats(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert bpe.digests(df, vocabulary, ["doc_id"]).count() == 3
    assert bpe.digests(df.limit(0), vocabulary, ["doc_id"]).count() == 0


def test_other_kinds_of_files_are_refused():
    import json

    whole = json.load(open(PATH, encoding="utf-8"))
    bpe._check(whole)
    for part, key, value in (("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "type", "Whitespace"), ("model", "end_of_word_suffix", "</w>"), ("model", "byte_fallback", True), ("decoder", "type", "WordPiece")):
        with pytest.raises(ValueError, match=part):
            bpe._check(whole | {part: whole[part] | {key: value}})
    with pytest.raises(ValueError, match="normalizer"):
        bpe._check(whole | {"normalizer": {"type": "NFC"}})
    with pytest.raises(ValueError, match="added_tokens"):
        bpe._check(whole | {"added_tokens": [whole["added_tokens"][0] | {"lstrip": True}]})


def test_cache_is_bounded_by_bytes(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 20_000)
    codec = bpe.Codec(vocabulary)
    for k in range(400):
        codec.both_ways(f"word{k} and {'x' * (k % 50 * 40)}")
        assert codec.held <= 20_000 and sum(len(p) + len(g[1]) + len(g[2]) for p, g in codec.known.items()) <= codec.held


def test_very_long_text(spark, vocabulary):
    text = "It is a long text, " * 150_000
    t = Tokenizer.from_file(PATH)
    r = bpe.digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), vocabulary, ["doc_id"]).first()
    ids = t.encode(text, add_special_tokens=False).ids
    assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(text))
