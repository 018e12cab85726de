"""The pipeline, and the registered queries, against brute force on a small corpus."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

from .conftest import SCHEMA, rows
from .test_bpe import sha
from .test_decontaminate import brute as leaks
from .test_quality_rules import brute as judged
from .test_simhash import fingerprint, least_reachable


def without_repeats(items, length=100):
    """Texts in order of id without the bytes that an earlier equal string covers; cut characters stay whole."""
    seen, out = set(), []
    for i, text in items:
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept, at = [], 0
        for c in text:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((i, "".join(kept)))
    return out


def make(spark, tmp_path, corpus):
    rng = random.Random(9)
    words = [t for t in corpus if t and 40 < len(t.split()) < 200]
    extra = ["SHOUT!! " * 20, "a | b | " * 20] + [" ".join(rng.sample(t.split(), 30)) for t in words[:6]]
    texts = corpus + extra
    item = " ".join(extra[3].split()[4:22])
    spark.createDataFrame(rows(texts), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "not in any text at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts, [(1, item), (2, "not in any text at all here")]


def test_run(spark, tmp_path, corpus):
    texts, items = make(spark, tmp_path, corpus)
    kept = [(i, t) for i, t in enumerate(texts) if judged(t)[-1]]
    roots = least_reachable([fingerprint(t) for _, t in kept])
    kept = [x for k, x in enumerate(kept) if roots[k] == k]
    kept = without_repeats(kept)
    bad = {x[0] for x in leaks([t for _, t in kept], items)}
    assert bad
    kept = [x for k, x in enumerate(kept) if k not in bad]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in kept:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


def test_stages_keep_columns_and_take_anything(spark, tmp_path, corpus):
    make(spark, tmp_path, corpus)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "word " * 3000, None, "s", None), (3, "a b c d e f g h i j k l m n o", "xx", "s", 5)], SCHEMA)
    for docs in (odd, odd.limit(0), odd.withColumn("score", F.lit(1)).withColumn("_id", F.lit("x"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "bpe":
                assert out.columns == docs.columns
            assert out.count() <= docs.count()
