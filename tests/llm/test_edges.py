"""Very long texts, and null, repeated and clashing columns, for the operators whose own tests have none of them."""

import hashlib

from pyspark.sql import functions as F

from tickloom.llm import pairwise_quality, quality_rules, sharding, simhash, suffix_dedup, toxicity

LONG = "".join(f"word{k % 977} and {k} " for k in range(180_000))  # three megabytes, no string of 100 bytes twice


def test_text_longer_than_a_slice(spark):
    df = spark.createDataFrame([(1, LONG), (2, "short before " * 3), (3, LONG[1000:1300] + "!"), (4, None)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in suffix_dedup.digests(df).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_removed"] == 300 and got[3]["kept_sha256"] == hashlib.sha256(b"!").hexdigest()
    n = {r["doc_id"]: r for r in quality_rules.judge(df, ["doc_id"], ordered=list(quality_rules.RULES)).collect()}
    assert n[1]["n_words"] == 540_000 and n[1]["n_repeat_words"] == 0
    assert len({r["component_id"] for r in simhash.classes(df).collect()}) == 4
    placed = {r["doc_id"]: r for r in sharding.assign(df, 2).collect()}
    assert placed[1]["size"] == len(LONG) + 1 and placed[1]["shard"] != placed[2]["shard"]  # alone, as it outweighs the rest


def test_scores_with_repeats_and_clashing_columns(spark):
    good, bad = "plain words in a row here", "BAD!!! WORDS!!! HERE!!!"
    rows = [(k, good if k % 2 else bad) for k in range(40)] + [(1, good), (None, bad), (77, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("score", "x", "_y", "_text"):
        df = df.withColumn(c, F.lit("mine"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 1), (None, 0), (2, None)], "doc_id long, quality int").withColumn("toxic", 1 - F.col("quality"))
    for learn, score in ((pairwise_quality.learn, pairwise_quality.score), (toxicity.learn, toxicity.score)):
        got = score(df, learn(df.select("doc_id", "text"), labels), ["doc_id"]).collect()
        assert len(got) == 43 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
        assert all(0 <= r["score"] <= 1 for r in got)


def test_no_score_without_labels(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pairwise_quality.learn(df, none) is None and toxicity.learn(df, none) is None
