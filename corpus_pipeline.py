"""A corpus, cleaned in five stages and tokenised. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, decontaminate, quality_rules, simhash, suffix_dedup
from tickloom.llm._common import materialise
from tickloom.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class (op3's law: 3 bits at most; see the README for its recall): the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings of 100 bytes and more that start earlier too."""
    return suffix_dedup.remove(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return bpe.digests(docs, bpe.read_vocabulary(spark, vocabulary_path()), ["doc_id"])


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: Suffix removal with its order of occurrences, and BPE merges, are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
