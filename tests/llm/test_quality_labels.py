"""The quality ranking learns from every label, however many there are."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.llm import pairwise_quality
from tickloom.llm.pairwise_quality import _nth


def test_every_label_counts(spark, short_plans):
    """A feature that only labels beyond the 20,000 first by hash show."""
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")).alias("nth"))
    late = F.col("nth") > 20_000
    own = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10**12)) / 1e12
    y = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) > 0
    x = F.array(own + F.when(y, 0.3).otherwise(0.0), F.when(late & y, 1.0).otherwise(0.0))
    features = docs.select("doc_id", x.alias("x"), y.cast("int").alias("quality"))
    ranking = pairwise_quality.learn_from(features.select("doc_id", "x"), features.select("doc_id", "quality"))
    assert ranking.weights[1] > 0.2
    got = features.toPandas()
    all_x = np.array(got["x"].tolist())
    assert ranking.mean == pytest.approx(all_x.mean(0)) and ranking.spread == pytest.approx(all_x.std(0), abs=2e-6)
    # the threshold is that of all labels
    assert (ranking.score(all_x) < 0.7).sum() == (got["quality"] == 0).sum()


def test_pairs_of_blocks_are_all_pairs():
    rng = np.random.default_rng(1)
    z, n, good, w = rng.normal(size=(20, 3)), rng.integers(1, 4, 20).astype(float), rng.random(20) < 0.6, rng.normal(size=3)
    weight, loss, gradient, curve = pairwise_quality._block_loss(z, n, good, w)
    told = [(z[i] - z[j], n[i] * n[j]) for i in np.flatnonzero(good) for j in np.flatnonzero(~good)]
    p = [1 / (1 + np.exp(d @ w)) for d, _ in told]
    assert weight == pytest.approx(sum(k for _, k in told))
    assert loss == pytest.approx(sum(k * np.log1p(np.exp(-d @ w)) for d, k in told))
    assert gradient == pytest.approx(-sum(k * q * d for (d, k), q in zip(told, p)))
    assert curve == pytest.approx(sum(k * q * (1 - q) * np.outer(d, d) for (d, k), q in zip(told, p)))


def test_nth_of_many_values(spark, short_plans, monkeypatch):
    monkeypatch.setattr(pairwise_quality, "PARTS", 7)
    values = np.random.default_rng(2).normal(size=300).round(1)
    raw = spark.createDataFrame([(float(v), 2) for v in values], "raw double, n long")
    every = np.sort(np.repeat(values, 2))
    assert [_nth(raw, k) for k in (0, 17, 333, 599)] == [every[k] for k in (0, 17, 333, 599)]
    one = spark.createDataFrame([(5.0, 3)] * 4, "raw double, n long")
    assert _nth(one, 11) == 5.0


def test_a_rare_class_meets_every_block(spark, short_plans):
    """Three bad rows among two thousand: each block has one of them at least."""
    rows = spark.range(2003).select(F.array(F.col("id").cast("double")).alias("x"), (F.col("id") >= 3).cast("int").alias("y"), F.lit(1).cast("long").alias("n"))
    blocks = pairwise_quality._blocks(rows, {0: 3, 1: 2000}).collect()
    assert len(blocks) == 8 and all(0 in b["y"] for b in blocks)
    assert sum(sum(b["y"]) for b in blocks) == 2000
