"""Counterfactuals of the toxicity model: a name is swapped for every other name of its kind."""

import random

import numpy as np

from tickloom.llm import toxicity

from .conftest import SCHEMA, rows


def test_name_moves_little_against_every_other(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    texts = [" ".join([*rng.sample(vocab, 15), *(["idiot"] if i % 3 == 0 else []), *(["muslims"] if i % 3 == 0 and i % 2 or i % 20 == 1 else [])]) for i in range(240)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")

    def moves(model):
        at = {w: model.weights[np.searchsorted(model.ids, sorted(toxicity.word_features(w)))].sum() for w in toxicity.IDENTITY[4]}
        return [abs(at["muslims"] - at[w]) for w in toxicity.IDENTITY[4] if w != "muslims"]

    fair, free = moves(toxicity.learn(docs, labels, fairness=20.0)), moves(toxicity.learn(docs, labels, fairness=0.0))
    assert len(fair) == 5 and all(a < b / 5 for a, b in zip(fair, free))


def test_texts_without_a_name_make_pairs(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    # words that start as a name does come with bad texts, so that without the pairs the name inherits their weight
    texts = [" ".join([*rng.sample(vocab, 12), *([rng.choice(["idiot", "musl" + rng.choice("abcd")])] if i % 3 == 0 else [])]) + ". " for i in range(240)]
    docs = spark.createDataFrame([*rows(texts), (500, None, None, None, 0), (501, "", None, None, 0)], SCHEMA)
    labels = spark.createDataFrame([*[(i, int(i % 3 == 0)) for i in range(200)], (500, 0), (501, 0)], "doc_id long, toxic int")
    free, fair = (toxicity.learn(docs, labels, fairness=f) for f in (0.0, 5.0))
    assert free.twins == fair.twins > 200 and not np.allclose(free.weights, fair.weights)
    clean = docs.where("doc_id >= 200 and doc_id % 3 <> 0")
    gaps = [toxicity.mention_gap(clean, m).first() for m in (free, fair)]
    assert gaps[0]["n_mentions"] == gaps[1]["n_mentions"] == clean.count() * len(toxicity.IDENTITY)
    assert gaps[1]["gap"] < gaps[0]["gap"] / 3 and gaps[1]["n_flagged"] <= gaps[0]["n_flagged"]
    assert toxicity.mention_gap(docs.limit(0), fair).first().asDict() == {"n_mentions": 0, "gap": None, "n_flagged": 0}


def test_pairs_are_texts_with_one_name_changed():
    kinds = ((b"gay", b"straight", b"lesbian"), (b"men", b"women"))
    pairs = toxicity.counterfactuals("GAY men, gay!".encode(), kinds)
    assert [b for _, b in pairs] == [b"straight men, straight!", b"lesbian men, lesbian!", b"GAY women, gay!"]
    for text in (b"", b"One word here. Another sentence!", "schön ist es".encode()):
        for base, other in toxicity.counterfactuals(text, kinds):
            changed = [(x, y) for x, y in zip(base.split(), other.split()) if x != y]
            assert len(changed) == 1 and any(set(changed[0]) <= set(kind) for kind in kinds)
    assert toxicity.counterfactuals(b"text", ()) == []


def test_weights_minimise_the_stated_loss():
    rng = np.random.default_rng(4)
    rows_ = [sorted(rng.choice(6, rng.integers(1, 5), replace=False).tolist()) for _ in range(60)]
    y = np.array([float(0 in r) if rng.random() < 0.9 else 1.0 for r in rows_])
    twins = {((0,), (1, 2)): 3, ((), (3,)): 1}

    def loss(w, b):
        z = np.array([b + sum(w[f] for f in r) for r in rows_])
        plain = np.mean([np.log1p(np.exp(-v if t else v)) for v, t in zip(z, y)])
        moved = [(sum(w[f] for f in gained) - sum(w[f] for f in lost)) ** 2 for (lost, gained), c in twins.items() for _ in range(c)]
        return plain + 0.005 * sum(w * w) + 2.0 * np.mean(moved)

    w, b = toxicity.fit(rows_, y, twins, 6, fairness=2.0, penalty=0.01, steps=3000)
    for k in range(7):  # no weight can be moved to a loss that is smaller by more than the last step's wobble
        d = np.eye(7)[k]
        assert all(loss(w + x * d[:6], b + x * d[6]) > loss(w, b) - 1e-3 for x in (-1, -0.3, -0.1, 0.1, 0.3, 1))
    free, _ = toxicity.fit(rows_, y, {}, 6, fairness=2.0, penalty=0.01)
    assert abs(w[0] - w[1] - w[2]) < abs(free[0] - free[1] - free[2]) / 2


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "fine words here"), (1, "fine words here"), (None, "idiot"), (2, None)], "doc_id long, text string").withColumn("score", docs_score()).withColumn("_text", docs_score())
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labels), ["doc_id"]).collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def docs_score():
    from pyspark.sql import functions as F

    return F.lit("mine")
