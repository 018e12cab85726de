import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, lang=None):
    return [(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, repeats inside a text, empty, null and long ones."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice(["an", "er", "th", "ou", "é", "in", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [make(rng.randint(20, 120)) for _ in range(25)]
    passage = make(60)
    texts = base + [base[3], base[3], base[7]]
    for t in base[:6]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [t + "\n" + passage + "\n" + make(10) for t in base[8:12]]
    texts += [passage[5:], make(5) + passage[30:250] + make(9), "", None, "x", "a" * 350, "ab" * 200, base[1] + base[1], make(4000), "é" * 120, " \n\t "]
    return texts


@pytest.fixture()
def docs(spark, corpus):
    return spark.createDataFrame(rows(corpus), SCHEMA)


@pytest.fixture()
def short_plans(spark):
    """For queries of many small jobs: fewer tasks."""
    own = {"spark.sql.shuffle.partitions": "3"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
