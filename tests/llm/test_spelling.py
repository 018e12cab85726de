"""Spelling variants against a plain version: words by one pattern, near words by their gaps."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import spelling

from .conftest import SCHEMA, rows

pytestmark = pytest.mark.usefixtures("short_plans")


def brute(docs, least_length=6, least=5, every=199, factor=5):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least}
    gaps, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= factor * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    """Few letters and many edits, so that most words have near ones, of all kinds and in chains."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abÀé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["colour", "color", "colours", "réseau", "reseau", "ABCDEF"]
    out = []
    for k in range(500):
        w = rng.choice(words)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abÀé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abÀéz") + w[i + 1 :]])
        out.append(" ".join([w] * rng.choice([1, 2, 5, 30])) + rng.choice(["", ", ", "1", "\n"]) + rng.choice(words))
    return out


@pytest.mark.parametrize("tile,every", [(spelling.TILE, 199), (7, 3)])
def test_against_plain_version(spark, texts, monkeypatch, tile, every):
    monkeypatch.setattr(spelling, "FLUSH", 40)
    df = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    monkeypatch.setattr(spelling.near, "__defaults__", (6, tile))
    want = brute(list(enumerate(texts)), every=every)
    assert len(want) > 100 and sum(1 for w in want if w[3]) > 10 and len({w[5] for w in want}) < len(want)
    assert sorted(map(tuple, spelling.variants(df, every=every).collect())) == want


def test_chain_of_forms(spark):
    words = ["aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb", "abbbbbb"]
    text = " ".join(" ".join([w] * 5 ** (k + 1)) for k, w in enumerate(words))
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert [got[w]["form"] for w in words] == [*words[1:], None]
    assert {got[w]["root"] for w in words} == {words[-1]} and [got[w]["n_near"] for w in words] == [1, 2, 2, 2, 2, 1]


def test_ties_go_to_the_first_word(spark):
    text = " ".join(["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcdefg"] * 25 + ["ébcdef"] * 25)
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), every=10**9).collect()}
    assert (got["abcdef"]["form"], got["abcdef"]["form_n"], got["abcdef"]["n_near"]) == ("abcdefg", 25, 3)
    assert got["abcdeg"]["n_near"] == 2 and got["ébcdef"]["root"] == "ébcdef"


def test_nulls_repeats_long_runs_and_clashing_columns(spark):
    long_ = "ab" * 3000
    data = [(None, "Wörter wörter WÖRTER"), (1, None), (2, ""), (3, long_), (3, long_), (4, f"{long_} {long_}c"), (5, f"{long_} {long_}"), (6, f"{long_}c " * 5)] + [(None, "Wörter wörter WÖRTER")] * 3
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    assert sorted(map(tuple, spelling.variants(df).collect())) == brute(data)
    assert spelling.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, factor=1)
