"""The numbers behind the scores, against plain versions; and texts longer than a slice for the operators that score them."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import langid, licenses, pairwise_quality, toxicity
from tickloom.llm._common import prefix_hash, range_hash

ODD = ["", "x", "One two, one two! THREE", "a\n\nb\r\n c\t\x0bd", "Straße straßen STRASSE été", "12 34 12 34 12 34 !!! ??? |||", "\x00\x01 \x7f", "word " * 300, "The cat. The cat. The cat sat", "日本 日本 語"]


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def plain_features(text):
    raw = text.encode()
    rate = lambda chars: sum(b in chars for b in raw) / (len(raw) + 1)
    out = [rate(c.encode("latin-1")) for c in pairwise_quality.CLASSES] + [rate(bytes(range(128, 256)))]
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    some = max(len(words), 1)
    letters = [len(re.findall(rb"[A-Za-z\x80-\xff]", w)) for w in words]
    out.append(sum(n == 0 for n in letters) / some)
    out.append(sum(2 * n < len(w) for n, w in zip(letters, words)) / some)
    out.append(sum(w[:1].isupper() and w[0] < 128 for w in words) / some)
    low = [w.lower() for w in words]
    for k in (1, 2, 4):
        grams = Counter(tuple(low[i : i + k]) for i in range(len(low) - k + 1))
        out.append(sum(n - 1 for n in grams.values()) / some)
    length = sum(map(len, words)) / some
    return [math.log1p(50 * x) for x in out] + [math.log1p(len(words)), min(len(words), 10) / 10, math.log1p(length), min(length, 12)]


def test_quality_features(corpus):
    texts = [t or "" for t in corpus] + ODD
    got = pairwise_quality.features(*joined(texts))
    assert got.shape[0] == len(texts)
    for row, text in zip(got, texts):
        assert row.tolist() == pytest.approx(plain_features(text), abs=1e-9)


def number(data, kind):
    buf = np.frombuffer(data, np.uint8)
    return int(toxicity._ids(range_hash(prefix_hash(buf), np.array([0]), np.array([len(buf)])), kind)[0])


def plain_found(text):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())
    words = [w.lower() for w in words]
    out = Counter(number(w, 0) for w in words)
    for k in toxicity.PREFIXES:
        families = {}
        for w in words:
            if len(w) > k:
                out[number(w[:k], k)] += 1
                families.setdefault(w[:k], set()).add(w)
        for start, members in families.items():
            if len(members) > 1:
                own = int(toxicity._ids(np.array([number(start, k)], np.uint64), k + 32)[0])
                out[own] += len(members) - 1
    return out


def test_toxicity_features(corpus):
    texts = [(t or "")[:3000] for t in corpus] + ODD + ["idiot idiots idiotic moron", "prefixed prefixes prefix"]
    doc, f = toxicity.found(*joined(texts))
    for i, text in enumerate(texts):
        assert Counter(f[doc == i].tolist()) == plain_found(text)


LONG = "".join(f"word{k % 977} and {k} " for k in range(260_000))  # over four megabytes


def test_texts_longer_than_a_slice(spark):
    assert len(LONG) > 4 << 20
    notice = licenses.TEMPLATES["mit-line"]
    rows = [(1, LONG + "idiot\n" + notice), (2, "short text"), (3, None), (4, LONG[:100])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    sample = {"en": b"word and the of words ", "xx": b"zq qz zzq qqz "}
    lang = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, sample, ["doc_id"]).collect()}
    assert lang == {1: "en", 2: "en", 3: "und", 4: "en"}
    parser = langid.Parser(sample)
    plain = langid._KEEP[np.frombuffer(LONG[:300_000].encode(), np.uint8)].tobytes()
    at = n = 0
    while at < len(plain):
        size = 0
        while at + size < len(plain) and plain[at : at + size + 1] in sample["en"]:
            size += 1
        at, n = at + max(size, 1), n + 1
    got = parser.phrases(np.frombuffer(LONG[:300_000].encode(), np.uint8), np.array([0, 300_000]))
    assert got[0, 0] == pytest.approx(n * parser.bits[0])

    assert [(r["doc_id"], r["license_id"], r["dice"]) for r in licenses.scan(df).collect()] == [(1, "mit-line", 1.0)]

    rng = random.Random(1)
    few = [(k, " ".join(rng.choice(["fine", "plain", "words"]) for _ in range(12)) + (" idiot" if k % 2 else "")) for k in range(60)]
    docs = spark.createDataFrame(few, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(60)], "doc_id long, toxic int, quality int")
    model = toxicity.learn(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, model, ["doc_id"]).collect()}
    for i, text in rows:
        if i != 3:
            doc, at = model.present(*joined([text]))
            assert scores[i] == pytest.approx(1 / (1 + math.exp(-model.bias - model.weights[at].sum())))
    ranking = pairwise_quality.learn(docs, labels)
    quality = {r["doc_id"]: r["score"] for r in pairwise_quality.score(df, ranking, ["doc_id"]).collect()}
    assert quality[1] == pytest.approx(float(ranking.score(np.array([plain_features(rows[0][1])]))[0]))


def test_clashing_columns_of_the_licence_scan(spark):
    df = spark.createDataFrame([(1, licenses.TEMPLATES["mit-line"], "a", 5)], "doc_id long, text string, license_id string, dice int")
    assert [(r["doc_id"], r["license_id"], r["n_parts"]) for r in licenses.scan(df).collect()] == [(1, "mit-line", 1)]
