import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import langid, licenses, pairwise_quality, toxicity

from .conftest import SCHEMA, rows

SYLLABLES = {"en": ["the", "ing", "er", "th", "wh"], "fr": ["eau", "é", "tion", "le", "qu"], "de": ["ung", "ß", "sch", "ein", "ä"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    data = [(i, sentence(rng, lang, rng.randint(8, 200)), lang) for i, lang in enumerate(sorted(SYLLABLES) * 30)]
    return spark.createDataFrame([*data, (900, None, "en"), (901, "12 34 !", None), (902, "", "fr"), (None, "the thing", None), (0, data[0][1], data[0][2])], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))


def longest(text, at, sample):
    n = 0
    while at + n < len(text) and text[at : at + n + 1] in sample:
        n += 1
    return max(n, 1)


@pytest.mark.parametrize("block", [1, 3, 17, langid.BLOCK])
def test_phrases_by_search(monkeypatch, block):
    """The dense automata count the phrases that searching the sample for longest matches gives, wherever blocks are cut."""
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(4)
    samples = {k: sentence(rng, k, 80).encode() for k in SYLLABLES}
    parser = langid.Parser({k: langid._KEEP[np.frombuffer(v, np.uint8)].tobytes() for k, v in samples.items()})
    texts = [sentence(rng, rng.choice(sorted(SYLLABLES)), n).encode() for n in (1, 5, 300)] + [b"", b"zzz QQ!", samples["en"][:700] + b"zq" + samples["en"][100:900], samples["de"] * 2]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    got = parser.phrases(buf, offs)
    for i, t in enumerate(texts):
        plain = langid._KEEP[np.frombuffer(t, np.uint8)].tobytes()
        for j, lang in enumerate(parser.langs):
            sample = langid._KEEP[np.frombuffer(samples[lang], np.uint8)].tobytes()
            count = at = 0
            while at < len(plain):
                at += longest(plain, at, sample)
                count += 1
            assert got[i, j] == pytest.approx(count * np.log2(len(sample) + 1))


def test_prediction_by_hand(spark, languages):
    """Language and score of every text, from longest matches searched for in the samples."""
    sample = langid.learn(languages, bytes_per_language=2000)
    got = {r["doc_id"]: r for r in langid.identify(languages.where("doc_id between 1 and 40"), sample, ["doc_id", "text"]).collect()}
    for r in got.values():
        plain = langid._KEEP[np.frombuffer(r["text"].lower().encode(), np.uint8)].tobytes()
        cost = {}
        for k, v in sample.items():
            at = n = 0
            while at < len(plain):
                at += longest(plain, at, v)
                n += 1
            cost[k] = n * np.log2(len(v) + 1)
        first, second = sorted(cost, key=lambda k: (cost[k], k))[:2]
        assert r["lang_pred"] == first and r["score"] == pytest.approx(cost[second] / (cost[first] + cost[second]))


def test_rare_languages_are_learned(spark):
    df = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 20, f"l{i}") for i in range(130)], "doc_id long, text string, lang string")
    assert len(langid.learn(df)) == 130
    assert langid._shared([b"abc", b"d" * 50, b"e" * 50], 40) == b"abc " + b"d" * 17 + b" " + b"e" * 17


def test_other_labels_take_nothing_from_a_language(spark):
    texts = [(i, f"word{i % 7} and text{i % 11} " * 40, "en") for i in range(80)]
    junk = [(1000 + i, "xyz " * 50, f"junk{i}") for i in range(120)]
    alone = langid.learn(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    beside = langid.learn(spark.createDataFrame(texts + junk, "doc_id long, text string, lang string"))
    assert beside["en"] == alone["en"] and len(beside) == 121


def test_packed_automata():
    rng = random.Random(8)
    texts = {"ab": bytes(rng.choice(b"ab ") for _ in range(700)), "wide": "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)).encode(), "one": b"a", "none": b""}
    code, width = langid.alphabet(texts)
    for text in texts.values():
        go = langid.suffix_automaton(text)
        packed = langid.Packed.of(go, code, width)
        state, byte = (x.ravel() for x in np.meshgrid(np.arange(len(go) + 1), np.arange(256)))
        want = [go[s - 1].get(b, -1) + 1 if s else 0 for s, b in zip(state.tolist(), byte.tolist())]
        assert packed.step(state, code[byte]).tolist() == want
        assert not packed.step(np.arange(len(go) + 1), width - 1).any()  # padding
        assert packed.size() < 60 * len(text) + 64 * width


def test_language(spark, languages):
    sample = langid.learn(languages)
    assert set(sample) == set(SYLLABLES)
    small = langid.learn(languages, bytes_per_language=300)
    assert set(small) == set(SYLLABLES) and all(100 < len(v) <= 300 for v in small.values())
    got = langid.identify(languages, sample, ["doc_id", "lang"]).collect()
    assert len(got) == languages.count()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 900)
    odd = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] >= 900}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0 for k in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got)
    none = langid.identify(languages, {}, ["doc_id"]).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    assert langid.learn(languages.limit(0)) == {}
    assert langid.identify(languages.limit(0), sample, ["doc_id"]).count() == 0


def test_quality_ranking(spark):
    rng = random.Random(2)
    texts, marks = [], []
    for i in range(200):
        good = i % 4 > 0
        t = sentence(rng, "en", rng.randint(20, 80))
        texts.append(t if good else " ".join(w.upper() + "!!" for w in t.split()))
        marks.append((i, int(good)))
    docs = spark.createDataFrame([*rows(texts), (500, None, None, None, None), (501, "", None, None, 0)], SCHEMA)
    labels = spark.createDataFrame([*marks[:150], (1, None), (999, 1), (3, 1)], "doc_id long, quality int")
    model = pairwise_quality.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in pairwise_quality.score(docs, model, ["doc_id"]).collect()}
    assert len(got) == 202 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.7) == bool(y) for i, y in marks[150:])
    assert pairwise_quality.learn(docs, labels.where("quality = 1")) is None
    assert pairwise_quality.score(docs.limit(2), None, ["doc_id"]).select("score").distinct().collect()[0][0] == 0.5
    assert pairwise_quality.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_ranking_prefers_the_better():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    good = x[:, 0] - x[:, 1] > 0
    model = pairwise_quality.rank(x, good, pairs=5000)
    assert ((model.score(x) >= 0.7) == good).mean() > 0.97
    assert abs(model.weights[2]) < abs(model.weights[0]) / 4


def test_toxicity_and_counterfactuals(spark):
    rng = random.Random(3)
    texts, marks = [], []
    for i in range(400):
        bad = i % 3 == 0
        words = sentence(rng, "en", 30).split()
        if bad:
            words[5:5] = [rng.choice(["idiot", "moron", "vequ" + rng.choice("abcdef")])]
        if bad and i % 2 or i % 20 == 1:
            words.insert(9, "muslims")  # the name comes mostly with bad texts
        texts.append(" ".join(words))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame([*rows(texts), (900, None, None, None, None), (901, "", None, None, 0), (902, "vequz the thing", None, None, 0), (903, "all muslims and christians", None, None, 0)], SCHEMA)
    labels = spark.createDataFrame([*marks[:300], (2, None)], "doc_id long, toxic int")
    fair = toxicity.learn(docs, labels, fairness=5.0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, fair, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in marks[300:])
    assert got[902] >= 0.5 and got[900] < 0.5 and got[901] < 0.5 and got[903] < 0.5

    def move(model):
        """How far the name alone moves the score's logit, against its counterpart."""
        at = lambda w: model.weights[np.searchsorted(model.ids, sorted(toxicity.word_features(w)))].sum()
        return abs(at("muslims") - at("christians"))

    assert move(fair) < move(toxicity.learn(docs, labels, fairness=0.0)) / 2
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
    assert toxicity.score(docs.limit(3), None, ["doc_id"]).select("score").distinct().collect()[0][0] == 0.0
    assert toxicity.score(docs.limit(0), fair, ["doc_id"]).count() == 0


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"]
    texts = ["some text\nReleased under the MIT License.\nmore text", "RELEASED under the MIT  licence.", mit.replace(",", "\n", 2) + " extra", "x" * 50, "", None, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "license", "the the the the"]

    def brute(t):
        out = {}
        parts = [p for p in (t or "").split("\n")] + ([t] if t and "\n" in t else [])
        for p in parts:
            own = licenses.bigrams(p.encode())
            dice = {k: 2 * len(own & b) / (len(own) + len(b)) for k, x in licenses.TEMPLATES.items() if (b := licenses.bigrams(x.encode()))}
            top = max(dice.values(), default=0)
            if top >= licenses.THRESHOLD:
                for k, v in dice.items():
                    if v == top:
                        out.setdefault(k, []).append(v)
        return {(k, round(max(v), 9), len(v)) for k, v in out.items()}

    df = spark.createDataFrame(rows(texts), SCHEMA).withColumn("dice", F.lit(1))
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r["doc_id"], set()).add((r["license_id"], round(r["dice"], 9), r["n_parts"]))
    assert got == {i: b for i, t in enumerate(texts) if (b := brute(t))}
    assert got[2] and got[0]
    assert licenses.scan(df.limit(0)).count() == 0


def test_ranking_minimises_the_pairs_loss():
    """The weights are where the stated loss, written out pair by pair, rises in every direction."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    good = x[:, 0] + rng.normal(size=60) > 0
    model = pairwise_quality.rank(x, good, pairs=400, penalty=0.05, seed=5)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -6, 6)
    draw = np.random.default_rng(5)
    pairs = list(zip(draw.choice(np.flatnonzero(good), 400), draw.choice(np.flatnonzero(~good), 400)))

    def loss(w):
        return sum(np.log1p(np.exp(-(z[a] - z[b]) @ w)) for a, b in pairs) / len(pairs) + 0.05 * w @ w / 2

    assert all(loss(model.weights + s * d) > loss(model.weights) for d in np.eye(3) for s in (-0.5, -0.01, 0.01, 0.5))
    # as many of the sample lie below the threshold as there are bad labels
    assert (model.score(x) < 0.7).sum() == (~good).sum()
