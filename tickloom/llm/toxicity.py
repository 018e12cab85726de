"""Toxicity by a linear classifier that is regularised by counterfactuals.

Features are the distinct words of a text, the first bytes of its words, and the starts that two different words share.
A counterfactual is a text in which a group's name is swapped for another of its kind; its features are found anew. A
labelled text that holds a name is swapped for every other name of the kind. Of one that holds none, a sentence is taken
and a name put into it, as a neutral mention: such a pair needs no label of its own. The loss adds the squared change of
the score's logit over all pairs, so that a name moves the score no more than its counterparts do.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, materialise, mix, prefix_hash, range_hash, slices, words

BITS = 24
PREFIXES = (4, 5, 6, 7, 8)

#: Identity terms that may stand for each other, by kind (fixed values; a parameter of learn()).
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


def _ids(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


# letters (A-Z lowered), digits and bytes above 127 stand; all else is white space, so that marks around a word don't hide it
_PLAIN = LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def found(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) pairs, repeats included: words, word starts, and starts of two different words."""
    low = _PLAIN[buf]
    s, e, doc = words(low, offs)
    p = prefix_hash(low)
    h = range_hash(p, s, e)
    docs, out = [doc], [_ids(h, 0)]
    for k in PREFIXES:
        long = e - s > k
        d, f, w = doc[long], _ids(range_hash(p, s[long], s[long] + k), k), h[long]
        order = np.lexsort((w, f, d))
        d, f, w = d[order], f[order], w[order]
        family = np.flatnonzero((d[1:] == d[:-1]) & (f[1:] == f[:-1]) & (w[1:] != w[:-1]))
        docs += [d, d[family]]
        out += [f, _ids(f[family].astype(np.uint64), k + 32)]
    return np.concatenate(docs), np.concatenate(out)


def word_features(word: str) -> set[int]:
    buf = np.frombuffer(word.encode(), np.uint8)
    return set(found(buf, np.array([0, len(buf)]))[1].tolist())


# a word as found() sees it, in UTF-8 bytes; and what ends a sentence
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SENTENCE = re.compile(rb"[^.!?\n]+")


def swapped(text: bytes, name: bytes, other: bytes) -> bytes:
    """text with every word `name` (A-Z lowered) made `other`."""
    return _WORD.sub(lambda m: other if m.group().lower() == name else m.group(), text)


def mention(text: bytes, name: bytes, number: int) -> bytes:
    """A sentence of text with `name` put before one of its words, or after the last; `number` chooses both."""
    sentences = [x for x in _SENTENCE.findall(text) if _WORD.search(x)] or [b""]
    sentence = sentences[number % len(sentences)]
    places = [*(m.start() for m in _WORD.finditer(sentence)), len(sentence)]
    at = places[number // 7 % len(places)]
    return sentence[:at] + b" " + name + b" " + sentence[at:]


def counterfactuals(text: bytes, identity: tuple[tuple[bytes, ...], ...]) -> list[tuple[bytes, bytes]]:
    """Pairs of texts that differ in one name: of each name that text holds, or of one put into it, and each other name."""
    have = {w.lower() for w in _WORD.findall(text)}
    held = [(text, w, kind) for kind in identity for w in kind if w in have]
    if not held and identity:
        number = zlib.crc32(text)
        kind = identity[number % len(identity)]
        name = kind[number // len(identity) % len(kind)]
        held = [(mention(text, name, number), name, kind)]
    return [(base, swapped(base, w, other)) for base, w, kind in held for other in kind if other != w]


@dataclass
class Model:
    ids: np.ndarray  # sorted feature numbers
    weights: np.ndarray
    bias: float
    twins: int = 0  # counterfactual pairs that it was taught with

    def __post_init__(self):
        self.known = np.zeros(1 << BITS, bool)
        self.known[self.ids] = True

    def __getstate__(self):
        return self.ids, self.weights, self.bias, self.twins

    def __setstate__(self, state):
        self.ids, self.weights, self.bias, self.twins = state
        self.__post_init__()

    def present(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, place in ids) of the known features, each once a text."""
        doc, f = found(buf, offs)
        hit = self.known[f]
        pair = np.unique(doc[hit] * np.int64(1 << BITS) + f[hit])
        return pair >> BITS, np.searchsorted(self.ids, pair & ((1 << BITS) - 1))

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        doc, at = self.present(buf, offs)
        z = self.bias + np.bincount(doc, self.weights[at], len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[list[int]], y: np.ndarray, twins: dict[tuple[tuple[int, ...], tuple[int, ...]], int], n: int, fairness: float = 1.0, penalty: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias: logistic loss + penalty / 2 * |w|^2 + fairness * mean squared change of the logit over twins.

    twins counts the pairs by (features lost, features gained). Full-batch gradient steps with per-weight scaling;
    features are places below n.
    """
    at = np.array([f for r in rows for f in r], np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pairs = sorted(twins.items())
    t_at = np.array([f for (a, b), _ in pairs for f in (*a, *b)], np.int64)
    t_of = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for (a, b), _ in pairs])
    t_sign = np.array([s for (a, b), _ in pairs for s in (*[-1.0] * len(a), *[1.0] * len(b))])
    share = np.array([c for _, c in pairs], float)
    share /= max(share.sum(), 1.0)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(n), float(np.log(rate / (1 - rate)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(of, w[at], len(rows))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.bincount(at, err[of], n) + penalty * w
        if pairs:
            change = np.bincount(t_of, t_sign * w[t_at], len(pairs))
            g += 2 * fairness * np.bincount(t_at, t_sign * (share * change)[t_of], n)
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w = w - 0.05 * (m / c) / (np.sqrt(v / d) + 1e-8)
        b = b - 0.05 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, b


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", identity: tuple[tuple[str, ...], ...] = IDENTITY, max_rows: int = 20_000, max_features: int = 3000, fairness: float = 1.0) -> Model | None:
    """A model from labelled documents: max_rows rows of labels at most, by hash order of doc_id; max_features features.

    Features are chosen by the size of their log odds against its standard error; those of identity terms always count.
    They are numbered by a 24-bit hash: two strings with the same number count as one feature (of a million different
    words and starts, about one in seventeen shares its number). Null labels and labels of unknown documents teach
    nothing. Rows that repeat teach again. None without both labels. The pairs that acted are counted in Model.twins.
    """
    few = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_rows)
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "_y", "text"), "toxic-sample")
    n = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None

    def count(batches):
        for part, buf, offs in slices(batches, "text"):
            doc, f = found(buf, offs)
            pair = np.unique(doc * np.int64(1 << BITS) + f)
            y = np.asarray(part.column(1).to_pylist(), np.int64)[pair >> BITS]
            f, at = np.unique(pair & ((1 << BITS) - 1), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.bincount(at, y == 1).astype(np.int64)), pa.array(np.bincount(at, y == 0).astype(np.int64))], names=["f", "pos", "neg"])

    odds = F.log((F.col("pos") + 0.5) / n[1]) - F.log((F.col("neg") + 0.5) / n[0])
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    counts = rows.mapInArrow(count, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = counts.where("pos + neg >= 3").withColumn("z", F.abs(odds / error)).where("z > 2").orderBy(F.desc("z"), "f").limit(max_features)
    names = {f for kind in identity for w in kind for f in word_features(w)}
    ids = np.array(sorted({r["f"] for r in best.select("f").collect()} | names), np.int64)
    blank = Model(ids, np.zeros(len(ids)), 0.0)
    kinds = tuple(tuple(w.lower().encode() for w in kind) for kind in identity)

    def select(batches):
        for part, buf, offs in slices(batches, "text"):
            doc, at = blank.present(buf, offs)
            cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
            own = [at[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
            pairs = [_changes(blank, counterfactuals(buf[a:b].tobytes(), kinds)) for a, b in zip(offs, offs[1:])]
            kind = pa.list_(pa.struct([("lost", pa.list_(pa.int64())), ("gained", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(own, pa.list_(pa.int64())), pa.array(pairs, kind)], names=["y", "own", "pairs"])

    got = rows.mapInArrow(select, "y int, own array<long>, pairs array<struct<lost: array<long>, gained: array<long>>>").collect()
    twins = Counter((tuple(p["lost"]), tuple(p["gained"])) for r in got for p in r["pairs"])
    own = sorted((r["y"], r["own"]) for r in got)
    w, b = fit([x for _, x in own], np.array([y for y, _ in own], float), twins, len(ids), fairness)
    return Model(ids, w, b, sum(twins.values()))


def _changes(model: Model, pairs: list[tuple[bytes, bytes]]) -> list[dict]:
    """What each pair's second text lacks of the known features of the first, and what it has beyond them."""
    texts = [t for pair in pairs for t in pair]
    if not texts:
        return []
    doc, at = model.present(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = [set(at[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]
    return [{"lost": sorted(a - b), "gained": sorted(b - a)} for a, b in zip(sets[::2], sets[1::2])]


def mention_gap(docs: DataFrame, model: Model, identity: tuple[tuple[str, ...], ...] = IDENTITY, at: float = 0.5) -> DataFrame:
    """One row on neutral mentions: n_mentions, gap and n_flagged.

    Into a sentence of each text of docs every name of every kind is put in turn. gap is the mean difference of the
    highest and the lowest score within a kind; n_flagged counts the sentences that score below `at` by themselves and
    `at` or more with the name. Null texts count as empty sentences; an empty table gives zero mentions and a null gap.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [[w.encode() for w in kind] for kind in identity]

    def run(batches):
        m = given.value
        for part, buf, offs in slices(batches, "text"):
            n, total, flagged = 0, 0.0, 0
            for a, b in zip(offs, offs[1:]):
                raw = buf[a:b].tobytes()
                number = zlib.crc32(raw)
                texts = [mention(raw, b"", number), *(mention(raw, w, number) for kind in kinds for w in kind)]
                s = m.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
                flagged += int((s[1:] >= at).sum()) if s[0] < at else 0
                place = 1
                for kind in kinds:
                    own = s[place : place + len(kind)]
                    total, n, place = total + float(own.max() - own.min()), n + 1, place + len(kind)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([flagged])], names=["n", "total", "flagged"])

    sums = docs.select("text").mapInArrow(run, "n long, total double, flagged long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_mentions"), F.sum("total").alias("_t"), F.coalesce(F.sum("flagged"), F.lit(0)).alias("n_flagged"))
    return sums.select("n_mentions", F.when(F.col("n_mentions") > 0, F.col("_t") / F.col("n_mentions")).alias("gap"), "n_flagged")


def score(docs: DataFrame, model: Model | None, keys: list[str]) -> DataFrame:
    """The columns `keys` and score (0 to 1) for every whole text; null counts as empty; without a model all are 0."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = given.value
        for rows, buf, offs in slices(batches, "_text"):
            s = m.score(buf, offs) if m else np.zeros(rows.num_rows)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], pa.array(s)], names=[*keys, "score"])

    return docs.select(*keys, docs["text"].alias("_text")).mapInArrow(run, docs.select(*keys).schema.add("score", "double"))
