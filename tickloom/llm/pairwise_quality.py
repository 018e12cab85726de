"""Quality by Bradley-Terry ranking: a document's strength is linear in its features, and the odds that a good document
beats a bad one are logistic in the difference. Pairs of all labelled documents teach the weights; a quantile of their
scores sets the threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ._common import LOWER, discard, materialise, ngrams, prefix_hash, range_hash, slices, words

CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\n", "!", "?", ".", ",", ";:", "|", "#*$%&<>", "()[]{}", "'\"`", "@/\\_~^=+-", "\x00\x01\x02\x03\x04\x05\x06\x07\x7f")
AT = 0.7  # the score that stands for the threshold


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of numbers for each text: rates of byte classes, and the shapes and repeats of words and lines."""
    n = len(offs) - 1
    size = np.diff(offs) + 1.0
    cols = []
    for chars in CLASSES:
        table = np.zeros(256, np.uint8)
        table[np.frombuffer(chars.encode("latin-1"), np.uint8)] = 1
        total = np.concatenate([[0], np.cumsum(table[buf], dtype=np.int32)])
        cols.append((total[offs[1:]] - total[offs[:-1]]) / size)
    total = np.concatenate([[0], np.cumsum(buf > 127, dtype=np.int32)])
    cols.append((total[offs[1:]] - total[offs[:-1]]) / size)
    low = LOWER[buf]
    s, e, doc = words(low, offs)
    m = np.bincount(doc, minlength=n)
    some = np.maximum(m, 1)
    h = range_hash(prefix_hash(low), s, e)
    letter = np.zeros(256, np.uint8)
    letter[65:91] = letter[97:123] = letter[128:] = 1
    total = np.concatenate([[0], np.cumsum(letter[buf], dtype=np.int32)])
    letters = total[e] - total[s]
    capital = (buf[s] >= 65) & (buf[s] <= 90) if len(s) else np.zeros(0, bool)
    cols.append(np.bincount(doc, letters == 0, n) / some)
    cols.append(np.bincount(doc, 2 * letters < e - s, n) / some)
    cols.append(np.bincount(doc, capital, n) / some)
    for k in (1, 2, 4):
        grams, at = ngrams(h, doc, k)
        of = doc[at]
        order = np.lexsort((grams, of))
        again = np.zeros(len(order), bool)
        again[1:] = (grams[order][1:] == grams[order][:-1]) & (of[order][1:] == of[order][:-1])
        cols.append(np.bincount(of[order], again, n) / some)
    rates = np.log1p(50 * np.column_stack(cols)) if n else np.zeros((0, len(cols)))
    length = np.bincount(doc, (e - s).astype(float), n) / some
    return np.column_stack([rates, np.log1p(m), np.minimum(m, 10) / 10, np.log1p(length), np.minimum(length, 12)])


@dataclass
class Ranking:
    """weights over features scaled by (mean, spread); cut is the raw score of the threshold quantile."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; AT exactly at the cut."""
        z = (self.raw(x) - self.cut) / self.scale + np.log(AT / (1 - AT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _newton(evaluate: Callable[[np.ndarray], tuple], width: int, penalty: float) -> np.ndarray:
    """Where a convex loss and the penalty on squared weights are least; evaluate(w): value, gradient and curve of the loss."""

    def at(w: np.ndarray) -> tuple:
        value, gradient, curve = evaluate(w)
        return value + penalty * w @ w / 2, gradient + penalty * w, curve + penalty * np.eye(width)

    w = np.zeros(width)
    here = at(w)
    for _ in range(30):
        step, size = np.linalg.solve(here[2], here[1]), 1.0
        if np.abs(step).max() < 1e-6:
            return w - step
        there = at(w - step)
        while there[0] > here[0] + 1e-12 and size > 1e-4:
            size /= 2
            there = at(w - size * step)
        w, here = w - size * step, there
    return w


def rank(x: np.ndarray, good: np.ndarray, pairs: int = 60_000, penalty: float = 1e-3, seed: int = 7) -> Ranking | None:
    """A ranking from rows in memory: the logistic loss of feature differences over random (good, bad) pairs.

    The cut is the quantile of the rows' raw scores at the share of bad labels. None without both labels.
    """
    if not 0 < good.sum() < len(good):
        return None
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / spread, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]

    def evaluate(w: np.ndarray) -> tuple:
        m = d @ w
        p = 1 / (1 + np.exp(np.clip(m, -30, 30)))
        return np.logaddexp(0, -m).mean(), -d.T @ p / pairs, (d * (p * (1 - p))[:, None]).T @ d / pairs

    w = _newton(evaluate, x.shape[1], penalty)
    raw = np.sort(z @ w)
    bad = len(raw) - int(good.sum())
    cut = (raw[bad - 1] + raw[bad]) / 2
    return Ranking(mean, spread, w, float(cut), max(float(np.std(raw)) / 4, 1e-6))


#: Distinct labelled rows of a block, and rows of either class in it at least, about.
BLOCK, LEAST = 256, 32
#: Parts that a range of raw scores is cut into, and raw scores at most that are looked at one by one.
PARTS = 4096


def _block_loss(z: np.ndarray, n: np.ndarray, good: np.ndarray, w: np.ndarray) -> tuple:
    """Weight, loss, gradient and curve of all (good, bad) pairs of a block; a pair weighs as much as its rows' product."""
    a, b = z[good], z[~good]
    pair = n[good][:, None] * n[~good][None, :]
    m = (a @ w)[:, None] - (b @ w)[None, :]
    p = pair / (1 + np.exp(np.clip(m, -30, 30)))
    c = p * (1 - p / pair)
    across = a.T @ c @ b
    curve = (a * c.sum(1)[:, None]).T @ a + (b * c.sum(0)[:, None]).T @ b - across - across.T
    return pair.sum(), (pair * np.logaddexp(0, -m)).sum(), b.T @ p.sum(0) - a.T @ p.sum(1), curve


def _summed(df: DataFrame, each: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of each(batch) over all batches: every task sends its own sum, so the driver adds one short row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((each(b) for b in batches if b.num_rows), 0)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    rows = df.mapInArrow(run, "s array<double>").collect()
    return np.sum(sorted([r["s"] for r in rows]), axis=0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rows (x, y, n; each once) dealt by hash into blocks, each one row of arrays.

    A class too rare to give every block LEAST rows is put into several blocks, each of its rows into as many.
    """
    many = -(-sum(counts.values()) // BLOCK)
    copies = {y: min(many, max(1, -(-LEAST * many // k))) for y, k in counts.items()}
    place = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == 1, copies[1]).otherwise(copies[0]) - 1))
    dealt = rows.withColumn("_k", place).withColumn("block", F.pmod(F.xxhash64("x", "y") + F.col("_k"), F.lit(many)))
    packed = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("y", "x", "n"))).alias("_rows"))
    return packed.select(F.col("_rows")["y"].alias("y"), F.col("_rows")["n"].alias("n"), F.flatten(F.col("_rows")["x"]).alias("x"))


def _nth(raw: DataFrame, wanted: int) -> float:
    """The raw score of the wanted-th row (from 0) in their order; raw: raw and n, the rows that a line stands for."""
    low, high = raw.agg(F.min("raw"), F.max("raw")).first()
    while True:
        inside = raw.where(F.col("raw").between(low, high))
        few = inside.groupBy("raw").agg(F.sum("n").alias("n")).limit(PARTS + 1).collect()
        if len(few) <= PARTS:
            for value, n in sorted(few):
                wanted -= n
                if wanted < 0:
                    return value
        part = F.least(F.floor((F.col("raw") - low) / ((high - low) / PARTS)), F.lit(PARTS - 1))
        parts = inside.groupBy(part.alias("part")).agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.sum("n").alias("n")).collect()
        for r in sorted(parts, key=lambda r: r["part"]):
            if wanted < r["n"]:
                low, high = r["low"], r["high"]
                break
            wanted -= r["n"]


def _with_features(docs: DataFrame, keys: list[str]) -> DataFrame:
    def run(batches):
        for rows, buf, offs in slices(batches, "_text"):
            x = features(buf, offs)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], pa.array(list(x), pa.list_(pa.float64()))], names=[*keys, "x"])

    return docs.select(*keys, docs["text"].alias("_text")).mapInArrow(run, docs.select(*keys).schema.add("x", ArrayType(DoubleType())))


def featured(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and x, the features of every whole text, as a table in the shared folder: for learn_from() and score_from()."""
    return materialise(_with_features(docs, keys), "features")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", penalty: float = 1e-3) -> Ranking | None:
    """A ranking from all labelled documents; None without both labels.

    Null labels and labels of unknown documents teach nothing; a document with several labels counts for each.
    """
    return learn_from(_with_features(docs, ["doc_id"]), labels, label, penalty)


def learn_from(features: DataFrame, labels: DataFrame, label: str = "quality", penalty: float = 1e-3) -> Ranking | None:
    """learn() of documents whose features (doc_id, x) are there.

    Every labelled document is in the means, in the threshold and in pairs: rows are dealt by hash into blocks, in which
    every good one meets every bad one. Rows of equal features and label are one row that weighs as many. Loss, gradient
    and curve are sums over blocks, so each of Newton's steps is one pass; the threshold is found by narrowing its range.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    rows = materialise(features.select("doc_id", "x").join(known, "doc_id").groupBy("x", "y").agg(F.count("*").alias("n")), "labelled")
    counts = {r["y"]: (r["rows"], r["n"]) for r in rows.groupBy("y").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    if len(counts) < 2:
        return None
    total = sum(n for _, n in counts.values())

    def weighted(batch: pa.RecordBatch, what: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        return what(_matrix(batch.column("x"))).T @ np.asarray(batch.column("n"))

    mean = _summed(rows, lambda b: weighted(b, lambda x: x)) / total
    spread = np.sqrt(_summed(rows, lambda b: weighted(b, lambda x: (x - mean) ** 2)) / total) + 1e-6
    blocks = materialise(_blocks(rows, {y: k for y, (k, _) in counts.items()}), "blocks")
    width = len(mean)

    def evaluate(w: np.ndarray) -> tuple:
        def each(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(2 + width + width * width)
            for y, n, x in zip(*(batch.column(c) for c in ("y", "n", "x"))):
                z = np.clip((x.values.to_numpy().reshape(-1, width) - mean) / spread, -6, 6)
                weight, value, gradient, curve = _block_loss(z, n.values.to_numpy().astype(float), y.values.to_numpy() == 1, w)
                out += np.concatenate([[weight, value], gradient, curve.ravel()])
            return out

        s = _summed(blocks, each)
        return s[1] / s[0], s[2 : 2 + width] / s[0], s[2 + width :].reshape(width, width) / s[0]

    ranking = Ranking(mean, spread, _newton(evaluate, width, penalty), 0.0, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranking.raw(_matrix(batch.column("x")))), batch.column("n")], names=["raw", "n"])

    raw = materialise(rows.mapInArrow(run, "raw double, n long"), "raw")
    bad = counts[0][1]
    middle = raw.agg(F.sum(F.col("raw") * F.col("n"))).first()[0] / total
    apart = raw.agg(F.sum((F.col("raw") - middle) ** 2 * F.col("n"))).first()[0] / total
    ranking.cut = (_nth(raw, bad - 1) + _nth(raw, bad)) / 2
    ranking.scale = max(float(np.sqrt(apart)) / 4, 1e-6)
    for table in (rows, blocks, raw):
        discard(table)
    return ranking


def score(docs: DataFrame, ranking: Ranking | None, keys: list[str]) -> DataFrame:
    """The columns `keys` and score (0 to 1) for every whole text; null counts as empty; without a ranking all are 0.5."""
    return score_from(_with_features(docs, keys), ranking, keys)


def score_from(features: DataFrame, ranking: Ranking | None, keys: list[str]) -> DataFrame:
    """score() of documents whose features (keys, x) are there."""
    given = features.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = given.value.score(_matrix(batch.column("x"))) if given.value else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(s)], names=[*keys, "score"])

    return features.select(*keys, "x").mapInArrow(run, features.select(*keys).schema.add("score", "double"))
