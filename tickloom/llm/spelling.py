"""Spelling variants: words of the corpus, which of them are one edit apart, and the commoner form that each leads to.

Words become vectors of letter counts. Words one edit apart lie at a squared distance of two (a letter replaced) or one
(a letter more), so Gram matrices, NumPy products of blocks of such vectors, show which pairs are worth a look; these are
verified letter by letter. Blocks hold words of one length and of the next that share a half: of two words one edit apart,
the first half of the shorter one's letters is the start of both, or the rest of them the end of both.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # letters a-z and U+00C0 to U+00FF, in UTF-8
FLUSH = 100_000  # different words that a task counts before it hands the counts on
TILE = 2048  # words of a block's tile
AREA = 1 << 21  # entries of one product of blocks


def words(docs: DataFrame, least_length: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """word and n: the words of at least `least_length` letters that occur at least `least` times in all texts.

    A word is a maximal run of the letters a-z, A-Z and U+00C0 to U+00FF, of which A-Z are lower-cased. Where `every` divides
    h, the CRC-32 of `<doc_id>:<run>`, the run's letter h % length is left out. A null text has no words, a null doc_id
    counts as the empty string in h, and repeated rows count again. Other columns are left out.
    """

    def table(n: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for w, k in Counter(_RUN.findall(text.lower())).items():
                    size = len(w) - w.count(b"\xc3")
                    if size < least_length:
                        continue
                    h = zlib.crc32(w, seed)
                    if h % every == 0:
                        if size == least_length:
                            continue
                        s = w.decode()
                        w = (s[: h % size] + s[h % size + 1 :]).encode()
                    found[w] = found.get(w, 0) + k
                if len(found) > FLUSH:
                    yield table(found)
                    found = {}
        if found:
            yield table(found)

    counts = docs.select(F.col("doc_id").cast("string"), F.encode("text", "utf-8").alias("text")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _letters(words: list[bytes]) -> np.ndarray:
    """The words' letters (Latin-1 codes), one row a word, filled up with zeros."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(size.max())), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out


def _counts(letters: np.ndarray, length: int) -> np.ndarray:
    """How often each letter stands in each row; exact in the type chosen, as a squared norm is at most length squared."""
    kind = np.float32 if length < 4096 else np.float64
    rows = len(letters)
    used = np.zeros(256, bool)
    used[letters.ravel()] = True
    used[0] = False
    place = np.cumsum(used) - 1
    at = np.flatnonzero(letters.ravel())
    cell = (at // letters.shape[1]) * int(used.sum()) + place[letters.ravel()[at]]
    out = np.zeros((rows, 256), kind)
    out[:, used] = np.bincount(cell, minlength=rows * int(used.sum())).reshape(rows, -1)
    return out


def _close(a: np.ndarray, b: np.ndarray, length: int, most: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b whose letter counts are at a squared distance of at most `most`, by products of blocks."""
    ca, cb = _counts(a, length), _counts(b, length)
    used = ca.any(0) & cb.any(0)
    na, nb = (ca * ca).sum(1), (cb * cb).sum(1)
    ca, cb = np.ascontiguousarray(ca[:, used]), np.ascontiguousarray(cb[:, used])
    step = max(1, AREA // len(cb))
    for lo in range(0, len(ca), step):
        gram = ca[lo : lo + step] @ cb.T
        i, j = np.nonzero(na[lo : lo + step, None] + nb - 2 * gram <= most)
        yield i + lo, j


def _verified(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, side: int) -> np.ndarray:
    """Which pairs are one edit apart and belong to this side: pairs that share both halves count at the first half only."""
    short = a.shape[1]
    x, y = a[i], b[j]
    if b.shape[1] == short:
        return (x != y).sum(1) == 1
    same = x == y[:, :-1]
    ahead = np.cumprod(same, axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
    behind = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
    ok = ahead + behind >= short
    return ok if side == 0 else ok & (ahead < short // 2)


def _near(batches: Iterator[pa.RecordBatch], schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows (short, side, half, one, two, tile, longer, word, n) to each word's near words of its block: how many, and the best of them."""
    for short, side, one, two, tile, longer, text, n in _runs(batches):
        words = [w.encode("latin-1") for w in text]
        own, more = np.flatnonzero(longer == 0), np.flatnonzero(longer == 1)
        pairs = []
        for other in (own, more):
            if len(own) and len(other):
                a, b = _letters([words[k] for k in own]), _letters([words[k] for k in other])
                for i, j in _close(a, b, short + 1):
                    # each pair once: inside a tile from its lower row, across tiles where the tiles differ
                    p, q = own[i], other[j]
                    ok = (tile[p] != tile[q]) if one != two else np.ones(len(i), bool)
                    if other is own:
                        ok &= p < q
                    i, j, p, q = i[ok], j[ok], p[ok], q[ok]
                    ok = _verified(a, b, i, j, side)
                    pairs.append((p[ok], q[ok]))
        if not pairs:
            continue
        p = np.concatenate([x for x, _ in pairs] + [y for _, y in pairs])
        q = np.concatenate([y for _, y in pairs] + [x for x, _ in pairs])
        if not len(p):
            continue
        rank = np.empty(len(text), np.int64)  # of near words: the largest n first, then the smallest word
        rank[sorted(range(len(text)), key=lambda k: (-n[k], text[k]))] = np.arange(len(text))
        order = np.lexsort((rank[q], p))
        p, q = p[order], q[order]
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        size = np.diff(np.r_[first, len(p)])
        near = [text[k] for k in q[first]]
        columns = [pa.array([text[k] for k in p[first]], pa.string()), pa.array(size, pa.int64()), pa.array(near, pa.string()), pa.array(n[q[first]], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of each block or pair of tiles, whole, wherever the batches cut them; at most two tiles are held."""
    held: list[pa.RecordBatch] = []
    key = None

    def made():
        t = pa.Table.from_batches(held)
        return (*key[:2], *key[3:], *(t.column(c).to_numpy() for c in ("tile", "longer")), t.column("word").to_pylist(), t.column("n").to_numpy())

    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in ("short", "side", "half", "one", "two"))))
        lo = 0
        for i, k in enumerate(keys):
            if k != key:
                if i > lo:
                    held.append(b.slice(lo, i - lo))
                if held:
                    yield made()
                held, key, lo = [], k, i
        if lo < len(keys):
            held.append(b.slice(lo))
    if held:
        yield made()


def near(vocabulary: DataFrame, least_length: int = 6, tile: int = TILE) -> DataFrame:
    """word, n_near and best (n, word): of every word with a word one edit apart, how many there are and the commonest (ties: the smallest).

    Blocks of more than `tile` words are dealt into tiles, every two of which meet in a task of their own; no pair is left out.
    """
    size = F.length("word")
    cells = []
    for longer in (0, 1):
        short = size - longer
        half = F.floor(short / 2).cast("int")
        for side, text in ((0, F.substring(F.col("word"), F.lit(1), half)), (1, F.substring(F.col("word"), half + 1 + longer, short - half))):
            cells.append(F.struct(short.alias("short"), F.lit(side).alias("side"), text.alias("half"), F.lit(longer).alias("longer")))
    placed = vocabulary.select("word", "n", F.explode(F.array(*cells)).alias("c")).select("c.*", "word", "n").where(F.col("short") >= least_length)
    block = ["short", "side", "half"]
    # few: a word stands in four blocks, so at most 4 / tile of the words' number
    weight = F.sum(1 + F.floor(F.length("word") / 64))
    big = placed.groupBy(*block).agg(weight.alias("w")).where(F.col("w") > tile).select(*block, F.ceil(F.col("w") / tile).cast("int").alias("tiles"))
    tiled = placed.join(F.broadcast(big), block, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = [*block, "one", "two"]
    tiled = tiled.withColumns({"one": F.least("tile", "other"), "two": F.greatest("tile", "other")}).select(*pair, "tile", "longer", "word", "n")
    schema = vocabulary.select("word").schema.add("n_near", "long").add("near", "string").add("near_n", "long")
    found = tiled.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(lambda batches: _near(batches, schema), schema)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select("word", "n_near", F.struct((-F.col("_best.less")).alias("n"), F.col("_best.word").alias("word")).alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word and root: the last of the forms that word leads to. forms: word, form; chains of at most 2 ** steps forms."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = materialise(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
    return at


def variants(docs: DataFrame, least_length: int = 6, least: int = 5, every: int = 199, factor: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the corpus (words() says which these are).

    n_near counts the words one edit apart (a code point inserted, deleted or replaced). form is the commonest of them
    (ties: the first by code points) if it occurs at least `factor` times as often, else null; root is where the forms
    lead to, the word itself if it has none. An empty table gives no words. factor is 2 at least, so that chains end.
    """
    if factor < 2:
        raise ValueError("factor is at least 2")
    vocabulary = materialise(words(docs, least_length, least, every), "spelling-words")
    joined = vocabulary.join(near(vocabulary, least_length), "word", "left")
    commoner = F.col("best.n") >= factor * F.col("n")
    form, form_n = F.when(commoner, F.col("best.word")).alias("form"), F.when(commoner, F.col("best.n")).alias("form_n")
    formed = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form, form_n), "spelling-forms")
    # counts grow by the factor along a chain, so a chain is no longer than the logarithm of the largest count
    largest = formed.agg(F.max("n")).first()[0] or 1
    longest = 1
    while least * factor**longest <= largest:
        longest += 1
    last = roots(formed.where("form is not null"), (longest - 1).bit_length())
    return formed.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
