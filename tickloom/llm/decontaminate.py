"""Benchmark decontamination: documents that contain a test item's word shingles.

Items are partitioned by size, and from the items of a size class come MinHash signatures: an item's k least shingle
hashes, where k is chosen for the class so that no text can hold the threshold's share of the item and miss all k. A
document is probed with every shingle it has, whatever its length; an item whose signature it meets, and for which it is
long enough, is then verified by exact shingle containment. Nothing is missed, as the signature's length follows from
the threshold.

Items and signatures stay tables. What goes to every executor is a Bloom filter of the signatures, of a bounded number of
bits, which lets most shingles go where they are made; what passes it is joined with the signatures. Signatures that are
too many for one filter are dealt by hash into several, and documents are probed with one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ._common import LOWER, materialise, mix, ngrams, prefix_hash, range_hash, slices, words

SHINGLE = 5
THRESHOLD = 0.8
BITS = 28  # a filter has 2**BITS bits (32 MB) at most, and 128 for each signature below that
LEAST = 16  # bits for each signature, below which there are more filters: one shingle in 400 passes then
PROBES = 4
KNOWN = 50_000  # shingles of items that a task remembers, about
LISTED = 1 << 20  # ids of documents to drop that are broadcast; more of them are joined by a shuffle


def _parts(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(parts: list[bytes], n: int = SHINGLE) -> set[bytes]:
    """All runs of n words; the whole sequence if there are fewer; none if there are no words."""
    n = min(n, len(parts))
    return {b" ".join(parts[i : i + n]) for i in range(len(parts) - n + 1)} if n else set()


def need(size: int, threshold: float) -> int:
    """Shingles, of `size` different ones, that make the threshold's share."""
    return -int(-threshold * size // 1)


def _signature(text: bytes, threshold: float) -> tuple[int, int, np.ndarray]:
    """Words in a shingle, number of different shingles, and the k least of their hashes, k by the size class."""
    parts = _parts(text)
    own = sorted(shingles(parts))
    n = min(SHINGLE, len(parts))
    buf = np.frombuffer(b" ".join(own), np.uint8)
    offs = np.cumsum([0, *(len(x) + 1 for x in own)])
    offs[-1] = len(buf)
    s, e, doc = words(buf, offs)
    h = ngrams(range_hash(prefix_hash(buf), s, e), doc, n)[0]
    # at least need(size) of `size` shingles are shared: size - need can be missed, and one more is met. Sizes up to the
    # next power of two form a class; its longest signature serves all of it.
    low, top = 1 << len(own).bit_length() - 1, (1 << len(own).bit_length()) - 1
    k = max(size - need(size, threshold) + 1 for size in range(low, top + 1)) if top < 64 else top - need(top, threshold) + 2
    return n, len(own), np.sort(h)[:k]


def _spots(h: np.ndarray, n: int, bits: int) -> Iterator[np.ndarray]:
    """Where the filter holds a hash of an n-word shingle: one array of places for each probe."""
    h = mix(h ^ np.uint64(n))
    for k in range(PROBES):
        yield (mix(h + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)


def _bloom(signatures: DataFrame, many: int) -> tuple[np.ndarray, int]:
    """The filter's 64-bit words and number of bits, for `many` signatures: each word is put together on the executors."""
    bits = min(BITS, max(16, (128 * many).bit_length()))

    def places(batches):
        for b in batches:
            h, n = np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1))
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for k in range(1, SHINGLE + 1) for x in _spots(h[n == k], k, bits))]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    found = signatures.select("h", "n").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out, bits


def _maybe(bloom: np.ndarray, bits: int, h: np.ndarray, n: int) -> np.ndarray:
    """Places in h that the filter lets pass."""
    left = np.arange(len(h))
    for spot in range(PROBES):
        at = next(x for k, x in enumerate(_spots(h[left], n, bits)) if k == spot)
        left = left[(bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0]
    return left


def _candidates(docs: DataFrame, keys: list[str], signatures: DataFrame, many: int, sizes: list[int]) -> DataFrame:
    """The columns `keys` of the rows of docs that may meet a signature, with their number of words and the shingles' hashes."""
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(signatures, many))
    asked = docs.select(*keys, F.col("text").alias("_text"))

    def run(batches):
        table, bits = bloom.value
        for rows, buf, offs in slices(batches, "_text"):
            low = LOWER[buf]
            s, e, doc = words(low, offs)
            h = range_hash(prefix_hash(low), s, e)
            docs_, hashes, ns = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            for n in sizes:
                grams, at = ngrams(h, doc, n)
                left = _maybe(table, bits, grams, n)
                docs_.append(doc[at[left]])
                hashes.append(grams[left])
                ns.append(np.full(len(left), n, np.int32))
            of, g, n = np.concatenate(docs_), np.concatenate(hashes), np.concatenate(ns)
            by = np.argsort(of, kind="stable")
            some, many = np.unique(of, return_counts=True)
            met = pa.StructArray.from_arrays([pa.array(n[by]), pa.array(g[by].view(np.int64))], names=["n", "h"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), met)
            taken = rows.take(pa.array(some))
            n_words = pa.array(np.bincount(doc, minlength=rows.num_rows)[some].astype(np.int64))
            yield pa.RecordBatch.from_arrays([*taken.columns[: len(keys)], n_words, lists], names=[*keys, "n_words", "met"])

    schema = docs.select(*keys).schema.add("n_words", "long").add("met", ArrayType(StructType().add("n", "integer").add("h", "long")))
    return asked.mapInArrow(run, schema)


def _probed(docs: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_row, n_words and a shingle n, h of documents that may meet a signature; _row, doc_id and text of these documents)."""
    counts = {r["n"]: r["count"] for r in signatures.groupBy("n").count().collect()}  # five sizes at most
    many, sizes = sum(counts.values()), sorted(counts)
    filters = -(-LEAST * many >> BITS) if many else 1
    if filters <= 1:
        rows = materialise(_candidates(docs.select("doc_id", "text"), ["doc_id", "text"], signatures, many, sizes), "decontaminate-documents").withColumn("_row", F.monotonically_increasing_id())
        return rows.select("_row", "n_words", F.explode("met").alias("x")), rows.select("_row", "doc_id", "text")
    rows = materialise(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "decontaminate-documents")
    met = []
    for k in range(filters):
        own = signatures.where(F.pmod(F.xxhash64("h"), F.lit(filters)) == k)
        met.append(materialise(_candidates(rows, ["_row"], own, -(-many // filters), sizes), f"decontaminate-met-{k}").select("_row", "n_words", F.explode("met").alias("x")))
    every = met[0]
    for m in met[1:]:
        every = every.unionByName(m)
    return every, rows.select("_row", "doc_id", "text")


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles (distinct, of the item), n_shared and containment, where containment >= threshold.

    Words are runs outside white space, A-Z lower-cased; shingles are five words (an item of fewer words is one shingle
    of all of them). Null or empty texts on either side meet nothing; an item_id that occurs with several texts is
    searched for by each; repeated documents each give rows, repeated items give one; null ids stay. Other columns of
    either table are left out.
    """
    items = benchmark.select("item_id", "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).distinct()
    items = materialise(items.withColumn("_item", F.monotonically_increasing_id()), "decontaminate-items")

    def sign(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, size, h = _signature(text.encode(), threshold)
                for col, val in zip(out, ([item] * len(h), [n] * len(h), [size] * len(h), h.view(np.int64).tolist())):
                    col += val
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["_item", "n", "size", "h"])

    signatures = materialise(items.select("_item", "text").mapInArrow(sign, "_item long, n int, size long, h long"), "decontaminate-signatures")
    met, rows = _probed(docs, signatures)
    met = met.select("_row", "n_words", "x.n", "x.h")
    # a document with fewer words than the shared shingles take up can't contain the item
    long_enough = F.col("n_words") >= F.ceil(F.col("size") * threshold - 1e-6) + F.col("n") - 1
    pairs = met.join(signatures, ["n", "h"]).where(long_enough).select("_row", "_item").distinct()
    both = pairs.join(items.withColumnRenamed("text", "_wanted"), "_item").join(rows, "_row")
    ids = [docs.select("doc_id").schema.fields[0], items.schema["item_id"]]
    schema = docs.select("doc_id").schema.add(ids[1]).add("n_shingles", "long").add("n_shared", "long").add("containment", "double")

    def verify(batches):
        last, parts, own = None, [], {}
        items: dict[str, tuple[set[bytes], int]] = {}  # parsed before
        held = 0

        def parsed(wanted: str) -> tuple[set[bytes], int]:
            nonlocal held
            if wanted not in items:
                if held > KNOWN:
                    items.clear()
                    held = 0
                item = _parts(wanted.encode())
                items[wanted] = shingles(item), min(SHINGLE, len(item))
                held += len(item)
            return items[wanted]

        for b in batches:
            at, found = [], []
            for k, (row, text, wanted) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_row", "text", "_wanted")))):
                if row != last:
                    last, parts, own = row, _parts(text.encode()), {}
                want, n = parsed(wanted)
                if n not in own:
                    own[n] = shingles(parts, n) if len(parts) >= n else set()
                shared = len(want & own[n])
                if shared >= need(len(want), threshold):
                    at.append(k)
                    found.append((len(want), shared, shared / len(want)))
            cols = list(zip(*found)) or [()] * 3
            hit = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([hit.column("doc_id"), hit.column("item_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64())))], names=schema.names)

    return both.select("_row", "text", "_wanted", "doc_id", "item_id").mapInArrow(verify, schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that contain a test item; rows whose doc_id is null stay, as nothing can name them."""
    bad = materialise(contained(docs, benchmark, threshold).where("doc_id is not null").select("doc_id").distinct(), "decontaminate-found")
    few = bad.limit(LISTED + 1).count() <= LISTED
    return docs.join(F.broadcast(bad) if few else bad, "doc_id", "left_anti")
