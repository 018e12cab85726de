"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if some LENGTH-byte string over it starts earlier too (smaller doc_id, or same document and earlier start).

Only suffixes that may have an equal are sorted. Every suffix is put into a bucket by its anchor: the SEED-byte string
inside its first LENGTH bytes whose hash is least. Equal strings have equal anchors, so a bucket with one member needs no
work. Members of the others bring the bytes that their suffixes start in, and buckets are sorted block after block in a
stream; a bucket of very many members is dealt into parts, each sorted like a bucket, whose first strings are merged.

In a block, the suffixes at sample positions are ranked first: those whose place in the document lies in a difference
cover modulo COVER. Any two places have an offset below COVER that takes both into the cover. So two suffixes that agree
in their first COVER bytes are compared by the ranks of the samples at that offset, and no tie is read further than that.
Hashes only choose buckets: whatever is removed has been compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ._common import discard, materialise, mix, prefix_hash, range_hash, slices

LENGTH = 100
SEED = 32
COVER = 32
PART = 1024  # members of a bucket that are sorted together; a larger bucket is dealt into parts
BLOCK = 8192  # different members in memory at a time, each of up to 2 * LENGTH bytes: many small buckets, or some parts


def difference_cover(v: int) -> list[int]:
    """A small set of residues whose differences give every residue mod v, chosen greedily."""
    out = [0]
    have = {0}
    while len(have) < v:
        best = max((x for x in range(v) if x not in out), key=lambda x: (len(({(x - y) % v for y in out} | {(y - x) % v for y in out}) - have), -x))
        have |= {(best - y) % v for y in out} | {(y - best) % v for y in out}
        out.append(best)
    return sorted(out)


def _anchors(buf: np.ndarray, offs: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each run of suffixes with one anchor: its place (in buf) and hash, and the first and the last suffix; and the prefix hash of buf."""
    p = prefix_hash(buf)
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none.view(np.uint64), none, none, p
    i = np.arange(len(buf) - seed + 1)
    h = range_hash(p, i, i + seed)
    # hash above, place below: the least value is the least hash, of equal ones the leftmost
    v = (h & np.uint64(0xFFFFFFFF00000000)) | i.astype(np.uint64)
    span, wide = length - seed + 1, 1
    while 2 * wide <= span:
        v = np.minimum(v[: len(v) - wide], v[wide:])
        wide *= 2
    if wide < span:
        v = np.minimum(v[: len(v) - (span - wide)], v[span - wide :])
    inside = np.zeros(len(buf) + 1, np.int32)
    whole = offs[1:] - offs[:-1] >= length
    np.add.at(inside, offs[:-1][whole], 1)
    np.add.at(inside, offs[1:][whole] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(v)] > 0)
    at = (v[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else none
    last = np.append(first[1:], len(at)) - 1 if len(at) else none
    return at[first], h[at[first]], start[first], start[last], p


def _equal_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size[i] bytes of buf from a[i] are those from b[i]."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1 << 14):
        cut = slice(lo, lo + (1 << 14))
        n = size[cut]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = buf[np.repeat(a[cut], n) + step] != buf[np.repeat(b[cut], n) + step]
        out[cut] = np.add.reduceat(differs, np.cumsum(n) - n) == 0
    return out


def _places(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """One row for each run of suffixes with one anchor: h (its hash), _id, _th, q (its place), and the suffixes at q - a to q - b.

    Of places with the same bytes in one slice of rows only the first can be the earliest; the suffixes of the others go
    for sure: these rows have no h, so that a passage that very many documents share doesn't meet in one task.
    """

    def run(batches):
        for rows, buf, offs in slices(batches, "text"):
            at, h, first, last, p = _anchors(buf, offs, length, seed)
            doc = np.searchsorted(offs, at, "right") - 1
            q, a, b = at - offs[doc], at - first, at - last
            ctx = mix(range_hash(p, first, last + length) ^ mix(a.astype(np.uint64)))
            ids, ths = rows.column(0), np.asarray(rows.column(1).to_pylist(), np.int64)
            order = _document_ranks(ids, ths)[doc] if rows.num_rows else doc
            sure = np.zeros(len(at), bool)
            by = np.lexsort((q, order, ctx, h))
            if len(by):
                x, y = by[1:], by[:-1]
                new = np.concatenate([[True], (h[x] != h[y]) | (ctx[x] != ctx[y])])
                head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
                # a row that repeats another wholly is no earlier than it
                later = (order[by] != order[head]) | (q[by] != q[head])
                later &= (a[by] == a[head]) & (b[by] == b[head])
                later[later] = _equal_bytes(buf, first[by[later]], first[head[later]], (a - b)[by[later]] + length)
                sure[by] = later
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64), mask=sure), ids.take(pa.array(doc)), pa.array(ths[doc]), pa.array(q), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                names=["h", "_id", "_th", "q", "a", "b"],
            )

    schema = StructType([StructField("h", LongType()), docs.schema["_id"], StructField("_th", LongType()), StructField("q", LongType()), StructField("a", IntegerType()), StructField("b", IntegerType())])
    return docs.select("_id", "_th", "text").mapInArrow(run, schema)


def _document_ranks(ids: pa.Array, ths: np.ndarray) -> np.ndarray:
    """Numbers in the order of (id, th), equal for equal ones; a null id is the least."""
    coded = ids.dictionary_encode()
    codes = np.asarray(coded.indices.fill_null(-1))
    rank = np.zeros(len(coded.dictionary) + 1, np.int64)  # the last: null
    rank[np.asarray(pc.array_sort_indices(coded.dictionary))] = np.arange(1, len(coded.dictionary) + 1)
    by = np.lexsort((ths, rank[codes]))
    key, th = rank[codes][by], ths[by]
    new = np.concatenate([[False], (key[1:] != key[:-1]) | (th[1:] != th[:-1])])
    out = np.zeros(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def _sorted_strings(windows: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows `at` of windows by bucket and bytes, and the bytes that each has in common with the one before (-1: other bucket)."""
    size = windows.shape[1]
    keyed = np.empty((len(at), 8 + size), np.uint8)
    keyed[:, :8] = bucket.astype(">u8").view(np.uint8).reshape(-1, 8)
    keyed[:, 8:] = windows[at]
    order = np.argsort(keyed.view(f"S{8 + size}").ravel())
    common = np.full(len(at), -1, np.int64)
    for lo in range(1, len(at), 1 << 16):
        hi = min(lo + (1 << 16), len(at))
        x = keyed[order[lo - 1 : hi]]
        differs = x[1:, 8:] != x[:-1, 8:]
        same = differs.argmax(1)
        same[~differs.any(1)] = size
        common[lo:hi] = np.where((x[1:, :8] == x[:-1, :8]).all(1), same, -1)
    return order, common


def repeats(raw: np.ndarray, begin: np.ndarray, bucket: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int, cover: list[int], v: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a block's texts that have `length` bytes left, and which of them have an earlier equal in their bucket.

    Text i is raw[begin[i] : begin[i + 1]], from position place[i] of the document with number doc[i]; earlier is the
    smaller (doc, position). Returns the suffixes' starts in raw, text by text, and a mark for each that goes.
    """
    size = np.diff(begin)
    text = np.repeat(np.arange(len(size)), size)
    position = place[text] + np.arange(len(raw)) - begin[text]
    left = begin[text + 1] - np.arange(len(raw))
    suffix = np.flatnonzero(left >= length)
    gone = np.zeros(len(suffix), bool)
    if len(suffix) < 2:
        return suffix, gone
    padded = np.concatenate([raw, np.zeros(length, np.uint8)])

    # ranks of the sample suffixes; two of them agree in n bytes where no neighbours between them have less in common
    # (windows may reach into the next text, but no suffix asks for more of a sample than its own text has)
    sampled = np.zeros(v, bool)
    sampled[cover] = True
    sample = np.flatnonzero(sampled[position % v] & (left > length - v))
    order, common = _sorted_strings(np.lib.stride_tricks.sliding_window_view(padded, length), sample, bucket[text[sample]])
    rank = np.full(len(raw), -1, np.int64)
    rank[sample[order]] = np.arange(len(order))

    # suffixes tie where they agree in their first v bytes
    order, same = _sorted_strings(np.lib.stride_tricks.sliding_window_view(padded, v), suffix, bucket[text[suffix]])
    tie = np.zeros(len(suffix), np.int64)
    tie[order] = np.cumsum(same < v)
    tied = np.flatnonzero(np.bincount(tie)[tie] > 1)
    when = doc[text[suffix]] * (np.int64(1) << 40) + position[suffix]
    for k in range(v):
        here = tied[sampled[(position[suffix[tied]] + k) % v]]
        if len(here) < 2:
            continue
        kind = np.cumsum(common < length - k)[rank[suffix[here] + k]]
        by = np.lexsort((when[here], kind, tie[here]))
        here, kind = here[by], kind[by]
        new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (tie[here[1:]] != tie[here[:-1]])])
        first = here[np.maximum.accumulate(np.where(new, np.arange(len(here)), 0))]
        gone[here] |= when[here] > when[first]
    return suffix, gone


def _block(rows: pa.Table, length: int, cover: list[int], v: int, limit: int):
    """Arrays of what a block of whole buckets (or parts) gives: row numbers, start and stop of ranges that go; and row numbers, starts and strings that other parts may have earlier."""
    h, part, parts = (np.asarray(rows.column(c)) for c in ("h", "part", "parts"))
    q, a = np.asarray(rows.column("q")), np.asarray(rows.column("a"))
    bucket = np.cumsum(np.concatenate([[False], (h[1:] != h[:-1]) | (part[1:] != part[:-1])]))
    doc = _document_ranks(rows.column("_id").combine_chunks(), np.asarray(rows.column("_th")))
    around = rows.column("around").combine_chunks().cast(pa.large_binary())
    offs = np.frombuffer(around.buffers()[1], np.int64, len(around) + 1, around.offset * 8)
    raw = np.frombuffer(around.buffers()[2], np.uint8)
    code = np.asarray(around.dictionary_encode().indices)

    # members that are alike in all their bytes: the suffixes of all but the earliest go
    by = np.lexsort((q, doc, a, code, bucket))
    x, y = by[1:], by[:-1]
    new = np.concatenate([[True], (bucket[x] != bucket[y]) | (code[x] != code[y]) | (a[x] != a[y])])
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    whole = by[(doc[by] != doc[head]) | (q[by] != q[head])]
    found = [(whole, q[whole] - a[whole], q[whole] - a[whole] + np.diff(offs)[whole])]
    strings = []

    kept = np.sort(by[new])
    many = np.bincount(bucket[kept])
    kept = kept[(many[bucket[kept]] > 1) | (parts[kept] > 1)]
    cuts, before = [0], 0
    for end in np.flatnonzero(np.diff(bucket[kept], append=-1)) + 1:  # whole buckets, up to the limit
        if end - cuts[-1] > limit and before > cuts[-1]:
            cuts.append(before)
        before = int(end)
    cuts += [len(kept)] if len(kept) else []
    for lo, hi in zip(cuts, cuts[1:]):
        m = kept[lo:hi]
        size = np.diff(offs)[m]
        begin = np.concatenate([[0], np.cumsum(size)])
        own = raw[np.repeat(offs[m] - begin[:-1], size) + np.arange(int(begin[-1]))]
        suffix, gone = repeats(own, begin, bucket[m], doc[m], q[m] - a[m], length, cover, v)
        of = np.searchsorted(begin, suffix, "right") - 1
        start = (q - a)[m[of]] + suffix - begin[of]
        g = np.flatnonzero(gone)
        if len(g):
            opens = np.concatenate([[True], (of[g[1:]] != of[g[:-1]]) | (g[1:] != g[:-1] + 1)])
            closes = np.append(opens[1:], True)
            found.append((m[of[g[opens]]], start[g[opens]], start[g[closes]] + length))
        open_ = np.flatnonzero(~gone & (parts[m[of]] > 1))
        if len(open_):
            view = np.lib.stride_tricks.sliding_window_view(own, length)[suffix[open_]]
            strings.append((m[of[open_]], start[open_], [x.tobytes() for x in view]))
    return found, strings


def _runs_of_buckets(batches, rows: int):
    """Tables of whole buckets (or parts) of a stream that is sorted by them, of about `rows` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        h, part = np.asarray(t.column("h")), np.asarray(t.column("part"))
        change = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1]))
        if len(change):
            cut = int(change[-1]) + 1
            yield t.slice(0, cut)
            t = t.slice(cut).combine_chunks()
        held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held)


def spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, part: int = PART, cover: int = COVER, block: int = BLOCK) -> DataFrame:
    """_id, _th, start and stop of byte ranges to remove (they may overlap). docs: _id, _th, text."""
    if seed > length:
        raise ValueError("seed must not exceed length")
    identity = docs.schema["_id"]
    places = materialise(_places(docs, length, seed), "suffix-places")
    buckets = materialise(places.where("h is not null").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "suffix-buckets")
    live = places.join(buckets, "h").select("_id", "_th", F.struct("q", "a", "b", "h", "n").alias("x"))
    edges = materialise(live.groupBy("_id", "_th").agg(F.collect_set("x").alias("at")), "suffix-members")
    sure = places.where("h is null").select("_id", "_th", (F.col("q") - F.col("a")).alias("start"), (F.col("q") - F.col("b") + length).alias("stop"))
    sure = materialise(sure, "suffix-sure")
    discard(places)
    discard(buckets)
    near = docs.join(edges, docs["_id"].eqNullSafe(edges["_id"]) & (docs["_th"] == edges["_th"])).select(docs["_id"], docs["_th"], "text", "at")

    def cut(batches):
        for batch in batches:
            for rows, buf, offs in slices([batch], "text"):
                at = rows.column(3)
                x = at.flatten()
                many = np.asarray(pc.list_value_length(at))
                doc = np.repeat(np.arange(rows.num_rows), many)
                q, a, b, h, n = (np.asarray(x.field(k)).astype(np.int64) for k in range(5))
                for lo in range(0, len(q), 1 << 15):
                    c = slice(lo, lo + (1 << 15))
                    size = (a - b)[c] + length
                    ends = np.cumsum(size)
                    data = buf[np.repeat(offs[doc[c]] + (q - a)[c] - (ends - size), size) + np.arange(int(ends[-1]))]
                    around = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)])
                    own = pa.array(doc[c])
                    yield pa.RecordBatch.from_arrays([pa.array(h[c]), pa.array(n[c]), rows.column(0).take(own), rows.column(1).take(own), pa.array(q[c]), pa.array(a[c].astype(np.int32)), around.cast(pa.binary())], names=["h", "n", "_id", "_th", "q", "a", "around"])

    members = StructType([StructField("h", LongType()), StructField("n", LongType()), identity, StructField("_th", LongType()), StructField("q", LongType()), StructField("a", IntegerType()), StructField("around", BinaryType())])
    parts = F.ceil(F.col("n") / part)
    dealt = near.mapInArrow(cut, members).select("h", F.pmod(F.xxhash64("_id", "_th", "q"), parts).alias("part"), parts.alias("parts"), "_id", "_th", "q", "a", "around")
    v = min(cover, length)
    chosen = difference_cover(v)

    def sort(batches):
        kind = None
        for rows in _runs_of_buckets(batches, 8 * block):
            kind = rows.schema.field("_id").type
            found, strings = _block(rows, length, chosen, v, block)
            at, start, stop = (np.concatenate(c) for c in zip(*found))
            got = [(at, pa.array(start), pa.array(stop), pa.nulls(len(at), pa.binary()))]
            got += [(at, pa.array(start), pa.nulls(len(at), pa.int64()), pa.array(s, pa.binary())) for at, start, s in strings]
            for at, start, stop, s in got:
                ids, ths = (rows.column(c).combine_chunks().take(pa.array(at)) for c in ("_id", "_th"))
                yield pa.RecordBatch.from_arrays([ids, ths, start, stop, s], names=["_id", "_th", "start", "stop", "s"])

    ranges = StructType([identity, StructField("_th", LongType()), StructField("start", LongType()), StructField("stop", LongType()), StructField("s", BinaryType())])
    found = materialise(dealt.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(sort, ranges), "suffix-found")
    discard(edges)

    # buckets in several parts: each part gives its first place of a string; all but the least of these places go
    firsts = found.where("s is not null")
    least = firsts.groupBy("s").agg(F.min(F.struct("_id", "_th", "start")).alias("least"))
    later = firsts.join(least, "s").where(~F.struct("_id", "_th", "start").eqNullSafe(F.col("least"))).select("_id", "_th", "start", (F.col("start") + length).alias("stop"))
    return found.where("s is null").drop("s").unionByName(later).unionByName(sure)


def _remove(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal ranges, clipped to raw, and what is left."""
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        b = min(b, len(raw))
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept.append(raw[at:a])
        at = b
    return [(a, b) for a, b in merged], b"".join([*kept, raw[at:]])


def _with_spans(docs: DataFrame, length: int, seed: int, part: int, block: int) -> DataFrame:
    """docs with _tl_text (text; null: empty), _tl_ranges to remove, and _tl_again: it repeats another row's id and text."""
    # a hash tells the texts of one doc_id apart, where a doc_id is there more than once
    repeated = bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).collect())
    th = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    keyed = docs.withColumns({"_tl_id": F.col("doc_id"), "_tl_th": th, "_tl_text": F.coalesce("text", F.lit(""))})
    again = F.lit(False)
    if repeated:  # of rows that are alike in id and text, the one with the least number is the first
        numbered = materialise(keyed.withColumn("_tl_no", F.monotonically_increasing_id()), "suffix-rows")
        first = numbered.groupBy(F.col("_tl_id").alias("_tl_fid"), F.col("_tl_th").alias("_tl_fth")).agg(F.min("_tl_no").alias("_tl_first"))
        keyed = numbered.join(first, numbered["_tl_id"].eqNullSafe(first["_tl_fid"]) & (numbered["_tl_th"] == first["_tl_fth"]))
        again = F.col("_tl_no") != F.col("_tl_first")
    found = spans(keyed.select(F.col("_tl_id").alias("_id"), F.col("_tl_th").alias("_th"), F.col("_tl_text").alias("text")), length, seed, part, block)
    ranges = found.groupBy("_id", "_th").agg(F.collect_list(F.struct("start", "stop")).alias("_tl_ranges"))
    ranges = materialise(ranges.select(F.col("_id").alias("_tl_rid"), F.col("_th").alias("_tl_rth"), "_tl_ranges"), "suffix-spans")
    joined = keyed.join(ranges, keyed["_tl_id"].eqNullSafe(ranges["_tl_rid"]) & (keyed["_tl_th"] == ranges["_tl_rth"]), "left")
    return joined.withColumn("_tl_again", again)


def _given(raw: bytes, ranges, again: bool, length: int) -> list[tuple[int, int]]:
    return [(0, len(raw))] if again and len(raw) >= length else [(x["start"], x["stop"]) for x in ranges or ()]


def digests(docs: DataFrame, length: int = LENGTH, seed: int = SEED, part: int = PART, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 for every whole text of docs.

    Texts are UTF-8 bytes; null is empty. Strings are judged on the input and never cross documents. A null doc_id is
    smaller than any other. Rows that repeat a doc_id are ordered by a hash of their text; of rows that are alike in
    doc_id and text, one is the first. Other columns of docs are left out.
    """
    rows = _with_spans(docs.select("doc_id", "text"), length, seed, part, block).select("doc_id", "_tl_text", "_tl_ranges", "_tl_again")
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, ranges, again in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                raw = text.encode()
                merged, left = _remove(raw, _given(raw, ranges, again, length))
                for col, val in zip(out, (len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest())):
                    col.append(val)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def remove(docs: DataFrame, length: int = LENGTH, seed: int = SEED, part: int = PART, block: int = BLOCK) -> DataFrame:
    """docs with repeated strings cut out of text. A character goes only if all of its bytes go; null texts stay null.

    Every row stays, with an empty text if nothing of it is left. n_chars, if docs has it, is the new text's length.
    """
    names = docs.columns
    given = _with_spans(docs, length, seed, part, block).select(*names, "_tl_text", "_tl_ranges", "_tl_again")

    def run(batches):
        for b in batches:
            texts = []
            for text, ranges, again in zip(*(b.column(len(names) + k).to_pylist() for k in range(3))):
                raw = text.encode()
                merged, _ = _remove(raw, _given(raw, ranges, again, length))
                kept, at = [], 0
                for x, y in merged:
                    while x < len(raw) and 128 <= raw[x] < 192:  # into a character: it stays whole
                        x += 1
                    while y < len(raw) and 128 <= raw[y] < 192:
                        y -= 1
                    kept.append(raw[at:x])
                    at = max(x, y)
                texts.append(b"".join([*kept, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "_tl_new"])

    out = given.mapInArrow(run, StructType([*docs.schema.fields, StructField("_tl_new", StringType())]))
    new = {"text": F.when(F.col("text").isNotNull(), F.col("_tl_new"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length("_tl_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in names])
