"""Helpers that several text operators share: tables in the shared folder, Arrow slices, vectorised words."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: dict[int, str] = {}  # the path of each table that materialise() gave, as long as it is there


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir). Only a local session may go without one."""
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="tickloom-")
    return f"file://{_own_dir}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")  # the shuffle files behind df are of no more use once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    weakref.finalize(out, _written.pop, id(out), None)
    return out


def discard(table: DataFrame) -> None:
    """Delete what materialise() wrote. Only for tables that nothing not yet written itself is made from."""
    path = _written.pop(id(table))
    jvm = table.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32(doc_id as text) mod modulus is remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % modulus == remainder, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with at most `limit` bytes of text (one longer text goes alone).

    Yields the rows, the texts' UTF-8 bytes end to end, and the n+1 offsets of the texts; null is the empty text.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).cast(pa.large_string()).fill_null("")
        if not len(texts):
            continue
        offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


# ---- words, and hashes of any byte range, for a whole slice at once

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(max(n, 1 << 20), _BASE if kind == "up" else _INVERSE, np.uint64)
        base[0] = 1
        _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash() gives the hash of any range of buf."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power("up", len(buf)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); equal bytes give equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _power("down", len(prefix))[start])


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word ([^\\x20\\x09-\\x0D]+) of texts that lie end to end in buf."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    end[:-1] &= ~solid[1:] | first[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offs, s, "right") - 1


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and the number of each run's first word; runs stay inside one text."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    out = h[at].copy()
    for k in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[at + k]
    return mix(out), at
