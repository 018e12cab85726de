"""Byte-level BPE encoding and decoding with the vocabulary of a public tokenizer file.

Each piece of text that the vocabulary's pattern cuts is merged on a doubly linked list of symbols, with a priority
queue of merge ranks; entries whose symbols have changed since are skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

#: The pattern by which a ByteLevel pre-tokenizer with use_regex cuts text before the merges (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 64 << 20  # bytes of pieces, their ids and their text that a worker remembers, about


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_vocabulary(spark: SparkSession, path: str) -> dict:
    """The tokenizer file at `path` (any path Spark reads, or a file of the driver), as plain tables.

    Files of byte-level BPE alone: anything in them that would cut, change or merge text in another way is an error.
    """
    try:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
    except FileNotFoundError:
        whole = json.loads(spark.read.text(path, wholetext=True).first()[0])
    model = whole["model"]
    _check(whole)
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"path": path, "vocab": model["vocab"], "merges": pairs, "added": {t["content"]: t["id"] for t in whole["added_tokens"]}}


def _check(whole: dict) -> None:
    model, cut = whole["model"], whole.get("pre_tokenizer") or {}
    wrong = []
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        wrong.append("model")
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if (whole.get("decoder") or {}).get("type") != "ByteLevel":
        wrong.append("decoder")
    if whole.get("normalizer"):
        wrong.append("normalizer")
    if any(t.get(k) for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        wrong.append("added_tokens")
    if wrong:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(wrong)}")


class Codec:
    def __init__(self, tables: dict):
        symbol = byte_symbols()
        vocab = tables["vocab"]
        self.added = tables["added"]
        self.by_byte = [0] * 256
        for c, b in symbol.items():
            self.by_byte[b] = vocab[c]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(tables["merges"])}
        self.bytes = {i: bytes(symbol[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.cut = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.held = 0  # bytes in known, about

    def merged(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(data)
        sym = [self.by_byte[b] for b in data]
        prev, next_ = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, sym[i], sym[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((sym[i], sym[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = next_[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue  # stale: one of the two has been merged since
            sym[i], sym[j] = new, -1
            next_[i] = k = next_[j]
            if k >= 0:
                prev[k] = i
                if m := self.merge.get((new, sym[k])):
                    heapq.heappush(queue, (m[0], i, new, sym[k], m[1]))
            if (h := prev[i]) >= 0 and (m := self.merge.get((sym[h], new))):
                heapq.heappush(queue, (m[0], h, sym[h], new, m[1]))
        return [s for s in sym if s >= 0]

    def encode(self, text: str) -> list[int]:
        out = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(self.added[part])
            else:
                for piece in self.cut(part):
                    out += self.merged(piece.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def _piece(self, piece: str) -> tuple[int, str, bytes]:
        ids = [self.added[piece]] if piece in self.added else self.merged(piece.encode())
        got = (len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes.__getitem__, ids)))
        size = 250 + 4 * len(piece) + len(got[1]) + len(got[2])  # with what Python adds
        if size > CACHED // 16:
            return got
        if self.held + size > CACHED:
            self.known.clear()
            self.held = 0
        self.known[piece] = got
        self.held += size
        return got

    def both_ways(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, the ids joined by commas, and the decoded text; pieces seen before come from the cache."""
        known, make = self.known.get, self._piece
        got = []
        for part in self.special.split(text) if self.special else [text]:
            pieces = [part] if part in self.added else self.cut(part)
            got += [known(p) or make(p) for p in pieces]
        return sum(g[0] for g in got), ",".join([g[1] for g in got]), b"".join([g[2] for g in got]).decode("utf-8", "replace")


_built: dict[str, Codec] = {}


def _codec(given) -> Codec:
    """One codec for each vocabulary and worker process."""
    tables = given.value
    key = f"{tables['path']} {len(tables['vocab'])} {len(tables['merges'])}"
    if key not in _built:
        _built.clear()
        _built[key] = Codec(tables)
    return _built[key]


def encode(docs: DataFrame, vocabulary: dict, keys: list[str]) -> DataFrame:
    """The columns `keys` and ids (array of int) of every whole text; null and empty texts have no ids."""
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        codec = _codec(given)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [codec.encode(t or "") for t in part.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(ids, pa.list_(pa.int32()))], names=[*keys, "ids"])

    return docs.select(*keys, docs["text"].alias("_text")).mapInArrow(run, docs.select(*keys).schema.add("ids", ArrayType(IntegerType())))


def decode(coded: DataFrame, vocabulary: dict, keys: list[str]) -> DataFrame:
    """The columns `keys` and text: the vocabulary strings of ids, end to end; null and empty ids give the empty text."""
    given = coded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        codec = _codec(given)
        for b in batches:
            texts = [codec.decode(x or []) for x in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(texts, pa.string())], names=[*keys, "text"])

    return coded.select(*keys, coded["ids"].alias("_ids")).mapInArrow(run, coded.select(*keys).schema.add("text", "string"))


def digests(docs: DataFrame, vocabulary: dict, keys: list[str]) -> DataFrame:
    """The columns `keys`, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded again.

    A special token's string in a text is that token. Null counts as the empty text: no tokens, digests of nothing.
    Repeated rows each get their row; other columns of docs are left out.
    """
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = docs.select(*keys).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        codec = _codec(given)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n, ids, back = [], [], []
                for text in part.column(len(keys)).to_pylist():
                    count, joined, decoded = codec.both_ways(text or "")
                    n.append(count)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=schema.names)

    return docs.select(*keys, docs["text"].alias("_text")).mapInArrow(run, schema)
