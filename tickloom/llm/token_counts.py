"""Token counts by byte-level BPE, with many pieces of text merged side by side.

The pieces that a batch of texts is cut into are held end to end in one NumPy array of symbols. In each round every piece
looks up the ranks of its neighbouring symbols and merges its lowest-ranked pair wherever it stands; pieces without a pair
leave. The symbols that are left over are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Codec

NONE = np.iinfo(np.int32).max
CACHED = 64 << 20  # bytes of pieces and counts that a worker remembers, about
LONG = 1024  # bytes of a piece above which a queue of its pairs (bpe.Codec) takes less time than rounds over all of it
BATCH = 1 << 20  # bytes of pieces merged together


class Merger:
    """The merges of a vocabulary as sorted arrays: pair, rank, new symbol."""

    def __init__(self, codec: Codec):
        self.codec = codec
        made: dict[int, int] = {}
        for (a, b), (rank, new) in codec.merge.items():
            made[new] = min(rank, made.get(new, NONE))
        if any(max(made.get(a, -1), made.get(b, -1)) >= rank for (a, b), (rank, _) in codec.merge.items()):
            raise ValueError("a merge is ranked before one that makes its parts; pieces would not merge rank by rank")
        self.base = 1 + max(codec.bytes)
        pairs = sorted((a * self.base + b, rank, new) for (a, b), (rank, new) in codec.merge.items())
        table = np.array(pairs or [(-1, NONE, 0)], np.int64)
        self.pair, self.rank, self.new = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int64)
        self.by_byte = np.array(codec.by_byte, np.int64)
        self.known: dict[str, int] = {}
        self.held = 0

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each piece (none of them empty)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        symbol = self.by_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), size)
        same = np.r_[piece[:-1] == piece[1:], False] if len(piece) else np.zeros(0, bool)
        at, rank = self._looked_up(symbol, same, np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(symbol)])
            out[piece[first]] = length
            hit = (rank == np.repeat(least, length)) & (rank != NONE)
            # of equal symbols in a row, pairs merge from the left: every other place of a run of hits
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))
            merge = np.flatnonzero(hit & (run % 2 == 1))
            symbol[merge] = self.new[at[merge]]
            keep = np.repeat(least != NONE, length)
            keep[merge + 1] = False
            now = np.cumsum(keep) - 1
            symbol, piece, at, rank = symbol[keep], piece[keep], at[keep], rank[keep]
            # only a merged symbol and the one before it have new neighbours
            changed = np.zeros(len(piece), bool)
            changed[now[merge]] = True
            changed[:-1] |= changed[1:]
            fresh = np.flatnonzero(changed)
            same = np.zeros(len(piece), bool)
            same[:-1] = piece[:-1] == piece[1:]
            at[fresh], rank[fresh] = self._looked_up(symbol, same, fresh)
        return out

    def _looked_up(self, symbol: np.ndarray, same: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table and rank of the pairs that begin at `where`; rank NONE where there is no such pair."""
        key = symbol[where] * self.base + symbol[np.minimum(where + 1, len(symbol) - 1)]
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return at, np.where((self.pair[at] == key) & same[where], self.rank[at], NONE)

    def learn(self, pieces: set[str]) -> None:
        """Count pieces that are not known yet, in batches of bounded bytes."""
        if self.held > CACHED:
            self.known, self.held = {}, 0
        batch: list[str] = []
        bytes_in = 0

        def flush():
            self.known.update(zip(batch, self.counts([p.encode() for p in batch]).tolist()))
            batch.clear()

        for p in pieces:
            data = p.encode()
            self.held += 120 + len(data)
            if len(data) > LONG:
                self.known[p] = len(self.codec.merged(data))
                continue
            batch.append(p)
            bytes_in += len(data)
            if bytes_in >= BATCH:
                flush()
                bytes_in = 0
        if batch:
            flush()

    def tokens(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text; a special token's string in a text is one token."""
        codec = self.codec
        cut, added = codec.cut, codec.added
        fixed, pieces = [], []
        for text in texts:
            special, own = 0, []
            for part in codec.special.split(text) if codec.special else [text]:
                if part in added:
                    special += 1
                else:
                    own += cut(part)
            fixed.append(special)
            pieces.append(own)
        self.learn(set().union(*pieces) if self.held > CACHED else set().union(*pieces).difference(self.known))
        get = self.known.__getitem__
        return [s + sum(map(get, own)) for s, own in zip(fixed, pieces)]


_built: dict[str, Merger] = {}


def _merger(given) -> Merger:
    """One merger for each vocabulary and worker process."""
    tables = given.value
    key = f"{tables['path']} {len(tables['vocab'])} {len(tables['merges'])}"
    if key not in _built:
        _built.clear()
        _built[key] = Merger(Codec(tables))
    return _built[key]


def count(docs: DataFrame, vocabulary: dict, keys: list[str], limit: int = 512, step: int = 1 << 20) -> DataFrame:
    """The columns `keys`, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every whole text.

    A special token's string in a text is that token; none are added. Null counts as the empty text, which has no token.
    Texts are taken together up to `step` characters (one longer text goes alone). Repeated rows each get their row; other
    columns of docs are left out.
    """
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = docs.select(*keys).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        merger = _merger(given)
        for b in batches:
            texts = b.column(len(keys))
            size, n = [], []
            held, chars = [], 0
            for text in texts:
                text = text.as_py() or ""
                size.append(len(text.encode()))
                if held and chars + len(text) > step:
                    n += merger.tokens(held)
                    held, chars = [], 0
                held.append(text)
                chars += len(text)
            n += merger.tokens(held)
            over = [k > limit for k in n]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(over, pa.bool_())], names=schema.names)

    return docs.select(*keys, docs["text"].alias("_text")).mapInArrow(run, schema)
