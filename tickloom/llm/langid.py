"""Language identification by cross-parsing entropy.

A suffix automaton per language, built over a bounded sample of labelled text, gives the longest match at any point of a
text. Cutting a text greedily into longest matches needs few phrases where the language is the same and many where it
isn't; the language with the fewest phrases, times the bits that point at a place in its sample, wins.

All texts are parsed side by side, in blocks. A block is first parsed as if a phrase began with it; then the phrase that
runs into it from the block before is followed, until it ends where a phrase of the first parse begins: from there on
both are the same. So phrases are the whole text's, wherever blocks are cut.

A state of an automaton has one way out or few, so its transitions are packed into one array for all states: each state
has an offset, at which the place of a byte holds the next state and, as a check, the state that it belongs to. That takes
some 40 bytes for each byte of a sample, whatever bytes there are.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import slices

BLOCK = 1024  # bytes of a text that are parsed beside others

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_KEEP[65:91] = np.arange(97, 123)


def learn(docs: DataFrame, texts_per_language: int = 64, bytes_per_language: int = 48_000) -> dict[str, bytes]:
    """Training text per language, from labelled rows (columns doc_id, text, lang).

    The bounds, of each label by itself: texts_per_language texts, by hash order of doc_id, and bytes_per_language bytes,
    which are spread over these texts: each gives a stretch from a place that its hash chooses. Null labels, and texts that
    are null or have no letter, teach nothing. Without any usable row the result is empty. Labels are languages: what the
    driver and a worker hold grows with their number, 48 kB of text and 2 MB of packed automaton for each.
    """
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return {}
    share = {r["lang"]: min(1.0, 4.0 * texts_per_language / r["count"]) for r in counts}
    most = bytes_per_language
    longest = 4 * -(-most // texts_per_language)  # characters of a stretch; what short texts leave is filled from longer ones
    room = F.greatest(F.length("text") - longest + 1, F.lit(1))
    few = (
        rows.withColumn("_h", F.xxhash64("doc_id"))
        .where((F.pmod("_h", F.lit(1_000_003)) / 1_000_003.0) < F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang")))
        .select("lang", "_h", F.lower(F.substring("text", (1 + F.pmod(F.xxhash64("_h"), room)).cast("int"), F.lit(longest))).alias("text"))
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))
    got: dict[str, list[bytes]] = {}
    for r in few.withColumn("_n", nth).where(F.col("_n") <= texts_per_language).orderBy("lang", "_n").toLocalIterator():
        got.setdefault(r["lang"], []).append(_KEEP[np.frombuffer(r["text"].encode(), np.uint8)].tobytes())
    return {k: _shared(v, most) for k, v in got.items()}


def _shared(texts: list[bytes], most: int) -> bytes:
    """The texts' beginnings end to end, of equal length but for shorter texts, `most` bytes at most."""
    left, out = most, []
    for k, size in enumerate(sorted(map(len, texts))):
        part = left // (len(texts) - k)
        if size + 1 > part:
            out = [t[: max(part - 1, 0)] for t in texts]
            break
        left -= size + 1
    return b" ".join(out or texts)


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of text; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


class Packed:
    """An automaton's transitions in one array. State 0 has none, state 1 is the start."""

    def __init__(self, base: np.ndarray, owner: np.ndarray, next_: np.ndarray, width: int):
        self.base, self.owner, self.next = base, owner, next_
        self.opening = self.step(np.full(width, 1), np.arange(width))

    @classmethod
    def of(cls, go: list[dict[int, int]], code: np.ndarray, width: int) -> Packed:
        ways = np.fromiter(map(len, go), np.int64, len(go))
        base = np.zeros(len(go) + 1, np.int32)
        # states with several ways, the most first, each at an offset not far from the last where all its places are free
        taken = bytearray(2 * width)
        taken[:width] = b"\x01" * width  # offset 0 belongs to state 0 alone
        near, several = width, []
        for state in np.argsort(-ways, kind="stable")[: int((ways > 1).sum())].tolist():
            codes = code[list(go[state])].tolist()
            first = min(codes)
            at = near - first
            while any(taken[at + c] for c in codes):
                at += 1
                if at + width >= len(taken):
                    taken.extend(bytes(len(taken)))
            for c in codes:
                taken[at + c] = 1
            near += (at + first - near) // 8
            several.append((state, at, codes))
        free = np.frombuffer(taken, np.uint8) == 0
        owner, next_ = np.full(len(free), -1, np.int32), np.zeros(len(free), np.int32)
        for state, at, codes in several:
            base[state + 1] = at
            owner[np.asarray(codes) + at] = state + 1
            next_[np.asarray(codes) + at] = np.fromiter(go[state].values(), np.int64, len(codes)) + 1
        # states with one way take what is left, in order
        single = np.flatnonzero(ways == 1)
        spots = np.flatnonzero(free)
        if len(spots) < len(single):
            more = len(single) - len(spots)
            spots = np.r_[spots, len(free) + np.arange(more)]
            owner, next_ = np.r_[owner, np.full(more, -1, np.int32)], np.r_[next_, np.zeros(more, np.int32)]
        spots = spots[: len(single)]
        byte, to = (np.fromiter((x for s in single.tolist() for x in pick(go[s])), np.int32, len(single)) for pick in (dict.keys, dict.values))
        base[single + 1] = spots - code[byte]
        owner[spots], next_[spots] = single + 1, to + 1
        used = int(np.flatnonzero(owner >= 0).max(initial=0)) + 1
        pad = np.full(2 * width, -1, np.int32)  # a state's places end beyond its last transition
        return cls(base, np.r_[owner[:used], pad], np.r_[next_[:used], np.zeros(2 * width, np.int32)], width)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states that the states go to with the bytes; 0 where there is no such transition."""
        at = self.base[state] + code
        return np.where(self.owner[at] == state, self.next[at], 0)

    def size(self) -> int:
        return self.base.nbytes + self.owner.nbytes + self.next.nbytes


def alphabet(texts: dict[str, bytes]) -> tuple[np.ndarray, int]:
    """A code for each byte, and their number. Code 0: a byte that no sample has; the last: padding."""
    seen = sorted(set().union(*texts.values()))
    code = np.zeros(256, np.int32)
    code[seen] = np.arange(1, len(seen) + 1)
    return code, len(seen) + 2


def pack(spark: SparkSession, texts: dict[str, bytes]) -> dict[str, tuple[bytes, bytes, bytes]]:
    """The packed automaton of each sample, built by a task for each language."""
    code, width = alphabet(texts)

    def build(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                made = Packed.of(suffix_automaton(text), code, width)
                parts = [pa.array([x.tobytes()], pa.binary()) for x in (made.base, made.owner, made.next)]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), *parts], names=["lang", "base", "owner", "next"])

    rows = spark.createDataFrame(pa.table({"lang": pa.array(list(texts), pa.string()), "text": pa.array(list(texts.values()), pa.binary())}))
    built = rows.repartition(max(1, len(texts)), "lang").mapInArrow(build, "lang string, base binary, owner binary, next binary")
    return {r["lang"]: (bytes(r["base"]), bytes(r["owner"]), bytes(r["next"])) for r in built.toLocalIterator()}


class Parser:
    """The automata of all languages: one numpy step moves every block of every text by one byte."""

    def __init__(self, texts: dict[str, bytes], packed: dict[str, tuple[bytes, bytes, bytes]] | None = None):
        self.langs = sorted(texts)
        self.code, self.width = alphabet(texts)
        if packed is None:
            self.tables = [Packed.of(suffix_automaton(texts[lang]), self.code, self.width) for lang in self.langs]
        else:
            self.tables = [Packed(*(np.frombuffer(x, np.int32) for x in packed[lang]), self.width) for lang in self.langs]
        self.bits = [np.log2(len(texts[lang]) + 1) for lang in self.langs]

    def phrases(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Phrases, times their bits, of each text (rows) under each language (columns)."""
        n, size = len(offs) - 1, np.diff(offs)
        out = np.zeros((n, len(self.langs)))
        per = -(-size // BLOCK)
        doc = np.repeat(np.arange(n), per)
        if not len(doc):
            return out
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = offs[doc] + nth * BLOCK
        left = np.minimum(offs[doc + 1] - start, BLOCK)
        codes = self.code[_KEEP[buf]]
        pad = self.width - 1
        grid = np.full((int(left.max()), len(doc)), pad, np.int32)
        for k in range(len(grid)):
            on = left > k
            grid[k, on] = codes[start[on] + k]
        inner = np.flatnonzero(nth > 0)  # blocks that another of the same text comes before
        real = grid != pad
        for i, table in enumerate(self.tables):
            begins, state = self._parse(table, grid)
            count = (begins & real).sum(0) + self._carried(table, grid, left, begins, state, inner)
            out[:, i] = np.bincount(doc, count, n) * self.bits[i]
        return out

    def _parse(self, table: Packed, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of blocks (columns) that begin with a phrase: where phrases begin, and the state after the last byte.

        State 0 has no transition, so that a phrase begins after it; a byte that no sample has leads there.
        """
        opened = table.opening[grid]  # the state that a phrase's first byte leads to
        state = np.zeros(grid.shape[1], np.int32)
        begins = np.empty(grid.shape, bool)
        for k, c in enumerate(grid):
            to = table.step(state, c)
            new = np.equal(to, 0, out=begins[k])
            state = np.where(new, opened[k], to)
        return begins, state

    def _carried(self, table: Packed, grid: np.ndarray, left: np.ndarray, begins: np.ndarray, end: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """How many phrases fewer or more each block has if the one before it runs on into it; `end` is brought up to date."""
        opening = table.opening
        change, alone = np.zeros(grid.shape[1], np.int64), end.copy()
        is_inner = np.zeros(grid.shape[1] + 1, bool)
        is_inner[blocks] = True
        while len(blocks):
            at, state = blocks, end[blocks - 1]
            change[at] = 0
            apart: list[np.ndarray] = []
            for k in range(len(grid)):
                done = left[at] <= k  # still another parse at the block's end
                if done.any():
                    apart.append(at[done & (end[at] != state)])
                    end[at[done]] = state[done]
                    at, state = at[~done], state[~done]
                if not len(at):
                    break
                c, first = grid[k, at], begins[k, at]
                to = table.step(state, c)
                new = to == 0
                change[at] += new.astype(np.int64) - first
                same = new & first
                if same.any():
                    joined = at[same]  # from here on as in the first parse
                    apart.append(joined[end[joined] != alone[joined]])
                    end[joined] = alone[joined]
                    on = ~same
                    at, c, to, new = at[on], c[on], to[on], new[on]
                state = np.where(new, opening[c], to)
            apart.append(at[end[at] != state])
            end[at] = state
            # a block after one that ends in another state than before is followed again
            blocks = np.sort(np.concatenate(apart)) + 1
            blocks = blocks[is_inner[blocks]]
        return change


_built: dict[str, Parser] = {}


def _parser(given) -> Parser:
    """One parser for each sample and worker process."""
    key, texts, packed = given.value
    if key not in _built:
        _built.clear()
        _built[key] = Parser(texts, packed)
    return _built[key]


def identify(docs: DataFrame, sample: dict[str, bytes], keys: list[str]) -> DataFrame:
    """The columns `keys` of docs, with lang_pred and score, from the column text alone.

    lang_pred is a language of the sample, or `und` where the text is null or has no letter, or the sample is empty;
    score (0 to 1) is the runner-up's share of both costs (0.5: a tie, 1: only one language known, 0: `und`). Equal
    costs go to the first language by name. Repeated rows each get their row; other columns of docs are left out.
    """
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((uuid.uuid4().hex, sample, pack(spark, sample) if sample else {}))
    asked = docs.select(*keys, F.lower("text").alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = docs.select(*keys).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        parser = _parser(given)
        for rows, buf, offs in slices(batches, "_text", 4 << 20):
            known = np.asarray(rows.column(len(keys) + 1).to_pylist(), bool) & bool(parser.langs)
            lang, score = np.full(rows.num_rows, "und", object), np.zeros(rows.num_rows)
            if parser.langs:
                cost = parser.phrases(buf, offs)
                best = cost.argmin(1)
                low = cost[np.arange(len(best)), best]
                cost[np.arange(len(best)), best] = np.inf
                next_ = cost.min(1) if cost.shape[1] > 1 else np.full(len(best), np.inf)
                with np.errstate(invalid="ignore", divide="ignore"):
                    sure = np.where(np.isinf(next_), 1.0, next_ / (low + next_))
                lang = np.where(known, np.asarray(parser.langs, object)[best], "und")
                score = np.where(known, np.nan_to_num(sure, nan=0.5), 0.0)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keys, "lang_pred", "score"])

    return asked.mapInArrow(run, schema)
