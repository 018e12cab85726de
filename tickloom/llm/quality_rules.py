"""Quality rules as DataFrame expressions, in a cascade that is ordered by what a rule rejects for what it costs.

Everything on the main path is built-in functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5  # words in a window that may not repeat
#: Lines that begin with a bullet and a blank, and lines that end in dots, with a word in them.
BULLET = r"(?:^|(?<=\n))[\x20\x09]*[-*\u2022\u25CF\u25AA][\x20\x09]+[^\x20\x09-\x0D]"
BROKEN_OFF = r"(?:\.\.\.|\u2026)[\x20\x09\x0D]*(?=\n|$(?!\n))"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document fails where `rejects` is true, given the text, the MEASURES, n_lines and counts of characters by name.

    What a rule costs is estimated on a sample, from what it does there: `chars` for each character of a text that it reads,
    `words` for each word, and RUN for each match of the patterns `runs` that it takes out. The units are nanoseconds, fixed
    values from a run of each kind of step alone, so that the estimate does not hang on what else the machine does.
    """

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]
    chars: float
    words: float = 0.0
    runs: tuple[str, ...] = ()

    def cost(self, text: Column, n_words: Column) -> Column:
        matches = sum((F.regexp_count(text, F.lit(p)) for p in self.runs), F.lit(0))
        return F.lit(self.chars) * F.length(text) + F.lit(self.words) * n_words + F.lit(RUN) * matches


RUN = 60.0  # to find a match and leave it out of a copy of the text
#: The first two are the base. The limits are fixed values: symbols per word, share of repeated lines, of lines with a bullet
#: and of lines that break off, mean word length as in published web-text filters; shouted and exclaimed words,
#: and table bars, as shares of all words.
BASE = (
    Rule("few_words", lambda m: m["n_words"] < 10, 0.0, 0.1),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"], 0.0, 600.0),
)
RULES = (
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"], 9.0),
    Rule("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"], 4.0),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]), 9.0),
    Rule("exclaimed", lambda m: 10 * m["n_exclaimed"] > 3 * m["n_words"], 1.0),
    Rule("capitals", lambda m: m["n_capitals"] > 2 * m["n_small"] + 20, 10.0, runs=("[A-Z]+", "[a-z]+")),
    Rule("few_letters", lambda m: 2 * m["n_letters"] < m["word_chars"], 10.0, runs=(r"\p{L}+",)),
    Rule("bullets", lambda m: (m["n_lines"] > 1) & (10 * m["n_bullets"] > 9 * m["n_lines"]), 6.0, runs=("\n",)),
    Rule("broken_off", lambda m: (m["n_lines"] > 1) & (10 * m["n_broken_off"] > 3 * m["n_lines"]), 6.0, runs=("\n",)),
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument, where a repeated expression would be computed again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are computed once a row.

    They are generated from an array of one struct: the optimiser moves neither a later filter nor a later expression
    below a generator, where it would compute them again, once for each element inside a lambda.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _without(text: Column, pattern: str) -> Column:
    """Characters of text that the pattern takes away."""
    return F.length(text) - F.length(F.regexp_replace(text, F.lit(pattern), F.lit("")))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _repeated_words(w: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text has twice or more.

    Hashes of windows tell whether any can be there twice; such windows are then compared as they are written.
    """
    n = F.size(w) - WINDOW + 1  # windows

    def joined(a: Column, b: Column, step: int) -> Column:
        return F.zip_with(a, F.slice(b, F.lit(step + 1), F.size(b)), lambda x, y: F.xxhash64(x, y))

    one = F.transform(w, lambda x: F.xxhash64(x))
    hashes = _let(one, lambda h1: _let(joined(h1, h1, 1), lambda h2: F.slice(joined(joined(h2, h2, 2), h1, 4), F.lit(1), n)))

    def run_lengths(pairs: Column) -> Column:
        """Words covered by the windows of pairs (key, place), sorted, whose key is there twice."""
        twice = _let(pairs, lambda s: F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["k"] == e["k"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["k"] == e["k"], F.lit(False))))
        where = F.sort_array(F.transform(twice, lambda e: e["i"]))
        steps = _let(where, lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - x), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        alike = _let(pairs, lambda s: F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))))
        written = F.transform(alike, lambda e: F.struct(F.array_join(F.slice(w, e["i"] + 1, F.lit(WINDOW)), " ").alias("k"), e["i"].alias("i")))
        return run_lengths(F.sort_array(written))

    some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(n > 1, some).otherwise(0).cast("long")


class _Measured(Mapping):
    """Expressions by name over a text and its words; only what is asked for becomes part of a plan."""

    def __init__(self, text: Column, words: Column):
        t = text
        self.made = {
            "text": lambda: t,
            "n_words": lambda: F.size(words).cast("long"),
            "word_chars": lambda: F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": lambda: (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": lambda: _let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_lines": lambda: F.size(_lines(t)).cast("long"),
            "n_repeat_words": lambda: _repeated_words(words),
            "n_exclaimed": lambda: F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
            "n_capitals": lambda: _without(t, "[A-Z]+"),
            "n_small": lambda: _without(t, "[a-z]+"),
            "n_letters": lambda: _without(t, r"\p{L}+"),
            "n_bullets": lambda: F.regexp_count(t, F.lit(BULLET)),
            "n_broken_off": lambda: F.regexp_count(t, F.lit(BROKEN_OFF)),
        }

    def __getitem__(self, name: str) -> Column:
        return self.made[name]()

    def __iter__(self):
        return iter(self.made)

    def __len__(self):
        return len(self.made)


def _columns(text: Column) -> Mapping[str, Column]:
    """The names a rule may use, where measure() has made columns of the MEASURES and n_lines."""
    return {**_Measured(text, F.array()), **{c: F.col(c) for c in (*MEASURES, "n_lines")}}


def measure(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The columns `keys` (none of them named like a result), text, and of every whole text: n_lines, the five MEASURES and base_failed."""
    cut = _once(docs.select(*keys, F.coalesce(F.col("text"), F.lit("")).alias("text")), _w=_words(F.col("text")), _lines=_lines(F.col("text")))
    of = _Measured(F.col("text"), F.col("_w"))
    lines = {"n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_lines": F.size("_lines").cast("long")}
    counted = _once(cut, **{c: of[c] for c in MEASURES if c not in lines}, **lines).drop("_w", "_lines")
    return counted.withColumn("base_failed", BASE[0].rejects(_columns(F.col("text"))) | BASE[1].rejects(_columns(F.col("text"))))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = 2000, after: tuple[Rule, ...] = BASE) -> list[Rule]:
    """Rules by rejections for a unit of cost, the best first, measured on a sample of about `rows` rows.

    A rule's rejections are those among the sampled rows that neither `after` nor the rules before it reject, and its cost
    is what it does to these rows. Texts are chosen by their hash and stand for all rows that have them, so that a table
    gives one order, however it lies in files and partitions; ties go to the rule given first. The order only decides how
    soon a bad document is known to be bad; the verdict is the same in any order. Reading the texts for their hash is one
    more scan; what comes to the driver is one row for each set of rules that reject together.
    """
    n = docs.count()
    fine = 1 << 40
    chosen = F.pmod(F.xxhash64("text"), F.lit(fine)) < min(fine, -(-rows * fine // n)) if n else F.lit(True)
    part = docs.select("text").where(chosen).groupBy("text").agg(F.count("*").alias("n"))
    every = (*after, *rules)
    measured = measure(part, ["n"])
    names = _columns(F.col("text"))
    failed = F.array(*[r.rejects(names) for r in every]).alias("failed")
    costs = F.array(*[r.cost(F.col("text"), F.col("n_words")) for r in rules]).alias("costs")
    summed = [F.sum(F.col("n") * F.col("costs")[i]).alias(f"c{i}") for i in range(len(rules))]
    found = measured.select(failed, costs, "n").groupBy("failed").agg(F.sum("n").alias("n"), *summed).collect()
    left = [(r["failed"][len(after) :], r["n"], [round(r[f"c{i}"], 3) for i in range(len(rules))]) for r in sorted(found, key=lambda r: r["failed"]) if not any(r["failed"][: len(after)])]
    waiting, out = list(range(len(rules))), []
    while waiting:

        def worth(i: int) -> float:
            return sum(x[1] for x in left if x[0][i]) / (sum(x[2][i] for x in left) + 1e-9)

        cost = {i: sum(x[2][i] for x in left) for i in waiting}
        best = max(waiting, key=lambda i: (worth(i), -cost[i], -i))
        out.append(rules[best])
        waiting.remove(best)
        left = [x for x in left if not x[0][best]]
    return out


def judge(docs: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES, ordered: list[Rule] | None = None) -> DataFrame:
    """The columns `keys` of docs, the five MEASURES, base_failed, failed_rule and kept, for every whole text.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. kept: not base_failed and no rule
    rejects. The rules form one CASE, so that a row stops at the first that rejects it; failed_rule names it (null where
    none did, `base` where the base failed). A null text counts as empty: zeros, base_failed. Ties and repeated rows are
    judged alike; a null among the keys stays; other columns of docs are left out.
    """
    if ordered is None:
        ordered = order_rules(docs.select("text"), rules)
    rows = measure(docs, keys)
    verdict = F.when(F.col("base_failed"), "base")
    for rule in ordered:
        verdict = verdict.when(rule.rejects(_columns(F.col("text"))), rule.name)
    return rows.withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull()).select(*keys, *MEASURES, "base_failed", "kept", "failed_rule")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ordered: list[Rule] | None = None) -> DataFrame:
    """docs without the rows that judge() does not keep: a filter over the text, where a row stops at its first rejection.

    No measure is made before a rule asks for it, and the base's rules take their place among the others.
    """
    every = (*BASE, *rules)
    if ordered is None:
        ordered = order_rules(docs.select("text"), every, after=())
    text = F.coalesce(docs["text"], F.lit(""))

    def passed(t: Column, w: Column) -> Column:
        names = _Measured(t, w)
        out = None
        for rule in ordered:
            out = F.when(rule.rejects(names), F.lit(False)) if out is None else out.when(rule.rejects(names), F.lit(False))
        return out.otherwise(F.lit(True))

    return docs.where(_let(F.struct(text.alias("t"), _words(text).alias("w")), lambda x: passed(x["t"], x["w"])))
