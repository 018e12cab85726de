import re

import pytest
from pyspark.sql import functions as F

from tickloom.llm import quality_rules as q

from .conftest import SCHEMA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p + k for ps in seen.values() if len(ps) > 1 for p in ps for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, chars, symbols, dup, rep = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
    base = n < 10 or 100 * rep > 20 * n
    upper, lower = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
    letters = sum(c.isalpha() for c in t)
    bad = 10 * symbols > 3 * n or 10 * dup > 3 * len(lines) or chars < 2 * n or chars > 15 * n or 10 * t.count("!") > 3 * n or upper > 2 * lower + 20 or 2 * letters < chars
    bullets = sum(bool(re.match(r"[ \t]*[-*\u2022\u25CF\u25AA][ \t]+[^ \t-\r]", x)) for x in lines)
    broken = sum(bool(re.search(r"(\.\.\.|\u2026)[ \t\r]*\Z", x)) for x in lines)
    bad = bad or (len(lines) > 1 and (10 * bullets > 9 * len(lines) or 10 * broken > 3 * len(lines)))
    return n, chars, symbols, dup, rep, base, not (base or bad)


ODD = ["a b c d e " * 5, "one two three four five six seven eight nine ten eleven", "X!! " * 30, "SHOUT OUT " * 12 + "abc", "a | b | c | d | e | f | g | h", "\x1c\x1d word" * 3, "l1 l2 l3\n" * 6, "é ñ ü " * 9, "\t\n\x0b\x0c\r ", "12 34 56 78 90 11 22 33 44 55 66", "a b c d e f a b c d e g a b c d e"]
LISTS = ["- one two three\n* four five six\n \u2022 seven eight\n\n- nine ten eleven", "- one two three four\nfive six seven eight\n- nine ten eleven", "-one two three\n-four five six\n-seven eight nine ten eleven", "one two three...\nfour five six\u2026 \r\nseven eight nine ten eleven twelve", "one two three four five six seven eight nine ten eleven...", "one two...\nthree four\nfive six\nseven eight nine\nten eleven twelve...more"]
LISTS += ["tel 5551234567 and fax 5557654321 and more text goes here in words", "word " * 12 + "...", "word other third fourth fifth\nsixth seventh eighth ninth tenth...\n\n"]
ODD += LISTS


def test_against_brute_force(spark, corpus):
    texts = corpus + ODD
    df = spark.createDataFrame(rows(texts), SCHEMA).withColumn("n_words", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in (*q.MEASURES, "base_failed", "kept")) for r in q.judge(df, ["doc_id"]).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_order_does_not_matter(spark, docs):
    a = q.judge(docs, ["doc_id"], ordered=list(q.RULES)).select("doc_id", "kept").collect()
    b = q.judge(docs, ["doc_id"], ordered=list(reversed(q.RULES))).select("doc_id", "kept").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert set(q.order_rules(docs)) == set(q.RULES)


def test_cascade_is_the_same_each_time_and_counts_what_is_left(spark):
    bad = ["one two three! four! five! six! seven! eight! nine! ten!", "* # one * # two * # three * # four * # five six seven eight nine ten"]
    df = spark.createDataFrame(rows([bad[0]] * 30 + [bad[1]] * 5 + ["plain words and no more than that in this very short text"] * 30), SCHEMA).repartition(3)
    exclaimed, symbols = (next(r for r in q.RULES if r.name == n) for n in ("exclaimed", "symbols"))
    shadow = q.Rule("shadow", exclaimed.rejects, exclaimed.chars * 1.5)  # rejects nothing that exclaimed leaves
    orders = [[r.name for r in q.order_rules(df, (shadow, symbols, exclaimed))] for _ in range(3)]
    assert orders == [["exclaimed", "symbols", "shadow"]] * 3


def test_one_table_has_one_order(spark, corpus):
    texts = (corpus + ODD) * 3 + [f"{k} plain words {k} that no rule rejects, a few of them" for k in range(300)]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    orders = {tuple(r.name for r in q.order_rules(x, rows=60)) for x in (df.coalesce(1), df.repartition(4), df.repartition(16, "doc_id"), df.orderBy(F.desc("doc_id")))}
    assert len(orders) == 1 and len(orders.pop()) == len(q.RULES)


def test_cost_is_what_a_rule_does_to_the_sample(spark):
    df = spark.createDataFrame([("ab CD ef 12", 4), ("", 0)], "text string, n long")
    rule = q.Rule("x", lambda m: F.lit(True), 2.0, 3.0, ("[a-z]+", "[0-9]+"))
    assert [r[0] for r in df.select(rule.cost(F.col("text"), F.col("n"))).collect()] == [2.0 * 11 + 3.0 * 4 + q.RUN * 3, 0.0]


def test_null_key_stays(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in q.judge(df, ["doc_id"]).collect()] == [None, None]
    assert q.keep(df).count() == 0


def test_plan_is_native(spark, docs):
    for df in (q.judge(docs, ["doc_id"], ordered=list(q.RULES)), q.keep(docs, ordered=[*q.BASE, *q.RULES])):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_keep_and_empty(spark, docs, corpus):
    docs, corpus = spark.createDataFrame(rows(corpus + ODD), SCHEMA), corpus + ODD
    extra = docs.withColumn("kept", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("n_words", F.lit(3))
    kept = q.keep(extra)
    assert kept.columns == extra.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(corpus) if brute(t)[-1]}
    assert q.judge(docs.limit(0), ["doc_id"]).count() == 0
    assert q.keep(docs.limit(0)).count() == 0
