"""The registered queries of this folder: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, licenses, pairwise_quality, prefix_trie, quality_rules, sharding, simhash, spelling, suffix_dedup, token_counts, toxicity
from ._common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """The tokenizer file: TICKLOOM_BPE, or else the installed public one."""
    if given := os.environ.get("TICKLOOM_BPE"):
        return given
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    sample = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs, sample, ["doc_id", "held_out"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), ["doc_id"]).drop("failed_rule")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    labels = _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4, 2))
    features = pairwise_quality.featured(docs, ["doc_id", "held_out"])
    ranking = pairwise_quality.learn_from(features, labels)
    return pairwise_quality.score_from(features, ranking, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), bpe.read_vocabulary(spark, vocabulary_path()), ["doc_id"])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    labels = _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    model = toxicity.learn(docs, labels)
    return toxicity.score(docs, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefixes(_table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"), bpe.read_vocabulary(spark, vocabulary_path()), ["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_language_id, op2_quality_rules, op3_simhash_dedup, op4_decontamination, op5_quality_classifier, op6_suffix_dedup, op7_license_scan, op8_bpe, op9_sharding, op10_toxicity, op11_spelling_variants, op12_prefix_trie, op13_token_counts, pipeline)
    return {f.__name__: f for f in ops}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
with w as (
  select doc_id, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    row_number() over () as r
  from documents),
windows as (
  select r, i, list_slice(w, i, i + 4) as g from (select r, w, unnest(range(1, greatest(len(w) - 3, 1))) as i from w)),
twice as (
  select r, unnest(range(i, i + 5)) as p from (select r, i, count(*) over (partition by r, g) as n from windows) where n > 1),
repeated as (select r, count(distinct p) as n from twice group by r),
base as (
  select doc_id, t, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(repeated.n, 0)::bigint as n_repeat_words, len(lines) as n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}\x{{25CF}}\x{{25AA}}][\x20\x09]+[^\x20\x09-\x0D]'))) as n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09\x0D]*$'))) as n_broken_off
  from w left join repeated using (r)),
judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 3 * n_words or 10 * n_dup_lines > 3 * n_lines
    or word_chars < 2 * n_words or word_chars > 15 * n_words
    or 10 * (length(t) - length(replace(t, '!', ''))) > 3 * n_words
    or length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(regexp_replace(t, '[^a-z]', '', 'g')) + 20
    or 2 * (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g'))) < word_chars
    or n_lines > 1 and 10 * n_bullets > 9 * n_lines
    or n_lines > 1 and 10 * n_broken_off > 3 * n_lines) as kept
from judged"""

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = rf"""
with item as (select distinct item_id, {_WORDS.format(_ASCII_LOWER.format("text"))} as w from benchmark where text is not null),
sized as (select item_id, w, least(5, len(w)) as n from item where len(w) > 0),
wanted as (select distinct item_id, w, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) as g from sized),
total as (select item_id, w, count(*) as n_shingles from wanted group by item_id, w),
doc as (select row_number() over () as r, doc_id, {_WORDS.format(_ASCII_LOWER.format("text"))} as w from documents where text is not null),
size as (select distinct n from sized),
has as (select distinct r, doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) as g from doc, size where len(w) >= n),
shared as (select r, doc_id, item_id, w, count(*) as n_shared from has join wanted using (n, g) group by r, doc_id, item_id, w)
select doc_id, item_id, n_shingles::bigint as n_shingles, n_shared::bigint as n_shared, n_shared / n_shingles as containment
from shared join total using (item_id, w) where n_shared >= ceil(0.8 * n_shingles)"""


def _op7() -> str:
    rows = ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}')" for k, t in licenses.TEMPLATES.items())
    clean = "regexp_replace({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]', ' ', 'g')"
    part = clean.format(_ASCII_LOWER.format("x"))
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    split = "regexp_extract_all({}, '[^ ]+')"
    return f"""
with template as (select k as license_id, {pairs} as b from (select k, {split.format(clean.format(_ASCII_LOWER.format("t")))} as w from (values {rows}) v(k, t))),
parts as (
  select doc_id, unnest(string_split(text, chr(10))) as x from documents
  union all select doc_id, text from documents where contains(text, chr(10))),
own as (select row_number() over () as r, doc_id, {pairs} as b from (select doc_id, {split.format(part)} as w from parts) where len(w) > 1),
bigram as (select r, unnest(b) as g from own),
shared as (
  select r, license_id, count(*) as n from bigram join (select license_id, unnest(b) as g from template) using (g) group by r, license_id),
dice as (
  select r, own.doc_id, license_id, 2 * n / (len(own.b) + len(template.b)) as d from shared join own using (r) join template using (license_id)),
best as (select *, max(d) over (partition by r) as top from dice)
select doc_id, license_id, max(d) as dice, count(*) as n_parts from best where d = top and d >= {licenses.THRESHOLD} group by doc_id, license_id"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in SQL, four bits a step."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    # low half of each byte before its high half
    halves = f"list_transform(range(octet_length(encode({text})) * 2), lambda i: ('0x' || substr(hex(encode({text})), (i + 2 - 2 * (i % 2))::int, 1))::int::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {halves}), lambda c, n: xor(c >> 4, ({table}::bigint[])[(xor(c, n) & 15) + 1])), 4294967295::bigint)"


_OP11 = rf"""
with recursive run as (
  select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) as r from documents),
own as (select d, r, count(*) as n from run where length(r) >= 6 group by d, r),
hashed as (select r, n, {_crc32("d || ':' || r")} as h from own),
changed as (select n, case when h % 199 = 0 then left(r, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word from hashed),
words as (select word, sum(n)::bigint as n from changed where length(word) >= 6 group by word having sum(n) >= 5),
gap as (select word, n, i, left(word, i::int - 1) || ' ' || substr(word, i::int + 1) as g from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pair as (
  select a.word as a, b.word as b, b.n as bn from gap a join gap b using (g) where a.word <> b.word
  union select gap.word, words.word, words.n from gap join words on words.word = replace(g, ' ', '')
  union select words.word, gap.word, gap.n from gap join words on words.word = replace(g, ' ', '')),
near as (select a as word, count(*) as n_near, first(b order by bn desc, b) as best, max(bn) as best_n from pair group by a),
formed as (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= 5 * n then best end as form, case when best_n >= 5 * n then best_n end as form_n
  from words left join near using (word)),
chain as (
  select word, coalesce(form, word) as root, form is null as done from formed
  union all select chain.word, coalesce(formed.form, chain.root), formed.form is null from chain join formed on formed.word = chain.root where not done)
select formed.*, root from formed join (select word, root from chain where done) using (word)"""

_OP12 = f"""
with turns as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
    row_number() over (partition by conv_id order by turn nulls first, left(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 32), octet_length(encode(coalesce(text, '')))) as p
  from conversations where conv_id is not null),
conv as (select c, count(*) as n, {_crc32("c::varchar")} % 9 as h from turns group by c),
seq as (
  select conv.c, h, 0 as own, p, r, x from conv join turns on turns.c = conv.c - conv.c % 5 and p <= h
  union all select conv.c, h, 1, p, r, x from conv join turns on turns.c = conv.c and p > h),
path as (
  select conv.c, coalesce(s, []) as s from conv
  left join (select c, list({{'r': r, 'x': x}} order by own, p) as s from seq group by c) using (c)),
prefix as (select c, s, unnest(range(0, len(s) + 1)) as d from path),
member as (select c, d, len(s) as whole, s[1:d] as k, s[1:d - 1] as up from prefix),
node as (
  select k, d, min(c) as conv_id, count(*) as n_convs, any_value(up) as up,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (whole = d), '')) as ends_sha256
  from member group by k, d),
kids as (select up as k, d - 1 as d, count(*) as n_children from node where d > 0 group by up, d),
full_node as (
  select node.*, coalesce(n_children, 0) as n_children, case when d = 0 then 0 else (n_convs - 1) * octet_length(encode(k[d].x)) end as own
  from node left join kids using (k, d)),
above as (select own, n_children, k, unnest(range(0, d + 1)) as j from full_node),
tree as (select k[1:j] as k, j as d, sum(own)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves from above group by all)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
from full_node n join tree using (k, d) left join node p on p.k = n.up and p.d = n.d - 1"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _OP2, "op4_decontamination": _OP4, "op7_license_scan": _op7(), "op11_spelling_variants": _OP11, "op12_prefix_trie": _OP12}
