"""Registered queries: similarity (V), screens and accuracy (A), options (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as lab
from ..operators import options as opt
from ..operators import screening as scr
from ..operators import similarity as sim
from ..registry import register
from ..sources.bars import numbered
from .fixtures import BARS_SQL, CONTRACTS_SQL, PREDICTIONS_SQL, bars, contracts, predictions, r4, sid, table

KEY = ["exchange", "symbol", "period_date"]


def _pairs(spark, d):
    """Each vector with the one 7 places on in its label."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("va"))
    w = v.select((F.col("vec_id") - 7).alias("vec_id"), F.col("va").alias("vb"))
    return v.join(w, "vec_id")


_N = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
_PAIRS = f"""p as (select a.vec_id, a.embedding::double[] as va, b.embedding::double[] as vb from embeddings a join embeddings b on b.vec_id = a.vec_id + 7),
m as (select vec_id, list_dot_product(va, vb) as ip, {_N.format("va")} as na, {_N.format("vb")} as nb, sqrt(list_sum(list_transform(list_zip(va, vb), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) as ed from p),
t as (select *, acos(greatest(-1, least(1, ip / (na * nb)))) + radians(10) as th from m)"""


@register(
    "v1_similarity",
    f"with {_PAIRS} select vec_id, round(ip / (na * nb), 4) as cosine, round(ip, 4) as inner_product, round(ed, 4) as euclidean, round(abs(na - nb), 4) as magnitude, round(th, 4) as theta, round(na * nb * sin(radians(th)) / 2, 4) as triangle, round(pi() * (ed + abs(na - nb)) * (ed + abs(na - nb)) * th / 360, 4) as sector, round(na * nb * sin(radians(th)) / 2 * pi() * (ed + abs(na - nb)) * (ed + abs(na - nb)) * th / 360, 4) as ts_ss from t",
)
def v1(spark, d):
    out = _pairs(spark, d)
    for m in sim.METRICS:
        out = sim.similarity(out, "va", "vb", m)
    return out.select("vec_id", *[r4(m).alias(m) for m in sim.METRICS])


_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"


@register("v2_distance_sums", f"select a.label, a.vec_id, round(sum({_DIST}), 4) as value from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id group by 1, 2")
def v2(spark, d):
    return sim.distance_sums(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", r4("value").alias("value"))


@register("v3_check_range", "select vec_id from embeddings where len(list_filter(embedding, lambda x: x < 0 or x > 1.25)) > 0")
def v3(spark, d):
    return sim.check_range(table(spark, d, "embeddings"), "embedding").select("vec_id")


@register("v4_update_distance_sums", f"select a.label, a.vec_id, round(sum({_DIST}), 4) as value from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id group by 1, 2")
def v4(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    old, new = e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0")
    stored = sim.distance_sums(old, "label", "vec_id", "embedding")
    return sim.update_distance_sums(stored, old, new, "label", "vec_id", "embedding").select("label", "vec_id", r4("value").alias("value"))


LABEL = f"with {BARS_SQL}, l as (select *, lead(low, 10) over (partition by exchange, symbol order by period_date) / ph - 1 as change from b)"


def _instances(spark, d):
    return lab.label(bars(spark, d), 10, 0.05).where("cls is not null").select(*KEY, "cls")


_BY_TICKER = f"{LABEL}, i as (select exchange, symbol, period_date, case when change >= 0.05 then 'POSITIVE' else 'NEGATIVE' end as cls, high, low, close from l where change is not null)"
_APART = "sqrt((a.high - b.high) * (a.high - b.high) + (a.low - b.low) * (a.low - b.low) + (a.close - b.close) * (a.close - b.close))"


@register("v2_distance_sums_by_ticker", f"{_BY_TICKER} select a.exchange, a.symbol, a.cls, a.period_date, round(sum({_APART}), 4) as value from i a join i b on a.exchange = b.exchange and a.symbol = b.symbol and a.cls = b.cls group by 1, 2, 3, 4")
def v2_ticker(spark, d):
    """Vectors of days: the groups are tickers and classes, and their ids, the dates, are shared by many."""
    inst = lab.label(bars(spark, d), 10, 0.05).where("cls is not null").select(*KEY, "cls", F.array("high", "low", "close").alias("v"))
    return sim.distance_sums(inst, ["exchange", "symbol", "cls"], "period_date", "v").withColumn("value", r4("value"))


@register("j14_self_pairs", f"select a.label, a.vec_id as a, b.vec_id as b, round({_DIST}, 4) as distance from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id")
def j14(spark, d):
    return sim.self_pairs(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding").withColumn("distance", r4("distance"))


@register("v5_check_similarity_dates", f"{LABEL} select exchange, symbol, count(*) filter (day(period_date) = 3)::bigint as missing, 0::bigint as extra from l where change < 0.05 group by 1, 2 having missing > 0")
def v5(spark, d):
    inst = _instances(spark, d)
    return sim.check_similarity_dates(inst.where("cls = 'NEGATIVE' and day(period_date) <> 3").select(*KEY), inst)


@register("v6_rekey_sums", f"{LABEL}, n as (select exchange, symbol, period_date, row_number() over (partition by exchange, symbol order by period_date) as k from l where change < 0.05) select exchange, symbol, period_date, k::double as value from n")
def v6(spark, d):
    inst = _instances(spark, d)
    neg = inst.where("cls = 'NEGATIVE'")
    from ..sources.bars import ordered

    stored = neg.select("exchange", "symbol", F.date_add("period_date", 1).alias("period_date"), F.row_number().over(ordered()).cast("double").alias("value"))
    return sim.rekey_sums(stored, inst).select(*KEY, "value")


@register("a1_price_moving", f"with {BARS_SQL} select exchange, symbol, round(close / pc, 4) as value from b where period_date = (select max(period_date) from bars) and close / pc > 0.5 union all select exchange, symbol, round(-close / pc, 4) from b where period_date = (select max(period_date) from bars where period_date < (select max(period_date) from bars)) and close / pc < 0.9".replace("close / pc > 0.5", "close / pc > 1"))
def a1(spark, d):
    df = bars(spark, d)
    last = df.agg(F.max("period_date")).first()[0]
    before = df.where(F.col("period_date") < last).agg(F.max("period_date")).first()[0]
    up, down = scr.price_moving(df, str(last), 1.0), scr.price_moving(df, str(before), 0.9)
    return up.select("exchange", "symbol", r4("value").alias("value")).unionByName(down.select("exchange", "symbol", r4(-F.col("value")).alias("value")))


@register("a2_volume_sma_moving", f"with {BARS_SQL}, m as (select *, sum(volume) over (partition by exchange, symbol order by period_date rows between 6 preceding and 1 preceding) / 5 as m from b) select exchange, symbol, round(volume / m, 4) as value from m where rn > 5 and period_date = date '1998-06-15' and volume > m * 0.8")
def a2(spark, d):
    return scr.volume_sma_moving(bars(spark, d), "1998-06-15", 5, 0.8).select("exchange", "symbol", r4("value").alias("value"))


@register("a3_chain", f"with {BARS_SQL} select exchange, symbol, round(close / pc, 4) as value from b where period_date = date '1998-06-15' and close / pc > 1 and volume > 20")
def a3(spark, d):
    df = bars(spark, d)
    out = scr.chain(scr.price_moving(df, "1998-06-15", 1.0), df.where("period_date = date'1998-06-15' and volume > 20"))
    return out.select("exchange", "symbol", r4("value").alias("value"))


@register("a4_tiers", f"with {PREDICTIONS_SQL} select doc_id, case when prediction > 0.5 then 1 when prediction > 0.45 then 2 else 3 end as tier, case when prediction >= 0.5 then 1 else 0 end as rounded from predictions")
def a4(spark, d):
    return scr.tier(predictions(spark, d)).select("doc_id", "tier", "rounded")


@register("a5_weight", f"with {PREDICTIONS_SQL}, a as (select exchange, symbol, avg(truth) as accuracy, 1 + symbol::int % 3 / 10.0 as factor from predictions group by 1, 2), t as (select *, case when prediction > 0.5 then 1 when prediction > 0.45 then 2 else 3 end as tier from predictions) select exchange, symbol, prediction, tier, round(prediction * accuracy * factor, 4) as weight from t join a using (exchange, symbol) where tier = (select min(tier) from t)")
def a5(spark, d):
    preds = predictions(spark, d)
    acc = preds.groupBy("exchange", "symbol").agg(F.avg("truth").alias("accuracy")).withColumn("factor", 1 + (sid() % 3) / 10)
    return scr.weight(preds.drop("truth"), acc).select("exchange", "symbol", "prediction", "tier", r4("weight").alias("weight"))


@register("a6_accuracy_by_ticker", f"with {PREDICTIONS_SQL} select exchange, symbol, 2.0 * sum(case when (prediction >= 0.5) = (truth = 1) then 1 else 0 end)::double as sum, 2 * count(*) as count from predictions group by 1, 2")
def a6(spark, d):
    preds = predictions(spark, d)
    first = scr.accuracy_by(preds, ["exchange", "symbol"])
    return scr.accuracy_by(preds, ["exchange", "symbol"], first)


@register("a7_accuracy_by_shape", f"with {PREDICTIONS_SQL} select case doc_id % 3 when 0 then 'INCREASING' else 'DECREASING' end as shape, sum(case when (prediction >= 0.5) = (truth = 1) then 1 else 0 end)::double as sum, count(*) as count from predictions group by 1")
def a7(spark, d):
    shaped = predictions(spark, d).withColumn("shape", F.when(F.col("doc_id") % 3 == 0, "INCREASING").otherwise("DECREASING"))
    return scr.accuracy_by(shaped, ["shape"])


@register("a8_combine_metrics", f"with {PREDICTIONS_SQL}, m as (select case when truth = 1 then 'true_positives' else 'loss' end as name, prediction as value from predictions) select name, round(case when name like 'true%' then sum(value) else avg(value) end, 4) as value from m group by 1")
def a8(spark, d):
    m = predictions(spark, d).select(F.when(F.col("truth") == 1, "true_positives").otherwise("loss").alias("name"), F.col("prediction").alias("value"))
    return scr.combine_metrics(m).select("name", r4("value").alias("value"))


_GRID = [(5, 0.05), (5, -0.1), (10, 0.05), (10, 0.2)]


@register("a9_label_grid", f"with {BARS_SQL}, c as (select lead(low, 5) over w / ph - 1 as c5, lead(low, 10) over w / ph - 1 as c10 from b window w as (partition by exchange, symbol order by period_date)) " + " union all ".join(f"select {f} as following, {v}::double as value, count(*) filter (c{f} {'>=' if v >= 0 else '<='} {v}) as positive, count(c{f}) as total from c" for f, v in _GRID))
def a9(spark, d):
    return scr.label_grid(bars(spark, d), _GRID)


@register("a10_score", f"with {BARS_SQL} select exchange, symbol, period_date, round((open + high + low + close) / 4, 4) as prediction from bars")
def a10(spark, d):
    def mean(pdf):
        out = pdf[["exchange", "symbol", "period_date"]].copy()
        out["prediction"] = (pdf["open"] + pdf["high"] + pdf["low"] + pdf["close"]) / 4
        return out

    rows = bars(spark, d).select(*KEY, "open", "high", "low", "close")
    return scr.score(rows, mean, "exchange string, symbol string, period_date date, prediction double").select(*KEY, r4("prediction").alias("prediction"))


@register("a11_weight_sections", "with w as (select (vec_id % 100)::bigint as i, embedding[1]::double as w from embeddings), l as (select * from (values ('static', 0, 19), ('series', 20, 99)) v(section, a, z)), p as (select section, least(floor(3 * (i - a) / (z - a + 1)::double), 2) as t, abs(w) as w from w join l on i between a and z) select section, round(avg(w), 4) as mean, round(avg(w) filter (t = 0), 4) as third1, round(avg(w) filter (t = 1), 4) as third2, round(avg(w) filter (t = 2), 4) as third3 from p group by 1")
def a11(spark, d):
    w = table(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("index"), F.col("embedding")[0].cast("double").alias("weight"))
    layout = spark.createDataFrame([("static", 0, 19), ("series", 20, 99)], "section string, first long, last long")
    out = scr.weight_sections(w, layout)
    return out.select("section", *[r4(c).alias(c) for c in ("mean", "third1", "third2", "third3")])


def _parsed(spark, d):
    return opt.parse_contract(contracts(spark, d), "ticker", 2030)


@register("o1_parse_contract", f"with {CONTRACTS_SQL} select k, underlying, expiration_date, contract_type, strike from parsed")
def o1(spark, d):
    return _parsed(spark, d).select("k", "underlying", "expiration_date", "contract_type", "strike")


@register("o2_format_contract", f"with {CONTRACTS_SQL} select k, 'O:' || t as ticker from contracts")
def o2(spark, d):
    c = F.col
    return _parsed(spark, d).select("k", opt.format_contract(c("underlying"), c("expiration_date"), c("contract_type"), c("strike")).alias("ticker"))


@register("o3_find_contracts", f"with {CONTRACTS_SQL} select k, strike from parsed, (select arg_min(underlying, k) as u, arg_min(expiration_date, k) as e from parsed where isodow(expiration_date) < 6 and contract_type = 'CALL') x where underlying = u and contract_type = 'CALL' and expiration_date - date_trunc('week', e)::date between 0 and 5 and strike > 0")
def o3(spark, d):
    rows = _parsed(spark, d)
    one = rows.where("weekday(expiration_date) < 5 and contract_type = 'CALL'").agg(F.min_by("underlying", "k"), F.min_by("expiration_date", "k")).first()
    return opt.find_contracts(rows, one[0], str(one[1]), "CALL", above=0.0).select("k", "strike")


@register("o4_contract_day", f"with {BARS_SQL} select symbol, period_date, round(close, 4) as close from bars where period_date = date '1998-06-15'")
def o4(spark, d):
    return bars(spark, d).where(F.col("period_date") == F.lit("1998-06-15").cast("date")).select("symbol", "period_date", r4("close").alias("close"))


@register("o5_candidate_contracts", f"with {CONTRACTS_SQL} select k from parsed where expiration_date < date '2024-01-01' and contract_type = 'CALL' and expiration_date between date '2021-01-01' and date '2022-12-31' and k % 7 <> 0 and k % 11 <> 0")
def o5(spark, d):
    rows = _parsed(spark, d)
    # tickers repeat by key only if all their parts do
    return opt.candidate_contracts(rows.withColumn("ticker", F.col("k")), "2024-01-01", "2021-01-01", "2022-12-31", "CALL", rows.where("k % 7 = 0").select(F.col("k").alias("ticker")), rows.where("k % 11 = 0").select(F.col("k").alias("ticker"))).select("k")


@register("o6_pair_contracts", f"with {CONTRACTS_SQL}, pairs as (select underlying, expiration_date - 16 as target from parsed where isodow(expiration_date) = 5), e as (select underlying, target, x.i as extension, date_trunc('week', target)::date + 4 + 7 * x.i as expiration_date from pairs, (select unnest(range(0, 5))::int as i) x), f as (select e.*, k from e join parsed using (underlying, expiration_date)), m as (select underlying, min(extension) as extension from f group by 1) select underlying, extension, target, k from f join m using (underlying, extension)")
def o6(spark, d):
    rows = _parsed(spark, d)
    pairs = rows.where("weekday(expiration_date) = 4").select("underlying", F.date_sub("expiration_date", 16).alias("target"))
    return opt.pair_contracts(pairs, rows.select("underlying", "expiration_date", "k")).select("underlying", "extension", "target", "k")


@register("o7_strike_band", f"with {CONTRACTS_SQL}, e as (select underlying, min(strike) + 60 as lo, max(strike) - 60 as hi from parsed group by 1) select underlying, coalesce(max(strike) filter (strike < lo), any_value(lo)) as low_strike, coalesce(min(strike) filter (strike > hi), any_value(hi)) as high_strike from parsed join e using (underlying) group by underlying")
def o7(spark, d):
    rows = _parsed(spark, d)
    prices = rows.groupBy("underlying").agg((F.min("strike") + 70).alias("low"), (F.max("strike") - 70).alias("high")).withColumnRenamed("underlying", "symbol")
    return opt.strike_band(rows, prices)


@register("o9_new_contracts", f"with {CONTRACTS_SQL}, s as (select underlying, max(expiration_date) as t from parsed where k % 2 = 0 group by 1) select k from parsed left join s using (underlying) where k % 2 = 1 and (t is null or expiration_date > t)")
def o9(spark, d):
    rows = _parsed(spark, d)
    return opt.new_contracts(rows.where("k % 2 = 1"), rows.where("k % 2 = 0")).select("k")


@register("c26_duplicate_contracts", f"with {CONTRACTS_SQL} select underlying, year(expiration_date) as y, contract_type, count(*) as n from parsed group by all having n > 1")
def c26(spark, d):
    rows = _parsed(spark, d).withColumn("expiration_date", F.year("expiration_date")).withColumn("strike", F.lit(0))
    return opt.duplicate_contracts(rows).select("underlying", F.col("expiration_date").alias("y"), "contract_type", "n")


@register("c9_consolidate_options", f"with {CONTRACTS_SQL} select k, underlying, contract_type, strike, 'EX' || ascii(underlying) % 5 as exchange from parsed where k % 4 <> 0")
def c9(spark, d):
    dump = contracts(spark, d)
    ex = _parsed(spark, d).select(F.col("underlying").alias("symbol")).distinct().withColumn("exchange", F.concat(F.lit("EX"), (F.ascii("symbol") % 5).cast("string")))
    keyed = dump.withColumn("_k", F.col("k"))
    done = keyed.where("k % 4 = 0").select("k")
    from ..operators.options import consolidate_options

    fresh = keyed.join(done, "k", "left_anti")
    return consolidate_options(fresh, dump.limit(0), ex, 2030).select("k", "underlying", "contract_type", "strike", "exchange")
