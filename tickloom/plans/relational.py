"""Registered queries: predicates (F), joins (J), relational basics (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import predicates as p
from ..registry import register
from ..sources.bars import numbered
from .fixtures import BARS_SQL, EARNINGS_SQL, INTEREST_SQL, SPLITS_SQL, VIX_SQL, bars, earnings, interest, minute_bars, r4, sid, splits, table, vix

KEY = ["exchange", "symbol", "period_date"]
K = "exchange, symbol, period_date"


@register("f1_equality_in", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')")
def f1(spark, d):
    return p.select_where(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"], o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"])


@register("f2_null_tests", "select doc_id from documents where lang is not null and source is not null")
def f2(spark, d):
    return p.select_where(table(spark, d, "documents"), ["doc_id"], lang=p.Null(False), source=p.Null(False))


@register("f3_comparisons", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_quantity < 10 and l_discount >= 0.05 and l_linenumber <> 3")
def f3(spark, d):
    return p.select_where(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], l_quantity=p.Compare("<", 10), l_discount=p.Compare(">=", 0.05), l_linenumber=p.Compare("!=", 3))


@register("f4_like", "select s_suppkey, s_name from supplier where s_name like '%1'")
def f4(spark, d):
    return p.select_where(table(spark, d, "supplier"), ["s_suppkey", "s_name"], s_name=p.Like("%1"))


@register("f5_between", "select p_partkey from part where p_size between 10 and 20 union all select -p_partkey from part where p_size > 10 and p_size < 20")
def f5(spark, d):
    part = table(spark, d, "part")
    return p.select_where(part, ["p_partkey"], p_size=p.Between(10, 20)).union(p.select_where(part, ["p_partkey"], p_size=p.Between(10, 20, False)).select(-F.col("p_partkey")))


@register("f6_within", "select o_orderkey from orders where abs(o_totalprice - 100000) <= 5000")
def f6(spark, d):
    return p.select_where(table(spark, d, "orders"), ["o_orderkey"], o_totalprice=p.Within(100000, 5000))


@register("f7_conjunction", "select o_orderkey, o_custkey from orders where o_totalprice > 150000 and o_orderstatus = 'O'")
def f7(spark, d):
    return p.select_where(table(spark, d, "orders"), ["o_orderkey", "o_custkey"], o_totalprice=p.Compare(">", 150000), o_orderstatus="O", o_orderpriority=None)


@register("f8_distinct_projection", "select distinct c_mktsegment, c_nationkey from customer")
def f8(spark, d):
    return p.select_where(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], distinct=True)


@register("f9_exclude_tickers", f"with {BARS_SQL} select exchange, symbol, count(*) as n from bars where symbol::int % 5 <> 0 group by 1, 2")
def f9(spark, d):
    df = bars(spark, d)
    return p.exclude(df, df.where(sid() % 5 == 0)).groupBy("exchange", "symbol").agg(F.count("*").alias("n"))


@register("f10_select_where", "select l_returnflag, l_linestatus, sum(l_quantity) as qty, count(*) as n from lineitem where l_quantity >= 5 group by 1, 2")
def f10(spark, d):
    return p.select_where(table(spark, d, "lineitem"), group_by=["l_returnflag", "l_linestatus"], aggregates={"qty": F.sum("l_quantity"), "n": F.count("*")}, order_by=["l_returnflag", "l_linestatus"], l_quantity=p.Compare(">=", 5))


@register("f11_bucket_by", "select case when o_totalprice < 50000 then 'small' when o_orderstatus = 'F' then 'done' else 'rest' end as bucket, count(*) as n from orders group by 1")
def f11(spark, d):
    b = p.bucket_by([F.col("o_totalprice") < 50000, F.col("o_orderstatus") == "F"], ["small", "done"], "rest")
    return table(spark, d, "orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@register("f12_exchange_alias", f"with {BARS_SQL} select distinct coalesce(n_name, exchange) as exchange, symbol from bars left join nation on exchange = 'EX' || n_nationkey and n_nationkey % 2 = 0")
def f12(spark, d):
    aliases = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("EX"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("standard"))
    return p.standard_exchange(bars(spark, d).select("exchange", "symbol").distinct(), aliases)


@register("f13_market_region", f"with {BARS_SQL} select distinct exchange, symbol, case when exchange in ('EX3', 'EX7') then 'CANADA' else 'US' end as region from bars")
def f13(spark, d):
    from ..functions.scalars import region

    return bars(spark, d).select("exchange", "symbol").distinct().withColumn("region", region(F.col("exchange"), ("EX3", "EX7")))


@register("b1_aggregates", f"with {BARS_SQL} select exchange, min(low) as lo, max(high) as hi, count(*) as n, sum(volume) as volume, round(avg(close), 2) as mean from bars group by 1")
def b1(spark, d):
    return bars(spark, d).groupBy("exchange").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.count("*").alias("n"), F.sum("volume").alias("volume"), F.round(F.avg("close"), 2).alias("mean"))


@register("b4_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def b4(spark, d):
    return p.select_where(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], order_by=[F.desc("o_totalprice"), "o_orderkey"], limit=50)


@register("b5_union_distinct", "select c_nationkey as k from customer union select s_nationkey from supplier")
def b5(spark, d):
    return p.union_distinct(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@register("b6_row_count_max", "select count(*) as n, max(o_orderkey) as top from orders")
def b6(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"))


@register("b8_sample_tickers", f"with {BARS_SQL} select least(count(distinct exchange || symbol), 10)::bigint as n from bars")
def b8(spark, d):
    df = bars(spark, d)
    s = p.sample_tickers(df, 10)
    return s.join(df.select("exchange", "symbol").distinct(), ["exchange", "symbol"]).agg(F.count("*").alias("n"))


@register("b9_delete_where", "select o_orderkey from orders where not (o_orderstatus = 'F' and o_totalprice < 100000)")
def b9(spark, d):
    return p.delete_where(table(spark, d, "orders"), o_orderstatus="F", o_totalprice=p.Compare("<", 100000)).select("o_orderkey")


@register("j1_symbols_daily", f"with {BARS_SQL} select exchange, s_name as name, period_date, round(close, 4) as close from bars join supplier on s_suppkey::varchar = symbol")
def j1(spark, d):
    sup = table(spark, d, "supplier").select(F.concat(F.lit("EX"), F.col("s_nationkey").cast("string")).alias("exchange"), F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("name"))
    return bars(spark, d).join(sup, ["exchange", "symbol"]).select("exchange", "name", "period_date", r4("close").alias("close"))


@register("j2_latest_minute", "select 'EV' as exchange, c_custkey::varchar as symbol, max(ts) as latest from customer left join events on user_id = c_custkey group by c_custkey")
def j2(spark, d):
    symbols = table(spark, d, "customer").select(F.lit("EV").alias("exchange"), F.col("c_custkey").cast("string").alias("symbol"))
    return j.latest_minute(symbols, minute_bars(spark, d))


@register("j3_semi", f"with {BARS_SQL}, {SPLITS_SQL} select exchange, symbol, count(*) as n from bars where (exchange, symbol) in (select exchange, symbol from splits where split_to = 4) group by 1, 2")
def j3(spark, d):
    return j.semi(bars(spark, d), splits(spark, d).where("split_to = 4")).groupBy("exchange", "symbol").agg(F.count("*").alias("n"))


@register("j4_anti", f"with {BARS_SQL}, {INTEREST_SQL} select {K} from bars x where not exists (select 1 from interest i where i.exchange = x.exchange and i.symbol = x.symbol and i.date = x.period_date)")
def j4(spark, d):
    return j.anti(bars(spark, d), interest(spark, d).withColumnRenamed("date", "period_date"), KEY).select(*KEY)


@register("j5_join_latest", f"with {BARS_SQL}, {SPLITS_SQL} select exchange, symbol, max(date) as date, arg_max(split_to, date) as split_to from splits group by 1, 2")
def j5(spark, d):
    u = bars(spark, d).select("exchange", "symbol").distinct()
    return j.join_latest(u, splits(spark, d), ["exchange", "symbol"], "date").select("exchange", "symbol", "date", "split_to")


@register("j8_with_vix", f"with {BARS_SQL}, {VIX_SQL} select exchange, symbol, period_date, round(vix.close, 4) as vix_close from bars left join vix using (period_date)")
def j8(spark, d):
    return j.with_vix(bars(spark, d), vix(spark, d)).select(*KEY, r4("vix_close").alias("vix_close"))


@register(
    "j10_next_earnings",
    f"""with {BARS_SQL}, {EARNINGS_SQL}, e as (select *, row_number() over w as i, lead(earnings_date) over w as nxt from earnings window w as (partition by exchange, symbol order by input_date, earnings_date)),
f as (select exchange, symbol, min(input_date) as a, max(input_date) as z, arg_min(earnings_date, i) as first from e group by 1, 2),
q as (select x.exchange, x.symbol, x.period_date, f.first, case when x.period_date < f.a then f.z else x.period_date end as cut from bars x join f using (exchange, symbol))
select q.exchange, q.symbol, q.period_date, coalesce(arg_max(e.nxt, e.i), q.first) as next_date from q left join e on e.exchange = q.exchange and e.symbol = q.symbol and e.nxt is not null and e.input_date <= q.cut and e.earnings_date < q.period_date group by q.exchange, q.symbol, q.period_date, q.first""",
)
def j10(spark, d):
    return j.next_earnings(bars(spark, d).select(*KEY), earnings(spark, d))


@register("j11_splits_in_range", f"with {BARS_SQL}, {SPLITS_SQL} select b.exchange, b.symbol, b.period_date, s.date, s.split_to from b join splits s on s.exchange = b.exchange and s.symbol = b.symbol and s.date > b.period_date - 60 and s.date <= b.period_date")
def j11(spark, d):
    inst = bars(spark, d).select(*KEY, F.date_sub("period_date", 60).alias("start"), F.col("period_date").alias("end"))
    return j.splits_in_range(inst, splits(spark, d)).select(*KEY, "date", "split_to")


@register("j15_volume_plus_interest", f"with {BARS_SQL}, {INTEREST_SQL} select exchange, symbol, period_date, volume + relative_interest as weight from bars join interest using (exchange, symbol) where date = period_date")
def j15(spark, d):
    return j.volume_plus_interest(bars(spark, d), interest(spark, d))
