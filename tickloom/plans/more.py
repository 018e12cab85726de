"""Registered queries: the rest of B, G, I, J, L, N, O, E."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import features as ft
from ..operators import financials as fin
from ..operators import indicators as ind
from ..operators import joins as jn
from ..operators import labels as lab
from ..operators import normalize as norm
from ..operators import options as opt
from ..operators import predicates as p
from ..registry import register
from ..sources import landed
from ..sources.bars import ordered
from .calendar import _years, holidays_sql
from .company import FILINGS, _filings
from .fixtures import BARS_SQL, VIX_SQL, bars, r4, sid, table, vix

KEY = ["exchange", "symbol", "period_date"]
K = "exchange, symbol, period_date"


@register("b2_distinct", "select distinct o_orderstatus, o_orderpriority from orders")
def b2(spark, d):
    return p.select_where(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], distinct=True)


@register("b3_order_by", "select o_orderkey, o_custkey from orders order by o_custkey, o_orderkey desc")
def b3(spark, d):
    return p.select_where(table(spark, d, "orders"), ["o_orderkey", "o_custkey"], order_by=["o_custkey", F.desc("o_orderkey")])


@register("b7_case", "select o_orderkey, case o_orderstatus when 'F' then 4 when 'O' then 1 else 2 end as quarter from orders")
def b7(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s == "F", 4).when(s == "O", 1).otherwise(2).alias("quarter"))


@register("n5_normalize_vix", f"with {BARS_SQL}, {VIX_SQL} select period_date, round(close / 1000000, 4) as close from vix")
def n5(spark, d):
    return norm.normalize_vix(vix(spark, d), 1e6).select("period_date", r4("close").alias("close"))


@register("l13_set_slice", f"with {BARS_SQL}, n as (select count(*) as n from bars) select ((n * 3 + 6) // 7 - (n * 2 + 6) // 7)::bigint as rows from n")
def l13(spark, d):
    return lab.set_slice(bars(spark, d), KEY, 7, 2).agg(F.count("*").alias("rows"))


@register("j6_edgar_nums", f"{FILINGS} select adsh, tag, sum(value) as value from num where tag <> 'OwnTag' group by 1, 2")
def j6(spark, d):
    sub, num, tag = _filings(spark, d)
    return fin.edgar_nums(num, sub, tag).groupBy("adsh", "tag").agg(F.sum("value").alias("value"))


@register("j7_latest_report", f"{FILINGS} select exchange, symbol, period, quarter from quarters qualify row_number() over (partition by exchange, symbol order by period desc, filed desc) = 1")
def j7(spark, d):
    sub, num, tag = _filings(spark, d)
    reports = fin.financial_reports(fin.edgar_nums(num, sub, tag), fin.edgar_quarters(sub, num))
    return fin.latest_filing(reports).select("exchange", "symbol", "period", "quarter")


@register("j12_real_neighbours", f"with {BARS_SQL}, r as (select *, case when rn % 4 <> 0 then close end as c from b) select {K}, round(last_value(c ignore nulls) over (partition by exchange, symbol order by period_date rows between unbounded preceding and 1 preceding), 4) as before, round(first_value(c ignore nulls) over (partition by exchange, symbol order by period_date rows between 1 following and unbounded following), 4) as after from r")
def j12(spark, d):
    from ..sources.bars import numbered

    w = ordered()
    real = numbered(bars(spark, d)).withColumn("c", F.when(F.col("idx") % 4 != 0, F.col("close")))
    # the next one is the last one in reverse order: a frame without an end is gone through again for every row
    back = Window.partitionBy("exchange", "symbol").orderBy(F.desc("period_date"))
    before, after = (F.last("c", True).over(x.rowsBetween(Window.unboundedPreceding, -1)) for x in (w, back))
    return real.select(*KEY, r4(before).alias("before"), r4(after).alias("after"))


@register("g2_vix_series", f"with {BARS_SQL}, {VIX_SQL}, j as (select b.*, v.close as vc, v.high as vh from b join vix v using (period_date)), s as (select *, list([vc, vh]) over (partition by exchange, symbol order by period_date rows between 5 preceding and 1 preceding) as l from j) select {K}, len(l)::int as n, round(l[1][1], 4) as first_close, round(l[5][2], 4) as last_high from s where len(l) = 5")
def g2(spark, d):
    out = ft.series(jn.with_vix(bars(spark, d), vix(spark, d)), ["vix_close", "vix_high"], 5).where("size(series) = 5")
    return out.select(*KEY, F.size("series").alias("n"), r4(F.col("series")[0][0]).alias("first_close"), r4(F.col("series")[4][1]).alias("last_high"))


@register("g8_indicator_features", f"with {BARS_SQL}, l as (select *, list(close) over (partition by exchange, symbol order by period_date rows between 20 preceding and 1 preceding) as l, case when close > pc then 1 else 0 end as g from b), a as (select *, list_reduce(l, lambda a, x: a + x) / 20 as m from l where rn >= 20), i as (select *, sqrt(list_reduce(list_transform(l, lambda x: (x - m) * (x - m)), lambda a, x: a + x) / 20) as s from a) select {K}, [floor((m - 2 * s) * 10000 + 0.5) / 10000, floor(m * 10000 + 0.5) / 10000, floor((m + 2 * s) * 10000 + 0.5) / 10000, g::double] as x from i where rn >= 20")
def g8(spark, d):
    rows = ind.rgvb(ind.bollinger(bars(spark, d))).where("bb_mid is not null")
    return rows.select(*KEY, F.array(r4("bb_low"), r4("bb_mid"), r4("bb_high"), F.col("rgvb").cast("double")).alias("x"))


@register("i15_interest_by_region", "select 'K' || o_custkey as keyword, 'G' || o_orderkey as geo_code, o_orderpriority as geo_name, (o_orderkey % 101)::int as value from orders")
def i15(spark, d):
    k = F.col("o_orderkey")
    point = F.struct(F.concat(F.lit("G"), k.cast("string")).alias("geoCode"), F.col("o_orderpriority").alias("geoName"), F.array((k % 101).cast("int")).alias("value"))
    files = table(spark, d, "orders").groupBy(F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("keyword")).agg(F.to_json(F.collect_list(point)).alias("json"))
    return landed.interest_by_region(files)


@register("i15_related", "select o_custkey::varchar as keyword, case when o_orderstatus = 'F' then 'top' else 'rising' end as kind, (row_number() over (partition by o_custkey, o_orderstatus = 'F' order by o_orderkey) - 1)::int as rank, 'q' || o_orderkey as query, (o_orderkey % 101)::int as value from orders")
def i15b(spark, d):
    k = F.col("o_orderkey")
    one = F.struct(k.alias("k"), F.concat(F.lit("q"), k.cast("string")).alias("query"), (k % 101).cast("int").alias("value"))
    done = F.col("o_orderstatus") == "F"
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("keyword")).agg(*[F.transform(F.sort_array(F.collect_list(F.when(c, one))), lambda x: F.struct(x["query"].alias("query"), x["value"].alias("value"))).alias(n) for n, c in (("top", done), ("rising", ~done))])
    return landed.related(lists.select("keyword", F.to_json(F.struct("top", "rising")).alias("json")))


@register("o8_strike_band_weekly", f"with {BARS_SQL}, {holidays_sql()}, c as (select distinct symbol as underlying, period_date as expiration_date, close + 10 as strike from b where rn % 15 = 9), a as (select c.*, md.date as day from c join cal on cal.date = expiration_date join md on md.ordinal = cal.ordinal - 4), w as (select symbol as underlying, date_trunc('week', period_date)::date as w, min(low) - 15 as lo, max(high) + 15 as hi from bars group by 1, 2) select underlying, expiration_date, round(strike, 4) as strike from a join w using (underlying) where date_trunc('week', day)::date = w and strike between lo and hi")
def o8(spark, d):
    from ..sources.bars import numbered

    df = bars(spark, d)
    contracts = numbered(df).where("idx % 15 = 9").select(F.col("symbol").alias("underlying"), F.col("period_date").alias("expiration_date"), (F.col("close") + 10).alias("strike"))
    out = opt.strike_band_weekly(contracts, df, cal.calendar(spark, *_years(spark, d)), 5)
    return out.select("underlying", "expiration_date", r4("strike").alias("strike"))
