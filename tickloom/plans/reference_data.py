"""Registered queries: landed files (S) and reference data (C15-C24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reference_data as ref
from ..operators.predicates import Compare
from ..registry import register
from ..session import scratch
from ..sources import landed
from ..sources.bars import numbered
from ..sources.stored import Stored
from .fixtures import BARS_SQL, bars, r4, sid, table

KEY = ["exchange", "symbol", "period_date"]
K = "exchange, symbol, period_date"


@register("s2_parse_grouped_daily", f"with {BARS_SQL} select symbol as ticker, period_date, round(open, 4) as open, round(close, 4) as close, volume, case when symbol::int % 2 = 0 then transactions else 0 end::double as transactions from bars")
def s2(spark, d):
    n = F.when(sid() % 2 == 0, F.col("transactions").cast("double"))
    each = F.struct(F.col("symbol").alias("T"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), n.alias("n"))
    days = bars(spark, d).groupBy("period_date").agg(F.to_json(F.struct(F.collect_list(each).alias("results"))).alias("json"))
    return landed.parse_grouped_daily(days).select("ticker", "period_date", r4("open").alias("open"), r4("close").alias("close"), "volume", "transactions")


@register("s3_parse_series_map", f"with {BARS_SQL} select {K}, round(open, 4) as open, round(close, 4) as close, volume from bars")
def s3(spark, d):
    named = {"1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close", "5. volume": "volume"}
    day = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), F.col(v).cast("string"))])
    files = bars(spark, d).groupBy("exchange", "symbol").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("period_date").cast("string"), day)))).alias("json"))
    return landed.parse_series_map(files).select(*KEY, r4("open").alias("open"), r4("close").alias("close"), "volume")


@register("s4_parse_aggregates", "select user_id::varchar as ticker, ts as timestamp, round(value, 4) as close, 0.0::double as transactions from (select distinct user_id, date_trunc('second', ts) as ts, value from events)")
def s4(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_trunc("second", "ts").alias("ts"), "value").distinct()
    bar = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("c"))
    files = e.groupBy("user_id").agg(F.to_json(F.struct(F.first("user_id").cast("string").alias("ticker"), F.collect_list(bar).alias("results"))).alias("json"))
    return landed.parse_aggregates(files).select("ticker", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), r4("close").alias("close"), "transactions")


@register("s5_parse_epoch_payload", f"with {BARS_SQL} select symbol, period_date, round(close, 4) as close from bars")
def s5(spark, d):
    ms = F.unix_date("period_date").cast("long") * 86_400_000
    files = bars(spark, d).groupBy("symbol").agg(F.to_json(F.collect_list(F.array(ms.cast("double"), F.col("close")))).alias("json"))
    return landed.parse_epoch_payload(files).select("symbol", "period_date", r4("close").alias("close"))


@register("s6_clean_vix", f"with {BARS_SQL} select period_date, case when symbol::int % 2 = 0 then 0 else volume end as open, volume as close, 0 as artificial from bars")
def s6(spark, d):
    rows = bars(spark, d)
    v = F.col("volume").cast("string")
    lines = rows.select(F.concat_ws(",", F.date_format("period_date", "MM/dd/yyyy"), F.when(F.col("symbol").cast("int") % 2 == 0, "n/a").otherwise(v), v, v, v).alias("value"))
    head = table(spark, d, "region").select(F.concat(F.lit("note, "), F.col("r_name")).alias("value"))
    return landed.clean_vix(head.unionByName(lines)).select("period_date", "open", "close", "artificial")


@register("s8_edgar_duplicates", "select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_extendedprice, l_linenumber, l_partkey) > 1 as duplicate, s.s_suppkey::varchar as symbol from lineitem l left join supplier s on s.s_suppkey = l.l_suppkey and s.s_suppkey % 2 = 0".replace("l_extendedprice, l_linenumber, l_partkey) > 1", "l_linenumber, l_partkey, l_suppkey) > 1"))
def s8(spark, d):
    lines = table(spark, d, "lineitem")
    num = lines.select(F.col("l_orderkey").alias("adsh"), "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("value"), F.col("l_suppkey").cast("string").alias("cik"))
    info = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.lit("EX").alias("exchange"), F.col("s_suppkey").cast("string").alias("symbol"))
    out = landed.attach_ticker(landed.mark_duplicates(num), info)
    return out.select(F.col("adsh").alias("l_orderkey"), "l_linenumber", "l_partkey", "duplicate", "symbol")


@register("s9_load_symbols", "select 'EX' || s_nationkey as exchange, 'A.' || s_suppkey as symbol, s_name as name, case s_suppkey % 3 when 0 then 'Stock' else 'ETF' end as asset_type from supplier where s_suppkey % 3 < 2 and s_nationkey < 10")
def s9(spark, d):
    k = F.col("s_suppkey") % 3
    rows = table(spark, d, "supplier").select(F.concat(F.lit("EX"), F.col("s_nationkey").cast("string")).alias("exchange"), F.concat(F.lit("A-"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("name"), F.when(k == 0, "Stock").when(k == 1, "ETF").otherwise("Bond").alias("asset_type"))
    return landed.load_symbols(rows, [f"EX{i}" for i in range(10)])


@register("s10_clean_earnings", "select o_orderkey, case o_orderkey % 4 when 0 then 1234.5 when 1 then -0.49 when 2 then null else 2 end::double as eps, make_date(2020, (1 + o_orderkey % 12)::int, case when o_orderkey % 2 = 0 then 15 else 1 end) as fiscal_quarter_ending, case when o_orderkey % 4 = 2 then 5.5 when o_orderkey % 4 = 1 then -5.5 else 5.5 end::double as surprise_percentage from orders")
def s10(spark, d):
    k = F.col("o_orderkey") % 4
    m = 1 + F.col("o_orderkey") % 12
    eps = F.when(k == 0, "$1,234.5").when(k == 1, "(0.49)").when(k == 2, "N/A").otherwise("2")
    date = F.when(F.col("o_orderkey") % 2 == 0, F.concat(m.cast("string"), F.lit("/15/2020"))).otherwise(F.date_format(F.make_date(F.lit(2020), m.cast("int"), F.lit(1)), "MMM/yyyy"))
    rows = table(spark, d, "orders").select("o_orderkey", eps.alias("eps"), F.lit("0.1").alias("eps_forecast"), date.alias("fiscal_quarter_ending"), F.lit("0.2 (5.5%)").alias("surprise"))
    return landed.clean_earnings(rows).select("o_orderkey", "eps", "fiscal_quarter_ending", "surprise_percentage")


@register("s11_parse_earnings_html", "select page_id, 'day' || page_id % 5 as day, ['SYM' || page_id, (page_id % 7) || '.5'] as cells from pages")
def s11(spark, d):
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit("<div data-tab-pane='day"), (F.col("page_id") % 5).cast("string"), F.lit("'><table><tr><th>x</th></tr><tr><td> SYM"), k, F.lit("</td><td>"), (F.col("page_id") % 7).cast("string"), F.lit(".5</td></tr></table></div>"))
    return landed.parse_earnings_html(table(spark, d, "pages").select("page_id", F.concat("html", html).alias("html")).where("html is not null")).where("day is not null")


@register("s12_parse_interest", f"with {BARS_SQL} select symbol as keyword, unnest(generate_series(period_date, period_date + 6, interval 1 day))::date as date, case when rn % 3 = 0 or rn % 50 = 0 then 0.1 else (rn % 50)::double end as relative_interest from b")
def s12(spark, d):
    rows = numbered(bars(spark, d))
    t = F.unix_date("period_date").cast("long") * 86400
    point = F.struct(t.alias("time"), (t + 6 * 86400).alias("end"), F.array(F.when(F.col("idx") % 3 == 0, 0.0).otherwise((F.col("idx") % 50).cast("double"))).alias("value"), F.array(F.lit(True)).alias("hasData"))
    return landed.parse_interest(rows.groupBy(F.col("symbol").alias("keyword")).agg(F.to_json(F.collect_list(point)).alias("json")))


@register("s13_flatten_details", "select s_suppkey as supp_key, s_name as company_name, s_nationkey as nation_code from supplier")
def s13(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppKey"), F.lit("x").alias("noise"), F.struct(F.col("s_name").alias("companyName"), F.col("s_nationkey").alias("nationCode")).alias("address"))
    return landed.flatten_details(rows, "address", ["noise"])


@register("s14_align_schema", "select s_suppkey as k, s_name as name, null::bigint as nation from supplier union all select c_custkey, null, c_nationkey from customer")
def s14(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"))
    return ref.align_schema(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").cast("long").alias("nation")), a)


@register("s15_merge_nonmarket", f"with {BARS_SQL} select {K}, case when rn % 4 = 0 then null when rn % 4 = 1 then null when rn % 3 = 0 then -1 else volume + 1 end::double as pre_market from b")
def s15(spark, d):
    rows = numbered(bars(spark, d))
    daily = rows.select(*KEY, "open", "high", "low", "close", "volume", F.lit(None).cast("double").alias("pre_market"), F.lit(None).cast("double").alias("after_hours"))
    up = rows.where("idx % 4 <> 0").select(*KEY, "open", "high", "low", "close", F.when(F.col("idx") % 4 == 1, F.col("volume") + 5).otherwise(F.col("volume")).alias("volume"), F.when(F.col("idx") % 3 != 0, F.col("volume") + 1).alias("pre_market"), F.lit(None).cast("double").alias("after_hours"))
    return ref.merge_nonmarket(daily, up)[0].select(*KEY, "pre_market")


def _two(spark, d):
    rows = numbered(bars(spark, d)).select(*KEY, "volume", "transactions", "idx")
    old = rows.where("idx % 3 <> 0").select(*KEY, "volume", F.lit(0).cast("long").alias("transactions"))
    new = rows.where("idx % 2 = 0").select(*KEY, F.when(F.col("idx") % 5 != 0, F.col("volume") * 2).alias("volume"), F.col("transactions").cast("long").alias("transactions"))
    return old, new


_UP = f"with {BARS_SQL}, o as (select {K}, volume, 0::bigint as transactions from b where rn % 3 <> 0), n as (select {K}, case when rn % 5 <> 0 then volume * 2 end as volume, transactions from b where rn % 2 = 0)"


@register("s16_upsert_ignore", f"{_UP} select * from o union all select * from n where ({K}) not in (select {K} from o)")
def s16a(spark, d):
    return ref.upsert(*_two(spark, d), KEY, "ignore")


@register("s16_upsert_replace", f"{_UP} select * from n union all select * from o where ({K}) not in (select {K} from n)")
def s16b(spark, d):
    return ref.upsert(*_two(spark, d), KEY, "replace")


@register("s16_upsert_update", f"{_UP} select {K}, coalesce(n.volume, o.volume) as volume, coalesce(n.transactions, o.transactions) as transactions from o full join n using ({K})")
def s16c(spark, d):
    return ref.upsert(*_two(spark, d), KEY, "update")


@register("s17_changed_tickers", f"with {BARS_SQL} select distinct exchange, symbol from b where symbol::int % 3 = 0 and rn = n - 1")
def s17(spark, d):
    df = numbered(bars(spark, d))
    return ref.changed_tickers(df, df.where("not (cast(symbol as int) % 3 = 0 and idx = n - 1)"))


@register("s18_plain_text", "select p_partkey::varchar as p_partkey, replace(p_name || ',x', ',', '') as name from part")
def s18(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(",x")).alias("name"), F.lit(1).alias("dropped"))
    return landed.plain_text(rows, ("dropped",))


@register("s19_export_bounds", f"with {BARS_SQL} select {K}, volume from b where rn = 0 or rn = n - 1")
def s19(spark, d):
    return ref.export_bounds(bars(spark, d), ["exchange", "symbol"], "period_date").select(*KEY, "volume")


@register("s20_import_copy", f"with {BARS_SQL} select {K}, volume from b where rn % 7 <> 3")
def s20(spark, d):
    rows = numbered(bars(spark, d)).select(*KEY, "volume", "idx")
    cols = [*KEY, "volume"]
    return ref.import_copy(rows.where("idx % 2 = 0").select(*cols), rows.where("idx % 3 <> 1 or idx % 2 = 1").select(*cols), KEY, rows.where("idx % 7 = 3"))


def _staging(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("S"), x.cast("string"))
    return s.select(F.lit("EX").alias("exchange"), k.cast("string").alias("symbol"), name(k % 5).alias("a"), F.when(k % 3 == 0, "").otherwise(name(F.when(k % 7 == 0, k % 4).otherwise(k % 5))).alias("b"), F.when(k % 2 == 0, name(k % 5)).alias("c"))


_STAGE = "st as (select 'EX' as exchange, s_suppkey::varchar as symbol, 'S' || s_suppkey % 5 as a, case when s_suppkey % 3 = 0 then '' else 'S' || case when s_suppkey % 7 = 0 then s_suppkey % 4 else s_suppkey % 5 end end as b, case when s_suppkey % 2 = 0 then 'S' || s_suppkey % 5 end as c from supplier)"


@register("c15_consensus_sector", f"with {_STAGE}, u as (select exchange, symbol, unnest([a, b, c]) as v from st) select exchange, symbol, max(v) as value from u where v in ('S0', 'S1', 'S2') group by 1, 2 having count(distinct v) = 1")
def c15(spark, d):
    return ref.consensus(_staging(spark, d), ["exchange", "symbol"], ["a", "b", "c"], ["S0", "S1", "S2"])


@register("c16_consensus_founded", "select s_suppkey::varchar as symbol, case s_suppkey % 3 when 0 then (1900 + s_suppkey % 90) || '-03-07' when 1 then (1900 + s_suppkey % 90) || '-11' else (1900 + s_suppkey % 90)::varchar end as value from supplier where s_suppkey % 5 <> 0")
def c16(spark, d):
    k = F.col("s_suppkey")
    year = (1900 + k % 90).cast("string")
    when = F.when(k % 3 == 0, F.concat(F.lit("March 7, "), year)).when(k % 3 == 1, F.concat(F.lit("November "), year)).otherwise(year)
    rows = table(spark, d, "supplier").select(k.cast("string").alias("symbol"), F.concat(F.lit("The company was founded in "), when, F.lit(" by two people in 1850.")).alias("a"), F.when(k % 5 == 0, "It was incorporated in 1777.").otherwise("No date here.").alias("b"))
    return ref.consensus_founded(rows, ["symbol"], ["a", "b"])


@register("c17_consensus_ipo", f"with {BARS_SQL}, f as (select exchange, symbol, min(period_date) as f from bars group by 1, 2) select exchange, symbol, f + 3 as ipo, case when symbol::int % 2 = 0 then 1 else 2 end::bigint as candidates from f")
def c17(spark, d):
    f = bars(spark, d).groupBy("exchange", "symbol").agg(F.min("period_date").alias("f"))
    rows = f.select("exchange", "symbol", F.date_add("f", 3).alias("a"), F.when(sid() % 2 == 0, F.date_add("f", 3)).otherwise(F.date_sub("f", 50)).alias("b"))
    return ref.consensus_ipo(rows, bars(spark, d), ["a", "b"])


@register("c18_classify_asset", "select p_partkey, case p_partkey % 6 when 0 then 'WARRANT' when 1 then 'ETF' when 2 then 'TRUST' when 3 then 'WARRANT' when 4 then 'CS' else 'CS' end as asset_kind from part")
def c18(spark, d):
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "Acme Warrants 2030").when(k == 1, "Total ETF").when(k == 2, "Real Trust").otherwise("Plain Company")
    symbol = F.when(k == 3, "ABCDW").when(k == 4, "ABCW").otherwise("ABCDX")
    return ref.classify_asset(table(spark, d, "part").select("p_partkey", F.lit("NASDAQ").alias("exchange"), symbol.alias("symbol"), name.alias("name"))).select("p_partkey", "asset_kind")


@register("c19_group_share_classes", "select 'EX' || p_partkey % 9 as exchange, 'K' || p_partkey || 'A' as symbol, 'K' || p_partkey as base from part where p_partkey % 2 = 0")
def c19(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    base = part.select(F.concat(F.lit("EX"), (k % 9).cast("string")).alias("exchange"), F.concat(F.lit("K"), k.cast("string")).alias("symbol"), F.concat(F.lit("Firm"), k.cast("string"), F.lit(" common")).alias("name"))
    more = base.where(F.substring("symbol", 2, 9).cast("int") % 2 == 0).select("exchange", F.concat("symbol", F.lit("A")).alias("symbol"), "name")
    return ref.group_share_classes(base.unionByName(more))


@register("c20_merge_dot_to", "select 'TSX' as exchange, 'C' || c_custkey as symbol, case when c_custkey % 3 = 0 then c_name || ' Inc' else c_name end as name, case when c_custkey % 2 = 0 then 'S1' else 'S2' end as sector, case when c_custkey % 3 = 0 then 1 else 0 end as api from customer")
def c20(spark, d):
    k = F.col("c_custkey")
    a = table(spark, d, "customer").select(F.lit("TSX").alias("exchange"), F.concat(F.lit("C"), k.cast("string")).alias("symbol"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "S1").otherwise(F.when(k % 3 == 0, "").otherwise("S2")).alias("sector"), F.lit(0).alias("api"))
    b = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.lit("TSX").alias("exchange"), F.concat(F.lit("C"), k.cast("string"), F.lit(".TO")).alias("symbol"), F.concat("c_name", F.lit(" Inc")).alias("name"), F.lit("S2").alias("sector"), F.lit(1).alias("api"))
    return ref.merge_dot_to(a.unionByName(b))


@register("c21_resolve_exchange", "select s_suppkey::varchar as symbol, s_name as name, 'X' || s_suppkey % 4 as exchange from supplier where s_suppkey % 5 <> 0")
def c21(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    sym, name = k.cast("string").alias("symbol"), F.col("s_name").alias("name")
    own = F.concat(F.lit("X"), (k % 4).cast("string"))
    symbols = s.select(sym, name, F.when(k % 2 == 0, own).alias("source_exchange"))
    other = F.concat(F.lit("X"), ((k + 1) % 4).cast("string")).alias("exchange")
    info = s.where("s_suppkey % 5 <> 0").select(sym, own.alias("exchange"), name).unionByName(s.where("s_suppkey % 5 <> 0").select(sym, other, F.lit("unlike").alias("name"))).unionByName(s.where("s_suppkey % 5 = 0").select(sym, other, F.lit("unlike").alias("name")))
    return ref.resolve_exchange(symbols, info)[0]


@register("c23_sector_counts", f"with {_STAGE}, u as (select unnest(['a', 'b', 'c']) as s, unnest([a, b, c]) as sector from st) select sector, count(*) filter (s = 'a') as a, count(*) filter (s = 'b') as b, count(*) filter (s = 'c') as c from u where sector is not null group by 1")
def c23(spark, d):
    return ref.sector_counts(_staging(spark, d), ["a", "b", "c"])


@register("c24_source_overlap", "select (select count(*) from customer where c_custkey not in (select s_suppkey from supplier)) as only_a, (select count(*) from supplier where s_suppkey not in (select c_custkey from customer)) as only_b, (select count(*) from supplier where s_suppkey in (select c_custkey from customer)) as shared")
def c24(spark, d):
    return ref.source_overlap(table(spark, d, "customer").select(F.col("c_custkey").alias("symbol")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol")))


def _landed_json(spark, d):
    """Customers as landed objects: a flag that is sometimes text, a number, a text that is sometimes a number, a known key."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(
            F.lit('{"custKey":'), k.cast("string"), F.lit(',"isActive":'), F.when(k % 5 == 0, F.lit('"yes"')).otherwise((k % 2 == 0).cast("string")), F.lit(',"shareCount":'), (k * 10).cast("string"),
            F.lit(',"lastCode":'), F.when(k % 3 == 0, F.lit("7.5")).otherwise(F.lit('"x"')), F.lit(',"never":null'), F.when(k % 4 == 0, F.lit(',"oneName":"n"')).otherwise(F.lit("")), F.lit("}"),
        ).alias("json")
    )


@register(
    "s14_align_landed",
    """select s_suppkey as cust_key, false as is_active, null::double as share_count, null::double as last_code, null::varchar as never, null::varchar as one_name from supplier
union all select c_custkey, case when c_custkey % 5 <> 0 then c_custkey % 2 = 0 end, (c_custkey * 10)::double, case when c_custkey % 3 = 0 then 7.5 end, null, case when c_custkey % 4 = 0 then 'n' end from customer""",
)
def s14_landed(spark, d):
    return ref.align_landed(table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("cust_key")), _landed_json(spark, d))


def _stored(spark, d, name):
    """Bars of _two() as a table in folders by exchange."""
    old, new = _two(spark, d)
    t = Stored(spark, scratch(spark, name), old.schema, tuple(KEY), ("exchange",))
    t.merge(old)
    return t, new


@register("s16_stored_merge", f"{_UP}, m as (select * from n where exchange in ('EX1', 'EX2', 'EX3')) select {K}, coalesce(m.volume, o.volume) as volume, coalesce(m.transactions, o.transactions) as transactions from o full join m using ({K})")
def s16_stored(spark, d):
    t, new = _stored(spark, d, "merge")
    t.merge(new.where("exchange in ('EX1', 'EX2', 'EX3')"), "update")
    return t.read()


@register("b9_stored_delete", f"{_UP} select * from o where not (exchange = 'EX4' or volume > 100)")
def b9_stored(spark, d):
    t, _ = _stored(spark, d, "delete")
    t.delete(exchange="EX4")
    t.delete(volume=Compare(">", 100))
    return t.read()


@register("s8_load_quarters", "select o_orderkey::varchar as adsh, 'q' || o_orderkey % 3 as loaded_quarter, date '2020-03-31' as period, o_custkey::varchar as symbol, l.n as nums from orders join customer on c_custkey = o_custkey and c_custkey % 2 = 0 join (select l_orderkey, count(*) as n from lineitem group by 1) l on l_orderkey = o_orderkey where o_orderkey % 3 <> 1")
def s8_quarters(spark, d):
    """Orders as filings, their lines as numbers, in folders by quarter, of which one is loaded before the others come."""
    root, out = scratch(spark, "filings"), scratch(spark, "edgar")
    quarter = (F.col("k") % 3).cast("int")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("cik"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat_ws("-", F.lit("T"), "l_linenumber", "l_partkey", "l_suppkey").alias("tag"), F.col("l_quantity").cast("string").alias("value"))
    us = F.lit("us-gaap/2020").alias("version")
    for q in (0, 2):
        sub = orders.where(quarter == q).select(F.col("k").cast("string").alias("adsh"), "cik", F.lit("Q1").alias("fp"), F.lit("20200331").alias("period"), F.lit("20200501").alias("filed"))
        num = lines.where(quarter == q).select(F.col("k").cast("string").alias("adsh"), "tag", us, F.lit("").alias("coreg"), F.lit("20200331").alias("ddate"), F.lit("0").alias("qtrs"), F.lit("USD").alias("uom"), "value")
        tag = spark.createDataFrame([("T", "us-gaap/2020", "0", "0")], "tag string, version string, custom string, abstract string")
        for name, df in (("sub", sub), ("num", num), ("tag", tag)):
            df.write.csv(f"{root}/q{q}/{name}.txt", sep="\t", header=True)
        info = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("cik"), F.lit("EX").alias("exchange"), F.col("c_custkey").cast("string").alias("symbol"))
        landed.load_new_quarters(spark, root, out, info)
    landed.load_new_quarters(spark, root, out, info)  # nothing is new now
    sub, num = spark.read.parquet(f"{out}/sub").where("symbol is not null"), spark.read.parquet(f"{out}/num")
    return sub.join(num.groupBy("adsh").agg(F.count("*").alias("nums")), "adsh").select("adsh", "loaded_quarter", "period", "symbol", "nums")


_CASCADE_SQL = """k as (select s_suppkey as k, s_suppkey::varchar as symbol, lower(s_name) as name from supplier),
t as (select symbol, name, unnest(case k % 8 when 0 then ['N1=' || name] when 1 then ['N1=other'] when 2 then ['N1=other', 'N2=' || name] when 3 then ['N1=' || name, 'N2=' || name] when 4 then ['N2=' || name] when 5 then ['N2=' || name, 'OTCBB=' || name]
  when 6 then ['N1=other', 'N1=another'] else ['ABROAD=' || name] end) as x, k from k)"""


@register(
    "c21_listing_cascade",
    f"""with {_CASCADE_SQL},
m as (select k, symbol, split_part(x, '=', 1) as ex, split_part(x, '=', 2) = name as alike from t where split_part(x, '=', 1) <> 'ABROAD'),
c as (select k, count(m.ex) filter (ex = 'N1') as same, count(*) filter (alike) as likes, count(*) filter (alike and ex <> 'OTCBB') as first_rate, count(*) filter (alike and ex = 'N1') as shared, max(ex) filter (alike and ex <> 'OTCBB') as sake from k left join m using (k) group by k),
s as (select k, case when k % 11 = 0 then 'source' when k = 3 then 'manual' when k = 4 then 'primary' when same = 0 and l = 0 then 'quoted' when same = 0 and l = 1 then 'name' when same = 1 and l = 0 then 'exchange'
  when same = 1 and l = 1 and shared = 1 then 'both' when same = 1 and l > 1 and shared < 2 then 'both' when same > 1 and l = 1 and shared = 0 then 'name' else 'rejected' end as step, sake from (select *, case when likes > 1 then first_rate else likes end as l from c))
select k::varchar as symbol, step, case step when 'source' then 'Second' when 'manual' then 'HAND' when 'primary' then 'MAIN' when 'name' then sake when 'rejected' then null else 'N1' end as exchange from s""",
)
def c21_cascade(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    sym, name = k.cast("string").alias("symbol"), F.lower("s_name")
    symbols = s.select(sym, F.upper("s_name").alias("name"), F.lit("alias").alias("quoted"))
    one = lambda x, n: F.struct(F.lit(x).alias("exchange"), n.alias("name"))
    other, another = F.lit("other"), F.lit("another")
    cases = [[one("N1", name)], [one("N1", other)], [one("N1", other), one("N2", name)], [one("N1", name), one("N2", name)], [one("N2", name)], [one("N2", name), one("OTCBB", name)], [one("N1", other), one("N1", another)]]
    pick = F.when(F.lit(False), F.array(one("", other)))
    for i, c in enumerate(cases):
        pick = pick.when(k % 8 == i, F.array(*c))
    tickers = s.select(sym, F.explode(pick.otherwise(F.array(one("ABROAD", name)))).alias("t")).select("symbol", "t.*")
    day = lambda x: F.lit(x).cast("date").alias("delisted")
    own = s.where("s_suppkey % 11 = 0")
    listed = own.select(sym, F.lit("old").alias("exchange"), F.lit(False).alias("active"), day("2001-01-01")).unionByName(own.select(sym, F.lit("new").alias("exchange"), F.lit(False).alias("active"), day("2010-01-01"))).unionByName(own.select(sym, F.lit("unknown").alias("exchange"), F.lit(True).alias("active"), day(None)))
    aliases = spark.createDataFrame([("alias", "N1"), ("old", "First"), ("new", "Second")], "alias string, standard string")
    return ref.resolve_listing(symbols, tickers, listed, aliases, {"3": "HAND"}, {"4": ["MAIN", "N2"]}, ("N1", "N2", "OTCBB")).select("symbol", "exchange", "step")
