"""Registered queries: consolidation, gaps and checks (C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import quality as q
from ..operators.predicates import Compare, Like, Null
from ..registry import register
from ..session import written
from ..sources.bars import numbered
from .calendar import _years, holidays_sql
from .fixtures import BARS_SQL, EARNINGS_SQL, INTEREST_SQL, SPLITS_SQL, VIX_SQL, bars, earnings, interest, r4, sid, splits, table, vix

KEY = ["exchange", "symbol", "period_date"]
K = "exchange, symbol, period_date"
DAYS = f"with {BARS_SQL}, {holidays_sql()}"
GAPS = f"{DAYS}, bounds as (select exchange, symbol, min(period_date) as a, max(period_date) as z from bars group by 1, 2), gaps as (select exchange, symbol, date as period_date, ordinal from bounds join md on date between a and z where not exists (select 1 from bars x where x.exchange = bounds.exchange and x.symbol = bounds.symbol and x.period_date = md.date))"


def _days(spark, d):
    return cal.market_days(spark, *_years(spark, d))


def _info(spark, d):
    """Three listings per supplier: by nation, by region, and a delisted one."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.col("s_name").alias("name"))
    sym = F.col("k").cast("string").alias("symbol")
    a = s.select(F.concat(F.lit("EX"), F.col("n").cast("string")).alias("exchange"), sym, "name", F.lit(True).alias("active"), F.lit(None).cast("date").alias("delisted"))
    b = s.where("k % 2 = 0").select(F.concat(F.lit("EX"), (F.col("n") % 5).cast("string")).alias("exchange"), sym, F.concat(F.lit("A "), "name").alias("name"), F.lit(True).alias("active"), F.lit(None).cast("date").alias("delisted"))
    c = s.where("k % 3 = 0").select(F.lit("OLD").alias("exchange"), sym, "name", F.lit(False).alias("active"), F.expr("date_add(date'1999-01-01', cast(k as int))").alias("delisted"))
    return a, b, c


INFO_SQL = """info as (select 'EX' || s_nationkey as exchange, s_suppkey::varchar as symbol, s_name as name, true as active, null::date as delisted from supplier
 union all select 'EX' || (s_nationkey % 5), s_suppkey::varchar, 'A ' || s_name, true, null from supplier where s_suppkey % 2 = 0
 union all select 'OLD', s_suppkey::varchar, s_name, false, date '1999-01-01' + s_suppkey::int from supplier where s_suppkey % 3 = 0)"""


@register("c1_symbol_universe", f"with {BARS_SQL}, {INFO_SQL}, ok as (select exchange, symbol from bars group by 1, 2 having max(high) <= 104000 and max(volume) <= 200) select exchange, symbol, min(name) as name from info where active and symbol <> '3' group by 1, 2 having (exchange, symbol) in (select exchange, symbol from ok)")
def c1(spark, d):
    df = bars(spark, d)
    a, b, c = _info(spark, d)
    out = q.symbol_universe([a, b, c], df, {"high": 104000, "volume": 200}, a.where("symbol = '3'").unionByName(b.where("symbol = '3'")).select("exchange", "symbol"))
    return out


_TOPICS = "topics as (select distinct on (exchange, symbol) exchange, symbol, topic_id from (select 'EX' || s_nationkey as exchange, s_suppkey::varchar as symbol, 't' || s_suppkey % 3 as topic_id, date '2020-01-01' as d from supplier where s_suppkey % 4 <> 0 union all select 'EX' || s_nationkey, s_suppkey::varchar, 't' || s_suppkey % 2, date '2021-01-01' from supplier where s_suppkey % 6 = 1) order by exchange, symbol, d desc, topic_id desc)"
_UNIVERSE = f"with {BARS_SQL}, {INFO_SQL}, {_TOPICS}, {EARNINGS_SQL}"


def _topics(spark, d):
    k = F.col("s_suppkey")
    one = lambda n, where, day: table(spark, d, "supplier").where(where).select(F.concat(F.lit("EX"), F.col("s_nationkey").cast("string")).alias("exchange"), k.cast("string").alias("symbol"), F.concat(F.lit("t"), (k % n).cast("string")).alias("topic_id"), F.lit(day).cast("date").alias("last_checked_date"))
    return one(3, "s_suppkey % 4 <> 0", "2020-01-01").unionByName(one(2, "s_suppkey % 6 = 1", "2021-01-01"))


@register(
    "c1_universe_predicates",
    f"""{_UNIVERSE}, u as (select exchange, symbol, min(name) as name from info where active and (delisted is null or delisted > date '2000-01-01') group by 1, 2)
select 'id' as asked, * from u where (exchange, symbol) in (select exchange, symbol from topics where topic_id in ('t1', 't2')) and (exchange, symbol) in (select exchange, symbol from earnings)
union all select 'none', * from u where (exchange, symbol) not in (select exchange, symbol from topics)
union all select 'any', * from u where (exchange, symbol) in (select exchange, symbol from topics) and (exchange, symbol) in (select exchange, symbol from bars where volume > 80 and close < 60000)
union all select 'delisted', exchange, symbol, min(name) from info where not active and exchange like 'O%' group by 2, 3""",
)
def c1_predicates(spark, d):
    df, topics, told = bars(spark, d), _topics(spark, d), earnings(spark, d)
    sources = list(_info(spark, d))
    cases = {
        "id": q.symbol_universe(sources, topics=topics, topic=["t1", "t2"], earnings=told),
        "none": q.symbol_universe(sources, topics=topics, topic=Null()),
        "any": q.symbol_universe(sources, df, topics=topics, topic=Null(False), daily_where={"volume": Compare(">", 80), "close": Compare("<", 60000)}),
        "delisted": q.symbol_universe(sources, active=False, exchange=Like("O%")),
    }
    parts = [u.withColumn("asked", F.lit(k)) for k, u in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("c2_order_universe", f"with {BARS_SQL}, {INTEREST_SQL}, u as (select distinct exchange, symbol from bars), v as (select exchange, symbol, sum(volume) as v from bars where period_date between date '1998-06-20' and date '1998-06-30' group by 1, 2), g as (select exchange, symbol, sum(relative_interest) as g from interest where date between date '1998-06-20' and date '1998-06-30' group by 1, 2) select exchange, symbol, coalesce(v, 0) + coalesce(g, 0) as weight from u left join v using (exchange, symbol) left join g using (exchange, symbol)")
def c2(spark, d):
    df = bars(spark, d)
    return q.order_universe(df.select("exchange", "symbol").distinct(), df, interest(spark, d), "both", "1998-06-30")


_HIST = "case when rn % 3 = 0 then rn % 2 = 0 end"


@register(
    "c3_consolidate_daily",
    f"""with {BARS_SQL}, av as (select {K}, close + 1 as close, 0 as prio from b where rn % 5 = 0),
hist as (select {K}, close + 2 as close, 1 as prio from b where rn % 3 = 0 and rn % 2 <> 0), poly as (select 'EX' || s_nationkey as exchange, symbol, period_date, close + 3 as close, 2 as prio from b join supplier on s_suppkey::varchar = symbol where rn % 2 = 0)
select {K}, round(close, 4) as close, prio from (select * from av union all select * from hist union all select * from poly) qualify row_number() over (partition by {K} order by prio) = 1""",
)
def c3(spark, d):
    rows = numbered(bars(spark, d))
    av = rows.where("idx % 5 = 0").withColumn("close", F.col("close") + 1)
    hist = rows.where("idx % 3 = 0").withColumn("close", F.col("close") + 2).withColumn("artificial", F.col("idx") % 2 == 0)
    poly = rows.where("idx % 2 = 0").withColumn("close", F.col("close") + 3).withColumnRenamed("symbol", "ticker").drop("exchange")
    a, _, c = _info(spark, d)
    aliases = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("alias"), F.concat(F.lit("EX"), F.col("n_nationkey").cast("string")).alias("exchange"))
    info = a.withColumn("exchange", F.concat(F.lit("N"), F.substring("exchange", 3, 9))).unionByName(c)
    return q.consolidate_daily(av, hist, poly, info, aliases).select(*KEY, r4("close").alias("close"), "prio")


@register("c4_find_gaps", f"{GAPS} select exchange, symbol, count(*) as n, min(period_date) as first_gap, max(period_date) as last_gap, sum(ordinal)::bigint as ordinals from gaps group by 1, 2")
def c4(spark, d):
    g = q.find_gaps(bars(spark, d), _days(spark, d))
    return g.groupBy("exchange", "symbol").agg(F.count("*").alias("n"), F.min("period_date").alias("first_gap"), F.max("period_date").alias("last_gap"), F.sum("ordinal").alias("ordinals"))


@register("j13_missing_days", f"{DAYS}, {INTEREST_SQL}, bounds as (select exchange, symbol, min(date) as a, max(date) as z from interest group by 1, 2) select exchange, symbol, md.date as period_date, ordinal from bounds join md on md.date between a and z where not exists (select 1 from interest x where x.exchange = bounds.exchange and x.symbol = bounds.symbol and x.date = md.date)")
def j13(spark, d):
    return q.missing_days(interest(spark, d).withColumnRenamed("date", "period_date"), _days(spark, d))


@register("c5_damaged_tickers", f"{GAPS}, i as (select exchange, symbol, ordinal - row_number() over (partition by exchange, symbol order by ordinal) as g from gaps), r as (select exchange, symbol, count(*) as run from i group by exchange, symbol, g) select exchange, symbol, max(run) as longest from r where run > 12 group by 1, 2")
def c5(spark, d):
    return q.longest_gaps(bars(spark, d), cal.calendar(spark, *_years(spark, d)), 12)


@register("c6_fill_stock_gaps", f"{GAPS}, filled as (select exchange, symbol, period_date, (select arg_max(x.close, x.period_date) from bars x where x.exchange = gaps.exchange and x.symbol = gaps.symbol and x.period_date < gaps.period_date) as c from gaps) select exchange, symbol, true as artificial, count(*) as n, round(sum(c), 4) as total from filled group by 1, 2 union all select exchange, symbol, false, count(*), round(sum(close), 4) from bars group by 1, 2".replace("round(sum(c), 4)", "round(avg(c), 2)").replace("round(sum(close), 4)", "round(avg(close), 2)"))
def c6(spark, d):
    df = bars(spark, d)
    f = q.fill_stock_gaps(df, q.find_gaps(df, _days(spark, d)))
    return f.groupBy("exchange", "symbol", "artificial").agg(F.count("*").alias("n"), F.round(F.avg("close"), 2).alias("total"))


def _option_bars(spark, d):
    """A contract per supplier that expires after its last bar, with every fifth of its bars missing."""
    last = F.max("period_date").over(Window.partitionBy("symbol"))
    rows = numbered(bars(spark, d).repartition("symbol")).withColumn("expiration_date", F.date_add(last, 5)).withColumnRenamed("symbol", "ticker")
    rows = written(rows.select("ticker", "expiration_date", "period_date", "idx", "open", "high", "low", "close"), "options")
    return rows.where("idx % 5 <> 2"), rows.where("idx % 5 = 2")


@register(
    "c7_fill_option_gaps",
    f"""with {BARS_SQL}, o as (select symbol as ticker, period_date, rn, open, high, low, close, max(period_date) over (partition by symbol) + 5 as e from b),
have as (select ticker, e, period_date, open, high, low, close from o where rn % 5 <> 2 union all select distinct ticker, e, e + 1, 0, 0, 0, 0 from o),
gap as (select o.ticker, o.period_date, (o.period_date - p.period_date)::double / (n.period_date - p.period_date) as f, p.open as po, n.open as no, p.high as ph, n.high as nh, p.low as pl, n.low as nl, p.close as pc, n.close as nc
  from o asof join have p on o.ticker = p.ticker and o.period_date > p.period_date asof join have n on o.ticker = n.ticker and o.period_date < n.period_date where o.rn % 5 = 2),
line as (select ticker, period_date, po + (no - po) * f as open, ph + (nh - ph) * f as high, pl + (nl - pl) * f as low, pc + (nc - pc) * f as close from gap)
select ticker, period_date, round(greatest(open, low), 4) as open, round(high, 4) as high, round(low, 4) as low, round(least(close, high), 4) as close, true as artificial from line
union all select ticker, period_date, round(open, 4), round(high, 4), round(low, 4), round(close, 4), period_date > e from have""",
)
def c7(spark, d):
    have, gaps = _option_bars(spark, d)
    return q.fill_option_gaps(have, gaps).select("ticker", "period_date", *[r4(c).alias(c) for c in ("open", "high", "low", "close")], "artificial")


@register(
    "c8_fill_vix",
    f"""{DAYS}, {VIX_SQL}, v as (select * from vix where day(period_date) % 4 <> 0), wanted as (select d as period_date from days where isodow(d) < 6 and d between (select min(period_date) from v) and (select max(period_date) from v)),
a as (select coalesce(w.period_date, v.period_date) as period_date, v.close, case when v.close is not null then 0 when coalesce(w.period_date, v.period_date) in (select date from us) then 2 else 1 end as artificial from wanted w full join v on w.period_date = v.period_date)
select period_date, round(coalesce(close, (select arg_max(x.close, x.period_date) from v x where x.period_date < a.period_date)), 4) as close, artificial from a""",
)
def c8(spark, d):
    y = _years(spark, d)
    v = vix(spark, d).where(F.dayofmonth("period_date") % 4 != 0)
    days = cal.calendar(spark, *y).where(~F.dayofweek("date").isin(1, 7))
    return q.fill_vix(v, days, cal.holidays(spark, *y, "US")).select("period_date", r4("close").alias("close"), "artificial")


@register("c10_detect_splits", f"with {BARS_SQL}, r as (select *, close / lead(close) over (partition by exchange, symbol order by period_date) as ratio from b) select {K}, round(ratio, 4) as ratio from r where ratio >= 2 or ratio <= 0.5")
def c10(spark, d):
    return q.detect_splits(bars(spark, d)).select(*KEY, r4("ratio").alias("ratio"))


@register(
    "c11_validate_splits",
    f"""with {BARS_SQL}, {SPLITS_SQL}, near as (select s.*, x.period_date, x.open, x.close, row_number() over (partition by s.exchange, s.symbol, s.date order by x.period_date desc) as k from splits s join bars x on x.exchange = s.exchange and x.symbol = s.symbol and x.period_date <= s.date and s.date - x.period_date <= 4),
p as (select exchange, symbol, date, split_from, split_to, max(open) filter (k = 1) as o, max(close) filter (k = 2) as c from near where k <= 2 group by all)
select exchange, symbol, date, case when c is null then 0 when abs(c / o / (split_to / split_from) - 1) <= 0.25 then 1 when abs(c / o - 1) < 1e-9 then -1 else 0 end as status from p""",
)
def c11(spark, d):
    return q.validate_splits(splits(spark, d), bars(spark, d)).select("exchange", "symbol", "date", "status")


@register("c12_splits_too_close", f"with {BARS_SQL}, {SPLITS_SQL}, g as (select *, date - lag(date) over (partition by exchange, symbol order by date) as gap from splits) select exchange, symbol, date, gap::int as gap from g where gap < 420")
def c12(spark, d):
    return q.splits_too_close(splits(spark, d), bars(spark, d), 420).select("exchange", "symbol", "date", "gap")


@register("c13_artificial_runs", f"with {BARS_SQL}, a as (select exchange, symbol, rn, (rn // 7 + symbol::int) % 3 <> 0 as art from b where exchange <> 'EX1'), g as (select exchange, symbol, rn - row_number() over (partition by exchange, symbol order by rn) as g from a where art), r as (select exchange, symbol, count(*) as run from g group by exchange, symbol, g) select exchange, symbol, max(run) as longest from r where run > 13 group by 1, 2")
def c13(spark, d):
    rows = numbered(bars(spark, d)).withColumn("artificial", (F.floor(F.col("idx") / 7) + sid()) % 3 != 0)
    return q.artificial_runs(rows, 13, ("EX1",))


@register("c14_superseded_active", f"with {INFO_SQL}, a as (select exchange, symbol, date '1999-02-10' as ts from info where active), g as (select 'EX' || s_nationkey as exchange, s_suppkey::varchar as symbol, date '1999-01-01' + s_suppkey::int as delisted from supplier where s_suppkey % 3 = 0) select distinct exchange, symbol, delisted from a join g using (exchange, symbol) where delisted > ts")
def c14(spark, d):
    a, b, c = _info(spark, d)
    gone = c.drop("exchange").join(a.select("symbol", "exchange"), "symbol")
    info = a.unionByName(b).unionByName(gone.select(*a.columns)).withColumn("timestamp", F.lit("1999-02-10 00:00:00").cast("timestamp"))
    return q.superseded_active(info).select("exchange", "symbol", "delisted").distinct()
