"""Registered queries: interest (I), earnings (E), filings (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import earnings as ear
from ..operators import financials as fin
from ..operators import interest as gi
from ..registry import register
from ..session import written
from ..sources.bars import numbered
from .fixtures import BARS_SQL, INTEREST_SQL, _numbered, bars, interest, r4, sid, written_days

TD = ["exchange", "symbol", "date"]


def _streams(spark, d):
    """Daily interest in streams of 141 days, one from every hundredth bar on, so that each overlaps the next."""
    idx = F.col("idx")
    value = ((sid() * 7 + idx * 13) % 101).cast("double")
    of = F.explode(F.sequence(F.greatest(F.ceil((idx - 140) / 100), F.lit(0)).cast("int"), F.floor(idx / 100).cast("int"))).alias("stream")
    return numbered(bars(spark, d)).select("exchange", "symbol", F.col("period_date").alias("date"), value.alias("v"), of).select(*TD, "stream", (F.col("v") + F.col("stream")).alias("relative_interest"))


STREAMS_SQL = "streams as (select exchange, symbol, period_date as date, k::int as stream, ((symbol::int * 7 + rn * 13) % 101 + k)::double as relative_interest from (select *, unnest(range(greatest(ceil((rn - 140) / 100.0), 0)::bigint, rn // 100 + 1)) as k from b))"
BLOCKS = f"with {BARS_SQL}, {STREAMS_SQL}, e as (select *, date + (6 - dayofweek(date))::int as week_end from streams), w as (select exchange, symbol, stream, week_end, count(*) as n, min(week_end) over p as f, max(week_end) over p as l, max(stream) over (partition by exchange, symbol) as top from e group by 1, 2, 3, 4 window p as (partition by exchange, symbol, stream)), blocks as (select e.* from e join w using (exchange, symbol, stream, week_end) where not (n < 7 and ((stream > 0 and week_end = f) or (stream < top and week_end = l))))"


@register("i1_week_blocks", f"{BLOCKS} select exchange, symbol, date, stream, week_end from blocks")
def i1(spark, d):
    return gi.week_blocks(_streams(spark, d)).select(*TD, "stream", "week_end")


@register("i2_merge_streams", f"{BLOCKS} select exchange, symbol, date, arg_min(relative_interest, stream) as relative_interest from blocks group by 1, 2, 3")
def i2(spark, d):
    return gi.merge_streams(gi.week_blocks(_streams(spark, d)))


MONTHS = f"with {BARS_SQL}, {INTEREST_SQL}, months as (select exchange, symbol, date_trunc('month', date)::date as month, arg_max(relative_interest, date) as value from interest group by 1, 2, 3)"


@register("i3_monthly", f"{MONTHS} select * from months")
def i3(spark, d):
    return gi.monthly(interest(spark, d))


@register("i5_relative_interest", f"{MONTHS} select exchange, symbol, date, round(relative_interest * value / 100, 4) as relative_interest from interest join months using (exchange, symbol) where date_trunc('month', date) = month")
def i5(spark, d):
    x = interest(spark, d)
    return gi.relative_interest(x, gi.monthly(x)).select(*TD, r4("relative_interest").alias("relative_interest"))


@register("i6_scale_daily", f"{MONTHS}, q as (select * from months where month(month) % 3 <> 0) select i.exchange, i.symbol, i.date, round(relative_interest * q.value / 100, 4) as relative_interest from interest i asof left join q on i.exchange = q.exchange and i.symbol = q.symbol and i.date >= q.month")
def i6(spark, d):
    x = interest(spark, d)
    return gi.scale_daily(x, gi.monthly(x).where("month(month) % 3 <> 0")).select(*TD, r4("relative_interest").alias("relative_interest"))


@register(
    "i4_project_months",
    f"""{MONTHS.replace("with bars", "with recursive bars", 1)}, sums as (select exchange, symbol, date_trunc('month', date)::date as month, sum(relative_interest) as total from interest group by 1, 2, 3),
l as (select exchange, symbol, list(s.month order by s.month) as m, list(total order by s.month) as t, list(value order by s.month) as v, count(*) as n from sums s left join (select * from months where month(month) % 4 <> 0) x using (exchange, symbol, month) group by 1, 2),
r(exchange, symbol, i, v) as (select exchange, symbol, 0::bigint, v from l
  union all select l.exchange, l.symbol, r.i + 1, list_transform(range(1, n + 1), lambda j: case when j = r.i + 1 and r.v[j] is null then t[j] * list_avg(list_transform(list_filter(range(1, n + 1), lambda k: r.v[k] is not null and t[k] > 0 and abs(m[r.i + 1] - m[k]) < 190), lambda k: r.v[k] / t[k])) else r.v[j] end)
  from r join l on l.exchange = r.exchange and l.symbol = r.symbol and r.i < n),
e as (select exchange, symbol, unnest(m) as month, unnest(r.v) as value, list_max(r.v) as top from r join l using (exchange, symbol) where i = n)
select exchange, symbol, month, round(value * case when top > 100 then 100 / top else 1 end, 4) as value from e""",
)
def i4(spark, d):
    x = interest(spark, d)
    return gi.project_months(x, gi.monthly(x).where("month(month) % 4 <> 0")).withColumn("value", r4("value"))


@register("i7_preceding_interest", f"with {BARS_SQL}, {INTEREST_SQL}, l as (select *, list(relative_interest) over (partition by exchange, symbol order by date rows between 12 preceding and 3 preceding) as v from interest) select b.exchange, b.symbol, b.period_date as date, len(v) as n, round(list_sum(list_transform(v, lambda x: case when list_max(v) > 0 then x * 100 / list_max(v) else x end)), 4) as total from b join l on l.exchange = b.exchange and l.symbol = b.symbol and l.date = b.period_date where len(v) > 0")
def i7(spark, d):
    inst = bars(spark, d).select("exchange", "symbol", F.col("period_date").alias("date"))
    out = gi.preceding_interest(inst, interest(spark, d), 10).where("size(values) > 0")
    return out.select(*TD, F.size("values").cast("long").alias("n"), r4(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@register("i8_expand_periods", f"{MONTHS} select exchange, symbol, unnest(generate_series(month, last_day(month), interval 1 day))::date as date, value from months")
def i8(spark, d):
    return gi.expand_periods(gi.monthly(interest(spark, d)).withColumnRenamed("month", "date"), "monthly")


@register("i9_interest_periods", f"with {BARS_SQL}, {INTEREST_SQL}, p as (select *, ((max(date) over (partition by exchange, symbol) - date) // 238)::int as period from interest) select exchange, symbol, period, sum(relative_interest) as total, count(*) filter (relative_interest = 0) as zeros, round(avg(relative_interest), 4) as mean from p group by 1, 2, 3")
def i9(spark, d):
    return gi.interest_periods(interest(spark, d)).withColumn("mean", r4("mean"))


@register("i10_zero_pct", f"with {BARS_SQL}, {INTEREST_SQL}, p as (select *, row_number() over (partition by exchange, symbol order by date desc) as k from interest) select exchange, symbol, round(count(*) filter (relative_interest < 1) / 183, 4) as zero_pct from p where k <= 183 group by 1, 2")
def i10(spark, d):
    return gi.zero_pct(interest(spark, d)).withColumn("zero_pct", r4("zero_pct"))


@register("i11_interest_coverage", f"with {BARS_SQL}, {INTEREST_SQL}, g as (select exchange, symbol, max(date) as g from interest where symbol::int % 4 <> 0 group by 1, 2), z as (select exchange, symbol, max(period_date) as z from bars where symbol::int % 7 <> 0 group by 1, 2), u as (select distinct exchange, symbol from bars) select exchange, symbol, case when z is null then 'NO_DATA' when g is null then 'NOT_STARTED' when g < z then 'PARTIAL' else 'UP_TO_DATE' end as status from u left join g using (exchange, symbol) left join z using (exchange, symbol)")
def i11(spark, d):
    df = bars(spark, d)
    return gi.interest_coverage(df.select("exchange", "symbol").distinct(), df.where(sid() % 7 != 0), interest(spark, d).where(sid() % 4 != 0))


@register("i12_max_stream", f"with {BARS_SQL}, {STREAMS_SQL} select exchange, symbol, 'DAILY' as type, max(stream) as stream from streams group by 1, 2")
def i12(spark, d):
    return gi.max_stream(_streams(spark, d).withColumn("type", F.lit("DAILY")))


@register("i13_match_topics", "select 'EX' as exchange, s_suppkey::varchar as symbol, s_name as name, '/m/' || s_suppkey as topic_id from supplier where s_suppkey % 2 = 0")
def i13(spark, d):
    from .fixtures import table

    s = table(spark, d, "supplier")
    tickers = s.select(F.lit("EX").alias("exchange"), F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("name"))
    topics = s.where("s_suppkey % 2 = 0").select(F.upper(F.concat(F.col("s_name"), F.lit(" ."))).alias("title"), F.concat(F.lit("/m/"), F.col("s_suppkey").cast("string")).alias("topic_id"))
    return gi.match_topics(tickers, topics)


@register("i14_split_interest", f"with {BARS_SQL} select date, cast(floor(close) as int) as a, volume::int as b, false as is_partial from (select period_date as date, close, volume from bars)")
def i14(spark, d):
    rows = bars(spark, d).select(F.col("period_date").alias("date"), F.array(F.floor("close").cast("double"), F.col("volume")).alias("value"), F.lit(None).cast("boolean").alias("is_partial"))
    return gi.split_interest(rows, ["a", "b"])


def _raw(spark, d):
    """Collected earnings rows: of two sources, with quarter ends or without, past and upcoming."""
    rows = numbered(bars(spark, d)).where("idx % 12 = 5")
    k = F.floor(F.col("idx") / 12)
    add = lambda n: F.date_add(F.col("period_date"), n.cast("int"))
    return rows.select(
        "exchange", "symbol", F.when(k % 2 == 0, "NASDAQ").otherwise("YAHOO").alias("source"), add(F.when(k % 3 == 0, -20).otherwise(15)).alias("input_date"), F.col("period_date").alias("earnings_date"),
        F.when(k % 4 != 3, add(-(F.lit(25) + (k % 5) * 40))).alias("fiscal_quarter_ending"), ((k * 5) % 7).cast("int").alias("number_of_estimates"),
        F.when(k % 4 == 0, k / 10.0).cast("double").alias("eps"),
    )


RAW = f"with {BARS_SQL}, raw as (select exchange, symbol, case when (rn // 12) % 2 = 0 then 'NASDAQ' else 'YAHOO' end as source, period_date + case when (rn // 12) % 3 = 0 then -20 else 15 end as input_date, period_date as earnings_date, case when (rn // 12) % 4 <> 3 then period_date - (25 + ((rn // 12) % 5) * 40)::int end as fiscal_quarter_ending, (((rn // 12) * 5) % 7)::int as number_of_estimates, case when (rn // 12) % 4 = 0 then ((rn // 12) / 10)::double end as eps from b where rn % 12 = 5)"
UNIQUE = f"{RAW}, uniq as (select * from raw where fiscal_quarter_ending is not null qualify row_number() over (partition by symbol, strftime(fiscal_quarter_ending, '%Y-%m') order by source = 'NASDAQ' desc, number_of_estimates desc nulls last, input_date desc, earnings_date) = 1)"


@register("e1_drop_abnormal", f"{RAW} select symbol, input_date, earnings_date from raw where fiscal_quarter_ending is null or earnings_date - fiscal_quarter_ending < 160")
def e1(spark, d):
    return ear.drop_abnormal(_raw(spark, d)).select("symbol", "input_date", "earnings_date")


@register("e2_split_known", f"{RAW} select symbol, earnings_date, earnings_date < input_date as known from raw")
def e2(spark, d):
    past, up = ear.split_known(_raw(spark, d))
    return past.withColumn("known", F.lit(True)).unionByName(up.withColumn("known", F.lit(False))).select("symbol", "earnings_date", "known")


@register("e3_unique_fqe", f"{UNIQUE} select symbol, source, input_date, earnings_date from uniq")
def e3(spark, d):
    return ear.unique_fqe(_raw(spark, d)).select("symbol", "source", "input_date", "earnings_date")


@register("e4_near_dups", f"{RAW} select symbol, earnings_date from raw o where source = 'YAHOO' and not exists (select 1 from raw k where k.source = 'NASDAQ' and k.symbol = o.symbol and abs(k.earnings_date - o.earnings_date) <= 50)")
def e4(spark, d):
    raw = _raw(spark, d)
    return ear.near_dups(raw.where("source = 'YAHOO'"), raw.where("source = 'NASDAQ'"), 50).select("symbol", "earnings_date")


def _clusters_sql(rows: str, days: int) -> str:
    """CTEs after `with recursive`: _s, the rows in order; _r, each one's cluster; clustered, the last of each cluster."""
    day = "(s.earnings_date - date '1970-01-01' + 719163)::double"
    return f"""_s as (select *, row_number() over (partition by symbol order by earnings_date, input_date) as i from {rows}),
_r(symbol, i, total, n, k) as (select symbol, i, {day}, 1, 0 from _s s where i = 1
  union all select s.symbol, s.i, case when abs({day} - r.total / r.n) <= {days} then r.total + {day} else {day} end, case when abs({day} - r.total / r.n) <= {days} then r.n + 1 else 1 end, case when abs({day} - r.total / r.n) <= {days} then r.k else r.k + 1 end
  from _r r join _s s on s.symbol = r.symbol and s.i = r.i + 1),
clustered as (select _s.* exclude (i) from _s join _r using (symbol, i) qualify row_number() over (partition by symbol, k order by i desc) = 1)"""


_RECURSE = RAW.replace("with bars", "with recursive bars", 1)


@register("e5_cluster_dates", f"{_RECURSE}, {_clusters_sql('raw', 60)} select symbol, input_date, earnings_date from clustered")
def e5(spark, d):
    return ear.cluster_dates(_raw(spark, d), 60).select("symbol", "input_date", "earnings_date")


@register("e6_year_free_diff", f"{RAW} select symbol, earnings_date, least(abs(earnings_date - make_date(year(earnings_date) - 1, month(f), d)), abs(earnings_date - make_date(year(earnings_date), month(f), d)), abs(earnings_date - make_date(year(earnings_date) + 1, month(f), d)))::int as diff from (select *, fiscal_quarter_ending as f, case when month(fiscal_quarter_ending) = 2 and day(fiscal_quarter_ending) = 29 then 28 else day(fiscal_quarter_ending) end as d from raw where fiscal_quarter_ending is not null)")
def e6(spark, d):
    rows = _raw(spark, d).where("fiscal_quarter_ending is not null")
    return rows.select("symbol", "earnings_date", ear.year_free_diff(F.col("earnings_date"), F.col("fiscal_quarter_ending")).alias("diff"))


@register("e6_avg_date", f"{RAW} select symbol, date '1970-01-01' + floor(avg(earnings_date - date '1970-01-01'))::int as mean from raw group by 1")
def e6b(spark, d):
    return _raw(spark, d).groupBy("symbol").agg(ear.avg_date(F.col("earnings_date")).alias("mean"))


def _near_year_sql(day: str, other: str) -> str:
    """`other` in the year around `day` in which it comes closest to it."""
    at = [f"make_date(year({day}) + {k}, month({other}), case when month({other}) = 2 and day({other}) = 29 then 28 else day({other}) end)" for k in (-1, 0, 1)]
    far = [f"abs({a} - {day})" for a in at]
    return f"(case when {far[0]} <= {far[1]} and {far[0]} <= {far[2]} then {at[0]} when {far[1]} <= {far[2]} then {at[1]} else {at[2]} end)"


def _typical_sql(rows: str) -> str:
    """CTEs after `with recursive`: typical, the quarters of each symbol, found row by row in a list."""
    mean = "(date '1970-01-01' + (x.total // x.n)::int)"
    fits = f"abs(t.earnings_date - {_near_year_sql('t.earnings_date', mean)}) < case when t.trusted and t.ending = x.ending then 60 else 30 end"
    day = "t.earnings_date - date '1970-01-01'"
    more = f"x.total + ({_near_year_sql('x.first', 't.earnings_date')} - date '1970-01-01')"
    return f"""_few as (select *, strftime(fiscal_quarter_ending, '%m-%d') as ending, source = 'NASDAQ' as trusted from {rows} qualify count(*) over (partition by symbol, year(earnings_date)) <= 4),
_t as (select *, row_number() over (partition by symbol order by trusted desc, earnings_date, input_date, ending nulls last) as i, count(*) over (partition by symbol) as rows_in from _few),
_q(symbol, i, found) as (
  select symbol, 0::bigint, []::struct(first date, total bigint, n bigint, ending varchar)[] from _t group by symbol
  union all
  select symbol, t.i, case
      when home > 0 then list_transform(found, lambda x, k: case when k = home then {{'first': x.first, 'total': {more}, 'n': x.n + 1, 'ending': x.ending}} else x end)
      when len(found) < 12 and (t.ending is not null or not t.trusted) then list_append(found, {{'first': t.earnings_date, 'total': ({day})::bigint, 'n': 1::bigint, 'ending': case when t.trusted then t.ending end}})
      else found end
  from (select t.*, q.found, coalesce(list_position(list_transform(q.found, lambda x: coalesce({fits}, false)), true), 0) as home from _q q join _t t on t.symbol = q.symbol and t.i = q.i + 1) t),
typical as (
  select symbol, (k - 1)::int as quarter, date '1970-01-01' + (found[k].total // found[k].n)::int as typical_date, found[k].n as n
  from (select symbol, found, unnest(range(1, len(found) + 1)) as k from _q join (select symbol, max(i) as i from _t group by symbol) using (symbol, i)))"""


def _aberrant_sql(unsure: str, known: str) -> str:
    """CTE borne_out: the rows of `unsure` that fix_aberrant() keeps."""
    apart = f"abs(u.earnings_date - {_near_year_sql('u.earnings_date', 't.typical_date')})"
    return f"""_aberrant as (select distinct symbol from (select symbol from {known} group by symbol, year(earnings_date) having count(*) > 4)),
borne_out as (select u.* exclude (own) from (select *, count(*) over (partition by symbol, year(earnings_date)) as own from {unsure}) u
  where own = 4 or symbol not in (select symbol from _aberrant) or exists (select 1 from typical t where t.symbol = u.symbol and {apart} < 30))"""


def _quarterly(spark, d):
    """Rows of which most years have four at most."""
    return _raw(spark, d).where((F.month("earnings_date") % 3 == 1) | (F.dayofmonth("earnings_date") % 6 == 1))


_QUARTERLY = f"{_RECURSE}, quarterly as (select * from raw where month(earnings_date) % 3 = 1 or day(earnings_date) % 6 = 1)"


@register("e7_typical_dates", f"{_QUARTERLY}, {_typical_sql('quarterly')} select symbol, quarter, typical_date, n from typical")
def e7(spark, d):
    return ear.typical_dates(_quarterly(spark, d))


@register("e8_fix_aberrant", f"{_QUARTERLY}, {_typical_sql('quarterly')}, unsure as (select * from raw where fiscal_quarter_ending is null), {_aberrant_sql('unsure', 'raw')} select symbol, source, earnings_date from borne_out")
def e8(spark, d):
    raw = _raw(spark, d)
    return ear.fix_aberrant(raw.where("fiscal_quarter_ending is null"), raw, ear.typical_dates(_quarterly(spark, d))).select("symbol", "source", "earnings_date")


@register("e9_condense_upcoming", f"{RAW}, n as (select *, lag(earnings_date) over (partition by symbol order by input_date, earnings_date) as p from raw where earnings_date >= input_date) select symbol, input_date, earnings_date from n where (p is null or p <> earnings_date) and not exists (select 1 from raw k where k.earnings_date < k.input_date and k.symbol = n.symbol and abs(k.earnings_date - n.earnings_date) <= 30 and n.input_date >= k.earnings_date)")
def e9(spark, d):
    past, up = ear.split_known(_raw(spark, d))
    return ear.condense_upcoming(up, past).select("symbol", "input_date", "earnings_date")


@register(
    "e10_derive_earnings",
    f"""{_RECURSE}, ok as (select * from raw where fiscal_quarter_ending is null or abs(earnings_date - fiscal_quarter_ending) < 160),
past as (select * from ok where earnings_date < input_date), up as (select * from ok where earnings_date >= input_date),
quarters as (select * from past where fiscal_quarter_ending is not null qualify row_number() over (partition by symbol, strftime(fiscal_quarter_ending, '%Y-%m') order by source = 'NASDAQ' desc, number_of_estimates desc nulls last, input_date desc, earnings_date) = 1),
lone as (select * from past o where fiscal_quarter_ending is null and not exists (select 1 from quarters q where q.symbol = o.symbol and abs(q.earnings_date - o.earnings_date) <= 30)),
{_clusters_sql('lone', 7)},
known as (select * from quarters union all by name select * from clustered),
{_typical_sql('known')},
{_aberrant_sql('clustered', 'known')},
new as (select *, lag(earnings_date) over (partition by symbol order by input_date, earnings_date) as p from up),
every as (
  select source, exchange, symbol, input_date, earnings_date from quarters union all select source, exchange, symbol, input_date, earnings_date from borne_out
  union all select source, exchange, symbol, input_date, earnings_date from new n where (p is null or p <> earnings_date) and not exists (select 1 from known k where k.symbol = n.symbol and abs(k.earnings_date - n.earnings_date) <= 30 and n.input_date >= k.earnings_date))
select distinct case when source = 'NASDAQ' then 'NASDAQ' else exchange end as exchange, symbol, input_date, earnings_date from every""",
)
def e10(spark, d):
    return ear.derive_earnings(_raw(spark, d))


@register("c25_earnings_day_histogram", f"{RAW} select x::int as day, count(symbol) as n from (select unnest(range(1, 367)) as x) left join raw on dayofyear(earnings_date) = x group by 1")
def c25(spark, d):
    return ear.earnings_day_histogram(_raw(spark, d))


TAGS = ("Assets", "AssetsCurrent", "AssetsNoncurrent", "Liabilities", "OwnTag")


def _filings(spark, d, df=None):
    """sub, num and tag of a filing for every 60th bar; every 7th filing's parts miss their total."""
    days = _numbered(spark, d, df).where("idx % 60 = 7").select("exchange", "symbol", "period_date", "idx")
    rows = written(days, "filings").withColumn("q", F.floor(F.col("idx") / 60).cast("int"))
    adsh = F.concat_ws("-", "symbol", "q")
    sub = rows.select("exchange", "symbol", adsh.alias("adsh"), F.trunc("period_date", "month").alias("period"), F.when(F.col("q") % 4 == 3, "FY").otherwise(F.concat(F.lit("Q"), (F.col("q") % 4 + 1).cast("string"))).alias("fp"), F.date_add("period_date", 30).alias("filed"))
    v = F.col("idx") + sid()
    off = F.when((F.col("q") + sid()) % 7 == 0, 5).otherwise(0)
    values = {"Assets": v * 3 + off, "AssetsCurrent": v, "AssetsNoncurrent": v * 2, "Liabilities": v % 11, "OwnTag": F.lit(1)}
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), x.cast("double").alias("value")) for t, x in values.items()])).alias("t")
    num = rows.where("q <> 2").select(adsh.alias("adsh"), F.trunc("period_date", "month").alias("ddate"), F.lit("us-gaap/2020").alias("version"), F.lit("").alias("coreg"), each).select("adsh", "ddate", "version", "coreg", "t.tag", "t.value")
    tag = spark.createDataFrame([(t, "us-gaap/2020", int(t == "OwnTag"), 0) for t in TAGS], "tag string, version string, custom int, abstract int")
    return sub, num, tag


FILINGS = f"""with {BARS_SQL}, r as (select exchange, symbol, period_date, rn, rn // 60 as q, symbol || '-' || (rn // 60) as adsh, date_trunc('month', period_date)::date as period, rn + symbol::int as v from b where rn % 60 = 7),
num as (select exchange, symbol, adsh, period as ddate, unnest(['Assets', 'AssetsCurrent', 'AssetsNoncurrent', 'Liabilities', 'OwnTag']) as tag, unnest([v * 3 + case when (q + symbol::int) % 7 = 0 then 5 else 0 end, v, v * 2, v % 11, 1])::double as value from r where q <> 2),
quarters as (select exchange, symbol, adsh, period, case when q % 4 = 3 then 4 else q % 4 + 1 end::int as quarter, period_date + 30 as filed from r where q <> 2)"""
_PARTS = [("Assets", "AssetsCurrent", 1), ("Assets", "AssetsNoncurrent", 1)]


def _parts(spark):
    return spark.createDataFrame(_PARTS, "total string, tag string, sign int")


@register("r1_edgar_quarters", f"{FILINGS} select exchange, symbol, period, quarter, filed from quarters")
def r1(spark, d):
    sub, num, _ = _filings(spark, d)
    return fin.edgar_quarters(sub, num).select("exchange", "symbol", "period", "quarter", "filed")


@register("r2_edgar_nums", f"{FILINGS} select distinct exchange, symbol, adsh, tag, ddate, value from num where tag <> 'OwnTag'")
def r2(spark, d):
    sub, num, tag = _filings(spark, d)
    return fin.edgar_nums(num, sub, tag)


@register("r3_financial_reports", f"{FILINGS} select n.exchange, n.symbol, ddate as period, quarter, filed, count(distinct tag) as tags, max(value) filter (tag = 'Assets') as assets from num n join quarters q on q.exchange = n.exchange and q.symbol = n.symbol and q.period = ddate where tag <> 'OwnTag' group by all")
def r3(spark, d):
    sub, num, tag = _filings(spark, d)
    rep = fin.financial_reports(fin.edgar_nums(num, sub, tag), fin.edgar_quarters(sub, num))
    return rep.select("exchange", "symbol", "period", "quarter", "filed", F.size("nums").cast("long").alias("tags"), F.element_at("nums", "Assets").alias("assets"))


@register("r4_balance_check", f"{FILINGS} select adsh, ddate, 'Assets' as total, max(value) filter (tag = 'Assets') as reported, sum(value) filter (tag in ('AssetsCurrent', 'AssetsNoncurrent')) as summed, max(value) filter (tag = 'Assets') = sum(value) filter (tag in ('AssetsCurrent', 'AssetsNoncurrent')) as balanced from num group by 1, 2")
def r4_(spark, d):
    _, num, _ = _filings(spark, d)
    return fin.balance_check(num, _parts(spark))


@register("r5_balance_status", f"{FILINGS}, c as (select adsh, max(value) filter (tag = 'Assets') = sum(value) filter (tag in ('AssetsCurrent', 'AssetsNoncurrent')) as ok, bool_and(value = 0) filter (tag = 'Liabilities' and ddate > date '1995-01-01') as z from num group by 1) select adsh, case when ok and z is null then 1 when ok and z then 3 when ok then 2 when z is null then -1 else 0 end as status from c")
def r5(spark, d):
    _, num, _ = _filings(spark, d)
    left = num.where("tag = 'Liabilities' and ddate > date'1995-01-01'").select("adsh", "value")
    return fin.balance_status(fin.balance_check(num, _parts(spark)), left)


@register("r6_missing_tags", f"{FILINGS} select distinct tag from num where tag not in ('Assets', 'AssetsCurrent')")
def r6(spark, d):
    _, num, tag = _filings(spark, d)
    return fin.missing_tags(num, tag.where("tag in ('Assets', 'AssetsCurrent')"))


@register("r7_unstaged", f"with {BARS_SQL} select distinct exchange, symbol from bars where symbol::int % 3 <> 0")
def r7(spark, d):
    u = bars(spark, d).select("exchange", "symbol").distinct()
    staged = u.where(sid() % 3 == 0).withColumn("source", F.lit("FMP")).unionByName(u.withColumn("source", F.lit("OTHER")))
    return fin.unstaged(u, staged, "FMP")


@register("n6_normalize_financials", f"{FILINGS} select exchange, symbol, ddate as period, max(value) filter (tag = 'Assets') / 1000 as assets from num group by 1, 2, 3")
def n6(spark, d):
    from ..operators.normalize import normalize_financials

    sub, num, tag = _filings(spark, d)
    rep = fin.financial_reports(fin.edgar_nums(num, sub, tag), fin.edgar_quarters(sub, num))
    return normalize_financials(rep, 1000).select("exchange", "symbol", "period", F.element_at("nums", "Assets").alias("assets"))


@register("j9_preceding_reports", f"{FILINGS} select b.exchange, b.symbol, b.period_date, q.period, q.quarter from b join quarters q on q.exchange = b.exchange and q.symbol = b.symbol and q.filed between b.period_date - 401 and b.period_date qualify row_number() over (partition by b.exchange, b.symbol, b.period_date order by q.period desc, q.filed desc) <= 6")
def j9(spark, d):
    from ..operators.joins import preceding_reports

    df = written_days(spark, d)
    sub, num, _ = _filings(spark, d, df)
    return preceding_reports(df, fin.edgar_quarters(sub, num), 400).select("exchange", "symbol", "period_date", "period", "quarter")


@register("s21_stage_financials", f"{FILINGS}, a as (select exchange, symbol, period, filed as date, v, q from (select *, period_date + 30 as filed from r)) select exchange, symbol, period, date, case when q % 2 = 0 then v::double end as fmp_eps, case when q % 3 = 0 then v * 2::double when q % 4 = 0 then -1.0 end as av_eps from a where q % 2 = 0 or q % 3 = 0")
def s21(spark, d):
    rows = numbered(bars(spark, d)).where("idx % 60 = 7").withColumn("q", F.floor(F.col("idx") / 60))
    base = rows.select("exchange", "symbol", F.trunc("period_date", "month").alias("period"), F.date_add("period_date", 30).alias("date"), (F.col("idx") + sid()).cast("double").alias("v"), "q")
    keys = ["exchange", "symbol", "period", "date"]
    old = base.where("q % 2 = 0").select(*keys, F.col("v").alias("fmp_eps"), F.when(F.col("q") % 4 == 0, -1.0).alias("av_eps"))
    return fin.stage_financials(old, base.where("q % 3 = 0").select(*keys, (F.col("v") * 2).alias("eps")), "av")
