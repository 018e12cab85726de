"""Registered queries: bars and reading (S1, S7, C22), labels and samples (L), normalisation (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as lab
from ..operators import normalize as norm
from ..registry import register
from ..session import written
from ..session import scratch
from ..sources.bars import date_bounds, ordered, rollup_intraday, take_daily
from .fixtures import BARS_SQL, bars, r4, table

KEY = ["exchange", "symbol", "period_date"]
K = "exchange, symbol, period_date"


@register("s1_read_daily", f"with {BARS_SQL} select {K}, round(open, 4) as open, round(high, 4) as high, round(low, 4) as low, round(close, 4) as close, volume, transactions from (select * from bars where period_date > date '1995-01-01' qualify row_number() over (partition by exchange, symbol order by period_date desc) <= 20)")
def s1(spark, d):
    rows = take_daily(bars(spark, d), "1995-01-01", 20)
    return rows.select(*KEY, *[r4(c).alias(c) for c in ("open", "high", "low", "close")], "volume", "transactions")


@register("s7_rollup_intraday", "select user_id, ts::date as day, round(first(value order by ts, value), 4) as open, round(max(value), 4) as high, round(min(value), 4) as low, round(last(value order by ts, value), 4) as close from events group by 1, 2")
def s7(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    out = rollup_intraday(rows, ["user_id", "day"], "ts", F.col("value"))
    return out.select("user_id", "day", *[r4(c).alias(c) for c in ("open", "high", "low", "close")])


@register("c22_date_bounds", f"with {BARS_SQL} select exchange, symbol, min(period_date) as first_date, max(period_date) as last_date from bars group by 1, 2")
def c22(spark, d):
    return date_bounds(bars(spark, d))


LABEL = f"with {BARS_SQL}, c as (select *, case when ph = 0 then 0 else lead(low, 10) over (partition by exchange, symbol order by period_date) / ph - 1 end as change from b), l as (select *, case when change is null then null when change >= 0.05 then 'POSITIVE' else 'NEGATIVE' end as cls from c)"
ANY = f"with {BARS_SQL}, c as (select *, case when lead(low, 10) over w is null then null else {{agg}}(low) over (partition by exchange, symbol order by period_date rows between 1 following and 9 following) end as l from b window w as (partition by exchange, symbol order by period_date))"


@register("l1_label", f"{LABEL} select {K}, round(change, 4) as change, cls from l where change is not null")
def l1(spark, d):
    return lab.label(bars(spark, d), 10, 0.05).where("cls is not null").select(*KEY, r4("change").alias("change"), "cls")


@register("l1_label_any_day", ANY.format(agg="min") + f" select {K}, round(l - ph, 4) as change, case when l - ph <= -100 then 'POSITIVE' else 'NEGATIVE' end as cls from c where l - ph is not null")
def l1_any(spark, d):
    return lab.label(bars(spark, d), 10, -100, percentage=False, any_day=True).where("cls is not null").select(*KEY, r4("change").alias("change"), "cls")


@register("l2_label_normalized", f"{LABEL} select {K}, round((change + 0.5) * 2000, 4) as change from l where change is not null")
def l2(spark, d):
    return lab.change(bars(spark, d), 10, norm_max=2000, offset=0.5).where("change is not null").select(*KEY, r4("change").alias("change"))


@register("l3_selections", f"with {BARS_SQL} select {K}, rn as idx, n from b where rn >= 81 and rn < n - 10")
def l3(spark, d):
    return lab.selections(bars(spark, d), 60, 10, 20).select(*KEY, F.col("idx").cast("long").alias("idx"), "n")


@register("l4_enough_rows", f"with {BARS_SQL} select exchange, symbol, count(*) as n from bars group by 1, 2 having count(*) >= 531")
def l4(spark, d):
    return lab.enough_rows(bars(spark, d), 500, 30)


@register("l5_class_counts", f"{LABEL} select exchange, symbol, count(*) filter (cls = 'POSITIVE') as positive, count(*) filter (cls = 'NEGATIVE') as negative from l where cls is not null group by 1, 2 having positive > 0")
def l5(spark, d):
    return lab.class_counts(lab.label(bars(spark, d), 10, 0.05).where("cls is not null"), True)


SHAPE = f"""with {BARS_SQL}, s as (select *, max(high) over w as top, min(low) over w as bottom, count(*) over w as c from b window w as (partition by exchange, symbol order by period_date rows between current row and 19 following)),
shaped as (select *, case when open > close then 'DECREASING' else 'INCREASING' end || case when top > greatest(open, close) and bottom < least(open, close) then 'WITHBETTERHIGHANDWORSELOW' when top > greatest(open, close) then 'WITHBETTERHIGH' when bottom < least(open, close) then 'WITHWORSELOW' else '' end as shape from s where c = 20)"""


@register("l6_range_type", f"{SHAPE} select {K}, shape from shaped")
def l6(spark, d):
    return lab.range_type(bars(spark, d), 20).where("shape is not null").select(*KEY, "shape")


@register("l7_range_type_counts", f"{SHAPE.replace('19 following', '1 following').replace('c = 20', 'c = 2')} select shape, count(*) as n from shaped group by 1")
def l7(spark, d):
    return lab.range_type_counts(bars(spark, d), 2)


@register("l8_drop_histogram", f"with {BARS_SQL}, c as (select floor(100 * greatest(0, 1 - lead(low, 10) over (partition by exchange, symbol order by period_date) / ph))::int as pct, ph, lead(low, 10) over (partition by exchange, symbol order by period_date) as l from b), h as (select pct, count(*) as n from c where ph is not null and l is not null group by 1) select pct, n, coalesce(sum(n) over (order by pct desc rows between unbounded preceding and 1 preceding), 0)::bigint as exceeding from h")
def l8(spark, d):
    return lab.drop_histogram(bars(spark, d), 10)


def _sims(df):
    return df.select(*KEY, (F.col("symbol").cast("int") * 31 + F.dayofyear("period_date") * 17) .alias("_x")).select(*KEY, (F.col("_x") % 997).cast("double").alias("value"))


@register(
    "l9_reduce_instances",
    LABEL + """, neg as (select exchange, symbol, period_date, row_number() over w - 1 as r, count(*) over (partition by exchange, symbol) as m from (
    select *, (symbol::int * 31 + dayofyear(period_date) * 17) % 997 as v from l where cls = 'NEGATIVE') window w as (partition by exchange, symbol order by v, period_date)),
mid as (select *, floor(m * 0.03) as lo, m - ceil(m * 0.5) - 1 as hi from neg),
gone as (select * from mid where r >= lo and r < hi and (r - lo) not in (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597))
select exchange, symbol, period_date, cls from l where cls is not null and not exists (select 1 from gone g where g.exchange = l.exchange and g.symbol = l.symbol and g.period_date = l.period_date)""",
)
def l9(spark, d):
    inst = written(lab.label(bars(spark, d), 10, 0.05).where("cls is not null").select(*KEY, "cls"), "instances")
    return lab.reduce_instances(inst, _sims(inst))


@register(
    "l9_reduce_descending",
    LABEL + """, neg as (select exchange, symbol, period_date, row_number() over w - 1 as r, count(*) over (partition by exchange, symbol) as m from (
    select *, (symbol::int * 31 + dayofyear(period_date) * 17) % 997 as v from l where cls = 'NEGATIVE') window w as (partition by exchange, symbol order by v, period_date)),
mid as (select *, floor(m * 0.03) as lo, m - ceil(m * 0.2) - 1 as hi from neg),
gone as (select * from mid where r >= lo and r < hi and (hi - 1 - r) not in (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597))
select exchange, symbol, period_date, cls from l where cls is not null and not exists (select 1 from gone g where g.exchange = l.exchange and g.symbol = l.symbol and g.period_date = l.period_date)""",
)
def l9_descending(spark, d):
    inst = written(lab.label(bars(spark, d), 10, 0.05).where("cls is not null").select(*KEY, "cls"), "instances")
    return lab.reduce_instances(inst, _sims(inst), top=0.2, descending=True)


@register("l10_balanced_sample", f"{LABEL} select cls, least(count(*), case when cls = 'POSITIVE' then 50 else 250 end)::bigint as n from l where cls is not null group by 1")
def l10(spark, d):
    inst = lab.label(bars(spark, d), 10, 0.05).where("cls is not null").select(*KEY, "cls")
    return lab.balanced_sample(inst, 300, 1 / 6, 1).groupBy("cls").agg(F.count("*").alias("n"))


@register("l11_split", f"{LABEL}, k as (select cls, count(*) as n from l where cls is not null group by 1), f as (select cls, n, floor(n * 0.7)::bigint as a, floor(n * 0.9)::bigint as b from k) select cls, 'train' as part, a as n from f union all select cls, 'validation', b - a from f union all select cls, 'test', n - b from f")
def l11(spark, d):
    inst = lab.label(bars(spark, d), 10, 0.05).where("cls is not null").select(*KEY, "cls")
    return lab.split(inst, 0.7, 0.2).groupBy("cls", "part").agg(F.count("*").alias("n"))


@register("l16_saved_sets", f"{LABEL}, p as (select exchange, symbol, period_date, row_number() over (partition by exchange, symbol order by period_date) as k from l where cls is not null) select exchange, symbol, period_date, case when k % 10 < 7 then 'train' when k % 10 < 9 then 'validation' else 'test' end as part, 'net' as network, 2::int as set_id from p")
def l16(spark, d):
    inst = lab.label(bars(spark, d), 10, 0.05).where("cls is not null")
    k = F.row_number().over(ordered()) % 10
    sets = inst.withColumn("part", F.when(k < 7, "train").when(k < 9, "validation").otherwise("test"))
    path = scratch(spark, "saved-sets")
    lab.save_sets(inst.select(*KEY, F.lit("test").alias("part")), path, "net", 2)
    lab.save_sets(sets, path, "net")  # in place of the one before
    lab.save_sets(sets.where("part = 'test'"), path, "other", 1)
    return lab.read_sets(spark, path, "net", 2)


_RANKED = LABEL + ", c as (select exchange, symbol, count(*) filter (cls = 'POSITIVE') as p, count(*) as t from l where cls is not null group by 1, 2), o as (select *, row_number() over (order by case when abs(p / t - 0.1) <= 0.02 then 0 when abs(p / t - 0.1) <= 0.05 then 1 else 2 end, t desc, exchange, symbol) - 1 as k from c)".replace(" c as (", " cc as (").replace("from c)", "from cc)")


@register("l12_assign_windows", _RANKED + " select exchange, symbol, (case when k % 8 < 4 then k % 8 else 7 - k % 8 end)::int as window from o")
def l12(spark, d):
    counts = lab.class_counts(lab.label(bars(spark, d), 10, 0.05).where("cls is not null"))
    return lab.assign_windows(counts, 4, 0.1).select("exchange", "symbol", "window")


@register("l14_page", f"with {BARS_SQL} select exchange, symbol from (select distinct exchange, symbol from bars) qualify (row_number() over (order by exchange, symbol) - 1) // 7 = 1")
def l14(spark, d):
    return lab.page(bars(spark, d).select("exchange", "symbol").distinct(), 7, 1)


@register("l15_instance_ratio", f"{LABEL} select round(avg(case when cls = 'POSITIVE' then 1.0 else 0.0 end), 4) as ratio from l where cls is not null")
def l15(spark, d):
    return lab.instance_ratio(lab.label(bars(spark, d), 10, 0.05).where("cls is not null")).select(r4("ratio").alias("ratio"))


MEANS = f"with {BARS_SQL}, m as (select exchange, symbol, avg(high) as h, avg(volume) as v, max(high) as mh, max(volume) as mv from bars group by 1, 2)"


@register("n1_cap_stddev", f"{MEANS} select round(avg(h) + 2.5 * stddev_pop(h), 4) as high_cap, round(avg(v) + 2.5 * stddev_pop(v), 4) as volume_cap from m")
def n1(spark, d):
    return norm.caps(bars(spark, d)).select(r4("high_cap").alias("high_cap"), r4("volume_cap").alias("volume_cap"))


@register("n2_cap_max", f"{MEANS} select round(max(mh), 4) as high_cap, round(max(mv), 4) as volume_cap from m where symbol <> '1'")
def n2(spark, d):
    df = bars(spark, d)
    out = norm.caps(df, {"high": "max", "volume": "max"}, exclude=df.where("symbol = '1'").select("exchange", "symbol").distinct())
    return out.select(r4("high_cap").alias("high_cap"), r4("volume_cap").alias("volume_cap"))


@register("n3_caps_by_method", f"{MEANS} select round(max(mh), 4) as high_cap, round(avg(v) + 2.5 * stddev_pop(v), 4) as volume_cap from m")
def n3(spark, d):
    return norm.caps(bars(spark, d), {"high": "max", "volume": "stddev"}).select(r4("high_cap").alias("high_cap"), r4("volume_cap").alias("volume_cap"))


@register("n4_normalize", f"{MEANS}, c as (select avg(h) + 2.5 * stddev_pop(h) as hc, avg(v) + 2.5 * stddev_pop(v) as vc from m) select {K}, round(open / hc - 0.5, 4) as open, round(close / hc - 0.5, 4) as close, round(volume / vc - 0.5, 4) as volume from bars, c")
def n4(spark, d):
    df = bars(spark, d)
    return norm.normalize(df, norm.caps(df), 0.5).select(*KEY, r4("open").alias("open"), r4("close").alias("close"), r4("volume").alias("volume"))


@register("n4_denormalize", f"with {BARS_SQL} select {K}, close::float as close, volume::float as volume from bars")
def n4_back(spark, d):
    df = bars(spark, d)
    caps = norm.caps(df)
    return norm.denormalize(norm.normalize(df, caps, 0.5), caps, 0.5).select(*KEY, F.col("close").cast("float").alias("close"), F.col("volume").cast("float").alias("volume"))
