"""Registered queries: feature encodings and vectors (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import labels as lab
from ..operators.joins import next_earnings
from ..registry import register
from ..sources.bars import numbered
from .company import FILINGS, _filings
from .fixtures import BARS_SQL, EARNINGS_SQL, VIX_SQL, bars, earnings, interest, r4, splits, written_bars, written_days

KEY = ["exchange", "symbol", "period_date"]
K = "exchange, symbol, period_date"


def _hot(i: str, n: int) -> str:
    return f"list_transform(range(0, {n}), lambda x: case when x = {i} then 1.0 else 0.0 end::double)"


def _r(c):
    return F.transform(c, lambda x: F.floor(x * 10000 + 0.5) / 10000)


@register("g1_price_series", f"with {BARS_SQL}, s as (select *, list([open, high, low, close, volume]) over (partition by exchange, symbol order by period_date rows between 5 preceding and 1 preceding) as l from b) select {K}, list_transform(flatten(l), lambda x: floor(x * 10000 + 0.5) / 10000) as x from s where len(l) = 5")
def g1(spark, d):
    out = ft.series(bars(spark, d), ft.PRICE_SERIES, 5).where("size(series) = 5")
    return out.select(*KEY, _r(F.flatten("series")).alias("x"))


@register("g3_calendar_one_hot", f"with {BARS_SQL} select {K}, {_hot('isodow(period_date) - 1', 5)} as dow, {_hot('day(period_date) - 1', 31)} as dom, {_hot('month(period_date) - 1', 12)} as moy from b")
def g3(spark, d):
    rows = bars(spark, d)
    p = F.col("period_date")
    return rows.select(*KEY, ft.day_of_week(p).alias("dow"), ft.day_of_month(p).alias("dom"), ft.month_of_year(p).alias("moy"))


@register("g3_calendar_scaled", f"with {BARS_SQL} select {K}, round((isodow(period_date) - 1) / 6.0 - 0.5, 4) as dow, round(day(period_date) / day(last_day(period_date))::double - 0.5, 4) as dom, round(month(period_date) / 12.0::double - 0.5, 4) as moy from bars")
def g3b(spark, d):
    p = F.col("period_date")
    one = lambda f: r4(f(p, "scaled")[0])
    return bars(spark, d).select(*KEY, one(ft.day_of_week).alias("dow"), one(ft.day_of_month).alias("dom"), one(ft.month_of_year).alias("moy"))


@register("g4_split_features", f"with {BARS_SQL} select {K}, [1.0::double, (1 + rn % 3)::double] as x from b where rn % 97 = symbol::int % 97")
def g4(spark, d):
    return splits(spark, d).select("exchange", "symbol", F.col("date").alias("period_date"), ft.split_features(F.col("split_from"), F.col("split_to")).alias("x"))


_NEXT = f"with {BARS_SQL}, n as (select exchange, symbol, period_date, case when rn % 3 = 0 then null else period_date + ((rn % 40)::int - 12) end as nd from b)"


def _next(spark, d):
    rows = numbered(bars(spark, d))
    return rows.select(*KEY, F.when(F.col("idx") % 3 != 0, F.expr("date_add(period_date, cast(idx % 40 as int) - 12)")).alias("nd"))


@register("g5_earnings_features", f"{_NEXT} select {K}, [(nd is not null)::int::double, coalesce((nd - period_date)::double, 0)] as two, [(nd is not null)::int::double, coalesce((nd >= period_date)::int::double, 0), coalesce((nd < period_date)::int::double, 0), coalesce(abs(nd - period_date) / 50.0::double, 0)] as four from n")
def g5(spark, d):
    p, n = F.col("period_date"), F.col("nd")
    return _next(spark, d).select(*KEY, ft.earnings_features(p, n).alias("two"), ft.earnings_features(p, n, 4, 50.0).alias("four"))


@register("g5_earnings_similarity", f"{_NEXT} select {K}, round(case when nd is null then 1.0 when nd >= period_date then 0.7 * (1 - least(nd - period_date, 90) / 90.0::double) else 0.7 + 0.3 * least(period_date - nd, 7) / 7 end, 4) as s from n")
def g5b(spark, d):
    return _next(spark, d).select(*KEY, r4(ft.earnings_similarity(F.col("period_date"), F.col("nd"))).alias("s"))


@register("g6_financial_features", f"""{FILINGS}, rep as (select b.exchange, b.symbol, b.period_date, q.period, q.quarter, (select max(value) from num n where n.adsh = q.adsh and tag = 'Assets') as assets from b join quarters q on q.exchange = b.exchange and q.symbol = b.symbol and q.filed between b.period_date - 401 and b.period_date qualify row_number() over (partition by b.exchange, b.symbol, b.period_date order by q.period desc, q.filed desc) <= 6),
last as (select *, row_number() over (partition by exchange, symbol, period_date order by period desc) as k from rep) select exchange, symbol, period_date, 5 as quarters, least(count(*), 5)::bigint as present, sum(assets) filter (k <= 5) as assets from last group by 1, 2, 3""")
def g6(spark, d):
    df = written_days(spark, d)
    total = lambda quarters, i: F.aggregate(quarters, F.lit(0.0), lambda a, q: a + q[i])
    told = lambda quarters: F.struct(F.size(quarters).alias("quarters"), total(quarters, 0).cast("long").alias("present"), total(quarters, 6).alias("assets"))
    rows = ft.financials_as_of(df, _reports(spark, d, df), 400, ["Assets"], form=told).select(*KEY, "_quarters.*")
    return rows.where("present > 0")


@register("g7_interest_features", f"with {BARS_SQL} select {K}, case when rn % 3 = 0 then [0.0, 0, 1, 0]::double[] else [0, 0, 0, ((symbol::int * 7 + rn * 13) % 101)]::double[] end as x from (select * replace (period_date + 5000 as period_date) from b)")
def g7(spark, d):
    gi = interest(spark, d).select("exchange", "symbol", F.col("date").alias("period_date"), "relative_interest")
    rows = bars(spark, d).select(*KEY).join(gi, KEY, "left").withColumn("period_date", F.date_add("period_date", 5000))
    return rows.select(*KEY, ft.interest_features(F.col("period_date"), F.date_add("period_date", 10), F.col("relative_interest")).alias("x"))


@register("g9_exchange_sector", f"with {BARS_SQL} select distinct exchange, symbol, {_hot('coalesce(case when substr(exchange, 3)::int < 7 then substr(exchange, 3)::int + 1 end, 0)', 8)} as ex, {_hot('symbol::int % 4', 7)} as sector from bars")
def g9(spark, d):
    rows = bars(spark, d).select("exchange", "symbol").distinct().withColumn("s", F.concat(F.lit("S"), (F.col("symbol").cast("int") % 4).cast("string")))
    return rows.select("exchange", "symbol", ft.exchange_one_hot(F.col("exchange")).alias("ex"), ft.sector_one_hot(F.col("s"), ("S0", "S1", "S2", "S3")).alias("sector"))


@register("g10_ages", f"with {BARS_SQL} select {K}, round((period_date - make_date(1950 + symbol::int % 40, 1 + symbol::int % 12, 1)) / 14600.0::double, 4) as company, round((period_date - date '1985-03-02') / 40.0::double / 365.0, 4) as ipo from bars")
def g10(spark, d):
    s = F.col("symbol").cast("int")
    founded = F.concat((1950 + s % 40).cast("string"), F.lit("-"), (1 + s % 12).cast("string"))
    return bars(spark, d).select(*KEY, r4(ft.company_age(founded, F.col("period_date"))[0]).alias("company"), r4(ft.ipo_age(F.lit("1985-03-02").cast("date"), F.col("period_date"))).alias("ipo"))


_VEC = f"with {BARS_SQL}, s as (select *, list([close, volume]) over (partition by exchange, symbol order by period_date rows between 10 preceding and 1 preceding) as l, lead(low, 10) over (partition by exchange, symbol order by period_date) / ph - 1 as change from b)"


@register("g11_assemble", f"{_VEC} select {K}, {_hot('isodow(period_date) - 1', 5)} as static, len(flatten(l)) as n, round(flatten(l)[1], 4) as first_close, round(flatten(l)[20], 4) as last_volume from s where len(l) = 10 and change is not null")
def g11(spark, d):
    df = bars(spark, d)
    inst = lab.label(df, 10, 0.05).where("cls is not null").select(*KEY, "cls")
    out = ft.assemble(inst, df, ["close", "volume"], 10, [ft.day_of_week(F.col("period_date"))])
    return out.select(*KEY, "static", F.size("series").cast("long").alias("n"), r4(F.col("series")[0]).alias("first_close"), r4(F.col("series")[19]).alias("last_volume"))


@register("g13_reshape", f"{_VEC} select {K}, len(l) as days, len(l[1]) as width from s where len(l) = 10 and change is not null")
def g13(spark, d):
    df = bars(spark, d)
    inst = lab.label(df, 10, 0.05).where("cls is not null").select(*KEY, "cls")
    out = ft.assemble(inst, df, ["close", "volume"], 10, [], flat=False)
    return out.select(*KEY, F.size("series").cast("long").alias("days"), F.size(F.col("series")[0]).cast("long").alias("width"))


@register("g14_output_vector", f"{_VEC} select {K}, case when change >= 0.05 then [0.0, 1.0]::double[] else [1.0, 0.0]::double[] end as y from s where change is not null")
def g14(spark, d):
    inst = lab.label(bars(spark, d), 10, 0.05).where("cls is not null")
    return inst.select(*KEY, ft.output_vector(F.col("cls"), True).alias("y"))


@register("g5_next_earnings_days", f"with {BARS_SQL}, {EARNINGS_SQL} select exchange, symbol, count(*) as n from bars where (exchange, symbol) in (select exchange, symbol from earnings) group by 1, 2")
def g5c(spark, d):
    rows = next_earnings(bars(spark, d).select(*KEY), earnings(spark, d)).where("next_date is not null")
    x = rows.withColumn("x", ft.earnings_features(F.col("period_date"), F.col("next_date"))).where("x[0] = 1")
    return x.groupBy("exchange", "symbol").agg(F.count("*").alias("n"))


def _reports(spark, d, df):
    from ..operators.financials import edgar_nums, edgar_quarters, financial_reports

    sub, num, tag = _filings(spark, d, df)
    return financial_reports(edgar_nums(num, sub, tag), edgar_quarters(sub, num))


_TIERS = [["Assets", "Liabilities"], ["AssetsCurrent"], ["OwnTag", "Assets"]]


def _quarters_sql(filings: str, preceding: int, tags: list[str], anchors: str) -> str:
    """CTEs from a common table expression list on: fin, the not-filed flag and the quarters' numbers (dates scaled) of each row of `anchors`."""
    quarters = -(-preceding // 90)
    month, day = "(month({0}) - 1) / 12.0::double - 0.5", "(day({0}) - 1) / day(last_day({0}))::double - 0.5"
    value = lambda t: f"(max(value) filter (tag = '{t}') is not null)::int::double, coalesce(max(value) filter (tag = '{t}'), 0.0)::double"
    width = 8 + 2 * len(tags)
    return f"""{filings},
rep as (select q.exchange, q.symbol, q.period, q.quarter, q.filed, list_concat([1.0::double], {_hot('q.quarter - 1', 4)}, [{month.format('q.period')}, {day.format('q.filed')}, {month.format('q.filed')}], [{', '.join(map(value, tags))}]) as x
  from quarters q join num n on n.exchange = q.exchange and n.symbol = q.symbol and n.ddate = q.period where tag <> 'OwnTag' group by q.exchange, q.symbol, q.period, q.quarter, q.filed),
had as (select a.exchange, a.symbol, a.period_date, a.last_day, rep.period, rep.filed, x from {anchors} a join rep on rep.exchange = a.exchange and rep.symbol = a.symbol and rep.filed between a.period_date - {preceding + 1} and a.period_date
  qualify row_number() over (partition by a.exchange, a.symbol, a.period_date order by rep.period desc, rep.filed desc) <= {quarters}),
fin as (select a.exchange, a.symbol, a.period_date, coalesce((month(a.last_day) - month(max(had.period)) > 3)::int, 0)::double as not_filed,
    list_concat(list_resize([]::double[], ({width} * ({quarters} - count(had.period)))::int, 0.0::double), coalesce(flatten(list(x order by had.period, had.filed) filter (x is not null)), [])) as quarters
  from {anchors} a left join had on had.exchange = a.exchange and had.symbol = a.symbol and had.period_date = a.period_date group by a.exchange, a.symbol, a.period_date, a.last_day)"""


@register("g6_financial_vector", f"{_quarters_sql(FILINGS, 400, ft.tier_tags(_TIERS, 3), '(select exchange, symbol, period_date, period_date as last_day from b)')} select {K}, not_filed, list_transform(quarters, lambda x: floor(x * 10000 + 0.5) / 10000) as x from fin")
def g6_vector(spark, d):
    df = written_days(spark, d)
    out = ft.financials_as_of(df, _reports(spark, d, df), 400, ft.tier_tags(_TIERS, 3), True, "scaled", "scaled", lambda quarters: _r(F.flatten(quarters)))
    return out.select(*KEY, F.col("_not_filed").alias("not_filed"), F.col("_quarters").alias("x"))


#: A map with features of each kind; what is not enabled leaves no trace.
MAP = {
    "exchange": {"enabled": True},
    "sector": {"enabled": True},
    "ipoAge": {"enabled": True},
    "etf": {"enabled": True},
    "dayOfWeek": {"enabled": True},
    "dayOfMonth": {"enabled": False},
    "stockSplits": {"enabled": True},
    "stock": {"open": {"enabled": False}, "close": {"enabled": True}, "volume": {"enabled": True}},
    "vix": {"high": {"enabled": True}},
    "financials": {"enabled": True, "includeDates": True, "maxTierIndex": 2, "tierTags": _TIERS},
    "googleInterests": {"enabled": True},
    "indicators": {"relativeStrengthIndex": {"enabled": False}, "bollingerBands": {"enabled": True}, "redGreenVolumeBars": {"enabled": True}},
}
_DAYS = 12


def _map_vectors(spark, d, recurrent):
    from ..operators import feature_map as fm
    from ..operators.indicators import bollinger, rgvb
    from .fixtures import vix

    df = written_bars(spark, d)
    info = df.select("exchange", "symbol").distinct()
    s = F.col("symbol").cast("int")
    info = info.withColumns({"sector": F.when(s % 4 != 3, F.concat(F.lit("S"), (s % 4).cast("string"))), "ipo": F.when(s % 3 != 0, F.lit("1985-03-02").cast("date")), "founded": F.lit(None).cast("string"), "etf": s % 2 == 0})
    narrow = df.select(*KEY, "open", "high", "low", "close", "volume")
    tables = {"splits": splits(spark, d, df), "vix": vix(spark, d, df), "interest": interest(spark, d, df), "reports": _reports(spark, d, df), "info": info, "indicators": rgvb(bollinger(narrow))}
    anchors = df.where("idx >= 32").select(*KEY)
    fmap = fm.FeatureMap(MAP, {"dayOfMonth": "scaled", "monthOfYear": "scaled"}, ("S0", "S1", "S2"))
    return fm.vectors(anchors, df, fmap, tables, _DAYS, recurrent, _r)


def _map_sql() -> str:
    r4 = "list_transform({}, lambda x: floor(x * 10000 + 0.5) / 10000)"
    base = FILINGS.replace("with bars", "with recursive bars", 1)
    ratio = "(case when rn % 97 = symbol::int % 97 then [1.0::double, (1 + rn % 3)::double] else [0.0::double, 0.0] end)"
    band = "avg(b.close) over p20 {} 2 * stddev_pop(b.close) over p20"
    windows = f"""{base}, {VIX_SQL},
day as (select b.exchange, b.symbol, b.period_date, rn, b.close, volume, v.high as vh, {_hot('isodow(b.period_date) - 1', 5)} as dow, {ratio} as sp,
    case when rn % 3 <> 0 then [(b.period_date < date '2004-01-01')::int::double, 0.0, 0.0, ((symbol::int * 7 + rn * 13) % 101)::double] else [(b.period_date < date '2004-01-01')::int::double, 0.0, 1.0, 0.0] end as gi,
    [{band.format('-')}, avg(b.close) over p20, {band.format('+')}] as bb, case when b.close > pc then 1.0 else 0.0 end::double as rg
  from b join vix v using (period_date) window p20 as (partition by b.exchange, b.symbol order by b.period_date rows between 20 preceding and 1 preceding)),
win as (select exchange, symbol, period_date, max(period_date) over w as last_day, list(dow) over w as l_dow, list(sp) over w as l_sp, list(close) over w as l_close, list(volume) over w as l_volume, list(vh) over w as l_vix,
    list(gi) over w as l_gi0, list(bb) over w as l_bb, list(rg) over w as l_rg, rn from day window w as (partition by exchange, symbol order by period_date rows between {_DAYS} preceding and 1 preceding)),
late as (select * exclude (l_gi0), list_transform(l_gi0, lambda x, i: case when i > {_DAYS - 3} then [x[1], 1.0, x[3], 0.0] else x end) as l_gi from win where rn >= 32),
"""
    fin = _quarters_sql("@", _DAYS, ft.tier_tags(_TIERS, 2), "late").split("@,\n", 1)[1]
    static = f"list_concat({_hot('coalesce(case when substr(exchange, 3)::int < 7 then substr(exchange, 3)::int + 1 end, 0)', 8)}, {_hot('case when symbol::int % 4 = 3 then 0 else symbol::int % 4 + 1 end', 7)}, [case when symbol::int % 3 <> 0 then (last_day - date '1985-03-02') / 40.0::double / 365.0 else 0.0 end, (symbol::int % 2 = 0)::int::double])"
    at = lambda i: f"list_concat(l_dow[{i}], l_sp[{i}], [l_close[{i}], l_volume[{i}], l_vix[{i}]], l_gi[{i}], l_bb[{i}], [l_rg[{i}]])"
    return windows + fin + f""",
parts as (select *, {static} as st from late join fin using (exchange, symbol, period_date))
select {K}, {r4.format("list_concat(st, [not_filed])")} as static, {r4.format("quarters")} as semiseries, ({_DAYS} * len({at(1)}))::bigint as n, {r4.format(at(1))} as first_day, {r4.format(at(_DAYS))} as last_day,
  {r4.format("list_concat(st, flatten(l_dow), flatten(l_sp), l_close, l_volume, l_vix, [not_filed], quarters, flatten(l_gi), flatten(l_bb), l_rg)")} as vector from parts"""


_MAP_SQL = _map_sql()


@register("g11_feature_map", f"select {K}, static, semiseries, n, first_day, last_day from ({_MAP_SQL})")
def g11_map(spark, d):
    out = _map_vectors(spark, d, True)
    width = 5 + 2 + 3 + 4 + 3 + 1
    return out.select(*KEY, "static", "semiseries", F.size("series").cast("long").alias("n"), F.slice("series", 1, width).alias("first_day"), F.slice("series", -width, width).alias("last_day"))


@register("g11_flat_vector", f"select {K}, vector from ({_MAP_SQL})")
def g11_flat(spark, d):
    return _map_vectors(spark, d, False).select(*KEY, "vector")
