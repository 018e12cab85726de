"""Registered queries: market calendar (M) over the dates of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..registry import register
from .fixtures import table

Y = (1992, 2002)  # the years of the order and ship dates

_NTH = "(select min(x.d) + {k} from days x where year(x.d) = y and month(x.d) = {m} and isodow(x.d) = {w})"


def _nth(m: int, w: int, n: int) -> str:
    return _NTH.format(m=m, w=w, k=7 * (n - 1))


def _fixed(m: int, d: int, sat: int = 0, sun: int = 0) -> str:
    return f"make_date(y, {m}, {d}) + case isodow(make_date(y, {m}, {d})) when 6 then {sat} when 7 then {sun} else 0 end"


_EASTER = """(select make_date(y, f // 31, f % 31 + 1) - 2 from (select d + e - 7 * ((y % 19 + 11 * d + 22 * e) // 451) + 114 as f from (select d, (32 + 2 * ((y // 100) % 4) + 2 * ((y % 100) // 4) - d - (y % 100) % 4) % 7 as e
  from (select (19 * (y % 19) + y // 100 - y // 400 - ((y // 100 - (y // 100 + 8) // 25 + 1) // 3) + 15) % 30 as d))))"""
_LAST_MAY = "(select max(x.d) from days x where year(x.d) = y and month(x.d) = 5 and isodow(x.d) = 1)"

_ROWS = [
    ("US", "new_year", _fixed(1, 1, 0, 1), "true"), ("CANADA", "new_year", _fixed(1, 1, 2, 1), "true"), ("US", "martin_luther_king", _nth(1, 1, 3), "y > 1997"),
    ("CANADA_US_SHARED", "presidents_family", _nth(2, 1, 3), "y >= 2008"), ("US", "presidents", _nth(2, 1, 3), "y < 2008"), ("CANADA_US_SHARED", "good_friday", _EASTER, "true"),
    ("US", "memorial", _LAST_MAY, "true"), ("CANADA", "victoria", f"{_LAST_MAY} - 7", "true"), ("US", "juneteenth", _fixed(6, 19, -1, 1), "y >= 2022"), ("CANADA", "canada", _fixed(7, 1, 2, 1), "true"),
    ("US", "independence", _fixed(7, 4, -1, 1), "true"), ("CANADA", "civic", _nth(8, 1, 1), "true"), ("CANADA_US_SHARED", "labour", _nth(9, 1, 1), "true"), ("CANADA", "truth_reconciliation", _fixed(9, 30, 2, 1), "y > 2022"),
    ("CANADA", "thanksgiving", _nth(10, 1, 2), "true"), ("US", "thanksgiving", _nth(11, 4, 4), "true"), ("US", "christmas", _fixed(12, 25, -1, 1), "true"), ("CANADA", "christmas", _fixed(12, 25, 2, 1), "true"),
    ("CANADA", "boxing", "make_date(y, 12, 26) + case isodow(make_date(y, 12, 26)) when 6 then 2 when 7 then 2 when 1 then 1 else 0 end", "true"),
]


def holidays_sql(first: int = Y[0], last: int = Y[1]) -> str:
    every = " union all ".join(f"select '{r}' as region, '{n}' as name, cast({e} as date) as date from ys where {k}" for r, n, e, k in _ROWS)
    return f"""days as (select unnest(generate_series(date '{first}-01-01', date '{last}-12-31', interval 1 day))::date as d),
ys as (select unnest(range({first}, {last + 1}))::int as y), holidays as ({every}),
us as (select distinct date from holidays where region in ('US', 'CANADA_US_SHARED')),
md as (select d as date, row_number() over (order by d)::int as ordinal from days where isodow(d) < 6 and d not in (select date from us)),
cal as (select d as date, (select max(md.date) from md where md.date <= d) as last_md, (select max(ordinal) from md where md.date <= d) as ordinal from days)"""


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


def _years(spark, d):
    """The years that orders and shipments lie in, from the data."""
    a, b = table(spark, d, "lineitem").agg(F.min(F.year("l_shipdate")), F.max(F.year("l_shipdate"))).first()
    return min(a, Y[0]), max(b, Y[1])


@register("m1_holidays", f"with {holidays_sql()} select region, name, date, (select count(*) from orders where o_orderdate::date = date) as orders from holidays")
def m1(spark, d):
    per = _orders(spark, d).groupBy(F.col("day").alias("date")).agg(F.count("*").alias("orders"))
    return cal.holidays(spark, *_years(spark, d)).join(per, "date", "left").select("region", "name", "date", F.coalesce("orders", F.lit(0)).alias("orders"))


@register("m2_half_days", f"with {holidays_sql()} select name, case when name = 'thanksgiving' then date + 1 else date - 1 end as date, (select count(*) from orders where o_orderdate::date = case when name = 'thanksgiving' then date + 1 else date - 1 end) as orders from holidays where region = 'US' and name in ('thanksgiving', 'christmas')")
def m2(spark, d):
    per = _orders(spark, d).groupBy(F.col("day").alias("date")).agg(F.count("*").alias("orders"))
    return cal.half_days(spark, *_years(spark, d)).join(per, "date", "left").select("name", "date", F.coalesce("orders", F.lit(0)).alias("orders"))


@register("m3_market_days", f"with {holidays_sql()} select date, ordinal, count(o_orderkey) as orders from md left join orders on o_orderdate::date = date group by 1, 2")
def m3(spark, d):
    per = _orders(spark, d).groupBy(F.col("day").alias("date")).agg(F.count("*").alias("orders"))
    return cal.market_days(spark, *_years(spark, d)).join(per, "date", "left").select("date", "ordinal", F.coalesce("orders", F.lit(0)).alias("orders"))


@register("m4_last_market_day", f"with {holidays_sql()} select o_orderkey, day, c.last_md, p.last_md as before from (select o_orderkey, o_orderdate::date as day from orders) left join cal c on c.date = day left join cal p on p.date = day - 1")
def m4(spark, d):
    c = cal.calendar(spark, *_years(spark, d))
    on = cal.last_market_day(_orders(spark, d), "day", c)
    return cal.last_market_day(on.withColumnRenamed("last_md", "on"), "day", c, strictly=True).select("o_orderkey", "day", F.col("on").alias("last_md"), F.col("last_md").alias("before"))


@register("m5_market_day_diff", f"with {holidays_sql()} select l_orderkey, l_linenumber, l_partkey, b.ordinal - a.ordinal as md_diff from lineitem join orders on o_orderkey = l_orderkey left join cal a on a.date = o_orderdate::date left join cal b on b.date = l_shipdate::date")
def m5(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("shipped"))
    rows = lines.join(_orders(spark, d), "o_orderkey")
    out = cal.market_day_diff(rows, "day", "shipped", cal.calendar(spark, *_years(spark, d)))
    return out.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", "md_diff")


@register("m6_advance", f"with {holidays_sql()} select o_orderkey, md.date as advanced from orders left join cal c on c.date = o_orderdate::date left join md on md.ordinal = c.ordinal + 10")
def m6(spark, d):
    return cal.advance(_orders(spark, d), "day", 10, cal.calendar(spark, *_years(spark, d))).select("o_orderkey", "advanced")
