"""Feature vectors: one row per instance with static, per-quarter and per-day arrays.

Windows of preceding rows multiply the data by their length, so they are taken last: columns are narrowed to the
features' numbers first, and only the chosen anchors keep their window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TICKER, one_hot
from ..sources.bars import ordered
from .joins import as_of

KEY = [*TICKER, "period_date"]
#: Exchanges that have a place of their own; place 0 is for all others (fixed values of the derived tables).
EXCHANGES = tuple(f"EX{i}" for i in range(7))


def day_of_week(date: Column, form: str = "one_hot") -> Column:
    """Monday 0 to Friday 4, as one-hot or over 6, less 0.5."""
    i = F.weekday(date)
    return one_hot(i, 5) if form == "one_hot" else F.array(i / 6 - 0.5)


def day_of_month(date: Column, form: str = "one_hot") -> Column:
    i = F.dayofmonth(date)
    return one_hot(i - 1, 31) if form == "one_hot" else F.array(i / F.dayofmonth(F.last_day(date)) - 0.5)


def month_of_year(date: Column, form: str = "one_hot") -> Column:
    i = F.month(date)
    return one_hot(i - 1, 12) if form == "one_hot" else F.array(i / 12 - 0.5)


def split_features(split_from: Column, split_to: Column) -> Column:
    """Flag, and the ratio about zero: max/min - 1, positive where from < to."""
    ratio = F.greatest(split_from, split_to) / F.least(split_from, split_to) - 1
    return F.when(split_from.isNull(), F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.when(split_from < split_to, ratio).otherwise(-ratio)))


def earnings_features(day: Column, next_date: Column, size: int = 2, cap: float | None = None) -> Column:
    """Size 2: known, signed days. Size 4: known, before, after, days. Days optionally over a cap."""
    diff = F.datediff(next_date, day).cast("double")
    known = next_date.isNotNull().cast("double")
    scale = cap or 1.0
    if size == 2:
        return F.array(known, F.coalesce(diff / scale, F.lit(0.0)))
    return F.array(known, F.coalesce((diff >= 0).cast("double"), F.lit(0.0)), F.coalesce((diff < 0).cast("double"), F.lit(0.0)), F.coalesce(F.abs(diff) / scale, F.lit(0.0)))


def earnings_similarity(day: Column, next_date: Column, span: float = 90.0) -> Column:
    """0 to 0.7 as the date comes near, 0.7 to 1 in the seven days after it, 1 where it is unknown."""
    diff = F.datediff(next_date, day).cast("double")
    before = 0.7 * (1 - F.least(diff, F.lit(span)) / span)
    return F.when(diff.isNull(), 1.0).when(diff >= 0, before).otherwise(0.7 + 0.3 * F.least(-diff, F.lit(7.0)) / 7)


def interest_features(date: Column, anchor: Column, value: Column) -> Column:
    """Before 2004, within the last three days, unknown, value."""
    early = date < F.lit("2004-01-01").cast("date")
    late = F.datediff(anchor, date) <= 3
    unknown = value.isNull() & ~early & ~late
    return F.array(early.cast("double"), late.cast("double"), unknown.cast("double"), F.when(early | late, 0.0).otherwise(F.coalesce(value, F.lit(0.0))))


def exchange_one_hot(exchange: Column, known: tuple[str, ...] = EXCHANGES) -> Column:
    return one_hot(F.array_position(F.array(*[F.lit(x) for x in known]), exchange), len(known) + 1)


def sector_one_hot(sector: Column, sectors: tuple[str, ...], spare: int = 3) -> Column:
    return one_hot(F.array_position(F.array(*[F.lit(x) for x in sectors]), sector) - 1, len(sectors) + spare)


def company_age(founded: Column, anchor: Column) -> Column:
    """Days over 40 * 365 of a founding date in parts (yyyy, yyyy-M or yyyy-MM-dd); month and day are known by default."""
    part = lambda k: F.get(F.split(founded, "-"), F.lit(k)).cast("int")
    date = F.make_date(part(0), F.coalesce(part(1), F.lit(1)), F.coalesce(part(2), F.lit(1)))
    return F.array(F.datediff(anchor, date) / (40 * 365.0), F.lit(1.0), F.lit(1.0))


def ipo_age(ipo: Column, anchor: Column) -> Column:
    return F.datediff(anchor, ipo) / 40.0 / 365.0


def sector_one_hot_or_none(sector: Column, sectors: tuple[str, ...], spare: int = 3) -> Column:
    """Place 0 for a sector that is unknown, then the known ones, then spare places."""
    return one_hot(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in sectors]), sector), F.lit(0)), len(sectors) + 1 + spare)


def tier_tags(tiers: list[list[str]], upto: int) -> list[str]:
    """The tags of the first `upto` tiers, tier after tier, each once."""
    if not 0 <= upto <= len(tiers):
        raise ValueError(f"{upto} of {len(tiers)} tiers")
    return list(dict.fromkeys(tag for tier in tiers[:upto] for tag in tier))


def max_quarters(preceding: int) -> int:
    return math.ceil(preceding / 90)


def _month(date: Column, form: str) -> Column:
    return one_hot(F.month(date) - 1, 12) if form == "one_hot" else F.array((F.month(date) - 1) / 12 - (0.5 if form == "scaled" else 0.0))


def _day(date: Column, form: str) -> Column:
    i = F.dayofmonth(date) - 1
    return one_hot(i, 31) if form == "one_hot" else F.array(i / F.dayofmonth(F.last_day(date)) - (0.5 if form == "scaled" else 0.0))


def _width(tags: list[str], dates: bool, month_form: str, day_form: str) -> int:
    """Numbers of a quarter."""
    told = 2 * (12 if month_form == "one_hot" else 1) + (31 if day_form == "one_hot" else 1) if dates else 0
    return 5 + told + 2 * len(tags)


def _quarter(tags: list[str], dates: bool, month_form: str, day_form: str) -> Column:
    """A report's numbers."""
    told = [_month(F.col("period"), month_form), _day(F.col("filed"), day_form), _month(F.col("filed"), month_form)] if dates else []
    values = [F.array(F.map_contains_key("nums", t).cast("double"), F.coalesce(F.element_at("nums", t).cast("double"), F.lit(0.0))) for t in tags]
    return F.concat(F.array(F.lit(1.0)), one_hot(F.col("quarter") - 1, 4), *told, *values)


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def _padded(have: Column, preceding: int, width: int) -> Column:
    """The quarters' numbers, absent quarters (zeros) in front."""
    return F.concat(F.array_repeat(F.array_repeat(F.lit(0.0), width), max_quarters(preceding) - F.size(have)), have)


def not_filed(last: Column) -> Column:
    """1 where the last bar's month is more than three after that of the last report's period (_period)."""
    return F.coalesce((F.month(last) - F.month("_period") > 3).cast("double"), F.lit(0.0))


def financial_vector(reports: DataFrame, inst: DataFrame, preceding: int, tags: list[str], dates: bool = False, month_form: str = "one_hot", day_form: str = "one_hot") -> DataFrame:
    """inst with _not_filed and _quarters, the arrays of its last ceil(preceding / 90) quarters, absent ones (zeros) in front.

    A quarter's array: presence, the one-hot quarter, with `dates` the month of the period's end, the day and the month of
    filing (one_hot, scaled about zero, or natural), then (present, value) of each tag; a tag without a value is present
    with 0. _not_filed is 1 where the last bar's month is more than three after that of the last report's period.

    reports: as preceding_reports() gives them (the anchor's key, period, quarter, filed, nums); inst: key and, if it has
    it, last_day (else the anchor's date counts as the last day).
    """
    last = F.col("last_day") if "last_day" in inst.columns else F.col("period_date")
    listed = F.sort_array(F.collect_list(F.struct("period", "filed", _quarter(tags, dates, month_form, day_form).alias("x"))))
    lists = reports.groupBy(*KEY).agg(listed.alias("_l")).select(*KEY, F.transform("_l", lambda s: s["x"]).alias("_q"), F.element_at("_l", -1)["period"].alias("_period"))
    have = F.coalesce(_last(F.col("_q"), max_quarters(preceding)), F.array().cast("array<array<double>>"))
    found = inst.join(lists, KEY, "left").withColumn("_quarters", _padded(have, preceding, _width(tags, dates, month_form, day_form)))
    return found.withColumn("_not_filed", not_filed(last)).drop("_q", "_period")


def financial_states(reports: DataFrame, preceding: int, tags: list[str], dates: bool = False, month_form: str = "one_hot", day_form: str = "one_hot") -> DataFrame:
    """Ticker, period_date, _quarters and _period of each day on which a ticker's quarters change: that of a filing, and that
    on which it is too old.

    reports: ticker, period, quarter, filed, nums. For joins.as_of(): some two rows a report, where preceding_reports() has
    several a bar. A ticker's reports, four a year, are one list, from which each day takes its own: no join.
    """
    known = reports.where("exchange is not null and symbol is not null and filed is not null")
    one = F.struct("period", "filed", _quarter(tags, dates, month_form, day_form).alias("x"))
    lists = known.groupBy(*TICKER).agg(F.sort_array(F.collect_list(one)).alias("_l"))
    days = F.array_distinct(F.flatten(F.transform("_l", lambda r: F.array(r["filed"], F.date_add(r["filed"], preceding + 2)))))
    within = lambda day: F.filter("_l", lambda r: r["filed"].between(F.date_sub(day, preceding + 1), day))
    found = lists.select(*TICKER, F.inline(F.transform(days, lambda day: F.struct(day.alias("period_date"), _last(within(day), max_quarters(preceding)).alias("_had")))))
    quarters = _padded(F.transform("_had", lambda r: r["x"]), preceding, _width(tags, dates, month_form, day_form))
    return found.select(*KEY, quarters.alias("_quarters"), F.get("_had", F.size("_had") - 1)["period"].alias("_period"))


def financials_as_of(
    inst: DataFrame, reports: DataFrame, preceding: int, tags: list[str], dates: bool = False, month_form: str = "one_hot", day_form: str = "one_hot", form: Callable[[Column], Column] = lambda quarters: quarters
) -> DataFrame:
    """financial_vector() of all of a ticker's reports: those filed up to preceding + 1 days before an anchor are chosen here.

    form: what _quarters is to be, made from the quarters once for each day on which they change, and not for each anchor.
    """
    last = F.col("last_day") if "last_day" in inst.columns else F.col("period_date")
    states = financial_states(reports, preceding, tags, dates, month_form, day_form).withColumn("_quarters", form(F.col("_quarters")))
    return filled(as_of(inst, states), preceding, tags, dates, month_form, day_form, form).withColumn("_not_filed", not_filed(last)).drop("_period")


def filled(found: DataFrame, preceding: int, tags: list[str], dates: bool, month_form: str, day_form: str, form: Callable[[Column], Column] = lambda quarters: quarters) -> DataFrame:
    """found with empty quarters (in the same form) where _quarters is null."""
    none = F.array_repeat(F.array_repeat(F.lit(0.0), _width(tags, dates, month_form, day_form)), max_quarters(preceding))
    return found.withColumn("_quarters", F.coalesce("_quarters", form(none)))


def financial_features(reports: DataFrame, inst: DataFrame, preceding: int, tags: list[str]) -> DataFrame:
    """inst with semiseries: the quarters of financial_vector() without dates."""
    return financial_vector(reports, inst, preceding, tags).withColumnRenamed("_quarters", "semiseries").drop("_not_filed")


#: What a day of a series says by default.
PRICE_SERIES = ["open", "high", "low", "close", "volume"]


def series(bars: DataFrame, columns: list[str], preceding: int) -> DataFrame:
    """bars with series: the columns' numbers of the `preceding` rows before each row, day by day (the row itself is out)."""
    w = ordered().rowsBetween(-preceding, -1)
    day = F.array(*[F.col(c).cast("double") for c in columns])
    return bars.withColumn("series", F.collect_list(day).over(w))


def assemble(anchors: DataFrame, bars: DataFrame, columns: list[str], preceding: int, static: list[Column], flat: bool = True) -> DataFrame:
    """anchors (ticker, period_date, cls) with static and series arrays; flat: series as one array, day after day."""
    windows = series(bars.select(*KEY, *columns), columns, preceding).select(*KEY, "series")
    rows = anchors.join(windows, KEY).where(F.size("series") == preceding)
    out = rows.withColumn("static", F.concat(*static) if static else F.array().cast("array<double>"))
    return out.withColumn("series", F.flatten("series")) if flat else out


def output_vector(cls: Column, two: bool = False) -> Column:
    hit = (cls == "POSITIVE").cast("double")
    return F.array(1 - hit, hit) if two else F.array(hit)
