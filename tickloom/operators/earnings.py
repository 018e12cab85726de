"""Earnings dates: from collected rows of several sources to one known date per input date."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runs import each_run
from ..functions.scalars import month_key
from ..session import written


def drop_abnormal(e: DataFrame, days: int = 160) -> DataFrame:
    """Rows whose date lies near the end of their fiscal quarter, or that have none."""
    far = F.abs(F.datediff("earnings_date", "fiscal_quarter_ending"))
    return e.where(far.isNull() | (far < days))


def split_known(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(past, upcoming) by whether the date was before the input date."""
    return e.where("earnings_date < input_date"), e.where("earnings_date >= input_date")


def unique_fqe(e: DataFrame) -> DataFrame:
    """One row per symbol and fiscal-quarter month: NASDAQ first, then most estimates, then the latest input."""
    w = Window.partitionBy("symbol", month_key(F.col("fiscal_quarter_ending"))).orderBy(F.desc(F.col("source") == "NASDAQ"), F.desc_nulls_last("number_of_estimates"), F.desc("input_date"), "earnings_date")
    return e.where("fiscal_quarter_ending is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def near_dups(other: DataFrame, kept: DataFrame, days: int = 30) -> DataFrame:
    """other without rows within `days` of a kept row of the symbol."""
    k = kept.select(F.col("symbol").alias("_s"), F.col("earnings_date").alias("_d"))
    return other.join(k, (F.col("symbol") == F.col("_s")) & (F.abs(F.datediff("earnings_date", "_d")) <= days), "left_anti")


def year_free_diff(a: Column, b: Column) -> Column:
    """Days between two dates whatever their years: the least over this year and its neighbours (29 February as 28)."""
    day = F.when((F.month(b) == 2) & (F.dayofmonth(b) == 29), 28).otherwise(F.dayofmonth(b))
    return F.least(*[F.abs(F.datediff(a, F.make_date(F.year(a) + k, F.month(b), day))) for k in (-1, 0, 1)])


def avg_date(c: Column) -> Column:
    """Mean of dates, as an aggregate."""
    return F.date_from_unix_date(F.floor(F.avg(F.unix_date(c))).cast("int"))


def _clusters(dates: list[dt.date], days: int) -> list[int]:
    """Number of the cluster of each date in order; a date joins if it lies within days of the running mean."""
    out, total, n, k = [], 0.0, 0, -1
    for d in dates:
        if n and abs(d.toordinal() - total / n) <= days:
            total, n = total + d.toordinal(), n + 1
        else:
            total, n, k = float(d.toordinal()), 1, k + 1
        out.append(k)
    return out


def cluster_dates(e: DataFrame, days: int = 7) -> DataFrame:
    """The last row of each cluster of dates around a running mean, with all columns of e.

    A symbol's rows (four a year and source) are one group, as each step moves the mean; one Python call does all groups
    of a partition.
    """

    def work(t: pa.RecordBatch) -> pa.RecordBatch:
        k = _clusters(t.column("earnings_date").to_pylist(), days)
        return t.take(pa.array([n for n in range(len(k)) if n + 1 == len(k) or k[n + 1] != k[n]], pa.int64()))

    return each_run(e, ["symbol"], ["earnings_date", "input_date"], work, e.schema)


def condense_upcoming(up: DataFrame, known: DataFrame) -> DataFrame:
    """Upcoming rows, one for each change of a quarter's date, without those at or after a real date they foretold."""
    w = Window.partitionBy("symbol").orderBy("input_date", "earnings_date")
    new = up.withColumn("_p", F.lag("earnings_date").over(w)).where("_p is null or _p <> earnings_date").drop("_p")
    k = known.select(F.col("symbol").alias("_s"), F.col("earnings_date").alias("_d"))
    late = (F.col("symbol") == F.col("_s")) & (F.abs(F.datediff("earnings_date", "_d")) <= 30) & (F.col("input_date") >= F.col("_d"))
    return new.join(k, late, "left_anti")


def _near_year(day: dt.date, other: dt.date) -> dt.date:
    """`other` in the year (day's, or one beside it) in which it comes closest to `day`; 29 February as 28."""
    d = 28 if (other.month, other.day) == (2, 29) else other.day
    return min((dt.date(day.year + k, other.month, d) for k in (-1, 0, 1)), key=lambda x: abs((x - day).days))


class _Quarter:
    """Dates of one quarter over the years: each is moved into the year nearest to the first, where their mean is taken."""

    def __init__(self, first: dt.date, ending: str | None):
        self.first, self.ending = first, ending
        self.total, self.n = first.toordinal(), 1

    def mean(self) -> dt.date:
        return dt.date.fromordinal(self.total // self.n)

    def add(self, day: dt.date) -> None:
        self.total += _near_year(self.first, day).toordinal()
        self.n += 1


def _quarters(rows: list[tuple[dt.date, str | None, bool, bool]], days: int, same_end_days: int, most: int) -> list[_Quarter]:
    """rows: (date, month and day of the fiscal quarter's end, trusted, with figures), the trusted ones first."""
    found: list[_Quarter] = []
    for day, ending, trusted, figures in rows:

        def fits(q: _Quarter) -> bool:
            apart = abs((day - _near_year(day, q.mean())).days)
            return apart < days or (trusted and ending is not None and ending == q.ending and apart < same_end_days)

        if home := next((q for q in found if fits(q)), None):
            home.add(day)
        elif len(found) < most and (ending is not None or not trusted):
            found.append(_Quarter(day, ending if trusted else None))
        elif figures:
            raise ValueError(f"{day} has figures but fits none of {len(found)} quarters")
    return found


def typical_dates(known: DataFrame, days: int = 30, same_end_days: int = 60, most: int = 12, per_year: int = 4, trusted: str = "NASDAQ") -> DataFrame:
    """symbol, quarter (from 0), typical_date and n: the usual dates of a symbol's quarters, whatever the year.

    known: symbol, source, earnings_date, fiscal_quarter_ending, eps. Years of more than per_year rows tell nothing. Rows of
    the trusted source come first, then the others, both by date. A row joins the first quarter whose mean date so far lies
    less than `days` from it, or, among trusted rows, less than same_end_days if the quarter's first row ends its fiscal
    quarter on the same month and day. Else it opens a quarter, up to `most`; a trusted row without a quarter end opens
    none. A row that finds no place is left out if it has no eps, and an error if it has. typical_date lies near the year
    of the quarter's first row.

    A symbol's rows (four a year) are one group, as each row moves the means; one Python call does all groups of a partition.
    """
    year = Window.partitionBy("symbol", F.year("earnings_date"))
    rows = known.withColumn("_n", F.count("*").over(year)).where(F.col("_n") <= per_year)
    rows = rows.select("symbol", "input_date", "earnings_date", F.date_format("fiscal_quarter_ending", "MM-dd").alias("ending"), F.col("source").eqNullSafe(trusted).alias("trusted"), F.col("eps").isNotNull().alias("figures"))

    def work(t: pa.RecordBatch) -> pa.RecordBatch:
        found = _quarters(list(zip(*(t.column(c).to_pylist() for c in ("earnings_date", "ending", "trusted", "figures")))), days, same_end_days, most)
        symbol = t.column("symbol").take(pa.array([0] * len(found), pa.int64()))
        told = [pa.array(range(len(found)), pa.int32()), pa.array([q.mean() for q in found], pa.date32()), pa.array([q.n for q in found], pa.int64())]
        return pa.RecordBatch.from_arrays([symbol, *told], names=["symbol", "quarter", "typical_date", "n"])

    order = [F.desc("trusted"), *[F.asc_nulls_last(c) for c in ("earnings_date", "input_date", "ending")]]
    return each_run(rows, ["symbol"], order, work, "symbol string, quarter int, typical_date date, n long")


def fix_aberrant(unsure: DataFrame, known: DataFrame, typical: DataFrame, most: int = 4, days: int = 30) -> DataFrame:
    """unsure (rows without a fiscal quarter, part of known) without those that lie `days` or more from all typical dates.

    Only symbols with a year of more than `most` known rows are checked; there, years with just `most` unsure rows stay.
    """
    years = known.groupBy("symbol", F.year("earnings_date")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    aberrant = years.select(F.col("symbol").alias("_s")).distinct()
    own = F.count("*").over(Window.partitionBy("symbol", F.year("earnings_date")))
    rows = unsure.withColumn("_own", own).join(aberrant, F.col("symbol") == F.col("_s"), "left")
    day = typical.select(F.col("symbol").alias("_t"), F.col("typical_date").alias("_d"))
    near = (F.col("symbol") == F.col("_t")) & (year_free_diff(F.col("earnings_date"), F.col("_d")) < days)
    asked = F.col("_s").isNotNull() & (F.col("_own") != most)
    return rows.where(~asked).unionByName(rows.where(asked).join(day, near, "left_semi")).drop("_own", "_s")


#: Symbols with too many dates a year to be told apart (fixed values).
EXCLUDED = ("AIM", "AMN", "BRTX", "CSR", "GEN", "GHI", "JEF", "RGP", "TAL", "VAL")


def derive_earnings(raw: DataFrame, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """exchange, symbol, input_date, earnings_date: one known date per quarter, and the upcoming dates as they changed.

    Known dates without a fiscal quarter that no typical date of the symbol bears out are left out in symbols with an
    aberrant year. Rows of NASDAQ get that exchange, others keep theirs. What several steps start from is written once.
    """
    rows = written(drop_abnormal(raw.where(~F.col("symbol").isin(*exclude)) if exclude else raw), "earnings")
    past, up = split_known(rows)
    quarters = written(unique_fqe(past), "quarters")
    rest = written(cluster_dates(near_dups(past.where("fiscal_quarter_ending is null"), quarters)), "clusters")
    known = quarters.unionByName(rest)
    kept = quarters.unionByName(fix_aberrant(rest, known, typical_dates(known)))
    every = kept.unionByName(condense_upcoming(up, known))
    exchange = F.when(F.col("source") == "NASDAQ", "NASDAQ").otherwise(F.col("exchange")).alias("exchange")
    return every.select(exchange, "symbol", "input_date", "earnings_date").dropDuplicates()


def earnings_day_histogram(e: DataFrame) -> DataFrame:
    """Announcements on each day of the year, days with none included."""
    days = e.sparkSession.range(1, 367).select(F.col("id").cast("int").alias("day"))
    counts = e.groupBy(F.dayofyear("earnings_date").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))

