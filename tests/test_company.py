"""Order-dependent operators by hand, where SQL can't follow them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import earnings as ear
from tickloom.operators import financials as fin
from tickloom.operators import interest as gi
from tickloom.sources import landed


def d(s):
    return dt.date.fromisoformat(s)


def test_clusters_move_with_their_mean(spark):
    rows = [("A", d("2020-01-01"), d(x)) for x in ("2020-02-01", "2020-02-06", "2020-02-10", "2020-02-20", "2020-05-01")]
    got = ear.cluster_dates(spark.createDataFrame(rows, "symbol string, input_date date, earnings_date date"), 7)
    # 1, 6 and 10 February lie within 7 days of the running mean; the 20th doesn't
    assert sorted(r["earnings_date"] for r in got.collect()) == [d("2020-02-10"), d("2020-02-20"), d("2020-05-01")]


KNOWN = "symbol string, source string, input_date date, earnings_date date, fiscal_quarter_ending date, eps double"


def known(*rows):
    return [("A", source, d("2024-01-01"), d(day), d(f"{day[:4]}-{end}") if end else None, eps) for source, day, end, eps in rows]


def typical(spark, *rows):
    got = ear.typical_dates(spark.createDataFrame(known(*rows), KNOWN)).orderBy("quarter").collect()
    return [(r["typical_date"], r["n"]) for r in got]


def test_typical_dates(spark):
    # the trusted rows come first, whatever their year: 50 days apart they are one quarter only if it ends on the same day
    first = ("NASDAQ", "2019-05-01", "03-31", 1.0)
    assert typical(spark, ("YAHOO", "2018-05-20", None, None), first, ("NASDAQ", "2020-06-20", "03-31", 1.0)) == [(d("2019-05-24"), 3)]
    assert typical(spark, first, ("NASDAQ", "2020-06-20", "04-30", 1.0)) == [(d("2019-05-01"), 1), (d("2020-06-20"), 1)]
    assert typical(spark, first, ("YAHOO", "2020-06-20", "03-31", 1.0)) == [(d("2019-05-01"), 1), (d("2020-06-20"), 1)]
    # the mean goes over the turn of the year, and 29 February counts as 28
    assert typical(spark, ("YAHOO", "2020-12-31", None, None), ("YAHOO", "2020-01-10", None, None)) == [(d("2020-01-05"), 2)]
    assert typical(spark, ("YAHOO", "2019-02-28", None, None), ("YAHOO", "2020-02-29", None, None)) == [(d("2019-02-28"), 2)]
    # years of five rows tell nothing
    assert typical(spark, first, *[("YAHOO", f"2021-{m:02d}-15", None, None) for m in (1, 2, 6, 8, 10)]) == [(d("2019-05-01"), 1)]


def test_typical_dates_without_a_place(spark):
    # a trusted row without a quarter's end opens no quarter: left out without figures, an error with them
    first = ("NASDAQ", "2019-05-01", "03-31", 1.0)
    assert typical(spark, first, ("NASDAQ", "2019-08-01", None, None)) == [(d("2019-05-01"), 1)]
    with pytest.raises(Exception, match="fits none of 1 quarters"):
        typical(spark, first, ("NASDAQ", "2019-08-01", None, 2.0))
    # and no more than twelve quarters: with a small tolerance the thirteenth finds none
    rows = known(*[("YAHOO", f"{2000 + k}-{k % 12 + 1:02d}-{1 + k:02d}", None, None) for k in range(13)])
    few = ear.typical_dates(spark.createDataFrame(rows, KNOWN), days=2)
    assert few.count() == 12


def test_aberrant_years(spark):
    sure = [("NASDAQ", f"{y}-{m}", e, 1.0) for y in (2019, 2020) for m, e in (("02-01", "12-31"), ("05-01", "03-31"))]
    unsure = [("YAHOO", day, None, None) for day in ("2020-01-20", "2020-07-01", "2020-08-01", "2021-09-09", *(f"2022-{m:02d}-10" for m in (3, 6, 9, 12)))]
    every = spark.createDataFrame(known(*sure, *unsure), KNOWN)
    at = ear.typical_dates(every.where("source = 'NASDAQ'"))
    rest = every.where("source = 'YAHOO'")
    days = lambda df: sorted(str(r["earnings_date"]) for r in df.collect())
    # 2020 has five rows, so all years are held to 1 February and 1 May, but for 2022 with just four unsure rows
    assert days(ear.fix_aberrant(rest, every, at)) == ["2020-01-20", "2022-03-10", "2022-06-10", "2022-09-10", "2022-12-10"]
    assert days(ear.fix_aberrant(rest, every.where("earnings_date < '2020-08-01'"), at)) == days(rest)


def test_projected_months(spark):
    day = [("X", "A", d(f"2020-{m:02d}-15"), v) for m, v in ((1, 10.0), (2, 20.0), (3, 30.0))]
    month = [("X", "A", d("2020-01-01"), 40.0), ("X", "A", d("2020-02-01"), 40.0)]
    got = gi.project_months(spark.createDataFrame(day, "exchange string, symbol string, date date, relative_interest double"), spark.createDataFrame(month, "exchange string, symbol string, month date, value double"))
    # factor (40/10 + 40/20) / 2 = 3: March is 90
    assert [r["value"] for r in got.orderBy("month").collect()] == pytest.approx([40, 40, 90])


def test_derived_earnings(spark):
    rows = [
        ("X", "A", "NASDAQ", d("2020-05-20"), d("2020-05-01"), d("2020-03-31"), 3),
        ("X", "A", "YAHOO", d("2020-05-21"), d("2020-05-03"), d("2020-03-31"), 9),
        ("X", "A", "YAHOO", d("2020-05-22"), d("2020-05-05"), None, None),
        ("X", "A", "YAHOO", d("2020-09-01"), d("2020-08-01"), None, None),
        ("X", "A", "YAHOO", d("2020-09-02"), d("2020-11-01"), None, None),
        ("X", "A", "YAHOO", d("2020-09-03"), d("2021-12-01"), d("2020-03-31"), 1),
    ]
    raw = spark.createDataFrame(rows, "exchange string, symbol string, source string, input_date date, earnings_date date, fiscal_quarter_ending date, number_of_estimates int").withColumn("eps", F.lit(None).cast("double"))
    assert {r["exchange"] for r in ear.derive_earnings(raw).collect()} == {"NASDAQ", "X"}
    got = sorted(r["earnings_date"] for r in ear.derive_earnings(raw).collect())
    assert got == [d("2020-05-01"), d("2020-08-01"), d("2020-11-01")]


def test_balance_status(spark):
    checks = spark.createDataFrame([("a", True), ("b", True), ("b", True), ("c", False), ("d", True), ("e", False)], "adsh string, balanced boolean")
    left = spark.createDataFrame([("b", 0.0), ("d", 1.0), ("e", 2.0)], "adsh string, value double")
    assert {r["adsh"]: r["status"] for r in fin.balance_status(checks, left).collect()} == {"a": 1, "b": 3, "c": -1, "d": 2, "e": 0}


def test_filings_from_files(spark, tmp_path):
    (tmp_path / "sub.txt").write_text("adsh\tcik\tfp\tperiod\tfiled\na1\t320193\tQ1\t20200331\t20200501\n")
    (tmp_path / "tag.txt").write_text("tag\tversion\tcustom\tabstract\nAssets\tus-gaap/2020\t0\t0\nAssets\tus-gaap/2020\t0\t0\n")
    (tmp_path / "num.txt").write_text("adsh\ttag\tversion\tcoreg\tddate\tqtrs\tuom\tvalue\na1\tAssets\tus-gaap/2020\t\t20200331\t0\tUSD\t5\na1\tAssets\tus-gaap/2020\t\t20200331\t0\tUSD\t6\n")
    info = spark.createDataFrame([("0000320193", "NASDAQ", "AAPL")], "cik string, exchange string, symbol string")
    sub, tag, num = landed.load_edgar(spark, f"file://{tmp_path}", info)
    assert sub.select("symbol", "filed").first() == ("AAPL", d("2020-05-01"))
    assert tag.count() == 1
    assert sorted((r["value"], r["duplicate"]) for r in num.collect()) == [(5.0, False), (6.0, True)]


def test_vix_file(spark, tmp_path):
    (tmp_path / "vix.csv").write_text("A title\nDate,Open,High,Low,Close\n1/2/2004,17.96,18.68,17.54,n/a\n")
    row = landed.read_vix_csv(spark, f"file://{tmp_path}/vix.csv").first()
    assert tuple(row) == (d("2004-01-02"), 17.96, 18.68, 17.54, 0.0, 0)


def test_earnings_of_many_symbols_share_a_python_call(spark):
    e = spark.range(900).selectExpr("concat('S', id % 300) as symbol", "'YAHOO' as source", "date_add(date'2020-01-01', cast(id % 40 as int)) as earnings_date", "date'2021-01-01' as input_date", "cast(null as date) as fiscal_quarter_ending", "1.0d as eps")
    for out in (ear.cluster_dates(e), ear.typical_dates(e)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsIn" not in plan and "MapInArrow" in plan
        assert out.select("symbol").distinct().count() == 300
