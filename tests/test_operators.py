"""Edge cases of operators that the SQL comparison over whole tables doesn't reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions.scalars import is_fibonacci
from tickloom.operators import calendar as cal
from tickloom.operators import labels as lab
from tickloom.operators import options as opt
from tickloom.operators import predicates as p
from tickloom.operators import similarity as sim


def d(s):
    return dt.date.fromisoformat(s)


def test_public_holidays(spark):
    rows = {(r["region"], r["name"], r["date"].year): r["date"] for r in cal.holidays(spark, 2019, 2024).collect()}
    assert rows["CANADA_US_SHARED", "good_friday", 2024] == d("2024-03-29")
    assert rows["US", "juneteenth", 2022] == d("2022-06-20") and ("US", "juneteenth", 2021) not in rows
    assert rows["US", "independence", 2020] == d("2020-07-03")
    assert rows["US", "thanksgiving", 2023] == d("2023-11-23")
    assert rows["CANADA", "victoria", 2023] == d("2023-05-22")
    assert rows["US", "memorial", 2021] == d("2021-05-31")
    days = [r["date"] for r in cal.market_days(spark, 2023, 2023).collect()]
    assert len(days) == 250


def test_option_round_trip(spark):
    df = spark.createDataFrame([("O:AACQ210219C00017500",), ("AACQ1210219P00000500",), ("O:X991231C00100000",)], "ticker string")
    rows = opt.parse_contract(df, "ticker", 2024).orderBy("strike").collect()
    assert [(r["underlying"], r["expiration_date"], r["contract_type"], r["strike"]) for r in rows] == [("AACQ", d("2021-02-19"), "PUT", 0.5), ("AACQ", d("2021-02-19"), "CALL", 17.5), ("X", d("1999-12-31"), "CALL", 100.0)]
    c = F.col
    back = opt.parse_contract(df.limit(1), "ticker", 2024).select(opt.format_contract(c("underlying"), c("expiration_date"), c("contract_type"), c("strike"))).first()[0]
    assert back == "O:AACQ210219C00017500"


def test_similarity_of_equal_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    got = sim.similarity(df, "a", "b", "cosine").select("cosine").collect()
    assert [r[0] for r in got] == pytest.approx([1.0, 0.0])
    assert sim.similarity(df, "a", "b", "ts_ss").first()["ts_ss"] == pytest.approx(0.0)


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    assert p.select_where(df, n=p.Compare(">", 1)).count() == 2
    assert p.select_where(df, s=p.Null()).first()["n"] == 2
    assert p.select_where(df, n=None).count() == 3
    assert {r["n"] for r in p.delete_where(df, s="a").collect()} == {2, 3}  # unknown isn't deleted
    assert p.select_where(df, n=p.Between(1, 3, False)).count() == 1


def test_split_covers_each_class(spark):
    rows = [("X", str(i), d("2020-01-01"), "POSITIVE" if i % 5 == 0 else "NEGATIVE") for i in range(103)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, period_date date, cls string")
    parts = lab.split(df, 0.7, 0.2)
    assert parts.count() == 103 and parts.select("exchange", "symbol").distinct().count() == 103
    n = {(r["cls"], r["part"]): r["count"] for r in parts.groupBy("cls", "part").count().collect()}
    assert n["POSITIVE", "train"] == 14 and n["NEGATIVE", "train"] == 57
    sample = lab.balanced_sample(df, 30, 1 / 6)
    assert {r["cls"]: r["count"] for r in sample.groupBy("cls").count().collect()} == {"POSITIVE": 5, "NEGATIVE": 25}


def test_fibonacci_numbers_are_exact(spark):
    want, a, b = {0}, 1, 1
    while a <= 10**9:
        want.add(a)
        a, b = b, a + b
    near = sorted({n + k for n in want for k in (-2, -1, 0, 1, 2) if 0 <= n + k <= 10**9})
    df = spark.createDataFrame([(n,) for n in near], "n long").where(is_fibonacci(F.col("n")))
    assert sorted(r["n"] for r in df.collect()) == sorted(want)
    assert spark.range(300_000).where(is_fibonacci(F.col("id"))).count() == len([n for n in want if n < 300_000])


@pytest.mark.parametrize("descending", [False, True])
def test_slice_above_a_hundred_thousand_rows(spark, descending):
    n = 130_000
    keys = spark.range(n).select(F.lit("X").alias("exchange"), F.lit("A").alias("symbol"), F.date_add(F.lit("1700-01-01"), F.col("id").cast("int")).alias("period_date"), F.lit("NEGATIVE").alias("cls"), F.col("id").cast("double").alias("value"))
    got = lab.reduce_instances(keys.drop("value"), keys.drop("cls"), top=0.0, bottom=0.0, descending=descending)
    kept = {(r["period_date"] - dt.date(1700, 1, 1)).days for r in got.collect()}
    fib, a, b = {0}, 1, 1
    while a < n:
        fib.add(a)
        a, b = b, a + b
    middle = n - 1  # the last row lies past the slice
    assert kept == {(middle - 1 - f if descending else f) for f in fib if f < middle} | {n - 1}
    assert 121_393 in fib
