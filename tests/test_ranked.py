"""Ranks over whole tables: equal to a plain window's, but no window holds a whole class or table."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import labels as lab

T = ["exchange", "symbol"]


@pytest.fixture(scope="module")
def inst(spark):
    rng = random.Random(2)
    rows = [(f"E{i % 3}", str(i % 41), dt.date(2020, 1, 1) + dt.timedelta(i), rng.choice(["POSITIVE", "NEGATIVE", "NEGATIVE", None])) for i in range(700)]
    return spark.createDataFrame(rows, "exchange string, symbol string, period_date date, cls string")


def spread(df):
    plan = df._jdf.queryExecution().analyzed().toString()
    windows = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", plan)
    # by range, or by ticker and class
    return windows and all("_range#" in x or x.startswith("exchange#") and "cls#" in x.split(" ASC")[0] for x in windows)


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_split(inst):
    w = Window.partitionBy("cls")
    k = F.row_number().over(w.orderBy(lab.mixed("exchange", "symbol", "period_date", seed=0), *T, "period_date"))
    n = F.count("*").over(w)
    want = inst.withColumn("k", k).withColumn("n", n).withColumn("part", F.when(F.col("k") <= F.floor(F.col("n") * 0.7), "train").when(F.col("k") <= F.floor(F.col("n") * (0.7 + 0.2)), "validation").otherwise("test")).drop("k", "n")
    got = lab.split(inst, 0.7, 0.2)
    same(got, want)
    assert spread(got)


def test_balanced_sample(inst):
    order = lab.mixed("exchange", "symbol", "period_date", seed=0)
    own = F.row_number().over(Window.partitionBy(*T, "cls").orderBy(order, "period_date"))
    rows = inst.withColumn("f", (own > 1).cast("int"))
    nth = F.row_number().over(Window.partitionBy("cls").orderBy("f", order, *T, "period_date"))
    want = rows.withColumn("n", nth).where(F.col("n") <= F.when(F.col("cls") == "POSITIVE", 30).otherwise(150)).drop("f", "n")
    got = lab.balanced_sample(inst, 180, 1 / 6, 1)
    same(got, want)
    assert spread(got)


def test_page_and_windows(spark):
    rng = random.Random(3)
    rows = [(f"E{i % 5}", f"S{i}", rng.randint(0, 3), rng.randint(1, 20)) for i in range(5000)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, positive long, negative long")
    tickers = sorted((r[0], r[1]) for r in rows)
    got = lab.page(df.select(*T), 7, 300)
    assert sorted(map(tuple, got.collect())) == tickers[2100:2107] and spread(got)
    dealt = lab.assign_windows(df, 4, 0.1)

    def key(r):
        gap = abs(r[2] / (r[2] + r[3]) - 0.1)
        return (0 if gap <= 0.02 else 1 if gap <= 0.05 else 2, -r[2] - r[3], r[0], r[1])

    want = {(r[0], r[1]): min(k % 8, 7 - k % 8) for k, r in enumerate(sorted(rows, key=key))}
    assert {(r["exchange"], r["symbol"]): r["window"] for r in dealt.collect()} == want and spread(dealt)
    sizes = [r["count"] for r in lab.key_ranges(df, T).groupBy("_range").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 200
