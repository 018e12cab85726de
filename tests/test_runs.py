"""Recursions over many tickers at once, and grouped work without a Python call for each group."""

import datetime as dt

import numpy as np
import pytest

from tickloom.operators import indicators as ind
from tickloom.operators import interest as gi


def test_tickers_side_by_side_are_as_each_alone():
    """Padded to the longest; every value to its last bit, at lengths about each indicator's warm-up."""
    rng = np.random.default_rng(4)
    sizes = [300, 1, 6, 7, 13, 14, 15, 26, 27, 28, 29, 60, 201]
    some = [[100 + rng.normal(size=n).cumsum() + k for k in (1.0, -1.0, 0.0)] for n in sizes]
    real = np.arange(max(sizes)) < np.array(sizes)[:, None]
    padded = [np.full(real.shape, np.nan) for _ in range(3)]
    for k in range(3):
        padded[k][real] = np.concatenate([x[k] for x in some])
    for variant in ("reference", "textbook"):
        together = ind._recursions(*padded, list(ind.RECURSIVE), variant, ind.DEFAULTS)
        for i, x in enumerate(some):
            alone = ind._recursions(*x, list(ind.RECURSIVE), variant, ind.DEFAULTS)
            for name, v in alone.items():
                assert np.array_equal(together[name][i, : sizes[i]], v, equal_nan=True), (name, sizes[i])


def test_recursive_and_projected_months_are_not_dealt_one_by_one(spark):
    days = spark.range(60).selectExpr("'X' as exchange", "cast(id % 3 as string) as symbol", "date_add(date'2020-01-01', cast(id * 10 as int)) as date", "id + 1.0d as relative_interest")
    months = gi.monthly(days).where("month(month) % 4 <> 0")
    bars = days.selectExpr("exchange", "symbol", "date as period_date", "relative_interest as high", "relative_interest as low", "relative_interest as close")
    for out in (gi.project_months(days, months), ind.recursive(bars, ["rsi", "ema5"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsIn" not in plan and "MapInArrow" in plan
    rows = ind.recursive(bars, ["ema5"]).where("symbol = '1'").orderBy("period_date").collect()
    assert [r["ema5"] is None for r in rows] == [k < 4 for k in range(20)]


def test_projected_months_follow_each_other(spark):
    """A projected month joins those that the next is taken from; all are scaled to 100; one without a near month is null."""
    d = dt.date
    daily = spark.createDataFrame([("X", "A", d(2020, m, 5), t) for m, t in ((1, 10.0), (2, 20.0), (3, 40.0))] + [("X", "B", d(2020, 1, 5), 3.0)], "exchange string, symbol string, date date, relative_interest double")
    months = spark.createDataFrame([("X", "A", d(2020, 1, 1), 50.0)], "exchange string, symbol string, month date, value double")
    got = {(r["symbol"], r["month"].month): r["value"] for r in gi.project_months(daily, months).collect()}
    assert got == {("A", 1): 25.0, ("A", 2): 50.0, ("A", 3): pytest.approx(100.0), ("B", 1): None}
