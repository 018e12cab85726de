"""Vectors of a feature map and of filings, held against plain builders."""

import calendar
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import feature_map as fm
from tickloom.operators import features as ft
from tickloom.operators.joins import preceding_reports


def d(s):
    return dt.date.fromisoformat(s)


def hot(i, n):
    return [float(k == i) for k in range(n)]


REPORTS = [("X", "A", d("2020-03-31"), 1, d("2020-05-04"), {"Assets": 5.0}), ("X", "A", d("2020-06-30"), 2, d("2020-08-10"), {"Assets": 7.0, "Debt": None}), ("X", "A", d("2020-12-31"), 4, d("2021-02-28"), {"Debt": 3.0})]
ANCHORS = [("X", "A", d(x)) for x in ("2020-05-03", "2020-05-10", "2020-08-20", "2020-12-15", "2021-03-01")] + [("X", "B", d("2020-05-10"))]


@pytest.fixture(scope="module")
def reports(spark):
    return spark.createDataFrame(REPORTS, "exchange string, symbol string, period date, quarter int, filed date, nums map<string,double>")


def plain(anchor, preceding, tags, form):
    """(not filed, quarters) as they should be."""
    had = sorted((r for r in REPORTS if r[:2] == anchor[:2] and anchor[2] - dt.timedelta(preceding + 1) <= r[4] <= anchor[2]), key=lambda r: r[2])
    month = lambda x: hot(x.month - 1, 12) if form == "one_hot" else [(x.month - 1) / 12 - (0.5 if form == "scaled" else 0)]
    day = lambda x: hot(x.day - 1, 31) if form == "one_hot" else [(x.day - 1) / calendar.monthrange(x.year, x.month)[1] - (0.5 if form == "scaled" else 0)]
    each = [[1.0, *hot(q - 1, 4), *month(p), *day(f), *month(f), *(v for t in tags for v in ([1.0, nums[t] or 0.0] if t in nums else [0.0, 0.0]))] for _, _, p, q, f, nums in had]
    n = -(-preceding // 90)
    width = len(each[0]) if each else 5 + {"one_hot": 55}.get(form, 3) + 2 * len(tags)
    flag = float(bool(had) and anchor[2].month - had[-1][2].month > 3)
    return flag, [[0.0] * width] * max(0, n - len(each)) + each[-n:]


@pytest.mark.parametrize("form", ["one_hot", "scaled", "natural"])
@pytest.mark.parametrize("preceding", [30, 200])
def test_financial_vector(spark, reports, form, preceding):
    inst = spark.createDataFrame(ANCHORS, "exchange string, symbol string, period_date date")
    tags = ft.tier_tags([["Assets"], ["Debt", "Assets"], ["Never"]], 2)
    got = ft.financial_vector(preceding_reports(inst, reports, preceding), inst, preceding, tags, True, form, form)
    have = {(r["exchange"], r["symbol"], r["period_date"]): (r["_not_filed"], r["_quarters"]) for r in got.collect()}
    assert len(have) == len(ANCHORS)
    for a in ANCHORS:
        flag, quarters = plain(a, preceding, tags, form)
        assert have[a][0] == flag
        assert len(have[a][1]) == len(quarters)
        for x, y in zip(have[a][1], quarters):
            assert x == pytest.approx(y)


def test_tiers():
    assert ft.tier_tags([["a", "b"], ["b", "c"], ["d"]], 2) == ["a", "b", "c"]
    assert ft.tier_tags([["a"]], 0) == []
    with pytest.raises(ValueError):
        ft.tier_tags([["a"]], 2)


TREE = {"exchange": {"enabled": True}, "stock": {"close": {"enabled": True}, "open": {"enabled": False}}, "googleInterests": {"enabled": True}, "financials": {"enabled": True, "maxTierIndex": 1, "tierTags": [["Assets"]]}, "etf": {"enabled": True}}


def test_layout():
    fmap = fm.FeatureMap(TREE, exchanges=("X", "Y"))
    assert list(fmap.features) == ["exchange", "stock_close", "googleInterests", "financials", "etf"]
    assert fmap.layout(100) == [("static", "exchange", 0, 3), ("series", "stock_close", 0, 1), ("series", "googleInterests", 1, 4), ("static", "financials", 3, 1), ("semiseries", "financials", 0, 14), ("static", "etf", 4, 1)]
    with pytest.raises(ValueError, match="no such feature: stock_colour"):
        fm.FeatureMap({"stock": {"colour": {"enabled": True}}})


def test_vectors_by_hand(spark, reports):
    days = [d("2020-05-01") + dt.timedelta(k) for k in range(8)]
    bars = spark.createDataFrame([("X", s, x, 1.0, 2.0, 0.5, 10.0 * k + (s == "B"), 5.0) for s in "AB" for k, x in enumerate(days)], "exchange string, symbol string, period_date date, open double, high double, low double, close double, volume double")
    interest = spark.createDataFrame([("X", "A", days[2], 7.0), ("X", "A", days[2], 3.0), ("X", "A", days[5], 9.0)], "exchange string, symbol string, date date, relative_interest double")
    info = spark.createDataFrame([("X", "A", True)], "exchange string, symbol string, etf boolean")
    anchors = spark.createDataFrame([("X", s, days[k], "POSITIVE") for s in "AB" for k in (4, 6, 7)], "exchange string, symbol string, period_date date, cls string")
    fmap = fm.FeatureMap(TREE, exchanges=("X", "Y"))
    tables = {"interest": interest, "info": info, "reports": reports}
    got = {(r["symbol"], r["period_date"]): r for r in fm.vectors(anchors, bars, fmap, tables, 5).collect()}
    flat = {(r["symbol"], r["period_date"]): r["vector"] for r in fm.vectors(anchors, bars, fmap, tables, 5, recurrent=False).collect()}
    assert set(got) == set(flat) == {(s, days[k]) for s in "AB" for k in (6, 7)}  # the fifth day has four before it
    filed = {days[6]: 1.0, days[7]: 1.0}  # the report of 4 May
    for (s, day), r in got.items():
        k = days.index(day)
        told = {days[2]: 7.0, days[5]: 9.0} if s == "A" else {}
        window = days[k - 5 : k]
        each = [[10.0 * days.index(x) + (s == "B"), 0.0, float(i >= 2), float(x not in told), told.get(x, 0.0) if i < 2 else 0.0] for i, x in enumerate(window)]
        static = [0.0, 1.0, 0.0, 0.0, float(s == "A")]
        semi = [1.0, *hot(0, 4), 1.0, 5.0] if s == "A" and filed[day] else [0.0] * 7
        assert r["cls"] == "POSITIVE" and r["static"] == static and r["semiseries"] == semi
        assert r["series"] == [v for x in each for v in x]
        assert flat[s, day] == [*static[:3], *(x[0] for x in each), *(v for x in each for v in x[1:]), static[3], *semi, static[4]]


def test_no_anchor_and_no_table(spark):
    bars = spark.createDataFrame([], "exchange string, symbol string, period_date date, open double, high double, low double, close double, volume double")
    fmap = fm.FeatureMap({"stock": {"close": {"enabled": True}}})
    assert fm.vectors(bars.select(*ft.KEY).withColumn("x", F.lit(1)), bars, fmap, {}, 5).count() == 0


def test_no_window_is_shuffled(spark, reports):
    """A window is some `preceding` times as large as a bar: all joins that move rows come before it."""
    days = [d("2020-05-01") + dt.timedelta(k) for k in range(8)]
    bars = spark.createDataFrame([("X", "A", x, 1.0, 2.0, 0.5, 3.0, 5.0) for x in days], "exchange string, symbol string, period_date date, open double, high double, low double, close double, volume double")
    info = spark.createDataFrame([("X", "A", True)], "exchange string, symbol string, etf boolean")
    interest = spark.createDataFrame([("X", "A", days[2], 7.0)], "exchange string, symbol string, date date, relative_interest double")
    anchors = spark.createDataFrame([("X", "A", days[6], c) for c in ("P", "N", "N")] + [("X", "A", d("2021-01-01"), "P")], "exchange string, symbol string, period_date date, cls string")
    out = fm.vectors(anchors, bars, fm.FeatureMap(TREE, exchanges=("X", "Y")), {"interest": interest, "info": info, "reports": reports}, 5)
    assert sorted(r["cls"] for r in out.collect()) == ["N", "N", "P"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    above = plan[: plan.index("collect_list(_day")]
    assert "Exchange" not in above


@pytest.mark.parametrize("preceding", [30, 200])
def test_financials_as_of(spark, reports, preceding):
    """The same quarters as by a join of each anchor with its reports; repeated anchors stay."""
    days = [("X", s, d("2020-04-01") + dt.timedelta(9 * k)) for s in "AB" for k in range(60)] + [("X", "A", d("2020-05-10"))] * 2
    inst = spark.createDataFrame(days, "exchange string, symbol string, period_date date")
    rows = ft.financials_as_of(inst, reports, preceding, ["Assets", "Debt"], True, "scaled", "scaled").collect()
    assert len(rows) == len(days)
    for r in rows:
        flag, quarters = plain((r["exchange"], r["symbol"], r["period_date"]), preceding, ["Assets", "Debt"], "scaled")
        assert r["_not_filed"] == flag and [list(q) for q in r["_quarters"]] == [pytest.approx(q) for q in quarters]
    pairs = preceding_reports(inst, reports, preceding)
    want = sum(a[:2] == r[:2] and a[2] - dt.timedelta(preceding + 1) <= r[4] <= a[2] for a in days for r in REPORTS)
    assert pairs.count() == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "filed" in plan and plan.index("Union") < plan.index("Join")  # bars meet no report in a join


def test_quarters_take_their_form_once_a_state(spark):
    """The form of the quarters is made below the window that carries them to the anchors, and for anchors without any too."""
    from tickloom.operators.features import financials_as_of

    reports = spark.sql("select 'X' as exchange, 'A' as symbol, date'2020-03-31' as period, 1 as quarter, date'2020-05-01' as filed, map('Assets', 7.0d) as nums")
    anchors = spark.sql("select 'X' as exchange, 'A' as symbol, explode(sequence(date'2020-04-29', date'2020-05-03')) as period_date")
    out = financials_as_of(anchors, reports, 400, ["Assets"], form=lambda q: F.aggregate(q, F.lit(0.0), lambda a, x: a + x[6]))
    assert [r["_quarters"] for r in out.orderBy("period_date").collect()] == [0, 0, 7, 7, 7]
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    assert above.count("aggregate(") == 1  # of no quarters at all, for anchors before the first state


def test_filings_are_numbered_once(spark):
    from tickloom import registry

    for name in ("g6_financial_vector", "g6_financial_features", "j9_preceding_reports"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "AS idx" not in plan and "l_shipdate" not in plan


def test_no_filings_are_broadcast(spark):
    """A million filings lie in some MB of file, so that Spark would send them, unpacked, through the driver: joins of them merge."""
    from tickloom import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()["g11_flat_vector"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert sent and not [line for line in sent if "adsh" in line or "symbol" in line]


@pytest.mark.parametrize("preceding", [2, 3, 5])
def test_tables_come_to_the_bars_in_one_series(spark, reports, preceding):
    """Whatever tables a map needs, bars are dealt once, and no table goes through the driver; odd keys find nothing."""
    days = [d("2020-05-01") + dt.timedelta(k) for k in range(8)]
    bars = spark.createDataFrame([("X", s, x, 1.0, 2.0, 0.5, 10.0 * k, 5.0) for s in ("A", None) for k, x in enumerate(days)], "exchange string, symbol string, period_date date, open double, high double, low double, close double, volume double")
    info = spark.createDataFrame([("X", "A", True), ("X", None, True)], "exchange string, symbol string, etf boolean")
    interest = spark.createDataFrame([("X", "A", x, 7.0 + k) for k, x in enumerate(days)], "exchange string, symbol string, date date, relative_interest double")
    splits = spark.createDataFrame([("X", "A", days[5], 1.0, 2.0), ("X", "A", days[5], 1.0, 3.0)], "exchange string, symbol string, date date, split_from double, split_to double")
    anchors = spark.createDataFrame([("X", "A", days[7]), ("X", None, days[7]), ("X", "A", None)], "exchange string, symbol string, period_date date")
    fmap = fm.FeatureMap(TREE | {"stockSplits": {"enabled": True}}, exchanges=("X", "Y"))
    tables = {"interest": interest, "info": info, "reports": reports, "splits": splits}
    out = fm.vectors(anchors, bars, fmap, tables, preceding)
    (row,) = out.collect()
    each = [[10.0 * k, 0.0, float(i >= preceding - 3), 0.0, 0.0 if i >= preceding - 3 else 7.0 + k, float(k == 5), 2.0 * (k == 5)] for i, k in enumerate(range(7 - preceding, 7))]
    assert row["series"] == [v for x in each for v in x] and row["static"] == [0.0, 1.0, 0.0, 0.0, 1.0]
    (flat,) = fm.vectors(anchors, bars, fmap, tables, preceding, recurrent=False).collect()
    at = [[0], [1, 2, 3, 4]]
    assert flat["vector"] == [0.0, 1.0, 0.0, *(x[k] for ks in at for x in each for k in ks), 0.0, *row["semiseries"], 1.0, *(v for x in each for v in x[5:])]
    (twice,) = fm.vectors(anchors, bars, fmap, tables, preceding, form=lambda x: F.transform(x, lambda v: 2 * v)).collect()
    assert all(twice[c] == [2 * v for v in row[c]] for c in ("static", "semiseries", "series"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("REPARTITION_BY_COL") == 1
