"""Sums of distances: exact zeros at every size, bounded blocks, and updates without joining pairs."""

import math

import numpy as np
import pytest

from tickloom.operators import similarity as sim

SCHEMA = "label int, vec_id long, v array<double>"


def test_copies_have_no_distance(spark):
    """More than 3,125 vectors of 64 values in a block: copies, which the product form set apart by noise."""
    rng = np.random.default_rng(1)
    v = (rng.normal(size=64) * 100).tolist()
    df = spark.createDataFrame([(1, i, v) for i in range(4000)], SCHEMA)
    # one block against one, by the work of a pair of blocks
    left, right = sim._cross(np.array([v] * 40), np.array([v] * 4000))
    assert left.max() == 0 and right.max() == 0
    assert sim.distance_sums(df, "label", "vec_id", "v", block=4000).where("value > 0").count() == 0


@pytest.mark.parametrize("block", [7, 1000])
def test_blocks_and_update(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5))
    data = [(i % 3 // 2, i, x[i].tolist()) for i in range(90)]
    df = spark.createDataFrame(data, SCHEMA)
    want = {i: sum(np.linalg.norm(x[i] - x[j]) for h, j, _ in data if h == g) for g, i, _ in data}
    got = {r["vec_id"]: r["value"] for r in sim.distance_sums(df, "label", "vec_id", "v", block).collect()}
    assert got == pytest.approx(want)
    old, new = df.where("vec_id % 5 <> 0 or label = 1"), df.where("vec_id % 5 = 0 and label <> 1")
    stored = sim.distance_sums(old, "label", "vec_id", "v", block)
    got = sim.update_distance_sums(stored, old, new, "label", "vec_id", "v", block)
    rows = got.collect()
    assert len(rows) == 90 and {r["vec_id"]: r["value"] for r in rows} == pytest.approx(want)


@pytest.mark.parametrize("block", [4, 1000])
def test_string_tickers_that_share_dates(spark, block):
    rng = np.random.default_rng(3)
    keys = [(x, s, c, f"2020-01-{k + 1:02}") for x, s, n in (("NYSE", "AB", 9), ("NYSE", "CD", 20), (None, "AB", 3)) for c in ("N", "P") for k in range(n)]
    vec = rng.normal(size=(len(keys), 4))
    df = spark.createDataFrame([(*k, v.tolist()) for k, v in zip(keys, vec)], "exchange string, symbol string, cls string, day string, v array<double>")
    group = ["exchange", "symbol", "cls"]
    want = {k: sum(np.linalg.norm(vec[i] - vec[j]) for j, o in enumerate(keys) if o[:3] == k[:3]) for i, k in enumerate(keys)}

    def plain(out):
        return {tuple(r[c] for c in (*group, "day")): r["value"] for r in out.collect()}

    assert plain(sim.distance_sums(df, group, "day", "v", block)) == pytest.approx(want)
    old, new = df.where("day not like '%2'"), df.where("day like '%2'")
    stored = sim.distance_sums(old, group, "day", "v", block)
    assert plain(sim.update_distance_sums(stored, old, new, group, "day", "v", block)) == pytest.approx(want)
    assert sim.distance_sums(df.limit(0), group, "day", "v").count() == 0
    pairs = sim.self_pairs(df, group, "day", "v").collect()
    assert len(pairs) == 2 * (9 * 8 + 20 * 19) // 2  # a null exchange pairs with none


def test_update_where_groups_share_ids(spark):
    df = spark.createDataFrame([(g, i, [float(g * i), 1.0]) for g in (1, 2) for i in (1, 2, 3)], SCHEMA)
    old, new = df.where("vec_id < 3"), df.where("vec_id = 3")
    got = sim.update_distance_sums(sim.distance_sums(old, "label", "vec_id", "v"), old, new, "label", "vec_id", "v")
    assert {(r["label"], r["vec_id"]): r["value"] for r in got.collect()} == {(1, 1): 3, (1, 2): 2, (1, 3): 3, (2, 1): 6, (2, 2): 4, (2, 3): 6}


def test_small_groups_are_not_dealt_to_python_one_by_one(spark):
    """Many groups of some hundred vectors: one block each, and one Python call for all of a partition."""
    df = spark.range(3000).selectExpr("id % 100 as g", "id as vec_id", "array(id / 7.0d, 1.0d) as v")
    out = sim.distance_sums(df, "g", "vec_id", "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsIn" not in plan and "MapInArrow" in plan
    got = {r["vec_id"]: r["value"] for r in out.collect()}
    assert len(got) == 3000 and got[0] == pytest.approx(sum(k * 100 / 7 for k in range(30)))


def test_runs_across_batches(spark):
    """Groups that begin in one Arrow batch and end in a later one, null keys and none at all."""
    import pyarrow as pa

    from tickloom.functions.runs import each_run

    df = spark.range(5000).selectExpr("nullif(id % 7, 3) as g", "cast(id % 2 as string) as h", "id as x")

    def work(t):
        x = t.column("x").to_pylist()
        return pa.RecordBatch.from_arrays([t.column("g").slice(0, 1), t.column("h").slice(0, 1), pa.array([len(x)], pa.int64()), pa.array([x == sorted(x)])], names=["g", "h", "n", "sorted"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = each_run(df, ["g", "h"], ["x"], work, "g long, h string, n long, sorted boolean").collect()
        assert each_run(df.limit(0), ["g", "h"], [], work, "g long, h string, n long, sorted boolean").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r["g"], r["h"]): r["n"] for r in df.groupBy("g", "h").count().withColumnRenamed("count", "n").collect()}
    assert {(r["g"], r["h"]): r["n"] for r in got} == want and len(got) == len(want) and all(r["sorted"] for r in got)


def test_pairs_of_a_large_group_are_dealt_in_blocks(spark):
    """A group of many blocks: every pair once, smaller id first, and no task's work is the whole group."""
    rng = np.random.default_rng(0)
    points = rng.normal(size=(60, 3)).tolist()
    rows = [(1, f"p{i}", p) for i, p in enumerate(points)] + [(2, "x", [1.0]), (2, "y", [3.0, 4.0]), (2, "z", None), (2, "w", [4.0]), (2, "v", [None])]
    df = spark.createDataFrame(rows, "label int, vec_id string, v array<double>")
    out = sim.self_pairs(df, ["label"], "vec_id", "v", block=8)
    got = {(r["label"], r["a"], r["b"]): r["distance"] for r in out.collect()}
    assert len(got) == 60 * 59 // 2 + 10 and all(a < b for _, a, b in got)
    for i in range(60):
        for j in range(60):
            if f"p{i}" < f"p{j}":
                assert got[1, f"p{i}", f"p{j}"] == pytest.approx(math.dist(points[i], points[j]))
    assert {k[1:]: d for k, d in got.items() if k[0] == 2 and d is not None} == {("w", "x"): 3.0}
    assert "_hi" in out._jdf.queryExecution().optimizedPlan().toString()
