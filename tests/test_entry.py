"""The driver's contract on the smallest tables, and a sample of queries against their SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = ["t1_true_range", "t8_adx", "t12_supertrend", "l1_label", "n4_normalize", "c4_find_gaps", "m4_last_market_day", "j10_next_earnings", "v1_similarity", "a9_label_grid", "o6_pair_contracts", "i1_week_blocks", "e3_unique_fqe", "r5_balance_status", "g11_assemble", "s16_upsert_update", "c21_resolve_exchange"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not there")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{name}") else "")
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path}')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*cols).collect())
    want = sql.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(repr(tuple(plain(x) for x in r)) for r in want)
