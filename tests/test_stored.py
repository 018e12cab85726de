"""Stored tables, the filings ledger and landed columns: what is rewritten, what is read, and what survives a lost job."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tickloom.operators import reference_data as ref
from tickloom.operators.predicates import Compare, Null
from tickloom.sources import landed
from tickloom.sources.stored import Stored

SCHEMA = "ex string, day int, k long, v double, w string"


def table(spark, tmp_path, name="t"):
    return Stored(spark, f"file://{tmp_path}/{name}", spark.createDataFrame([], SCHEMA).schema, ("ex", "day", "k"), ("ex", "day"))


def files(tmp_path, name="t"):
    out = {}
    for folder, _, names in os.walk(tmp_path / name):
        for n in names:
            if n.endswith(".parquet"):
                out.setdefault(os.path.relpath(folder, tmp_path / name), set()).add(n)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


OLD = [("a", 1, 1, 1.0, "x"), ("a", 1, 2, 2.0, "x"), ("a", 2, 1, 3.0, None), ("b: +%/c", 1, 1, 4.0, "x"), (None, 1, 1, 5.0, "x")]
NEW = [("a", 1, 2, None, "y"), ("a", 1, 3, 9.0, "y"), ("d", 7, 1, 8.0, "y")]
AFTER = {
    "ignore": OLD + NEW[1:],
    "replace": [OLD[0], *OLD[2:], *NEW],
    "update": [OLD[0], ("a", 1, 2, 2.0, "y"), *OLD[2:], *NEW[1:]],
}


@pytest.mark.parametrize("mode", list(AFTER))
def test_merge_rewrites_touched_partitions_only(spark, tmp_path, mode):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and not t.exists()
    t.merge(spark.createDataFrame(OLD, SCHEMA))
    before = files(tmp_path)
    assert rows(t.read()) == rows(spark.createDataFrame(OLD, SCHEMA))
    t.merge(spark.createDataFrame(NEW, SCHEMA), mode)
    want = rows(spark.createDataFrame(AFTER[mode], SCHEMA))
    assert rows(t.read()) == want
    after = files(tmp_path)
    assert {f for f in before if before[f] == after[f]} == set(before) - {"ex=a/day=1"}
    t.merge(spark.createDataFrame(NEW, SCHEMA), mode)  # twice is once
    assert rows(t.read()) == want


def test_delete(spark, tmp_path):
    t = table(spark, tmp_path)
    t.delete(k=1)  # of a table that is not there
    t.merge(spark.createDataFrame(OLD, SCHEMA))
    before = files(tmp_path)
    t.delete(v=Compare(">", 1.5), w="x", ex="a")
    assert rows(t.read()) == rows(spark.createDataFrame([OLD[0], *OLD[2:]], SCHEMA))
    assert {f for f in before if before[f] == files(tmp_path)[f]} == set(before) - {"ex=a/day=1"}
    t.delete(ex="b: +%/c")  # all rows of a partition: its folder goes
    t.delete(ex=Null())
    assert rows(t.read()) == rows(spark.createDataFrame([OLD[0], OLD[2]], SCHEMA))
    assert set(files(tmp_path)) == {"ex=a/day=1", "ex=a/day=2"}
    t.delete(w="never")
    t.delete()
    assert t.read().count() == 0 and files(tmp_path) == {}


def test_a_lost_change_is_finished_or_cleared_away(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame(OLD, SCHEMA))

    def lost(self, pending):
        shutil.rmtree(tmp_path / "t" / "ex=a" / "day=1")  # as if lost after old files went and before new ones came
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Stored, "_swap", lost)
        with pytest.raises(RuntimeError):
            t.merge(spark.createDataFrame(NEW, SCHEMA), "replace")
    assert t.read().count() < len(OLD)
    t.resume()
    assert rows(t.read()) == rows(spark.createDataFrame(AFTER["replace"], SCHEMA))
    os.makedirs(tmp_path / "t" / "_pending-half" / "rows")  # not written whole
    t.merge(spark.createDataFrame(NEW, SCHEMA), "replace")
    assert rows(t.read()) == rows(spark.createDataFrame(AFTER["replace"], SCHEMA))
    assert not [n for n in os.listdir(tmp_path / "t") if n.startswith("_pending")]


def test_partitions_are_keys(spark, tmp_path):
    with pytest.raises(ValueError):
        Stored(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, ("k",), ("ex",))


def quarter(tmp_path, name, adsh):
    at = tmp_path / "in" / name
    at.mkdir(parents=True)
    (at / "sub.txt").write_text(f"adsh\tcik\tfp\tperiod\tfiled\n{adsh}\t320193\tQ1\t20200331\t20200501\n")
    (at / "tag.txt").write_text("tag\tversion\tcustom\tabstract\nAssets\tus-gaap/2020\t0\t0\n")
    (at / "num.txt").write_text(f"adsh\ttag\tversion\tcoreg\tddate\tqtrs\tuom\tvalue\n{adsh}\tAssets\tus-gaap/2020\t\t20200331\t0\tUSD\t5\n")


def test_loaded_quarters_are_not_read(spark, tmp_path):
    info = spark.createDataFrame([("0000320193", "NASDAQ", "AAPL")], "cik string, exchange string, symbol string")
    quarter(tmp_path, "2020q1", "a1")
    quarter(tmp_path, "2020q2", "a2")
    root, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    assert landed.new_quarters(spark, root, ["2020q1"]) == ["2020q2"]
    sub, _, num = landed.load_edgar(spark, root, info, ["2020q1"])
    assert [(r["adsh"], r["symbol"], r["loaded_quarter"]) for r in sub.collect()] == [("a2", "AAPL", "2020q2")]
    assert all("2020q2" in f for f in num.inputFiles())
    assert landed.load_new_quarters(spark, root, out, info) == ["2020q2", "2020q1"]
    (tmp_path / "in" / "2020q1" / "sub.txt").write_text("broken")  # is not looked at again
    assert landed.load_new_quarters(spark, root, out, info) == []
    assert [x.inputFiles() for x in landed.load_edgar(spark, root, info, ["2020q1", "2020q2"])] == [[], [], []]
    quarter(tmp_path, "2020q3", "a3")
    assert landed.load_new_quarters(spark, root, out, info) == ["2020q3"]
    assert sorted(r["adsh"] for r in spark.read.parquet(f"{out}/sub").collect()) == ["a1", "a2", "a3"]
    assert spark.read.parquet(f"{out}/tag").count() == 1 and spark.read.parquet(f"{out}/num").count() == 3
    assert sorted(landed.load_ledger(spark, f"{out}/ledger")) == ["2020q1", "2020q2", "2020q3"]


def test_columns_of_landed_objects(spark):
    texts = ['{"isActive": true, "shareCount": 5, "name": "n", "mixed": "x", "at": {"a": 1}}', '{"isActive": "yes", "shareCount": 2.5, "mixed": 1, "is_active": null}', '{"mixed": false, "none": null}', "{}", "no json", None, "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "json string")
    found = ref.infer_columns(df)
    assert found == {"is_active": ("boolean", ["isActive", "is_active"]), "share_count": ("double", ["shareCount"]), "name": ("string", ["name"]), "mixed": ("boolean", ["mixed"]), "at": ("string", ["at"]), "none": ("string", ["none"])}
    target = spark.createDataFrame([("old", 1)], "name string, extra int")
    got = ref.align_landed(target, df)
    assert dict(got.dtypes) == {"name": "string", "extra": "int", "is_active": "boolean", "share_count": "double", "mixed": "boolean", "at": "string", "none": "string"}
    byname = {r["name"]: r for r in got.collect() if r["name"]}
    assert tuple(byname["old"])[:2] == ("old", 1) and byname["old"]["is_active"] is False and byname["old"]["share_count"] is None
    assert byname["n"]["is_active"] is True and byname["n"]["share_count"] == 5.0 and byname["n"]["at"] == '{"a":1}'
    assert got.count() == 1 + len(texts) and got.where("share_count = 2.5 and is_active is null").count() == 1
    with pytest.raises(ValueError, match="1st"):
        ref.infer_columns(spark.createDataFrame([('{"1st": 2}',)], "json string"))
    assert ref.align_landed(target, df.limit(0)).count() == 1


TICKERS = [("NYSE", "A", "Alpha Inc"), ("NASDAQ", "A", "Other"), ("NYSE", "B", "Beta"), ("NASDAQ", "B", "Beta"), ("OTCBB", "C", "Gamma"), ("NYSE", "C", "Gamma"), ("LSE", "D", "Delta"), ("NYSE", "E", "Epsilon"), ("NYSE", "E", "Other"), ("BATS", "E", "Zeta"), ("NYSE", "XM", "x")]
CASES = [
    # name, symbol, quoted -> exchange, step
    (("A", "Alpha Inc", "NYSE"), ("NYSE", "both")),
    (("A", "Nobody", "NYSE"), ("NYSE", "exchange")),
    (("A", "alpha inc", "PNK"), ("NYSE", "name")),
    (("A", "Alpha Inc", "NASDAQ"), (None, "rejected")),  # the namesake is elsewhere
    (("A", None, None), (None, "quoted")),
    (("B", "Beta", "PNK"), (None, "rejected")),  # two namesakes
    (("B", "Beta", "NYSE"), ("NYSE", "both")),  # two, one of them there
    (("C", "Gamma", "PNK"), ("NYSE", "name")),  # of several, over the counter does not count
    (("D", "Delta", "LSE"), ("LSE", "quoted")),  # abroad is no ticker
    (("E", "Zeta", "NYSE"), ("BATS", "name")),
    (("E", "Nobody", "NYSE"), (None, "rejected")),  # two tickers of that exchange
    (("E", "Epsilon", "NYSE"), (None, "rejected")),
    (("XM", "x", "NYSE"), ("NASDAQ", "manual")),
    (("RZB", "x", "NYSE MKT"), ("NYSE", "primary")),
    (("Z", "x", "n.y."), ("NYSE", "quoted")),  # by its standard name
]


@pytest.mark.parametrize("asked,want", CASES)
def test_listing_steps(spark, asked, want):
    tickers = spark.createDataFrame(TICKERS, "exchange string, symbol string, name string")
    aliases = spark.createDataFrame([("n.y.", "NYSE")], "alias string, standard string")
    symbols = spark.createDataFrame([asked], "symbol string, name string, quoted string")
    row = ref.resolve_listing(symbols, tickers, aliases=aliases).first()
    assert (row["exchange"], row["step"]) == want


def test_source_comes_first(spark):
    symbols = spark.createDataFrame([("XM", "x", "NYSE")], "symbol string, name string, quoted string")
    listed = spark.createDataFrame([("XM", "n1", False, "2020-01-01"), ("XM", "n2", True, None), ("XM", "?", True, None)], "symbol string, exchange string, active boolean, delisted string")
    aliases = spark.createDataFrame([("n1", "NYSE"), ("n2", "BATS")], "alias string, standard string")
    row = ref.resolve_listing(symbols, symbols.select("symbol", "name", F.lit("NYSE").alias("exchange")), listed, aliases).first()
    assert (row["exchange"], row["step"]) == ("BATS", "source")


def test_delete_reads_a_path_once_a_file(spark, tmp_path, monkeypatch):
    """The partition's folder is told from the path of each file, not from that of each row."""
    t = table(spark, tmp_path)
    t.merge(spark.range(400).selectExpr("'a b' as ex", "cast(id % 2 as int) as day", "id as k", "cast(id as double) as v", "'w' as w"))
    asked = []
    plain = Stored._folders
    monkeypatch.setattr(Stored, "_folders", lambda self, df: (asked.append(df.count()), plain(self, df))[1])
    t.delete(v=Compare("<", 10))
    assert asked == [2] and t.read().count() == 390
    t.delete(day=1)
    assert {r["day"] for r in t.read().collect()} == {0} and list(files(tmp_path)) == ["ex=a b/day=0"]


def test_quarters_are_named_without_a_path(spark, tmp_path):
    """Two quarters with their columns in other orders; no row's path is looked at."""
    for q, head, line in (("q 1", "adsh\tcik\tfp\tperiod\tfiled", "a\t1\tQ1\t20200331\t20200501"), ("q2", "cik\tadsh\tfp\tperiod\tfiled", "1\tb\tQ2\t20200630\t20200801")):
        (tmp_path / q).mkdir()
        (tmp_path / q / "sub.txt").write_text(f"{head}\n{line}\n")
        (tmp_path / q / "tag.txt").write_text("tag\tversion\tcustom\tabstract\nT\tv\t0\t0\n")
        (tmp_path / q / "num.txt").write_text("adsh\ttag\tversion\tcoreg\tddate\tqtrs\tuom\tvalue\na\tT\tv\t\t20200331\t0\tUSD\t5\n")
    info = spark.createDataFrame([("1", "X", "S")], "cik string, exchange string, symbol string")
    sub, tag, num = landed.load_edgar(spark, f"file://{tmp_path}", info, [])
    assert {(r["adsh"], r["cik"], r["loaded_quarter"]) for r in sub.collect()} == {("a", "1", "q 1"), ("b", "1", "q2")}
    assert tag.count() == 1 and num.count() == 2
    assert "_metadata" not in num._jdf.queryExecution().analyzed().toString()
