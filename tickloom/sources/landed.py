"""Readers of landed response files: the same fields as the services send, as rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import edgar_date, snake

GROUPED = "results array<struct<T: string, o: double, h: double, l: double, c: double, v: double, n: double>>"
AGGREGATES = "ticker string, results array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double, vw: double, n: double>>"


def parse_grouped_daily(df: DataFrame) -> DataFrame:
    """json, period_date: one day of all tickers as dump rows."""
    r = df.select("period_date", F.explode(F.from_json("json", GROUPED)["results"]).alias("r"))
    return r.select(F.col("r.T").alias("ticker"), "period_date", F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"), F.col("r.c").alias("close"), F.col("r.v").alias("volume"), F.coalesce("r.n", F.lit(0.0)).alias("transactions"))


def parse_series_map(df: DataFrame) -> DataFrame:
    """exchange, symbol, json: an object of dates with "1. open" and so on."""
    days = df.select("exchange", "symbol", F.explode(F.from_json("json", "map<string, map<string, string>>")).alias("d", "m"))
    named = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume"}
    return days.select("exchange", "symbol", F.col("d").cast("date").alias("period_date"), *[F.element_at("m", v).cast("double").alias(k) for k, v in named.items()])


def parse_aggregates(df: DataFrame) -> DataFrame:
    """json: bars of one ticker with millisecond times."""
    j = df.select(F.from_json("json", AGGREGATES).alias("j"))
    r = j.select(F.col("j.ticker").alias("ticker"), F.explode("j.results").alias("r"))
    return r.select("ticker", F.timestamp_millis("r.t").alias("timestamp"), *[F.col(f"r.{a}").alias(b) for a, b in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"), ("vw", "volume_weighted_average"))], F.coalesce("r.n", F.lit(0.0)).alias("transactions"))


def parse_epoch_payload(df: DataFrame) -> DataFrame:
    """symbol, json: a list of [epoch ms, close] points as dated closes."""
    p = df.select("symbol", F.explode(F.from_json("json", "array<array<double>>")).alias("p"))
    return p.select("symbol", F.to_date(F.timestamp_millis(F.col("p")[0].cast("long"))).alias("period_date"), F.col("p")[1].alias("close"))


def clean_vix(lines: DataFrame) -> DataFrame:
    """value: lines `month/day/year, open, high, low, close`; other lines are left out, n/a is 0, artificial 0."""
    parts = lines.where(F.col("value").rlike(r"^\d{1,2}/\d{1,2}/\d{4},")).select(F.split("value", ",").alias("p"))
    number = lambda i: F.when(F.lower(F.trim(F.col("p")[i])) == "n/a", 0.0).otherwise(F.expr(f"try_cast(p[{i}] as double)"))
    return parts.select(F.to_date(F.col("p")[0], "M/d/yyyy").alias("period_date"), number(1).alias("open"), number(2).alias("high"), number(3).alias("low"), number(4).alias("close"), F.lit(0).alias("artificial"))


def read_vix_csv(spark: SparkSession, path: str) -> DataFrame:
    return clean_vix(spark.read.text(path))


def new_quarters(spark: SparkSession, root: str, loaded: Iterable[str] = ()) -> list[str]:
    """The folders below root, one a quarter, that are not loaded yet, the latest first; no file is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    names = {f.getPath().getName() for f in found if f.isDirectory()}
    return sorted((n for n in names - set(loaded) if n[0] not in "._"), reverse=True)


#: The columns that are read of each file, all as text (fixed names of the published data sets).
EDGAR = {"sub": ["adsh", "cik", "fp", "period", "filed"], "tag": ["tag", "version", "custom", "abstract"], "num": ["adsh", "tag", "version", "coreg", "ddate", "qtrs", "uom", "value"]}


def load_edgar(spark: SparkSession, root: str, symbol_info: DataFrame, loaded: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sub, tag, num) of tab-separated files: tickers by CIK, repeated tags dropped, repeated keys of num marked.

    root is one quarter's folder, or, with `loaded`, the folder of all quarters: those in `loaded` are skipped before any
    file is read, and sub and num have a column loaded_quarter. The ledger of what is loaded is the caller's to keep
    (load_ledger()). Where nothing is new, the frames are empty.
    """
    quarters = None if loaded is None else new_quarters(spark, root, loaded)

    def read(name: str) -> DataFrame:
        if quarters is None:
            return spark.read.csv(f"{root}/{name}.txt", sep="\t", header=True)
        if not quarters:
            return spark.createDataFrame([], ", ".join(f"{c} string" for c in [*EDGAR[name], "loaded_quarter"]))
        # a quarter's name is said of its files, as to take it from the path of every row would cost more than to read the row
        each = [spark.read.csv(f"{root}/{q}/{name}.txt", sep="\t", header=True).withColumn("loaded_quarter", F.lit(q)) for q in quarters]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)

    sub = attach_ticker(read("sub"), symbol_info).withColumn("filed", edgar_date(F.col("filed"))).withColumn("period", edgar_date(F.col("period")))
    num = mark_duplicates(read("num").withColumn("ddate", edgar_date(F.col("ddate"))).withColumn("value", F.col("value").cast("double")))
    return sub, read("tag").dropDuplicates(["tag", "version"]), num


def load_ledger(spark: SparkSession, path: str) -> list[str]:
    """The quarters that a ledger says are loaded; some dozens of names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    return [r["quarter"] for r in spark.read.schema("quarter string").parquet(path).distinct().collect()]


def load_new_quarters(spark: SparkSession, root: str, out: str, symbol_info: DataFrame) -> list[str]:
    """Load what is new below root into Parquet at out (sub, tag, num and the ledger); returns the quarters loaded.

    sub and num are written by quarter and replace what a lost run left of the same quarters; the ledger gets its line last,
    so a run that was lost is made again whole and a second run reads no file. tag keeps one row of each tag and version.
    """
    ledger = f"{out}/ledger"
    had = load_ledger(spark, ledger)
    fresh = new_quarters(spark, root, had)
    if not fresh:
        return []
    sub, tag, num = load_edgar(spark, root, symbol_info, had)
    for name, df in (("sub", sub), ("num", num)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("loaded_quarter").parquet(f"{out}/{name}")
    tags = tag.drop("loaded_quarter")
    if had:
        known = spark.read.schema(tags.schema).parquet(f"{out}/tag")
        tags = tags.join(known, ["tag", "version"], "left_anti")
    tags.write.mode("append").parquet(f"{out}/tag")
    spark.createDataFrame([(q,) for q in fresh], "quarter string").write.mode("append").parquet(ledger)
    return fresh


def attach_ticker(sub: DataFrame, symbol_info: DataFrame) -> DataFrame:
    """sub with exchange and symbol by CIK, plain or padded to ten digits."""
    side = symbol_info.select(F.lpad("cik", 10, "0").alias("_cik"), "exchange", "symbol").dropDuplicates(["_cik"])
    return sub.join(side, F.lpad(F.col("cik").cast("string"), 10, "0") == F.col("_cik"), "left").drop("_cik")


def mark_duplicates(num: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    keys = ["adsh", "tag", "version", "coreg", "ddate", "qtrs", "uom"]
    nth = F.row_number().over(Window.partitionBy(*[k for k in keys if k in num.columns]).orderBy("value"))
    return num.withColumn("duplicate", nth > 1)


def clean_earnings(df: DataFrame) -> DataFrame:
    """Text fields of an earnings calendar as numbers and dates: $1,234; (0.49); %m/%d/%Y or Mon/YYYY; N/A; `x (y%)`.

    The surprise's sign is turned where it contradicts eps against its forecast.
    """
    blank = lambda c: F.when(F.trim(F.col(c)).isin("N/A", "", "-"), None).otherwise(F.trim(F.col(c)))
    bare = lambda c: F.regexp_replace(F.regexp_replace(blank(c), r"[$,]", ""), r"^\((.*)\)$", "-$1")
    number = lambda c: bare(c).try_cast("double")
    date = F.coalesce(F.try_to_timestamp(blank("fiscal_quarter_ending"), F.lit("M/d/yyyy")), F.try_to_timestamp(blank("fiscal_quarter_ending"), F.lit("MMM/yyyy"))).cast("date")
    told = F.coalesce(F.nullif(F.regexp_extract(blank("surprise"), r"\((-?[\d.]+)%\)", 1), F.lit("")), blank("surprise")).try_cast("double")
    rows = df.withColumns({"eps": number("eps"), "eps_forecast": number("eps_forecast"), "fiscal_quarter_ending": date, "surprise_percentage": told}).drop("surprise")
    wrong = F.signum(F.col("eps") - F.col("eps_forecast")) * F.signum("surprise_percentage") < 0
    return rows.withColumn("surprise_percentage", F.when(wrong, -F.col("surprise_percentage")).otherwise(F.col("surprise_percentage")))


def parse_earnings_html(pages: DataFrame) -> DataFrame:
    """page_id, html: cells of table rows inside day tabs, in batches of pages."""
    from html.parser import HTMLParser

    class Rows(HTMLParser):
        def __init__(self):
            super().__init__()
            self.day, self.rows, self.cell = None, [], None

        def handle_starttag(self, tag, attrs):
            day = dict(attrs).get("data-tab-pane")
            self.day = day or self.day
            if tag == "tr":
                self.rows.append((self.day, []))
            elif tag == "td" and self.rows:
                self.cell = []

        def handle_data(self, data):
            if self.cell is not None:
                self.cell.append(data)

        def handle_endtag(self, tag):
            if tag == "td" and self.cell is not None:
                self.rows[-1][1].append(" ".join("".join(self.cell).split()))
                self.cell = None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, html in zip(pdf["page_id"], pdf["html"]):
                p = Rows()
                p.feed(html or "")
                out += [(page, day, cells) for day, cells in p.rows if cells]
            yield pd.DataFrame(out, columns=["page_id", "day", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, day string, cells array<string>")


def parse_interest(df: DataFrame) -> DataFrame:
    """keyword, json: timeline points with start, end and value; a 0 that has data is 0.1; one row for each day."""
    t = "array<struct<time: bigint, end: bigint, value: array<double>, hasData: array<boolean>>>"
    p = df.select("keyword", F.explode(F.from_json("json", t)).alias("p"))
    value = F.when((F.col("p.value")[0] == 0) & F.col("p.hasData")[0], 0.1).otherwise(F.col("p.value")[0])
    day = lambda c: F.to_date(F.timestamp_seconds(c))
    return p.select("keyword", F.explode(F.sequence(day("p.time"), day(F.coalesce("p.end", "p.time")))).alias("date"), value.alias("relative_interest"))


def flatten_details(df: DataFrame, nested: str, drop: list[str]) -> DataFrame:
    """Ticker details without some keys, with a nested object's fields as columns, in snake case."""
    flat = df.select("*", f"{nested}.*").drop(nested, *drop)
    return flat.toDF(*[snake(c) for c in flat.columns])


def load_symbols(df: DataFrame, whitelist: list[str] | None = None) -> DataFrame:
    """exchange, symbol, name, asset_type of a list: `-` in a symbol is `.`, stocks and funds only."""
    rows = df.where(F.col("asset_type").isin("Stock", "ETF"))
    if whitelist is not None:
        rows = rows.where(F.col("exchange").isin(*whitelist))
    return rows.select("exchange", F.regexp_replace("symbol", "-", ".").alias("symbol"), "name", "asset_type")


def to_csv(df: DataFrame, path: str, exclude: tuple[str, ...] = ()) -> None:
    """Write df as CSV without some columns; commas in values are removed."""
    plain_text(df, exclude).write.csv(path, header=True)


def plain_text(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    kept = df.drop(*exclude)
    return kept.select(*[F.regexp_replace(F.col(c).cast("string"), ",", "").alias(c) for c in kept.columns])


def interest_by_region(df: DataFrame) -> DataFrame:
    """keyword, json: a list of regions with a value each."""
    t = "array<struct<geoCode: string, geoName: string, value: array<int>>>"
    p = df.select("keyword", F.explode(F.from_json("json", t)).alias("p"))
    return p.select("keyword", F.col("p.geoCode").alias("geo_code"), F.col("p.geoName").alias("geo_name"), F.get("p.value", F.lit(0)).alias("value"))


def related(df: DataFrame) -> DataFrame:
    """keyword, json: the top list and the rising list of related queries, with their rank."""
    t = "struct<top: array<struct<query: string, value: int>>, rising: array<struct<query: string, value: int>>>"
    j = df.select("keyword", F.from_json("json", t).alias("j"))
    each = [j.select("keyword", F.lit(k).alias("kind"), F.posexplode(f"j.{k}").alias("rank", "x")) for k in ("top", "rising")]
    return each[0].unionByName(each[1]).select("keyword", "kind", "rank", "x.query", "x.value")
