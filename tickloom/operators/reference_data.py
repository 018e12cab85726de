"""Reference data: upserts, consensus of sources, classification of securities, merges of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TICKER, first_filled, snake


def upsert(old: DataFrame, new: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """old with new rows: `ignore` keeps old rows, `replace` new ones, `update` fills old values where new ones are null."""
    if mode == "ignore":
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
    if mode == "replace":
        return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
    if mode != "update":
        raise ValueError(mode)
    rest = [c for c in old.columns if c not in keys]
    n = new.withColumnsRenamed({c: f"_new_{c}" for c in rest})
    return old.join(n, keys, "full").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in rest])


def align_schema(df: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of both, with the columns of both; a column that one lacks is null there."""
    return target.unionByName(df, allowMissingColumns=True)


#: Kinds of a landed value, the strongest first, with the type of a column that holds one and what old rows get there.
_KINDS = (("bool", "boolean", False), ("number", "double", None), ("text", "string", None))


def infer_columns(landed: DataFrame, json: str = "json") -> dict[str, tuple[str, list[str]]]:
    """Type of each column that landed JSON objects give, with the keys it comes from, by one aggregate over all rows.

    Keys become snake case. A column is boolean if any of its values is a boolean, else double if any is a number, else
    string; keys that are always null are string. A name that starts with a digit is an error. What reaches the driver is
    one row for each key.
    """
    each = landed.select(F.explode(F.from_json(F.col(json), "map<string,variant>")).alias("key", "value"))
    kind = F.schema_of_variant("value")
    seen = each.groupBy("key").agg(F.bool_or(kind == "BOOLEAN").alias("bool"), F.bool_or(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")).alias("number"))
    found: dict[str, tuple[set[str], list[str]]] = {}
    for r in seen.orderBy("key").collect():
        if not r["key"] or r["key"][0].isdigit():
            raise ValueError(f"not a name of a column: {r['key']!r}")
        kinds, keys = found.setdefault(snake(r["key"]), (set(), []))
        keys.append(r["key"])
        kinds |= {k for k in ("bool", "number") if r[k]} or {"text"}
    return {name: (next(t for k, t, _ in _KINDS if k in kinds), keys) for name, (kinds, keys) in found.items()}


def align_landed(target: DataFrame, landed: DataFrame, json: str = "json") -> DataFrame:
    """Rows of target and of landed JSON objects, with a typed column for every key that target lacks (infer_columns()).

    Columns that target has keep their type; values that do not fit it are null. Old rows get false in a new boolean column
    and null in others; a landed object without the key gets null. Rows whose JSON is no object have only nulls.
    """
    found = infer_columns(landed, json)
    had = {f.name: f.dataType.simpleString() for f in target.schema}
    value = F.try_parse_json(F.col(json))

    def one(key: str, kind: str) -> Column:
        at = F.try_variant_get(value, f"$['{key}']", kind)
        if kind != "boolean":
            return at
        return F.when(F.schema_of_variant(F.variant_get(value, f"$['{key}']", "variant")) == "BOOLEAN", at)  # "yes" is no boolean

    def read(name: str, kind: str, keys: list[str]) -> Column:
        return F.coalesce(*[one(k, kind) for k in keys]).alias(name)

    old = {t: d for _, t, d in _KINDS}
    new = {name: kind for name, (kind, _) in found.items() if name not in had}
    wide = target.select("*", *[F.lit(old[kind]).cast(kind).alias(name) for name, kind in new.items()])
    rows = landed.select(*[read(n, had[n], found[n][1]) if n in found else F.lit(None).cast(had[n]).alias(n) for n in had], *[read(n, kind, found[n][1]) for n, kind in new.items()])
    return wide.unionByName(rows)


def merge_nonmarket(daily: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(daily with pre- and after-market prices, rejected updates): an update whose prices or volume differ is refused;
    a missing pre- or after-market price is -1."""
    keys = [*TICKER, "period_date"]
    same = ["open", "high", "low", "close", "volume"]
    u = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*same, "pre_market", "after_hours")], F.lit(True).alias("_u"))
    joined = daily.drop("pre_market", "after_hours").join(u, keys, "left")
    fits = F.lit(True)
    for c in same:
        fits = fits & F.col(c).eqNullSafe(F.col(f"_{c}"))
    marked = joined.withColumn("_fits", F.coalesce(F.col("_u"), F.lit(False)) & fits)
    out = marked.select(*keys, *same, *[F.when(F.col("_fits"), F.coalesce(f"_{c}", F.lit(-1.0))).alias(c) for c in ("pre_market", "after_hours")])
    return out, marked.where("_u and not _fits").select(*keys, *[F.col(f"_{c}").alias(c) for c in same])


def changed_tickers(dump: DataFrame, computed: DataFrame) -> DataFrame:
    """Tickers with dump rows that are not computed yet."""
    keys = [*TICKER, "period_date"]
    return dump.select(*keys).join(computed.select(*keys), keys, "left_anti").select(*TICKER).distinct()


def export_bounds(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first and last row of each key."""
    up = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_u", up).withColumn("_d", down).where("_u = 1 or _d = 1").drop("_u", "_d")


def import_copy(old: DataFrame, src: DataFrame, keys: list[str], removed: DataFrame | None = None) -> DataFrame:
    out = upsert(old, src, keys, "ignore")
    return out.join(removed.select(*keys), keys, "left_anti") if removed is not None else out


def consensus(df: DataFrame, keys: list[str], candidates: list[str], valid: list[str] | None = None) -> DataFrame:
    """keys and `value`, where all filled (and valid) candidates agree."""
    given = F.filter(F.array(*[F.nullif(F.col(c), F.lit("")) for c in candidates]), lambda x: x.isNotNull())
    if valid is not None:
        given = F.filter(given, lambda x: x.isin(*valid))
    return df.withColumn("_v", F.array_distinct(given)).where(F.size("_v") == 1).select(*keys, F.col("_v")[0].alias("value"))


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def founded_in(text: Column) -> Column:
    """A founding date told in a text, as yyyy-MM-dd, yyyy-MM or yyyy; null without one."""
    lead = r"(?:founded|incorporated|established)[^.]{0,40}?"
    full, month, year = rf"{lead}((?:{MONTHS}) \d{{1,2}}, \d{{4}})", rf"{lead}((?:{MONTHS}) \d{{4}})", rf"{lead}\b(\d{{4}})\b"
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(F.date_format(F.to_date(found(full), "MMMM d, yyyy"), "yyyy-MM-dd"), F.date_format(F.to_date(F.concat(F.lit("1 "), found(month)), "d MMMM yyyy"), "yyyy-MM"), found(year))


def consensus_founded(df: DataFrame, keys: list[str], descriptions: list[str]) -> DataFrame:
    told = df.withColumns({f"_f{i}": founded_in(F.col(c)) for i, c in enumerate(descriptions)})
    return consensus(told, keys, [f"_f{i}" for i in range(len(descriptions))])


def consensus_ipo(df: DataFrame, bars: DataFrame, candidates: list[str]) -> DataFrame:
    """Ticker and ipo: the candidates' one date, or of several the one nearest to the ticker's first bar."""
    first = bars.groupBy(*TICKER).agg(F.min("period_date").alias("_first"))
    rows = df.join(first, TICKER, "left").withColumn("_c", F.explode(F.array_distinct(F.filter(F.array(*candidates), lambda x: x.isNotNull()))))
    w = F.struct(F.coalesce(F.abs(F.datediff("_c", "_first")), F.lit(0)), F.col("_c"))
    return rows.groupBy(*TICKER).agg(F.min_by("_c", w).alias("ipo"), F.count("*").alias("candidates"))


#: Ends of names and symbols by which a security's kind is told, in order (fixed values).
NAME_KINDS = (("warrant", "WARRANT"), ("right", "RIGHTS"), ("unit", "UNIT"), ("preferred", "PREFERRED"), ("etf", "ETF"), ("etn", "ETN"), ("fund", "FUND"), ("trust", "TRUST"))
SYMBOL_KINDS = (("W", "WARRANT"), ("R", "RIGHTS"), ("U", "UNIT"), ("P", "PREFERRED"))


def classify_asset(df: DataFrame) -> DataFrame:
    """df with asset_kind, from words of the name, then the fifth letter of a NASDAQ symbol, else CS."""
    name = F.concat(F.lit(" "), F.lower("name"), F.lit(" "))
    kind = F.when(F.lit(False), "")
    for word, k in NAME_KINDS:
        kind = kind.when(name.rlike(rf"\b{word}s?\b"), k)
    for letter, k in SYMBOL_KINDS:
        kind = kind.when((F.col("exchange") == "NASDAQ") & (F.length("symbol") == 5) & F.col("symbol").endswith(letter), k)
    return df.withColumn("asset_kind", kind.otherwise("CS"))


def group_share_classes(symbols: DataFrame) -> DataFrame:
    """Symbols with the shortest symbol of their exchange that they contain and whose name begins with the same word."""
    word = F.lower(F.get(F.split("name", " "), F.lit(0)))
    s = symbols.select("exchange", "symbol", word.alias("_w"))
    base = s.select("exchange", "_w", F.col("symbol").alias("base"))
    pairs = s.join(base, ["exchange", "_w"]).where((F.length("base") < F.length("symbol")) & F.contains("symbol", "base"))
    return pairs.groupBy("exchange", "symbol").agg(F.min_by("base", F.struct(F.length("base"), "base")).alias("base"))


def merge_dot_to(symbols: DataFrame) -> DataFrame:
    """One row for X and X.TO: the longer name, the first filled sector, and the flag of both if equal, else the one that isn't 0."""
    base = symbols.where("not endswith(symbol, '.TO')")
    other = symbols.where("endswith(symbol, '.TO')").select("exchange", F.expr("substring(symbol, 1, length(symbol) - 3)").alias("symbol"), F.col("name").alias("_n"), F.col("sector").alias("_s"), F.col("api").alias("_a"))
    j = base.join(other, ["exchange", "symbol"], "full")
    name = F.when(F.coalesce(F.length("_n"), F.lit(0)) > F.coalesce(F.length("name"), F.lit(0)), F.col("_n")).otherwise(F.col("name"))
    a, b = F.col("api"), F.col("_a")
    flag = F.when(a.isNull(), b).when(b.isNull() | (a == b), a).when(a == 0, b).when(b == 0, a).otherwise(0)
    return j.select("exchange", "symbol", name.alias("name"), first_filled(F.col("sector"), F.col("_s")).alias("sector"), flag.alias("api"))


def resolve_exchange(symbols: DataFrame, info: DataFrame, ratio: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """(symbols with their exchange, rejected): candidates by symbol; the source's own exchange first, then an equal or
    near-equal name. Nearness is 1 - Levenshtein distance over the longer length. Two candidates alike are rejected."""
    c = info.select("symbol", F.col("exchange").alias("_x"), F.lower("name").alias("_n"))
    near = 1 - F.levenshtein(F.lower("name"), "_n") / F.greatest(F.length("name"), F.length("_n"), F.lit(1))
    score = F.when(F.col("_x") == F.col("source_exchange"), 2.0).when(near >= ratio, near).otherwise(0.0)
    scored = symbols.join(c, "symbol", "left").withColumn("_score", F.coalesce(score, F.lit(0.0)))
    best = scored.groupBy("symbol", "name", "source_exchange").agg(F.max("_score").alias("_s"), F.max_by("_x", "_score").alias("exchange"))
    ties = scored.join(best.select("symbol", "_s"), "symbol").where("_score = _s").groupBy("symbol").agg(F.count_distinct("_x").alias("_k"))
    judged = best.join(ties, "symbol", "left")
    ok = (F.col("_s") > 0) & (F.col("_k") == 1)
    return judged.where(ok).select("symbol", "name", "exchange"), judged.where(~ok | ok.isNull()).select("symbol", "name")


#: Exchanges whose tickers can stand for a symbol, and symbols that are settled by hand (fixed values).
US_EXCHANGES = ("NASDAQ", "NYSE", "NYSE MKT", "NYSE ARCA", "BATS", "OTCBB")
MANUAL = {"XM": "NASDAQ"}
#: Symbols that several exchanges list, the primary one first (fixed values).
PRIMARY = {"ALO": ["NYSE", "NYSE MKT"], "FTNW": ["NYSE", "NYSE MKT"], "SDI": ["NYSE", "NYSE MKT"], "RZB": ["NYSE", "NASDAQ"]}
#: Of several namesakes, those on these exchanges do not count.
SECONDARY = ("OTCBB",)


def _named_alike(name: Column, other: Column, ratio: float) -> Column:
    """Equal or nearly so, as a whole or with the longer name's start: 1 - Levenshtein distance over the longer length."""
    a, b = F.lower(name), F.lower(other)
    near = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)) >= ratio
    head = F.substring(b, F.lit(1), F.greatest(F.floor(F.length(b) / 2).cast("int"), F.length(a)))
    return F.coalesce((a != "") & (near(a, b) | near(a, head)), F.lit(False))


def resolve_listing(symbols: DataFrame, tickers: DataFrame, listed: DataFrame | None = None, aliases: DataFrame | None = None, manual: dict[str, str] | None = None, primary: dict[str, list[str]] | None = None, exchanges: tuple[str, ...] = US_EXCHANGES, ratio: float = 0.999) -> DataFrame:
    """symbol, name, exchange and step of each of symbols (symbol, name, quoted): where it is traded, and what told so.

    The first step that has an answer decides:
    source: the exchange that the source itself lists (listed: symbol, exchange, active, delisted), the active and latest
    delisted first, if it has a standard name (aliases: alias, standard); manual: a table of symbols settled by hand;
    primary: the first exchange of a symbol that several list. Then the quoted exchange (by its standard name, if it has
    one) is held against the tickers (exchange, symbol, name) of that symbol on the given exchanges: on those of the quoted
    exchange, and on those of nearly the same name.
    quoted: no ticker, or none that fits either way: the quoted exchange as it is, which may be null; both: one ticker of
    the quoted exchange, and no more than one of its namesakes there; exchange: one ticker of it, no namesake; name: one
    namesake alone, also against several tickers of the quoted exchange. All else is step rejected, without exchange: two
    namesakes or tickers alike, or one ticker of the quoted exchange and one namesake elsewhere. Of several namesakes those
    on SECONDARY exchanges do not count.

    symbols has one row a symbol; its tickers are a few rows, as many as exchanges.
    """
    spark = symbols.sparkSession
    names = aliases.select(F.col("alias").alias("_a"), F.col("standard").alias("_standard")) if aliases is not None else spark.createDataFrame([], "_a string, _standard string")
    rows = symbols.select("symbol", "name", "quoted")
    if listed is not None:
        rank = F.struct(F.col("active").cast("int").alias("active"), F.col("delisted").alias("delisted"), F.col("_standard").alias("exchange"))
        first = listed.join(F.broadcast(names), F.col("exchange") == F.col("_a")).groupBy("symbol").agg(F.max(rank)["exchange"].alias("_source"))
        rows = rows.join(first, "symbol", "left")
    else:
        rows = rows.withColumn("_source", F.lit(None).cast("string"))
    hand = [(s, x, None) for s, x in (MANUAL if manual is None else manual).items()] + [(s, None, x[0]) for s, x in (PRIMARY if primary is None else primary).items()]
    settled = spark.createDataFrame(hand, "symbol string, m string, p string").groupBy("symbol").agg(F.max("m").alias("_manual"), F.max("p").alias("_primary"))
    rows = rows.join(F.broadcast(settled), "symbol", "left").join(F.broadcast(names), F.col("quoted") == F.col("_a"), "left")
    rows = rows.withColumn("_quoted", F.coalesce("_standard", "quoted")).drop("_a", "_standard")
    known = tickers.where(F.col("exchange").isin(*exchanges)).select("symbol", F.col("exchange").alias("_x"), F.col("name").alias("_n"))
    met = rows.join(known, "symbol", "left").withColumns({"_same": F.col("_x").eqNullSafe(F.col("_quoted")) & F.col("_x").isNotNull(), "_like": _named_alike(F.col("name"), F.col("_n"), ratio)})
    first_rate = ~F.col("_x").isin(*SECONDARY)
    same, any_like = F.col("_same"), F.col("_like")
    alike = any_like & first_rate
    told = lambda c: [F.count_if(c).alias("like"), F.count_if(same & c).alias("both"), F.max(F.when(c, F.col("_x"))).alias("namesake")]
    counted = met.groupBy("symbol", "name", "quoted", "_source", "_manual", "_primary", "_quoted").agg(F.count_if(same).alias("same"), F.struct(*told(any_like)).alias("_all"), F.struct(*told(alike)).alias("_some"))
    counted = counted.withColumn("_of", F.when(F.col("_all.like") > 1, F.col("_some")).otherwise(F.col("_all")))
    same, like, both = F.col("same"), F.col("_of.like"), F.col("_of.both")
    step = (
        F.when(F.col("_source").isNotNull(), "source").when(F.col("_manual").isNotNull(), "manual").when(F.col("_primary").isNotNull(), "primary")
        .when((same == 0) & (like == 0), "quoted").when((same == 0) & (like == 1), "name")
        .when((same == 1) & (like == 0), "exchange").when((same == 1) & (like == 1) & (both == 1), "both").when((same == 1) & (like > 1) & (both < 2), "both")
        .when((same > 1) & (like == 1) & (both == 0), "name").otherwise("rejected")
    )
    found = F.when(F.col("step") == "rejected", F.lit(None)).when(F.col("step") == "name", F.col("_of.namesake")).otherwise(F.coalesce("_source", "_manual", "_primary", "_quoted"))
    return counted.withColumn("step", step).select("symbol", "name", found.alias("exchange"), "step")


def sector_counts(staging: DataFrame, sources: list[str]) -> DataFrame:
    """Sector values with their count in each source, side by side."""
    long = staging.select(F.stack(F.lit(len(sources)), *[x for s in sources for x in (F.lit(s), F.col(s))]).alias("source", "sector"))
    return long.where("sector is not null").groupBy("sector").pivot("source", sources).count().na.fill(0)


def source_overlap(a: DataFrame, b: DataFrame, key: str = "symbol") -> DataFrame:
    """How many keys only a has, only b has, and both have."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"))
