"""Predicates from keyword arguments, projections and the relational basics."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TICKER


class Null:
    """IS NULL, or IS NOT NULL with Null(False)."""

    def __init__(self, null: bool = True):
        self.null = null

    def on(self, c: Column) -> Column:
        return c.isNull() if self.null else c.isNotNull()


class Compare:
    """column <op> value, with op one of < <= = != >= >."""

    OPS = {"<": operator.lt, "<=": operator.le, "=": operator.eq, "!=": operator.ne, ">=": operator.ge, ">": operator.gt}

    def __init__(self, op: str, value):
        self.op, self.value = op, value

    def on(self, c: Column) -> Column:
        return self.OPS[self.op](c, self.value)


class Like:
    def __init__(self, pattern: str):
        self.pattern = pattern

    def on(self, c: Column) -> Column:
        return c.like(self.pattern)


class Between:
    def __init__(self, low, high, inclusive: bool = True):
        self.low, self.high, self.inclusive = low, high, inclusive

    def on(self, c: Column) -> Column:
        return c.between(self.low, self.high) if self.inclusive else (c > self.low) & (c < self.high)


class Within:
    """Value plus or minus a tolerance."""

    def __init__(self, value, tolerance):
        self.value, self.tolerance = value, tolerance

    def on(self, c: Column) -> Column:
        return F.abs(c - self.value) <= self.tolerance


def condition(**predicates) -> Column | None:
    """The conjunction of keyword predicates; None is skipped, lists are IN, plain values are equality."""
    parts = []
    for name, p in predicates.items():
        c = F.col(name)
        if p is None:
            continue
        if hasattr(p, "on"):
            parts.append(p.on(c))
        elif isinstance(p, (list, tuple, set)):
            parts.append(c.isin(*p))
        else:
            parts.append(c == p)
    return reduce(operator.and_, parts) if parts else None


def select_where(df: DataFrame, cols: list[str] | None = None, distinct: bool = False, group_by: list[str] | None = None, aggregates: dict[str, Column] | None = None, order_by: list | None = None, limit: int | None = None, **predicates) -> DataFrame:
    """Filter, group or project, order and limit; filters and columns reach the scan."""
    where = condition(**predicates)
    if where is not None:
        df = df.where(where)
    if group_by is not None:
        df = df.groupBy(*group_by).agg(*[c.alias(k) for k, c in (aggregates or {"count": F.count("*")}).items()])
    elif cols:
        df = df.select(*cols)
    if distinct:
        df = df.distinct()
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(limit) if limit is not None else df


def delete_where(df: DataFrame, **predicates) -> DataFrame:
    """df without the rows that meet all predicates; rows for which they are unknown stay."""
    where = condition(**predicates)
    return df.where(~F.coalesce(where, F.lit(False))) if where is not None else df.limit(0)


def exclude(df: DataFrame, tickers: DataFrame) -> DataFrame:
    return df.join(tickers.select(*TICKER).distinct(), TICKER, "left_anti")


def bucket_by(cases: list[Column], names: list[str], rest: str) -> Column:
    """The name of the first case that holds."""
    out = F.when(cases[0], names[0])
    for c, n in zip(cases[1:], names[1:]):
        out = out.when(c, n)
    return out.otherwise(rest)


def standard_exchange(df: DataFrame, aliases: DataFrame, col: str = "exchange") -> DataFrame:
    """df with exchange aliases (alias, standard) replaced; aliases is a table of some hundred rows."""
    side = F.broadcast(aliases.select(F.col("alias").alias("_a"), F.col("standard").alias("_s")))
    return df.join(side, F.col(col) == F.col("_a"), "left").withColumn(col, F.coalesce("_s", col)).drop("_a", "_s")


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs).distinct()


def sample_tickers(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k tickers in an order that looks random but is the same on every run."""
    return df.select(*TICKER).distinct().orderBy(F.xxhash64(*TICKER, F.lit(seed)), *TICKER).limit(k)
