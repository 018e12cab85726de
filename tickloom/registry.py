"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def _plain_rounding(sql: str) -> str:
    """round(x, 4) as floor(x * 10000 + 0.5) / 10000, which Spark and SQL compute alike."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        if at and (sql[at - 1].isalnum() or sql[at - 1] == "_"):
            at += 6
            continue
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6 : end - 1]
        if inner.endswith(", 4"):
            sql = f"{sql[:at]}(floor(({inner[:-3]}) * 10000 + 0.5) / 10000){sql[end:]}"
        else:
            at += 6
    return sql


def register(name: str, sql: str | None = None):
    """Decorator: adds a query under `name`, with the SQL that DuckDB checks it by."""

    def add(f: Query) -> Query:
        _found[name] = (f, sql and _plain_rounding(sql))
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items() if s}


def load() -> None:
    """Import the modules that register queries."""
    from .plans import calendar, company, indicators, labels, more, quality, reference_data, relational, scoring, vectors  # noqa: F401


load()
