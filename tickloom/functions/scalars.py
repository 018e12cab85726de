"""Column helpers: names, dates, text and number clean-up."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKER = ["exchange", "symbol"]


def snake(name: str) -> str:
    """camelCase or PascalCase to snake_case."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def pascal(name: str) -> str:
    return "".join(x.capitalize() for x in name.split("_"))


def condense(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def csv_floats(c: Column) -> Column:
    """'1.5,2' as an array of doubles."""
    return F.transform(F.split(c, ","), lambda x: x.cast("double"))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def from_epoch(c: Column) -> Column:
    """Seconds, or milliseconds above 9999999999, as a timestamp."""
    return F.when(c > 9_999_999_999, F.timestamp_millis(c)).otherwise(F.timestamp_seconds(c))


def edgar_date(c: Column) -> Column:
    return F.to_date(c, "yyyyMMdd")


def us_date(c: Column) -> Column:
    return F.date_format(c, "MM/dd/yyyy")


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def one_hot(index: Column, size: int) -> Column:
    """Array of `size` numbers, 1.0 at index (0-based), 0.0 elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("double"))


def region(exchange: Column, canadian: tuple[str, ...] = ("TSX", "TSXV", "NEO", "CSE")) -> Column:
    """Market region of an exchange."""
    return F.when(exchange.isin(*canadian), "CANADA").otherwise("US")


def _fibonacci(upto: int) -> list[int]:
    a, b, out = 0, 1, []
    while a <= upto:
        out.append(a)
        a, b = b, a + b
    return sorted(set(out))


#: The Fibonacci numbers that a long holds: 91.
FIBONACCI = _fibonacci(2**63 - 1)


def is_fibonacci(n: Column) -> Column:
    """Whether a whole number is a Fibonacci number: n is named once, as what it is made of would be worked out for each naming."""
    return n.cast("long").isin(FIBONACCI)
