"""Where queries register, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postledger.plans.binding import NOW, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TS = f"TIMESTAMP '{NOW}'"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def query(sql: str | None = None, tables: str = ""):
    """Register a query by its function's name, with the DuckDB SQL that answers it over the same views and further tables (common table expressions)."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, tables)
        return f

    return register


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def re2(pattern: str) -> str:
    """A pattern of ours as DuckDB's engine reads it (no look-around; its word ends are ASCII), quoted for SQL."""
    for java, other in (("(?iu)", "(?i)"), ("(?<![A-Za-z0-9_])", r"\b"), ("(?![A-Za-z0-9_])", r"\b")):
        pattern = pattern.replace(java, other)
    return "'" + pattern.replace("'", "''") + "'"
