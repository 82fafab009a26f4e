"""Where the runnable queries and their check SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded, and never negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def R(expr: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"(round({expr}, {digits}) + 0.0)"
