"""Registered queries: a Spark callable plus, where SQL can say it, the SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison; the nudge keeps exact decimal ties on one side in both engines."""
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value.cast("double") + 1e-9, digits)


def sql6(expression: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE) + 1e-9, {digits})"
