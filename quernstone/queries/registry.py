"""Where queries and their SQL are gathered by inventory id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class _Columns:
    """``col.close`` is the column close, made when asked for: modules must load without a session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


col = _Columns()


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function below as query ``name``."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def rounded(columns: dict[str, Column], places: int = 6) -> list[Column]:
    """Doubles rounded, as sums in another order differ in their last digits. Minus zero becomes zero."""
    return [(F.round(c, places) + F.lit(0.0)).alias(n) for n, c in columns.items()]


def sql_rounded(columns: dict[str, str], places: int = 6) -> str:
    return ", ".join(f"(round(({c})::DOUBLE, {places}) + 0.0) AS {n}" for n, c in columns.items())
