"""The registry that the topic modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, also: str | None = None):
    """Register a query under ``name``, and the SQL that gives the same rows; ``also`` is an older name of it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        for n in (name, also) if also else (name,):
            QUERIES[n] = f
            if sql is not None:
                ORACLE_SQL[n] = sql
        return f

    return add
