"""Registry of runnable queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lobspark.plans.tables import Tables

BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in BUILDERS:
            raise ValueError(f"query {name!r} registered twice")
        BUILDERS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _runner(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: fn(Tables(spark, path))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _runner(f) for n, f in BUILDERS.items()}


def all_sql() -> dict[str, str]:
    return dict(SQL)
