"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.operators.versions import in_force
from skein.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def live(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return in_force(table(spark, sf_dir, name), list(columns))


def live_sql(name: str) -> str:
    """The rows in force of a table, as SQL."""
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edit_time DESC NULLS LAST) AS rn_ FROM {name}) WHERE rn_ = 1 AND coalesce(status, 1) <> 0)"
