"""All queries of the engine by name, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.plans import console, more, observability, relational, search  # noqa: F401
from skein.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_top5"](spark, sf_dir)
