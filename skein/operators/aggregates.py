"""Aggregations that stay distributed: exact percentiles from value counts, latest rows, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(df: DataFrame, groups: list[str], column: str, points: dict[str, float]) -> DataFrame:
    """(groups, one column per point, n): linear interpolation between the two values around rank p (n - 1). Values
    are counted first (map-side combined), so a group costs its distinct values, not its rows. Nulls don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy(*groups)
    run = counts.withColumn("__upto", F.sum("__k").over(w.orderBy("__v"))).withColumn("__n", F.sum("__k").over(w))

    def at(rank):  # the value that covers a rank counted from 0
        return F.min(F.when(F.col("__upto") > rank, F.col("__v")))

    out = []
    for name, p in points.items():
        place = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return run.groupBy(*groups).agg(*out, F.max("__n").alias("n"))


def latest(df: DataFrame, groups: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group in the given order; the planner cuts groups to n rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of the ordered rows, numbered from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
