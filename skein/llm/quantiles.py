"""Percentiles with a bound on the relative error, from counts in signed logarithmic buckets that can be added up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of a percentile's value.
ERROR = 0.01


def gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(c: Column, error: float = ERROR) -> Column:
    """Signed number of the bucket of a value: bucket i > 0 holds gamma**(i-1) < x <= gamma**i over OFFSET, mirrored for
    negative values; 0 holds 0. Null, NaN and infinite values have none. Every other value of a double, however small, has
    its bucket."""
    x = c.cast("double")
    i = F.ceil(F.log(F.abs(x)) / F.lit(math.log(gamma(error)))) + F.lit(offset(error))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("int") * i).cast("int")


def offset(error: float) -> int:
    """Makes the bucket of the smallest magnitude 1."""
    return math.ceil(1075 * math.log(2) / math.log(gamma(error))) + 1


def value(b: Column, error: float = ERROR) -> Column:
    """The value a bucket stands for: off by at most the relative error from anything in it."""
    g = gamma(error)
    x = F.pow(F.lit(g), (F.abs(b) - F.lit(offset(error))).cast("double")) * F.lit(2 / (1 + g))
    return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b.cast("double")) * x)


def sketch(df: DataFrame, groups: list[str], column: str, error: float = ERROR) -> DataFrame:
    """(groups, bucket, n): a sketch per group. Counting combines map-side, so a hot group shuffles one row per task
    and bucket; a group has a few thousand buckets at most, whatever its size. Null, NaN and infinite values aren't counted; a
    null group is a group; an empty table gives an empty sketch."""
    return df.select(*groups, bucket(F.col(column), error).alias("bucket")).where("bucket is not null").groupBy(*groups, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Adds up sketches of days, partitions or runs (of the same error) for coarser groups."""
    return sketches.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: list[str], points: list[float], error: float = ERROR) -> DataFrame:
    """(groups, point, rank, n, value): the value whose rank is ceil(point * n), at least 1, within the relative
    error. The windows run over buckets, not values."""
    w = Window.partitionBy(*groups)
    up = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = sketches.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(w))
    each = run.select("*", F.explode(F.array(*map(F.lit, points))).alias("point"))
    each = each.withColumn("rank", F.greatest(F.ceil(F.round(F.col("point") * F.col("total"), 6)), F.lit(1)))
    hit = each.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return hit.select(*groups, "point", "rank", F.col("total").alias("n"), value(F.col("bucket"), error).alias("value"))
