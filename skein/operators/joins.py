"""Joins that Spark leaves to the caller: by a checked key set, as-of, by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are broadcast at most (8 to 16 bytes each); larger sets are joined by shuffle.
BROADCAST_KEYS = 500_000


_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """The frame, persisted until release()."""
    _kept.append(df.persist())
    return _kept[-1]


def release() -> None:
    """Gives back what earlier queries have persisted; a query that still needs it computes it again."""
    while _kept:
        df = _kept.pop()
        try:
            df.unpersist()
        except Exception:  # its session has ended
            continue


def checked(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """The frame, kept, and marked for broadcast if it is counted to have at most so many (narrow) rows."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= most else df


def _semi(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    keys = kept(keys.select(on))
    if keys.count() <= BROADCAST_KEYS:
        return df.join(F.broadcast(keys), on, how)
    return df.join(keys.hint("shuffle_hash"), on, how)


def with_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in keys; the key set is counted and broadcast if it is small."""
    return _semi(df, keys, on, "left_semi")


def without_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key isn't in keys; the key set is counted and broadcast if it is small."""
    return _semi(df, keys, on, "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str) -> DataFrame:
    """Each left row with the value of the latest right row of its key at or before its time; both inputs go through
    one sort by (key, time) and no row meets another."""
    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__side", F.lit(1))
    other = right.select(*[F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(value).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(other).withColumn(out, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__v", "__side")


def in_range(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= point < high. Intervals are cut into bins of the given width, so the join is an equi-join."""
    bins = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high)) / width))).alias("__bin")
    return left.withColumn("__bin", F.floor(F.col(point) / width)).join(right.where(F.col(high) > F.col(low)).select("*", bins), "__bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bin")
