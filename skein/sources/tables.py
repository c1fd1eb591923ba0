"""Readers for the test tables: one parquet file or directory per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as stored; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Casts a zone-less timestamp so that it can carry a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Writes a table so that a reader sees the old or the new one whole: into a folder beside it, then renamed. Files
    are as many as the frame has partitions."""
    spark = df.sparkSession
    target, fresh, old = f"{folder}/{name}.parquet", f"{folder}/.{name}.next", f"{folder}/.{name}.before"
    df.write.mode("overwrite").parquet(fresh)
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path(old), True)
    if files.exists(path(target)) and not files.rename(path(target), path(old)):
        raise OSError(f"cannot move {target}")
    if not files.rename(path(fresh), path(target)):
        raise OSError(f"cannot move {fresh}")
    files.delete(path(old), True)


def upsert_table(spark: SparkSession, folder: str, name: str, new: DataFrame, key: str) -> None:
    """Writes the table again with the rows of new in the place of those with the same key, or beside them."""
    from skein.operators.versions import upsert

    old = table(spark, folder, name)
    write_table(upsert(old, new.select(*old.columns), key).drop("origin").select(*old.columns), folder, name)
