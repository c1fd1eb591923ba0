"""Running sums over groups of any size: a range sort in place of a window with one task per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.joins import checked
from skein.session import ensure_checkpoint_dir


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with out, the sum of value (a whole number, null counts as 0) over the rows of the same group before the row
    in order, nulls first. The rows are range-sorted by (group, order), so a group lies in as many tasks as it needs;
    a task adds up its own rows, and the sums of the tasks before it are joined, one row per task and group. Rows that
    are equal in group and order come in any order. A null group is a group; an empty table stays empty."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order]
    ordered = df.withColumn("__n", F.coalesce(F.col(value).cast("bigint"), F.lit(0))).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id())
    at, size = ordered.columns.index(group), ordered.columns.index("__n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(at).dictionary_encode(null_encoding="encode")
            own, n = names.indices.to_numpy(), batch.column(size).to_numpy()
            before = np.cumsum(n) - n
            first = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
            before = before - np.repeat(before[first[:-1]], np.diff(first))
            if last is not None and names.dictionary[int(own[0])] == last:
                before[: first[1]] += done
            last, done = names.dictionary[int(own[-1])], int(before[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=[*batch.schema.names, "__sofar"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    summed = ordered.mapInArrow(run, f"{fields}, __sofar bigint").checkpoint()
    parts = summed.groupBy(F.col(group).alias("__group"), "__part").agg(F.sum("__n").alias("__sum"))
    w = Window.partitionBy("__group").orderBy("__part")  # a row per task that a group lies in
    parts = parts.select("__group", F.col("__part").alias("__of"), (F.sum("__sum").over(w) - F.col("__sum")).alias("__base"))
    both = summed.join(checked(parts), (F.col("__part") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    return both.select(*[f"`{c}`" for c in df.columns], (F.col("__base") + F.col("__sofar")).alias(out))
