"""Rows in force: of all deliveries of a key the latest version, unless it is deleted."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.joins import kept

#: Keys with several deliveries that are sent to every task; above it the rows are shuffled by key instead.
BROADCAST_KEYS = 300_000


def in_force(df: DataFrame, columns: list[str], key: str = "id", version: str = "edit_time", status: str | None = "status") -> DataFrame:
    """One row per key: the one with the latest version; of equal versions the one that arrived last (exact copies
    are such rows, so they count once). A null version is older than any other; rows with a null key are dropped.
    If status names a column, keys whose row in force has status 0 drop out; a null status is live.

    For a frame read from files only the key columns are shuffled: a row's place in its file identifies it, and the
    few keys delivered more than once are broadcast if there are at most BROADCAST_KEYS of them. Otherwise, and for
    frames without file places, the wide rows are shuffled by key, which spreads evenly because deliveries of one
    key are few.
    """
    extra = [] if status is None else [status]
    wanted = list(dict.fromkeys([key, *columns]))
    alive = F.lit(True) if status is None else F.coalesce(F.col(status), F.lit(1)) != 0
    df = df.where(F.col(key).isNotNull())
    try:
        # files arrive by time, those of one write by their number
        part = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int"), F.lit(0))
        file = F.struct(F.unix_micros("_metadata.file_modification_time").alias("t"), part.alias("p"), F.xxhash64("_metadata.file_path").alias("h"))
        placed = df.select(*dict.fromkeys([*wanted, version, *extra]), file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # no file source
        placed = None
    if placed is not None:
        narrow = placed.select(key, version, *extra, "__file", "__row").groupBy(key)
        chosen = F.max(F.struct(F.col(version), F.col("__file"), F.col("__row"), *extra)).alias("__last")
        several = narrow.agg(F.count(F.lit(1)).alias("__n"), chosen).where("__n > 1").select(key, "__last")
        several = kept(several)
        if several.count() <= BROADCAST_KEYS:
            last = several.select(key, F.col("__last.__file").alias("__lf"), F.col("__last.__row").alias("__lr"))
            joined = placed.join(F.broadcast(last), key, "left")
            mine = F.col("__lf").isNull() | ((F.col("__lf") == F.col("__file")) & (F.col("__lr") == F.col("__row")))
            return joined.where(mine & alive).select(*wanted)
        order = [F.col(version).desc_nulls_last(), F.col("__file").desc(), F.col("__row").desc()]
        df = placed
    else:
        order = [F.col(version).desc_nulls_last(), F.xxhash64(*df.columns).desc()]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").where(alive).select(*wanted)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in the place of those with the same key, or beside them: (key, origin, other columns).
    origin is 'kept', 'replaced' or 'inserted'. Both have the same columns and each key once; null keys drop out. One
    shuffle by key, combined map-side; on files it is written as a new version of the table."""
    columns = [c for c in old.columns if c != key]
    both = old.select(key, *columns, F.lit(0).alias("__new")).unionByName(new.select(key, *columns, F.lit(1).alias("__new"))).where(F.col(key).isNotNull())
    by = both.groupBy(key).agg(F.max_by(F.struct(*columns), "__new").alias("__row"), F.min("__new").alias("__least"), F.max("__new").alias("__most"))
    origin = F.when(F.col("__least") == 1, "inserted").when(F.col("__most") == 1, "replaced").otherwise("kept")
    return by.select(key, origin.alias("origin"), "__row.*")
