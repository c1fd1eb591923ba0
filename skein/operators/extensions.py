"""Places where a deployment adds its own parts: models, retrieval channels, chunk and memory strategies, tools.

Models need a network and are given as pandas UDFs; the ones here are deterministic stand-ins so that pipelines run and
are tested without one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("chat model", "embedding model", "rerank model", "channel", "chunk strategy", "memory strategy", "tool")
_parts: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str):
    """Adds a part under its kind and name; a later one replaces an earlier one."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")

    def add(f: Callable) -> Callable:
        _parts[kind, name] = f
        return f

    return add


def part(kind: str, name: str) -> Callable:
    try:
        return _parts[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} named {name}; there are {sorted(n for k, n in _parts if k == kind)}") from None


@register("chat model", "echo")
def echo_model(prompt: Column) -> Column:
    """Answers with the first 80 characters of the prompt."""

    @F.pandas_udf(T.StringType())
    def answer(s: pd.Series) -> pd.Series:
        return "echo: " + s.str[:80]

    return answer(prompt)


@register("embedding model", "hashed")
def hashed_embedding(text: Column, width: int = 64) -> Column:
    """Unit vectors of hashed words; null for texts without words. Words are cut and hashed in the JVM, a batch is one
    count."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(s: pd.Series) -> pd.Series:
        sizes = np.array([0 if x is None else len(x) for x in s], np.int64)
        v = np.zeros((len(s), width))
        if sizes.sum():
            np.add.at(v, (np.repeat(np.arange(len(s)), sizes), np.concatenate([x for x in s if x is not None and len(x)])), 1)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return pd.Series([row if n else None for row, n in zip(v.astype(np.float32), sizes)])

    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return embed(F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int")))


@register("rerank model", "overlap")
def overlap_rerank(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has."""
    bag = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(bag(query), bag(text))).cast("double"), F.size(bag(query))), F.lit(0.0))


@register("chunk strategy", "recursive")
def recursive(df: DataFrame, key: str, text: str) -> DataFrame:
    from skein.operators.retrieval import window_chunks

    return window_chunks(df, key, text)


@register("chunk strategy", "semantic")
def semantic(df: DataFrame, key: str, text: str) -> DataFrame:
    from skein.operators.retrieval import semantic_chunks

    return semantic_chunks(df, key, text)


@register("chunk strategy", "structure")
def structure(df: DataFrame, key: str, text: str) -> DataFrame:
    """A chunk per heading with the lines below it."""
    lines = df.where(F.length(text) > 0).select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    part_no = F.sum(F.when(F.col("line").rlike(r"^#{1,6}\s"), 1).otherwise(0)).over(w)
    grouped = lines.withColumn("chunk_no", part_no).groupBy(key, "chunk_no").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return grouped.select(key, F.col("chunk_no").cast("int").alias("chunk_no"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("chunk_text")).where(F.trim("chunk_text") != "")


@register("chunk strategy", "model")
def by_model(df: DataFrame, key: str, text: str, most: int = 3500) -> DataFrame:
    """Pieces of at most 3500 characters for a model that answers with a JSON array of chunks; the stand-in splits at
    blank lines."""
    calls = df.where(F.length(text) > 0).select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / most)), lambda i: F.substring(F.col(text), i * most + 1, F.lit(most)))).alias("call_no", "t"))
    return calls.select(key, "call_no", F.posexplode(F.split("t", r"\n\s*\n")).alias("part_no", "chunk_text")).where(F.trim("chunk_text") != "")


def pipeline(df: DataFrame, key: str, text: str, strategies: list[str]) -> DataFrame:
    """Chunk strategies one after the other: each cuts the chunks of the one before."""
    out = df.select(F.col(key).cast("string").alias("path"), F.col(text).alias("t"))
    for name in strategies:
        cut = part("chunk strategy", name)(out, "path", "t")
        numbers = [c for c in cut.columns if c not in ("path", "chunk_text")]
        out = cut.select(F.concat_ws("/", "path", *[F.col(c).cast("string") for c in numbers]).alias("path"), F.col("chunk_text").alias("t"))
    return out.withColumnRenamed("t", "chunk_text")


@register("tool", "keyed lookup")
def keyed_lookup(df: DataFrame, key: str, rows: DataFrame, default: dict[str, object]) -> DataFrame:
    """Rows found by a key without case and outer spaces, else the default. rows has (key, ...) in lower case; it is
    broadcast only if it is counted to be small."""
    from skein.operators.joins import checked

    found = df.withColumn("__k", F.coalesce(F.lower(F.trim(key)), F.lit(""))).join(checked(rows.withColumnRenamed(rows.columns[0], "__k")), "__k", "left").drop("__k")
    return found.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in default.items()})


@register("tool", "session context")
def session_context(messages: Column, focus: Column) -> Column:
    """Thread summary for an agent: how many messages there are, and the trimmed focus."""
    return F.concat(F.lit("messages="), F.size(messages).cast("string"), F.lit(", focus="), F.coalesce(F.trim(focus), F.lit("")))


@register("channel", "keyword")
def keyword_channel(queries: DataFrame, query_key: str, query: str, texts: DataFrame, key: str, text: str, n: int) -> DataFrame:
    from skein.operators.retrieval import bm25_top

    return bm25_top(queries, query_key, query, texts, key, text, n)


@register("channel", "overlap")
def overlap_channel(queries: DataFrame, query_key: str, query: str, texts: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """The texts that share most of a query's distinct terms, by an equi-join on terms."""
    from skein.operators.retrieval import tokens, top

    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(query)))).alias("__term"))
    held = texts.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("__term"))
    return top(asked.join(held, "__term").groupBy(query_key, key).agg(F.count(F.lit(1)).cast("double").alias("score")), [query_key], "score", key, n)


@register("memory strategy", "none")
def no_memory(turns: DataFrame, group: str, order: list, size: str) -> DataFrame:
    return sliding_memory(turns, group, order, size, 1)


@register("memory strategy", "sliding")
def sliding_memory(turns: DataFrame, group: str, order: list, size: str, most: int = 3) -> DataFrame:
    """The latest turns of each group; order is latest first."""
    w = Window.partitionBy(group).orderBy(*order)
    return turns.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


@register("memory strategy", "summary")
def summary_memory(turns: DataFrame, group: str, order: list, size: str, budget: int = 700, kept: int = 2) -> DataFrame:
    """All turns of a group within the budget; of a larger one the latest few, beside which a summary stands."""
    w = Window.partitionBy(group)
    marked = turns.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("__s", F.sum(size).over(w))
    return marked.where((F.col("__s") <= budget) | (F.col("__r") <= kept)).drop("__r", "__s")


@F.pandas_udf(T.DoubleType())
def range_middle(low: pd.Series, high: pd.Series) -> float:
    """An aggregate over a group's ends: the middle between the lowest and the highest."""
    return float((low.min() + high.max()) / 2)


def register_sql(spark: SparkSession) -> list[str]:
    """Makes the models callable from SQL."""
    spark.udf.register("echo_model", F.pandas_udf(lambda s: "echo: " + s.str[:80], T.StringType()))
    return ["echo_model"]
