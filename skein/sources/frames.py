"""Readers of framed text: server-sent events, model streams, and the texts of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "type string, content string"


def sse_events(df: DataFrame, key: str, raw: str, schema: str = EVENT) -> DataFrame:
    """(key, event_no, event): the JSON events of each raw stream. Blocks end at a blank line; the data lines of a block
    are one text; [DONE] and blocks without data are skipped; a block without data lines is read line by line as JSON.
    Bad JSON gives a null event, which drops out."""
    blocks = df.select(key, F.posexplode(F.split(raw, r"\r?\n\r?\n")).alias("block_no", "block"))
    lines = F.split("block", r"\r?\n")
    data = F.filter(lines, lambda x: F.startswith(x, F.lit("data:")))
    joined = F.array(F.array_join(F.transform(data, lambda x: F.ltrim(F.substring(x, F.lit(6), F.length(x)))), "\n"))
    payload = F.when(F.size(data) > 0, joined).otherwise(lines)
    parts = blocks.select(key, "block_no", F.posexplode(payload).alias("part_no", "payload")).where("trim(payload) not in ('', '[DONE]')")
    events = parts.select(key, "block_no", "part_no", F.from_json("payload", schema).alias("event")).where("event is not null and event.type is not null")
    return events.select(key, (F.shiftleft(F.col("block_no").cast("bigint"), 32) + F.col("part_no")).alias("event_no"), "event")


def model_stream(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, content, finish_reason): the deltas of a streamed completion put together, with its last reason."""
    lines = df.select(key, F.posexplode(F.split(raw, r"\r?\n")).alias("n", "line")).where(F.startswith("line", F.lit("data:")))
    body = F.trim(F.substring("line", F.lit(6), F.length("line")))
    parts = lines.select(key, "n", F.get_json_object(body, "$.choices[0].delta.content").alias("delta"), F.get_json_object(body, "$.choices[0].finish_reason").alias("reason"))
    return parts.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("delta", F.lit("")).alias("delta")))), lambda x: x["delta"]), "").alias("content"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("n"))).alias("finish_reason"),
    )


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text, markdown and HTML files; tags and entities of HTML are taken out."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    return files.select("path", F.when(F.col("path").rlike(r"(?i)\.html?$"), html_text(F.col("text"))).otherwise(F.col("text")).alias("text"))


def html_text(c):
    """HTML without scripts, styles and tags; block ends become line breaks."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(mark))
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", "")
