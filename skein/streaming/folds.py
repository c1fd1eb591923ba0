"""Structured Streaming: folding answer events into messages, windows over event time, two-stage ingestion."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FOLDED = "key string, text string, thinking string, status string, n bigint"


def fold_batch(events: DataFrame, key: str = "key") -> DataFrame:
    """(key, text, thinking, status, n) of events (key, n, type, content): text is appended, thinking is appended if
    new, status replaces, an error makes it FAILED, stop makes it STOPPED; both are final."""
    row = F.struct("n", "type", "content")
    ordered = F.array_sort(F.collect_list(row))
    pick = lambda kind: F.transform(F.filter("e", lambda x: x["type"] == kind), lambda x: F.coalesce(x["content"], F.lit("")))
    ends = F.filter("e", lambda x: x["type"].isin("error", "stop"))
    states = F.filter("e", lambda x: x["type"] == "status")
    status = F.when(F.size(ends) > 0, F.when(ends[0]["type"] == "error", "FAILED").otherwise("STOPPED")).when(F.size(states) > 0, F.element_at(states, -1)["content"]).otherwise("RUNNING")
    folded = events.groupBy(key).agg(ordered.alias("e"))
    return folded.select(F.col(key).cast("string").alias("key"), F.array_join(pick("text"), "").alias("text"), F.array_join(F.array_distinct(pick("thinking")), "\n").alias("thinking"), status.alias("status"), F.size("e").cast("bigint").alias("n"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, thinking, status, final, n = state.get if state.exists else ("", "", "RUNNING", False, 0)
    rows = pd.concat(list(batches)).sort_values("n")
    seen = json.loads(thinking) if thinking else []
    for kind, content in zip(rows["type"], rows["content"]):
        content = content or ""
        n += 1
        if kind == "text":
            text += content
        elif kind == "thinking" and content not in seen:
            seen.append(content)
        elif kind == "status" and not final:
            status = content
        elif kind in ("error", "stop") and not final:
            status, final = ("FAILED" if kind == "error" else "STOPPED"), True
    state.update((text, json.dumps(seen), status, final, n))
    yield pd.DataFrame({"key": [str(key[0])], "text": [text], "thinking": ["\n".join(seen)], "status": [status], "n": [n]})


def fold_stream(events: DataFrame, key: str = "key") -> DataFrame:
    """The same fold over a stream of events, with the state of each key kept between micro-batches."""
    return events.groupBy(key).applyInPandasWithState(_fold, FOLDED, "text string, thinking string, status string, final boolean, n bigint", "update", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and kind; on a stream, rows later than the watermark are left out."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stamped.groupBy(window.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of a key's events without a longer gap: the liveness of a lease that each event renews."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "n")


def run_once(df: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends; files are written exactly once."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(out).awaitTermination()


def run_updates(df: DataFrame, checkpoint: str, out: str, keys: list[str]) -> DataFrame:
    """Runs a stream of updates over all that is there and gives the last update of each key. Each micro-batch is one
    folder, so a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch:06d}")

    df.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    spark = df.sparkSession
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, epoch int").parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.desc("epoch"))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "epoch", "batch")


def run_callbacks(df: DataFrame, checkpoint: str, on_content: Callable[[DataFrame, int], None], on_complete: Callable[[], None] = lambda: None, on_error: Callable[[Exception], None] | None = None) -> None:
    """Runs a stream over all that is there and hands every micro-batch to on_content, then calls on_complete; an error
    goes to on_error if there is one, and else is raised. A batch may come again after a failure, with its number."""
    try:
        df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(on_content).start().awaitTermination()
    except Exception as e:  # the stream's own failure
        if on_error is None:
            raise
        on_error(e)
        return
    on_complete()


def run_polling(df: DataFrame, checkpoint: str, on_content: Callable[[DataFrame, int], None], every: str = "3 seconds", most: int = 30):
    """Runs a stream that looks for new rows at an interval and ends after `most` micro-batches; gives the query."""
    seen = {"n": 0}

    def step(batch: DataFrame, epoch: int) -> None:
        on_content(batch, epoch)
        seen["n"] += 1

    running = df.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(step).start()
    while running.isActive and seen["n"] < most:
        running.awaitTermination(1)
        if seen["n"] and not running.status["isDataAvailable"] and not running.status["isTriggerActive"]:
            break
    running.stop()
    return running


def ingest(spark: SparkSession, source: str, schema, work: str, parse, index) -> DataFrame:
    """Two jobs in a row over a folder as a queue: parse writes parsed rows, index reads them as its own stream. Each
    has its checkpoint, so a restart goes on where it ended."""
    run_once(parse(spark.readStream.schema(schema).parquet(source)), f"{work}/parse.checkpoint", f"{work}/parsed")
    parsed = spark.read.parquet(f"{work}/parsed").schema
    run_once(index(spark.readStream.schema(parsed).parquet(f"{work}/parsed")), f"{work}/index.checkpoint", f"{work}/indexed")
    return spark.read.parquet(f"{work}/indexed")
