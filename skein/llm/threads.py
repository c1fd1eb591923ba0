"""Conversations from message rows: parent pointers, pointer jumping, root-to-leaf paths.

Rows of a conversation are brought into order by one range sort over (conversation, time, id), so a conversation of any
size is spread over as many tasks as it needs. A message's parent is the one before it. Inside a sorted partition the
chain of a conversation is contracted to a segment; only segments, at most one per conversation and one more per
partition border, take part in the pointer-jumping joins, whose roots and depths place every message and decide whose
turn it is. Tables with parent pointers of their own go through the same joins, with orphans, cycles and branches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import code_key, is_blank
from skein.session import ensure_checkpoint_dir



def resolve_threads(df: DataFrame, key: str, parent: str, weight: str | None = None) -> DataFrame:
    """(key, root, depth, state) of every message: the root its parent pointers lead to, the steps to it, and 'ok',
    'orphan' (the chain ends at a parent that has no row; root is that parent) or 'cycle' (root and depth are null).
    weight, if given, is the length of the step from a row to its parent, instead of 1.

    Each round replaces every pointer by the pointer of the row it points to, so a chain of n messages takes log2 n
    joins; rows that have arrived and to which no open row points any more leave the joins. After the round that doubles
    a reach of s steps with at most s open rows before it, what is still open lies on or behind a cycle. Keys must be
    unique; rows with a null key drop out; an empty table gives an empty result; other columns are ignored."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    step = F.lit(1) if weight is None else F.col(weight)
    nodes = df.select(F.col(key).alias("id"), F.col(parent).alias("to"), step.cast("bigint").alias("depth")).where("id is not null")
    known = nodes.select(F.col("id").alias("k"))
    arrived = F.when(F.col("to").isNull(), "ok").when(F.col("k").isNull(), "orphan")
    root = F.when(F.col("to").isNull(), F.col("id")).when(F.col("k").isNull(), F.col("to"))
    depth = F.when(F.col("to").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("depth"))
    look = nodes.join(known, F.col("to") == F.col("k"), "left").select("id", "to", depth.alias("depth"), root.alias("root"), arrived.alias("state")).checkpoint()
    done, open_ = [look.where("state is not null")], look.where("state is null")
    reach, left = 1, open_.count()
    while left:
        ends = look.select(F.col("id").alias("at"), F.col("to").alias("next"), F.col("depth").alias("more"), "root", "state")
        moved = open_.select("id", "to", "depth").join(ends, F.col("to") == F.col("at")).select("id", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), "root", "state").checkpoint()
        done.append(moved.where("state is not null"))
        open_ = moved.where("state is null")
        before, left = left, open_.count()
        if before <= reach:
            break
        if left:
            targets = open_.select(F.col("to").alias("id")).distinct()
            look = moved.unionByName(look.where("state is not null")).join(targets, "id", "left_semi").checkpoint()
        reach *= 2
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    kind = nodes.schema["id"].dataType
    cycles = open_.select("id", F.lit(None).cast(kind).alias("root"), F.lit(None).cast("bigint").alias("depth"), F.lit("cycle").alias("state"))
    return out.select("id", "root", "depth", "state").unionByName(cycles).withColumnRenamed("id", key)


def root_paths(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(leaf, depth, key): the messages on the way from the root to every leaf, a leaf being a message without answers;
    depth is 0 for a root and 1 for the first message whose parent is missing. Messages on or behind a cycle have no way.

    The way of a leaf is doubled in each round by the 2**k-th ancestors of what is known of it, which double too, so ways
    of n messages take log2 n rounds. Keys must be unique; rows with a null key drop out; an empty table gives an empty
    result; other columns are ignored."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    nodes = df.select(F.col(key).alias("id"), F.col(parent).alias("to")).where("id is not null").checkpoint()
    depths = resolve_threads(nodes, "id", "to").where("state <> 'cycle'").select("id", "depth").checkpoint()
    jump = nodes.join(nodes.select(F.col("id").alias("to")), "to").select("id", "to")
    leaves = depths.join(nodes.select(F.col("to").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    way = leaves.select(F.col("id").alias("leaf"), "id", "depth").checkpoint()
    reach = 1
    while True:
        more = way.join(jump.select("id", F.col("to").alias("up")), "id").select("leaf", F.col("up").alias("id"), (F.col("depth") - reach).alias("depth")).checkpoint()
        if not more.count():
            return way.select("leaf", "depth", F.col("id").alias(key))
        way = way.unionByName(more)
        jump = jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")).checkpoint()
        reach *= 2


def messages(exchanges: DataFrame, code: str, prompt: str, reply: str, time: str, key: str = "id") -> DataFrame:
    """(conversation, time, id, part, role, text): the prompt of each exchange if not blank, then its reply if not
    blank. conversation is the code without case and outer spaces; exchanges without a code drop out."""
    both = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col(prompt).alias("text"), is_blank(F.col(prompt)).alias("blank")),
        F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col(reply).alias("text"), is_blank(F.col(reply)).alias("blank")),
    )
    rows = exchanges.select(code_key(F.col(code)).alias("conversation"), F.col(time).alias("time"), F.col(key).alias("id"), F.explode(both).alias("m"))
    return rows.where("conversation is not null and not m.blank").select("conversation", "time", "id", "m.part", "m.role", "m.text")


def _linked(ordered: DataFrame) -> DataFrame:
    """Adds the number of the message within its partition's stretch of the conversation, and the role before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = role = None
        n = 0
        for batch in batches:
            step, before = [], []
            for c, r in zip(batch.column("conversation").to_pylist(), batch.column("role").to_pylist()):
                n, role = (n + 1, role) if c == code else (0, None)
                step.append(n)
                before.append(role)
                code, role = c, r
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(step, pa.int64()), pa.array(before, pa.string())], names=[*batch.schema.names, "step", "role_before"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(run, f"{fields}, step bigint, role_before string")


def conversations(rows: DataFrame, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(paths, verdicts) of messages(). paths has every message with its place (depth) in its conversation, verdicts
    one row per conversation: n messages, and whole if the roles run user, assistant, user, assistant to the end.
    Messages without a time have no place: their conversation is not whole."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    if not texts:
        rows = rows.drop("text")
    timed = rows.where("time is not null")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conversation", "time", "id", "part"]
    ordered = timed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("stretch", F.spark_partition_id().cast("bigint"))
    linked = _linked(ordered).checkpoint()
    segments = linked.groupBy("conversation", "stretch").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("step", "role"))["role"].alias("first_role"),
        F.max(F.struct("step", "role"))["role"].alias("last_role"),
        F.bool_and(F.coalesce(F.col("role") != F.col("role_before"), F.lit(True))).alias("turns"),
    )
    # few rows per conversation: as many as there are partitions that it lies in; a segment's parent is the one before it
    w = Window.partitionBy("conversation").orderBy("stretch")
    name = F.concat_ws("/", F.col("conversation"), F.col("stretch"))
    segments = segments.select("*", name.alias("segment"), F.lag(name).over(w).alias("parent"), F.lag("n").over(w).alias("step")).checkpoint()
    # depth: the messages between the root and the first message of the segment
    placed = segments.join(resolve_threads(segments, "segment", "parent", "step"), "segment").checkpoint()
    due = F.when(F.col("depth") % 2 == 0, "user").otherwise("assistant")
    verdicts = placed.groupBy("conversation").agg(
        F.sum("n").alias("n"),
        F.bool_and(F.col("turns") & (F.col("state") == "ok") & (F.col("first_role") == due)).alias("turns"),
        F.max_by("last_role", "depth").alias("last_role"),
    )
    untimed = rows.where("time is null").select("conversation").distinct().withColumn("untimed", F.lit(True))
    verdicts = verdicts.join(untimed, "conversation", "full").select("conversation", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("turns") & (F.col("last_role") == "assistant") & F.col("untimed").isNull(), F.lit(False)).alias("whole"))
    starts = placed.select("conversation", "stretch", F.col("depth").alias("start"))
    paths = linked.join(starts, ["conversation", "stretch"]).withColumn("depth", F.col("start") + F.col("step")).drop("stretch", "step", "start", "role_before")
    return paths, verdicts


def rebuilt(dialogues: DataFrame, exchanges: DataFrame, code: str, prompt: str, reply: str, time: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, gone): the messages, in order, of the dialogues that stay, and the dialogues that go, as spelt in
    dialogues: those without a message, with an exchange without a time, or whose roles do not alternate from user to
    assistant. Dialogues without a code drop out of both; exchanges of no dialogue are left aside; equal times are
    ordered by id; empty tables give empty results; other columns are ignored."""
    own = dialogues.where(F.col(code).isNotNull()).select(F.col(code).alias("dialogue_code"), code_key(F.col(code)).alias("conversation"))
    paths, verdicts = conversations(messages(exchanges, code, prompt, reply, time, key))
    untimed = exchanges.where(F.col(time).isNull()).select(code_key(F.col(code)).alias("conversation")).where("conversation is not null").distinct().withColumn("untimed", F.lit(True))
    judged = own.join(verdicts, "conversation", "left").join(untimed, "conversation", "left").withColumn("stays", F.coalesce("whole", F.lit(False)) & F.col("untimed").isNull())
    kept = judged.where("stays").select("conversation", "dialogue_code").join(paths, "conversation").select("dialogue_code", "depth", "role", "text", F.col("time").alias(time), F.col("id").alias("exchange_id"))
    return kept, judged.where("not stays").select("dialogue_code")
