"""Structure trees of texts: headings, steps and list items, their parents, neighbours and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import ensure_checkpoint_dir

ROOT, SECTION, STEP, ITEM = 1, 2, 3, 4


def structure_nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node_no, kind, depth, title, parent_no): the root of each text, its '#' headings by depth, numbered steps
    and list items below the heading they follow [choice of patterns]. Windows run within one text."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    marks = F.regexp_extract("line", r"^(#{1,6})\s", 1)
    kind = F.when(F.length(marks) > 0, SECTION).when(F.col("line").rlike(r"^\s*\d+[.)]\s+\S"), STEP).when(F.col("line").rlike(r"^\s*[-*]\s+\S"), ITEM)
    nodes = lines.select(key, "line_no", kind.alias("kind"), F.length(marks).alias("level"), F.trim(F.regexp_replace("line", r"^\s*(#{1,6}|\d+[.)]|[-*])\s+", "")).alias("title")).where("kind is not null")
    root = df.select(key, F.lit(-1).alias("line_no"), F.lit(ROOT).alias("kind"), F.lit(0).alias("level"), F.lit("").alias("title"))
    w = Window.partitionBy(key).orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    numbered = root.unionByName(nodes).withColumn("node_no", F.row_number().over(w)).withColumn("depth", F.when(F.col("kind") <= SECTION, F.col("level")))
    numbered = numbered.withColumn("depth", F.coalesce("depth", F.last(F.when(F.col("kind") <= SECTION, F.col("level")), ignorenulls=True).over(before) + 1))
    # the parent of depth d is the last heading of a smaller depth
    last = [F.max(F.when((F.col("kind") <= SECTION) & (F.col("level") == d), F.col("node_no"))).over(before).alias(f"l{d}") for d in range(7)]
    with_last = numbered.select("*", *last)
    parent = F.greatest(*[F.when(F.col("depth") > d, F.col(f"l{d}")) for d in range(7)])
    return with_last.select(key, "node_no", "kind", "depth", "title", parent.alias("parent_no"))


def siblings(nodes: DataFrame, key: str) -> DataFrame:
    """Previous and next node under the same parent."""
    w = Window.partitionBy(key, "parent_no").orderBy("node_no")
    return nodes.withColumn("previous_no", F.lag("node_no").over(w)).withColumn("next_no", F.lead("node_no").over(w))


def _from_the_root(nodes: DataFrame, key: str, step, root, joined) -> DataFrame:
    """(key, node_no, value) from the root down, by joins of one level after the other; as many rounds as the tree is
    deep, whatever its size."""
    ensure_checkpoint_dir(nodes.sparkSession)
    nodes = nodes.select(key, "node_no", "parent_no", step.alias("step")).checkpoint()
    level = nodes.where("parent_no is null").select(key, "node_no", root.alias("value"))
    done = level
    while True:
        level = nodes.join(level.withColumnRenamed("node_no", "parent_no"), [key, "parent_no"]).select(key, "node_no", joined.alias("value")).checkpoint()
        if level.isEmpty():
            return done
        done = done.unionByName(level)


def paths(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node_no, path): titles from the root down."""
    return _from_the_root(nodes, key, F.col("title"), F.col("step"), F.concat_ws("/", "value", "step")).withColumnRenamed("value", "path")


def codes(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node_no, code): the places of a node and of those above it below their parents; empty for a root."""
    place = F.row_number().over(Window.partitionBy(key, "parent_no").orderBy("node_no")).cast("string")
    joined = F.when(F.col("value") == "", F.col("step")).otherwise(F.concat_ws(".", "value", "step"))
    return _from_the_root(nodes, key, place, F.lit(""), joined).withColumnRenamed("value", "code")


def scope_paths(df: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """(key, root, depth, path) of a self-referring table, from its roots down, one level a
    round, however deep it is. Rows on a cycle never appear."""
    ensure_checkpoint_dir(df.sparkSession)
    level = df.where(F.col(parent).isNull()).select(key, F.col(key).alias("root"), F.lit(0).alias("depth"), F.col(name).alias("path"))
    done = level
    while True:
        up = level.select(F.col(key).alias(parent), "root", "depth", "path")
        level = df.select(key, parent, name).join(up, parent).select(key, "root", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", name).alias("path")).checkpoint()
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return done
