"""Lines repeated across the documents of one scope, found with suffix arrays over line identifiers.

Every text becomes a sequence of line identifiers (hashes of the letters of a line, within its scope). A line that
stands in fewer places than a repeated block has documents is in no such block, so the sequences are cut at such lines
into runs. The suffixes of all runs of a scope are sorted bucket by bucket, a bucket being all suffixes with one first
line; the common prefixes of neighbours in that order (LCP intervals) and the documents of each interval give, for every
place, the longest block that begins there and spans enough documents. A bucket of very many suffixes is split by
document, so its parts have no document in common and their counts add up. Suffixes are compared over DEPTH lines; where
a block goes on, its length is found by doubling: names of 2, 4, 8 ... times as many lines, from the names of their
halves, and bisection. So no suffix is ever held longer than DEPTH, and blocks may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.text import LETTER, classes, codes, slices, span_hashes
from skein.operators.joins import checked, with_keys
from skein.session import ensure_checkpoint_dir

#: Suffixes of one first line that one task sorts; beyond it the bucket is split by document.
BUCKET_ROWS = 20_000
#: Lines over which suffixes are compared before doubling, a power of two.
DEPTH = 16


def line_keys(texts: list[str], letters: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the letters of each line in lower case, 0 for lines with fewer letters, and the lines of each text."""
    texts = [t.lower() + "\n" for t in texts]
    _, points, at = codes(texts)
    breaks = np.flatnonzero(points == 10)
    mine = classes()[points] == LETTER
    before = np.concatenate(([0], np.cumsum(mine)))
    ends = before[breaks]
    starts = np.concatenate(([0], ends[:-1]))
    keys = span_hashes(points[mine], starts, ends)
    keys[keys == 0] = 1
    keys[ends - starts < letters] = 0
    return keys, np.diff(np.searchsorted(breaks, at))


def _sequences(df: DataFrame, key: str, document: str, text: str, letters: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            keys, counts = line_keys([x or "" for x in batch.column(2).to_pylist()], letters)
            at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64)))], names=["row_id", "document", "lines"])

    return df.select(F.col(key).alias("row_id"), F.col(document).alias("document"), text).mapInArrow(run, "row_id bigint, document bigint, lines array<bigint>")


def intervals(suffixes: list[tuple[tuple[int, ...], int]], least: int = 1) -> Iterator[tuple[int, int, int, int]]:
    """(low, high, depth, documents) of every LCP interval of sorted suffixes that spans at least so many documents, an
    interval after the shorter ones that hold it. suffixes are (line identifiers, document). An interval that spans too
    few documents holds no deeper one that spans enough, so it isn't entered."""
    stack = [(0, len(suffixes), 0)]
    while stack:
        low, high, depth = stack.pop()
        i = low
        while i < high:
            tail = suffixes[i][0]
            if len(tail) <= depth:  # ends here: no deeper block
                i += 1
                continue
            j = i + 1
            while j < high and len(suffixes[j][0]) > depth and suffixes[j][0][depth] == tail[depth]:
                j += 1
            spans = len({d for _, d in suffixes[i:j]})
            if spans >= least:
                yield i, j, depth + 1, spans
                stack.append((i, j, depth + 1))
            i = j


def _longest(suffixes: DataFrame, documents: int) -> DataFrame:
    """The suffix arrays of all buckets, one bucket at a time. For a bucket that is whole, a row per suffix with the
    longest block that begins there (its lines, its documents and its places); for a part of a bucket, a row without a
    row_id per interval."""

    def flush(own: list, part: bool) -> pa.RecordBatch:
        order = sorted(range(len(own)), key=lambda i: own[i][0])
        tails = [(own[i][0], own[i][1]) for i in order]
        if part:
            found = [(None, None, list(tails[i][0][:depth]), spans, j - i) for i, j, depth, spans in intervals(tails)]
        else:
            best: list = [None] * len(own)
            for i, j, depth, spans in intervals(tails, documents):
                best[i:j] = [(depth, spans, j - i)] * (j - i)
            found = [(own[i][2], own[i][3], list(own[i][0][: b[0]]), b[1], b[2]) for i, b in zip(order, best) if b]
        columns = list(zip(*found)) or [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["row_id", "line_no", "block", "documents", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, own = None, []
        for batch in batches:
            for first, part, parts, document, tail, row_id, line_no in zip(*(c.to_pylist() for c in batch.columns)):
                if (first, part, parts > 1) != bucket:
                    if own:
                        yield flush(own, bucket[2])
                    bucket, own = (first, part, parts > 1), []
                own.append((tuple(tail), document, row_id, line_no))
        if own:
            yield flush(own, bucket[2])

    kept = suffixes.select("first", "part", "parts", "document", "tail", "row_id", "line_no")
    return kept.repartition("first", "part").sortWithinPartitions("first", "part").mapInArrow(run, "row_id bigint, line_no int, block array<bigint>, documents bigint, n bigint")


def _spanning(found: DataFrame, names: list[str], documents: int) -> DataFrame:
    """The names of found (names, document) that stand in enough documents, with their documents and places."""
    places = found.groupBy(*names, "document").agg(F.count(F.lit(1)).alias("n"))
    return places.groupBy(*names).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n")).where(F.col("documents") >= documents)


def _lengthened(begun: DataFrame, documents: int) -> DataFrame:
    """(row_id, line_no, name, n_lines, documents, n) of the longest blocks that begin where a block of DEPTH lines does
    (begun: row_id, line_no, document, name). Doubling gives the names of all blocks of DEPTH * 2**k lines that span
    enough documents. A block of up to twice that many lines is named by the two such blocks at its beginning and its
    end, so its length is found by bisection over the place of the second, each try counted over all places."""
    at = ["row_id", "line_no"]
    levels, width = [begun.checkpoint()], DEPTH
    while True:
        level = levels[-1]
        onward = level.select("row_id", (F.col("line_no") - width).alias("line_no"), F.col("name").alias("next"))
        wider = level.join(onward, at).select(*at, "document", F.xxhash64("name", "next").alias("name"))
        wider = with_keys(wider, _spanning(wider, ["name"], documents), "name").checkpoint()
        if wider.isEmpty():
            break
        levels.append(wider)
        width *= 2
    out = None
    for k, level in enumerate(levels):
        mine = level if k + 1 == len(levels) else level.join(levels[k + 1].select(*at), at, "left_anti")
        longest = mine.join(_spanning(level, ["name"], documents), "name").select(*at, "name", F.lit(0).alias("off"), F.lit(0).cast("bigint").alias("end"), "documents", "n").checkpoint()
        ends = level.select("row_id", F.col("line_no").alias("__at"), F.col("name").alias("next"))
        step = (DEPTH << k) // 2
        while step and not longest.isEmpty():
            tried = longest.select(*at, "name", (F.col("off") + step).alias("further")).withColumn("__at", F.col("line_no") + F.col("further")).join(ends, ["row_id", "__at"]).drop("__at").checkpoint()
            every = level.join(tried.select("name", "further").distinct(), "name").withColumn("__at", F.col("line_no") + F.col("further")).join(ends, ["row_id", "__at"])
            good = _spanning(every, ["name", "further", "next"], documents).withColumnsRenamed({"documents": "d", "n": "p"})
            grown = tried.join(good, ["name", "further", "next"]).select(*at, "further", "next", "d", "p")
            longest = longest.join(grown, at, "left").select(*at, "name", *(F.coalesce(a, b).alias(b) for a, b in (("further", "off"), ("next", "end"), ("d", "documents"), ("p", "n")))).checkpoint()
            step //= 2
        named = F.when(F.col("off") == 0, F.col("name")).otherwise(F.xxhash64("name", "off", "end"))
        found = longest.select(*at, named.alias("name"), (F.col("off") + (DEPTH << k)).alias("n_lines"), "documents", "n")
        out = found if out is None else out.unionByName(found)
    return out


def repeated_lines(df: DataFrame, scopes: DataFrame, key: str, document: str, text: str, scope: str, documents: int = 6, letters: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lines, blocks). lines has (row_id, line_no, block_id, n_lines): every line, numbered from 0, that a repeated
    block covers, with the longest one that begins there. blocks has (block_id, n_lines, documents, n): the longest
    blocks, of any length, that span at least `documents` documents; a block that is only the rest of a longer one
    wherever it stands is left out. n are the places where a block stands.

    df has one row per text, scopes one row per document with its scope. Texts without a document, documents without
    a scope (null or empty) and null or empty texts have no repeated lines; a repeated row of df repeats its lines;
    an empty table gives empty results; other columns are ignored."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    places = scopes.select(F.col(document).alias("document"), F.col(scope).alias("scope")).where("scope is not null and scope <> ''")
    scoped = F.transform("lines", lambda x: F.when(x == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.col("scope"), x)))
    rows = _sequences(df, key, document, text, letters).join(places, "document").select("row_id", "document", scoped.alias("lines")).checkpoint()
    lines = rows.select("row_id", "document", F.posexplode("lines").alias("line_no", "first")).where("first <> 0")
    # only a filter: lines in fewer places than documents are asked for
    often = checked(lines.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= documents))
    kept = lines.join(often, "first").groupBy("row_id", "document").agg(F.array_sort(F.collect_list(F.struct("line_no", "first", "n"))).alias("own"))
    # a suffix ends where the next line is not a kept one
    suffixes = kept.select("row_id", "document", "own", F.posexplode("own").alias("i", "line")).select(
        "row_id",
        "document",
        "line.line_no",
        "line.first",
        (F.col("line.n") / BUCKET_ROWS + 1).cast("int").alias("parts"),
        F.transform(F.filter(F.slice("own", F.col("i") + 1, F.lit(DEPTH)), lambda x, j: x["line_no"] - F.col("line.line_no") == j), lambda x: x["first"]).alias("tail"),
    )
    suffixes = suffixes.withColumn("part", F.pmod(F.xxhash64("document"), F.col("parts")).cast("int")).checkpoint()
    found = _longest(suffixes, documents).checkpoint()
    best = found.where("row_id is not null").select("row_id", "line_no", F.xxhash64("block").alias("name"), F.size("block").alias("n_lines"), "documents", "n")
    split = found.where("row_id is null")
    if not split.isEmpty():
        summed = split.groupBy(F.xxhash64("block").alias("name"), F.size("block").alias("n_lines")).agg(F.sum("documents").alias("documents"), F.sum("n").alias("n")).where(F.col("documents") >= documents)
        prefixes = suffixes.where("parts > 1").select("row_id", "line_no", F.explode(F.transform(F.sequence(F.lit(1), F.size("tail")), lambda k: F.xxhash64(F.slice("tail", F.lit(1), k)))).alias("name"))
        hit = prefixes.join(checked(summed), "name").groupBy("row_id", "line_no").agg(F.max(F.struct("n_lines", "name", "documents", "n")).alias("b"))
        best = best.unionByName(hit.select("row_id", "line_no", "b.name", "b.n_lines", "b.documents", "b.n"))
    full = best.where(F.col("n_lines") == DEPTH)
    if not full.isEmpty():
        begun = suffixes.select("row_id", "line_no", "document").join(full.select("row_id", "line_no", "name"), ["row_id", "line_no"])
        best = best.where(F.col("n_lines") < DEPTH).unionByName(_lengthened(begun, documents))
    best = best.checkpoint()
    w = Window.partitionBy("row_id").orderBy("line_no")
    before = F.when(F.lag("line_no").over(w) == F.col("line_no") - 1, F.lag("n_lines").over(w))
    starts = best.withColumn("before", before).where("before is null or before <= n_lines")
    blocks = starts.groupBy(F.col("name").alias("block_id"), "n_lines").agg(F.max("documents").alias("documents"), F.max("n").alias("n"))
    return best.select("row_id", "line_no", F.col("name").alias("block_id"), "n_lines"), blocks


def without_lines(df: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """df with the given (row_id, line_no) cut out of the text; a text that loses all its lines becomes empty."""
    gone = lines.groupBy(F.col("row_id").alias(key)).agg(F.collect_set("line_no").alias("__gone"))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return df.join(gone, key, "left").withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)).drop("__gone")
