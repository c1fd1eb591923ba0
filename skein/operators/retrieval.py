"""Keyword and vector retrieval: chunks, postings, BM25, exact vector search in blocks, gates, rank fusion, evidence.

Constants that no source fixes are marked [choice].
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.joins import with_keys
from skein.session import ensure_checkpoint_dir

K1, B = 1.2, 0.75  # [choice]
RRF_K = 60
VECTOR_FLOOR, KEYWORD_FLOOR = 0.45, 0.35
CHANNEL_TOP, MERGED_TOP, FINAL_TOP = 8, 10, 5
PARENT_CHARS, PART_CHARS, TOTAL_CHARS = 2200, 2200, 5200
CHUNK_CHARS, CHUNK_OVERLAP = 800, 120

#: Queries, vectors and texts that one task compares.
QUERY_BLOCK, VECTOR_BLOCK, TEXT_BLOCK = 2048, 16384, 32768


def window_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_no, chunk_text): windows of fixed size at a fixed stride; the last one ends with the text."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(stride))
    rows = df.where(F.length(text) > 0).select(key, text, F.posexplode(starts).alias("chunk_no", "__at"))
    return rows.select(key, "chunk_no", F.substring(F.col(text), F.col("__at") + 1, F.lit(size)).alias("chunk_text"))


def semantic_chunks(df: DataFrame, key: str, text: str, most: int = 700, least: int = 240, similarity: float = 0.18) -> DataFrame:
    """(key, chunk_no, chunk_text): sentences joined to the chunk before while it is short, or while it has room and
    shares enough words with them [choice: Jaccard of word sets]. One fold over each text's own sentences."""
    parts = F.filter(F.split(text, r"(?<=[.!?。！？])\s*|\n+"), lambda s: F.trim(s) != "")
    bag = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(last, F.lit(" "), s)
        near = F.size(F.array_intersect(bag(last), bag(s))) >= similarity * F.size(F.array_union(bag(last), bag(s)))
        fits = F.length(joined) <= most
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))
        return F.when(F.size(done) == 0, F.array(s)).when(fits & ((F.length(last) < least) | near), grown).otherwise(F.concat(done, F.array(s)))

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return df.where(F.length(text) > 0).select(key, F.posexplode(folded).alias("chunk_no", "chunk_text"))


IDEOGRAPHS = "\u4e00-\u9fff"


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; of a run of ideographs, every two that stand side by side."""
    apart = F.regexp_replace(F.lower(text), f"([{IDEOGRAPHS}]+)", " $1 ")
    runs = F.regexp_extract_all(apart, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
    split = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{IDEOGRAPHS}]"), pairs(r)).otherwise(F.array(r))))
    return F.when(apart.rlike(f"[{IDEOGRAPHS}]"), split).otherwise(runs)


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, dl): how often a term stands in a text, and the text's length in terms."""
    words = df.select(key, tokens(F.col(text)).alias("w")).select(key, F.size("w").alias("dl"), F.explode("w").alias("term"))
    return words.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", key, F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl"))


def store_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes postings as a table cut by hash of the term and sorted by term, so that a read for given terms opens only
    their buckets and skips the row groups between them."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    index.withColumn("bucket", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_index(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """The postings of a stored index, of the given terms only if there are any; terms and buckets reach the scan."""
    index = spark.read.parquet(path)
    if terms is not None:
        some = spark.createDataFrame([(t,) for t in terms] or [("",)], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()
        index = index.where(F.col("bucket").isin([r[0] for r in some]) & F.col("term").isin(terms))
    return index.drop("bucket")


def weighted_terms(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, terms: str, n: int, pruned: float = 0.0) -> DataFrame:
    """(query_key, h, idf): the hashed terms of each query that stand in a text, with their weight. Frequencies are
    counted only for terms that a query has. pruned drops that share of each query's terms, the commonest first."""
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term")).withColumn("h", F.xxhash64("term"))
    seen = docs.select(F.explode(F.array_distinct(terms)).alias("h")).join(asked.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(seen.select("h", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "h")
    if pruned:
        w = Window.partitionBy(query_key)
        place = F.row_number().over(w.orderBy(F.round("idf", 9), "term"))
        weighted = weighted.withColumn("__p", place).withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__p") > F.floor(F.col("__n") * pruned))
    return weighted.select(query_key, "h", "idf")


def bm25_top(queries: DataFrame, query_key: str, query_text: str, texts: DataFrame, key: str, text: str, n: int, pruned: float = 0.0, others: bool = False, within: tuple[str, str] | None = None) -> DataFrame:
    """(query_key, key, score, rank): the n texts of the highest BM25 score for each query, among those that share a term
    with it; scores are rounded to 6 digits and ties go to the smaller key. others leaves out the text whose key is the
    query's own; within names a column of the queries and one of the texts that must be equal (a filter inside the
    channel: a document or a scope). Queries without a term in any text have no result; null texts have no terms.

    Texts are read once as hashed terms. Texts and queries are cut into blocks of bounded size; in a task the postings
    of a block of texts meet a block of queries, and n texts per query leave it, so no (query, text) score is shuffled."""
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    q_in, d_in = (F.col(c).cast("string") for c in within) if within else (F.lit(None).cast("string"),) * 2
    docs = texts.select(F.col(key).cast("bigint").alias("id"), F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t)).alias("terms"), d_in.alias("inside")).where(F.size("terms") > 0).checkpoint()
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avgdl")).first()
    total, avgdl = size.n, size.avgdl or 1.0
    terms = weighted_terms(queries, query_key, query_text, docs, "terms", total, pruned).groupBy(query_key).agg(F.collect_list("h").alias("terms"), F.collect_list("idf").alias("idf"))
    asked = terms.join(queries.select(query_key, q_in.alias("inside")), query_key).select(F.col(query_key).cast("bigint").alias("id"), "terms", "idf", "inside").checkpoint()
    qb, vb = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-total // TEXT_BLOCK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 2000))
    here = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = asked.select(here(qb).alias("q"), spread(vb).alias("b"), "id", "terms", "idf", "inside").unionByName(
        docs.select(spread(qb).alias("q"), here(vb).alias("b"), "id", "terms", F.lit(None).cast("array<double>").alias("idf"), "inside")
    )

    def score(table: pa.Table) -> pa.Table:
        is_query = table.column("idf").is_valid().to_numpy()
        ids = table.column("id").to_numpy()
        inside = np.array(table.column("inside").to_pylist(), object)
        lists = table.column("terms").combine_chunks()
        begins, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        d = np.flatnonzero(~is_query)
        d = d[np.argsort(ids[d])]  # columns in order of key, so ties are too
        dl = np.diff(begins)[d]
        own = np.concatenate([flat[begins[i] : begins[i + 1]] for i in d]) if len(d) else flat[:0]
        names, term = np.unique(own, return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * max(1, len(d)) + np.repeat(np.arange(len(d)), dl), return_counts=True)
        doc, at = pair % max(1, len(d)), np.searchsorted(pair // max(1, len(d)), np.arange(len(names) + 1))
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
        idf, out = table.column("idf").combine_chunks(), []
        for i in np.flatnonzero(is_query) if len(d) else []:
            mine, w = flat[begins[i] : begins[i + 1]], np.asarray(idf[int(i)].values)
            t = np.minimum(np.searchsorted(names, mine), len(names) - 1)
            hit = names[t] == mine
            t, w = t[hit], w[hit]
            if not len(t):
                continue
            n_each = at[t + 1] - at[t]
            where = np.arange(int(n_each.sum())) + np.repeat(at[t] - (np.cumsum(n_each) - n_each), n_each)
            s = np.round(np.bincount(doc[where], weights=np.repeat(w, n_each) * weight[where], minlength=len(d)), 6)
            touched = np.bincount(doc[where], minlength=len(d)) > 0
            if others:
                touched &= ids[d] != ids[i]
            if within:
                touched &= inside[d] == inside[i]
            c = np.flatnonzero(touched)
            if len(c) > n:  # all that reach the n-th best score, so that ties are decided by key alone
                c = c[s[c] >= np.partition(s[c], len(c) - n)[len(c) - n]]
                c = c[np.argsort(-s[c], kind="stable")][:n]
            out.append((np.full(len(c), ids[i]), ids[d[c]], s[c]))
        a, b, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({query_key: pa.array(a, pa.int64()), key: pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    found = both.groupBy("q", "b").applyInArrow(score, f"`{query_key}` bigint, `{key}` bigint, score double")
    return top(found, [query_key], "score", key, n)


def top(df: DataFrame, groups: list[str], score: str, key: str, n: int, rank: str = "rank") -> DataFrame:
    """The n best of each group by score, then key; cut to n per task before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(F.desc(score), key)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def terms_of(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """(columns, h): the distinct terms of each text, hashed."""
    return df.select(*columns, F.explode(F.array_distinct(F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t)))).alias("h"))


def question_classes(asked: DataFrame, key: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with the same known terms have the same hits and count as one. (of, terms): each class with the smallest
    key in it; (key, of): its members. Questions without a known term are in none. asked has (key, h), known has h."""
    own = with_keys(asked, known, "h").groupBy(key).agg(F.sort_array(F.collect_set("h")).alias("terms")).checkpoint()
    classes = own.groupBy("terms").agg(F.min(key).alias("of")).checkpoint()
    return classes.select("of", "terms"), own.join(classes, "terms").select(key, "of")


def first_alike(docs: DataFrame, groups: list[str], n: int) -> DataFrame:
    """The n smallest ids of each group: all of a group score alike, so no other can be among the n best of a query."""
    w = Window.partitionBy(*groups).orderBy("id")
    return docs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def routed_top(queries: DataFrame, docs: DataFrame, n: int, unit: int) -> DataFrame:
    """(of, id, scope, value, rank): the n documents of the highest value for each query, then of the smallest id, among
    those that share a term with it and lie in one of its scopes. The value is `unit` for each shared term, the bonus of
    the document's scope and the largest bonus among its topics; all are whole numbers.

    queries has (of, terms, scopes, scope_bonus, topics, topic_bonus) and docs has (id, terms, scope, topics); terms and
    topics are hashes in arrays, as are the scopes of queries; a topic's hash is that of its scope and name. Both are cut
    into blocks of bounded size, and n documents per query leave a task, so no (query, document) pair is shuffled."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    none = F.array().cast("array<bigint>")
    docs, queries = docs.select("id", "terms", "scope", "topics").checkpoint(), queries.checkpoint()
    total = docs.count()
    qb = max(1, -(-queries.count() // QUERY_BLOCK))
    # a query costs a task more than a few thousand documents do: many blocks only where there are few of queries
    vb = max(1, -(-total // TEXT_BLOCK), min(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // qb), total // 2000))
    here = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = queries.withColumnRenamed("of", "id").withColumn("scope", F.lit(None).cast("string"))
    docs = docs.withColumns({"scopes": F.array(F.xxhash64("scope")), "scope_bonus": none, "topic_bonus": none})
    columns = ["id", "scope", "terms", "scopes", "scope_bonus", "topics", "topic_bonus"]
    both = queries.select(here(qb).alias("q"), spread(vb).alias("b"), F.lit(1).alias("side"), *columns).unionByName(docs.select(spread(qb).alias("q"), here(vb).alias("b"), F.lit(0).alias("side"), *columns))

    def score(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        lists = {}
        for c in columns[2:]:
            x = table.column(c).combine_chunks()
            lists[c] = x.flatten().to_numpy(), x.offsets.to_numpy() - x.offsets[0].as_py()
        of = lambda c, i: lists[c][0][lists[c][1][i] : lists[c][1][i + 1]]
        d = np.flatnonzero(side == 0)
        d = d[np.argsort(ids[d])]  # in order of id, so ties are too

        def inverted(c: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            names, at = np.unique(np.concatenate([of(c, i) for i in d]), return_inverse=True)
            order = np.argsort(at, kind="stable")
            return names, np.repeat(np.arange(len(d)), np.diff(lists[c][1])[d])[order], np.searchsorted(at[order], np.arange(len(names) + 1))

        def found(names: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(names, mine), max(len(names) - 1, 0))
            hit = names[at] == mine if len(names) else np.zeros(len(mine), bool)
            return at[hit], hit

        out = []
        if len(d):
            names, doc, at = inverted("terms")
            topics, in_topic, topic_at = inverted("topics")
            scopes, scope = np.unique(np.array([of("scopes", i)[0] for i in d]), return_inverse=True)
        for i in np.flatnonzero(side == 1) if len(d) else []:
            own, _ = found(names, of("terms", i))
            shared = np.bincount(np.concatenate([doc[at[t] : at[t + 1]] for t in own]), minlength=len(d)) if len(own) else np.zeros(len(d), np.int64)
            own, hit = found(scopes, of("scopes", i))
            bonus, inside = np.zeros(len(scopes), np.int64), np.zeros(len(scopes), bool)
            bonus[own], inside[own] = of("scope_bonus", i)[hit], True
            own, hit = found(topics, of("topics", i))
            extra = np.zeros(len(d), np.int64)
            for t, more in zip(own, of("topic_bonus", i)[hit]):
                w = in_topic[topic_at[t] : topic_at[t + 1]]
                extra[w] = np.maximum(extra[w], more)
            c = np.flatnonzero((shared > 0) & inside[scope])
            value = shared[c] * unit + bonus[scope[c]] + extra[c]
            if len(c) > n:  # all that reach the n-th best value, so that ties are decided by id alone
                enough = value >= np.partition(value, len(c) - n)[len(c) - n]
                c, value = c[enough], value[enough]
                best = np.argsort(-value, kind="stable")[:n]
                c, value = c[best], value[best]
            out.append((np.full(len(c), ids[i]), d[c], value))
        a, b, v = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"of": pa.array(a, pa.int64()), "id": pa.array(ids[b], pa.int64()), "scope": table.column("scope").combine_chunks().take(pa.array(b, pa.int64())).cast(pa.string()), "value": pa.array(v, pa.int64())})

    return top(both.groupBy("q", "b").applyInArrow(score, "of bigint, id bigint, scope string, value bigint"), ["of"], "value", "id", n)


def keyword_gate(df: DataFrame, groups: list[str], score: str = "score", share: float = KEYWORD_FLOOR) -> DataFrame:
    """Rows with at least a share of their group's best score. Call it on rows cut to the top, which hold the best."""
    return df.withColumn("__best", F.max(score).over(Window.partitionBy(*groups))).where(F.col(score) >= share * F.col("__best")).drop("__best")


def is_vector(c: str, width: int) -> Column:
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) == width) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def vector_top(queries: DataFrame, vectors: DataFrame, key: str, vector: str, n: int, width: int = 64, floor: float | None = None) -> DataFrame:
    """(query_id, key, score, rank): the n vectors nearest to each query by cosine, exactly; scores are rounded to 6
    digits and ties go to the smaller key. A vector is no neighbour of itself. Queries and vectors are cut into blocks
    of bounded size; each pair of blocks is one matrix product in one task, of which n per query leave."""
    spark = vectors.sparkSession
    vectors = vectors.where(is_vector(vector, width)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    queries = queries.where(is_vector(vector, width)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    nq, nv = queries.count(), vectors.count()
    qb, vb = max(1, -(-nq // QUERY_BLOCK)), max(1, -(-nv // VECTOR_BLOCK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), nv // 2000))
    here = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = queries.select(here(qb).alias("q"), spread(vb).alias("b"), F.lit(1).alias("side"), "id", "v").unionByName(vectors.select(spread(qb).alias("q"), here(vb).alias("b"), F.lit(0).alias("side"), "id", "v"))

    def near(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        x = np.stack(table.column("v").to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q, r = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        r = r[np.argsort(ids[r])]
        out = []
        for i in range(0, len(q) if len(r) else 0, 256):
            s = np.round(x[q[i : i + 256]] @ x[r].T, 6)
            s[ids[q[i : i + 256]][:, None] == ids[r][None, :]] = -np.inf
            m = min(n, len(r))
            # all that reach the m-th best score, so that ties are decided by key alone
            least = np.partition(s, len(r) - m, axis=1)[:, len(r) - m]
            a, b = np.nonzero((s >= least[:, None]) & np.isfinite(s))
            out.append((ids[q[i + a]], ids[r[b]], s[a, b]))
        a, b, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(a, pa.int64()), key: pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    found = both.groupBy("q", "b").applyInArrow(near, f"query_id bigint, `{key}` bigint, score double")
    if floor is not None:
        found = found.where(F.col("score") >= floor)
    return top(found, ["query_id"], "score", key, n)


def fuse(channels: dict[str, DataFrame], query_key: str, key: str, k: int = RRF_K) -> DataFrame:
    """(query_key, key, rrf_score, one rank per channel): reciprocal ranks summed over channels. Channels are united
    and grouped once, instead of an outer join."""
    both = None
    for name, df in channels.items():
        part = df.select(query_key, key, F.lit(name).alias("channel"), "rank")
        both = part if both is None else both.unionByName(part)
    ranks = [F.min(F.when(F.col("channel") == name, F.col("rank"))).alias(f"{name}_rank") for name in channels]
    return both.groupBy(query_key, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"), *ranks)


def elevate(hits: DataFrame, query_key: str, chunk: str, parents: DataFrame, parent: str, score: str) -> DataFrame:
    """(query_key, parent, score, hits, is_elevated): child hits rolled up to their parents with the best child's
    score [choice: max]; a parent is elevated if two children hit."""
    rows = hits.join(parents, chunk)
    return rows.groupBy(query_key, parent).agg(F.max(score).alias(score), F.count(F.lit(1)).alias("hits")).withColumn("is_elevated", F.col("hits") >= 2)


def within_budget(df: DataFrame, groups: list[str], order: list, size: Column, budget: int, flag: str = "is_rendered") -> DataFrame:
    """Marks the longest beginning of each group whose sizes add up to at most the budget [choice: prefix rule]."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used_chars", F.sum(size).over(w)).withColumn(flag, F.col("used_chars") <= budget)


def split_questions(text: Column, most: int = 4) -> Column:
    """Sub-questions where they are explicit: question marks, semicolons, line breaks, numbering; and of several subjects
    asked about one by one (before 分别), each with the question. At most `most`."""
    marked = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*\d+[.、)]\s*", "\n"), r"([?？])", "$1\n")
    parts = F.filter(F.transform(F.split(marked, r"[;；\n]+"), lambda x: F.trim(x)), lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) > 0)
    before, after = F.substring_index(text, "分别", 1), F.substring_index(text, "分别", -1)
    subjects = F.filter(F.split(before, "[、，和与]+"), lambda x: F.trim(x) != "")
    each = F.transform(subjects, lambda x: F.concat(F.trim(x), F.trim(after)))
    several = F.contains(text, F.lit("分别")) & (F.size(parts) == 1) & (F.size(subjects) > 1)
    return F.slice(F.when(several, each).when(F.size(parts) == 0, F.array(F.trim(text))).otherwise(parts), 1, most)


def intent(question: Column) -> Column:
    """(relation, mode, confidence) of a question by its words [choice of words]."""
    relation = F.when(question.rlike("(?i)difference|关系|区别|zusammen|relación|relate"), "comparison").when(question.rlike("(?i)^(can|may|darf|kann|puede|¿puede)|可以|能否"), "permission").when(question.rlike("(?i)who|which team|谁|wer |quién"), "owner").otherwise("procedure")
    section = question.rlike("§|章|Kapitel|section|sección")
    mode = F.when(section & (relation == "owner"), "graph_only").when(section, "graph_then_evidence").when(relation == "comparison", "graph_assist").otherwise("retrieval")
    return F.struct(relation.alias("relation"), mode.alias("mode"), F.when(relation == "procedure", 0.5).otherwise(0.8).alias("confidence"))


#: Separators from the strongest to the weakest; the last cuts anywhere.
SEPARATORS = (r"\n\s*\n", r"\n", r"(?<=[.!?。！？])\s*", r"(?<=[,;:，；：、])\s*|\s+", None)


def cut_at_separators(text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, str]]:
    """(begin, chunk) of at most size characters. A text that is too long is cut at its strongest separators; parts that
    are still too long at the next weaker ones; neighbours are joined again while they fit. A chunk begins with up to
    `overlap` characters of whole parts of the chunk before it. Together the chunks cover the text."""
    parts: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        low, high, level = todo.pop()
        if high - low <= size - overlap or SEPARATORS[level] is None:
            step = size - overlap
            parts += [(i, min(i + step, high)) for i in range(low, high, step)]
            continue
        at = [low, *(m.end() for m in re.compile(SEPARATORS[level]).finditer(text, low, high) if low < m.end() < high), high]
        todo += [(a, b, level + 1) for a, b in reversed(list(zip(at, at[1:]))) if b > a]
    out, first = [], 0
    while first < len(parts):
        last = first
        begin = parts[first][0]
        if out:
            back = first
            while back and parts[first][0] - parts[back - 1][0] <= overlap:
                back -= 1
            begin = parts[back][0]
        while last + 1 < len(parts) and parts[last + 1][1] - begin <= size:
            last += 1
        out.append((begin, text[begin : parts[last][1]]))
        first = last + 1
    return out


def separator_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_no, begin, chunk_text): recursive chunks of every text that isn't empty, see cut_at_separators."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, n, begin, chunk) for i, t in enumerate(batch.column(1).to_pylist()) for n, (begin, chunk) in enumerate(cut_at_separators(t, size, overlap))]
            row, no, begin, chunk = zip(*found) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(begin, pa.int32()), pa.array(chunk, pa.string())], names=[key, "chunk_no", "begin", "chunk_text"])

    return df.where(F.length(text) > 0).select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_no int, begin int, chunk_text string")
