"""The queries of the data-preparation problems, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import STAND_INS, code_key
from skein.llm import encode, jaccard, mixing, neighbours, pairs, quantiles, repeated_lines, spam_pages, splitting, threads
from skein.operators.versions import in_force
from skein.session import ensure_checkpoint_dir
from skein.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return in_force(table(spark, sf_dir, "document_chunk"), ["chunk_text", *columns])


# 3. near-duplicate chunks


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, copies, near = jaccard.similar_texts(_chunks(spark, sf_dir), "id", "chunk_text", t=0.6, width=3, least=20)
    return jaccard.member_pairs(copies, near, "id", "chunk_id_a", "chunk_id_b")


# 8. token ids


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


# 1. lines repeated in a scope


def _repeated(spark: SparkSession, sf_dir: str):
    documents = in_force(table(spark, sf_dir, "agent_document"), ["knowledge_scope_code"], status=None)
    scopes = documents.select(F.col("id").alias("document_id"), code_key(F.col("knowledge_scope_code")).alias("scope"))
    chunks = _chunks(spark, sf_dir, "document_id")
    return chunks, *repeated_lines.repeated_lines(chunks, scopes, "id", "document_id", "chunk_text", "scope", documents=6, letters=10)


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines, _ = _repeated(spark, sf_dir)
    return lines.select(F.col("row_id").alias("chunk_id"), "line_no")


@query
def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's text without the repeated lines."""
    chunks, lines, _ = _repeated(spark, sf_dir)
    return repeated_lines.without_lines(chunks, lines, "id", "chunk_text").select(F.col("id").alias("chunk_id"), "document_id", "chunk_text")


@query
def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest repeated blocks by length: how many there are, the most documents one spans, and their places."""
    _, _, blocks = _repeated(spark, sf_dir)
    return blocks.groupBy("n_lines").agg(F.count(F.lit(1)).alias("blocks"), F.max("documents").alias("most_documents"), F.sum("n").alias("places"))


# 2. oversized chunks


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir, "document_id", "chunk_no", "parent_block_id")
    return splitting.split_oversized(chunks, "id", "chunk_text", "document_id", "chunk_no", "parent_block_id", 800, 120)


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 1").select(F.col("id").alias("chunk_id"))


SQL["p2_found"] = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY edit_time DESC NULLS LAST) AS rn FROM document_chunk)
SELECT id AS chunk_id FROM ranked
WHERE rn = 1 AND coalesce(status, 1) <> 0 AND length(trim(chunk_text, ' ' || chr(9) || chr(10) || chr(13))) > 800
"""


@query
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves, with their new number in the document."""
    ensure_checkpoint_dir(spark)
    pieces = _pieces(spark, sf_dir).checkpoint()  # they are numbered and returned, but cut once
    numbers = splitting.renumbered(in_force(table(spark, sf_dir, "document_chunk"), ["document_id", "chunk_no"]), pieces, "id", "document_id", "chunk_no")
    return pieces.join(numbers, ["id", "piece_no"]).withColumnRenamed("id", "chunk_id")


@query
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk with enough shingles: its class of equal shingle sets, that class's links, and its group."""
    classes, _, near = jaccard.similar_texts(_chunks(spark, sf_dir), "id", "chunk_text", t=0.6, width=3, least=20)
    return jaccard.groups(classes, near, "id").withColumnRenamed("id", "chunk_id")


# 4. conversations


def _conversations(spark: SparkSession, sf_dir: str):
    dialogues = in_force(table(spark, sf_dir, "chat_dialogue"), ["dialogue_code"])
    exchanges = in_force(table(spark, sf_dir, "chat_exchange"), ["dialogue_code", "user_prompt", "reply_content", "create_time"])
    return threads.rebuilt(dialogues, exchanges, "dialogue_code", "user_prompt", "reply_content", "create_time")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir)[1]


@query
def p4_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the dialogues that stay, from root to leaf."""
    return _conversations(spark, sf_dir)[0]


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_force(table(spark, sf_dir, "chat_exchange_trace_stage"), ["parent_stage_id"])


@query
def p4_stage_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and state of every stage by its own parent pointer."""
    return threads.resolve_threads(_stages(spark, sf_dir), "id", "parent_stage_id").withColumnRenamed("id", "stage_id")


@query
def p4_stage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way from a root to a leaf of the stages' trees."""
    return threads.root_paths(_stages(spark, sf_dir), "id", "parent_stage_id").select("leaf", "depth", F.col("id").alias("stage_id"))


_TREES = """
WITH RECURSIVE v AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY edit_time DESC NULLS LAST) AS rn FROM chat_exchange_trace_stage),
s AS (SELECT id, parent_stage_id AS up FROM v WHERE rn = 1 AND coalesce(status, 1) <> 0),
t AS (
  SELECT id, coalesce(up, id) AS root, CASE WHEN up IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN up IS NULL THEN 'ok' ELSE 'orphan' END AS state
  FROM s WHERE up IS NULL OR up NOT IN (SELECT id FROM s)
  UNION ALL
  SELECT s.id, t.root, t.depth + 1, t.state FROM s JOIN t ON s.up = t.id)
"""
SQL["p4_stage_threads"] = _TREES + "SELECT s.id AS stage_id, root, depth::BIGINT AS depth, coalesce(state, 'cycle') AS state FROM s LEFT JOIN t ON t.id = s.id"
SQL["p4_stage_paths"] = _TREES + """,
w AS (
  SELECT id AS leaf, id, depth FROM t WHERE id NOT IN (SELECT up FROM s WHERE up IS NOT NULL)
  UNION ALL
  SELECT w.leaf, s.up, w.depth - 1 FROM w JOIN s ON s.id = w.id WHERE s.up IN (SELECT id FROM s))
SELECT leaf, depth::BIGINT AS depth, id AS stage_id FROM w
"""
_CONVERSATIONS = """, kept AS (
  SELECT dialogue_code, code FROM dialogues LEFT JOIN verdict USING (code)
  WHERE n IS NOT NULL AND turns AND n % 2 = 0 AND code NOT IN (SELECT code FROM untimed))
SELECT k.dialogue_code, (p.place - 1)::BIGINT AS depth, CASE p.part WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
  CASE p.part WHEN 0 THEN e.user_prompt ELSE e.reply_content END AS text, e.create_time, e.id AS exchange_id
FROM kept k JOIN placed p USING (code) JOIN exchanges e ON e.id = p.id
"""

_STAND_INS = ", ".join(f"'{x}'" for x in STAND_INS)
_BLANK = "(coalesce(regexp_replace(lower({0}), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'), '') IN ('', %s))" % _STAND_INS

_DIALOGUES = f"""
WITH d AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY edit_time DESC NULLS LAST) AS rn FROM chat_dialogue),
dialogues AS (SELECT dialogue_code, lower(trim(dialogue_code)) AS code FROM d WHERE rn = 1 AND coalesce(status, 1) <> 0 AND dialogue_code IS NOT NULL),
e AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY edit_time DESC NULLS LAST) AS rn FROM chat_exchange),
exchanges AS (SELECT *, lower(trim(dialogue_code)) AS code FROM e WHERE rn = 1 AND coalesce(status, 1) <> 0 AND dialogue_code IS NOT NULL),
messages AS (
  SELECT code, create_time, id, 0 AS part FROM exchanges WHERE NOT {_BLANK.format("user_prompt")}
  UNION ALL
  SELECT code, create_time, id, 1 AS part FROM exchanges WHERE NOT {_BLANK.format("reply_content")}),
placed AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY create_time, id, part) AS place FROM messages),
verdict AS (SELECT code, count(*) AS n, bool_and(part = (place - 1) % 2) AS turns FROM placed GROUP BY code),
untimed AS (SELECT DISTINCT code FROM exchanges WHERE create_time IS NULL)
"""
SQL["p4_found"] = _DIALOGUES + """
SELECT dialogue_code FROM dialogues
LEFT JOIN verdict USING (code)
WHERE n IS NULL OR NOT turns OR n % 2 = 1 OR code IN (SELECT code FROM untimed)
"""
SQL["p4_conversations"] = _DIALOGUES + _CONVERSATIONS


# 5. similar vectors


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p5_neighbours(spark, sf_dir)
    return near.select(F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b")).distinct()


@query
def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = in_force(table(spark, sf_dir, "document_embedding"), ["embedding"])
    near = neighbours.similar_vectors(vectors, "id", "embedding", k=5, width=64)
    return near.select(F.col("id").alias("vec_id"), F.col("other").alias("other_id"), "rank", "similarity")


# 6. percentiles

POINTS = [0.5, 0.9, 0.95, 0.99]


def daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(measure, grp, day, bucket, n) of the three latencies: a sketch per group and day."""
    stages = in_force(table(spark, sf_dir, "chat_exchange_trace_stage"), ["stage_code", "duration_ms", "create_time"])
    turns = in_force(table(spark, sf_dir, "chat_exchange"), ["first_token_latency_ms", "total_latency_ms", "create_time"])
    day = F.to_date("create_time").alias("day")
    both = turns.select(day, F.explode(F.array(F.struct(F.lit("first_token_latency_ms").alias("measure"), F.col("first_token_latency_ms").alias("x")), F.struct(F.lit("total_latency_ms").alias("measure"), F.col("total_latency_ms").alias("x")))).alias("m"))
    values = stages.select(F.lit("duration_ms").alias("measure"), F.lower(F.trim("stage_code")).alias("grp"), day, F.col("duration_ms").alias("x"))
    values = values.unionByName(both.select("m.measure", F.lit("all").alias("grp"), "day", "m.x"))
    return quantiles.sketch(values, ["measure", "grp", "day"], "x")


@query
def p6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch of every group and day: what is stored and added up, by days, weeks or for ever."""
    return daily_sketches(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query
def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over all time, from the sketches of single days added up."""
    merged = quantiles.merge(daily_sketches(spark, sf_dir), ["measure", "grp"])
    out = quantiles.percentiles(merged, ["measure", "grp"], POINTS)
    return out.select("measure", "grp", "point", F.col("rank").cast("bigint").alias("rank"), "n", F.round("value", 6).alias("value"))


@query
def p6_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch of each day, to be stored and added up later."""
    out = daily_sketches(spark, sf_dir).groupBy("measure", "grp", "day").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("buckets"), F.min("bucket").alias("least"), F.max("bucket").alias("most"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_G, _O = quantiles.gamma(quantiles.ERROR), quantiles.offset(quantiles.ERROR)
_VALUES = f"""
WITH s AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY edit_time DESC NULLS LAST) AS rn FROM chat_exchange_trace_stage),
e AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY edit_time DESC NULLS LAST) AS rn FROM chat_exchange),
x AS (
  SELECT 'duration_ms' AS measure, lower(trim(stage_code)) AS grp, create_time, duration_ms AS x FROM s WHERE rn = 1 AND coalesce(status, 1) <> 0
  UNION ALL SELECT 'first_token_latency_ms', 'all', create_time, first_token_latency_ms FROM e WHERE rn = 1 AND coalesce(status, 1) <> 0
  UNION ALL SELECT 'total_latency_ms', 'all', create_time, total_latency_ms FROM e WHERE rn = 1 AND coalesce(status, 1) <> 0),
b AS (
  SELECT measure, grp, create_time, CASE WHEN x = 0 THEN 0 ELSE sign(x)::INT * (ceil(ln(abs(x)) / {__import__("math").log(_G)!r}) + {_O})::INT END AS bucket
  FROM x WHERE x IS NOT NULL)
"""
SQL["p6_percentiles"] = _VALUES + f""",
c AS (SELECT measure, grp, bucket, count(*) AS k FROM b GROUP BY ALL),
r AS (
  SELECT *, sum(k) OVER (PARTITION BY measure, grp ORDER BY bucket) AS upto, sum(k) OVER (PARTITION BY measure, grp) AS n FROM c),
p AS (
  SELECT *, greatest(ceil(round(point * n, 6)), 1)::BIGINT AS rank FROM r, (VALUES (0.5::DOUBLE), (0.9), (0.95), (0.99)) AS t(point))
SELECT measure, grp, point::DOUBLE AS point, rank, n::BIGINT AS n,
  round(CASE WHEN bucket = 0 THEN 0.0 ELSE sign(bucket) * pow({_G!r}::DOUBLE, (abs(bucket) - {_O})::DOUBLE) * {2 / (1 + _G)!r} END, 6)::DOUBLE AS value
FROM p WHERE rank <= upto AND rank > upto - k
"""
SQL["p6_sketches"] = _VALUES + """
SELECT measure, grp, strftime(create_time::DATE, '%Y-%m-%d') AS day, bucket, count(*) AS n FROM b GROUP BY ALL
"""
SQL["p6_daily"] = _VALUES + """,
c AS (SELECT measure, grp, create_time::DATE AS day, bucket, count(*) AS k FROM b GROUP BY ALL)
SELECT measure, grp, strftime(day, '%Y-%m-%d') AS day, sum(k)::BIGINT AS n, count(*) AS buckets, min(bucket) AS least, max(bucket) AS most
FROM c GROUP BY measure, grp, c.day
"""


_LINES = """
WITH d AS (
  SELECT id, lower(trim(knowledge_scope_code)) AS scope, row_number() OVER (PARTITION BY id ORDER BY edit_time DESC NULLS LAST) AS rn FROM agent_document),
c AS (
  SELECT id, document_id, chunk_text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edit_time DESC NULLS LAST) AS rn FROM document_chunk) WHERE rn = 1 AND coalesce(status, 1) <> 0),
l AS (
  SELECT c.id AS chunk_id, c.document_id, d.scope, unnest(string_split(c.chunk_text, chr(10))) AS line, generate_subscripts(string_split(c.chunk_text, chr(10)), 1) - 1 AS line_no
  FROM c LEFT JOIN d ON d.id = c.document_id AND d.rn = 1 AND d.scope <> ''),
k AS (SELECT *, regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') AS letters FROM l),
r AS (SELECT scope, letters FROM k WHERE scope IS NOT NULL AND length(letters) >= 10 GROUP BY ALL HAVING count(DISTINCT document_id) >= 6)
"""
SQL["p1_found"] = _LINES + "SELECT chunk_id, line_no::INT AS line_no FROM k JOIN r USING (scope, letters)"
SQL["p1_cleaned"] = _LINES + """, t AS (
  SELECT chunk_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (r.letters IS NULL), '') AS kept, count(r.letters) AS gone
  FROM k LEFT JOIN r ON r.scope = k.scope AND r.letters = k.letters GROUP BY chunk_id)
SELECT c.id AS chunk_id, c.document_id, CASE WHEN gone > 0 THEN kept ELSE c.chunk_text END AS chunk_text FROM c LEFT JOIN t ON t.chunk_id = c.id
"""

#: Every pair by its common triples, through an inverted index: for small tables.
SQL["p3_found"] = """
WITH c AS (
  SELECT id, regexp_extract_all(regexp_replace(lower(chunk_text), '([\u4e00-\u9fff])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+') AS w
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edit_time DESC NULLS LAST) AS rn FROM document_chunk) WHERE rn = 1 AND coalesce(status, 1) <> 0 AND chunk_text IS NOT NULL),
s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM c),
n AS (SELECT id, len(s) AS n FROM s WHERE len(s) >= 20),
t AS (SELECT id, unnest(s) AS t FROM s WHERE len(s) >= 20),
b AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM t x JOIN t y ON x.t = y.t AND x.id < y.id GROUP BY 1, 2)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM b JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE common >= 0.6 * (na.n + nb.n - common)
"""


# 7. broken pairs


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    exchanges = in_force(table(spark, sf_dir, "chat_exchange"), ["user_prompt", "reply_content", "exchange_state"])
    finished = exchanges.where(F.col("exchange_state").isin(2, 3, 4))
    return pairs.defective_pairs(finished, "id", "user_prompt", "reply_content").withColumnRenamed("id", "exchange_id")


# 9. mixtures


def _mixture(spark: SparkSession, sf_dir: str):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), "doc_id", "source", "text")


@query
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of every plan with the stretches of documents in its block."""
    return _mixture(spark, sf_dir)[0].withColumnRenamed("doc", "doc_id")


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of every plan and source."""
    return _mixture(spark, sf_dir)[1]


@query
def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used by each plan: the most passes any of its tokens is in."""
    mixed = _mixture(spark, sf_dir)[0]
    per_block = mixed.groupBy("plan_code", "source", "doc", "block").agg(F.count(F.lit(1)).alias("uses"))
    return per_block.groupBy("plan_code", "source", F.col("doc").alias("doc_id")).agg(F.max("uses").alias("uses"))


# 10. spam pages


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages.label_pages(table(spark, sf_dir, "documents")).where("is_spam").select("doc_id")


@query
def p10_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document by kind of line."""
    return spam_pages.label_pages(table(spark, sf_dir, "documents"))
