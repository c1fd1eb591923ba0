"""Further queries: nested results, contracts of model answers, extension points, checkpointed agents, worker ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import extensions as X
from skein.operators import structure as S
from skein.plans.registry import live, live_sql, query
from skein.sources.tables import table

DOCS, CHUNKS, EXCHANGES, STAGES, DIALOGUES = map(live_sql, ["agent_document", "document_chunk", "chat_exchange", "chat_exchange_trace_stage", "chat_dialogue"])


@query(f"""
WITH s AS (SELECT exchange_id, coalesce(nullif(stage_level, 0), 1) AS lvl, coalesce(lower(trim(stage_code)), 'unknown') AS code, id FROM {STAGES}),
c AS (SELECT exchange_id, lvl, code, count(*) AS n, min(id) AS first FROM s GROUP BY ALL)
SELECT exchange_id, lvl::INT AS level, string_agg(code || ':' || n, ',' ORDER BY first) AS groups FROM c GROUP BY 1, 2""")
def nested_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a turn by level, then by stage in order of arrival; level 0 counts as 1, no code as unknown."""
    s = live(spark, d, "chat_exchange_trace_stage", "exchange_id", "stage_level", "stage_code")
    level = F.coalesce(F.nullif(F.col("stage_level").cast("int"), F.lit(0)), F.lit(1))
    by = s.groupBy("exchange_id", level.alias("level"), F.coalesce(F.lower(F.trim("stage_code")), F.lit("unknown")).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    outer = by.groupBy("exchange_id", "level").agg(F.array_sort(F.collect_list(F.struct("first", F.concat_ws(":", "code", F.col("n").cast("string")).alias("g")))).alias("l"))
    return outer.select("exchange_id", "level", F.array_join(F.transform("l", lambda x: x["g"]), ",").alias("groups"))


def prompted(spark: SparkSession, d: str) -> DataFrame:
    """All exchanges with a prompt."""
    return live(spark, d, "chat_exchange", "user_prompt").where(F.length(T.stripped(F.col("user_prompt"))) > 0).select(F.col("id").alias("query_id"), "user_prompt")


PROMPTED = f"(SELECT id AS query_id, user_prompt FROM {EXCHANGES} WHERE length(trim(user_prompt)) > 0)"


@query(f"SELECT query_id, trim(user_prompt) AS rewrite, length(user_prompt) - length(replace(user_prompt, '?', '')) > 1 AS should_split FROM {PROMPTED}")
def rewrite_contract(spark: SparkSession, d: str) -> DataFrame:
    """A model's rewrite as JSON, read back; here the answer is built from the prompt."""
    several = F.length("user_prompt") - F.length(F.replace("user_prompt", F.lit("?"), F.lit(""))) > 1
    answer = F.to_json(F.struct(T.stripped(F.col("user_prompt")).alias("rewrite"), several.alias("should_split"), F.array(F.col("user_prompt")).alias("sub_questions")))
    parsed = F.from_json(answer, "rewrite string, should_split boolean, sub_questions array<string>")
    return prompted(spark, d).select("query_id", parsed.alias("p")).select("query_id", "p.rewrite", "p.should_split")


@query(f"SELECT query_id, 'echo: ' || left(user_prompt, 80) AS reply FROM {PROMPTED}")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a pluggable model; the stand-in echoes."""
    return prompted(spark, d).select("query_id", X.part("chat model", "echo")(F.col("user_prompt")).alias("reply"))


@query()
def model_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a pluggable model for the documents' texts; the stand-in hashes words."""
    return table(spark, d, "documents").select("doc_id", X.part("embedding model", "hashed")(F.col("text")).alias("embedding"))


TERMS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'))"


@query(f"""
WITH p AS (SELECT e.id, {TERMS.format('user_prompt')} AS q, {TERMS.format('reply_content')} AS r FROM {EXCHANGES} e WHERE user_prompt IS NOT NULL AND reply_content IS NOT NULL)
SELECT id, coalesce(round(len(list_intersect(q, r)) / nullif(len(q), 0)::DOUBLE, 6), 0.0) AS score FROM p""")
def reranked_replies(spark: SparkSession, d: str) -> DataFrame:
    """A pluggable reranker's score; the stand-in is the share of the prompt's words in the reply."""
    e = live(spark, d, "chat_exchange", "user_prompt", "reply_content").where("user_prompt is not null and reply_content is not null")
    return e.select("id", F.round(X.part("rerank model", "overlap")(F.col("user_prompt"), F.col("reply_content")), 6).alias("score"))


@query()
def chunk_pipelines(spark: SparkSession, d: str) -> DataFrame:
    """Two ordered pipelines, parents by structure and children by structure then size."""
    docs = table(spark, d, "documents")
    parents = X.pipeline(docs, "doc_id", "text", ["structure"]).withColumn("pipeline", F.lit("PARENT"))
    return parents.unionByName(X.pipeline(docs, "doc_id", "text", ["structure", "recursive"]).withColumn("pipeline", F.lit("CHILD")))


@query("SELECT doc_id, count(*) AS parts, sum(length(line_)) AS chars FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\\n\\s*\\n')) AS line_ FROM (SELECT doc_id, substring(text, (i * 3500 + 1)::INT, 3500) AS t FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 3500 + 1)) AS i FROM documents WHERE length(text) > 0))) WHERE trim(line_) <> '' GROUP BY 1")
def model_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = X.by_model(table(spark, d, "documents"), "doc_id", "text")
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.length("chunk_text")).alias("chars"))


@query(f"""
WITH t AS (SELECT lower(trim(dialogue_code)) AS code, id, ceil(length(coalesce(user_prompt, '')) / 4) + ceil(length(coalesce(reply_content, '')) / 4) AS tokens, row_number() OVER (PARTITION BY lower(trim(dialogue_code)) ORDER BY create_time DESC NULLS LAST, id DESC) AS back FROM {EXCHANGES} WHERE dialogue_code IS NOT NULL)
SELECT code, count_if(back = 1)::BIGINT AS none, count_if(back <= 3)::BIGINT AS sliding, CASE WHEN sum(tokens) > 700 THEN least(count(*), 2) ELSE count(*) END::BIGINT AS summary, (sum(tokens) > 700) AS compressed FROM t GROUP BY code""")
def memory_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Turns that each strategy keeps in full: none but the current, three sliding, or two beside a summary once a
    session has more than 700 tokens."""
    e = live(spark, d, "chat_exchange", "dialogue_code", "user_prompt", "reply_content", "create_time").withColumn("code", T.code_key(F.col("dialogue_code"))).where("code is not null")
    w = Window.partitionBy("code").orderBy(F.desc_nulls_last("create_time"), F.desc("id"))
    t = e.select("code", (T.token_estimate(F.col("user_prompt")) + T.token_estimate(F.col("reply_content"))).alias("tokens"), F.row_number().over(w).alias("back"))
    out = t.groupBy("code").agg(F.count_if(F.col("back") == 1).alias("none"), F.count_if(F.col("back") <= 3).alias("sliding"), F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    return out.select("code", "none", "sliding", F.when(F.col("tokens") > 700, F.least("n", F.lit(2))).otherwise(F.col("n")).cast("bigint").alias("summary"), (F.col("tokens") > 700).alias("compressed"))


@query("""
WITH n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS sections FROM n WHERE regexp_matches(line, '^#\\s') GROUP BY doc_id""")
def outline(spark: SparkSession, d: str) -> DataFrame:
    """The top sections of each text: children of its root that are headings of depth one."""
    nodes = S.structure_nodes(table(spark, d, "documents"), "doc_id", "text")
    root = nodes.where("parent_no is null").select("doc_id", F.col("node_no").alias("parent_no"))
    return nodes.where((F.col("kind") == S.SECTION) & (F.col("depth") == 1)).join(root, ["doc_id", "parent_no"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))


@query(f"SELECT id, CASE WHEN regexp_matches(user_prompt, '§|章|Kapitel|section|sección') THEN 'graph_then_evidence' WHEN length(user_prompt) < 12 THEN 'graph_assist' ELSE 'retrieval' END AS mode FROM {EXCHANGES} WHERE user_prompt IS NOT NULL")
def retrieval_modes(spark: SparkSession, d: str) -> DataFrame:
    """How a question is answered: through the structure tree first, beside it, or by retrieval alone [choice of words]."""
    e = live(spark, d, "chat_exchange", "user_prompt").where("user_prompt is not null")
    mode = F.when(F.col("user_prompt").rlike("§|章|Kapitel|section|sección"), "graph_then_evidence").when(F.length("user_prompt") < 12, "graph_assist").otherwise("retrieval")
    return e.select("id", mode.alias("mode"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 500 ELSE 0 END AS code, CASE WHEN event_type <> 'error' THEN value END AS data FROM events")
def api_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Answers in a {code, message, data} envelope, read back; data of a failed answer is left out."""
    e = table(spark, d, "events")
    raw = F.to_json(F.struct(F.when(F.col("event_type") == "error", 500).otherwise(0).alias("code"), F.col("event_type").alias("message"), F.col("value").alias("data")))
    p = F.from_json(raw, "code int, message string, data double")
    return e.select("event_id", p.alias("p")).select("event_id", "p.code", F.when(F.col("p.code") == 0, F.col("p.data")).alias("data"))


@query("SELECT range AS call, CASE WHEN range < 32 THEN range ELSE 0 END AS worker, CASE WHEN range < 32 THEN 0 ELSE (range - 31) % 32 END AS centre FROM range(64)")
def worker_ids(spark: SparkSession, d: str) -> DataFrame:
    """What the worker counter gives call by call: workers 0 to 31, after which only the centre moves on and the worker
    stays 0."""
    r = spark.range(64).withColumnRenamed("id", "call")
    return r.select("call", F.when(F.col("call") < 32, F.col("call")).otherwise(0).alias("worker"), F.when(F.col("call") < 32, 0).otherwise(F.pmod(F.col("call") - 31, F.lit(32))).alias("centre"))


# a quotient that is exactly halfway between two digits goes up, as in the console; printf would take the even one
@query(f"""SELECT id, CASE WHEN duration_ms IS NULL OR duration_ms <= 0 THEN '-' WHEN duration_ms < 1000 THEN duration_ms || ' ms'
  WHEN duration_ms < 60000 THEN CASE WHEN duration_ms % 1000 = 250 THEN (duration_ms // 1000) || '.3 s' ELSE printf('%.1f s', duration_ms / 1000.0) END
  ELSE CASE WHEN duration_ms % 60000 = 15000 THEN (duration_ms // 60000) || '.3 min' ELSE printf('%.1f min', duration_ms / 60000.0) END END AS shown FROM {STAGES}""")
def shown_durations(spark: SparkSession, d: str) -> DataFrame:
    """Durations as texts."""
    x = F.col("duration_ms")
    shown = F.when(x.isNull() | (x <= 0), "-").when(x < 1000, F.concat(x.cast("string"), F.lit(" ms"))).when(x < 60000, F.concat(T.tenths(x, 1000), F.lit(" s"))).otherwise(F.concat(T.tenths(x, 60000), F.lit(" min")))
    return live(spark, d, "chat_exchange_trace_stage", "duration_ms").select("id", shown.alias("shown"))


@query(f"SELECT dialogue_code, 'messages=' || coalesce(n, 0) || ', focus=' || coalesce(trim(selected_document_name), '') AS context FROM {DIALOGUES} d LEFT JOIN (SELECT lower(trim(dialogue_code)) AS code, count(*) AS n FROM {EXCHANGES} GROUP BY 1) e ON e.code = lower(trim(d.dialogue_code))")
def session_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What a context tool tells an agent about its thread."""
    n = live(spark, d, "chat_exchange", "dialogue_code").groupBy(T.code_key(F.col("dialogue_code")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    own = live(spark, d, "chat_dialogue", "dialogue_code", "selected_document_name").withColumn("code", T.code_key(F.col("dialogue_code"))).join(n, "code", "left")
    messages = F.array_repeat(F.lit(1), F.coalesce(F.col("n"), F.lit(0)).cast("int"))
    return own.select("dialogue_code", X.part("tool", "session context")(messages, F.col("selected_document_name")).alias("context"))
