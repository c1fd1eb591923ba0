"""Console analytics: dashboards, traces, benchmarks, coverage and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import aggregates as A
from skein.operators import routes
from skein.plans.registry import live, live_sql, query
from skein.sources.tables import table

DOCS, CHUNKS, DIALOGUES, EXCHANGES, STAGES, SCOPES = map(live_sql, ["agent_document", "document_chunk", "chat_dialogue", "chat_exchange", "chat_exchange_trace_stage", "knowledge_scope_node"])
CANDIDATES = "array<struct<documentId:string,score:double>>"


@query(f"SELECT count(*) AS total, count_if(parse_status = 3) AS parsed, count_if(strategy_status = 3) AS confirmed, count_if(index_status = 3) AS indexed FROM {DOCS}")
def document_dashboard(spark: SparkSession, d: str) -> DataFrame:
    docs = live(spark, d, "agent_document", "parse_status", "strategy_status", "index_status")
    return docs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c) == 3).alias(n) for c, n in (("parse_status", "parsed"), ("strategy_status", "confirmed"), ("index_status", "indexed"))])


def _turns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return live(spark, d, "chat_exchange", "dialogue_code", *columns).withColumn("code", T.code_key(F.col("dialogue_code"))).where("code is not null")


@query(f"""
WITH e AS (SELECT lower(trim(dialogue_code)) AS code, exchange_state, row_number() OVER (PARTITION BY lower(trim(dialogue_code)) ORDER BY create_time DESC NULLS LAST, id DESC) AS r FROM {EXCHANGES})
SELECT count(*) AS total, count_if(dialogue_stage = 2) AS running, count_if(chat_mode = 1) AS document_mode, count_if(exchange_state = 3) AS last_failed
FROM {DIALOGUES} LEFT JOIN e ON e.code = lower(trim(dialogue_code)) AND r = 1""")
def session_page_stats(spark: SparkSession, d: str) -> DataFrame:
    last = A.latest(_turns(spark, d, "exchange_state", "create_time"), ["code"], [F.desc_nulls_last("create_time"), F.desc("id")]).select("code", "exchange_state")
    sessions = live(spark, d, "chat_dialogue", "dialogue_code", "dialogue_stage", "chat_mode").withColumn("code", T.code_key(F.col("dialogue_code")))
    return sessions.join(last, "code", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("dialogue_stage") == 2).alias("running"), F.count_if(F.col("chat_mode") == 1).alias("document_mode"), F.count_if(F.col("exchange_state") == 3).alias("last_failed"))


# route traces, built from the turns: an automatic record unless the session is locked to its document, and a shadow record
# where it has selected one, which says whether that is among the best three. Every other turn's shadow record arrives first.


def route_traces(spark: SparkSession, d: str) -> DataFrame:
    """Records of routing: (exchange_id, code, arrival, create_time, mode, confidence, route_status, selected_document_id,
    hit_selected_document, top_documents_json, top_scopes_json, top_topics_json)."""
    turns = _turns(spark, d, "source_snapshot_list", "exchange_state", "create_time", "edit_time").withColumn("c", T.json_list(F.col("source_snapshot_list"), CANDIDATES))
    ranked = F.array_sort("c", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["documentId"] < b["documentId"], -1).otherwise(1))
    docs = live(spark, d, "agent_document", "knowledge_scope_code", "business_category").select(F.col("id").cast("string").alias("doc"), T.filled(T.code_key(F.col("knowledge_scope_code"))).alias("scope"), T.filled(F.trim("business_category")).alias("topic"))
    about = turns.select("id", F.explode("c.documentId").alias("doc")).join(docs, "doc").groupBy("id").agg(F.to_json(F.collect_set("scope")).alias("top_scopes_json"), F.to_json(F.collect_set("topic")).alias("top_topics_json"))
    own = live(spark, d, "chat_dialogue", "dialogue_code", "chat_mode", "selected_document_id").select(T.code_key(F.col("dialogue_code")).alias("code"), "chat_mode", F.col("selected_document_id").cast("string").alias("selected_document_id"))
    rows = turns.withColumn("c", ranked).join(own, "code").join(about, "id", "left")
    confidence = F.get("c", F.lit(0))["score"]
    status = F.when(F.col("exchange_state") == 2, F.when(confidence >= 0.55, "1").otherwise("LOW_CONFIDENCE")).when(F.col("exchange_state") == 3, "3").otherwise(F.lit("stopped"))
    hit = F.when(F.size("c") > 0, F.array_contains(F.slice("c.documentId", 1, 3), F.col("selected_document_id")).cast("int").cast("string"))
    rows = rows.select(F.col("id").alias("exchange_id"), "code", "create_time", "edit_time", confidence.cast("string").alias("confidence"), status.cast("string").alias("route_status"), "selected_document_id", hit.alias("hit"), F.to_json("c").alias("top_documents_json"), "top_scopes_json", "top_topics_json", "chat_mode")
    early = F.when(F.pmod("exchange_id", F.lit(2)) == 0, 0).otherwise(2)
    auto = rows.where("coalesce(chat_mode, 0) <> 1").select("exchange_id", "code", F.lit(1).alias("arrival"), "create_time", F.lit("auto").alias("mode"), "confidence", "route_status", "selected_document_id", F.lit(None).cast("string").alias("hit_selected_document"), "top_documents_json", "top_scopes_json", "top_topics_json")
    shadow = rows.where("selected_document_id is not null").select("exchange_id", "code", early.alias("arrival"), F.col("edit_time").alias("create_time"), F.lit("shadow").alias("mode"), "confidence", "route_status", "selected_document_id", F.col("hit").alias("hit_selected_document"), "top_documents_json", "top_scopes_json", "top_topics_json")
    return auto.unionByName(shadow)


def records(spark: SparkSession, d: str) -> DataFrame:
    return routes.route_records(route_traces(spark, d))


ROUTES = f"""
WITH parsed AS (
  SELECT id, lower(trim(dialogue_code)) AS code, create_time, edit_time, exchange_state, CASE WHEN json_valid(source_snapshot_list) AND json_type(source_snapshot_list) = 'ARRAY' THEN source_snapshot_list::JSON ELSE '[]'::JSON END AS j FROM {EXCHANGES}),
each AS (SELECT id, json_extract_string(x, '$.documentId') AS doc, json_extract_string(x, '$.score')::DOUBLE AS score FROM (SELECT id, unnest(json_extract(j, '$[*]')) AS x FROM parsed)),
docs AS (SELECT id::VARCHAR AS doc, nullif(lower(trim(knowledge_scope_code)), '') AS scope, nullif(trim(business_category), '') AS topic FROM {DOCS}),
best AS (SELECT id, list(doc ORDER BY score DESC, doc) AS ids, max(score) AS top, count(*) AS n FROM each GROUP BY id),
about AS (SELECT id, count(DISTINCT scope) AS scopes, count(DISTINCT topic) AS topics FROM each JOIN docs USING (doc) GROUP BY id),
dlg AS (SELECT lower(trim(dialogue_code)) AS code, chat_mode, selected_document_id::VARCHAR AS selected FROM {DIALOGUES}),
t AS (
  SELECT p.id AS exchange_id, p.code, create_time, edit_time, chat_mode, selected, top AS confidence, coalesce(n, 0) AS n, coalesce(scopes, 0) AS scopes, coalesce(topics, 0) AS topics, ids, ids[1] AS top_document,
    CASE WHEN exchange_state = 2 AND top >= 0.55 THEN 'SUCCESS' WHEN exchange_state = 2 THEN 'LOW_CONFIDENCE' ELSE 'FAILED' END AS route_status,
    CASE WHEN coalesce(n, 0) > 0 THEN list_contains(ids[1:3], selected) END AS hit
  FROM parsed p JOIN dlg USING (code) LEFT JOIN best USING (id) LEFT JOIN about USING (id)),
r AS (
  SELECT *, 'auto' AS mode, create_time AS at_, NULL::BOOLEAN AS hit_, 1 AS arrival FROM t WHERE coalesce(chat_mode, 0) <> 1
  UNION ALL SELECT *, 'shadow', edit_time, hit, CASE WHEN exchange_id % 2 = 0 THEN 0 ELSE 2 END FROM t WHERE selected IS NOT NULL)
"""


@query(ROUTES + """
SELECT count(*) AS total, count_if(mode = 'shadow') AS shadow, count_if(mode = 'auto') AS auto, count_if(route_status = 'SUCCESS') AS success, count_if(route_status = 'LOW_CONFIDENCE') AS low_confidence, count_if(route_status = 'FAILED') AS failed,
  count_if(confidence >= 0.8) AS high, count_if(mode = 'auto' AND confidence < 0.8 AND n >= 5) AS widened, round(avg(confidence), 4) AS avg_confidence, round(avg(n), 6) AS avg_documents, round(avg(topics), 6) AS avg_topics, round(avg(scopes), 6) AS avg_scopes,
  count(DISTINCT top_document) AS top_documents, round(100.0 * count_if(route_status = 'SUCCESS') / nullif(count(*), 0), 6) AS success_rate, round(100.0 * (count_if(route_status = 'LOW_CONFIDENCE') + count_if(route_status = 'FAILED')) / nullif(count(*), 0), 6) AS low_rate,
  round(100.0 * count_if(mode = 'shadow' AND hit_) / nullif(count_if(mode = 'shadow' AND hit_ IS NOT NULL), 0), 6) AS shadow_hit_rate FROM r""")
def route_trace_summary(spark: SparkSession, d: str) -> DataFrame:
    return routes.route_summary(records(spark, d))


@query(ROUTES + "SELECT top_document, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, count_if(route_status <> 'SUCCESS') AS not_success FROM r WHERE top_document IS NOT NULL GROUP BY 1 ORDER BY n DESC, top_document LIMIT 6")
def top_document_distribution(spark: SparkSession, d: str) -> DataFrame:
    by = records(spark, d).where("top_document is not null").groupBy("top_document").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count_if(F.col("route_status") != "SUCCESS").alias("not_success"))
    return by.orderBy(F.desc("n"), "top_document").limit(6)


@query(ROUTES + "SELECT CASE WHEN confidence IS NULL OR confidence <= 0 THEN 'none' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.55 THEN 'usable' ELSE 'widen' END AS band, count(*) AS n, round(avg(round(confidence * 100)), 6) AS avg_percent FROM r GROUP BY 1")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy(T.confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.round(F.col("confidence") * 100)), 6).alias("avg_percent"))


@query(ROUTES + "SELECT mode, CASE WHEN hit_ THEN 'hit' WHEN NOT hit_ THEN 'missed' ELSE 'unknown' END AS hit, count(*) AS n, round(avg(n), 6) AS candidates, round(avg(CASE WHEN confidence >= 0.8 THEN least(n, 3) ELSE least(n, 5) END), 6) AS kept FROM r GROUP BY 1, 2")
def shadow_hits(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("document_count")
    kept = F.when(F.col("confidence") >= routes.HIGH, F.least(n, F.lit(3))).otherwise(F.least(n, F.lit(5)))
    hit = F.when(F.col("hit"), "hit").when(F.col("missed"), "missed").otherwise("unknown")
    return records(spark, d).groupBy("mode", hit.alias("hit")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("candidates"), F.round(F.avg(kept), 6).alias("kept"))


@query(ROUTES + """, s AS (SELECT code, arg_min(top_document, (-confidence, top_document)) AS selected FROM t WHERE top_document IS NOT NULL GROUP BY code)
SELECT exchange_id, s.selected, list_position(ids, s.selected)::INT AS place FROM t JOIN s USING (code) WHERE list_contains(ids, s.selected)""")
def selected_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Where the document that a session's surest turn found first stands among the candidates of its turns."""
    all_ = route_traces(spark, d).drop("selected_document_id").dropDuplicates(["exchange_id"])
    # a session may have neither kind of record: then it has no candidates here
    top = routes.route_records(all_.withColumn("selected_document_id", F.lit(None).cast("string")))
    best = top.where("top_document is not null").groupBy("code").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "top_document"))["top_document"].alias("selected_document_id"))
    found = routes.route_records(all_.join(best, "code"))
    return found.where("selected_place is not null").select("exchange_id", "selected", F.col("selected_place").alias("place"))


KEPT = ", k AS (SELECT *, row_number() OVER (PARTITION BY exchange_id ORDER BY CASE WHEN autos = 0 THEN 0 WHEN exchange_id % 2 = 0 OR coalesce(epoch_us(edit_time), 0) < coalesce(epoch_us(create_time), 0) THEN (mode = 'shadow')::INT ELSE (mode = 'auto')::INT END) AS turn FROM (SELECT *, count_if(mode = 'auto') OVER (PARTITION BY exchange_id) AS autos FROM r))"


@query(ROUTES + KEPT + " SELECT exchange_id, mode, route_status, round(confidence, 6) AS confidence, n::INT AS documents FROM k WHERE turn = 1")
def route_of_exchange(spark: SparkSession, d: str) -> DataFrame:
    """The record that counts for each turn: an automatic one drives out a shadow one, else the later one holds."""
    own = records(spark, d).select("exchange_id", "arrival", "create_time", "mode", "route_status", "confidence", "document_count")
    return routes.record_of_exchange(own, "exchange_id", "arrival", "create_time").select("exchange_id", "mode", "route_status", F.round("confidence", 6).alias("confidence"), F.col("document_count").alias("documents"))


@query(ROUTES + KEPT + ", l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY at_ DESC NULLS LAST, exchange_id DESC) AS place FROM k WHERE turn = 1) SELECT dialogue_code, l.exchange_id, mode, route_status, round(confidence, 6) AS confidence FROM " + DIALOGUES + " LEFT JOIN l ON l.code = lower(trim(dialogue_code)) AND place = 1")
def latest_route_per_dialogue(spark: SparkSession, d: str) -> DataFrame:
    own = records(spark, d).select("exchange_id", "code", "arrival", "create_time", "mode", "route_status", "confidence")
    counted = routes.record_of_exchange(own, "exchange_id", "arrival", "create_time")
    last = A.latest(counted, ["code"], [F.desc_nulls_last("create_time"), F.desc("exchange_id")]).select("code", "exchange_id", "mode", "route_status", F.round("confidence", 6).alias("confidence"))
    sessions = live(spark, d, "chat_dialogue", "dialogue_code").select("dialogue_code", T.code_key(F.col("dialogue_code")).alias("code"))
    return sessions.join(last, "code", "left").drop("code")


@query(ROUTES + """SELECT exchange_id, mode, CASE WHEN mode = 'auto' THEN CASE WHEN n > 0 THEN 'scopes first, then ' || n || ' documents; the first is ' || top_document ELSE 'scopes first; no document stands out' END
  ELSE CASE WHEN n > 0 THEN 'compared only; its first is ' || top_document ELSE 'compared only; no candidate' END END
  || CASE WHEN mode = 'auto' AND confidence < 0.8 AND n >= 5 THEN '; unsure, so widened' ELSE '' END || CASE WHEN mode = 'auto' AND n = 0 THEN '; falls back to all documents' ELSE '' END
  || CASE WHEN mode = 'shadow' AND hit_ THEN '; the selected document is in the first three' WHEN mode = 'shadow' AND NOT hit_ THEN '; the selected document is not in the first three' ELSE '' END AS explained FROM r""")
def route_explained(spark: SparkSession, d: str) -> DataFrame:
    """What a record says, in words."""
    auto, some = F.col("mode") == "auto", F.col("document_count") > 0
    head = F.when(auto & some, F.concat(F.lit("scopes first, then "), F.col("document_count").cast("string"), F.lit(" documents; the first is "), F.col("top_document"))).when(auto, "scopes first; no document stands out").when(some, F.concat(F.lit("compared only; its first is "), F.col("top_document"))).otherwise("compared only; no candidate")
    notes = [F.when(F.col("widened"), "; unsure, so widened"), F.when(auto & ~some, "; falls back to all documents"), F.when(~auto & F.col("hit"), "; the selected document is in the first three").when(~auto & F.col("missed"), "; the selected document is not in the first three")]
    return records(spark, d).select("exchange_id", "mode", F.concat(head, *[F.coalesce(x, F.lit("")) for x in notes]).alias("explained"))


@query(f"""
WITH parsed AS (SELECT id, exchange_state, CASE WHEN json_valid(source_snapshot_list) AND json_type(source_snapshot_list) = 'ARRAY' THEN source_snapshot_list::JSON ELSE '[]'::JSON END AS j FROM {EXCHANGES}),
x AS (SELECT exchange_state, id, json_extract_string(x, '$.score')::DOUBLE AS score FROM (SELECT id, exchange_state, unnest(json_extract(j, '$[*]')) AS x FROM parsed))
SELECT exchange_state, count(*) AS recalled, count_if(score >= 0.45) AS accepted, count(DISTINCT id) AS turns, round(avg(score), 6) AS avg_score, max(score) AS max_score, min(score) AS min_score FROM x GROUP BY exchange_state""")
def channel_execution_stats(spark: SparkSession, d: str) -> DataFrame:
    x = live(spark, d, "chat_exchange", "exchange_state", "source_snapshot_list").select("id", "exchange_state", F.explode(T.json_list(F.col("source_snapshot_list"), CANDIDATES)).alias("c"))
    s = F.col("c.score")
    return x.groupBy("exchange_state").agg(F.count(F.lit(1)).alias("recalled"), F.count_if(s >= 0.45).alias("accepted"), F.count_distinct("id").alias("turns"), F.round(F.avg(s), 6).alias("avg_score"), F.max(s).alias("max_score"), F.min(s).alias("min_score"))


@query(f"""
WITH u AS (SELECT exchange_state, ceil(length(coalesce(user_prompt, '')) / 4)::BIGINT AS p, ceil(length(coalesce(reply_content, '')) / 4)::BIGINT AS c FROM {EXCHANGES})
SELECT exchange_state, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(p + c)::BIGINT AS total_tokens, count(*) AS turns FROM u GROUP BY 1""")
def usage_by_state(spark: SparkSession, d: str) -> DataFrame:
    u = live(spark, d, "chat_exchange", "exchange_state", "user_prompt", "reply_content").select("exchange_state", T.token_estimate(F.col("user_prompt")).alias("p"), T.token_estimate(F.col("reply_content")).alias("c"))
    return u.groupBy("exchange_state").agg(F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.sum(F.col("p") + F.col("c")).alias("total_tokens"), F.count(F.lit(1)).alias("turns"))


# stages


def stages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return live(spark, d, "chat_exchange_trace_stage", "stage_code", "execution_mode", "duration_ms", *columns).withColumn("code", F.lower(F.trim("stage_code"))).withColumn("mode", F.coalesce("execution_mode", F.lit("NONE")))


STAGE_ROWS = f"(SELECT *, lower(trim(stage_code)) AS code, coalesce(execution_mode, 'NONE') AS mode FROM {STAGES})"
POINTS = {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}


def benchmark(rows: DataFrame) -> DataFrame:
    shown = A.exact_percentiles(rows, ["code", "mode"], "duration_ms", POINTS)
    rest = rows.where("duration_ms is not null").groupBy("code", "mode").agg(F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.min("duration_ms").alias("min_ms"))
    return shown.select("code", "mode", *[F.round(c, 6).alias(c) for c in POINTS], "n").withColumnRenamed("n", "samples").join(rest.withColumnsRenamed({"code": "c_", "mode": "m_"}), F.expr("code <=> c_ and mode <=> m_")).drop("c_", "m_")


BENCH = """SELECT code, mode, round(quantile_cont(duration_ms::DOUBLE, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ms::DOUBLE, 0.9), 6) AS p90_ms, round(quantile_cont(duration_ms::DOUBLE, 0.99), 6) AS p99_ms, count(*) AS samples,
  round(avg(duration_ms), 6) AS avg_ms, max(duration_ms) AS max_ms, min(duration_ms) AS min_ms FROM {0} WHERE duration_ms IS NOT NULL GROUP BY code, mode"""


@query(BENCH.format(STAGE_ROWS))
def stage_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return benchmark(stages(spark, d))


RECENT = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, mode ORDER BY start_time DESC NULLS LAST, id DESC) AS place FROM {STAGE_ROWS} WHERE duration_ms IS NOT NULL) WHERE place <= 100)"


@query(BENCH.format(RECENT))
def rolling_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark over the 100 latest durations of each stage and mode [choice: 100]."""
    rows = stages(spark, d, "start_time").where("duration_ms is not null")
    return benchmark(A.latest(rows, ["code", "mode"], [F.desc_nulls_last("start_time"), F.desc("id")], 100))


@query(f"""
WITH b AS ({BENCH.format(STAGE_ROWS)})
SELECT s.code, CASE WHEN duration_ms <= coalesce(p50_ms, 0) THEN 'excellent' WHEN duration_ms <= coalesce(p90_ms, 0) THEN 'good' WHEN duration_ms <= coalesce(p99_ms, 0) THEN 'warning' ELSE 'slow' END AS level, count(*) AS n
FROM {STAGE_ROWS} s LEFT JOIN b ON s.code = b.code AND s.mode = b.mode WHERE duration_ms IS NOT NULL GROUP BY 1, 2""")
def benchmark_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = stages(spark, d).where("duration_ms is not null")
    level = T.duration_level(F.col("duration_ms"), F.col("p50_ms"), F.col("p90_ms"), F.col("p99_ms"))
    # one row per stage and mode; Spark broadcasts it while it is small
    return rows.join(benchmark(rows), ["code", "mode"], "left").groupBy("code", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH t AS (SELECT exchange_id, id, stage_order, duration_ms, max(duration_ms) OVER (PARTITION BY exchange_id) AS most FROM {STAGES})
SELECT exchange_id, id, stage_order, round(greatest(6.0, CASE WHEN most > 0 THEN 100.0 * coalesce(duration_ms, 0) / most ELSE 0 END), 6) AS bar FROM t""")
def stage_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Width of each stage's bar beside the longest of its turn, at least 6 percent."""
    rows = live(spark, d, "chat_exchange_trace_stage", "exchange_id", "stage_order", "duration_ms")
    most = F.max("duration_ms").over(Window.partitionBy("exchange_id"))
    share = F.when(most > 0, F.lit(100.0) * F.coalesce("duration_ms", F.lit(0)) / most).otherwise(0)
    return rows.select("exchange_id", "id", "stage_order", F.round(F.greatest(F.lit(6.0), share), 6).alias("bar"))


@query(f"SELECT c.stage_level, lower(trim(p.stage_code)) AS parent_code, count(*) AS n, sum(c.duration_ms)::BIGINT AS total_ms FROM {STAGES} c LEFT JOIN {STAGES} p ON c.parent_stage_id = p.id GROUP BY 1, 2")
def stage_parents(spark: SparkSession, d: str) -> DataFrame:
    rows = live(spark, d, "chat_exchange_trace_stage", "stage_code", "stage_level", "parent_stage_id", "duration_ms")
    up = rows.select(F.col("id").alias("parent_stage_id"), F.lower(F.trim("stage_code")).alias("parent_code"))
    return rows.join(up, "parent_stage_id", "left").groupBy("stage_level", "parent_code").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms"))


@query(f"""
WITH s AS (SELECT exchange_id, lower(trim(stage_code)) AS code, stage_state FROM {STAGES})
SELECT exchange_id, count_if(stage_state = 3) AS failed, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM s GROUP BY exchange_id""")
def stage_inspector(spark: SparkSession, d: str) -> DataFrame:
    """The stages a turn went through, and how many failed."""
    rows = live(spark, d, "chat_exchange_trace_stage", "exchange_id", "stage_code", "stage_state")
    return rows.groupBy("exchange_id").agg(F.count_if(F.col("stage_state") == 3).alias("failed"), F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("stage_code")))), ",").alias("codes"))


@query(f"""
WITH r AS (SELECT exchange_id, count_if(lower(trim(stage_code)) = 'answer_generate') AS model_calls, count_if(lower(trim(stage_code)) = 'rag_retrieve') AS tool_calls FROM {STAGES} GROUP BY exchange_id)
SELECT CASE WHEN model_calls > 8 OR tool_calls > 6 THEN 'over' WHEN model_calls = 8 OR tool_calls = 6 THEN 'at' ELSE 'under' END AS usage, count(*) AS n, max(model_calls) AS most_model, max(tool_calls) AS most_tool FROM r GROUP BY 1""")
def call_limits(spark: SparkSession, d: str) -> DataFrame:
    """Turns under, at and over the limits of 8 model and 6 tool calls."""
    code = F.lower(F.trim("stage_code"))
    r = live(spark, d, "chat_exchange_trace_stage", "exchange_id", "stage_code").groupBy("exchange_id").agg(F.count_if(code == "answer_generate").alias("m"), F.count_if(code == "rag_retrieve").alias("t"))
    usage = F.when((F.col("m") > 8) | (F.col("t") > 6), "over").when((F.col("m") == 8) | (F.col("t") == 6), "at").otherwise("under")
    return r.groupBy(usage.alias("usage")).agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("most_model"), F.max("t").alias("most_tool"))


@query(f"""
WITH r AS (SELECT lower(trim(dialogue_code)) AS code, count_if(lower(trim(stage_code)) = 'answer_generate') AS model_calls, count_if(lower(trim(stage_code)) = 'rag_retrieve') AS tool_calls FROM {STAGES} WHERE dialogue_code IS NOT NULL GROUP BY 1)
SELECT code, model_calls, tool_calls, greatest(40 - model_calls, 0) AS model_left, greatest(30 - tool_calls, 0) AS tool_left, model_calls >= 40 OR tool_calls >= 30 AS ended FROM r""")
def thread_limits(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a session's 40 model and 30 tool calls."""
    code = F.lower(F.trim("stage_code"))
    rows = live(spark, d, "chat_exchange_trace_stage", "dialogue_code", "stage_code").where("dialogue_code is not null")
    by = rows.groupBy(T.code_key(F.col("dialogue_code")).alias("code")).agg(F.count_if(code == "answer_generate").alias("model_calls"), F.count_if(code == "rag_retrieve").alias("tool_calls"))
    left = lambda c, most: F.greatest(F.lit(most) - F.col(c), F.lit(0))
    return by.select("code", "model_calls", "tool_calls", left("model_calls", 40).alias("model_left"), left("tool_calls", 30).alias("tool_left"), ((F.col("model_calls") >= 40) | (F.col("tool_calls") >= 30)).alias("ended"))


@query(ROUTES + """SELECT exchange_id, mode, array_to_string(ids[1:5], ',') AS documents, least(scopes, 3)::INT AS scopes, least(topics, 3)::INT AS topics FROM r""")
def route_previews(spark: SparkSession, d: str) -> DataFrame:
    """The first five documents, three scopes and three topics of a record."""
    first = lambda c, n: F.slice(T.json_list(F.col(c)), 1, n)
    ids = F.array_join(F.transform(F.slice("documents", 1, 5), lambda x: x["documentId"]), ",")
    return records(spark, d).select("exchange_id", "mode", F.when(F.size("documents") > 0, ids).alias("documents"), F.size(first("top_scopes_json", 3)).alias("scopes"), F.size(first("top_topics_json", 3)).alias("topics"))


@query(ROUTES + """, p AS (SELECT exchange_id, code, coalesce(ids, []) AS ids, coalesce(lag(ids) OVER (PARTITION BY code ORDER BY create_time NULLS FIRST, exchange_id), []) AS before FROM t)
SELECT exchange_id, len(list_filter(list_distinct(ids), lambda x: NOT list_contains(before, x))) AS added, len(list_filter(list_distinct(before), lambda x: NOT list_contains(ids, x))) AS dropped, len(list_distinct(list_concat(ids, before))) AS together FROM p""")
def candidate_sets(spark: SparkSession, d: str) -> DataFrame:
    """What a turn's candidates add to those of the turn before, what they drop, and both together."""
    turns = _turns(spark, d, "source_snapshot_list", "create_time").select("id", "code", "create_time", F.transform(T.json_list(F.col("source_snapshot_list"), CANDIDATES), lambda x: x["documentId"]).alias("ids"))
    own = live(spark, d, "chat_dialogue", "dialogue_code").select(T.code_key(F.col("dialogue_code")).alias("code"))
    none = F.array().cast("array<string>")
    before = F.lag("ids").over(Window.partitionBy("code").orderBy(F.asc_nulls_first("create_time"), "id"))
    p = turns.join(own, "code").withColumn("before", F.coalesce(before, none))
    return p.select(F.col("id").alias("exchange_id"), F.size(F.array_except("ids", "before")).alias("added"), F.size(F.array_except("before", "ids")).alias("dropped"), F.size(F.array_union("ids", "before")).alias("together"))


# sessions and turns


@query(f"SELECT lower(trim(dialogue_code)) AS code, (sum(CASE WHEN coalesce(user_prompt, '') <> '' THEN 1 ELSE 0 END) + sum(CASE WHEN coalesce(reply_content, '') <> '' THEN 1 ELSE 0 END))::BIGINT AS messages, count(*) AS turns FROM {EXCHANGES} WHERE dialogue_code IS NOT NULL GROUP BY 1")
def message_counts(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0)
    return _turns(spark, d, "user_prompt", "reply_content").groupBy("code").agg(F.sum(has("user_prompt") + has("reply_content")).alias("messages"), F.count(F.lit(1)).alias("turns"))


@query(f"""
WITH e AS (SELECT lower(trim(dialogue_code)) AS code, * FROM {EXCHANGES} WHERE dialogue_code IS NOT NULL AND create_time IS NOT NULL),
q AS (SELECT code, arg_max(user_prompt, (create_time, id)) AS prompt FROM e WHERE user_prompt <> '' GROUP BY code),
a AS (SELECT code, arg_max(reply_content, (create_time, id)) AS reply FROM e WHERE reply_content <> '' GROUP BY code)
SELECT coalesce(q.code, a.code) AS code, CASE WHEN length(prompt) > 28 THEN left(prompt, 28) || '...' ELSE prompt END AS title, CASE WHEN length(reply) > 72 THEN left(reply, 72) || '...' ELSE reply END AS preview
FROM q FULL JOIN a ON q.code = a.code""")
def latest_turn(spark: SparkSession, d: str) -> DataFrame:
    """Title and preview of a session: its last question and its last answer that aren't empty."""
    e = _turns(spark, d, "user_prompt", "reply_content", "create_time").where("create_time is not null")
    last = lambda c: F.max(F.when(F.col(c) != "", F.struct("create_time", "id", F.col(c).alias("v"))))["v"]
    by = e.groupBy("code").agg(last("user_prompt").alias("prompt"), last("reply_content").alias("reply")).where("prompt is not null or reply is not null")
    return by.select("code", T.truncated(F.col("prompt"), 28).alias("title"), T.truncated(F.col("reply"), 72).alias("preview"))


@query(f"""
WITH e AS (SELECT lower(trim(dialogue_code)) AS code, max(edit_time) AS e_at FROM {EXCHANGES} GROUP BY 1)
SELECT dialogue_code, strftime(greatest(coalesce(e_at, d.edit_time), coalesce(d.edit_time, e_at)), '%Y-%m-%d %H:%M:%S') AS updated_at FROM {DIALOGUES} d LEFT JOIN e ON e.code = lower(trim(d.dialogue_code))
ORDER BY updated_at DESC NULLS LAST, dialogue_code LIMIT 20 OFFSET 20""")
def session_list_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of sessions, latest first."""
    at = _turns(spark, d, "edit_time").groupBy("code").agg(F.max("edit_time").alias("at"))
    own = live(spark, d, "chat_dialogue", "dialogue_code", "edit_time").withColumn("code", T.code_key(F.col("dialogue_code"))).join(at, "code", "left")
    rows = own.select("dialogue_code", F.date_format(F.greatest("at", "edit_time"), "yyyy-MM-dd HH:mm:ss").alias("updated_at"))
    return A.page(rows, [F.desc_nulls_last("updated_at"), "dialogue_code"], 2, 20)


@query(f"""
WITH e AS (SELECT lower(trim(dialogue_code)) AS code, exchange_state, first_token_latency_ms AS f, total_latency_ms AS t FROM {EXCHANGES} WHERE dialogue_code IS NOT NULL)
SELECT code, count(*) AS turns, count_if(exchange_state = 2) AS done, count_if(exchange_state = 3) AS failed, count_if(exchange_state = 4) AS stopped, round(avg(CASE WHEN f > 0 THEN f END), 6) AS avg_first, max(CASE WHEN t > 0 THEN t END) AS max_total FROM e GROUP BY code""")
def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = _turns(spark, d, "exchange_state", "first_token_latency_ms", "total_latency_ms")
    state = lambda n: F.count_if(F.col("exchange_state") == n)
    own = lambda c: F.when(F.col(c) > 0, F.col(c))
    return e.groupBy("code").agg(F.count(F.lit(1)).alias("turns"), state(2).alias("done"), state(3).alias("failed"), state(4).alias("stopped"), F.round(F.avg(own("first_token_latency_ms")), 6).alias("avg_first"), F.max(own("total_latency_ms")).alias("max_total"))


# documents, scopes, coverage

DOC_SCOPE = f"(SELECT *, nullif(lower(trim(knowledge_scope_code)), '') AS scope FROM {DOCS})"


def scoped(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return live(spark, d, "agent_document", "knowledge_scope_code", *columns).withColumn("scope", T.filled(T.code_key(F.col("knowledge_scope_code"))))


@query(f"""
WITH x AS (SELECT id, scope, business_category, document_tags FROM {DOC_SCOPE})
SELECT id, concat_ws(',', CASE WHEN scope IS NULL THEN 'scope' END, CASE WHEN coalesce(trim(business_category), '') = '' THEN 'category' END, CASE WHEN coalesce(trim(document_tags), '') = '' THEN 'tags' END) AS missing FROM x""")
def metadata_missing(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return scoped(spark, d, "business_category", "document_tags").select("id", F.concat_ws(",", F.when(F.col("scope").isNull(), "scope"), F.when(none("business_category"), "category"), F.when(none("document_tags"), "tags")).alias("missing"))


@query(f"""
WITH x AS (
  SELECT d.id, list_filter([CASE WHEN d.scope IS NULL THEN 'no scope' END, CASE WHEN d.scope IS NOT NULL AND s.scope_code IS NULL THEN 'unknown scope' END, CASE WHEN coalesce(trim(business_category), '') = '' THEN 'no category' END,
    CASE WHEN coalesce(trim(document_tags), '') = '' THEN 'no tags' END, CASE WHEN c.document_id IS NULL THEN 'no chunks' END], lambda v: v IS NOT NULL) AS a
  FROM {DOC_SCOPE} d LEFT JOIN (SELECT DISTINCT lower(trim(scope_code)) AS scope_code FROM {SCOPES}) s ON d.scope = s.scope_code LEFT JOIN (SELECT DISTINCT document_id FROM {CHUNKS}) c ON c.document_id = d.id)
SELECT id, array_to_string(a, ',') AS anomalies, CASE WHEN len(a) >= 3 THEN 'danger' WHEN len(a) > 0 THEN 'warning' ELSE 'ok' END AS severity, coalesce(a[1], 'none') AS suggestion FROM x""")
def document_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Five rules per document; three or more make it dangerous, the first names the suggestion."""
    codes = live(spark, d, "knowledge_scope_node", "scope_code").select(T.code_key(F.col("scope_code")).alias("scope"), F.lit(True).alias("known")).distinct()
    chunks = live(spark, d, "document_chunk", "document_id").select(F.col("document_id").alias("id"), F.lit(True).alias("chunked")).distinct()
    none = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    x = scoped(spark, d, "business_category", "document_tags").join(codes, "scope", "left").join(chunks, "id", "left")
    rules = F.array(F.when(F.col("scope").isNull(), "no scope"), F.when(F.col("scope").isNotNull() & F.col("known").isNull(), "unknown scope"), F.when(none("business_category"), "no category"), F.when(none("document_tags"), "no tags"), F.when(F.col("chunked").isNull(), "no chunks"))
    x = x.select("id", F.filter(rules, lambda v: v.isNotNull()).alias("a"))
    return x.select("id", F.array_join("a", ",").alias("anomalies"), F.when(F.size("a") >= 3, "danger").when(F.size("a") > 0, "warning").otherwise("ok").alias("severity"), F.coalesce(F.get("a", F.lit(0)), F.lit("none")).alias("suggestion"))


TOPICS = f"(SELECT DISTINCT scope, lower(trim(business_category)) AS topic FROM {DOC_SCOPE} WHERE scope IS NOT NULL AND coalesce(trim(business_category), '') <> '')"


@query(f"""
WITH s AS (SELECT lower(trim(scope_code)) AS scope FROM {SCOPES}),
d AS (SELECT scope, count(*) AS documents, count_if(index_status = 3) AS covered FROM {DOC_SCOPE} GROUP BY scope),
t AS (SELECT scope, count(*) AS topics FROM {TOPICS} GROUP BY scope)
SELECT s.scope, coalesce(documents, 0) AS documents, coalesce(covered, 0) AS covered, greatest(0, coalesce(documents, 0) - coalesce(covered, 0)) AS pending, coalesce(topics, 0) AS topics, coalesce(round(100.0 * covered / nullif(documents, 0), 6), 0) AS coverage
FROM s LEFT JOIN d USING (scope) LEFT JOIN t USING (scope)""")
def scope_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents, indexed ones, and topics of every scope; scopes without documents have zeros."""
    docs = scoped(spark, d, "index_status", "business_category")
    by = docs.groupBy("scope").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("index_status") == 3).alias("covered"), F.count_distinct(T.filled(F.lower(F.trim("business_category")))).alias("topics"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "covered", "topics")]
    rows = live(spark, d, "knowledge_scope_node", "scope_code").select(T.code_key(F.col("scope_code")).alias("scope")).join(by, "scope", "left").select("scope", *zero)
    return rows.withColumn("pending", F.greatest(F.lit(0), F.col("documents") - F.col("covered"))).withColumn("coverage", F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col("covered"), F.col("documents")), 6), F.lit(0.0)))


@query(f"""
WITH n AS (SELECT lower(trim(scope_code)) AS scope FROM {SCOPES}), u AS (SELECT DISTINCT scope FROM {DOC_SCOPE} WHERE scope IS NOT NULL)
SELECT count(*) AS scopes, count(u.scope) AS used, round(100.0 * count(u.scope) / nullif(count(*), 0), 6) AS coverage FROM n LEFT JOIN u USING (scope)""")
def overall_coverage(spark: SparkSession, d: str) -> DataFrame:
    used = scoped(spark, d).select("scope", F.lit(1).alias("u")).distinct()
    rows = live(spark, d, "knowledge_scope_node", "scope_code").select(T.code_key(F.col("scope_code")).alias("scope")).join(used, "scope", "left")
    return rows.agg(F.count(F.lit(1)).alias("scopes"), F.count("u").alias("used"), F.round(F.try_divide(F.lit(100.0) * F.count("u"), F.count(F.lit(1))), 6).alias("coverage"))


@query(f"SELECT lower(trim(business_category)) AS topic, count(*) AS relations, count(DISTINCT scope) AS scopes, round(avg(CASE WHEN token_count > 0 THEN token_count END), 6) AS mean_tokens FROM {DOC_SCOPE} WHERE coalesce(trim(business_category), '') <> '' GROUP BY 1")
def topic_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = scoped(spark, d, "business_category", "token_count").withColumn("topic", T.filled(F.lower(F.trim("business_category")))).where("topic is not null")
    return docs.groupBy("topic").agg(F.count(F.lit(1)).alias("relations"), F.count_distinct("scope").alias("scopes"), F.round(F.avg(F.when(F.col("token_count") > 0, F.col("token_count"))), 6).alias("mean_tokens"))


@query(f"SELECT id, document_name FROM {DOCS} d WHERE NOT EXISTS (SELECT 1 FROM {CHUNKS} c WHERE c.document_id = d.id)")
def unchunked_documents(spark: SparkSession, d: str) -> DataFrame:
    chunks = live(spark, d, "document_chunk", "document_id").select(F.col("document_id").alias("id"))
    return live(spark, d, "agent_document", "document_name").join(chunks, "id", "left_anti").select("id", "document_name")


@query(f"SELECT id, scope_code FROM {SCOPES} s WHERE lower(trim(scope_code)) IN (SELECT scope FROM {DOC_SCOPE} WHERE scope IS NOT NULL)")
def used_scopes(spark: SparkSession, d: str) -> DataFrame:
    used = scoped(spark, d).select("scope").where("scope is not null")
    return live(spark, d, "knowledge_scope_node", "scope_code").withColumn("scope", T.code_key(F.col("scope_code"))).join(used, "scope", "left_semi").select("id", "scope_code")


@query(f"""
SELECT (SELECT count(*) FROM {DOCS}) AS documents, (SELECT count(*) FROM {SCOPES}) AS scopes, (SELECT count(*) FROM {DOC_SCOPE} WHERE scope IS NULL) AS without_scope,
  (SELECT count(*) FROM {DOCS} WHERE coalesce(trim(business_category), '') = '') AS without_category, (SELECT count(*) FROM {DOCS} WHERE coalesce(trim(document_tags), '') = '') AS without_tags, (SELECT count(*) FROM {DOCS} WHERE coalesce(char_count, 0) = 0) AS without_text""")
def metadata_summary(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    docs = scoped(spark, d, "business_category", "document_tags", "char_count").agg(F.count_if(F.coalesce("char_count", F.lit(0)) == 0).alias("without_text"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("scope").isNull()).alias("without_scope"), F.count_if(none("business_category")).alias("without_category"), F.count_if(none("document_tags")).alias("without_tags"))
    return docs.crossJoin(live(spark, d, "knowledge_scope_node").agg(F.count(F.lit(1)).alias("scopes")))  # one row each


@query(f"SELECT id, document_name FROM {DOCS} WHERE contains(lower(concat_ws(' ', nullif(document_name, ''), nullif(original_file_name, ''), nullif(business_category, ''), nullif(document_tags, ''))), 'policy') AND index_status = 3")
def keyword_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = live(spark, d, "agent_document", "document_name", "original_file_name", "business_category", "document_tags", "index_status")
    search = [F.col(c) for c in ("document_name", "original_file_name", "business_category", "document_tags")]
    return docs.where(T.any_contains(search, " Policy ") & T.chosen(F.col("index_status"), "3") & T.chosen(F.col("business_category"), "ALL")).select("id", "document_name")


@query(f"SELECT id, document_name, (SELECT greatest(1, ceil(count(*) / 12.0))::BIGINT FROM {DOCS}) AS pages FROM {DOCS} ORDER BY create_time DESC NULLS LAST, id LIMIT 12 OFFSET 24")
def document_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of twelve, with the number of pages."""
    docs = live(spark, d, "agent_document", "document_name", "create_time")
    pages = docs.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / 12)).cast("bigint").alias("pages"))
    return A.page(docs, [F.desc_nulls_last("create_time"), "id"], 3, 12).select("id", "document_name").crossJoin(pages)  # one row


FILE_TYPES = {"1": "PDF", "2": "DOC", "3": "DOCX", "4": "TXT", "5": "MD", "6": "HTML"}


@query(f"""
SELECT id, CASE file_type WHEN 1 THEN 'PDF' WHEN 2 THEN 'DOC' WHEN 3 THEN 'DOCX' WHEN 4 THEN 'TXT' WHEN 5 THEN 'MD' WHEN 6 THEN 'HTML' ELSE coalesce(file_type::VARCHAR, '-') END AS kind, coalesce(index_status::VARCHAR, '') = '3' AS is_indexed,
  CASE WHEN file_size IS NULL OR file_size <= 0 THEN '-' WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN printf('%.1f KB', file_size / 1024.0) WHEN file_size < 1073741824 THEN printf('%.1f MB', file_size / 1048576.0) ELSE printf('%.1f GB', file_size / 1073741824.0) END AS size
FROM {DOCS}""")
def document_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = live(spark, d, "agent_document", "file_type", "index_status", "file_size")
    return docs.select("id", T.label(F.col("file_type"), FILE_TYPES, "-").alias("kind"), (F.coalesce(F.col("index_status").cast("string"), F.lit("")) == "3").alias("is_indexed"), T.file_size(F.col("file_size")).alias("size"))


@query(f"SELECT id, CASE exchange_state WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'DONE' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'STOPPED' END AS turn_status, exchange_state IS NOT NULL AS has_answer FROM {EXCHANGES} WHERE exchange_state IS NOT NULL")
def turn_status(spark: SparkSession, d: str) -> DataFrame:
    e = live(spark, d, "chat_exchange", "exchange_state").where("exchange_state is not null")
    return e.select("id", T.strict_label(F.col("exchange_state"), {"1": "RUNNING", "2": "DONE", "3": "FAILED", "4": "STOPPED"}).alias("turn_status"), F.col("exchange_state").isNotNull().alias("has_answer"))


@query(f"SELECT id, coalesce(scope, '') AS scope, coalesce(file_size::VARCHAR, '') AS size, coalesce(business_category, '') AS category, len(list_filter(list_transform(string_split(coalesce(document_tags, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS tags, coalesce(index_status = 3, FALSE) AS indexed, coalesce(strftime(edit_time, '%Y-%m-%d %H:%M:%S'), '') AS edited FROM {DOC_SCOPE}")
def null_policy(spark: SparkSession, d: str) -> DataFrame:
    """Null texts, numbers and times come out as empty text, null lists as empty ones, null flags as false."""
    docs = scoped(spark, d, "file_size", "business_category", "document_tags", "index_status", "edit_time")
    return docs.select("id", F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce(F.col("file_size").cast("string"), F.lit("")).alias("size"), F.coalesce("business_category", F.lit("")).alias("category"), F.size(T.csv_list(F.col("document_tags"))).alias("tags"), F.coalesce(F.col("index_status") == 3, F.lit(False)).alias("indexed"), F.coalesce(F.date_format("edit_time", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("edited"))


@query(f"SELECT id, regexp_matches(lower(user_prompt), 'today|latest|current|now|heute|aktuell|hoy|actual|今天|最新|当前') AS fresh FROM {EXCHANGES} WHERE user_prompt IS NOT NULL")
def freshness_flags(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that ask for what holds now [choice of words]."""
    e = live(spark, d, "chat_exchange", "user_prompt").where("user_prompt is not null")
    return e.select("id", F.lower("user_prompt").rlike("today|latest|current|now|heute|aktuell|hoy|actual|今天|最新|当前").alias("fresh"))


@query(f"SELECT s.id, s.scope_code, len(list_filter(list_transform(string_split(coalesce(aliases, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS aliases, CASE WHEN json_valid(example_questions) AND json_type(example_questions) = 'ARRAY' THEN json_array_length(example_questions)::INT ELSE 0 END AS examples FROM {SCOPES} s")
def scope_lists(spark: SparkSession, d: str) -> DataFrame:
    s = live(spark, d, "knowledge_scope_node", "scope_code", "aliases", "example_questions")
    return s.select("id", "scope_code", F.size(T.csv_list(F.col("aliases"))).alias("aliases"), F.size(T.json_list(F.col("example_questions"))).alias("examples"))


# chunks and parents


@query(f"SELECT count(DISTINCT parent_block_id) AS parents, count_if(vector_status = 3) AS ready, count_if(vector_status <> 3) AS pending, round(avg(token_count))::BIGINT AS mean_tokens, count(*) AS chunks FROM {CHUNKS}")
def chunk_page_stats(spark: SparkSession, d: str) -> DataFrame:
    c = live(spark, d, "document_chunk", "parent_block_id", "vector_status", "token_count")
    return c.agg(F.count_distinct("parent_block_id").alias("parents"), F.count_if(F.col("vector_status") == 3).alias("ready"), F.count_if(F.col("vector_status") != 3).alias("pending"), F.round(F.avg("token_count")).cast("bigint").alias("mean_tokens"), F.count(F.lit(1)).alias("chunks"))


@query(f"SELECT document_id, coalesce(nullif(parent_block_id, 0)::VARCHAR, 'unbound-' || id) AS parent_key, string_agg(chunk_no::VARCHAR, ',' ORDER BY chunk_no, id) AS chunk_nos, count(*) AS n FROM {CHUNKS} GROUP BY 1, 2")
def chunk_groups(spark: SparkSession, d: str) -> DataFrame:
    """Chunks under their parents in order; a chunk without a parent is a group of its own."""
    c = live(spark, d, "document_chunk", "document_id", "parent_block_id", "chunk_no")
    name = F.coalesce(F.nullif("parent_block_id", F.lit(0)).cast("string"), F.concat(F.lit("unbound-"), F.col("id").cast("string")))
    by = c.groupBy("document_id", name.alias("parent_key")).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "id"))).alias("own"), F.count(F.lit(1)).alias("n"))
    return by.select("document_id", "parent_key", F.array_join(F.transform("own", lambda x: x["chunk_no"].cast("string")), ",").alias("chunk_nos"), "n")


@query(f"SELECT parent_block_id, count(*) AS child_count, min(chunk_no) AS start_chunk_no, max(chunk_no) AS end_chunk_no, sum(length(chunk_text))::BIGINT AS char_count, sum(coalesce(token_count, 0))::BIGINT AS token_count FROM {CHUNKS} WHERE parent_block_id IS NOT NULL GROUP BY 1")
def parent_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = live(spark, d, "document_chunk", "parent_block_id", "chunk_no", "chunk_text", "token_count").where("parent_block_id is not null")
    return c.groupBy("parent_block_id").agg(F.count(F.lit(1)).alias("child_count"), F.min("chunk_no").alias("start_chunk_no"), F.max("chunk_no").alias("end_chunk_no"), F.sum(F.length("chunk_text")).alias("char_count"), F.sum(F.coalesce("token_count", F.lit(0))).alias("token_count"))


@query(f"SELECT id, chunk_no - min(chunk_no) OVER (PARTITION BY parent_block_id) + 1 AS place, count(*) OVER (PARTITION BY parent_block_id) AS siblings, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id, lpad((row_number() OVER w)::VARCHAR, 2, '0') AS label FROM {CHUNKS} WHERE parent_block_id IS NOT NULL WINDOW w AS (PARTITION BY parent_block_id ORDER BY chunk_no NULLS FIRST, id)")
def chunk_siblings(spark: SparkSession, d: str) -> DataFrame:
    c = live(spark, d, "document_chunk", "parent_block_id", "chunk_no").where("parent_block_id is not null")
    whole = Window.partitionBy("parent_block_id")
    w = whole.orderBy("chunk_no", "id")
    number = F.row_number().over(w).cast("string")
    return c.select("id", (F.col("chunk_no") - F.min("chunk_no").over(whole) + 1).alias("place"), F.count(F.lit(1)).over(whole).alias("siblings"), F.lag("id").over(w).alias("previous_id"), F.lead("id").over(w).alias("next_id"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(F.left(number, F.lit(2))).alias("label"))


@query(f"SELECT c.id, c.chunk_no, v.embedding_model, len(v.embedding) AS width FROM {CHUNKS} c JOIN {live_sql('document_embedding')} v ON c.id = v.id")
def chunk_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = live(spark, d, "document_embedding", "embedding_model", "embedding").select("id", "embedding_model", F.size("embedding").alias("width"))
    return live(spark, d, "document_chunk", "chunk_no").join(v, "id").select("id", "chunk_no", "embedding_model", F.when(F.col("width") >= 0, F.col("width")).alias("width"))


@query(f"""
WITH p AS (SELECT * FROM document_parent_block WHERE coalesce(status, 1) <> 0)
SELECT p.id, p.parent_no, count(c.id) AS children, p.child_count AS stored FROM (SELECT DISTINCT id, parent_no, child_count FROM p) p LEFT JOIN {CHUNKS} c ON c.parent_block_id = p.id GROUP BY ALL""")
def parent_children(spark: SparkSession, d: str) -> DataFrame:
    """Stored and found numbers of children."""
    p = table(spark, d, "document_parent_block").where("coalesce(status, 1) <> 0").select("id", "parent_no", "child_count").distinct()
    c = live(spark, d, "document_chunk", "parent_block_id").groupBy("parent_block_id").agg(F.count(F.lit(1)).alias("children"))
    return p.join(c, p["id"] == c["parent_block_id"], "left").select("id", "parent_no", F.coalesce("children", F.lit(0)).alias("children"), F.col("child_count").alias("stored"))


@query(f"SELECT d.id, d.last_index_task_id, count(c.id) AS chunks FROM {DOCS} d LEFT JOIN {CHUNKS} c ON c.document_id = d.id AND c.task_id = d.last_index_task_id GROUP BY 1, 2")
def current_task_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the chunks of the index task it points to."""
    c = live(spark, d, "document_chunk", "document_id", "task_id").groupBy(F.col("document_id").alias("id"), F.col("task_id").alias("last_index_task_id")).agg(F.count(F.lit(1)).alias("chunks"))
    return live(spark, d, "agent_document", "last_index_task_id").join(c, ["id", "last_index_task_id"], "left").select("id", "last_index_task_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query(f"SELECT document_id, string_agg(DISTINCT source_type::VARCHAR, '|' ORDER BY source_type::VARCHAR) AS signature, count(*) AS n FROM {CHUNKS} GROUP BY 1")
def strategy_signature(spark: SparkSession, d: str) -> DataFrame:
    c = live(spark, d, "document_chunk", "document_id", "source_type")
    return c.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("source_type").cast("string"))), "|").alias("signature"), F.count(F.lit(1)).alias("n"))
