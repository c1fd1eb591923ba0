"""Further console and retrieval queries: indexes over structure and routes, topic relations, evidence per sub-question,
row states, formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import ids as I
from skein.functions import text as T
from skein.operators import extensions as X
from skein.operators import retrieval as R
from skein.operators import routes
from skein.operators import structure as S
from skein.operators.joins import with_keys
from skein.plans import search
from skein.plans.registry import live, live_sql, query
from skein.plans.search import ASKED, HYBRID, NEAR, NODES_SQL, POSTINGS, ROUTED, TOKENS, bm25_sql
from skein.session import ensure_checkpoint_dir, work_folder
from skein.sources.tables import event_time, table
from skein.streaming import folds

DOCS, CHUNKS, EXCHANGES, DIALOGUES, SCOPES, STAGES, BLOCKS = map(live_sql, ["agent_document", "document_chunk", "chat_exchange", "chat_dialogue", "knowledge_scope_node", "chat_exchange_trace_stage", "document_parent_block"])


# indexes


@query(f"{NODES_SQL}, w AS (SELECT doc_id, node_no, kind, unnest({TOKENS.format('title')}) AS term FROM node) SELECT term, doc_id, node_no, any_value(kind)::INT AS kind, count(*) AS tf FROM w GROUP BY term, doc_id, node_no")
def navigation_index(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index over the titles of sections, steps and items."""
    nodes = S.structure_nodes(table(spark, d, "documents"), "doc_id", "text")
    words = nodes.select("doc_id", "node_no", "kind", F.explode(R.tokens(F.col("title"))).alias("term"))
    return words.groupBy("term", "doc_id", "node_no").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("tf"))


TAGS = "list_filter(list_transform(string_split(coalesce(document_tags, ''), ','), lambda x: lower(trim(x))), lambda x: x <> '')"
ROUTE_TERMS = f"""
WITH m AS (
  SELECT 'scope' AS level, scope_code AS name, unnest({TOKENS.format("concat_ws(' ', scope_name, aliases, example_questions)")}) AS term FROM {SCOPES}
  UNION ALL SELECT 'topic', tag, unnest({TOKENS.format('tag')}) FROM (SELECT DISTINCT unnest({TAGS}) AS tag FROM {DOCS})
  UNION ALL SELECT 'document', id::VARCHAR, unnest({TOKENS.format('document_name')}) FROM {DOCS})"""


def _tags(spark: SparkSession, d: str, *more: str) -> DataFrame:
    tags = F.transform(T.csv_list(F.col("document_tags")), lambda x: F.lower(x))
    return live(spark, d, "agent_document", "document_tags", "knowledge_scope_code", *more).select(F.col("id").alias("document_id"), T.filled(T.code_key(F.col("knowledge_scope_code"))).alias("scope"), tags.alias("tags"), *more)


def _scope_texts(spark: SparkSession, d: str) -> DataFrame:
    c = live(spark, d, "knowledge_scope_node", "scope_code", "scope_name", "aliases", "example_questions")
    return c.select(F.col("scope_code").alias("name"), F.concat_ws(" ", "scope_name", "aliases", "example_questions").alias("t"))


def _topic_names(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select(F.explode("tags").alias("name")).distinct()


@query(ROUTE_TERMS + " SELECT term, level, name, count(*) AS tf FROM m GROUP BY ALL")
def route_index(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index over what a route can lead to: scopes with aliases and example questions, topics, documents."""
    scopes = _scope_texts(spark, d).select(F.lit("scope").alias("level"), "name", "t")
    topics = _topic_names(spark, d).select(F.lit("topic").alias("level"), "name", F.col("name").alias("t"))
    docs = live(spark, d, "agent_document", "document_name").select(F.lit("document").alias("level"), F.col("id").cast("string").alias("name"), F.col("document_name").alias("t"))
    words = scopes.unionByName(topics).unionByName(docs).select("level", "name", F.explode(R.tokens(F.col("t"))).alias("term"))
    return words.groupBy("term", "level", "name").agg(F.count(F.lit(1)).alias("tf"))


# topics: a document's tags; its relation to the first of them counts 1, to the second 1/2 and so on


RELATIONS = f"""
WITH tagged AS (SELECT id AS document_id, nullif(lower(trim(knowledge_scope_code)), '') AS scope, {TAGS} AS tags FROM {DOCS}),
rel AS (SELECT document_id, topic, round(max(1.0 / place), 4) AS score FROM (SELECT document_id, unnest(tags) AS topic, generate_subscripts(tags, 1) AS place FROM tagged) GROUP BY document_id, topic),
topics AS (SELECT topic, count(DISTINCT scope) AS scopes, min(scope) AS first_scope FROM (SELECT scope, unnest(tags) AS topic FROM tagged) GROUP BY topic)"""


def relations(spark: SparkSession, d: str) -> DataFrame:
    rows = _tags(spark, d).select("document_id", F.posexplode("tags").alias("place", "topic"))
    return rows.groupBy("document_id", "topic").agg(F.round(F.max(1.0 / (F.col("place") + 1)), 4).alias("score"))


def topics(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("scope", F.explode("tags").alias("topic")).groupBy("topic").agg(F.count_distinct("scope").alias("scopes"), F.min("scope").alias("first_scope"))


@query(RELATIONS + " SELECT document_id, topic, score::DOUBLE AS score FROM rel")
def topic_relations(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their topics with a score."""
    return relations(spark, d)


@query(RELATIONS + " SELECT document_id, rel.topic, first_scope FROM rel LEFT JOIN topics ON topics.topic = rel.topic AND first_scope < 'm'")
def relation_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Relations with the scope of their topic, which a filter on scopes may leave out."""
    some = topics(spark, d).where("first_scope < 'm'").select("topic", "first_scope")
    return relations(spark, d).select("document_id", "topic").join(some, "topic", "left")


@query(RELATIONS + " SELECT topic, scopes FROM topics WHERE topic IN (SELECT topic FROM rel WHERE document_id % 3 = 0)")
def topics_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """The topics that chosen documents have, by a semi join through the relations."""
    chosen = relations(spark, d).where("document_id % 3 = 0").select("topic")
    return topics(spark, d).select("topic", "scopes").join(chosen, "topic", "left_semi")


@query(RELATIONS + f", every AS (SELECT DISTINCT unnest({TAGS}) AS topic FROM agent_document) SELECT count(*) AS topics, count(r.topic) AS related, coalesce(round(100.0 * count(r.topic) / nullif(count(*), 0), 6), 0.0) AS coverage FROM every LEFT JOIN (SELECT DISTINCT topic FROM rel) r USING (topic)")
def topic_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of all topics ever used that a document in force has; 0 without topics."""
    every = table(spark, d, "agent_document").select(F.explode(F.transform(T.csv_list(F.col("document_tags")), lambda x: F.lower(x))).alias("topic")).distinct()
    both = every.join(relations(spark, d).select("topic", F.lit(1).alias("r")).distinct(), "topic", "left")
    n = F.count(F.lit(1))
    return both.agg(n.alias("topics"), F.count("r").alias("related"), F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.count("r"), n), 6), F.lit(0.0)).alias("coverage"))


@query(RELATIONS + " SELECT topic, count(*) AS relations, count(DISTINCT document_id) AS documents, round(avg(score), 6)::DOUBLE AS mean_score FROM rel GROUP BY topic")
def topic_scores(spark: SparkSession, d: str) -> DataFrame:
    """Relations, documents and mean score of each topic, over scores that are numbers."""
    return relations(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("relations"), F.count_distinct("document_id").alias("documents"), F.round(F.avg(routes.finite(F.col("score"))), 6).alias("mean_score"))


# routing: scopes by name, aliases and example questions; their topics; documents of both


FUNNEL = ROUTE_TERMS + f""", q AS (SELECT DISTINCT query_id, unnest({TOKENS.format('user_prompt')}) AS term FROM {ROUTED}),
dm AS (SELECT DISTINCT level, name, term FROM m),
hit AS (SELECT query_id, level, name, count(*) AS shared FROM q JOIN dm USING (term) GROUP BY ALL),
tagged AS (SELECT id::VARCHAR AS name, lower(trim(knowledge_scope_code)) AS scope, {TAGS} AS tags FROM {DOCS} WHERE coalesce(trim(knowledge_scope_code), '') <> ''),
dh AS (SELECT query_id, name, scope, tags, shared FROM hit JOIN tagged USING (name) WHERE level = 'document'),
sc AS (SELECT query_id, scope, sum(direct) AS direct, sum(through) AS through FROM (SELECT query_id, lower(trim(name)) AS scope, shared AS direct, 0 AS through FROM hit WHERE level = 'scope' UNION ALL SELECT query_id, scope, 0, shared FROM dh) GROUP BY ALL),
sr AS (SELECT *, 2 * direct + through AS scope_score, row_number() OVER (PARTITION BY query_id ORDER BY 2 * direct + through DESC, scope) AS scope_rank FROM sc QUALIFY scope_rank <= 3),
tp AS (SELECT query_id, scope, topic, sum(shared) AS shared FROM (SELECT query_id, scope, unnest(list_distinct(tags)) AS topic, shared FROM dh JOIN sr USING (query_id, scope)) GROUP BY ALL),
tr AS (SELECT t.query_id, t.scope, t.topic, t.shared + coalesce(h.shared, 0) AS topic_score, row_number() OVER (PARTITION BY t.query_id ORDER BY t.shared + coalesce(h.shared, 0) DESC, t.topic, t.scope) AS topic_rank FROM tp t LEFT JOIN hit h ON h.query_id = t.query_id AND h.level = 'topic' AND h.name = t.topic QUALIFY topic_rank <= 5)"""


@query(FUNNEL + """, cand AS (SELECT dh.query_id, dh.name, dh.scope, shared + scope_score * 0.1 + coalesce(max(topic_score) * 0.1, 0) AS score FROM dh JOIN sr USING (query_id, scope) LEFT JOIN tr ON tr.query_id = dh.query_id AND tr.scope = dh.scope AND list_contains(dh.tags, tr.topic) GROUP BY dh.query_id, dh.name, dh.scope, shared, scope_score)
SELECT query_id, name::BIGINT AS document_id, scope, round(score, 6)::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, name::BIGINT) AS rank FROM cand) WHERE rank <= 5""")
def route_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Scope, topic, document: the three best scopes (shared words of their names, aliases and example questions count
    twice those of their documents), the five best topics in them, and the five best documents, whose score is their own
    shared words and a tenth of those of their scope and best topic [choice of weights]. What scopes and topics score are
    sums over terms, documents with the same scope, tags and asked words are alike, as are questions with the same words of
    the index, and the rest meets in blocks, so questions don't meet documents one by one."""
    ensure_checkpoint_dir(spark)
    q = R.terms_of(search.routed(spark, d), "user_prompt", "query_id")
    asked = lambda df: with_keys(df, q.select("h").distinct(), "h")
    tagged = _tags(spark, d, "document_name").where("scope is not null").withColumn("tags", F.array_distinct("tags"))
    terms = asked(R.terms_of(tagged.withColumnRenamed("document_id", "id"), "document_name", "id", "scope", "tags")).checkpoint()
    direct = asked(R.terms_of(_scope_texts(spark, d), "t", "name")).distinct().checkpoint()
    named = asked(R.terms_of(_topic_names(spark, d), "name", "name")).checkpoint()
    classes, members = R.question_classes(q, "query_id", terms.select("h").union(direct.select("h")).union(named.select("h")).distinct())
    own = classes.select("of", F.explode("terms").alias("h"))
    weight = direct.select(T.code_key(F.col("name")).alias("scope"), "h", F.lit(2).alias("w")).union(terms.select("scope", "h", F.lit(1))).groupBy("scope", "h").agg(F.sum("w").alias("w"))
    sc = own.join(weight, "h").groupBy("of", "scope").agg(F.sum("w").alias("scope_score"))
    sr = R.top(sc, ["of"], "scope_score", F.asc_nulls_last("scope"), 3, "scope_rank").select("of", "scope", "scope_score").checkpoint()
    in_topic = terms.select("scope", "h", F.explode("tags").alias("topic")).groupBy("scope", "topic", "h").agg(F.count(F.lit(1)).alias("w"))
    tp = own.join(sr, "of").join(in_topic, ["scope", "h"]).groupBy("of", "scope", "topic").agg(F.sum("w").alias("shared"))
    hit = own.join(named.withColumnRenamed("name", "topic"), "h").groupBy("of", "topic").agg(F.count(F.lit(1)).alias("own"))
    scored = tp.join(hit, ["of", "topic"], "left").withColumn("topic_score", F.col("shared") + F.coalesce("own", F.lit(0)))
    tr = scored.withColumn("r", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("topic_score"), "topic", "scope"))).where("r <= 5")
    topic = lambda x: F.xxhash64("scope", x)
    bonus = sr.groupBy("of").agg(F.collect_list(F.xxhash64("scope")).alias("scopes"), F.collect_list("scope_score").alias("scope_bonus"))
    more = tr.groupBy("of").agg(F.collect_list(topic("topic")).alias("topics"), F.collect_list("topic_score").alias("topic_bonus"))
    none = F.array().cast("array<bigint>")
    queries = classes.join(bonus, "of").join(more, "of", "left").withColumns({c: F.coalesce(c, none) for c in ("topics", "topic_bonus")})
    docs = terms.groupBy("id").agg(F.any_value("scope").alias("scope"), F.sort_array(F.any_value("tags")).alias("tags"), F.sort_array(F.collect_set("h")).alias("terms"))
    docs = R.first_alike(docs, ["scope", "tags", "terms"], 5).withColumn("topics", F.transform("tags", topic))
    # in tenths, so that sums are exact
    found = R.routed_top(queries, docs, 5, 10).join(members, "of")
    return found.select("query_id", F.col("id").alias("document_id"), "scope", (F.col("value") / 10).alias("score"), "rank")


# evidence per sub-question

SUBS = f"""
sq AS (SELECT query_id, part, query_id + part AS sub_id, question FROM (SELECT query_id, unnest(q) AS question, generate_subscripts(q, 1) - 1 AS part FROM (SELECT query_id, {search.QUESTIONS_SQL.format('user_prompt')} AS q FROM {ASKED})))"""
SUB_HITS = bm25_sql().replace(ASKED, "(SELECT sub_id AS query_id, question AS user_prompt FROM sq)").replace("WITH ", "WITH " + SUBS + ",", 1)
SUB_ROWS = SUB_HITS + f""",
g AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM t),
e AS (SELECT sq.query_id, sq.part, g.id, g.rank, g.score, g.score >= 0.35 * best AS accepted, least(length(chunk_text), 2200) AS chars FROM g JOIN sq ON sq.sub_id = g.query_id JOIN (SELECT id, chunk_text FROM {CHUNKS}) c ON c.id = g.id),
p AS (SELECT *, sum(CASE WHEN accepted THEN chars ELSE 0 END) OVER (PARTITION BY query_id, part ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM e),
ff AS (SELECT *, sum(CASE WHEN accepted AND used <= 2200 THEN chars ELSE 0 END) OVER (PARTITION BY query_id ORDER BY part, rank ROWS UNBOUNDED PRECEDING) AS total FROM p),
st AS (SELECT *, CASE WHEN NOT accepted THEN 'filtered' WHEN used <= 2200 AND total <= 5200 THEN 'selected' ELSE 'omitted' END AS state FROM ff)"""
SUB_ROWS = SUB_ROWS.replace("\np AS (SELECT *, sum", "\npp AS (SELECT *, sum").replace("FROM p),\nst", "FROM pp),\nst")


def sub_question_rows(spark: SparkSession, d: str) -> DataFrame:
    """The keyword channel's rows of every sub-question with their state: filtered by the gate, selected while the
    sub-question's 2200 and the question's 5200 characters last, else omitted. Ids of questions are multiples of 20 and
    have four sub-questions at most, so id + part names a sub-question."""
    q = search.asked(spark, d).select("query_id", F.posexplode(R.split_questions(F.col("user_prompt"))).alias("part", "question")).withColumn("sub_id", F.col("query_id") + F.col("part")).checkpoint()
    hits = R.bm25_top(q, "sub_id", "question", search.chunks(spark, d), "id", "chunk_text", R.CHANNEL_TOP)
    size = search.chunks(spark, d).select("id", F.least(F.length("chunk_text"), F.lit(R.PARENT_CHARS)).alias("chars"))
    w = Window.partitionBy("sub_id")
    rows = hits.join(q.select("sub_id", "query_id", "part"), "sub_id").join(size, "id").withColumn("accepted", F.col("score") >= R.KEYWORD_FLOOR * F.max("score").over(w))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("used", F.sum(F.when(F.col("accepted"), F.col("chars")).otherwise(0)).over(upto(w.orderBy("rank"))))
    fits = F.col("accepted") & (F.col("used") <= R.PART_CHARS)
    rows = rows.withColumn("total", F.sum(F.when(fits, F.col("chars")).otherwise(0)).over(upto(Window.partitionBy("query_id").orderBy("part", "rank"))))
    state = F.when(~F.col("accepted"), "filtered").when(fits & (F.col("total") <= R.TOTAL_CHARS), "selected").otherwise("omitted")
    return rows.withColumn("state", state)


@query(SUB_ROWS + " SELECT query_id, part::INT AS part, id, rank, state FROM st")
def sub_question_evidence(spark: SparkSession, d: str) -> DataFrame:
    return sub_question_rows(spark, d).select("query_id", "part", "id", "rank", "state")


@query(SUB_ROWS + " SELECT query_id, part::INT AS part, 'keyword' AS channel, count(*) AS recalled, count_if(accepted) AS accepted, count_if(state = 'selected') AS selected, round(avg(score), 6) AS avg_score, max(score) AS max_score, min(score) AS min_score FROM st GROUP BY query_id, part")
def channel_traces(spark: SparkSession, d: str) -> DataFrame:
    """What each channel recalled, accepted and selected for a sub-question."""
    r = sub_question_rows(spark, d)
    return r.groupBy("query_id", "part", F.lit("keyword").alias("channel")).agg(F.count(F.lit(1)).alias("recalled"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("state") == "selected").alias("selected"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))


@query(SUB_ROWS + f", n AS (SELECT query_id, part, id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS no FROM st WHERE state = 'selected') SELECT query_id, string_agg('[' || no || '] ' || left(chunk_text, 2200), chr(10) || chr(10) ORDER BY no) AS evidence FROM n JOIN (SELECT id, chunk_text FROM {CHUNKS}) c USING (id) GROUP BY query_id")
def numbered_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The selected evidence of a question, sub-question after sub-question, numbered for references."""
    rows = sub_question_rows(spark, d).where("state = 'selected'")
    n = rows.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank")).alias("no"))
    block = F.concat(F.lit("["), F.col("no").cast("string"), F.lit("] "), F.left("chunk_text", F.lit(R.PARENT_CHARS)))
    blocks = n.join(search.chunks(spark, d), "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("no", block.alias("b")))).alias("l"))
    return blocks.select("query_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("evidence"))


@query(SUB_ROWS + f""", n AS (SELECT query_id, part, id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS no FROM st WHERE state = 'selected'),
b AS (SELECT query_id, part, string_agg('[' || no || '] ' || left(chunk_text, 2200), chr(10) ORDER BY no) AS blocks FROM n JOIN (SELECT id, chunk_text FROM {CHUNKS}) c USING (id) GROUP BY query_id, part)
SELECT query_id, string_agg((part + 1) || '. ' || question || chr(10) || coalesce(blocks, 'no evidence'), chr(10) || chr(10) ORDER BY part) AS prompt FROM sq LEFT JOIN b USING (query_id, part) GROUP BY query_id""")
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of every question: each sub-question with its numbered evidence, or a note that there is none."""
    q = search.asked(spark, d).select("query_id", F.posexplode(R.split_questions(F.col("user_prompt"))).alias("part", "question"))
    rows = sub_question_rows(spark, d).where("state = 'selected'")
    n = rows.select("query_id", "part", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank")).alias("no"))
    block = F.concat(F.lit("["), F.col("no").cast("string"), F.lit("] "), F.left("chunk_text", F.lit(R.PARENT_CHARS)))
    lines = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"])
    blocks = n.join(search.chunks(spark, d), "id").groupBy("query_id", "part").agg(F.array_join(lines(F.struct("no", block.alias("t"))), "\n").alias("blocks"))
    asked = q.join(blocks, ["query_id", "part"], "left")
    text = F.concat((F.col("part") + 1).cast("string"), F.lit(". "), F.col("question"), F.lit("\n"), F.coalesce("blocks", F.lit("no evidence")))
    return asked.groupBy("query_id").agg(F.array_join(lines(F.struct("part", text.alias("t"))), "\n\n").alias("prompt"))


TERMS = "list_distinct(" + TOKENS + ")"


@query(HYBRID + f""", cand AS (SELECT r.query_id, r.id, rrf_score, {TERMS.format('words')} AS q, {TERMS.format('chunk_text')} AS t FROM ranked r JOIN src ON src.query_id = r.query_id JOIN (SELECT id, chunk_text FROM {CHUNKS}) c ON c.id = r.id WHERE final_rank <= 10),
sc AS (SELECT query_id, id, coalesce(round(len(list_intersect(q, t)) / nullif(len(q), 0)::DOUBLE, 6), 0.0) AS score, rrf_score FROM cand)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5""")
def hybrid_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The ten fused candidates in the order of a pluggable reranker, cut to five; the stand-in counts shared words."""
    text = search.chunks(spark, d).checkpoint()
    merged = search.fused(spark, d).join(text, "id").join(text.select(F.col("id").alias("query_id"), F.col("chunk_text").alias("words")), "query_id")
    score = F.coalesce(F.round(F.try_divide(F.size(F.array_intersect(R.tokens(F.col("words")), R.tokens(F.col("chunk_text")))).cast("double"), F.size(F.array_distinct(R.tokens(F.col("words"))))), 6), F.lit(0.0))
    return R.top(merged.select("query_id", "id", score.alias("score")), ["query_id"], "score", "id", R.FINAL_TOP)


@query(f"WITH {NEAR.replace('rank <= 8', 'rank <= 12')} SELECT query_id, id, score, rank FROM vt WHERE score >= 0.15")
def query_preview(spark: SparkSession, d: str) -> DataFrame:
    """A preview of a search with its own topK (12) and threshold (0.15)."""
    v = live(spark, d, "document_embedding", "embedding")
    return R.vector_top(v.where("id % 20 = 0"), v, "id", "embedding", 12, floor=0.15)


# states of rows and stages


@query(f"""
WITH log AS (SELECT DISTINCT exchange_id, lower(trim(stage_code)) AS code, stage_state FROM {STAGES} WHERE exchange_id IS NOT NULL),
lib AS (SELECT * FROM (VALUES ('rewrite', 1), ('route', 2), ('rag_retrieve', 3), ('answer_generate', 4)) AS v(code, place)),
t AS (SELECT DISTINCT exchange_id FROM log)
SELECT t.exchange_id, lib.place, CASE WHEN bool_or(stage_state = 3) THEN 'failed' WHEN bool_or(stage_state = 1) THEN 'current' WHEN count(stage_state) > 0 THEN 'completed' ELSE 'pending' END AS state
FROM t CROSS JOIN lib LEFT JOIN log ON log.exchange_id = t.exchange_id AND log.code = lib.code GROUP BY t.exchange_id, lib.place""")
def build_stages(spark: SparkSession, d: str) -> DataFrame:
    """The state of each of four stages of a turn, from the events in its log; a stage without events is pending."""
    library = ["rewrite", "route", "rag_retrieve", "answer_generate"]
    log = live(spark, d, "chat_exchange_trace_stage", "exchange_id", "stage_code", "stage_state").where("exchange_id is not null")
    seen = [F.collect_set(F.when(F.lower(F.trim("stage_code")) == code, F.col("stage_state").cast("int"))).alias(code) for code in library]
    by = log.groupBy("exchange_id").agg(*seen)
    state = lambda c: F.when(F.array_contains(c, 3), "failed").when(F.array_contains(c, 1), "current").when(F.size(c) > 0, "completed").otherwise("pending")
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("place"), state(code).alias("state")) for i, code in enumerate(library)]))
    return by.select("exchange_id", rows.alias("r")).select("exchange_id", "r.place", "r.state")


@query(f"""
WITH e AS (SELECT lower(trim(dialogue_code)) AS code, id, exchange_state, row_number() OVER (PARTITION BY lower(trim(dialogue_code)) ORDER BY create_time NULLS FIRST, id) AS ord FROM {EXCHANGES} WHERE dialogue_code IS NOT NULL)
SELECT code, coalesce(min(id) FILTER (exchange_state = 3), arg_max(id, ord)) AS exchange_id FROM e GROUP BY code""")
def preferred_exchange(spark: SparkSession, d: str) -> DataFrame:
    """The exchange a session opens with: its first failed one if there is one, else the last."""
    e = live(spark, d, "chat_exchange", "dialogue_code", "exchange_state", "create_time").withColumn("code", T.code_key(F.col("dialogue_code"))).where("code is not null")
    last = F.max(F.struct("create_time", "id"))["id"]
    return e.groupBy("code").agg(F.coalesce(F.min(F.when(F.col("exchange_state") == 3, F.col("id"))), last).alias("exchange_id"))


@query("""
WITH n AS (SELECT least(count(*), 40) AS total FROM agent_document), p AS (SELECT total, unnest(generate_series(1, total)) AS page FROM n)
SELECT page, CASE WHEN total <= 7 THEN list_aggregate(generate_series(1, total), 'string_agg', ' ') WHEN page <= 4 THEN '1 2 3 4 5 ... ' || total
  WHEN page >= total - 3 THEN '1 ... ' || (total - 4) || ' ' || (total - 3) || ' ' || (total - 2) || ' ' || (total - 1) || ' ' || total ELSE '1 ... ' || (page - 1) || ' ' || page || ' ' || (page + 1) || ' ... ' || total END AS shown FROM p""")
def page_windows(spark: SparkSession, d: str) -> DataFrame:
    """The page numbers shown beside each page, with dots for what is left out."""
    n = table(spark, d, "agent_document").agg(F.least(F.count(F.lit(1)), F.lit(40)).alias("total"))
    pages = n.select("total", F.explode(F.sequence(F.lit(1).cast("bigint"), "total")).alias("page"))
    return pages.select("page", T.page_window(F.col("page"), F.col("total")).alias("shown"))


@query(f"""
WITH t AS (SELECT id, list_transform(list_filter(string_split(coalesce(section_path, ''), ' '), lambda x: regexp_matches(x, '^[0-9]$')), lambda x: x) AS l FROM {CHUNKS}),
f AS (SELECT id, list_filter(l, lambda x: list_contains(['1', '2', '3', '4'], x)) AS l FROM t)
SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS signature FROM f WHERE len(l) > 0""")
def allowed_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Codes of an allowed set, each once and in the order of their first place, joined to a signature."""
    codes = F.split(F.coalesce("section_path", F.lit("")), " ")
    kept = T.allowed(codes, ["1", "2", "3", "4"])
    return live(spark, d, "document_chunk", "section_path").select("id", kept.alias("l")).where("size(l) > 0").select("id", F.array_join("l", "|").alias("signature"))


# formats


@query(f"""WITH c AS (SELECT id, json_extract_string(x, '$.score')::DOUBLE AS score FROM (SELECT id, unnest(json_extract(CASE WHEN json_valid(source_snapshot_list) AND json_type(source_snapshot_list) = 'ARRAY' THEN source_snapshot_list::JSON ELSE '[]'::JSON END, '$[*]')) AS x FROM {EXCHANGES}))
SELECT id, count(*) AS n, coalesce(printf('%.4f', max(score)), '-') AS best, coalesce(printf('%.2f%%', max(score) * 100), '-') AS percent FROM c GROUP BY id""")
def score_texts(spark: SparkSession, d: str) -> DataFrame:
    """Scores with four decimals, and in percent."""
    c = live(spark, d, "chat_exchange", "source_snapshot_list").select("id", F.explode(T.json_list(F.col("source_snapshot_list"), "array<struct<documentId:string,score:double>>")).alias("c"))
    by = c.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("c.score").alias("s"))
    return by.select("id", "n", T.fixed(F.col("s"), 4).alias("best"), F.coalesce(F.concat(T.fixed(F.nullif(F.col("s"), F.lit(None).cast("double")) * 100, 2), F.lit("%")), F.lit("-")).alias("percent"))


@query("SELECT o_orderkey, format('{:,}', (o_totalprice * 100)::BIGINT) AS cents, lower(to_base(o_orderkey * 7919, 36)) AS code, CASE WHEN o_orderkey > 0 THEN floor(log2(o_orderkey))::BIGINT END AS magnitude FROM orders")
def number_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers with marks between thousands, in base 36, and their magnitude in bits."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select("o_orderkey", T.thousands(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), I.base36(key * 7919).alias("code"), I.log2_floor(key).alias("magnitude"))


@query(f"SELECT id, coalesce(nullif(concat_ws(' / ', CASE WHEN file_type % 2 = 1 THEN '大纲导航' END, CASE WHEN file_type >= 4 THEN '条目定位' END, CASE WHEN index_status = 3 THEN '图辅助检索' END), ''), '未开启') AS capability FROM {DOCS}")
def capability_text(spark: SparkSession, d: str) -> DataFrame:
    """What a document's structure tree can be used for, in words."""
    names = [F.when(F.col("file_type") % 2 == 1, "大纲导航"), F.when(F.col("file_type") >= 4, "条目定位"), F.when(F.col("index_status") == 3, "图辅助检索")]
    return live(spark, d, "agent_document", "file_type", "index_status").select("id", F.coalesce(T.filled(F.concat_ws(" / ", *names)), F.lit("未开启")).alias("capability"))


@query(f"""
WITH u AS (SELECT id, ceil(length(coalesce(user_prompt, '')) / 4)::BIGINT AS p, ceil(length(coalesce(reply_content, '')) / 4)::BIGINT AS c, total_latency_ms AS ms FROM {EXCHANGES})
SELECT id, 'answer | unknown / unknown | ' || concat_ws('，', CASE WHEN p > 0 THEN '输入 ' || p END, CASE WHEN c > 0 THEN '输出 ' || c END, CASE WHEN p + c > 0 THEN '总Token ' || (p + c) END, CASE WHEN coalesce(ms, 0) <> 0 THEN '耗时 ' || ms || ' ms' END) AS shown, p + c AS tokens, printf('%.4f', (p * 3 + c * 9) / 10000.0) AS cost FROM u""")
def usage_texts(spark: SparkSession, d: str) -> DataFrame:
    """The usage of each turn as one line, and its cost at 3 and 9 parts of 10000 for a token in and out."""
    u = live(spark, d, "chat_exchange", "user_prompt", "reply_content", "total_latency_ms").select("id", T.token_estimate(F.col("user_prompt")).alias("p"), T.token_estimate(F.col("reply_content")).alias("c"), F.col("total_latency_ms").alias("ms"))
    some = lambda c, head, tail="": F.when(F.coalesce(c, F.lit(0)) != 0, F.concat(F.lit(head), c.cast("string"), F.lit(tail)))
    p, c = F.col("p"), F.col("c")
    parts = F.concat_ws("，", some(p, "输入 "), some(c, "输出 "), some(p + c, "总Token "), some(F.col("ms"), "耗时 ", " ms"))
    return u.select("id", F.concat(F.lit("answer | unknown / unknown | "), parts).alias("shown"), (p + c).alias("tokens"), T.fixed((p * 3 + c * 9) / 10000, 4).alias("cost"))


@query(f"""
WITH s AS (SELECT exchange_id, lower(trim(stage_code)) AS code, count(*) AS calls, sum(CASE WHEN duration_ms > 0 THEN duration_ms ELSE 0 END)::BIGINT AS ms FROM {STAGES} WHERE exchange_id IS NOT NULL GROUP BY ALL),
u AS (SELECT id, ceil(length(coalesce(user_prompt, '')) / 4)::BIGINT AS p, ceil(length(coalesce(reply_content, '')) / 4)::BIGINT AS c FROM {EXCHANGES})
SELECT s.exchange_id, code, calls, ms, CASE WHEN code = 'answer_generate' THEN coalesce(p, 0) ELSE 0 END AS prompt_tokens, CASE WHEN code = 'answer_generate' THEN coalesce(c, 0) ELSE 0 END AS completion_tokens FROM s LEFT JOIN u ON u.id = s.exchange_id""")
def usage_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """Calls, time and tokens of each turn and stage; tokens belong to the stage that writes the answer."""
    s = live(spark, d, "chat_exchange_trace_stage", "exchange_id", "stage_code", "duration_ms").where("exchange_id is not null")
    by = s.groupBy("exchange_id", F.lower(F.trim("stage_code")).alias("code")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(0)).alias("ms"))
    u = live(spark, d, "chat_exchange", "user_prompt", "reply_content").select(F.col("id").alias("exchange_id"), T.token_estimate(F.col("user_prompt")).alias("p"), T.token_estimate(F.col("reply_content")).alias("c"))
    own = lambda c: F.when(F.col("code") == "answer_generate", F.coalesce(c, F.lit(0))).otherwise(0)
    return by.join(u, "exchange_id", "left").select("exchange_id", "code", "calls", "ms", own("p").alias("prompt_tokens"), own("c").alias("completion_tokens"))


@query(f"""
WITH s AS (SELECT id, CASE WHEN json_valid(source_snapshot_list) THEN source_snapshot_list::JSON END AS j FROM {EXCHANGES})
SELECT id, coalesce(json_extract_string(j, '$[0].documentId'), '') AS first_document, CASE WHEN json_type(j) = 'ARRAY' THEN len(list_filter(json_extract_string(j, '$[*].documentId'), lambda x: coalesce(x, '') <> '')) ELSE 0 END AS documents FROM s""")
def snapshot_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field and a list of each snapshot; what is no snapshot has an empty field and no items."""
    e = live(spark, d, "chat_exchange", "source_snapshot_list")
    found = T.json_list(F.col("source_snapshot_list"), "array<struct<documentId:string>>")
    return e.select("id", F.coalesce(F.get_json_object("source_snapshot_list", "$[0].documentId"), F.lit("")).alias("first_document"), F.size(F.filter(found, lambda x: F.coalesce(x["documentId"], F.lit("")) != "")).alias("documents"))


@query("""SELECT event_id, '{"id":"' || event_id || '","user":"' || user_id || '","type":"' || event_type || '","nested":{"k":"' || (props::JSON ->> '$.k') || '"}}' AS record FROM events""")
def stringified_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON whose numbers are texts at every level, so that long ids survive a reader of doubles."""
    e = table(spark, d, "events")
    row = F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("type"), F.from_json("props", "k bigint").alias("nested"))
    return e.select("event_id", row.alias("row")).select("event_id", F.to_json(T.stringified(F.col("row"), e.select(row.alias("row")).schema["row"].dataType)).alias("record"))


@query(f"""SELECT id, CASE WHEN json_valid(source_snapshot_list) THEN replace(replace(replace(replace(replace(source_snapshot_list, '[{{', '[ {{' || chr(10) || '  '), '}},{{', chr(10) || '}}, {{' || chr(10) || '  '), '}}]', chr(10) || '}} ]'), ',"', ',' || chr(10) || '  "'), '":', '" : ') ELSE source_snapshot_list END AS shown FROM {EXCHANGES} WHERE source_snapshot_list IS NOT NULL AND source_snapshot_list <> '[]'""")
def pretty_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON broken into lines; what is no JSON stays as it is."""
    e = live(spark, d, "chat_exchange", "source_snapshot_list").where("source_snapshot_list is not null and source_snapshot_list <> '[]'")
    return e.select("id", T.pretty(F.col("source_snapshot_list"), "array<struct<documentId:string,score:decimal(18,4)>>").alias("shown"))


# calendar


def _at(spark: SparkSession, d: str) -> DataFrame:
    return event_time(table(spark, d, "events")).select("event_id", F.col("ts").alias("at"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m-%d %H') AS hour, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second, strftime(ts, '%Y-%m-%d %H:%M:%S:%g') AS millisecond, strftime(ts, '%Y%m%d') AS no_date, strftime(ts, '%Y%m%d%H') AS no_hour,
  strftime(ts, '%Y%m%d%H%M') AS no_minute, strftime(ts, '%Y%m%d%H%M%S') AS no_second, strftime(ts, '%Y%m%d%H%M%S%g') AS no_millisecond, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%gZ') AS utc FROM events""")
def date_formats(spark: SparkSession, d: str) -> DataFrame:
    return _at(spark, d).select("event_id", *[D.formatted(F.col("at"), style).alias(style) for style in D.FORMATS])


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S:%g') AS time, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, (epoch_us(ts) // 1000 % 1000)::INT AS millisecond,
  ['星期一', '星期二', '星期三', '星期四', '星期五', '星期六', '星期日'][isodow(ts)] AS week, dayofyear(ts)::INT AS day_of_year, ceil(dayofyear(ts) / 7.0)::INT AS week_of_year, (ceil(dayofyear(ts) / 7.0) - CASE WHEN isodow(date_trunc('year', ts)) = 1 THEN 0 ELSE 1 END)::INT AS week_of_year_ignore_last_year, epoch_us(ts) // 1000 AS millisecond_stamp, epoch_us(ts) // 1000000 AS second_stamp FROM events""")
def date_node_fields(spark: SparkSession, d: str) -> DataFrame:
    """All fields of a date node."""
    return _at(spark, d).select("event_id", D.node(F.col("at")).alias("n")).select("event_id", "n.*")


@query("""SELECT event_id, strftime(ts + INTERVAL 1 YEAR, '%Y-%m-%d') AS year, strftime(ts + INTERVAL 1 MONTH, '%Y-%m-%d') AS month, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 14 DAY, '%Y-%m-%d') AS week, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS hour,
  strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS minute, strftime(ts - INTERVAL 61 SECOND, '%Y-%m-%d %H:%M:%S') AS second, strftime(ts + INTERVAL 1500 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS millisecond FROM events""")
def date_units(spark: SparkSession, d: str) -> DataFrame:
    """A time moved by each of eight units."""
    add = lambda unit, n, form: F.date_format(D.added(F.col("at"), unit, n), form).alias(unit)
    day, second = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"
    return _at(spark, d).select("event_id", add("year", 1, day), add("month", 1, day), add("day", 3, day), add("week", 2, day), add("hour", -5, second), add("minute", 90, second), add("second", -61, second), add("millisecond", 1500, second + ".SSS"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS at_8, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '1970-01-01' END AS parsed FROM events")
def uid_dates(spark: SparkSession, d: str) -> DataFrame:
    """Times at UTC+8, and days and times read by a fixed pattern; without a text the default day holds."""
    at = F.col("at")
    third = F.pmod("event_id", F.lit(3))
    written = F.when(third == 0, F.date_format(at, D.DAY)).when(third == 1, F.date_format(at, D.SECOND))
    parsed = F.when(third == 0, F.date_format(D.by_pattern(written, D.DAY), D.DAY)).otherwise(F.when(written.isNull(), F.date_format(D.by_pattern(written, D.DAY), D.DAY)).otherwise(F.date_format(D.by_pattern(written, D.SECOND), D.SECOND)))
    return _at(spark, d).select("event_id", F.date_format(D.utc_plus_8(at), D.SECOND).alias("at_8"), parsed.alias("parsed"))


@query(f"SELECT id, CASE WHEN trim(coalesce(reply_content, ''), ' ') = '' THEN '' WHEN length(reply_content) > 80 THEN left(reply_content, 77) || '...' ELSE reply_content END AS short FROM {EXCHANGES}")
def abbreviations(spark: SparkSession, d: str) -> DataFrame:
    return live(spark, d, "chat_exchange", "reply_content").select("id", T.abbreviated(F.col("reply_content")).alias("short"))


@query("""WITH l AS (SELECT * FROM (VALUES (28, 22, 13), (31, 10, 22), (41, 10, 12)) AS v(time_bits, worker_bits, sequence_bits))
SELECT event_id, time_bits::INT AS time_bits, ((epoch_us(ts) // 1000000 % (1::BIGINT << time_bits)) << (worker_bits + sequence_bits)) | ((user_id % (1::BIGINT << worker_bits)) << sequence_bits) | (event_id % (1::BIGINT << sequence_bits)) AS id, (1::BIGINT << worker_bits) - 1 AS most_workers, (1::BIGINT << sequence_bits) - 1 AS most_sequence FROM events, l""")
def bit_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Ids of three layouts of 64 bits: sign, time, worker and sequence."""
    e = event_time(table(spark, d, "events"))
    out = None
    for bits in ((28, 22, 13), (31, 10, 22), (41, 10, 12)):
        layout = I.Layout(*bits)
        clip = lambda c, most: F.pmod(c, F.lit(most + 1))
        own = layout.allocate(clip(F.unix_seconds("ts"), layout.most_time), clip(F.col("user_id"), layout.most_workers), clip(F.col("event_id"), layout.most_sequence))
        part = e.select("event_id", F.lit(bits[0]).alias("time_bits"), own.alias("id"), F.lit(layout.most_workers).cast("bigint").alias("most_workers"), F.lit(layout.most_sequence).cast("bigint").alias("most_sequence"))
        out = part if out is None else out.unionByName(part)
    return out


# chunks and streams


@query(f"SELECT b.id, count(c.id) AS children, min(c.chunk_no) AS first_no, max(c.chunk_no) AS last_no, coalesce(min(c.chunk_no) >= b.start_chunk_no AND max(c.chunk_no) <= b.end_chunk_no, FALSE) AS inside FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY create_time DESC NULLS LAST) AS rn_ FROM document_parent_block) WHERE rn_ = 1 AND coalesce(status, 1) <> 0) b LEFT JOIN {CHUNKS} c ON c.parent_block_id = b.id GROUP BY b.id, b.start_chunk_no, b.end_chunk_no")
def child_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The range of chunk numbers inside each parent block, and whether it lies in the range the block names."""
    from skein.operators.versions import in_force

    blocks = in_force(table(spark, d, "document_parent_block"), ["start_chunk_no", "end_chunk_no"], version="create_time")
    own = live(spark, d, "document_chunk", "parent_block_id", "chunk_no").groupBy(F.col("parent_block_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("chunk_no").alias("first_no"), F.max("chunk_no").alias("last_no"))
    inside = F.coalesce((F.col("first_no") >= F.col("start_chunk_no")) & (F.col("last_no") <= F.col("end_chunk_no")), F.lit(False))
    return blocks.join(own, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("children"), "first_no", "last_no", inside.alias("inside"))


@query()
def separator_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of at most 800 characters cut at the strongest separator that fits, with up to 120 of the chunk before."""
    return R.separator_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_callbacks(spark: SparkSession, d: str) -> DataFrame:
    """A stream whose batches go to a callback, which stores what it counts."""
    work = work_folder(spark)
    events = table(spark, d, "events").select("event_id", "event_type")
    events.write.parquet(f"{work}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{work}/events")

    def on_content(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    folds.run_callbacks(stream, f"{work}/checkpoint", on_content)
    return spark.read.parquet(f"{work}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT event_type, round((max(value) + min(value)) / 2, 6) AS middle FROM events GROUP BY event_type")
def own_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate of one's own over Arrow batches: the middle of a range, from the ends of each task's part."""
    ends = table(spark, d, "events").groupBy("event_type", F.spark_partition_id().alias("part")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.groupBy("event_type").agg(F.round(X.range_middle(F.col("low"), F.col("high")), 6).alias("middle"))


INTENT = "CASE WHEN regexp_matches({0}, '(?i)difference|关系|区别|zusammen|relación|relate') THEN 'comparison' WHEN regexp_matches({0}, '(?i)^(can|may|darf|kann|puede|¿puede)|可以|能否') THEN 'permission' WHEN regexp_matches({0}, '(?i)who|which team|谁|wer |quién') THEN 'owner' ELSE 'procedure' END"


@query(f"""WITH i AS (SELECT id, {INTENT.format('user_prompt')} AS relation, regexp_matches(user_prompt, '§|章|Kapitel|section|sección') AS section FROM {EXCHANGES} WHERE user_prompt IS NOT NULL)
SELECT id, relation, CASE WHEN section AND relation = 'owner' THEN 'graph_only' WHEN section THEN 'graph_then_evidence' WHEN relation = 'comparison' THEN 'graph_assist' ELSE 'retrieval' END AS mode, CASE relation WHEN 'procedure' THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence FROM i""")
def intents(spark: SparkSession, d: str) -> DataFrame:
    """What kind of relation a question asks for, how it is to be retrieved, and how sure that is [choice of words]."""
    return live(spark, d, "chat_exchange", "user_prompt").where("user_prompt is not null").select("id", R.intent(F.col("user_prompt")).alias("i")).select("id", "i.*")
