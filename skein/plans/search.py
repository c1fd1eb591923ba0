"""Retrieval from question to evidence, knowledge routing, and conversation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import retrieval as R
from skein.operators import structure as S
from skein.operators.joins import with_keys
from skein.plans.registry import live, live_sql, query
from skein.session import ensure_checkpoint_dir, work_folder
from skein.sources.tables import table

DOCS, CHUNKS, VECTORS, EXCHANGES, DIALOGUES, SCOPES = map(live_sql, ["agent_document", "document_chunk", "document_embedding", "chat_exchange", "chat_dialogue", "knowledge_scope_node"])

TOKENS = (
    "flatten(list_transform(regexp_extract_all(regexp_replace(lower({0}), '([\u4e00-\u9fff]+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+'), "
    "lambda r: CASE WHEN regexp_matches(r, '^[\u4e00-\u9fff]') THEN list_transform(range(1, greatest(length(r), 2)), lambda i: substring(r, i, 2)) ELSE [r] END))"
)
#: Queries are the prompts whose id is divisible by 20, against all chunks.
ASKED = f"(SELECT id AS query_id, user_prompt FROM {EXCHANGES} WHERE id % 20 = 0 AND length(trim(user_prompt)) > 1)"

#: Routes are found for all prompts.
ROUTED = f"(SELECT id AS query_id, user_prompt FROM {EXCHANGES} WHERE length(trim(user_prompt)) > 1)"


def routed(spark: SparkSession, d: str) -> DataFrame:
    return live(spark, d, "chat_exchange", "user_prompt").where(F.length(T.stripped(F.col("user_prompt"))) > 1).select(F.col("id").alias("query_id"), "user_prompt")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return routed(spark, d).where("query_id % 20 = 0")


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return live(spark, d, "document_chunk", "chunk_text", *columns)


# chunking


@query("""
WITH s AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 121, 0), 680)) AS at FROM documents WHERE length(text) > 0)
SELECT doc_id, (at / 680)::INT AS chunk_no, substring(text, at::INT + 1, 800) AS chunk_text FROM s""".replace(" AS at ", " AS at_ ").replace("(at /", "(at_ /").replace("at::INT", "at_::INT"))
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return R.window_chunks(table(spark, d, "documents"), "doc_id", "text")


@query()
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return R.semantic_chunks(table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT id, length(chunk_text) AS chars, len({TOKENS.format('chunk_text')}) AS terms, ceil(length(chunk_text) / 4)::BIGINT AS tokens, CASE WHEN length(chunk_text) > 800 THEN 'recursive' WHEN chunk_text LIKE '%' || chr(10) || '%' THEN 'structure' ELSE 'none' END AS strategy FROM {CHUNKS} WHERE trim(chunk_text) <> ''")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the chunks that aren't empty, and the strategy to cut them with [choice]."""
    c = chunks(spark, d).where(F.trim("chunk_text") != "")
    strategy = F.when(F.length("chunk_text") > 800, "recursive").when(F.contains("chunk_text", F.lit("\n")), "structure").otherwise("none")
    return c.select("id", F.length("chunk_text").alias("chars"), F.size(R.tokens(F.col("chunk_text"))).alias("terms"), T.token_estimate(F.col("chunk_text")).alias("tokens"), strategy.alias("strategy"))


# keyword channel

POSTINGS = f"""
w AS (SELECT id, {TOKENS.format('chunk_text')} AS w FROM {CHUNKS}),
p AS (SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY term, id)"""


def index(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(chunks(spark, d), "id", "chunk_text")


@query(f"WITH {POSTINGS} SELECT term, id, tf, dl FROM p")
def token_postings(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d)


@query(f"WITH {POSTINGS}, n AS (SELECT count(DISTINCT id) AS n FROM p) SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, n GROUP BY term")
def term_idf(spark: SparkSession, d: str) -> DataFrame:
    p = index(spark, d)
    n = p.agg(F.count_distinct("id").alias("n"))
    by = p.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # one row
    return by.select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def bm25_sql(pruned: float = 0.0) -> str:
    keep = "weighted" if not pruned else f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(idf, 9), term) AS pl, count(*) OVER (PARTITION BY query_id) AS cnt FROM weighted) WHERE pl > floor(cnt * {pruned}))"
    return f"""WITH {POSTINGS},
z AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT id, any_value(dl) AS dl FROM p GROUP BY id)),
q AS (SELECT DISTINCT query_id, unnest({TOKENS.format('user_prompt')}) AS term FROM {ASKED}),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
weighted AS (SELECT query_id, q.term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM q JOIN f ON q.term = f.term, z),
k AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM {keep} w JOIN p ON p.term = w.term GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k QUALIFY rank <= 8)"""


def keyword_channel(spark: SparkSession, d: str, pruned: float = 0.0) -> DataFrame:
    return R.bm25_top(asked(spark, d), "query_id", "user_prompt", chunks(spark, d), "id", "chunk_text", R.CHANNEL_TOP, pruned)


@query(bm25_sql() + " SELECT query_id, id, score, rank FROM t")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return keyword_channel(spark, d)


@query(bm25_sql() + " SELECT query_id, id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM t) WHERE score >= 0.35 * best")
def keyword_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_gate(keyword_channel(spark, d), ["query_id"])


@query(f"WITH {POSTINGS}, q AS (SELECT DISTINCT unnest({TOKENS.format('user_prompt')}) AS term FROM {ASKED}) SELECT term, count(*) AS texts, sum(tf)::BIGINT AS places FROM p JOIN q USING (term) GROUP BY term")
def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index written as a table and read back, then joined to the terms that are asked for."""
    path = f"{work_folder(spark)}/postings"
    R.store_index(index(spark, d), path)
    terms = asked(spark, d).select(F.explode(R.tokens(F.col("user_prompt"))).alias("term")).distinct()
    return R.load_index(spark, path).join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("texts"), F.sum("tf").alias("places"))


SCOPED = f"(SELECT e.id AS query_id, e.user_prompt, s.selected_document_id FROM {EXCHANGES} e JOIN (SELECT lower(trim(dialogue_code)) AS code, selected_document_id FROM {DIALOGUES} WHERE selected_document_id IS NOT NULL) s ON s.code = lower(trim(e.dialogue_code)) WHERE e.id % 20 = 0 AND length(trim(e.user_prompt)) > 1)"


@query(bm25_sql().replace(ASKED, SCOPED).replace("JOIN p ON p.term = w.term", f"JOIN p ON p.term = w.term JOIN (SELECT id AS pid, document_id FROM {CHUNKS}) c ON c.pid = p.id JOIN {SCOPED} a ON a.query_id = w.query_id AND a.selected_document_id = c.document_id").replace("SELECT query_id, id, round", "SELECT w.query_id, p.id, round") + " SELECT query_id, id, score, rank FROM t")
def document_scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    """The keyword channel within the document that the session has selected."""
    own = live(spark, d, "chat_dialogue", "dialogue_code", "selected_document_id").where("selected_document_id is not null").select(T.code_key(F.col("dialogue_code")).alias("code"), "selected_document_id")
    e = live(spark, d, "chat_exchange", "dialogue_code", "user_prompt").where((F.col("id") % 20 == 0) & (F.length(T.stripped(F.col("user_prompt"))) > 1))
    q = e.withColumn("code", T.code_key(F.col("dialogue_code"))).join(own, "code").select(F.col("id").alias("query_id"), "user_prompt", "selected_document_id")
    return R.bm25_top(q, "query_id", "user_prompt", chunks(spark, d, "document_id"), "id", "chunk_text", R.CHANNEL_TOP, within=("selected_document_id", "document_id"))


@query(bm25_sql(0.15) + " SELECT query_id, id, score, rank FROM t")
def sparse_pruning(spark: SparkSession, d: str) -> DataFrame:
    """The keyword channel without the commonest 15 percent of each query's terms."""
    return keyword_channel(spark, d, 0.15)


# vector channel: queries are the vectors whose id is divisible by 20

VALID = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
NEAR = f"""
v AS (SELECT id, embedding::DOUBLE[] AS e FROM {VECTORS} WHERE {VALID}),
near AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0),
vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 8)"""


def vector_channel(spark: SparkSession, d: str, width: int = R.CHANNEL_TOP) -> DataFrame:
    v = live(spark, d, "document_embedding", "embedding")
    return R.vector_top(v.where("id % 20 = 0"), v, "id", "embedding", width)


@query(f"WITH {NEAR} SELECT query_id, id, score, rank FROM vt")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector_channel(spark, d)


@query(f"WITH {NEAR} SELECT query_id, id, score, rank FROM vt WHERE score >= 0.45")
def vector_gate(spark: SparkSession, d: str) -> DataFrame:
    return vector_channel(spark, d).where(F.col("score") >= R.VECTOR_FLOOR)


# fusion: a query is a chunk with a vector whose id is divisible by 20; its whole text asks the keyword channel

HYBRID = f"""WITH {POSTINGS}, {NEAR},
z AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT id, any_value(dl) AS dl FROM p GROUP BY id)),
src AS (SELECT c.id AS query_id, chunk_text AS words FROM {CHUNKS} c JOIN v ON v.id = c.id WHERE c.id % 20 = 0),
q AS (SELECT DISTINCT query_id, unnest({TOKENS.format('words')}) AS term FROM src),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
k AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN f ON q.term = f.term JOIN p ON p.term = q.term, z WHERE id <> query_id GROUP BY ALL),
kt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k QUALIFY rank <= 8),
kg AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM kt) WHERE score >= 0.35 * best),
fused AS (
  SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, min(CASE WHEN ch = 'v' THEN rank END) AS vector_rank, min(CASE WHEN ch = 'k' THEN rank END) AS keyword_rank
  FROM (SELECT query_id, id, rank, 'v' AS ch FROM vt WHERE score >= 0.45 UNION ALL SELECT query_id, id, rank, 'k' FROM kg) GROUP BY query_id, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS final_rank FROM fused)"""


def fused(spark: SparkSession, d: str, width: int = R.CHANNEL_TOP, floor: float = R.VECTOR_FLOOR) -> DataFrame:
    """The fused candidates of both channels, of `width` results each."""
    v = live(spark, d, "document_embedding", "embedding").where(R.is_vector("embedding", 64)).where("id % 20 = 0").select("id")
    words = chunks(spark, d).where("id % 20 = 0").join(v, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("chunk_text").alias("words"))
    hits = R.bm25_top(words, "query_id", "words", chunks(spark, d), "id", "chunk_text", width, others=True)
    keyword = R.keyword_gate(hits, ["query_id"])
    vector = vector_channel(spark, d, width).where(F.col("score") >= floor)
    return R.top(R.fuse({"vector": vector, "keyword": keyword}, "query_id", "id"), ["query_id"], "rrf_score", "id", R.MERGED_TOP, "final_rank")


@query(HYBRID + " SELECT query_id, id, rrf_score, vector_rank, keyword_rank, final_rank FROM ranked WHERE final_rank <= 10")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d)


@query(HYBRID + " SELECT query_id, id, rrf_score, final_rank FROM ranked WHERE final_rank <= 5")
def hybrid_top5(spark: SparkSession, d: str) -> DataFrame:
    """Both channels, gated, fused by reciprocal ranks, cut to five."""
    return fused(spark, d).where(F.col("final_rank") <= R.FINAL_TOP).select("query_id", "id", "rrf_score", "final_rank")


@query(HYBRID.replace("rank <= 8", "rank <= 12") + " SELECT query_id, id, rrf_score, final_rank FROM ranked WHERE final_rank <= 5")
def hybrid_of_12(spark: SparkSession, d: str) -> DataFrame:
    """The same with 12 results from each channel."""
    return fused(spark, d, 12).where(F.col("final_rank") <= R.FINAL_TOP).select("query_id", "id", "rrf_score", "final_rank")


@query(HYBRID.replace("rank <= 8", "rank <= 20").replace("score >= 0.45", "score >= 0.3") + " SELECT query_id, id, rrf_score, final_rank FROM ranked WHERE final_rank <= 5")
def hybrid_of_20(spark: SparkSession, d: str) -> DataFrame:
    """The same with 20 results from each channel and a threshold of 0.3."""
    return fused(spark, d, 20, 0.3).where(F.col("final_rank") <= R.FINAL_TOP).select("query_id", "id", "rrf_score", "final_rank")


ELEVATED = HYBRID + f""", el AS (
  SELECT query_id, parent_block_id, max(rrf_score) AS rrf_score, count(*) AS hits, count(*) >= 2 AS is_elevated FROM ranked JOIN (SELECT id, parent_block_id FROM {CHUNKS} WHERE parent_block_id IS NOT NULL) c USING (id) WHERE final_rank <= 10 GROUP BY 1, 2),
pt AS (SELECT parent_block_id, left(string_agg(chunk_text, chr(10) ORDER BY chunk_no NULLS FIRST, id), 2200) AS evidence FROM {CHUNKS} WHERE parent_block_id IS NOT NULL AND chunk_text IS NOT NULL GROUP BY 1),
ev AS (SELECT query_id, parent_block_id, rrf_score, evidence, row_number() OVER w AS place, sum(length(evidence)) OVER (PARTITION BY query_id ORDER BY rrf_score DESC, parent_block_id ROWS UNBOUNDED PRECEDING) AS used_chars FROM el JOIN pt USING (parent_block_id) WINDOW w AS (PARTITION BY query_id ORDER BY rrf_score DESC, parent_block_id))"""


def elevated(spark: SparkSession, d: str) -> DataFrame:
    parents = live(spark, d, "document_chunk", "parent_block_id").where("parent_block_id is not null")
    return R.elevate(fused(spark, d), "query_id", "id", parents, "parent_block_id", "rrf_score")


@query(ELEVATED + " SELECT query_id, parent_block_id, rrf_score, hits, is_elevated FROM el")
def parent_elevation(spark: SparkSession, d: str) -> DataFrame:
    return elevated(spark, d)


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Parents of the hits with their text of at most 2200 characters, in order, and the running length."""
    hit = elevated(spark, d).checkpoint()  # a few rows per query, used twice
    c = chunks(spark, d, "parent_block_id", "chunk_no").where("parent_block_id is not null and chunk_text is not null")
    own = c.join(hit.select("parent_block_id").distinct(), "parent_block_id", "left_semi")
    texts = own.groupBy("parent_block_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "id", "chunk_text"))).alias("c"))
    texts = texts.select("parent_block_id", F.left(F.array_join(F.transform("c", lambda x: x["chunk_text"]), "\n"), F.lit(R.PARENT_CHARS)).alias("evidence"))
    rows = R.within_budget(hit.join(texts, "parent_block_id"), ["query_id"], [F.desc("rrf_score"), "parent_block_id"], F.length("evidence"), R.TOTAL_CHARS)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "parent_block_id")))


@query(ELEVATED + " SELECT query_id, count_if(used_chars <= 5200) AS rendered, count_if(used_chars > 5200) AS omitted, max(CASE WHEN used_chars <= 5200 THEN used_chars END)::BIGINT AS used FROM ev GROUP BY 1")
def evidence_budget(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).groupBy("query_id").agg(F.count_if("is_rendered").alias("rendered"), F.count_if(~F.col("is_rendered")).alias("omitted"), F.max(F.when(F.col("is_rendered"), F.col("used_chars"))).alias("used"))


@query(ELEVATED + " SELECT query_id, string_agg('[' || place || '] ' || evidence, chr(10) || chr(10) ORDER BY place) AS prompt FROM ev WHERE used_chars <= 5200 GROUP BY 1")
def evidence_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The numbered evidence blocks of each query, within the budget."""
    kept = evidence(spark, d).where("is_rendered").select("query_id", "place", F.concat(F.lit("["), F.col("place"), F.lit("] "), F.col("evidence")).alias("block"))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n\n").alias("prompt"))


@query(bm25_sql() + f" SELECT a.query_id, count(t.id) AS hits, CASE WHEN count(t.id) = 0 THEN 'no evidence' ELSE 'answer' END AS reply FROM {ASKED} a LEFT JOIN t ON t.query_id = a.query_id GROUP BY a.query_id")
def no_evidence_reply(spark: SparkSession, d: str) -> DataFrame:
    hits = keyword_channel(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return asked(spark, d).join(hits, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("hits"), F.when(F.col("n").isNull(), "no evidence").otherwise("answer").alias("reply"))


# questions


PARTS_SQL = "list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({0}, '(?m)^\\s*\\d+[.、)]\\s*', chr(10), 'g'), '([?？])', '\\1' || chr(10), 'g'), '[;；\\n]+'), lambda x: trim(x)), lambda x: length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) > 0)"
SUBJECTS_SQL = "list_filter(regexp_split_to_array(string_split({0}, '分别')[1], '[、，和与]+'), lambda x: trim(x) <> '')"
QUESTIONS_SQL = f"(CASE WHEN contains({{0}}, '分别') AND len({PARTS_SQL}) = 1 AND len({SUBJECTS_SQL}) > 1 THEN list_transform({SUBJECTS_SQL}, lambda x: trim(x) || trim(string_split({{0}}, '分别')[-1])) WHEN len({PARTS_SQL}) = 0 THEN [trim({{0}})] ELSE {PARTS_SQL} END)[1:4]"


@query(f"SELECT id, (part - 1)::INT AS part, question FROM (SELECT id, unnest(q) AS question, generate_subscripts(q, 1) AS part FROM (SELECT id, {QUESTIONS_SQL.format('user_prompt')} AS q FROM {EXCHANGES} WHERE length(trim(user_prompt)) > 0))")
def sub_questions(spark: SparkSession, d: str) -> DataFrame:
    """The explicit sub-questions of every prompt, at most four."""
    e = live(spark, d, "chat_exchange", "user_prompt").where(F.length(T.stripped(F.col("user_prompt"))) > 0)
    return e.select("id", F.posexplode(R.split_questions(F.col("user_prompt"))).alias("part", "question"))


@query(f"SELECT id, CASE WHEN length(trim(coalesce(user_prompt, ''))) < 4 THEN 'CLARIFICATION' WHEN selected_document_id IS NOT NULL THEN 'RAG_CHAT' ELSE 'REACT_AGENT' END AS executor FROM {EXCHANGES} e LEFT JOIN (SELECT lower(trim(dialogue_code)) AS code, selected_document_id FROM {DIALOGUES}) d ON d.code = lower(trim(e.dialogue_code))")
def executor_choice(spark: SparkSession, d: str) -> DataFrame:
    """Clarification before knowledge question before open agent."""
    own = live(spark, d, "chat_dialogue", "dialogue_code", "selected_document_id").select(T.code_key(F.col("dialogue_code")).alias("code"), "selected_document_id")
    e = live(spark, d, "chat_exchange", "dialogue_code", "user_prompt").withColumn("code", T.code_key(F.col("dialogue_code"))).join(own, "code", "left")
    short = F.length(F.trim(F.coalesce("user_prompt", F.lit("")))) < 4
    return e.select("id", F.when(short, "CLARIFICATION").when(F.col("selected_document_id").isNotNull(), "RAG_CHAT").otherwise("REACT_AGENT").alias("executor"))


@query(f"""
WITH e AS (SELECT lower(trim(dialogue_code)) AS code, id, trim(user_prompt) AS p, row_number() OVER (PARTITION BY lower(trim(dialogue_code)) ORDER BY create_time DESC NULLS LAST, id DESC) AS r FROM {EXCHANGES} WHERE length(trim(user_prompt)) > 3 AND dialogue_code IS NOT NULL),
f AS (SELECT code, p, min(r) AS r FROM e GROUP BY code, p)
SELECT code, string_agg(p, ' | ' ORDER BY r) AS suggestions FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY r) AS k FROM f WHERE r > 1) WHERE k <= 3 GROUP BY code""")
def follow_ups(spark: SparkSession, d: str) -> DataFrame:
    """Up to three earlier questions of a session, latest first, none equal to the last one's row."""
    e = live(spark, d, "chat_exchange", "dialogue_code", "user_prompt", "create_time").select(T.code_key(F.col("dialogue_code")).alias("code"), "id", "create_time", F.trim("user_prompt").alias("p")).where("length(p) > 3 and code is not null")
    w = Window.partitionBy("code").orderBy(F.desc_nulls_last("create_time"), F.desc("id"))
    first = e.withColumn("r", F.row_number().over(w)).groupBy("code", "p").agg(F.min("r").alias("r")).where("r > 1")
    top = first.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("r"))).where("k <= 3")
    return top.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p"))), lambda x: x["p"]), " | ").alias("suggestions"))


# routing: scopes by words of their names, then documents of the best scopes

FUNNEL = f"""
WITH q AS (SELECT DISTINCT query_id, unnest({TOKENS.format('user_prompt')}) AS term FROM {ROUTED}),
dt AS (SELECT DISTINCT d.id, lower(trim(knowledge_scope_code)) AS scope, unnest({TOKENS.format('document_name')}) AS term FROM {DOCS} d WHERE coalesce(trim(knowledge_scope_code), '') <> ''),
s AS (SELECT query_id, id, scope, count(*) AS score FROM q JOIN dt USING (term) GROUP BY ALL),
sc AS (SELECT query_id, scope, sum(score) AS scope_score FROM s GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY scope_score DESC, scope) AS scope_rank FROM sc QUALIFY scope_rank <= 3),
dr AS (SELECT s.query_id, s.id, s.scope, s.score, scope_rank, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, scope_rank, s.id) AS rank, max(s.score) OVER (PARTITION BY s.query_id) AS best FROM s JOIN sr USING (query_id, scope))"""


@query(FUNNEL + " SELECT query_id, id, scope, score, scope_rank, rank FROM dr WHERE rank <= CASE WHEN best >= 3 THEN 3 ELSE 5 END")
def route_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Scopes, then documents inside the three best scopes, by shared words [choice]; three documents if the best shares
    three words, else five. What a scope scores is a sum over terms, documents with the same asked words and questions
    with the same words of names are alike, and the rest meets in blocks, so questions don't meet documents one by one."""
    ensure_checkpoint_dir(spark)
    q = R.terms_of(routed(spark, d), "user_prompt", "query_id")
    docs = live(spark, d, "agent_document", "knowledge_scope_code", "document_name").withColumn("scope", T.code_key(F.col("knowledge_scope_code"))).where("scope <> ''")
    terms = with_keys(R.terms_of(docs, "document_name", "id", "scope"), q.select("h").distinct(), "h").checkpoint()
    classes, members = R.question_classes(q, "query_id", terms.select("h").distinct())
    weight = terms.groupBy("scope", "h").agg(F.count(F.lit(1)).alias("w"))
    scores = classes.select("of", F.explode("terms").alias("h")).join(weight, "h").groupBy("of", "scope").agg(F.sum("w").alias("scope_score"))
    scopes = R.top(scores, ["of"], "scope_score", "scope", 3, "scope_rank").select("of", "scope", "scope_rank").checkpoint()
    # a term counts more than the places of the scopes, which order what shares as many
    none = F.array().cast("array<bigint>")
    bonus = scopes.groupBy("of").agg(F.collect_list(F.xxhash64("scope")).alias("scopes"), F.collect_list(-F.col("scope_rank").cast("bigint")).alias("scope_bonus"))
    queries = classes.join(bonus, "of").withColumns({"topics": none, "topic_bonus": none})
    some = R.first_alike(terms.groupBy("id").agg(F.any_value("scope").alias("scope"), F.sort_array(F.collect_set("h")).alias("terms")), ["scope", "terms"], 5)
    found = R.routed_top(queries, some.withColumn("topics", none), 5, 4).join(scopes, ["of", "scope"]).withColumn("score", F.floor((F.col("value") + F.col("scope_rank")) / 4))
    ranked = found.withColumn("best", F.max("score").over(Window.partitionBy("of"))).where(F.col("rank") <= F.when(F.col("best") >= 3, 3).otherwise(5))
    return ranked.join(members, "of").select("query_id", "id", "scope", "score", "scope_rank", "rank")


# memory

TURNS = f"(SELECT lower(trim(dialogue_code)) AS code, id, length(coalesce(user_prompt, '')) + length(coalesce(reply_content, '')) AS chars, row_number() OVER (PARTITION BY lower(trim(dialogue_code)) ORDER BY create_time DESC NULLS LAST, id DESC) AS back, count(*) OVER (PARTITION BY lower(trim(dialogue_code))) AS turns FROM {EXCHANGES} WHERE dialogue_code IS NOT NULL)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    e = live(spark, d, "chat_exchange", "dialogue_code", "user_prompt", "reply_content", "create_time").withColumn("code", T.code_key(F.col("dialogue_code"))).where("code is not null")
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    w = Window.partitionBy("code")
    return e.select("code", "id", (size("user_prompt") + size("reply_content")).alias("chars"), F.row_number().over(w.orderBy(F.desc_nulls_last("create_time"), F.desc("id"))).alias("back"), F.count(F.lit(1)).over(w).alias("turns"))


@query(f"SELECT code, id, back FROM {TURNS} WHERE back <= 4")
def memory_window(spark: SparkSession, d: str) -> DataFrame:
    """The latest four turns of each session."""
    return turns(spark, d).where("back <= 4").select("code", "id", "back")


@query(f"SELECT code, id, ((turns - back) // 6)::BIGINT AS batch FROM {TURNS} WHERE back > 4")
def memory_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Older turns in batches of six for the summary, which leaves the latest four alone."""
    return turns(spark, d).where("back > 4").select("code", "id", F.floor((F.col("turns") - F.col("back")) / 6).alias("batch"))


@query(f"SELECT code, id, used::BIGINT AS used, used <= 1600 AS for_planning, used <= 1000 AS for_answer FROM (SELECT *, sum(chars) OVER (PARTITION BY code ORDER BY back ROWS UNBOUNDED PRECEDING) AS used FROM {TURNS})")
def history_budget(spark: SparkSession, d: str) -> DataFrame:
    """From the last turn back, what fits into 1600 and 1000 characters."""
    w = Window.partitionBy("code").orderBy("back").rowsBetween(Window.unboundedPreceding, 0)
    return turns(spark, d).withColumn("used", F.sum("chars").over(w)).select("code", "id", "used", (F.col("used") <= 1600).alias("for_planning"), (F.col("used") <= 1000).alias("for_answer"))


@query(f"""SELECT code, count(*) AS turns, count_if(back <= 4 AND recent <= 2200) AS kept, count_if(back > 4 AND old <= 1400) AS summarised, count_if(back > 4 AND old > 1400) AS left_out FROM (
  SELECT *, sum(CASE WHEN back <= 4 THEN chars ELSE 0 END) OVER w AS recent, sum(CASE WHEN back > 4 THEN least(chars, 200) ELSE 0 END) OVER w AS old FROM {TURNS} WINDOW w AS (PARTITION BY code ORDER BY back ROWS UNBOUNDED PRECEDING)) GROUP BY code""")
def memory_budget(spark: SparkSession, d: str) -> DataFrame:
    """Turns whose text stays (of the latest four, within 2200 characters), those a summary of 1400 characters holds at 200
    each [choice], and the rest."""
    w = Window.partitionBy("code").orderBy("back").rowsBetween(Window.unboundedPreceding, 0)
    new = F.col("back") <= 4
    t = turns(spark, d).withColumn("recent", F.sum(F.when(new, F.col("chars")).otherwise(0)).over(w)).withColumn("old", F.sum(F.when(~new, F.least("chars", F.lit(200))).otherwise(0)).over(w))
    return t.groupBy("code").agg(F.count(F.lit(1)).alias("turns"), F.count_if(new & (F.col("recent") <= 2200)).alias("kept"), F.count_if(~new & (F.col("old") <= 1400)).alias("summarised"), F.count_if(~new & (F.col("old") > 1400)).alias("left_out"))


# structure


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
SELECT doc_id, count(*) + 1 AS nodes, count_if(regexp_matches(line, '^#{1,6}\\s')) AS sections FROM l
WHERE regexp_matches(line, '^#{1,6}\\s') OR regexp_matches(line, '^\\s*\\d+[.)]\\s+\\S') OR regexp_matches(line, '^\\s*[-*]\\s+\\S') GROUP BY doc_id""")
def structure_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each text that has more than its root."""
    nodes = S.structure_nodes(table(spark, d, "documents"), "doc_id", "text")
    return nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind") == S.SECTION).alias("sections")).where("nodes > 1")


NODES_SQL = """WITH RECURSIVE line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
marked AS (SELECT doc_id, n, length(regexp_extract(line, '^(#{1,6})\\s', 1)) AS level, CASE WHEN regexp_matches(line, '^#{1,6}\\s') THEN 2 WHEN regexp_matches(line, '^\\s*\\d+[.)]\\s+\\S') THEN 3 WHEN regexp_matches(line, '^\\s*[-*]\\s+\\S') THEN 4 END AS kind, trim(regexp_replace(line, '^\\s*(#{1,6}|\\d+[.)]|[-*])\\s+', '')) AS title FROM line),
node AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS node_no, kind, level, title FROM (SELECT doc_id, n, kind, level, title FROM marked WHERE kind IS NOT NULL UNION ALL SELECT doc_id, -1, 1, 0, '' FROM documents)),
head AS (SELECT doc_id, node_no, level FROM node WHERE kind <= 2),
deep AS (SELECT n.*, CASE WHEN kind <= 2 THEN n.level ELSE (SELECT arg_max(h.level, h.node_no) FROM head h WHERE h.doc_id = n.doc_id AND h.node_no < n.node_no) + 1 END AS depth FROM node n),
tree AS (SELECT d.doc_id, d.node_no, any_value(d.kind) AS kind, any_value(d.depth) AS depth, any_value(d.title) AS title, max(h.node_no) AS parent_no FROM deep d LEFT JOIN head h ON h.doc_id = d.doc_id AND h.node_no < d.node_no AND h.level < d.depth GROUP BY d.doc_id, d.node_no)"""


@query(NODES_SQL + " SELECT doc_id, node_no::INT AS node_no, kind::INT AS kind, depth::INT AS depth, title, parent_no::INT AS parent_no, (lag(node_no) OVER w)::INT AS previous_no, (lead(node_no) OVER w)::INT AS next_no FROM tree WINDOW w AS (PARTITION BY doc_id, parent_no ORDER BY node_no)")
def structure_nodes(spark: SparkSession, d: str) -> DataFrame:
    return S.siblings(S.structure_nodes(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(NODES_SQL + """, way AS (SELECT doc_id, node_no, title AS path FROM tree WHERE parent_no IS NULL UNION ALL SELECT t.doc_id, t.node_no, w.path || '/' || t.title FROM tree t JOIN way w ON t.doc_id = w.doc_id AND t.parent_no = w.node_no)
SELECT doc_id, node_no::INT AS node_no, path FROM way""")
def structure_paths(spark: SparkSession, d: str) -> DataFrame:
    return S.paths(S.structure_nodes(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(NODES_SQL + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_no ORDER BY node_no) AS place FROM tree),
way AS (SELECT doc_id, node_no, '' AS code FROM ordered WHERE parent_no IS NULL UNION ALL SELECT t.doc_id, t.node_no, CASE WHEN w.code = '' THEN t.place::VARCHAR ELSE w.code || '.' || t.place END FROM ordered t JOIN way w ON t.doc_id = w.doc_id AND t.parent_no = w.node_no)
SELECT doc_id, node_no::INT AS node_no, code FROM way""")
def structure_codes(spark: SparkSession, d: str) -> DataFrame:
    """The code of every node: its place below its parent, behind its parent's code."""
    return S.codes(S.structure_nodes(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(f"""
WITH RECURSIVE n AS (SELECT id, parent_scope_id, scope_code FROM {SCOPES}),
t AS (SELECT id, id AS root, 0 AS depth, scope_code AS path FROM n WHERE parent_scope_id IS NULL UNION ALL SELECT n.id, t.root, t.depth + 1, t.path || '/' || n.scope_code FROM n JOIN t ON n.parent_scope_id = t.id)
SELECT id, root, depth, path FROM t""")
def scope_paths(spark: SparkSession, d: str) -> DataFrame:
    return S.scope_paths(live(spark, d, "knowledge_scope_node", "parent_scope_id", "scope_code"), "id", "parent_scope_id", "scope_code")


@query(f"SELECT section_path, count(*) AS chunks, min(document_id) AS first_document FROM {CHUNKS} WHERE regexp_matches(section_path, '(^|[>/／])\\s*1\\s') GROUP BY 1")
def locate_section(spark: SparkSession, d: str) -> DataFrame:
    """Chunks below a section numbered 1, whichever separator the path has."""
    c = live(spark, d, "document_chunk", "section_path", "document_id").where(F.col("section_path").rlike(r"(^|[>/／])\s*1\s"))
    return c.groupBy("section_path").agg(F.count(F.lit(1)).alias("chunks"), F.min("document_id").alias("first_document"))


@query(f"SELECT d.id, file_type, CASE WHEN max(length(c.section_path)) IS NULL THEN 0 WHEN count(DISTINCT c.section_path) > 3 THEN 3 ELSE count(DISTINCT c.section_path) END AS structure_level, count(c.id) AS chunks FROM {DOCS} d LEFT JOIN {CHUNKS} c ON c.document_id = d.id GROUP BY d.id, file_type")
def document_profile(spark: SparkSession, d: str) -> DataFrame:
    """Type, level of structure (0 to 3) and chunks of every document."""
    c = live(spark, d, "document_chunk", "document_id", "section_path").groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("section_path").alias("s"), F.count(F.lit(1)).alias("n"))
    return live(spark, d, "agent_document", "file_type").join(c, "id", "left").select("id", "file_type", F.when(F.col("s") > 0, F.least("s", F.lit(3))).otherwise(0).alias("structure_level"), F.coalesce("n", F.lit(0)).alias("chunks"))


@query(f"WITH gone AS (SELECT id FROM {DOCS} WHERE index_status = 4) SELECT c.id, c.document_id FROM {CHUNKS} c WHERE c.document_id NOT IN (SELECT id FROM gone)")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the chunks once documents whose index failed are deleted."""
    gone = live(spark, d, "agent_document", "index_status").where("index_status = 4").select(F.col("id").alias("document_id"))
    return live(spark, d, "document_chunk", "document_id").where("document_id is not null").join(gone, "document_id", "left_anti").select("id", "document_id")
