"""Calendar, text and identifier functions over tables, and the relational operators of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import ids as I
from skein.functions import text as T
from skein.operators import extensions as X
from skein.operators import joins as J
from skein.operators.versions import in_force, upsert
from skein.plans.registry import live, live_sql, query
from skein.session import work_folder
from skein.sources import frames
from skein.sources.tables import event_time, table, upsert_table, write_table
from skein.streaming import folds

EXCHANGES, DOCS = live_sql("chat_exchange"), live_sql("agent_document")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))


# calendar


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::INT AS day_key, strftime(o_orderdate, '%Y%m%d%H%M%S')::BIGINT AS second_key, (strftime(o_orderdate, '%Y%m%d%H%M%S') || '000')::BIGINT AS milli_key FROM orders")
def date_keys(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    return o.select("o_orderkey", D.int_day(F.col("at")).alias("day_key"), D.long_second(F.col("at")).alias("second_key"), D.long_milli(F.col("at")).alias("milli_key"))


@query("SELECT isodow(o_orderdate)::INT AS weekday, ['星期一', '星期二', '星期三', '星期四', '星期五', '星期六', '星期日'][isodow(o_orderdate)] AS name, count(*) AS n FROM orders GROUP BY 1, 2")
def weekday_names(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy(D.weekday_no(F.col("at")).alias("weekday"), D.weekday_name(F.col("at")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT ceil(dayofyear(o_orderdate) / 7.0)::INT AS week, (ceil(dayofyear(o_orderdate) / 7.0) - CASE WHEN isodow(date_trunc('year', o_orderdate)) = 1 THEN 0 ELSE 1 END)::INT AS full_week, count(*) AS n FROM orders GROUP BY 1, 2")
def week_of_year(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy(D.week_of_year(F.col("at")).alias("week"), D.full_week_of_year(F.col("at")).alias("full_week")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, strftime(date_trunc('day', o_orderdate) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS day_end,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_start, strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end,
  strftime(date_trunc('week', o_orderdate) + INTERVAL 2 DAY, '%Y-%m-%d') AS wednesday FROM orders""")
def date_nodes(spark: SparkSession, d: str) -> DataFrame:
    at, text = F.col("at"), lambda c: F.date_format(c, "yyyy-MM-dd")
    return orders(spark, d).select(
        "o_orderkey", F.year(at).alias("year"), F.month(at).alias("month"), F.day(at).alias("day"), F.date_format(D.day_end(at), "yyyy-MM-dd HH:mm:ss.SSS").alias("day_end"), text(F.trunc(at, "month")).alias("month_start"),
        text(F.last_day(at)).alias("month_end"), text(F.trunc(at, "week")).alias("week_start"), text(D.week_end(at)).alias("week_end"), text(D.weekday_of_same_week(at, F.lit(3))).alias("wednesday"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 YEAR, '%Y-%m-%d') AS next_year, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d') AS two_weeks, strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS earlier FROM orders")
def date_shifts(spark: SparkSession, d: str) -> DataFrame:
    at, text = F.col("at"), lambda c: F.date_format(c, "yyyy-MM-dd")
    shift = lambda **k: at + F.make_interval(**{n: F.lit(v) for n, v in k.items()})
    return orders(spark, d).select("o_orderkey", text(shift(years=1)).alias("next_year"), text(shift(months=1)).alias("next_month"), text(shift(weeks=2)).alias("two_weeks"), F.date_format(shift(mins=-90), "yyyy-MM-dd HH:mm:ss").alias("earlier"))


@query("SELECT id, CASE WHEN create_time IS NULL OR edit_time IS NULL THEN -1 ELSE (abs(epoch_ms(create_time) - epoch_ms(edit_time)) // 1000)::BIGINT END AS seconds, CASE WHEN create_time::DATE = edit_time::DATE THEN 2 WHEN create_time::DATE < edit_time::DATE THEN date_diff('day', create_time::DATE, edit_time::DATE) + 1 WHEN create_time IS NULL OR edit_time IS NULL THEN 0 ELSE 0 END::INT AS days FROM " + EXCHANGES)
def time_spans(spark: SparkSession, d: str) -> DataFrame:
    """Seconds between two times and the days from the one to the other; a day that is both ends stands twice."""
    e = live(spark, d, "chat_exchange", "create_time", "edit_time")
    a, b = F.col("create_time"), F.col("edit_time")
    return e.select("id", D.seconds_between(a, b).alias("seconds"), F.greatest(F.size(D.days_between(a.cast("date"), b.cast("date"))), F.lit(0)).alias("days"))


@query("SELECT strftime(unnest(generate_series(date_trunc('month', m), last_day(m), INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM (SELECT max(o_orderdate) AS m FROM orders)")
def month_calendar(spark: SparkSession, d: str) -> DataFrame:
    """All days of the month of the latest order."""
    m = orders(spark, d).agg(F.max("at").alias("m"))
    return m.select(F.explode(F.sequence(F.trunc("m", "month"), F.last_day("m"))).alias("day")).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') WHEN 2 THEN epoch_ms(o_orderdate)::VARCHAR WHEN 3 THEN '  ' ELSE 'never' END AS written, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <= 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM t""")
def lenient_dates(spark: SparkSession, d: str) -> DataFrame:
    """Times read back from several written forms; blank and senseless ones are null."""
    form = F.pmod("o_orderkey", F.lit(5))
    written = F.when(form == 0, F.date_format("at", "yyyy-MM-dd")).when(form == 1, F.date_format("at", "yyyy/MM/dd HH:mm:ss")).when(form == 2, F.unix_millis("at").cast("string")).when(form == 3, "  ").otherwise("never")
    return orders(spark, d).select("o_orderkey", F.date_format(D.lenient_time(written), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


# text


@query(f"""
SELECT id, CASE WHEN length(document_name) > 12 THEN left(document_name, 12) || '...' ELSE document_name END AS short_name, left(id::VARCHAR, 6) || '...' || right(id::VARCHAR, 6) AS short_id, coalesce(lower(trim(knowledge_scope_code)), '') AS scope,
  concat_ws(' · ', business_category, knowledge_scope_code) AS labels, least(100.0, greatest(0.0, token_count / 20.0)) AS percent FROM {DOCS}""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    x = live(spark, d, "agent_document", "document_name", "knowledge_scope_code", "business_category", "token_count")
    return x.select("id", T.truncated(F.col("document_name"), 12).alias("short_name"), T.short_id(F.col("id")).alias("short_id"), T.normalised(F.col("knowledge_scope_code")).alias("scope"), F.concat_ws(" · ", "business_category", "knowledge_scope_code").alias("labels"), F.when(F.col("token_count").isNull(), 0.0).otherwise(T.percent(F.col("token_count") / 20)).alias("percent"))


@query(f"SELECT id, CASE WHEN contains(section_path, ' > ') THEN left(section_path, length(section_path) - length(string_split(section_path, ' > ')[-1]) - 3) ELSE section_path END AS head, CASE WHEN contains(section_path, ' > ') THEN string_split(section_path, ' > ')[-1] ELSE '' END AS tail FROM {live_sql('document_chunk')}")
def split_last(spark: SparkSession, d: str) -> DataFrame:
    """Section paths cut at their last mark."""
    head, tail = T.split_last(F.col("section_path"), " > ")
    return live(spark, d, "document_chunk", "section_path").select("id", head.alias("head"), F.when(F.col("section_path").isNull(), "").otherwise(tail).alias("tail"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS subject, CASE WHEN o_orderkey % 7 <> 0 THEN 2000000000 + o_orderkey END AS expires, o_orderkey % 7 = 0 OR 2000005000 >= 2000000000 + o_orderkey AS expired FROM orders")
def jwt_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Claims read from tokens that are built here from orders, and whether a token has expired at a given time; one
    without an end has."""
    end = F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.lit(2000000000) + F.col("o_orderkey"))
    claims = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("sub"), end.alias("exp")))
    url = F.regexp_replace(F.translate(F.base64(F.encode(claims, "UTF-8")), "+/", "-_"), "[=\r\n]", "")
    payload = T.jwt_payload(F.concat(F.lit("e30."), url, F.lit(".c2ln")))
    expires = F.get_json_object(payload, "$.exp").cast("bigint")
    return orders(spark, d).select("o_orderkey", F.get_json_object(payload, "$.sub").alias("subject"), expires.alias("expires"), F.coalesce(F.lit(2000005000) >= expires, F.lit(True)).alias("expired"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k, CASE WHEN value IS NULL THEN 0.0 ELSE value END AS number FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), T.number(F.col("value")).alias("number"))


# identifiers


@query("SELECT event_id, ((epoch_us(ts) // 1000 - 1288834974657) << 22) | ((user_id % 32) << 17) | (3 << 12) | (event_id % 4096) AS id, epoch_us(ts) // 1000 AS millis FROM events")
def snowflake_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids composed from times and read back."""
    e = event_time(table(spark, d, "events"))
    e = e.select("event_id", I.snowflake(F.unix_millis("ts"), F.pmod("user_id", F.lit(32)), F.lit(3), F.pmod("event_id", F.lit(4096))).alias("id"))
    return e.withColumn("millis", I.snowflake_millis(F.col("id")))


@query("SELECT event_id, ((epoch_us(ts) // 1000 - 1288834974657) << 22) | ((event_id % 4096) << 6) | (user_id % 64) AS order_no FROM events")
def order_genes(spark: SparkSession, d: str) -> DataFrame:
    base = F.shiftleft((F.unix_millis(F.col("ts").cast("timestamp")) - I.EPOCH_MS).cast("bigint"), 22)
    return table(spark, d, "events").select("event_id", I.with_gene(base, F.pmod("event_id", F.lit(4096)), F.col("user_id"), 64).alias("order_no"))


@query("WITH u AS (SELECT event_id, (event_id << 35) | ((user_id % 4194304) << 13) | (event_id % 8192) AS uid, user_id FROM events) SELECT event_id, uid, (1716134400 + event_id)::BIGINT AS seconds, (user_id % 4194304)::BIGINT AS worker, (event_id % 8192)::BIGINT AS sequence FROM u")
def uid_parse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", I.uid(F.col("event_id") + I.UID_EPOCH_S, F.pmod("user_id", F.lit(1 << 22)), F.pmod("event_id", F.lit(1 << 13))).alias("uid"))
    seconds, worker, sequence = I.uid_parts(F.col("uid"))
    return e.select("event_id", "uid", seconds.alias("seconds"), worker.alias("worker"), sequence.alias("sequence"))


@query("SELECT (5::BIGINT << 35) | (7::BIGINT << 13) | range AS uid FROM range(8192)")
def uid_batch(spark: SparkSession, d: str) -> DataFrame:
    """All ids of one worker and second."""
    return spark.range(1 << I.UID_SEQUENCE_BITS).select(I.uid(F.lit(I.UID_EPOCH_S + 5), F.lit(7), F.col("id")).alias("uid"))


# set operations


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    keys = lambda status: o.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))
    return keys("F").intersect(keys("O")).subtract(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("""
WITH c AS (SELECT (min(epoch_us(edit_time)) + max(epoch_us(edit_time))) // 2 AS cut FROM agent_document),
x AS (SELECT id, status, edit_time, epoch_us(edit_time) >= cut AS fresh FROM agent_document, c WHERE edit_time IS NOT NULL)
SELECT id, CASE WHEN bool_and(fresh) THEN 'inserted' WHEN bool_or(fresh) THEN 'replaced' ELSE 'kept' END AS origin, arg_max(status, (fresh::INT, edit_time)) AS status FROM x GROUP BY id""")
def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the deliveries upserted into the table that the earlier half makes."""
    rows = table(spark, d, "agent_document").where("edit_time is not null").select("id", "status", "edit_time").withColumn("at", F.unix_micros(F.col("edit_time").cast("timestamp")))
    cut = rows.agg(F.floor((F.min("at") + F.max("at")) / 2).alias("cut"))
    marked = rows.crossJoin(F.broadcast(cut))  # one row
    half = lambda late: in_force(marked.where((F.col("at") >= F.col("cut")) == F.lit(late)).select("id", "status", "edit_time"), ["status"], status=None)
    return upsert(half(False), half(True), "id")


@query("""
WITH c AS (SELECT (min(epoch_us(edit_time)) + max(epoch_us(edit_time))) // 2 AS cut FROM document_embedding),
x AS (SELECT id, embedding_model, edit_time, epoch_us(edit_time) >= cut AS fresh FROM document_embedding, c WHERE edit_time IS NOT NULL)
SELECT id, arg_max(coalesce(embedding_model, ''), (fresh::INT, edit_time)) AS model FROM x GROUP BY id""")
def stored_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """A table of embeddings written from the earlier half of its deliveries, then upserted with the later half."""
    folder = work_folder(spark)
    rows = table(spark, d, "document_embedding").where("edit_time is not null").select("id", "embedding", "embedding_model", "edit_time").withColumn("at", F.unix_micros(F.col("edit_time").cast("timestamp")))
    cut = rows.agg(F.floor((F.min("at") + F.max("at")) / 2).alias("cut"))
    marked = rows.crossJoin(F.broadcast(cut))  # one row
    half = lambda late: in_force(marked.where((F.col("at") >= F.col("cut")) == F.lit(late)).drop("at", "cut"), ["embedding", "embedding_model"], status=None)
    write_table(half(False), folder, "embedding")
    upsert_table(spark, folder, "embedding", half(True), "id")
    return table(spark, folder, "embedding").select("id", F.coalesce("embedding_model", F.lit("")).alias("model"))


@query("SELECT title AS line, count(*) AS n FROM documents WHERE length(trim(title)) > 0 AND NOT regexp_matches(title, '[<>&\\s]{2}|[<&]|\\n|\\r') GROUP BY 1")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Titles written as text and as HTML files, read back as files: each line once of each kind."""
    folder = work_folder(spark)
    titles = table(spark, d, "documents").where("length(trim(title)) > 0").where(~F.col("title").rlike(r"[<>&\s]{2}|[<&]|\n|\r")).select("title")
    titles.coalesce(3).write.text(f"{folder}/plain")
    titles.coalesce(3).select(F.concat(F.lit("<p class='t'>"), F.col("title"), F.lit("</p>"))).write.text(f"{folder}/pages")
    files = frames.text_files(spark, f"{folder}/plain/*.txt").unionByName(frames.text_files(spark, f"{folder}/pages/*.txt").withColumn("text", frames.html_text(F.col("text"))))
    lines = files.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("line").agg((F.count(F.lit(1)) / 2).cast("bigint").alias("n"))


@query(f"SELECT id, len(list_distinct(t)) AS tags, list_contains(t, 'policy') AS has_policy, len(list_filter(t, lambda x: NOT list_contains(['policy', '流程'], x))) = 0 AS only_known FROM (SELECT id, list_filter(list_transform(string_split(coalesce(document_tags, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS t FROM {DOCS})")
def tag_sets(spark: SparkSession, d: str) -> DataFrame:
    t = live(spark, d, "agent_document", "document_tags").select("id", T.csv_list(F.col("document_tags")).alias("t"))
    known = F.array(F.lit("policy"), F.lit("流程"))
    return t.select("id", F.size(F.array_distinct("t")).alias("tags"), F.array_contains("t", "policy").alias("has_policy"), F.forall("t", lambda x: F.array_contains(known, x)).alias("only_known"))


# native relational operators


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, round(avg(l_discount), 6) AS avg_discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_discount"))


@query("SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) + grouping(o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def order_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), (F.grouping("o_orderstatus") + F.grouping("o_orderpriority")).cast("int").alias("level"))


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, count_if(k % 2 = 0) AS even, count_if(k % 2 = 1) AS odd FROM (SELECT event_type, (props::JSON ->> '$.k')::INT AS k FROM events) GROUP BY 1")
def event_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("half", F.when(F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(2)) == 0, "even").otherwise("odd"))
    return e.groupBy("event_type").pivot("half", ["even", "odd"]).count().na.fill(0)


@query("SELECT event_id, user_id, lag(value) OVER w AS previous, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS kind_rank, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    who = Window.partitionBy("user_id")
    w = who.orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.lag("value").over(w).alias("previous"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("mean3"), F.dense_rank().over(who.orderBy("event_type")).alias("kind_rank"), F.count(F.lit(1)).over(who).alias("n"))


@query("SELECT a.event_id, b.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def as_of_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Errors with the value of the user's last purchase up to then."""
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    failed = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return J.as_of(failed, bought, "user_id", "ts", "value", "last_purchase").select("event_id", "last_purchase")


@query("SELECT p_partkey, low FROM part JOIN (SELECT range AS low, range + 250 AS high FROM range(0, 3000, 250)) b ON p_retailprice >= low AND p_retailprice < high")
def price_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Parts in price ranges: an interval join as an equi-join on bins."""
    ranges = spark.range(0, 3000, 250).select(F.col("id").alias("low"), (F.col("id") + 250).alias("high"))
    return J.in_range(table(spark, d, "part"), ranges, "p_retailprice", "low", "high", 250).select("p_partkey", "low")


@query("SELECT k AS code, coalesce(n_name, 'UNKNOWN') AS name FROM (SELECT DISTINCT 'Nation_' || c_nationkey AS k, c_nationkey FROM customer UNION ALL SELECT ' nowhere ', -1) x LEFT JOIN nation ON n_nationkey = c_nationkey")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    """A keyed lookup with a default row; the table of nations is of fixed size."""
    named = lambda c: F.concat(F.lit("Nation_"), F.col(c).cast("string"))
    codes = table(spark, d, "customer").select(named("c_nationkey").alias("code")).distinct().unionByName(spark.createDataFrame([(" nowhere ",)], "code string"))
    names = table(spark, d, "nation").select(F.lower(named("n_nationkey")).alias("k"), F.col("n_name").alias("name"))
    return X.part("tool", "keyed lookup")(codes, "code", names, {"name": "UNKNOWN"})


@query("SELECT event_type, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.aggregates import exact_percentiles

    e = table(spark, d, "events")
    users = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return users.join(exact_percentiles(e, ["event_type"], "value", {"median": 0.5}).select("event_type", F.round("median", 6).alias("median")), "event_type")


# framed streams: every exchange's reply written as server-sent events and read back


def raw_streams(spark: SparkSession, d: str) -> DataFrame:
    e = live(spark, d, "chat_exchange", "reply_content", "exchange_state").where("reply_content is not null")
    line = lambda kind, content: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit(kind).alias("type"), content.alias("content"))))
    half = F.floor(F.length("reply_content") / 2).cast("int")
    texts = [line("status", F.lit("RUNNING")), line("text", F.substring("reply_content", F.lit(1), half)), line("text", F.substring("reply_content", half + 1, F.length("reply_content")))]
    last = F.when(F.col("exchange_state") == 3, line("error", F.lit("failed"))).when(F.col("exchange_state") == 4, line("stop", F.lit(""))).otherwise(line("status", F.lit("COMPLETED")))
    return e.select(F.col("id").alias("key"), F.concat_ws("\n\n", *texts, last, F.lit("data: [DONE]"), F.lit("")).alias("raw"))


def events_of(raw: DataFrame) -> DataFrame:
    return frames.sse_events(raw, "key", "raw").select("key", F.col("event_no").cast("bigint").alias("n"), "event.type", "event.content")


FOLD_SQL = f"SELECT id::VARCHAR AS key, reply_content AS text, '' AS thinking, CASE exchange_state WHEN 3 THEN 'FAILED' WHEN 4 THEN 'STOPPED' ELSE 'COMPLETED' END AS status, 4 AS n FROM {EXCHANGES} WHERE reply_content IS NOT NULL"


@query(FOLD_SQL)
def sse_fold_batch(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold_batch(events_of(raw_streams(spark, d)))


@query(FOLD_SQL)
def sse_fold_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same fold as a stream with state per key; the last update of a key holds."""
    work = work_folder(spark)
    events_of(raw_streams(spark, d)).write.parquet(f"{work}/events")
    stream = spark.readStream.schema("key bigint, n bigint, type string, content string").parquet(f"{work}/events")
    out = folds.run_updates(folds.fold_stream(stream), f"{work}/checkpoint", f"{work}/out", ["key"])
    return out.select("key", "text", "thinking", "status", "n")


@query("SELECT 'reply-' || (event_id % 50) AS key, string_agg(event_type, '' ORDER BY event_id) AS content, 'stop' AS finish_reason FROM events GROUP BY event_id % 50")
def model_streams(spark: SparkSession, d: str) -> DataFrame:
    """Streamed completions, written from events as data lines and put together again."""
    e = table(spark, d, "events").select("event_id", "event_type")
    line = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), F.col("event_type"), F.lit('"}}]}'))
    raw = e.groupBy(F.concat(F.lit("reply-"), F.pmod("event_id", F.lit(50)).cast("string")).alias("key")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"))
    end = F.lit('\n: note\ndata: {bad\ndata: {"choices":[{"delta":{},"finish_reason":"stop"}]}\ndata: [DONE]')
    return frames.model_stream(raw.select("key", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), end).alias("raw")), "key", "raw")


HOURS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


@query(HOURS)
def hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    return folds.tumbling(table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 6))


@query(HOURS)
def hourly_windows_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same windows over a stream of several micro-batches in the order of time, so nothing is late; a window that
    goes on in a later batch comes out again, and the last update holds."""
    work = work_folder(spark)
    events = table(spark, d, "events")
    third = [r[0] for r in events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.33, 0.66])).collect()][0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for low, high in zip([None, *third], [*third, None]):
        part = events.where((at >= low) if low is not None else F.lit(True)).where((at < high) if high is not None else F.lit(True))
        part.coalesce(1).write.mode("append").parquet(f"{work}/events")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/events")
    stream = folds.tumbling(source, "ts", "event_type", "value")
    out = folds.run_updates(stream, f"{work}/checkpoint", f"{work}/out", ["window_start", "event_type"])
    return out.select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM g GROUP BY user_id, g""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return folds.sessions(table(spark, d, "events"), "ts", "user_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS saved_at FROM events GROUP BY 1")
def latest_states(spark: SparkSession, d: str) -> DataFrame:
    """The last saved state of each thread."""
    e = event_time(table(spark, d, "events"))
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return last.select("user_id", F.col("m.event_type").alias("state"), F.date_format("m.ts", "yyyy-MM-dd HH:mm:ss").alias("saved_at"))


@query("SELECT doc_id, count(*) AS chunks, sum(length(text_)) AS chars FROM (SELECT doc_id, substring(text, at_::INT + 1, 800) AS text_ FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 121, 0), 680)) AS at_ FROM documents WHERE length(text) > 0)) GROUP BY 1")
def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """Two streaming jobs: documents are tidied, then cut into chunks, each from the folder the one before wrote."""
    from skein.operators.retrieval import window_chunks

    docs = table(spark, d, "documents").select("doc_id", "text")
    work = work_folder(spark)
    docs.write.parquet(f"{work}/queue")
    out = folds.ingest(spark, f"{work}/queue", docs.schema, work, lambda x: x.where(F.length("text") > 0), lambda x: window_chunks(x, "doc_id", "text"))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk_text")).alias("chars"))
