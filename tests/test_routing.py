"""Routing of many questions to many documents that share words."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import retrieval as R
from skein.plans import catalog
from tests.compare import assert_same, connect


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """2000 documents and 300 questions, all of which share a word."""
    d, rng = str(tmp_path_factory.mktemp("routes")), random.Random(7)
    things = [f"thing{i}" for i in range(12)]
    tags = [None, "", "a,,b", "Thing1, draft", "thing2,a,a", "b"]
    scopes = ["hr", " HR ", "it", "law", "far", None, "  ", "Ops"]
    docs = [(i, rng.choice(scopes), f"the {rng.choice(things)} {rng.choice(things)} name{i}", rng.choice(tags), None, 1) for i in range(1, 2001)]
    asked = [(20 * i, "the " + " ".join(rng.sample(things, rng.randint(0, 3))) + (f" name{rng.randint(1, 2000)}" if i % 3 else ""), None, 1) for i in range(1, 301)]
    nodes = [(1, "hr", "thing3", "x, y", None, None, 1), (2, "Hr ", "the thing4", None, "thing5 thing3", None, 1), (3, "law", "thing3 thing6", None, None, None, 1), (4, "none", "the", None, None, None, 1)]
    late = "edit_time timestamp, status int"
    spark.createDataFrame(docs, f"id long, knowledge_scope_code string, document_name string, document_tags string, {late}").repartition(3).write.parquet(f"{d}/agent_document.parquet")
    spark.createDataFrame(asked, f"id long, user_prompt string, {late}").coalesce(1).write.parquet(f"{d}/chat_exchange.parquet")
    spark.createDataFrame(nodes, f"id long, scope_code string, scope_name string, aliases string, example_questions string, {late}").coalesce(1).write.parquet(f"{d}/knowledge_scope_node.parquet")
    return d


@pytest.mark.parametrize("name", ["route_funnel", "route_cascade"])
def test_questions_meet_no_single_documents(spark, folder, name):
    """As SQL says, and without a row for each of the 600,000 pairs of a question and a document that share a word."""
    before = shuffled(spark)
    assert_same(catalog.QUERIES[name](spark, folder), connect(folder), catalog.SQL[name])
    assert sum(n for stage, n in shuffled(spark).items() if stage not in before) < 150_000


@pytest.mark.parametrize("name", ["route_cascade", "route_funnel"])
def test_every_question_is_routed(spark, tmp_path, name):
    """Whatever its id, a question that shares a word with a document in a scope has a route."""
    late = "edit_time timestamp, status int"
    spark.createDataFrame([(1, "hr", "the leave form", "a,b", None, 1), (2, "it", "the laptop form", None, None, 1)], f"id long, knowledge_scope_code string, document_name string, document_tags string, {late}").write.parquet(f"{tmp_path}/agent_document.parquet")
    spark.createDataFrame([(i, "which form" if i % 2 else "laptop?", None, 1) for i in range(1, 46)], f"id long, user_prompt string, {late}").write.parquet(f"{tmp_path}/chat_exchange.parquet")
    spark.createDataFrame([(1, "hr", "people", None, None, None, 1)], f"id long, scope_code string, scope_name string, aliases string, example_questions string, {late}").write.parquet(f"{tmp_path}/knowledge_scope_node.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert {r.query_id for r in found.select("query_id").collect()} == set(range(1, 46))
    assert_same(found, connect(str(tmp_path)), catalog.SQL[name])


def test_routed_top_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "TEXT_BLOCK", 40)
    rng = random.Random(3)
    some = lambda of, most: rng.sample(of, rng.randint(0, most))
    code = lambda *x: "-".join(x)
    names = ["a", "b", "c", "d"]
    docs = [(i, some(range(12), 5), s := rng.choice(names), [code(s, t) for t in some(names, 3)]) for i in range(150)]
    queries = []
    for i in range(30):
        own = some(names, 3)
        topics = [code(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 4))]
        queries.append((i, some(range(14), 6), own, [rng.randint(-3, 9) for _ in own], topics, [rng.randint(1, 9) for _ in topics]))
    hashes = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    q = spark.createDataFrame(queries, "of long, terms array<long>, scopes array<string>, scope_bonus array<long>, topics array<string>, topic_bonus array<long>").withColumns({"scopes": hashes("scopes"), "topics": hashes("topics")})
    t = spark.createDataFrame(docs, "id long, terms array<long>, scope string, topics array<string>").withColumn("topics", hashes("topics"))
    got = {(r.of, r["rank"]): (r.id, r.scope, r.value) for r in R.routed_top(q, t, 5, 10).collect()}
    want = {}
    for of, terms, scopes, bonus, topics, more in queries:
        rows = [(i, s, 10 * len(set(w) & set(terms)) + bonus[scopes.index(s)] + max([m for x, m in zip(topics, more) if x in own], default=0)) for i, w, s, own in docs if s in scopes and set(w) & set(terms)]
        want |= {(of, k + 1): r for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0]))[:5])}
    assert got == want and len(want) > 60
    assert R.routed_top(q, t.where("false"), 5, 10).count() == 0 == R.routed_top(q.where("false"), t, 5, 10).count()
