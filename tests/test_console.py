"""Route records, the keyword channel, separator chunks and upserts against plain versions."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import ids as I
from skein.functions import text as T
from skein.operators import extensions as X
from skein.operators import retrieval as R
from skein.operators import routes
from skein.operators.versions import in_force, upsert

FIELDS = "id long, exchange_id string, mode string, top_scopes_json string, top_topics_json string, top_documents_json string, selected_document_id string, hit_selected_document string, confidence string, route_status string, create_time timestamp"


def docs(*names):
    return "[" + ",".join(f'{{"documentId":"{n}","score":0.5}}' for n in names) + "]"


@pytest.fixture(scope="module")
def traces(spark):
    from datetime import datetime

    t = lambda n: None if n is None else datetime(2024, 1, 1, 0, n)
    data = [
        (1, "e1", "auto", '["a","b"]', '["t"]', docs("1", "2", "3", "4", "5"), None, None, "0.79", "1", t(1)),  # widened: unsure and five candidates
        (2, "e1", "shadow", "[]", "[]", docs("2", "9"), "9", "1", "0.8", "2", t(5)),  # later than the automatic one
        (3, "e2", "shadow", None, "", docs("7"), "8", "0", "0.9", "SUCCESS", t(9)),
        (4, "e2", "auto", "[bad", "[]", docs("1", "2", "3", "4"), "", "", "0.1", "3", t(2)),  # earlier, but automatic
        (5, "e3", "auto", "[]", "[]", "{}", "1", None, "", "LOW_CONFIDENCE", None),
        (6, "e3", "auto", "[]", "[]", '[{"documentName":"only a name"}]', "1", None, "x", "9", None),  # as early, so it holds
        (7, " ", " auto ", "[]", "[]", docs("1", "2", "3", "4", "5", "6"), "6", " 1 ", "1e999", None, t(3)),
    ]
    return spark.createDataFrame(data, FIELDS)


def test_route_records(traces):
    got = {r.id: r for r in routes.route_records(traces).collect()}
    assert [got[i].route_status for i in range(1, 8)] == ["SUCCESS", "LOW_CONFIDENCE", "SUCCESS", "FAILED", "LOW_CONFIDENCE", "FAILED", "FAILED"]
    assert [got[i].widened for i in range(1, 8)] == [True, False, False, False, False, False, False]
    assert [got[i].confidence for i in range(1, 8)] == [0.79, 0.8, 0.9, 0.1, None, None, None]
    assert [got[i].selected_place for i in range(1, 8)] == [None, 2, None, None, None, None, 6]
    assert [got[i].top_document for i in range(1, 8)] == ["1", "2", "7", "1", None, "only a name", "1"]
    assert (got[1].scope_count, got[1].topic_count, got[4].scope_count, got[3].topic_count) == (2, 1, 0, 0)


def test_route_summary(traces):
    r = routes.route_summary(routes.route_records(traces)).first()
    assert (r.total, r.auto, r.shadow, r.success, r.low_confidence, r.failed, r.high, r.widened, r.top_documents) == (7, 5, 2, 2, 2, 3, 2, 1, 4)
    assert (r.avg_confidence, r.shadow_hit_rate) == (round((0.79 + 0.8 + 0.9 + 0.1) / 4, 4), 50.0)
    assert r.low_rate == round(500 / 7, 6) and r.avg_documents == round((5 + 2 + 1 + 4 + 0 + 1 + 6) / 7, 6)
    nothing = routes.route_summary(routes.route_records(traces.where("false"))).first()
    assert nothing.total == 0 and nothing.success_rate is None and nothing.avg_confidence is None


def test_record_of_exchange(traces):
    got = {r.exchange_id: r.id for r in routes.record_of_exchange(routes.route_records(traces), "exchange_id", "id", "create_time").select("exchange_id", "create_time", "mode", F.col("route_status")).withColumn("id", F.lit(0)).collect()}
    assert set(got) == {"e1", "e2", "e3"}
    kept = {r.exchange_id: (r.mode, r.route_status) for r in routes.record_of_exchange(routes.route_records(traces), "exchange_id", "id", "create_time").collect()}
    assert kept == {"e1": ("shadow", "LOW_CONFIDENCE"), "e2": ("auto", "FAILED"), "e3": ("auto", "FAILED")}


def plain_tokens(t):
    out = []
    for run in re.findall(r"[一-鿿]+|[^\W_一-鿿]+", t.lower()):
        out += [run[i : i + 2] for i in range(max(1, len(run) - 1))] if "一" <= run[0] <= "鿿" else [run]
    return out


def test_tokens(spark):
    texts = ["A b1 c", "中文字 abc中文", "中", "", None, "a_b-c"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.tokens(F.col("t")).alias("t")).collect()]
    assert got == [None if t is None else plain_tokens(t) for t in texts]


@pytest.mark.parametrize("block", [5, 32_768])
def test_bm25_top_like_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(R, "TEXT_BLOCK", block)
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    rng = random.Random(9)
    words = ["red", "green", "blue", "中文", "文字", "rare", "rarer"]
    texts = [(i, " ".join(rng.choices(words, [9, 7, 5, 3, 3, 1, 0.3], k=rng.randint(0, 12))), i % 3) for i in range(60)] + [(100, None, 0), (101, "...", 1)]
    asked = [(i, t, g) for i, t, g in texts if i % 5 == 0] + [(900, "no such term", 0), (901, None, 1)]
    df = spark.createDataFrame(texts, "id bigint, t string, g int").withColumn("terms", F.lit(1)).withColumn("score", F.lit(2))
    q = spark.createDataFrame(asked, "qid bigint, t string, g int").withColumn("idf", F.lit(1))
    bags = {i: plain_tokens(t) for i, t, _ in texts if t and plain_tokens(t)}
    group = {i: g for i, _, g in texts}
    avgdl = sum(map(len, bags.values())) / len(bags)
    df_of = {w: sum(w in b for b in bags.values()) for w in {w for b in bags.values() for w in b}}
    for others, within in ((False, None), (True, None), (False, ("g", "g"))):
        want = set()
        for qid, t, g in asked:
            scores = []
            for i, b in bags.items():
                shared = [w for w in set(plain_tokens(t or "")) if w in b]
                if shared and not (others and i == qid) and not (within and group[i] != g):
                    s = sum(math.log(1 + (len(bags) - df_of[w] + 0.5) / (df_of[w] + 0.5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / avgdl)) for w in shared)
                    scores.append((-round(s, 6), i))
            want |= {(qid, i, -s, k + 1) for k, (s, i) in enumerate(sorted(scores)[:4])}
        got = {tuple(r) for r in R.bm25_top(q, "qid", "t", df, "id", "t", 4, others=others, within=within).collect()}
        assert {(a, b, k) for a, b, _, k in got} == {(a, b, k) for a, b, _, k in want}
    assert R.bm25_top(q, "qid", "t", df.where("false"), "id", "t", 4).count() == 0
    assert R.bm25_top(q.where("false"), "qid", "t", df, "id", "t", 4).count() == 0


def test_stored_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "id bigint, t string")
    R.store_index(R.postings(df, "id", "t"), str(tmp_path / "i"), 4)
    assert {tuple(r) for r in R.load_index(spark, str(tmp_path / "i"), ["a", "c", "none"], 4).select("term", "id", "tf", "dl").collect()} == {("a", 1, 2, 3), ("c", 2, 1, 2)}
    assert R.load_index(spark, str(tmp_path / "i"), None, 4).count() == 4 and R.load_index(spark, str(tmp_path / "i"), [], 4).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc  .\n,。中", min_size=1, max_size=500), st.integers(10, 60), st.integers(0, 9))
def test_separator_chunks_cover_the_text(t, size, overlap):
    out = R.cut_at_separators(t, size, overlap)
    assert all(len(c) <= size and t[b : b + len(c)] == c for b, c in out)
    at = 0
    for b, c in out:
        assert at - overlap <= b <= at < b + len(c)
        at = b + len(c)
    assert at == len(t)


def test_separator_chunks_prefer_paragraphs():
    t = "one two. three four.\n\nfive six. seven eight.\n\nnine"
    assert [c for _, c in R.cut_at_separators(t, 30, 0)] == ["one two. three four.\n\n", "five six. seven eight.\n\nnine"]
    assert R.cut_at_separators("x" * 50, 20, 5)[1][0] == 15


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "z")], "id int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert sorted(tuple(r) for r in upsert(old, new, "id").collect()) == [(1, "kept", "a"), (2, "replaced", None), (3, "inserted", "c")]
    assert upsert(old.where("false"), new.where("false"), "id").count() == 0


def test_files_of_one_write_arrive_in_order(spark, tmp_path):
    for n, v in enumerate(["first", "second", "third"]):
        spark.createDataFrame([(1, v, 5), (n + 10, v, 1)], "id int, v string, edit_time int").withColumn("status", F.lit(1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    assert {r.v for r in in_force(spark.read.parquet(str(tmp_path / "t")), ["v"]).where("id = 1").collect()} == {"third"}


def test_layouts():
    with pytest.raises(ValueError):
        I.Layout(28, 22, 12)
    x = I.Layout(28, 22, 13)
    assert (x.most_time, x.most_workers, x.most_sequence, x.time_shift, x.worker_shift) == ((1 << 28) - 1, (1 << 22) - 1, 8191, 35, 13)


def test_values_shown(spark):
    df = spark.range(1, 31).withColumn("n", F.lit(30))
    shown = [r.w for r in df.select(T.page_window(F.col("id"), F.col("n")).alias("w")).orderBy("id").collect()]
    assert shown[0] == shown[3] == "1 2 3 4 5 ... 30" and shown[4] == "1 ... 4 5 6 ... 30" and shown[27] == "1 ... 26 27 28 29 30"
    one = spark.createDataFrame([(1, [" 2", "9", "1", "2"], None, 1023)], "a int, l array<string>, x double, k bigint")
    r = one.select(T.allowed(F.col("l"), ["1", "2"]).alias("l"), T.fixed(F.col("x"), 4).alias("x"), T.thousands(F.col("x").cast("bigint")).alias("t"), I.log2_floor(F.col("k")).alias("m"), I.base36(F.lit(35 * 36 + 10)).alias("b"), T.pretty(F.lit("[bad"), "array<int>").alias("p")).first()
    assert (r.l, r.x, r.t, r.m, r.b, r.p) == (["2", "1"], "-", "0", 9, "za", "[bad")
    end = spark.sql("SELECT timestamp'2024-01-31 10:00:00' AS t, CAST(NULL AS timestamp) AS n").select(F.date_format(D.added(F.col("t"), "month", 1), "yyyy-MM-dd").alias("m"), D.formatted(F.col("n"), "utc").alias("e"), D.node(F.col("n")).alias("d")).first()
    assert (end.m, end.e, end.d) == ("2024-02-29", "", None)


def test_sub_questions(spark):
    texts = ["What? And why? ", "one; two\nthree；four;five", "1. a\n2) b", "...", "价格和期限分别是多少", "分别说明", "a和b"]
    got = [r.q for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.split_questions(F.col("t")).alias("q")).collect()]
    assert got == [["What?", "And why?"], ["one", "two", "three", "four"], ["a", "b"], ["..."], ["价格是多少", "期限是多少"], ["分别说明"], ["a和b"]]


def test_memory_and_channels(spark):
    turns = spark.createDataFrame([("a", i, 100) for i in range(6)] + [("b", i, 200) for i in range(5)], "g string, n int, size int")
    count = lambda name: {r.g: r["count"] for r in X.part("memory strategy", name)(turns, "g", [F.desc("n")], "size").groupBy("g").count().collect()}
    assert count("none") == {"a": 1, "b": 1} and count("sliding") == {"a": 3, "b": 3} and count("summary") == {"a": 6, "b": 2}
    texts = spark.createDataFrame([(1, "red green"), (2, "green blue"), (3, "grey")], "id bigint, t string")
    q = spark.createDataFrame([(7, "green red")], "qid bigint, q string")
    for name in ("keyword", "overlap"):
        assert [r.id for r in X.part("channel", name)(q, "qid", "q", texts, "id", "t", 5).orderBy("rank").collect()] == [1, 2]
