from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.operators.running import running_sum
from skein.operators import aggregates as A
from skein.operators import joins as J
from skein.operators import retrieval as R
from skein.operators import structure as S
from skein.operators import versions
from skein.sources import frames
from skein.streaming import folds


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def deliveries(spark, tmp_path):
    t = lambda day: datetime(2024, 1, day)
    data = [(1, "old", t(1), 1), (1, "new", t(2), 1), (1, "new", t(2), 1), (2, "gone", t(3), 0), (2, "was", t(1), 1), (3, "only", None, None), (None, "lost", t(1), 1), (4, "a", t(1), 1), (4, "b", None, 1)]
    df = spark.createDataFrame(data, "id bigint, v string, edit_time timestamp, status int")
    df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t"))
    return df, spark.read.parquet(str(tmp_path / "t"))


@pytest.mark.parametrize("most", [0, 1000])
def test_in_force(deliveries, monkeypatch, most):
    monkeypatch.setattr(versions, "BROADCAST_KEYS", most)
    for df in deliveries:
        assert rows(versions.in_force(df, ["v"])) == [(1, "new"), (3, "only"), (4, "a")]
        assert [r[0] for r in rows(versions.in_force(df, ["v"], status=None))] == [1, 2, 3, 4]


def test_in_force_empty(spark, tmp_path):
    spark.createDataFrame([], "id bigint, edit_time timestamp, status int").write.parquet(str(tmp_path / "e"))
    assert versions.in_force(spark.read.parquet(str(tmp_path / "e")), []).count() == 0


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("c", 1, 1)], "k string, t int, v int")
    assert rows(J.as_of(left, right, "k", "t", "v", "x").where("x is not null")) == [("a", 5, 50)]


def test_in_range(spark):
    left = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (25.0,)], "p double")
    right = spark.createDataFrame([(0.0, 10.0), (5.0, 26.0), (3.0, 3.0)], "lo double, hi double")
    assert rows(J.in_range(left, right, "p", "lo", "hi", 4.0)) == [(0.0, 0.0, 10.0), (9.99, 0.0, 10.0), (9.99, 5.0, 26.0), (10.0, 5.0, 26.0), (25.0, 5.0, 26.0)]


def test_exact_percentiles(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 2, 10)] + [("g", None), ("h", 7.0)], "g string, v double")
    assert rows(A.exact_percentiles(df, ["g"], "v", {"m": 0.5, "p": 0.9})) == [("g", 2.0, pytest.approx(7.6), 4), ("h", 7.0, 7.0, 1)]


def test_window_chunks_rebuild_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2000))
    parts = [r[2] for r in rows(R.window_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string"), "id", "t", 800, 120))]
    assert parts[0] + "".join(p[120:] for p in parts[1:]) == text


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "q int, id int, rank int")
    left = {(r.q, r.id): r.rrf_score for r in R.fuse({"x": a, "y": b}, "q", "id").collect()}
    right = {(r.q, r.id): r.rrf_score for r in R.fuse({"x": b, "y": a}, "q", "id").collect()}
    assert left == right and left[1, 11] > left[1, 10]


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 4, 9, 1])], "q int, i int, n int")
    out = {r.i: r.is_rendered for r in R.within_budget(df, ["q"], ["i"], F.col("n"), 8).collect()}
    assert out == {0: True, 1: True, 2: False, 3: False}


def test_vector_top_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).astype("float32")
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [1.0] * 3)]
    df = spark.createDataFrame(data, "id bigint, v array<float>")
    monkeypatch.setattr(R, "QUERY_BLOCK", 10)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 7)
    got = {(r.query_id, r.rank): r.id for r in R.vector_top(df.where("id % 2 = 0"), df, "id", "v", 3, 8).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    np.fill_diagonal(s, -2)
    for q in range(0, 60, 2):
        want = sorted(range(60), key=lambda i: (-s[q, i], i))[:3]
        assert [got[q, k] for k in (1, 2, 3)] == want


def test_split_questions(spark):
    q = lambda t: spark.createDataFrame([(t,)], "t string").select(R.split_questions(F.col("t"))).first()[0]
    assert q("What is A? And B？") == ["What is A?", "And B？"]
    assert q("1. one\n2. two; three") == ["one", "two", "three"]
    assert q("plain") == ["plain"]
    assert len(q("a?b?c?d?e?f?")) == 4


def test_structure(spark):
    text = "# A\n1. s1\n## B\n- i1\n- i2\n# C"
    nodes = S.structure_nodes(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t")
    tree = {r.node_no: (r.title, r.parent_no) for r in nodes.where("id = 1").collect()}
    assert tree == {1: ("", None), 2: ("A", 1), 3: ("s1", 2), 4: ("B", 2), 5: ("i1", 4), 6: ("i2", 4), 7: ("C", 1)}
    paths = {r.node_no: r.path for r in S.paths(nodes, "id").where("id = 1").collect()}
    assert paths[5] == "/A/B/i1"


def test_sse_frames(spark):
    raw = 'data: {"type":"text","content":"a"}\r\n\r\ndata: {"type":"text",\ndata: "content":"b"}\n\ndata: [DONE]\n\n{"type":"status","content":"X"}\n{bad\n{"type":"text","content":"c"}'
    got = [r.event.content for r in frames.sse_events(spark.createDataFrame([(1, raw), (2, None), (3, "")], "k int, r string"), "k", "r").orderBy("event_no").collect()]
    assert got == ["a", "b", "X", "c"]


def test_fold_orders_and_ends(spark):
    e = [("k", 3, "text", "b"), ("k", 1, "text", "a"), ("k", 2, "thinking", "t"), ("k", 4, "thinking", "t"), ("k", 5, "error", None), ("k", 6, "status", "COMPLETED"), ("j", 1, "text", None)]
    assert rows(folds.fold_batch(spark.createDataFrame(e, "key string, n bigint, type string, content string"))) == [("j", "", "", "RUNNING", 1), ("k", "ab", "t", "FAILED", 6)]


def test_html(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>T</h1><script>x<y</script><p>a &amp; b</p><ul><li>i</li></ul>")
    (tmp_path / "b.txt").write_text("<p> stays")
    got = [r.text for r in frames.text_files(spark, str(tmp_path)).orderBy("path").collect()]
    assert got == ["T\na & b\ni", "<p> stays"]


def test_running_sum(spark):
    import random

    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(data, "g string, t int, v int").withColumn("before", F.lit("x")).repartition(5)
    got = {r.t: r.sum for r in running_sum(df, "g", ["t"], "v", "sum").collect()}
    seen = {}
    for g, t, v in data:
        assert got[t] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + (v or 0)
    assert running_sum(df.where("false"), "g", ["t"], "v", "sum").count() == 0
