import pytest
from pyspark.sql import functions as F

from skein.operators import extensions as X


def test_unknown_parts():
    with pytest.raises(KeyError, match="no chunk strategy named none"):
        X.part("chunk strategy", "none")
    with pytest.raises(ValueError):
        X.register("weather", "x")


def test_models(spark):
    df = spark.createDataFrame([("one two", "two three"), (None, None), ("", "x")], "q string, t string")
    echo, v, score = zip(*df.select(X.echo_model(F.col("q")), X.hashed_embedding(F.col("q")), X.overlap_rerank(F.col("q"), F.col("t"))).collect())
    assert echo == ("echo: one two", None, "echo: ")
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-6 and v[1] is None and v[2] is None
    assert score == (0.5, 0.0, 0.0)


def test_pipeline_keeps_the_text(spark):
    text = "intro\n# A\n" + "a" * 1000 + "\n# B\nb"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, t string")
    out = {r.path: r.chunk_text for r in X.pipeline(df, "id", "t", ["structure", "recursive"]).collect()}
    assert set(out) == {"1/0/0", "1/1/0", "1/1/1", "1/2/0"} and out["1/2/0"] == "# B\nb"


def test_lookup(spark):
    df = spark.createDataFrame([(" AB ",), ("zz",), (None,)], "k string")
    rows = spark.createDataFrame([("ab", "found")], "code string, state string")
    assert sorted((r.k or "", r.state) for r in X.keyed_lookup(df, "k", rows, {"state": "none"}).collect()) == [("", "none"), (" AB ", "found"), ("zz", "none")]


def test_session_context(spark):
    assert spark.range(1).select(X.session_context(F.array(F.lit(1), F.lit(2)), F.lit(" x "))).first()[0] == "messages=2, focus=x"


def test_sql_models(spark):
    X.register_sql(spark)
    assert spark.sql("SELECT echo_model('a')").first()[0] == "echo: a"
