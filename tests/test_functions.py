import math

import numpy as np
from pyspark.ml.feature import Tokenizer
from pyspark.sql import functions as F

from topicspace.functions import text as T
from topicspace.functions import vectors as V

TEXTS = ["", "a", "A b", " lead", "inner  gap", "trail ", "trail  \t", "   ", "x\ty\nz",
         "Élan vital ÇA", "a\x0bb\x0cc\rd"]


def test_ml_tokens_match_spark_tokenizer(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    ours = {r.id: list(r.tok) for r in df.select("id", T.ml_tokens("t").alias("tok")).collect()}
    ref = {r.id: list(r.words) for r in Tokenizer(inputCol="t", outputCol="words").transform(df).collect()}
    assert ours == ref


def test_word_and_stream_tokens(spark):
    df = spark.createDataFrame([("Hello, wörld! an ox-cart  runs\tfar",)], "t string")
    r = df.select(T.word_tokens("t").alias("w"), T.stream_tokens("t").alias("s"),
                  T.word_tokens("t", 2).alias("w2")).first()
    assert r.w == ["hello", "wörld", "cart", "runs", "far"]
    assert r.w2 == ["hello", "wörld", "an", "ox", "cart", "runs", "far"]
    assert r.s == ["Hello,", "wörld!", "an", "ox-cart", "runs", "far"]


def test_title_and_content(spark):
    df = spark.createDataFrame([("Title one\nline a\nline b",), ("Only title",)], "t string")
    rows = df.select(T.first_line("t").alias("title"), T.join_rest_lines("t").alias("c"),
                     T.normalize_title(T.first_line("t")).alias("key")).collect()
    assert [tuple(r) for r in rows] == [("Title one", "line a line b", "Title_one"),
                                       ("Only title", "", "Only_title")]


def test_vector_functions(spark):
    a, b = [1.0, 2.0, 3.0], [0.5, -1.0, 4.0]
    df = spark.createDataFrame([(a, b), ([0.0, 0.0, 0.0], b)], "a array<double>, b array<double>")
    r = df.select(V.sqdist("a", "b").alias("sq"), V.euclidean("a", "b").alias("eu"),
                  V.cosine("a", "b").alias("co"), V.l2_normalize("a").alias("n"),
                  V.add("a", "b").alias("s"), V.scale("a", 2.0).alias("h")).collect()
    na, nb = np.array(a), np.array(b)
    assert math.isclose(r[0].sq, float(((na - nb) ** 2).sum()))
    assert math.isclose(r[0].eu, float(np.linalg.norm(na - nb)))
    assert math.isclose(r[0].co, 1 - float(na @ nb / np.linalg.norm(na) / np.linalg.norm(nb)))
    assert np.allclose(r[0].n, na / np.linalg.norm(na))
    assert r[0].s == [1.5, 1.0, 7.0] and r[0].h == [0.5, 1.0, 1.5]
    # a zero vector: cosine distance 1, normalised stays zero
    assert r[1].co == 1.0 and r[1].n == [0.0, 0.0, 0.0]


def test_stable_rounds_to_float(spark):
    df = spark.createDataFrame([(0.1 + 0.2,), (0.3,)], "x double")
    vals = [r.y for r in df.select(V.stable("x").alias("y")).collect()]
    assert vals[0] == vals[1]


def test_metric_lookup():
    assert V.metric("cosine") is V.cosine
    try:
        V.metric("manhattan")
    except ValueError:
        pass
    else:
        raise AssertionError("unknown metric accepted")


def test_ml_tokens_keep_codegen(spark):
    df = spark.range(3).select(F.lit("a b").alias("t"))
    plan = df.select(T.ml_tokens("t"))._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
