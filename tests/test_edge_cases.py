"""Inputs that once gave wrong or cut results."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from topicspace_cases import write
from topicspace.functions.vectors import vector_entries
from topicspace.operators import categories as C
from topicspace.operators import labels as L
from topicspace.operators.common import bounded_broadcast, row_bytes, spread
from topicspace.operators.evaluation import class_scores, topk_accuracy, true_class_ranks
from topicspace.operators.sampling import hash_sample, split_parts
from topicspace.operators.tfidf import hashed_term_frequency
from topicspace.operators.vectors import document_vectors, vector_sum
from topicspace.plans import jobs
from topicspace.plans.materialize import materialize
from topicspace.sources import files as SF


def test_small_fractions_are_met(spark):
    keys = spark.range(200_000).withColumnRenamed("id", "k")
    assert 40 < hash_sample(keys, "k", 0.0004).count() < 130
    small = split_parts(keys, "k", (0.9996, 0.0004))
    assert 40 < small[1].count() < 130
    assert small[0].count() + small[1].count() == 200_000
    assert hash_sample(keys, "k", 0.0).count() == 0
    assert hash_sample(keys, "k", 1.0).count() == 200_000


def test_mean_skips_null_vectors_and_long_ones_fail(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", None), ("b", None)],
                                 "k string, v array<double>")
    got = {r.k: r.vec for r in vector_sum(rows, "k", "v", how="mean", dim=2).collect()}
    assert got == {"a": [1.0, 2.0], "b": None}
    longer = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "k string, v array<double>")
    with pytest.raises(PySparkException):
        vector_sum(longer, "k", "v", dim=2).collect()


def test_document_vectors_weigh_repeated_words(spark):
    enc = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 9)], "doc_id int, idx int")
    wv = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "idx int, vec array<double>")
    assert [tuple(r.vec) for r in document_vectors(enc, wv).collect()] == [(2.0, 3.0)]
    mean = document_vectors(enc, wv, how="mean").first().vec
    assert mean == pytest.approx([2 / 3, 1.0])


def test_lookup_keeps_the_row_count(spark):
    df = spark.createDataFrame([("x",), ("y",)], "k string")
    d = spark.createDataFrame([("x", 1), ("x", 2)], "k string, v int")
    assert sorted((r.k, r.v) for r in L.lookup(df, d, "k", "v", default=0).collect()) == [
        ("x", 2), ("y", 0)]


def test_crlf_corpus(spark, tmp):
    path = write(f"{tmp}/c.txt", "A\r\none\r\ntwo\r\n\r\nB\r\nthree\r\n\r\nC\r\nfour\r\n", newline="")
    assert sorted(map(tuple, SF.read_corpus(spark, path).collect())) == [
        ("A", "one two"), ("B", "three"), ("C", "four")]


def test_file_order_beyond_five_digits(spark):
    paths = ["/d/part-100000-x.txt", "/d/part-99999-x.txt", "/d/part-00001-x.txt", "/d/a.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.p for r in df.orderBy(SF.path_order(F.col("p"))).collect()]
    assert got == ["/d/a.txt", "/d/part-00001-x.txt", "/d/part-99999-x.txt", "/d/part-100000-x.txt"]


def test_bad_dictionary_lines(spark, tmp):
    path = write(f"{tmp}/names.txt", "one\t1\nbroken\ntwo\t2\nthree\tx\n")
    with pytest.raises(PySparkException):
        SF.read_category_names(spark, path).collect()
    kept = SF.read_category_names(spark, path, bad_lines="drop").collect()
    assert sorted(map(tuple, kept)) == [(1, "one"), (2, "two")]
    rejected = SF.rejected_lines(spark, path, "category_names").collect()
    assert sorted(r.value for r in rejected) == ["broken", "three\tx"]


def test_saved_result_follows_its_input(spark, tmp):
    path = f"{tmp}/in.txt"
    def load():
        return spark.read.text(path)

    write(path, "a\n")
    assert materialize(spark, "t", load, {}, base=tmp, inputs=[path]).count() == 1
    write(path, "a\nbb\n")
    assert materialize(spark, "t", load, {}, base=tmp, inputs=[path]).count() == 2


def _articles(spark):
    return spark.createDataFrame(
        [(1, "a b b", ["x", "y"]), (2, "b c", ["x"]), (3, "d d", ["z"]), (4, "e", [])],
        "article_id int, content string, categories array<string>")


@pytest.mark.parametrize("buckets", [20, 4096, 5000])
def test_tfidf_distances_are_alike_for_any_bucket_count(spark, buckets):
    arts = _articles(spark)
    keep = spark.createDataFrame([("x",), ("y",)], "category_id string")
    one = jobs.category_distance_tfidf(arts, categories="categories", num_features=buckets, keep=keep)
    two = jobs.category_distance_tfidf(arts, categories="categories", num_features=buckets, keep=keep,
                                       fused=False)
    a, b = one.collect(), two.collect()
    assert [(r.name1, r.name2) for r in a] == [(r.name1, r.name2) for r in b] == [("x", "y")]
    assert a[0].distance == pytest.approx(b[0].distance)


def test_callable_reducer_in_the_tfidf_job(spark):
    arts = _articles(spark)
    first = lambda v: F.array(F.max(v[0]), F.max(v[1]))
    got = jobs.category_distance_tfidf(arts, categories="categories", num_features=2, how=first)
    assert got.count() == 3


@pytest.mark.parametrize("how", ["sum", "mean"])
def test_embedding_distances_equal_those_of_article_vectors(spark, how):
    arts = spark.createDataFrame(
        [(1, "aaa bbb bbb", ["x", "y"]), (2, "bbb ccc", ["x"]), (3, "ddd ddd", ["z"]), (4, "qqq", ["x"])],
        "article_id int, content string, categories array<string>")
    wv = spark.createDataFrame([("aaa", [1.0, 0.0]), ("bbb", [0.0, 2.0]), ("ccc", [3.0, 1.0]),
                                ("ddd", [1.0, 1.0])], "word string, vec array<double>")
    got = jobs.category_distance_embedding(arts, wv, categories="categories", how=how, skip_top=0)
    doc = {1: [1.0, 4.0], 2: [3.0, 3.0], 3: [2.0, 2.0]}
    cats = {"x": [1, 2], "y": [1], "z": [3]}
    vec = {}
    for c, ids in cats.items():
        n = len(ids) if how == "mean" else 1
        vec[c] = [sum(doc[i][d] for i in ids) / n for d in (0, 1)]
    want = {(a, b): sum((p - q) ** 2 for p, q in zip(vec[a], vec[b]))
            for a in vec for b in vec if a < b}
    assert {(r.name1, r.name2): r.distance for r in got.collect()} == pytest.approx(want)


def test_symmetric_matrix_for_any_label(spark):
    d = spark.createDataFrame([("a", "b", 2.0)], "name1 string, name2 string, distance double")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    got = sorted(map(tuple, C.symmetric_distances(d, names).collect()))
    assert got == [("a", "a", 0.0), ("a", "b", 2.0), ("b", "a", 2.0), ("b", "b", 0.0), ("c", "c", 0.0)]


def test_nearest_reads_the_pairs_once(spark):
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "category_id int, vec array<double>")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "category_id int, name string")
    near = C.nearest(C.name_pairs(C.pair_distances(vecs), names), 2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1
    assert near.count() == 12


def test_ranks_with_many_blocks_of_classes(spark, monkeypatch):
    from topicspace.operators import evaluation as EV
    cls = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(12)], "label int, vec array<double>")
    rows = spark.createDataFrame([(i, i % 13, [i * 0.7, 1.0]) for i in range(40)],
                                 "id int, label int, vec array<double>")
    whole = {r.id: r["rank"] for r in true_class_ranks(rows, cls).collect()}
    monkeypatch.setattr(EV, "BLOCK_CLASSES", 3)
    monkeypatch.setattr(EV, "SALT_ROWS", 10)
    assert {r.id: r["rank"] for r in true_class_ranks(rows, cls).collect()} == whole
    assert any(v is None for v in whole.values())
    known = rows.where("label < 12")
    assert topk_accuracy(class_scores(known, cls), 3).first().n == known.count()


def test_broadcast_is_bounded_in_bytes(spark):
    wide = spark.range(1000).select("id", F.array_repeat(F.lit(1.0), 2000).alias("v"))
    assert wide.select(F.sum(row_bytes(wide))).first()[0] == 1000 * (8 + 16000)
    plan = bounded_broadcast(wide, max_bytes=1 << 20)._jdf.queryExecution().analyzed().toString()
    assert "UnresolvedHint" not in plan and "ResolvedHint" not in plan
    plan = bounded_broadcast(wide)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan


def test_spread_leaves_large_inputs_alone(spark):
    df = spark.range(0, 100_000, 1, 1)
    assert spread(df, min_partitions=4, min_bytes=1).rdd.getNumPartitions() == 4
    assert spread(df, min_partitions=4, min_bytes=1, max_bytes=10).rdd.getNumPartitions() == 1


def test_vector_entries_dense_and_sparse(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.sparse(5, [1, 3], [2.0, 4.0]),), (Vectors.dense([7.0, 0.0]),)], ["v"])
    got = [[(e["index"], e["value"]) for e in r.e] for r in df.select(vector_entries("v").alias("e")).collect()]
    assert got == [[(1, 2.0), (3, 4.0)], [(0, 7.0), (1, 0.0)]]
    toks = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "d int, t array<string>")
    assert sorted(r.tf for r in hashed_term_frequency(toks, "d", "t", 1 << 18).collect()) == [1.0, 2.0]


def test_embeddings_train_on_whole_texts(spark, monkeypatch):
    from topicspace.plans import embed
    seen = {}
    real = embed.Word2Vec

    def spy(**kw):
        seen.update(kw)
        return real(**kw)

    monkeypatch.setattr(embed, "Word2Vec", spy)
    docs = spark.createDataFrame([(1, " ".join(["a", "b"] * 900))], "article_id int, text string")
    embed.learn_embeddings(docs, vocab_size=5, dim=4).collect()
    assert seen["maxSentenceLength"] >= 1800 and seen["numPartitions"] == embed.NUM_PARTITIONS
