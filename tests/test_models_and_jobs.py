import math
import os

import numpy as np
from pyspark.sql import functions as F

from topicspace.operators import categories as C
from topicspace.plans import classify as K
from topicspace.plans import recommend as R
from topicspace.plans.embed import learn_embeddings
from topicspace.plans.materialize import materialize
from topicspace.plans.reduce import principal_components
from topicspace.sources import files as SF

FIXTURES = os.path.join(os.path.dirname(__file__), "fixtures")

# Published squared distances between the published category
# centroids in golden_centroids.csv (sum-of-word-vectors strategy).
GOLDEN_DISTANCES = {
    ("War", "Logic"): 135111.76188334916,
    ("Animals", "War"): 335682.21008698986,
    ("Animals", "Logic"): 611069.3847694126,
}


def test_golden_centroid_distances(spark):
    cen = SF.read_centroids(spark, os.path.join(FIXTURES, "golden_centroids.csv"))
    got = {(r.cat1, r.cat2): r.distance for r in C.pair_distances(cen, id="name").collect()}
    for (a, b), d in GOLDEN_DISTANCES.items():
        key = (a, b) if (a, b) in got else (b, a)
        assert math.isclose(got[key], d, rel_tol=1e-12), (a, b)


def test_pca_matches_numpy_svd(spark):
    cen = SF.read_centroids(spark, os.path.join(FIXTURES, "golden_centroids.csv"))
    proj, ratio = principal_components(cen, "name", "vec", k=1)
    x = np.array([r.vec for r in cen.orderBy("name").collect()])
    xc = x - x.mean(axis=0)
    s = np.linalg.svd(xc, compute_uv=False)
    assert math.isclose(ratio[0], s[0] ** 2 / (s ** 2).sum(), rel_tol=1e-6)
    assert proj.count() == 3


def _ratings(spark):
    # 4 x 4 upper triangle of distances
    rows = [(1, 2, 1.0), (1, 3, 4.0), (1, 4, 2.0), (2, 3, 3.0), (2, 4, 5.0), (3, 4, 1.5)]
    return spark.createDataFrame(rows, "user int, item int, rating double")


def test_recommendations_shape_and_order(spark):
    model = R.fit_recommender(_ratings(spark), rank=3, max_iter=6, seed=1)
    for side, key in (("users_for_items", "item"), ("items_for_users", "user")):
        recs = R.recommend(model, k=2, side=side)
        rows = recs.collect()
        groups = {}
        for r in rows:
            groups.setdefault(r[key], []).append((r["rank"], r.rating))
        assert all(len(v) == 2 for v in groups.values())
        for v in groups.values():
            v.sort()
            assert v[0][1] >= v[1][1]
    again = R.recommend(R.fit_recommender(_ratings(spark), rank=3, max_iter=6, seed=1), k=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, R.recommend(model, k=2).collect()))
    no_self = R.recommend(model, k=2, exclude_self=True).collect()
    assert all(r.item != r.user for r in no_self)


def test_ratings_from_distances_default(spark):
    d = spark.createDataFrame([("A", "B", 2.0), ("A", "Z", 1.0)], "name1 string, name2 string, distance double")
    dic = spark.createDataFrame([("A", 1), ("B", 2)], "name string, category_id int")
    rows = sorted(tuple(r) for r in R.ratings_from_distances(d, dic).collect())
    assert rows == [(1, 0, 1.0), (1, 2, 2.0)]
    inv = R.ratings_from_distances(d, dic, rating_transform="inverse").collect()
    assert sorted(r.rating for r in inv) == [1 / 3, 0.5]


def test_classifier_train_predict_evaluate(spark, tmp):
    words = {1: "alpha beta gamma", 2: "delta epsilon zeta", 3: "eta theta iota"}
    rows = [(i, f"{words[1 + i % 3]} {words[1 + i % 3]} x{i}", 1 + i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "article_id int, content string, label int")
    path = os.path.join(tmp, "model")
    model, parts = K.train_classifier(df, model_path=path)
    test = parts[2]
    assert parts[0].join(test, "article_id").count() == 0
    pred = K.predict(model, test)
    assert pred.count() == test.count()
    acc = K.evaluate_saved(path, test, k=1).first()
    assert acc.accuracy > 0.9 and acc.n == test.count()


def test_learned_embeddings_unit_norm(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat the end") for i in range(20)],
                                 "article_id int, text string")
    vecs = learn_embeddings(docs, vocab_size=4, dim=8, seed=1)
    words = {r.word: r.vec for r in vecs.collect()}
    assert "UNK" in words and len(words) == 4
    assert all(math.isclose(float(np.linalg.norm(v)), 1.0, rel_tol=1e-9) for v in words.values())


def test_materialize_computes_once(spark, tmp):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5).withColumn("x", F.col("id") * 2)

    a = materialize(spark, "demo", compute, {"p": 1}, base=tmp, text_copy=True)
    b = materialize(spark, "demo", compute, {"p": 1}, base=tmp)
    c = materialize(spark, "demo", compute, {"p": 2}, base=tmp)
    assert len(calls) == 2 and a.count() == b.count() == c.count() == 5
    assert any(n.endswith("-txt") for n in os.listdir(tmp))


def test_streaming_scoring(spark, tmp):
    import shutil
    from topicspace.plans.classify import text_classifier
    from topicspace.streaming.scoring import article_stream, score_stream, write_stream
    src = os.path.join(tmp, "incoming")
    os.makedirs(src)
    shutil.copy("/root/testdata/sf0.001/documents.parquet", os.path.join(src, "part-0.parquet"))
    batch = (spark.read.parquet(src).select(F.col("doc_id").alias("article_id"), F.lit("x y").alias("content"),
                                            (F.col("doc_id") % 2).cast("double").alias("label")))
    model = text_classifier(num_features=64).fit(batch)
    stream = article_stream(spark, src)
    q = write_stream(score_stream(model, stream, ["article_id", "prediction"]), os.path.join(tmp, "out"), "scoring_test")
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(tmp, "out")).count() == spark.read.parquet(src).count()


def test_tfidf_distances_fused_equals_pipeline(spark):
    from topicspace.plans import jobs
    from topicspace.sources import tables as TB
    arts = TB.articles(spark, "/root/testdata/sf0.001", with_categories=True)
    keep = TB.category_filter(spark)
    res = {}
    for fused in (True, False):
        for how in ("mean", "sum"):
            df = jobs.category_distance_tfidf(arts, categories="categories", keep=keep,
                                              category="category", fused=fused, how=how)
            res[(fused, how)] = {(r.name1, r.name2): r.distance for r in df.collect()}
    for how in ("mean", "sum"):
        a, b = res[(True, how)], res[(False, how)]
        assert a.keys() == b.keys() and len(a) > 0
        assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_embedding_distances_vocab_weight(spark):
    from topicspace.plans import jobs
    arts = spark.createDataFrame(
        [(1, "alpha alpha beta", ["x", "y"]), (2, "beta gamma", ["y"]), (3, "gamma gamma delta", ["z"])],
        "article_id int, content string, categories array<string>")
    wv = spark.createDataFrame([("gamma", [1.0, 0.0]), ("alpha", [0.0, 1.0]), ("beta", [1.0, 1.0])], "word string, vec array<float>")
    for weight in ("article", "membership"):
        d = jobs.category_distance_embedding(arts, wv, categories="categories", category="category",
                                             vocab_size=3, skip_top=0, vocab_weight=weight)
        rows = d.collect()
        assert len(rows) == 3 and [r.distance for r in rows] == sorted(r.distance for r in rows)
