import itertools
import math
import random

import numpy as np
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from topicspace.operators import categories as C
from topicspace.operators import labels as L
from topicspace.operators import text as TX
from topicspace.operators import tfidf as TF
from topicspace.operators.evaluation import class_scores, topk_accuracy, true_class_rank
from topicspace.operators.sampling import hash_sample, hash_split, split_parts
from topicspace.operators.skipgram import skipgrams
from topicspace.operators.vectors import document_vectors, l2_normalize, vector_sum


# --- labels ---------------------------------------------------------------------

def test_dense_labels_many_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(9)
    got = L.dense_labels(df, "k", out="label").select("k", "label").collect()
    keys = sorted(r.k for r in got)
    assert {r.k: r.label for r in got} == {k: i + 1 for i, k in enumerate(keys)}


def test_lookup_default_and_semi_filter(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    d = spark.createDataFrame([(1, "a"), (3, "c")], "id int, name string")
    got = {r.id: r.name for r in L.lookup(df, d, "id", "name", default="").collect()}
    assert got == {1: "a", 2: "", 3: "c"}
    ids = spark.createDataFrame([(3,), (9,)], "id int")
    assert [r.id for r in L.semi_filter(df, ids, "id").collect()] == [3]
    rev = L.reverse(d, "id", "name").collect()
    assert sorted((r.id, r.name) for r in rev) == [("a", 1), ("c", 3)]
    assert L.duplicated_values(d, "name").count() == 0


def test_label_articles_modes(spark):
    arts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "article_id int, content string")
    mem = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 99)], "article_id int, category_id int")
    labels = spark.createDataFrame([(10, 2), (11, 1), (12, 3)], "category_id int, label int")
    ex = sorted((r.article_id, r.label) for r in L.label_articles(arts, mem, labels).collect())
    assert ex == [(1, 1), (1, 2), (2, 3)]   # category 99 has no label -> 0 -> dropped
    first = sorted((r.article_id, r.label) for r in L.label_articles(arts, mem, labels, mode="first").collect())
    assert first == [(1, 1), (2, 3)]


# --- text -----------------------------------------------------------------------

def _counts(spark, pairs):
    return spark.createDataFrame(pairs, "word string, cnt bigint")


def test_vocabulary_trim_ties_and_unk(spark):
    counts = _counts(spark, [("a", 5), ("b", 5), ("c", 9), ("d", 1), ("e", 2), ("f", 2)])
    v = [tuple(r) for r in TX.vocabulary(counts, 4).orderBy("idx").collect()]
    assert v == [("c", 9, 1), ("a", 5, 2), ("b", 5, 3), ("e", 2, 4)]
    trimmed = [tuple(r) for r in TX.vocabulary(counts, 4, skip_top=1).orderBy("idx").collect()]
    assert trimmed == [("a", 5, 1), ("b", 5, 2), ("e", 2, 3)]   # ranks 2..4; the last is kept
    unk = [tuple(r) for r in TX.vocabulary(counts, 3, unk=True).orderBy("idx").collect()]
    assert unk == [("UNK", 1 + 2 + 2 + 5, 0), ("c", 9, 1), ("a", 5, 2)]


def test_word_counts_weight(spark):
    df = spark.createDataFrame([(["a", "b", "a"], 1), (["a"], 3)], "tokens array<string>, w int")
    assert {r.word: r.cnt for r in TX.word_counts(df).collect()} == {"a": 3, "b": 1}
    assert {r.word: r.cnt for r in TX.word_counts(df, weight="w").collect()} == {"a": 5, "b": 1}


def test_encode_pad_sequences(spark):
    docs = spark.createDataFrame([(1, ["x", "q", "y", "x"]), (2, ["q"]), (3, [])],
                                 "doc_id int, tokens array<string>")
    vocab = spark.createDataFrame([("x", 1), ("y", 2)], "word string, idx int")
    enc = TX.encode(docs, "doc_id", "tokens", vocab)
    seqs = {r.doc_id: r.seq for r in TX.index_sequences(enc).collect()}
    assert seqs == {1: [1, 2, 1]}                       # no in-vocabulary word -> no row
    unk = TX.encode(docs, "doc_id", "tokens", vocab, oov="unk")
    assert TX.unk_count(unk).first().unk_count == 2
    s = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5],), ([],)], "seq array<int>")
    post = [r.seq for r in TX.pad(s, "seq", 4).collect()]
    pre = [r.seq for r in TX.pad(s, "seq", 4, side="pre").collect()]
    assert post == [[1, 2, 3, 0], [1, 2, 3, 4], [0, 0, 0, 0]]
    assert pre == [[0, 1, 2, 3], [2, 3, 4, 5], [0, 0, 0, 0]]
    dec = {r.pos: r.word for r in TX.decode(enc.drop("word"), vocab).collect() if r.doc_id == 1}
    assert dec == {0: "x", 2: "y", 3: "x"}


# --- tf-idf ---------------------------------------------------------------------

def test_tfidf_exact_formula(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, ["c"])],
                                 "doc int, tokens array<string>")
    got = {(r.doc, r.term): r.tfidf for r in TF.tfidf_exact(docs, "doc", "tokens").collect()}
    idf = lambda df: math.log((3 + 1) / (df + 1))
    assert math.isclose(got[(1, "a")], 2 * idf(1))
    assert math.isclose(got[(1, "b")], idf(2))
    assert math.isclose(got[(3, "c")], idf(1))


def test_hashed_tf_matches_hashing_tf(spark):
    words = ["", "a", "ab", "abc", "abcd", "abcde", "héllo", "日本語", "zzzzzzzzz"]
    docs = spark.createDataFrame([(1, words), (2, words[:3] * 2)], "doc int, tokens array<string>")
    ht = HashingTF(inputCol="tokens", outputCol="v", numFeatures=20)
    got = {(r.doc, r.bucket): r.tf for r in TF.hashed_term_frequency(docs, "doc", "tokens", 20).collect()}
    expect = {}
    for d, toks in [(1, words), (2, words[:3] * 2)]:
        for w in toks:
            b = ht.indexOf(w)
            expect[(d, b)] = expect.get((d, b), 0.0) + 1.0
    assert got == expect


# --- vectors & categories ----------------------------------------------------------

def test_vector_sum_mean_weight(spark):
    df = spark.createDataFrame([("g", [1.0, 2.0], 1), ("g", [3.0, 4.0], 3), ("h", [0.0, 0.0], 2)],
                               "k string, v array<double>, w int")
    s = {r.k: r.vec for r in vector_sum(df, "k", "v").collect()}
    m = {r.k: r.vec for r in vector_sum(df, "k", "v", how="mean").collect()}
    w = {r.k: r.vec for r in vector_sum(df, "k", "v", weight="w").collect()}
    assert s == {"g": [4.0, 6.0], "h": [0.0, 0.0]}
    assert m == {"g": [2.0, 3.0], "h": [0.0, 0.0]}
    assert w == {"g": [10.0, 14.0], "h": [0.0, 0.0]}
    n = {r.k: r.vec for r in l2_normalize(vector_sum(df, "k", "v"), "vec").collect()}
    assert np.allclose(n["g"], np.array([4.0, 6.0]) / np.hypot(4, 6)) and n["h"] == [0.0, 0.0]


def test_document_vectors(spark):
    enc = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 5), (2, 0, 7)], "doc_id int, pos int, idx int")
    wv = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 2.0])], "idx int, vec array<float>")
    got = {r.doc_id: r.vec for r in document_vectors(enc, wv).collect()}
    assert got == {1: [2.0, 2.0]}                       # word 7 has no vector
    mean = {r.doc_id: r.vec for r in document_vectors(enc, wv, how="mean").collect()}
    assert np.allclose(mean[1], [2 / 3, 2 / 3])


def test_category_vectors_three_ways(spark):
    docs = spark.createDataFrame([(1, [1.0, 1.0], ["a", "b"]), (2, [3.0, 5.0], ["a"])],
                                 "article_id int, vec array<double>, cats array<string>")
    mem = docs.select("article_id", F.explode("cats").alias("category_id"))
    by_col = {r.category_id: r.vec for r in C.category_vectors(docs, "vec", categories="cats").collect()}
    by_join = {r.category_id: r.vec for r in C.category_vectors(docs, "vec", membership=mem).collect()}
    summed = {r.category_id: r.vec for r in C.category_vectors(docs, "vec", categories="cats", how="sum").collect()}
    assert by_col == by_join == {"a": [2.0, 3.0], "b": [1.0, 1.0]}
    assert summed == {"a": [4.0, 6.0], "b": [1.0, 1.0]}


def test_category_vectors_ml_vectors(spark):
    from pyspark.ml.linalg import Vectors
    docs = spark.createDataFrame([(1, Vectors.sparse(3, [0], [2.0]), "a"),
                                  (2, Vectors.dense([0.0, 2.0, 4.0]), "a")],
                                 ["article_id", "features", "category_id"])
    got = C.category_vectors(docs, "features", how="mean").first().vec
    assert got == [1.0, 1.0, 2.0]


def _brute_pairs(rows):
    out = {}
    for (i, a), (j, b) in itertools.combinations(sorted(rows), 2):
        out[(i, j)] = float(((np.array(a) - np.array(b)) ** 2).sum())
    return out


def test_pair_distances_blocked_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(i * 3 + 1, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "category_id int, vec array<double>")
    expect = _brute_pairs(rows)
    for blocks in (1, 2, 5, 13, None):
        for method in ("numpy", "sql"):
            got = {(r.cat1, r.cat2): r.distance
                   for r in C.pair_distances(df, blocks=blocks, method=method).collect()}
            assert got.keys() == expect.keys()
            assert all(math.isclose(got[k], expect[k], rel_tol=1e-12) for k in expect)
    # a metric given as a Column function runs on the SQL path
    from topicspace.functions.vectors import sqdist
    custom = {(r.cat1, r.cat2): r.distance for r in C.pair_distances(df, metric=sqdist, blocks=4).collect()}
    assert all(math.isclose(custom[k], expect[k], rel_tol=1e-12) for k in expect)
    cos = C.pair_distances(df, metric="cosine", blocks=3).count()
    assert cos == 60 * 59 // 2


def test_pair_plan_has_no_cartesian(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "category_id int, vec array<double>")
    for method in ("numpy", "sql"):
        plan = C.pair_distances(df, blocks=3, method=method)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_names_nearest_matrix(spark):
    d = spark.createDataFrame([(1, 2, 3.0), (1, 3, 1.0), (2, 3, 2.0)], "cat1 int, cat2 int, distance double")
    names = spark.createDataFrame([(1, "A"), (2, "B")], "category_id int, name string")
    named = C.name_pairs(d, names)
    rows = [tuple(r) for r in C.sort_distances(named).collect()]
    assert rows == [("A", "", 1.0), ("B", "", 2.0), ("A", "B", 3.0)]   # unknown id 3 -> ''
    nd = spark.createDataFrame([("A", "B", 3.0), ("A", "C", 1.0)], "name1 string, name2 string, distance double")
    near = {(r.name1, r.rank): r.name2 for r in C.nearest(nd, 1).collect()}
    assert near == {("A", 1): "C", ("B", 1): "A", ("C", 1): "A"}
    m = {r.name: (r.A, r.B, r.C) for r in C.distance_matrix(nd, ["A", "B", "C"]).collect()}
    assert m == {"A": (0.0, 3.0, 1.0), "B": (3.0, 0.0, 0.0), "C": (1.0, 0.0, 0.0)}


# --- skip-grams, sampling, evaluation ------------------------------------------------------

def _brute_skipgrams(tokens, window):
    out = []
    for i, c in enumerate(tokens):
        for o in range(-window, window + 1):
            if o and 0 <= i + o < len(tokens):
                out.append((i, c, tokens[i + o]))
    return sorted(out)


def test_skipgrams_brute_force(spark):
    docs = [(1, []), (2, ["a"]), (3, ["a", "b"]), (4, ["a", "b", "c"]), (5, list("abcde"))]
    df = spark.createDataFrame(docs, "doc int, tokens array<string>")
    for window in (1, 2):
        got = {}
        for r in skipgrams(df, "doc", "tokens", window=window).collect():
            got.setdefault(r.doc, []).append((r.pos, r.center, r.context))
        for d, toks in docs:
            assert sorted(got.get(d, [])) == _brute_skipgrams(toks, window)


def test_skipgrams_num_skips_subset(spark):
    df = spark.createDataFrame([(1, list("abcdefgh"))], "doc int, tokens array<string>")
    a = sorted(tuple(r) for r in skipgrams(df, "doc", "tokens", window=2, num_skips=2, seed=3).collect())
    b = sorted(tuple(r) for r in skipgrams(df, "doc", "tokens", window=2, num_skips=2, seed=3).collect())
    assert a == b
    per_pos = {}
    for _, p, c, ctx in a:
        per_pos.setdefault(p, []).append(ctx)
    assert all(len(v) == 2 for v in per_pos.values()) and len(per_pos) == 8
    full = set(_brute_skipgrams(list("abcdefgh"), 2))
    assert {(p, c, x) for _, p, c, x in a} <= full


def test_hash_split_and_sample(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "k")
    parts = {r.split: r["count"] for r in hash_split(df, "k", (0.8, 0.1, 0.1)).groupBy("split").count().collect()}
    assert abs(parts[0] / 20000 - 0.8) < 0.02 and abs(parts[1] / 20000 - 0.1) < 0.02
    a, b, c = split_parts(df, "k", (0.8, 0.1, 0.1))
    assert a.join(c, "k").count() == 0 and a.count() + b.count() + c.count() == 20000
    s1 = {r.k for r in hash_sample(df, "k", 0.2).collect()}
    s2 = {r.k for r in hash_sample(df.repartition(7), "k", 0.2).collect()}
    assert s1 == s2 and abs(len(s1) / 20000 - 0.2) < 0.02


def test_topk_accuracy_scores_small(spark):
    # three rows, six classes, true class at rank 1, 5 and 6
    def scores(order_of_true):
        return [{"label": c, "score": float(10 - c)} for c in range(6)], order_of_true
    rows = []
    for rid, true_label in [(0, 0), (1, 4), (2, 5)]:
        s, _ = scores(true_label)
        rows.append((rid, true_label, s))
    df = spark.createDataFrame(rows, "id int, label int, scores array<struct<label:int,score:double>>")
    ranks = {r.id: r.rk for r in df.select("id", true_class_rank().alias("rk")).collect()}
    assert ranks == {0: 1, 1: 5, 2: 6}
    acc = topk_accuracy(df, 5).first()
    assert acc.k == 5 and math.isclose(acc.accuracy, 2 / 3) and acc.n == 3


def test_class_scores_nearest_centroid(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 10.0])], "label int, vec array<double>")
    cls = spark.createDataFrame([(0, [1.0, 1.0]), (1, [9.0, 9.0])], "label int, vec array<double>")
    acc = topk_accuracy(class_scores(rows, cls), 1).first().accuracy
    assert acc == 1.0


def test_vectorize_zero_fill(spark):
    from topicspace.operators.vectors import vectorize
    seqs = spark.createDataFrame([(1, [5, 9, 0])], "doc_id int, seq array<int>")
    wv = spark.createDataFrame([(5, [1.0, 2.0])], "idx int, vec array<float>")
    got = {r.pos: list(r.vec) for r in vectorize(seqs, wv, 2).collect()}
    assert got == {0: [1.0, 2.0], 1: [0.0, 0.0], 2: [0.0, 0.0]}


def test_articles_with_ids_unknown(spark):
    corpus = spark.createDataFrame([("Ancient history", "c1"), ("War", "c2"), ("Nope", "c3")],
                                   "title string, content string")
    d = spark.createDataFrame([("Ancient_history", 7), ("War", 8)], "title string, article_id int")
    keep = {r.content: r.article_id for r in L.articles_with_ids(corpus, d).collect()}
    assert keep == {"c1": 7, "c2": 8, "c3": -1}
    drop = {r.content: r.article_id for r in L.articles_with_ids(corpus, d, unknown="drop").collect()}
    assert drop == {"c1": 7, "c2": 8}


def test_random_split_seeded(spark):
    from topicspace.operators.sampling import random_split
    df = spark.range(1000).repartition(4)
    a = [p.count() for p in random_split(df, [0.8, 0.2], seed=3)]
    assert sum(a) == 1000 and 700 < a[0] < 900


def test_pair_distances_long_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3000).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "category_id int, vec array<double>")
    old = C.BLOCK_VALUES
    C.BLOCK_VALUES = 3000 * 4          # four vectors per block -> several blocks
    try:
        got = {(r.cat1, r.cat2): r.distance for r in C.pair_distances(df).collect()}
    finally:
        C.BLOCK_VALUES = old
    expect = _brute_pairs(rows)
    assert got.keys() == expect.keys()
    assert all(math.isclose(got[k], expect[k], rel_tol=1e-12) for k in expect)


def test_true_class_ranks_match_score_arrays(spark):
    from topicspace.operators.evaluation import topk_accuracy_from_ranks, true_class_ranks
    rng = np.random.default_rng(11)
    cls = spark.createDataFrame([(c, rng.normal(size=4).tolist()) for c in range(7)], "label int, vec array<double>")
    rows = spark.createDataFrame([(i, int(rng.integers(0, 7)), rng.normal(size=4).tolist()) for i in range(300)],
                                 "id int, label int, vec array<double>")
    for metric in ("sqeuclidean", "cosine"):
        a = {r.id: r.rk for r in class_scores(rows, cls, metric=metric).select("id", true_class_rank().alias("rk")).collect()}
        b = {r.id: r["rank"] for r in true_class_ranks(rows, cls, metric=metric).collect()}
        assert a == b
    acc1 = topk_accuracy(class_scores(rows, cls), 3).first().accuracy
    acc2 = topk_accuracy_from_ranks(true_class_ranks(rows, cls), 3).first().accuracy
    assert math.isclose(acc1, acc2)


def test_vector_entries_sparse_and_dense(spark):
    from pyspark.ml.linalg import Vectors
    from topicspace.functions.vectors import vector_entries
    df = spark.createDataFrame([(Vectors.sparse(1 << 20, [3, 70000], [2.0, 1.5]),),
                                (Vectors.dense([0.5, 0.0]),), (Vectors.sparse(4, [], []),)], ["v"])
    got = [[(e["index"], e["value"]) for e in r.e] for r in df.select(vector_entries("v").alias("e")).collect()]
    assert got == [[(3, 2.0), (70000, 1.5)], [(0, 0.5), (1, 0.0)], []]


def test_hashed_tf_large_buckets_sparse(spark):
    words = ["alpha", "beta", "alpha", "héllo"]
    docs = spark.createDataFrame([(1, words)], "doc int, tokens array<string>")
    n = 1 << 18
    ht = HashingTF(inputCol="tokens", outputCol="v", numFeatures=n)
    got = {r.bucket: r.tf for r in TF.hashed_term_frequency(docs, "doc", "tokens", n).collect()}
    expect = {}
    for w in words:
        expect[ht.indexOf(w)] = expect.get(ht.indexOf(w), 0.0) + 1.0
    assert got == expect
