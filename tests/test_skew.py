"""One key holding a third of all rows: results stay exact and the plans
combine rows map-side before any shuffle (one partial row per task per key)."""

import re

import numpy as np
from pyspark.sql import functions as F

from topicspace.operators import categories as C
from topicspace.operators import text as TX
from topicspace.operators import tfidf as TF
from topicspace.sources.files import last_wins

N = 30000


def _hot(spark):
    # key 0 holds a third of the rows
    return spark.range(N).repartition(8).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("k"))


def _partial_before_exchange(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "partial_" in plan


def test_hot_word_count(spark):
    docs = _hot(spark).select("id", F.array(F.concat(F.lit("w"), F.col("k").cast("string"))).alias("tokens"))
    counts = TX.word_counts(docs)
    got = {r.word: r.cnt for r in counts.collect()}
    assert got["w0"] == N // 3 and sum(got.values()) == N
    assert _partial_before_exchange(counts)


def test_hot_category_vectors(spark):
    rows = _hot(spark).select("id", F.col("k").alias("category_id"),
                              F.array((F.col("id") % 5).cast("double"), F.lit(1.0)).alias("vec"))
    cv = C.category_vectors(rows, "vec", how="mean", dim=2)
    got = {r.category_id: r.vec for r in cv.collect()}
    ids = np.arange(N)
    hot = ids[ids % 3 == 0]
    assert np.allclose(got[0], [np.mean(hot % 5), 1.0])
    assert _partial_before_exchange(cv)


def test_hot_last_wins(spark):
    rows = _hot(spark).select(F.col("k").alias("key"), F.col("id").alias("value"),
                              F.struct(F.col("id")).alias("_order"))
    lw = last_wins(rows, "key")
    got = {r.key: r.value for r in lw.collect()}
    assert got[0] == max(i for i in range(N) if i % 3 == 0)
    assert _partial_before_exchange(lw)


def test_hot_term_tfidf(spark):
    docs = _hot(spark).select(F.col("id").alias("doc"),
                              F.array(F.lit("the"), F.concat(F.lit("t"), F.col("k").cast("string"))).alias("tokens"))
    res = TF.tfidf_exact(docs, "doc", "tokens")
    the = res.where("term = 'the'").agg(F.count("*").alias("n"), F.max("idf").alias("idf")).first()
    assert the.n == N and abs(the.idf - np.log((N + 1) / (N + 1))) < 1e-12
    assert res.count() == N * 2


def test_salted_tfidf_join_equals_plain(spark):
    docs = _hot(spark).select(F.col("id").alias("doc"),
                              F.array(F.lit("the"), F.concat(F.lit("t"), F.col("k").cast("string"))).alias("tokens"))
    tf = TF.term_frequency(docs, "doc", "tokens")
    idf = TF.idf_weights(TF.document_frequency(tf), N)
    plain = {(r.doc, r.term): r.tfidf for r in TF.tfidf(tf, idf).collect()}
    salted_df = TF.tfidf(tf, idf, salt=8, doc="doc")
    salted = {(r.doc, r.term): r.tfidf for r in salted_df.collect()}
    assert plain == salted and len(plain) == 2 * N
    assert "_salt" in salted_df._jdf.queryExecution().executedPlan().toString()


def test_term_counts_need_one_exchange(spark, tmp):
    """Texts are brought together by id, never (article, term) rows."""
    from topicspace.plans import registry as R
    rows = [(i, f"title\nsome words {i} some", "en", "src0", 5) for i in (1, 2, 2, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp}/documents.parquet")
    plan = R.tfidf_exact(spark, tmp)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(article_id#\d+L?, term", plan)
    got = {(r.article_id, r.term): r.tf for r in R.term_frequency(spark, tmp).collect()}
    assert got[(2, "some")] == 4 and got[(1, "1")] == 1 and len(got) == 9


def test_pairs_are_counted_as_indexes(spark):
    """What is shuffled are pairs of the vocabulary, not of all words."""
    from topicspace.plans.skipgram_model import word_pairs
    docs = spark.createDataFrame([(i, ["a", f"rare{i}", "b", "a"]) for i in range(20)],
                                 "article_id long, tokens array<string>")
    vocab = spark.createDataFrame([("UNK", 0), ("a", 1), ("b", 2)], "word string, idx int")
    pairs = word_pairs(docs, vocab)
    assert "hashpartitioning(center" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {(r.c, r.o): r.n for r in pairs.collect()} == {
        (1, 0): 20, (0, 1): 20, (0, 2): 20, (2, 0): 20, (2, 1): 20, (1, 2): 20}


def test_pairs_are_counted_in_the_task(spark):
    """Pairs of many texts leave a task counted, not one row for each place."""
    from topicspace.operators.skipgram import skipgrams
    from topicspace.plans.skipgram_model import word_pairs
    rows = [(1, ["a", None, "b", "a"]), (2, None), (3, []), (4, ["b"]), (5, ["x", "a", "b", "a", "b"])]
    docs = spark.createDataFrame(rows, "article_id long, tokens array<string>")
    vocab = spark.createDataFrame([("UNK", 0), ("a", 1), ("b", 2)], "word string, idx int")
    index = {"a": 1, "b": 2}
    for window in (1, 2, 7):
        pairs = word_pairs(docs, vocab, window=window)
        assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()
        want = {}
        for r in skipgrams(docs, "article_id", "tokens", window).collect():
            key = (index.get(r.center, 0), index.get(r.context, 0))
            want[key] = want.get(key, 0) + 1
        assert {(r.c, r.o): r.n for r in pairs.collect()} == want
