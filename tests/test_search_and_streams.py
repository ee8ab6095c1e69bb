"""Pruned searches, stream windows, mergeable reducers and committed results, each against
a plain version."""

import sys
import threading

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from topicspace.operators import categories as C
from topicspace.operators import evaluation as E
from topicspace.operators import inner_product as I
from topicspace.operators.reducers import Midrange, Reducer, geometric_medians, reduce_vectors
from topicspace.operators.word_stream import stream_skipgrams
from topicspace.plans import materialize as M

VECTORS = "id long, vec array<double>"
# the reducer below runs in tasks, which can't import the test
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def points(spark, n, dim, seed, parts=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)) * rng.choice([0.1, 1, 5], size=(n, 1)), 3)
    x[n // 2] = x[0]  # equal vectors
    x[1] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    return df.repartition(parts), x


@pytest.mark.parametrize("metric", ["sqeuclidean", "euclidean", "cosine"])
def test_nearest_vectors(spark, metric, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 16)
    df, x = points(spark, 61, 5, 2)
    got = {}
    for r in C.nearest_vectors(df, 3, id="id", metric=metric).collect():
        got.setdefault(r.cat1, []).append((r["rank"], r.cat2, r.distance))
    for i in range(len(x)):
        if metric == "cosine":
            na, nb = np.linalg.norm(x, axis=1), np.linalg.norm(x[i])
            with np.errstate(all="ignore"):
                d = np.where(na * nb == 0, 1.0, 1 - (x @ x[i]) / (na * nb))
        else:
            d = ((x - x[i]) ** 2).sum(axis=1)
            d = np.sqrt(d) if metric == "euclidean" else d
        want = sorted((v, j) for j, v in enumerate(d) if j != i)[:3]
        mine = sorted(got[i])
        assert [k for k, _, _ in mine] == [1, 2, 3]
        assert np.allclose([v for _, _, v in mine], [v for v, _ in want], atol=1e-9)
        if metric != "cosine":  # ties are exact there
            assert [j for _, j, _ in mine] == [j for _, j in want]


def test_nearest_vectors_of_few_rows(spark):
    one = spark.createDataFrame([(1, [1.0])], VECTORS)
    assert C.nearest_vectors(one, 3, id="id").count() == 0
    two = spark.createDataFrame([(1, [1.0]), (2, [4.0])], VECTORS)
    assert sorted((r.cat1, r.cat2, r.distance) for r in C.nearest_vectors(two, 3, id="id").collect()) \
        == [(1, 2, 9.0), (2, 1, 9.0)]
    with pytest.raises(ValueError):
        C.nearest_vectors(two, 1, id="id", metric="other")


def test_kernel_gives_on_few_rows(spark, monkeypatch):
    """The window gets at most k rows of a vector from each block pair."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 10)
    df, x = points(spark, 40, 3, 1)
    fn = C._numpy_block_nearest("sqeuclidean", 2)
    v = df.select(F.col("id").alias("_id"), F.col("vec").alias("_v")).toPandas()
    left = v.assign(_bi=0, _bj=0)
    out = fn(left, v.rename(columns={"_id": "_rid", "_v": "_rv"}))
    assert len(out) == 80 and out.groupby("a").size().max() == 2


def test_close_pairs_are_exact_and_nearly_all(spark):
    df, x = points(spark, 80, 4, 5)
    got = {(r.cat1, r.cat2): r.distance for r in C.close_pairs(df, 1.0, id="id").collect()}
    want = {(i, j): float(np.linalg.norm(x[i] - x[j])) for i in range(80) for j in range(i + 1, 80)
            if np.linalg.norm(x[i] - x[j]) <= 1.0}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


@pytest.mark.parametrize("block", [4, 1000])
def test_top_inner_products(spark, block):
    items, x = points(spark, 50, 4, 7)
    queries, q = points(spark, 23, 4, 8)
    got = {}
    found = I.top_inner_products(queries.withColumnRenamed("id", "query"),
                                 items.withColumnRenamed("id", "item"), 6,
                                 block_items=block, block_queries=10)
    for r in found.collect():
        got.setdefault(r.query, []).append((r["rank"], r.item, r.score))
    for i in range(len(q)):
        want = sorted((-round(float(x[j] @ q[i]), 9), j) for j in range(50))[:6]
        mine = sorted(got[i])
        assert [j for _, j, _ in mine] == [j for _, j in want]
        assert np.allclose([s for *_, s in mine], [-s for s, _ in want])


def test_inner_products_leave_out_blocks(spark, monkeypatch):
    """Blocks that the bound rules out are never scored."""
    items = spark.createDataFrame([(i, [1000.0 / (i + 1), 0.0]) for i in range(40)],
                                  "item long, vec array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1])], "query long, vec array<double>")
    seen = []
    scored = I._scored
    monkeypatch.setattr(I, "_scored", lambda q, i, k, kinds: seen.append(i.count()) or scored(q, i, k, kinds))
    got = I.top_inner_products(queries, items, 3, block_items=5).collect()
    assert sorted((r.query, r["rank"], r.item) for r in got) == [(q, k + 1, k) for q in (0, 1) for k in range(3)]
    assert seen == [5, 0]


@pytest.mark.parametrize("window", [1, 2, 7])
@pytest.mark.parametrize("parts", [1, 5])
def test_stream_skipgrams(spark, window, parts):
    texts = [["a", "b"], [], ["c"], None, ["d"], ["e", "f", "g", "h", "i"], [], ["j"]] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, tokens array<string>").repartition(parts)
    stream = [w for t in texts for w in t or []]
    want = sorted((i, w, stream[i + o]) for i, w in enumerate(stream)
                  for o in range(-window, window + 1) if o and 0 <= i + o < len(stream))
    assert sorted(tuple(r) for r in stream_skipgrams(docs, "k", "tokens", window).collect()) == want
    assert stream_skipgrams(docs.where("k < 0"), "k", "tokens", window).count() == 0


class Median(Reducer):
    """For small groups: keeps all values."""

    def init(self):
        return np.zeros((0, 2))

    def update(self, state, vectors, key):
        return np.concatenate((state, vectors))

    def merge(self, a, b):
        return np.concatenate((a, b))

    def finish(self, state):
        return np.median(state, axis=0)


def test_mergeable_reducers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    keys = [None if i % 50 == 0 else ("hot" if i % 3 else f"k{i % 7}") for i in range(300)]
    rows = [(k, v.tolist()) for k, v in zip(keys, x)] + [("nulls", None), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, vec array<double>").repartition(6)
    for reducer, plain in ((Median(), lambda m: np.median(m, axis=0)),
                           (Midrange(), lambda m: (m.min(axis=0) + m.max(axis=0)) / 2)):
        for held in (1, 1000):
            got = {r.k: r.vec for r in reduce_vectors(df, "k", "vec", reducer, max_groups=held).collect()}
            assert set(got) == set(keys)
            for k in got:
                assert np.allclose(got[k], plain(x[[i for i, o in enumerate(keys) if o == k]]))


def test_geometric_median_has_the_smallest_distance(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(40, 2)), [[100.0, 100.0]]])
    df = spark.createDataFrame([(1, v.tolist()) for v in x], "k int, vec array<double>")
    m = np.array(geometric_medians(df, "k", "vec", 30).first().vec)
    total = lambda p: np.linalg.norm(x - p, axis=1).sum()
    assert total(m) < total(x.mean(axis=0)) - 50
    assert all(total(m) <= total(m + d) + 1e-6 for d in rng.normal(size=(30, 2)) * 0.01)


def test_class_scores_of_many_classes(spark, monkeypatch):
    rows, _ = points(spark, 12, 3, 1)
    classes, _ = points(spark, 30, 3, 2)
    rows, classes = (d.withColumnRenamed("id", "label") for d in (rows, classes))
    few = {r.label: r.scores for r in E.class_scores(rows, classes).collect()}
    monkeypatch.setattr(E, "BLOCK_CLASSES", 7)
    many = {r.label: r.scores for r in E.class_scores(rows, classes).collect()}
    assert few == many and all(len(s) == 30 for s in many.values())


def test_two_runs_share_one_result(spark, tmp_path):
    """Both compute, the first to end names the result, both read it, nothing else stays."""
    gate, made = threading.Barrier(2), []

    def run(value):
        def compute():
            gate.wait(60)
            return spark.range(50).select(F.lit(value).alias("v"))
        made.append(sorted({r.v for r in M.materialize(spark, "shared", compute, {}, str(tmp_path)).collect()}))

    threads = [threading.Thread(target=run, args=(v,)) for v in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert made[0] == made[1] and made[0] in ([1], [2])
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1


def test_leftovers_give_way(spark, tmp_path):
    path = M.result_path(spark, "left", {}, str(tmp_path))
    spark.range(3).write.parquet(path)
    (tmp_path / path.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert M.materialize(spark, "left", lambda: spark.range(7), {}, str(tmp_path)).count() == 7


def test_blocks_grow_instead_of_their_number(spark, monkeypatch):
    """What is shuffled is the rows times the blocks, so their number has a bound."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 4)
    monkeypatch.setattr(C, "MAX_BLOCKS", 3)
    monkeypatch.setattr(C, "KERNEL_PAIRS", 64)
    df, x = points(spark, 70, 4, 11)
    assert C._block_count(df.select(F.col("id").alias("_id"), F.col("vec").alias("_v"))) <= 3
    want = {(i, j): float(((x[i] - x[j]) ** 2).sum()) for i in range(70) for j in range(i + 1, 70)}
    got = {(r.cat1, r.cat2): r.distance for r in C.pair_distances(df, id="id").collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    near = {(r.cat1, r.cat2) for r in C.pair_distances(df, id="id", metric="euclidean", within=1.0).collect()}
    assert near == {p for p, d in want.items() if np.sqrt(d) <= 1.0} and near


def test_rows_are_sent_as_often_as_the_tasks_need(spark, monkeypatch):
    """Every copy of a row lies on disk: their number goes by the cores, not by the rows."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 4)
    df, x = points(spark, 400, 4, 12)
    cores = spark.sparkContext.defaultParallelism
    sent = []
    inner = C._in_block_pairs
    monkeypatch.setattr(C, "_in_block_pairs", lambda v, blocks, *a: (sent.append(blocks), inner(v, blocks, *a))[1])
    found = C.pair_distances(df, id="id")
    assert sent[0] * (sent[0] - 1) // 2 < C.PAIRS_OF_A_CORE * cores
    assert sent[0] * (sent[0] + 1) // 2 >= C.PAIRS_OF_A_CORE * cores
    got = {(r.cat1, r.cat2): r.distance for r in found.collect()}
    assert len(got) == 400 * 399 // 2
    assert all(abs(d - float(((x[i] - x[j]) ** 2).sum())) < 1e-9 for (i, j), d in got.items())


def test_nearest_among_many_copies(spark, monkeypatch):
    """Of equal vectors the smallest ids come first, and all copies are found."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 16)
    df = spark.createDataFrame([(i, [1.0, 2.0] if i % 5 else [float(i), 0.0]) for i in range(60)], VECTORS)
    copies = [i for i in range(60) if i % 5]
    got = {}
    for r in C.nearest_vectors(df, 3, id="id").orderBy("rank").collect():
        got.setdefault(r.cat1, []).append(r.cat2)
    assert all(got[i] == [j for j in copies if j != i][:3] for i in copies) and len(got) == 60
    some = C._fewest(np.arange(60), np.array([[1.0, 2.0] if i % 5 else [i, 0.0] for i in range(60)]), 3)
    assert len(some) == 12 + 4


def test_close_pairs_in_one_large_bucket(spark, monkeypatch):
    """A bucket of all rows is met block by block, each pair given once."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 8)
    df, x = points(spark, 50, 4, 5)
    df = df.withColumn("vec", F.transform("vec", lambda v: v + 1000))  # on one side of the origin
    got = [(r.cat1, r.cat2) for r in C.close_pairs(df, 1.0, id="id", bucket_length=1e6).collect()]
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if np.linalg.norm(x[i] - x[j]) <= 1.0}
    assert len(got) == len(set(got)) and set(got) == want


def test_stream_pairs_come_in_bounded_batches(spark):
    """A batch of many or long texts never becomes one batch of pairs."""
    import pyarrow as pa
    from topicspace.operators import word_stream as W
    texts = pa.array([["w"] * 300_000, None, [], ["x"] * 10])
    context = type("Context", (), {"get": staticmethod(lambda: context), "partitionId": staticmethod(lambda: 0)})
    held, W.TaskContext = W.TaskContext, context
    try:
        run = W._pair_task("tokens", 1, {0: (5, ["a"], ["z"])})
        out = list(run(iter([pa.RecordBatch.from_arrays([texts], names=["tokens"])])))
    finally:
        W.TaskContext = held
    assert sum(b.num_rows for b in out) == 2 * 300_010
    assert max(b.num_rows for b in out) <= W.WORDS_TOGETHER + 1
    first = pa.Table.from_batches(out).slice(0, 1).to_pylist()
    assert first == [{"pos": 5, "center": "w", "context": "a"}]
