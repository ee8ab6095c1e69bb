import math

import numpy as np
from topicspace.llm.prefix_forest import PrefixForest, hash_strings, op10_nearest_vectors, search

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5):
    """Exact answers over the usable rows."""
    fine = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and len(v) == 8
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % 50 == 0:
            near = sorted((-float(v @ q) / math.sqrt(float(v @ v)) / math.sqrt(float(q @ q)), j)
                          for j, v in fine if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 8))
    x = centres[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, 8))
    return [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]


def test_recall_and_scores_against_brute_force(spark, table):
    rows = data() + [(1001, None), (1050, [0.0] * 8), (1100, [float("nan")] + [1.0] * 7),
                     (1150, [float("inf")] + [1.0] * 7), (1200, [None] + [1.0] * 7), (1250, [1.0, 2.0])]
    got = op10_nearest_vectors(spark, table(rows, SCHEMA, "embeddings")).collect()
    want = brute(rows)
    assert {r.query_id for r in got} == set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for i, _ in near})
        exact = dict(near)
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in mine if i in exact)
    assert hits / (5 * len(want)) >= 0.9


def test_ties_few_rows_and_repeats(spark):
    same = [(i, [1.0, 2.0]) for i in (0, 9, 3, 7, 3, 50, 12, 1)]
    got = search(spark.createDataFrame(same, SCHEMA), lambda i: i % 50 == 0)
    rows = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())
    assert [(q, i) for q, _, i, _ in rows] == [(0, i) for i in (1, 3, 3, 7, 9)] + [(50, i) for i in (0, 1, 3, 3, 7)]
    assert len({s for *_, s in rows}) == 1
    few = search(spark.createDataFrame(same[:2], SCHEMA), lambda i: i % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 9)]
    assert search(spark.createDataFrame([], SCHEMA), lambda i: i % 50 == 0).count() == 0


def test_blocks_do_not_change_what_is_found(spark):
    df = spark.createDataFrame(data(400, 3), SCHEMA)
    whole = search(df, lambda i: i % 50 == 0, recall=1.0).collect()
    cut = search(df, lambda i: i % 50 == 0, recall=1.0, block_rows=90).collect()
    hits = len({(r.query_id, r.vec_id) for r in whole} & {(r.query_id, r.vec_id) for r in cut})
    assert hits >= 0.95 * len(whole) == 0.95 * len(cut)


def test_candidates_share_the_longest_prefixes():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    forest, q = PrefixForest(x, trees=3), rng.standard_normal((4, 8))
    strings, asked = hash_strings(x, 3), hash_strings(q, 3)
    for i, found in forest.candidates(q, 20):
        shared = np.array([max(64 - int(a ^ b).bit_length() for a, b in zip(strings[:, r], asked[:, i]))
                           for r in range(300)])
        level = shared[found].min()
        assert len(found) >= 20 and set(found) == set(np.flatnonzero(shared >= level))
        assert (shared > level).sum() < 20


def test_lengths_repeats_and_huge_or_tiny_components(spark):
    rows = [(50, [1.0, 2.0, 3.0]), (1, [3.0, 2.0, 1.0]), (2, [2.0, 4.0, 6.0]), (50, [1.0, 2.0, 3.1]),
            (100, [1e200, 1e200]), (3, [1e200, 0.0]), (4, [1e-200, 1e-200]), (5, [5e-324, 0.0]),
            (150, [1.0]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df, lambda i: i % 50 == 0, k=3).collect()
    own = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got]
    half = round(math.sqrt(0.5), 9)
    # both rows with id 50 are queries, and neighbours of each other
    assert sorted(x for x in own if x[0] == 100) == [(100, 1, 4, 1.0), (100, 2, 3, half), (100, 3, 5, half)]
    assert sorted((r, i) for q, r, i, _ in own if q == 50) == [(1, 2), (1, 2), (2, 50), (2, 50), (3, 1), (3, 1)]
    assert {x[0] for x in own} == {50, 100} and all(0 <= x[3] <= 1 for x in own)


def test_cores_do_not_change_the_blocks(spark):
    from topicspace.llm import prefix_forest as P
    df = spark.createDataFrame(data(300, 4), SCHEMA)
    one = search(df, lambda i: i % 50 == 0).collect()
    other = search(df.repartition(7), lambda i: i % 50 == 0).collect()
    assert P.SMALL_BLOCKS == 8 and len(one) == len(other) == 30
