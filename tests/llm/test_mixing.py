import random
import re

import pytest
from pyspark.sql import functions as F
from topicspace.llm.mixing import capped_targets, min_cost_flow, mix, mix_documents, op5_mix_sources


def test_targets():
    assert capped_targets([10, 100, 1000], [5, 2, 1], 300) == pytest.approx([20, 560 / 3, 280 / 3])
    assert capped_targets([10, 10], [1, 1], 100) == [20, 20]
    assert capped_targets([0, 5], [5, 2], 7.5) == [0, 7.5]


def brute_flow(supply, members, quotas, repeats):
    """Cheapest fullest flow by trying all ways to route single tokens."""
    best = None

    def go(p, left, cost, moved):
        nonlocal best
        if p == len(supply):
            key = (-moved, cost)
            best = key if best is None or key < best else best
            return
        def split(k, qs, left, taken):
            if k == len(qs):
                price = sum(max(0, min(supply[p], taken - r * supply[p])) * r for r in range(repeats))
                go(p + 1, left, cost + price, moved + taken)
                return
            for n in range(0, min(left[qs[k]], repeats * supply[p] - taken) + 1):
                after = list(left)
                after[qs[k]] -= n
                split(k + 1, qs, after, taken + n)
        split(0, members[p], list(left), 0)

    go(0, list(quotas), 0, 0)
    return best


def test_flow_is_the_cheapest_of_the_fullest():
    rng = random.Random(1)
    for _ in range(60):
        supply = [rng.randint(0, 3) for _ in range(3)]
        members = [rng.sample(range(3), rng.randint(0, 3)) for _ in range(3)]
        quotas = [rng.randint(0, 4) for _ in range(3)]
        given = min_cost_flow(supply, members, quotas, 2)
        moved = sum(map(sum, given))
        cost = sum(r * g for own in given for r, g in enumerate(own))
        assert (-moved, cost) == brute_flow(supply, members, quotas, 2)
        assert all(g <= n for own, n in zip(given, supply) for g in own)


def test_op5_against_brute_force(spark, table, doc_rows):
    rng = random.Random(2)
    rows = doc_rows + [(1000 + i, "w " * rng.randint(1, 40), "en", rng.choice(["s0", "s1", "s2", "é", None]), 1)
                       for i in range(400)]
    folder = table(rows)
    got = {r.doc_id: r for r in op5_mix_sources(spark, folder).collect()}
    assert len(got) == len(rows)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sums = [sum(size[r[0]] for r in rows if r[3] == s) for s in names]
    targets = capped_targets(sums, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sums))
    taken = dict.fromkeys(names, 0)
    for r in rows:
        g = got[r[0]]
        k = names.index(r[3])
        assert (g.size, g.source_size) == (size[r[0]], sums[k])
        assert g.target == pytest.approx(targets[k])
        assert g.taken in (0, g.size, 2 * g.size)
        taken[r[3]] += g.taken
    for s, n, t in zip(names, sums, targets):
        # no choice of whole documents comes near where one holds most of the source
        if max(size[r[0]] for r in rows if r[3] == s) < n / 2:
            assert abs(taken[s] - t) <= max(0.01 * t, 8), (s, taken[s], t)
    again = {r.doc_id: r.taken for r in op5_mix_sources(spark, folder).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_overlapping_sources_share_their_documents(spark):
    rows = [(i, ["a"]) for i in range(10)] + [(i, ["a", "b"]) for i in range(10, 30)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, sources array<string>").withColumn("size", F.lit(10))
    out = mix(df, weights={"a": 1, "b": 1}, share=0.8, key=["id"]).collect()
    copies = {r.id: r.copies for r in out}
    assert copies[99] == 0 and sum(copies.values()) == pytest.approx(25, abs=1)
    assert max(copies.values()) == 1


def test_mixed_documents_come_as_often_as_taken(spark, doc_rows):
    df = spark.createDataFrame([(*r, 1, "t") for r in doc_rows],
                               "doc_id long, text string, lang string, source string, n_chars int, size int, target string")
    out = mix_documents(df)
    assert out.columns == df.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts and set(counts.values()) <= {1, 2}
    assert mix_documents(df.where("doc_id < 0")).count() == 0


def test_empty_table(spark, table):
    assert op5_mix_sources(spark, table([])).count() == 0
