import random
import re

import numpy as np
import pytest

from topicspace.llm import shingle_join as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k=3):
    w = words_of(text)
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else \
        {" ".join(w)} if w else set()


def components(sets, percent):
    """Brute force: the smallest place that links reach, for each set."""
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(sets))]


def brute(rows, percent=90):
    sets = [shingles(r[1]) for r in rows]
    roots = components(sets, percent)
    least = {}
    for r, c in zip(rows, roots):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted(((r[0], len(s), least.get(c)) for r, s, c in zip(rows, sets, roots)), key=str)


def near_copies(doc_rows, seed=2):
    """Chains of texts each a little different from the one before, and a hot group."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(4000)}" for _ in range(120)]
    rows, at = [], 1000
    for _ in range(60):
        rows.append((at, " ".join(base), "en", "s", 1))
        base = list(base)
        base[rng.randrange(len(base))] = f"u{rng.randrange(4000)}"
        at += 1
    hot = [f"h{i}" for i in range(80)]
    for _ in range(60):
        own = list(hot)
        if rng.random() < 0.7:
            own[rng.randrange(80)] = f"q{rng.randrange(5)}"
        rows.append((at, " ".join(own).upper(), "en", "s", 1))
        at += 1
    return doc_rows + rows + rows[:5] + [(None, "no id at all here", "en", "s", 1),
                                         (None, rows[0][1], "en", "s", 1), (7, rows[3][1], "", "", 0)]


@pytest.mark.parametrize("block", [S.BLOCK_SHINGLES, 900])
def test_components_match_brute_force(spark, doc_rows, block):
    rows = near_copies(doc_rows)
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(r[0], r[1], 4, "x") for r in rows],
                                 "doc_id long, text string, n int, cls string").repartition(5)
    got = S.jaccard_components(docs, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_query(spark, table, doc_rows):
    rows = near_copies(doc_rows, 5)
    got = S.op12_shingle_join(spark, table(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert S.op12_shingle_join(spark, table([])).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    bands = S.Bands(percent)
    for size in [1, 2, 8, 9, 10, 11, 19, 20, 57, 300, 2000]:
        for _ in range(6):
            own = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            most = len(own) - -(-percent * len(own) // 100)  # as many as may go or come
            gone = int(rng.integers(0, most + 1))
            other = np.delete(own, rng.choice(len(own), gone, replace=False))
            room = 100 * len(other) // percent - len(own)
            if room > 0:
                other = np.unique(np.concatenate([other, rng.integers(0, 1 << 64, room,
                                                                      dtype=np.uint64)]))
            both = len(np.intersect1d(own, other))
            if 100 * both >= percent * (len(own) + len(other) - both):
                assert set(S.segment_keys(own, bands)) & set(S.segment_keys(other, bands))


@pytest.mark.parametrize("heap", [0, S.HEAP_ENTRIES])
@pytest.mark.parametrize("percent", [40, 80, 90])
def test_search_matches_brute_force(heap, percent, monkeypatch):
    monkeypatch.setattr(S, "HEAP_ENTRIES", heap)
    rng = random.Random(heap + percent)
    for _ in range(30):
        pool = rng.randrange(8, 60)
        sets = [set(rng.sample(range(pool), rng.randrange(0, pool))) for _ in range(rng.randrange(0, 25))]
        sets += [s ^ {rng.randrange(pool)} for s in sets[:10]]
        links = S.spanning_links([np.array(sorted(s), dtype=np.uint64) for s in sets], percent)
        for a, b in links:
            both = len(sets[a] & sets[b])
            assert 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
        root = list(range(len(sets)))
        for _ in sets:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert root == components(sets, percent)
        assert len(links) <= max(0, len(sets) - 1)  # a forest, never all pairs


def test_merges_agree():
    rng = random.Random(4)
    for _ in range(100):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 30))) for _ in range(rng.randrange(1, 12))]
        least = rng.randrange(1, len(lists) + 1)
        want = {x: n for x in range(40) if (n := sum(x in own for own in lists)) >= least}
        assert S.merge_skip(lists, least) == want
        members, counts = S.run_merge([np.array(own, dtype=np.int64) for own in lists], least)
        assert dict(zip(members.tolist(), counts.tolist())) == want


def test_sets_of_short_and_long_texts():
    texts = ["a b c", "A B\tC", "a b", "a", None, "", " \n", "a b c a b c a b c", "x " * 400_000]
    got = [len(s) for s in S.shingle_sets(texts)]
    assert got == [1, 1, 1, 1, 0, 0, 0, 3, 1]
    one, two, three, four = S.shingle_sets(["a b c", "A B\tC", "a b", "b a"])
    assert one.tolist() == two.tolist() and three.tolist() != four.tolist()
