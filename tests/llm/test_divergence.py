import random
import re
from collections import Counter

from topicspace.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=30, top=50):
    groups, held = {}, {}
    for _, text, lang, source, _ in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
        held.setdefault(lang or "", Counter()).update(set(terms))
    out = set()
    for lang in held:
        kept = sorted(t for t, n in held[lang].items() if n >= min_docs)
        own = {s: {t: c[t] for t in kept} for (a, s), c in groups.items() if a == lang}

        def shares(counts):
            total = sum(counts.values())
            return {t: 1 + 10 ** 9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares({t: sum(c[t] for c in own.values()) for t in kept})
        p = {s: shares(c) for s, c in own.items()}
        for s in own:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s],
                     "term": [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)
                        if part == "pair" or i < top}
    return out


def documents(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Éa", "éa", "漢字", "ZED"]
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["s1", "s2", "é", "", None])
        lang = rng.choice(["en", "en", "de", None, "xx"]) if i % 50 else "rare"
        some = words[: 60 + 10 * len(source or "")]
        text = rng.choice([None, "", "12 34 _"]) if i % 9 == 0 else " ".join(
            rng.choice(some) + rng.choice(["", "1", ".", "-x"]) for _ in range(rng.randint(1, 60)))
        rows.append((i, text, lang, source, 0))
    return rows + rows[:20]


def test_query_matches_brute_force(spark, table):
    rows = documents()
    got = D.op13_source_divergence(spark, table(rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    want = brute(rows)
    assert len(found) == len(want) and set(found) == want
    assert {r[2] for r in found} == {"pair", "term"}


def test_few_ranks_with_ties_and_small_memory(spark, monkeypatch):
    rows = documents(120, 8)
    docs = spark.createDataFrame([(r[1], r[2], r[3], 5) for r in rows],
                                 "text string, lang string, source string, n int")
    for top, held in ((1, 1 << 18), (3, 5)):
        monkeypatch.setattr(D, "HELD_ENTRIES", held)
        got = {tuple(r) for r in D.audit(docs, min_docs=2, top=top).collect()}
        assert got == brute(rows, 2, top)


def test_no_kept_terms_one_source_and_empty_table(spark, table):
    rows = [(1, "one two", "en", "a", 1), (2, None, "en", "b", 1), (3, "x", "de", "a", 1)]
    got = sorted(tuple(r) for r in D.op13_source_divergence(spark, table(rows)).collect())
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert D.op13_source_divergence(spark, table([])).count() == 0


def test_counts_beyond_double_precision(spark):
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big - 7, big, 11)], "c long, t long, v long")
    got = df.select(D.share("c", "t", "v").alias("p")).first().p
    assert got == 1 + 10 ** 9 * (big - 2) // (big + 55)
