import random

import numpy as np
import xxhash
from topicspace.llm.simhash import (deduplicate, fingerprint_links, near_duplicate_components,
                                    op2_simhash_near_dedup, spanning_links)


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ")
             .replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, max_bits=2):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_op2_against_brute_force(spark, table, doc_rows):
    got = {r.doc_id: r for r in op2_simhash_near_dedup(spark, table(doc_rows)).collect()}
    prints = [brute_fingerprint(r[1]) for r in doc_rows]
    comps = brute_components(prints)
    for i, (p, c) in enumerate(zip(prints, comps)):
        assert got[i].fingerprint == f"{p:016x}"
        assert got[i].component_id == c


def test_components_of_chains_and_balls(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:10]:                       # chains of two-bit steps, past ten bits in all
        for _ in range(8):
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.append(v)
    values += [values[0] ^ (1 << a) for a in range(64)]
    values += [values[1] ^ 0b111]               # three bits: no link
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    marked = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = {r.fp: r.root for r in near_duplicate_components(marked).collect()}
    comps = brute_components(values)
    same = {}
    for v, c in zip(signed, comps):
        same.setdefault(c, set()).add(got[v])
    assert all(len(s) == 1 for s in same.values())
    assert len(set(got.values())) == len(set(comps))


def test_links_are_true_and_few(spark):
    base = 0x0123456789ABCDEF
    ball = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)})
    fps = spark.createDataFrame([(v,) for v in ball], "fp long")
    links = fingerprint_links(fps).collect()
    assert all(bin((r.a ^ r.b) & (2 ** 64 - 1)).count("1") <= 2 for r in links)
    assert len(links) < 28 * len(ball)
    assert len(spanning_links(np.array(ball, dtype=np.uint64), 4)) == len(ball) - 1


def test_deduplicate_keeps_one_row_and_all_columns(spark, doc_rows):
    rows = [(*r, i) for i, r in enumerate(doc_rows)] + [(*doc_rows[3], 99), (None, "One", None, None, 3, 5)]
    df = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars int, fingerprint int")
    out = deduplicate(df).collect()
    assert df.columns == deduplicate(df).columns
    comps = brute_components([brute_fingerprint(r[1]) for r in rows])
    assert len(out) == len(set(comps))
    assert [r.doc_id for r in out if r.text == "One"] == [43]
    assert len([r for r in out if r.doc_id == 3]) == 1
    assert deduplicate(df.where("doc_id < 0")).count() == 0


def test_empty_table(spark, table):
    assert op2_simhash_near_dedup(spark, table([])).count() == 0
