import random
import re
from collections import Counter

from pyspark.sql import functions as F
from topicspace.llm import quality
from topicspace.llm.quality import (ABSTAIN, BAD, GOOD, fit_label_model, judge, keep_documents,
                                    op7_quality_rules, repeat_words, words)

JUNK = [t for k in range(8) for t in (
    " | ".join(["table"] * 3 + [f"cell{i}x{k}" for i in range(60)]) + " |",
    " ".join(f"wo{i}r{k}d$$$%%%" for i in range(80)))]


def brute(text):
    words_ = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words_, words_[1:], words_[2:]))
    inside = {i + k for i, g in enumerate(zip(words_, words_[1:], words_[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words_), sum(map(len, words_)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(inside))


CASES = ["a a a a", "a b c a b c", "a b a b a", "a b c d a b c", "x y z", "x", "a\nb\na\n \n \nb\nb",
         "one two three " * 60, "é 漢 é 漢 é 漢 \xa0é"]


def test_op7_against_brute_force(spark, table, doc_rows):
    rows = doc_rows + [(500 + i, t, None, None, None) for i, t in enumerate(CASES + JUNK)]
    df = op7_quality_rules(spark, table(rows))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        n, chars, symbols, dup, rep = brute(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            n, chars, symbols, dup, rep), text and text[:40]
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)
    assert all(got[i].kept for i in range(40))
    assert not any(got[500 + len(CASES) + i].kept for i in range(len(JUNK)))


def test_repeats_with_colliding_sort_keys(spark, monkeypatch):
    """With almost no hash bits in the sort key, or too short a place, the whole-hash
    key must give the same counts."""
    texts = [" ".join(f"w{(i * 7) % m}" for i in range(90)) for m in (5, 31, 200)] + CASES
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [brute(t)[4] for t in texts]
    for bits in (62, 3, 24):
        monkeypatch.setattr(quality, "PLACE_BITS", bits)
        got = [r.n for r in df.select(repeat_words(words("t")).alias("n")).collect()]
        assert got == want, bits


def test_label_model_finds_the_reliable_rules():
    # three rules agree on the class, one votes at random
    patterns = Counter()
    rng = random.Random(4)
    for _ in range(4000):
        y = GOOD if rng.random() < 0.75 else BAD
        vote = [y if rng.random() < p else -y for p in (0.97, 0.9, 0.85, 0.5)]
        vote[2] = ABSTAIN if rng.random() < 0.2 else vote[2]
        patterns[tuple(vote)] += 1
    model = fit_label_model(sorted(patterns.items()), 4)
    assert all((q >= 0.5) == (p[0] == GOOD) for p, q in model.items() if p[1] == p[0])
    assert abs(model[(GOOD, BAD, GOOD, GOOD)] - model[(GOOD, BAD, GOOD, BAD)]) < 0.1
    assert fit_label_model([], 4) == {}


def test_kept_rows_have_the_columns_of_the_input(spark, doc_rows):
    df = spark.createDataFrame([(*r, True, 1.5) for r in doc_rows],
                               "doc_id long, text string, lang string, source string, n_chars int, kept boolean, quality double")
    out = keep_documents(df)
    assert out.columns == df.columns
    ids = {r.doc_id for r in out.collect()}
    assert set(range(40)) <= ids and not ids & {40, 41, 42, 43}
    assert judge(df.where("doc_id < 0").select("doc_id", "text")).count() == 0
    assert keep_documents(spark.createDataFrame([(None, None)], "doc_id int, text string")).count() == 0


def test_repeated_rows_each_get_a_verdict(spark, doc_rows):
    df = spark.createDataFrame([(1, doc_rows[0][1])] * 3, "doc_id int, text string")
    assert judge(df).agg(F.count("*")).first()[0] == 3


def test_empty_table(spark, table):
    assert op7_quality_rules(spark, table([])).count() == 0


def test_long_runs_without_letters_take_linear_time(spark, table):
    import time
    rows = [(1, "." * 1_000_000, "en", "s", 1), (2, "x" * 1_000_000, "en", "s", 1),
            (3, "# " * 300_000 + "word", "en", "s", 1), (4, "-a- " * 200 + "... " * 200, "en", "s", 1)]
    start = time.time()
    from topicspace.llm.quality import statistics
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.n_lettered for r in statistics(docs).select("doc_id", "n_lettered").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 200}
    assert time.time() - start < 60
