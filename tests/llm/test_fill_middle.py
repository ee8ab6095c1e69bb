import hashlib

from topicspace.llm import fill_middle as M


def brute(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        form, out = "spm", f"<S>{suf}<P>{pre}<M>{mid}"
    else:
        form, out = "psm", f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, a, b - a, sha(out), sha(text), out


ODD = [(900, "has <P> inside", "en", "s", 1), (901, "ends with <S", "en", "s", 1),
       (902, "<", "en", "s", 1), (None, "no id", "en", "s", 1), (903, "é漢\U0001F600" * 40, "", "", 0),
       (904, "x" * 300_000, None, None, None), (905, "<M", "en", "s", 1)]


def test_query_matches_brute_force(spark, table, doc_rows):
    rows = doc_rows + ODD + doc_rows[:3]
    sf = table(rows)
    got = M.op11_fill_in_middle(spark, sf)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                           "restored_sha256"]
    want = [brute(r[0], r[1])[:7] for r in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_outputs_and_restored_texts_over_small_frames(spark, doc_rows):
    rows = [(r[0], r[1]) for r in doc_rows + ODD]
    # columns that the operator also makes give way; others stay
    docs = spark.createDataFrame([(*r, "keep", "old") for r in rows],
                                 "doc_id long, text string, extra string, form string")
    stored = M.store_frames(docs, units=7)
    assert "text" not in stored.columns and "extra" in stored.columns
    out = M.fill_in_middle(stored)
    texts = {r.doc_id: (r.form, r.text, r.extra) for r in M.read_text(out).collect()}
    back = {r.doc_id: r.text for r in M.read_text(M.restore(out)).collect()}
    for doc_id, text in rows:
        want = brute(doc_id, text)
        assert texts[doc_id] == (want[2], want[7], "keep")
        assert back[doc_id] == (text or "")


def test_only_cut_frames_are_decompressed():
    codec = M.Codec()
    text = "".join(chr(97 + i % 26) for i in range(1000))
    frames = codec.frames(text, 100)
    ends = [100 * (i + 1) for i in range(10)]
    opened = []
    raw = codec.raw
    codec.raw = lambda f: opened.append(f) or raw(f)
    parts = codec.span(frames, ends, 150, 820)
    assert len(opened) == 2 and parts[1:-1] == frames[2:8]
    assert b"".join(map(raw, parts)).decode() == text[150:820]
    assert codec.span(frames, ends, 300, 300) == []
    assert codec.span(frames, ends, 0, 1000) == frames


def test_marks_are_found_across_frames():
    codec = M.Codec()
    text = "ab<S>cd<P>ef<M>gh"
    for units in (1, 2, 3, 5, 100):
        assert codec.places(codec.frames(text, units), M.MARKS) == [7, 2, 12]
    assert codec.places(codec.frames("a<P", 2), M.MARKS) == [-1, -1, -1]


def test_empty_table_and_other_seed(spark, table, doc_rows):
    assert M.op11_fill_in_middle(spark, table([])).count() == 0
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    stored = M.store_frames(docs)
    forms = {M.fill_in_middle(stored, seed=s, plain_from=100, spm_below=100).first().form
             for s in range(3)}
    assert forms == {"spm"}
