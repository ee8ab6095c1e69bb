import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from topicspace.llm import token_files as T

PATH = public_tokenizers.path(T.TOKENIZER)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_library(tokenizer, doc_rows, monkeypatch):
    monkeypatch.setattr(T, "CACHE_PIECES", 7)  # the cache turns over all the time
    e = T.Encoder(PATH)
    odd = ["a  b", "a \n b", "\x1c x", "x\xa0 y", "don't 's 'S  12 3.5,", "<|endoftext|> hi", "a\n\nb",
           "a\nb\n", "\n", "é😀 ñ\tq", " a", "'s\n't b", "a.,b ,c. .d", "Ab.\nCd e\n,f ②x ½"]
    for text in [*odd, *[r[1] for r in doc_rows if r[1]]]:
        assert e(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def test_op4_against_the_library(spark, table, doc_rows, tokenizer):
    rows = [*doc_rows, (None, "no id", None, None, 5)]
    got = T.op4_token_files(spark, table(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    at = 0
    for i, text in sorted([(r[0], r[1]) for r in rows], key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (by_id[i].start, by_id[i].n_tokens) == (at, len(ids))
        assert by_id[i].ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)


def test_random_access_to_sequences(spark, tmp_path, doc_rows, tokenizer):
    df = spark.createDataFrame([(r[0], r[1]) for r in doc_rows], "doc_id long, text string")
    manifest = T.write_token_files(df.coalesce(1), str(tmp_path / "t"), PATH, seq_len=32).orderBy("file")
    ids = [x for r in doc_rows for x in [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]]
    at = 0
    for f in manifest.collect():
        file, own = T.SequenceFile(f.path), ids[at:at + f.tokens]
        n = -(-len(own) // 32)
        for i in {0, n // 2, n - 1} if own else ():
            seq, mask = file.sequence(i)
            want = own[32 * i:32 * i + 32]
            assert len(seq) == len(mask) == 32 and mask.sum() == len(want)
            assert seq[:len(want)].tolist() == want and not seq[len(want):].any()
        if own:
            assert np.concatenate(list(file.span(1, len(own) - 1))).tolist() == own[1:]
        at += f.tokens
    assert at == len(ids)


def test_empty_table(spark, table):
    assert T.op4_token_files(spark, table([])).count() == 0


def test_strings_of_added_tokens(spark, table):
    library = Tokenizer.from_file(PATH)  # unchanged
    texts = ["end <|endoftext|> start", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "a\n<|endoftext|>\n b",
             "<|endoftext|", "x  <|endoftext|>  y <|endoftext|>", "no such string"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [437, 220, 50256, 923]
    e = T.Encoder(PATH, special_text=False)
    assert [e(t).tolist() for t in texts] == want
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in T.op4_token_files(spark, table(rows)).collect()}
    at = 0
    for i, ids in enumerate(want):
        crc = zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids) + 1, crc)
        at += len(ids) + 1


def test_words_met_once_are_not_kept(tokenizer):
    e = T.Encoder(PATH)
    words = [f"{a}{b}{c}q{mark}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"
             for mark in ("", "!7")]
    text = " ".join(words)
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert e(text).tolist() == want
    assert len(e.cache) + len(e.units) < 50
    assert e(text).tolist() == want and len(e.cache) > 1000  # met again: kept
    assert e(text).tolist() == want
