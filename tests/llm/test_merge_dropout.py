import heapq
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from topicspace.llm import merge_dropout as M

PATH = public_tokenizers.path(M.MODEL)
TEXTS = ["Hello  world", " lead", "a\nb", "tab\tx", "ﬁ ＡＢ", "😀x", "  ", "trail  ", "\xa0x​", "<s>hi</s>",
         "12345 67", "ab " * 300, "unbelievable internationalisation", "漢字かな"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_rate_zero_is_the_model(model, doc_rows):
    e = M.Encoder(PATH, 0.0)
    for text in TEXTS + [r[1] for r in doc_rows if r[1] and M.MARK not in r[1]]:
        assert e.encode_batch([text], [7])[0].tolist() == model.encode(text), text


def brute_segment(model, text, key, rate):
    """One word by a plain agenda with the same keyed draws."""
    ids = {model.id_to_piece(i).replace(M.MARK, " "): i for i in range(259, 32000)}
    sym, place = list(text), list(range(len(text)))
    gone = set()
    while True:
        agenda = []
        for i in range(len(sym) - 1):
            piece = sym[i] + sym[i + 1]
            if piece in ids and (place[i], place[i + 1], piece) not in gone:
                agenda.append((-model.get_score(ids[piece]), i, piece))
        if not agenda:
            break
        _, i, piece = heapq.nsmallest(1, agenda)[0]
        if M.draw_one(key, place[i], ids[piece]) < int(rate * 2 ** 64):
            gone.add((place[i], place[i + 1], piece))
            continue
        # the neighbours' pairs are new candidates
        sym[i:i + 2], place[i:i + 2] = [piece], [place[i]]
    return [x for s in sym for x in ([ids[s]] if s in ids else [3 + b for b in s.encode()])]


def brute_key(seed, document, place, word):
    """The key of the word at a place (from 0) of a document."""
    z = ((document ^ seed) + (place + 1) * int(M.GOLDEN)) % 2 ** 64
    mix = lambda x: int(M._mix(np.array([x % 2 ** 64], dtype=np.uint64))[0])
    return mix(mix(z) ^ M.char_hash(word))


def test_draws_agree():
    keys, codes = [1, 2 ** 64 - 1, 77], [(3, 5), (0, 31999), (63, 0)]
    got = M.draws(np.array(keys, dtype=np.uint64), np.array([a << 32 | b for a, b in codes]))
    assert got.tolist() == [M.draw_one(k, a, b) for k, (a, b) in zip(keys, codes)]


@pytest.mark.parametrize("rate", [0.1, 0.5])
def test_dropout_against_a_plain_agenda(model, rate):
    """Every occurrence of a word has draws of its own, by document and place."""
    words = [" unbelievable", " internationalisation", " the", " x", " 😀word", " Zürich", " is",
             " " + "antidisestablishment" * 4]  # the last is longer than the trees' words
    text = "".join(words * 12)
    e = M.Encoder(PATH, rate, seed=5)
    for document in (9, 10):
        got = e.encode_batch([text[1:], "", text[1:]], [document, 3, document])
        want = [brute_segment(model, w, brute_key(5, document, i, w), rate)
                for i, w in enumerate(words * 12)]
        assert got[0].tolist() == [x for w in want for x in w] == got[2].tolist() and not len(got[1])
    # more different segmentations than any small number of streams would give
    found = {tuple(e.encode_batch(["internationalisation"], [d])[0].tolist()) for d in range(400)}
    assert len(found) > 30


def test_long_words_take_linear_time(model):
    text = "abcdefghij" * 100_000
    start = time.process_time()
    ids = M.Encoder(PATH).encode_batch([text], [1])[0]
    assert time.process_time() - start < 60
    assert M.Encoder(PATH).decode(ids.tolist()) == text
    some = " " + "qzabcdexyz漢" * 30
    e = M.Encoder(PATH)
    assert e.pieces.heap_segment(some, 8, int(0.2 * 2 ** 64)).tolist() == brute_segment(model, some, 8, 0.2)


def test_varied_but_lossless(model):
    e = M.Encoder(PATH)
    text = "internationalisation " * 200 + "own ▁ mark \U0010FFFE\U0010FFFF \x1f"
    ids = e.encode_batch([text], [3])[0]
    assert e.decode(ids.tolist()) == text
    assert len({tuple(x) for x in [ids[:40].tolist(), e.encode_batch([text], [4])[0][:40].tolist()]}) == 2
    assert e.encode_batch([text], [3])[0].tolist() == ids.tolist()
    assert len(ids) > len(M.Encoder(PATH, 0.0).encode_batch([text], [3])[0])


def test_op8_round_trip(spark, table, doc_rows):
    rows = doc_rows + [(900 + i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(1, "again", None, None, 5)] * 2
    got = M.op8_merge_dropout(spark, table(rows)).collect()
    assert len(got) == len(rows)
    e = M.Encoder(PATH)
    text = {r[0]: r[1] for r in doc_rows}
    for r in got:
        if r.doc_id in text and r.doc_id != 1:
            t = text[r.doc_id]
            if t is None:
                assert r.ids is None and r.n_pieces == 0 and r.lossless is None and r.ids_crc32 is None
                continue
            assert r.lossless and e.decode(r.ids) == t and r.n_pieces == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<i4").tobytes())
    assert M.op8_merge_dropout(spark, table([])).count() == 0


def test_small_cache_changes_nothing(monkeypatch, doc_rows):
    texts = [r[1] for r in doc_rows]
    whole = [x.tolist() for x in M.Encoder(PATH).encode_batch(texts, list(range(len(texts))))]
    monkeypatch.setattr(M, "CACHE_SEGMENTS", 50)
    monkeypatch.setattr(M, "SEGMENTS_TOGETHER", 30)
    monkeypatch.setattr(M, "MATRIX_CELLS", 64)
    assert [x.tolist() for x in M.Encoder(PATH).encode_batch(texts, list(range(len(texts))))] == whole


def test_symbols_without_a_piece_merge_with_nothing():
    pieces = M.Pieces(PATH)
    known = pieces.byte_ids[:1]
    for a, b in ((-1, -1), (-1, 5), (5, -1), (M.ABSENT, 5), (5, M.ABSENT), (-0x10FFFF, -1)):
        assert pieces.merged(np.array([a], np.int32), np.array([b], np.int32)).tolist() == [-1]
    assert pieces.merged(known, known).tolist() == [-1]
