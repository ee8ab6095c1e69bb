"""The convolutional classifier and the skip-gram trainer on Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspace.operators import text as TX
from topicspace.plans import sequence_classifier as K
from topicspace.plans import skipgram_model as S


@pytest.fixture(scope="module")
def articles(spark):
    """Two classes told apart by their words; some articles are empty or null."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        label = 1 + i % 2
        words = rng.choice(["alpha", "beta", "gamma"] if label == 1 else ["delta", "kappa", "omega"], 30)
        rows.append((i, " ".join(words) if i % 30 else (None if i else ""), label))
    docs = spark.createDataFrame(rows, "article_id long, content string, label int")
    toks = TX.tokenize(docs, "content", "tokens", "words")
    vocab = TX.vocabulary(TX.word_counts(toks), 50).checkpoint(eager=True)
    vectors = np.vstack([np.zeros(4), rng.normal(size=(6, 4))]).astype(np.float32)
    return docs, K.Sequences(vocab, vectors, 40)


LAYERS = {"channels": 4, "hidden": 6, "pools": (3,)}


def test_sequences_keep_every_article(articles):
    docs, sequences = articles
    rows = sequences.of(docs, "article_id", "content", ["label"]).collect()
    assert len(rows) == 90 and all(len(r.seq) == 40 for r in rows)
    empty = [r for r in rows if r.article_id % 30 == 0]
    assert len(empty) == 3 and all(not any(r.seq) for r in empty)
    assert all(all(r.seq[:30]) and not any(r.seq[30:]) for r in rows if r.article_id % 30)


def test_texts_with_several_labels_are_taken_apart_once(spark, articles, monkeypatch):
    """Rows of a key share one sequence of all their places; equal texts are tokenised once."""
    _, sequences = articles
    idx = {r.word: r.idx for r in sequences.vocab.collect()}
    docs = spark.createDataFrame(
        [(1, "alpha none beta", 1), (1, "alpha none beta", 2), (2, "gamma", 1), (2, "delta omega", 2),
         (3, "kappa", 1), (4, None, 1), (4, None, 2), (None, "alpha", 1)],
        "article_id long, content string, label int")
    seen = []
    inner = TX.tokenize
    monkeypatch.setattr(K.TX, "tokenize", lambda df, *a: (seen.append(df.count()), inner(df, *a))[1])
    rows = sequences.of(docs, "article_id", "content", ["label"]).collect()
    want = {1: ["alpha", "alpha", "beta", "beta"], 2: sorted(["gamma", "delta"], key=idx.get) + ["omega"],
            3: ["kappa"], 4: [], None: []}
    assert sorted((r.article_id or 0, r.label) for r in rows) == [
        (0, 1), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (4, 2)]
    for r in rows:
        words = [idx[w] for w in want[r.article_id]]
        assert list(r.seq) == words + [0] * (40 - len(words))
    assert seen == [6]


def test_restart_gives_the_same_model(spark, articles, tmp_path):
    docs, sequences = articles
    run = {"epochs": 3, "batches": 2, "rate": 0.05, "top_k": 1, "seed": 4, **LAYERS}
    whole = K.train(docs, sequences, 2, str(tmp_path / "a"), **run)
    K.train(docs, sequences, 2, str(tmp_path / "b"), **{**run, "epochs": 1})
    again = K.train(docs, sequences, 2, str(tmp_path / "b"), **run)
    assert np.array_equal(whole.params, again.params) and whole.history == again.history
    assert [h["epoch"] for h in whole.history] == [0, 1, 2] and whole.history[0]["n"] > 0
    assert whole.history[-1]["loss"] < whole.history[0]["loss"]
    loaded = K.load(spark, str(tmp_path / "a"), sequences, 2, **LAYERS)
    assert np.array_equal(loaded.params, whole.params)
    scored = loaded.predict(docs)
    assert scored.columns == ["article_id", "label", "prediction", "scores"] and scored.count() == 90
    assert scored.where("article_id % 30 <> 0").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.9
    with pytest.raises(FileNotFoundError):
        K.load(spark, str(tmp_path / "none"), sequences, 2, **LAYERS)


def test_tree_of_gradients_is_the_whole_gradient(spark, articles):
    docs, sequences = articles
    rows = sequences.of(docs, "article_id", "content", ["label"]).repartition(7).checkpoint(eager=True)
    net = K.ConvNet(4, 2, 40, **LAYERS)
    params = net.flat(net.initial(1)).astype(np.float64)
    g, loss, n = K.mean_gradient(rows, net, params, sequences.vectors)
    local = rows.collect()
    want_loss, want = net.gradient(net.shaped(params.astype(np.float32)),
                                   sequences.vectors[np.array([r.seq for r in local])],
                                   np.array([r.label for r in local]) - 1)
    assert n == 90 and np.isclose(loss, want_loss / 90, rtol=1e-4)
    assert np.allclose(g, net.flat(want) / 90, atol=1e-4)
    empty = rows.where("label = 9")
    assert K.mean_gradient(empty, net, params, sequences.vectors)[2] == 0


def test_rows_of_one_text_go_through_the_network_once(monkeypatch):
    """Rows that stand together with one sequence are one of the network's, texts of like
    length go together, and every row gets the result of its own."""
    monkeypatch.setattr(K, "PLACES_TOGETHER", 400)
    net = K.ConvNet(4, 3, 100, channels=4, hidden=6, pools=(3,))
    rng = np.random.default_rng(5)
    texts = np.zeros((60, 100), dtype=np.int32)
    for i, n in enumerate(rng.integers(0, 100, 60)):
        texts[i, :n] = rng.integers(1, 30, n)
    whole = texts[np.repeat(np.arange(60), rng.integers(1, 4, 60))]
    batch = K.pa.RecordBatch.from_pydict({"seq": K.pa.array(list(whole), K.pa.list_(K.pa.int32()))})
    parts = list(K._batches(batch, net))
    assert sorted(np.concatenate([rows for _, rows, _ in parts])) == list(range(len(whole)))
    assert sum(len(seqs) for seqs, _, _ in parts) == len(np.unique(texts, axis=0)) < len(whole)
    for seqs, rows, of in parts:
        n = seqs.shape[1]
        assert np.array_equal(seqs[of], whole[rows, :n]) and not whole[rows, n:].any()
    assert sum(seqs.size for seqs, _, _ in parts) < 0.9 * 60 * 100


def test_pair_gradients_by_differences():
    rng = np.random.default_rng(0)
    x, y, z = rng.normal(size=(3, 5)), rng.normal(size=(3, 5)), rng.normal(size=(4, 5))
    x[:, -1] = 1
    c, o, n, neg = np.array([0, 1, 0]), np.array([2, 3, 3]), np.array([2.0, 1, 5]), np.array([0, 2, 3, 7])
    le = np.log(rng.random(9))
    x[2] = x[0]
    y[2] = y[1]
    z[1], z[2] = y[0], y[1]  # the negatives are rows of the same table

    def loss(a, b, d):
        return S.pair_gradients(c, o, n, a, b, neg, d, le)[0]

    _, parts = S.pair_gradients(c, o, n, x, y, neg, z, le)
    (_, ic, gc), (_, io, go) = parts
    assert ic.tolist() == [0, 1] and io.tolist() == [0, 2, 3, 7]
    assert gc[:, -1].tolist() == [7, 1]
    step = 1e-6
    for k in range(4):
        moved = x.copy()
        moved[[0, 2], k] += step
        assert np.isclose((loss(moved, y, z) - loss(x, y, z)) / step, gc[0, k], atol=1e-3)
    for k in range(5):  # context 3: true word of pairs 1 and 2, negative of pair 0
        b, d = y.copy(), z.copy()
        b[[1, 2], k] += step
        d[2, k] += step
        assert np.isclose((loss(x, b, d) - loss(x, y, z)) / step, go[2, k], atol=1e-3)


def test_skipgram_groups_words_that_share_contexts(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        a = rng.choice(["a1", "a2", "a3"], 40) if i % 2 else rng.choice(["b1", "b2", "b3"], 40)
        rows.append((i, " ".join(a)))
    docs = spark.createDataFrame(rows + [(99, None), (98, "")], "article_id long, text string")
    got = {r.word: np.array(r.vec) for r in S.learn_skipgram(
        docs, vocab_size=20, dim=12, steps=4, epochs=3, rate=0.2, spread=0.02, negatives=6).collect()}
    assert set(got) == {"a1", "a2", "a3", "b1", "b2", "b3"}
    for w, v in got.items():
        near = max((x for x in got if x != w), key=lambda x: v @ got[x] / np.linalg.norm(got[x]))
        assert near[0] == w[0]


def test_word_pairs_count_whole_windows(spark):
    docs = spark.createDataFrame([(1, ["x", "y", "x", "z"]), (2, ["q"]), (3, [])],
                                 "article_id int, tokens array<string>")
    vocab = spark.createDataFrame([("x", 1), ("y", 2), ("UNK", 0)], "word string, idx int")
    got = {(r.c, r.o): r.n for r in S.word_pairs(docs, vocab).collect()}
    assert got == {(1, 2): 2, (2, 1): 2, (1, 0): 1, (0, 1): 1}
