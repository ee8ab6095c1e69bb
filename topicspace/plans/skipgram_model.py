"""Skip-gram embeddings trained with sampled softmax and Adagrad, distributed.

The model is a table: one row for each word and side (0: the word as a center, 1: as a
context), dealt by word, holding its parameters and their squared-gradient sums. A
step takes a share of the counted (center, context) pairs, joins them to the rows they
touch, computes gradients batch by batch in numpy, sums them by row and side, and joins
the sums back to the table for the Adagrad update. Only the step's negatives (a fixed
number of rows) pass through the driver.

A row's gradient is the mean over the pairs it takes part in, so that one step moves rare
and frequent words alike; Adagrad then slows down each value by what it has moved.

Pairs are counted first, so a pair that stands a million times is one row of weight one
million, and a frequent word's gradient is summed within each task before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspace.operators import text as TX
from topicspace.operators.common import BROADCAST_BYTES, BROADCAST_ROWS, bounded_broadcast
from topicspace.operators.skipgram import skipgram_counts, skipgrams
from topicspace.operators.vectors import vector_sum
from topicspace.session import shared_dir

# The original trainer's settings.
RATE = 1.0              # Adagrad learning rate
ACCUMULATED = 0.1       # squared-gradient sum at the start
NEGATIVES = 64          # sampled words of a step
#: Rows of a gradient batch.
ROWS_TOGETHER = 4096


def word_pairs(docs: DataFrame, vocab: DataFrame, doc: str = "article_id", tokens: str = "tokens",
               window: int = 1, num_skips: int | None = None, seed: int = 0) -> DataFrame:
    """``(c int, o int, n bigint)``: how often each (center, context) pair of vocabulary
    indexes stands within ``window``; a word outside the vocabulary has index 0. The words
    become indexes before anything is counted, so that what is shuffled are pairs of
    the vocabulary, not of all words."""
    known = vocab.where(F.col("idx") > 0).select("word", F.col("idx").cast("int").alias("idx"))
    if num_skips is None or num_skips >= 2 * window:
        rows = known.where(F.col("word").isNotNull()).limit(BROADCAST_ROWS + 1).toArrow()
        words = pa.array(rows.column("word").to_pylist(), pa.string())
        if (len(words) <= BROADCAST_ROWS and words.nbytes <= BROADCAST_BYTES
                and len(words.unique()) == len(words)):
            return skipgram_counts(docs, tokens, words, rows.column("idx").to_numpy(), window)
    met = skipgrams(docs, doc, tokens, window, num_skips, seed).select("center", "context")
    left = bounded_broadcast(known.select(F.col("word").alias("center"), F.col("idx").alias("_c")))
    right = bounded_broadcast(known.select(F.col("word").alias("context"), F.col("idx").alias("_o")))
    return (met.join(left, "center", "left").join(right, "context", "left")
            .groupBy(F.coalesce("_c", F.lit(0)).cast("int").alias("c"),
                     F.coalesce("_o", F.lit(0)).cast("int").alias("o"))
            .agg(F.count(F.lit(1)).alias("n")))


def _uniform(seed: int, *keys: Column) -> Column:
    """A repeatable number in (0, 1) for the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def initial_state(words: DataFrame, dim: int, seed: int, spread: float = 1.0) -> DataFrame:
    """``(side, idx, x array<float>, acc array<float>)`` for the vocabulary ``words(idx)``:
    centers uniform in (-``spread``, ``spread``) with a constant 1 at the end, contexts normal with standard
    deviation ``1 / sqrt(dim)``, cut at two of them, with a bias of 0 at the end."""
    place = F.sequence(F.lit(0), F.lit(dim - 1))
    centers = F.transform(place, lambda i: spread * (2 * _uniform(seed, F.lit("c"), F.col("idx"), i) - 1))

    def normal(i):
        radius = F.sqrt(-2 * F.log(_uniform(seed, F.lit("r"), F.col("idx"), i)))
        z = radius * F.cos(2 * math.pi * _uniform(seed, F.lit("a"), F.col("idx"), i))
        return F.greatest(F.least(z, F.lit(2.0)), F.lit(-2.0)) / math.sqrt(dim)

    sides = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.concat(centers, F.array(F.lit(1.0))).alias("x")),
        F.struct(F.lit(1).alias("side"),
                 F.concat(F.transform(place, normal), F.array(F.lit(0.0))).alias("x"))))
    return words.select(F.col("idx").cast("int").alias("idx")).select("idx", sides.alias("s")).select(
        "s.side", "idx", F.col("s.x").cast("array<float>").alias("x"),
        F.array_repeat(F.lit(ACCUMULATED).cast("float"), dim + 1).alias("acc"))


def log_uniform(n_words: int, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Different word indexes drawn by rank, frequent words (small indexes) more often,
    and the log of the expected number of draws of every index."""
    rng = np.random.default_rng(seed)
    picked = np.minimum(np.exp(rng.random(draws) * math.log(n_words + 1)).astype(np.int64) - 1,
                        n_words - 1)
    ranks = np.arange(n_words)
    share = np.log((ranks + 2) / (ranks + 1)) / math.log(n_words + 1)
    return np.unique(picked), np.log(-np.expm1(draws * np.log1p(-share)))


def _sum_rows(idx: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(idx, kind="stable")
    idx, starts = np.unique(idx[order], return_index=True)
    return idx, np.add.reduceat(g[order], starts, axis=0)


def pair_gradients(c: np.ndarray, o: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray,
                   neg: np.ndarray, z: np.ndarray, log_expected: np.ndarray):
    """Sampled-softmax loss of weighted pairs and its gradients. ``x`` and ``y`` are the rows
    of centers and contexts, ``z`` those of the negatives; the true word of a pair is no
    negative of it. Gives the loss and (side, idx, gradient and mass) parts, summed by
    index."""
    true = (x * y).sum(axis=1) - log_expected[o]
    other = x @ z.T - log_expected[neg]
    other[neg[None, :] == o[:, None]] = -np.inf
    top = np.maximum(true, other.max(axis=1, initial=-np.inf))
    e_true, e_other = np.exp(true - top), np.exp(other - top[:, None])
    total = e_true + e_other.sum(axis=1)
    loss = float((n * (np.log(total) - np.log(e_true))).sum())
    d_true = n * (e_true / total - 1)
    d_other = (n / total)[:, None] * e_other
    gx = d_true[:, None] * y + d_other @ z
    gx[:, -1] = 0  # the constant that meets the bias
    gz = d_other.T @ x
    # a last column of how much each row took part, by which its gradient is divided
    mass = np.concatenate((n, d_other.sum(axis=0)))[:, None]
    idx, g = _sum_rows(np.concatenate((o, neg)),
                       np.hstack((np.concatenate((d_true[:, None] * x, gz)), mass)))
    return loss, [(0, *_sum_rows(c, np.hstack((gx, n[:, None])))), (1, idx, g)]


def _gradient_task(neg: np.ndarray, z: np.ndarray, log_expected: np.ndarray):
    width = z.shape[1]

    def rows(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().astype(np.float64).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(at, ROWS_TOGETHER)
                c, o, n = (part.column(k).to_numpy() for k in ("c", "o", "n"))
                loss, parts = pair_gradients(c, o, n.astype(np.float64), rows(part.column("x")),
                                             rows(part.column("y")), neg, z, log_expected)
                weight = float(n.sum())
                for side, idx, g in parts:
                    ends = np.arange(len(idx) + 1, dtype=np.int32) * (width + 1)
                    extra = np.zeros(len(idx))
                    size = np.zeros(len(idx))
                    if side == 0:  # the batch's loss rides on one of its rows
                        extra[0], size[0] = loss, weight
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(idx), side, dtype=np.int32)),
                        pa.array(idx.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(g.ravel())),
                        pa.array(extra), pa.array(size)], names=["side", "idx", "g", "loss", "n"])

    return run


def train_skipgram(pairs: DataFrame, words: DataFrame, dim: int = 100, steps: int = 20,
                   epochs: int = 1, rate: float = RATE, negatives: int = NEGATIVES,
                   seed: int = 0, spread: float = 1.0) -> tuple[DataFrame, list[float]]:
    """Fit ``(idx, vec array<double>)`` on counted pairs ``(c, o, n)`` over the vocabulary
    ``words(idx)`` whose indexes run from 0 without a gap, most frequent first. Each epoch takes the
    pairs in ``steps`` shares, dealt by a hash. Returns the center vectors and the
    mean loss of every step. The table is checkpointed after each step, so a lost executor
    costs at most one step."""
    spark = pairs.sparkSession
    shared_dir(spark)
    share = F.pmod(F.xxhash64(F.lit(seed), "c", "o"), F.lit(steps)).cast("int")
    # dealt by center once: a word's gradient is summed where its pairs are, whatever the
    # step, and no step moves the pairs (a center has at most a pair for each word)
    dealt = (pairs.withColumn("_share", share).repartition("c")
             .sortWithinPartitions("_share", "c", "o").checkpoint(eager=True))
    state = initial_state(words, dim, seed, spread).checkpoint(eager=True)
    n_words = words.count()
    small = n_words <= BROADCAST_ROWS and n_words * (dim + 1) * 8 <= BROADCAST_BYTES
    side = F.broadcast if small else lambda rows: rows
    losses: list[float] = []
    for step in range(steps * epochs):
        neg, log_expected = log_uniform(n_words, negatives, seed * 1_000_003 + step)
        drawn = {r.idx: r.x for r in state.where((F.col("side") == 1)
                                                 & F.col("idx").isin(neg.tolist())).collect()}
        z = np.array([drawn[i] for i in neg.tolist()], dtype=np.float64)
        batch = dealt.where(F.col("_share") == step % steps).select("c", "o", "n")
        met = (batch.join(side(state.where("side = 0").select(F.col("idx").alias("c"), "x")), "c")
               .join(side(state.where("side = 1").select(F.col("idx").alias("o"),
                                                         F.col("x").alias("y"))), "o"))
        parts = met.select("c", "o", "n", "x", "y").mapInArrow(
            _gradient_task(neg, z, log_expected),
            "side int, idx int, g array<double>, loss double, n double")
        tagged = parts.withColumn("g", F.concat("g", F.array("loss", "n")))
        summed = vector_sum(tagged, ["side", "idx"], "g", dim=dim + 4, out="g")
        g = F.transform(F.slice("g", 1, dim + 1), lambda b: b / F.col("g")[dim + 1])
        acc = F.zip_with("acc", g, lambda a, b: (a + b * b).cast("float"))
        moved = state.join(summed, ["side", "idx"], "left").select(
            "side", "idx", "x", F.coalesce(acc, "acc").alias("acc"), "g")
        slope = F.zip_with(g, "acc", lambda b, a: b / F.sqrt(a))
        x = F.zip_with("x", slope, lambda v, s: (v - rate * s).cast("float"))
        last = moved.select("side", "idx", F.coalesce(x, "x").alias("x"), "acc",
                            F.element_at("g", -2).alias("loss"), F.element_at("g", -1).alias("n"))
        last = last.checkpoint(eager=True)
        total = last.agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
        losses.append(total.loss / total.n if total.n else math.nan)
        state = last.drop("loss", "n")
    vec = F.slice("x", 1, dim).cast("array<double>")
    return state.where("side = 0").select("idx", vec.alias("vec")), losses


def learn_skipgram(docs: DataFrame, doc: str = "article_id", text: str = "text",
                   vocab_size: int = 10000, dim: int = 100, window: int = 1,
                   num_skips: int | None = None, steps: int = 20, epochs: int = 1,
                   rate: float = RATE, negatives: int = NEGATIVES, seed: int = 0,
                   spread: float = 1.0) -> DataFrame:
    """``(word, vec)`` of the ``vocab_size - 1`` most frequent words and of ``UNK``, trained on
    the pairs of whole texts."""
    toks = TX.tokenize(docs.select(doc, text), text, "tokens", "stream")
    shared_dir(docs.sparkSession)
    vocab = TX.vocabulary(TX.word_counts(toks), vocab_size, unk=True).checkpoint(eager=True)
    pairs = word_pairs(toks, vocab, doc, "tokens", window, num_skips, seed)
    vecs, _ = train_skipgram(pairs, vocab.select("idx"), dim, steps, epochs, rate, negatives, seed,
                             spread)
    return vocab.where((F.col("idx") > 0) | (F.col("cnt") > 0)).join(vecs, "idx").select("word", "vec")
