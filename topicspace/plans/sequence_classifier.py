"""Text classification on word-vector sequences (C4, C5): mini-batch Adagrad over a
convolutional network, distributed.

Texts become sequences of ``length`` vocabulary indexes (M4), written once, dealt to
mini-batches by the key's hash. Every step computes the gradient of one mini-batch: a
task sums the gradients of its rows, groups of tasks sum theirs (a tree of two
levels, always in the same order, so a repeated run gives the same model), and the driver
makes the Adagrad step on the one sum it gets. What passes through the driver is the
model and a few gradients of its size, whatever the number of rows. After every epoch the
state is written, the validation part is scored, and a run that is started again goes on
from the last whole epoch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspace.functions.convnet import ConvNet, adagrad
from topicspace.operators import text as TX
from topicspace.operators.sampling import hash_split, key_hash
from topicspace.plans.materialize import _fs_exists
from topicspace.session import shared_dir

# The original trainer's settings.
RATE, DECAY = 0.01, 0.0002
LENGTH, EPOCHS = 1000, 10
#: Places of sequences put through the network at a time, to bound a task's memory.
PLACES_TOGETHER = 1 << 14
STATE = "epoch int, step int, params binary, acc binary, loss double, accuracy double, n bigint"


@dataclass
class Sequences:
    """What turns texts into network input: the vocabulary, the word vectors (row ``i``
    for index ``i``, row 0 zeros for padding) and the sequence length."""

    vocab: DataFrame
    vectors: np.ndarray
    length: int = LENGTH
    min_len: int = 3

    def of(self, docs: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
        """``(key, carry..., seq)``: the first ``length`` vocabulary words of each text
        as indexes, padded with 0 at the end; a text without any is all padding. The rows of
        a key (one for each label) have one sequence, in which a word stands as often as its
        place has it in all of them; a text that several have is taken apart once."""
        texts = docs.groupBy(key, text).agg(F.count(F.lit(1)).cast("int").alias("_n"))
        toks = TX.tokenize(texts, text, "tokens", "words", self.min_len)
        enc = TX.encode(toks, key, "tokens", self.vocab, oov="drop", carry=["_n"])
        seqs = TX.index_sequences(enc, key, times="_n")
        joined = docs.select(key, *carry).join(seqs, key, "left").withColumn(
            "seq", F.coalesce("seq", F.array().cast("array<int>")))
        return TX.pad(joined, "seq", self.length, "post").select(key, *carry, "seq")


def vector_table(word_vectors: DataFrame, vocab: DataFrame, dim: int, idx: str = "idx",
                 vec: str = "vec") -> np.ndarray:
    """The vectors of the vocabulary as one matrix on the driver. Its size is bounded by
    the vocabulary's cap, never by the corpus; an index without a vector has zeros."""
    rows = word_vectors.join(vocab.select(idx), idx).select(idx, vec).toLocalIterator()
    found = {r[idx]: r[vec] for r in rows if r[idx] > 0}
    top = vocab.agg(F.max(idx)).first()[0] or 0
    table = np.zeros((top + 1, dim), dtype=np.float32)
    for i, v in found.items():
        table[i] = v
    return table


def _batches(batch: pa.RecordBatch, net: ConvNet) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A few sequences of like length at a time, without the padding that does not count:
    (sequences, the rows that have them, the sequence of each row). Rows of one text stand
    together (one for each of its labels) and have one sequence."""
    seqs = batch.column("seq").flatten().to_numpy().reshape(batch.num_rows, -1)
    start = np.flatnonzero(np.r_[True, (seqs[1:] != seqs[:-1]).any(axis=1)])
    count = np.diff(np.r_[start, len(seqs)])
    seqs = seqs[start]
    filled = np.where(seqs.any(axis=1), seqs.shape[1] - (seqs[:, ::-1] != 0).argmax(axis=1), 0)
    order = np.argsort(filled, kind="stable")
    sizes, back = np.unique(filled[order], return_inverse=True)
    need = np.array([net.needed(int(f)) for f in sizes])[back]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * need[end] <= PLACES_TOGETHER:
            end += 1
        some = order[at:end]
        n = count[some]
        of = np.repeat(np.arange(len(some)), n)
        rows = np.arange(len(of)) + np.repeat(start[some] - (np.cumsum(n) - n), n)
        yield seqs[some, :need[end - 1]].astype(np.intp), rows, of
        at = end


def _gradient_task(net: ConvNet, shared):
    """Arrow function: the summed gradient of a partition's rows, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, vectors = shared.value
        shaped = net.shaped(params)
        table = net.table(shaped, vectors)
        words = np.zeros((net.kernel, len(vectors), net.channels))
        met = np.zeros(len(vectors), dtype=bool)
        total, loss, n = None, 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column("label").to_numpy().astype(np.int64) - 1
            for seqs, rows, of in _batches(batch, net):
                met[seqs] = True
                own, grads = net.gradient(shaped, seqs, labels[rows], of, table, words)
                flat = net.flat(grads).astype(np.float64)
                total = flat if total is None else total + flat
                loss, n = loss + own, n + len(rows)
        if total is not None:
            first = net.first(vectors, words, met).ravel()
            total[:len(first)] += first
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "g": pa.array([total.tobytes()], pa.binary()), "loss": [loss],
                "n": pa.array([n], pa.int64())})

    return run


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of a partition's gradient rows, which come sorted by part."""
    total, loss, n, first = None, 0.0, 0, None
    for batch in batches:
        for row in batch.to_pylist():
            g = np.frombuffer(row["g"])
            total = g.copy() if total is None else total + g
            first = row["part"] if first is None else first
            loss, n = loss + row["loss"], n + row["n"]
    if total is not None:
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([first], pa.int32()), "g": pa.array([total.tobytes()], pa.binary()),
            "loss": [loss], "n": pa.array([n], pa.int64())})


def mean_gradient(rows: DataFrame, net: ConvNet, params: np.ndarray,
                  vectors: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Mean gradient, mean loss and number of ``rows(label, seq)``, by a tree: about the
    square root of the tasks sum the others' rows, and the driver sums theirs."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((params, vectors))
    schema = "part int, g binary, loss double, n bigint"
    leaves = rows.select("label", "seq").mapInArrow(_gradient_task(net, shared), schema)
    branches = max(1, math.isqrt(max(1, rows.rdd.getNumPartitions())))
    if branches > 1:
        leaves = (leaves.withColumn("_b", F.col("part") % branches)
                  .repartitionById(branches, F.col("_b")).drop("_b")
                  .sortWithinPartitions("part").mapInArrow(_sum_task, schema))
    found = sorted(leaves.collect(), key=lambda r: r.part)
    shared.unpersist()
    n = sum(r.n for r in found)
    if not n:
        return np.zeros(len(params)), math.nan, 0
    return (sum(np.frombuffer(r.g) for r in found) / n, sum(r.loss for r in found) / n, n)


@dataclass
class SequenceModel:
    """A trained network and what scores texts with it."""

    net: ConvNet
    params: np.ndarray
    sequences: Sequences
    history: list[dict] = field(default_factory=list)

    def score(self, rows: DataFrame, key: str, label: str = "label") -> DataFrame:
        """``(key, label, prediction, scores)`` of sequence rows; scores are the class
        probabilities as an array of ``struct(label, score)``, labels from 1."""
        net, spark = self.net, rows.sparkSession
        shared = spark.sparkContext.broadcast((self.params, self.sequences.vectors))
        kind = rows.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            params, vectors = shared.value
            shaped = net.shaped(params)
            table = net.table(shaped, vectors)
            for batch in batches:
                if not batch.num_rows:
                    continue
                p = np.empty((batch.num_rows, net.classes))
                for seqs, at, of in _batches(batch, net):
                    p[at] = np.exp(net.forward(shaped, seqs, table=table))[of]
                ends = np.arange(len(p) + 1, dtype=np.int32) * net.classes
                yield pa.RecordBatch.from_arrays([
                    batch.column("key"), batch.column("label"),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel()))],
                    names=["key", "label", "p"])

        out = rows.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"), "seq") \
            .mapInArrow(run, f"key {kind}, label double, p array<double>")
        scores = F.transform("p", lambda p, i: F.struct((i + 1).cast("double").alias("label"),
                                                        p.alias("score")))
        best = F.array_position("p", F.array_max("p")).cast("double")
        return out.select(F.col("key").alias(key), F.col("label").alias(label),
                          best.alias("prediction"), scores.alias("scores"))

    def predict(self, docs: DataFrame, key: str = "article_id", text: str = "content",
                label: str = "label") -> DataFrame:
        return self.score(self.sequences.of(docs, key, text, [label]), key, label)


def topk_of_scores(scored: DataFrame, k: int, label: str = "label") -> DataFrame:
    from topicspace.plans.classify import evaluate_topk
    return evaluate_topk(scored, k, label)


def _saved_epochs(spark: SparkSession, path: str) -> list[int]:
    """The whole epochs below ``path``."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(f[6:]) for f in found if f.startswith("epoch-")
                  and _fs_exists(spark, f"{path}/{f}/_SUCCESS"))


def train(docs: DataFrame, sequences: Sequences, classes: int, path: str, key: str = "article_id",
          text: str = "content", label: str = "label", weights=(0.8, 0.1, 0.1), epochs: int = EPOCHS,
          batches: int = 8, rate: float = RATE, decay: float = DECAY, top_k: int = 5, seed: int = 0,
          **layers) -> SequenceModel:
    """Train on the first part of ``docs`` (split by the key's hash), scoring the second
    after every epoch; labels run from 1 to ``classes``.

    Everything is kept below ``path``: the sequences, dealt to ``batches`` mini-batches, and
    the state after each epoch. A call with the same ``path`` goes on after its last
    whole epoch, so a job that was cut off loses at most one epoch. ``layers`` are sizes
    of ``ConvNet``."""
    spark = docs.sparkSession
    shared_dir(spark)
    net = ConvNet(sequences.vectors.shape[1], classes, sequences.length, **layers)
    data = f"{path}/sequences"
    if not _fs_exists(spark, f"{data}/_SUCCESS"):
        rows = hash_split(sequences.of(docs, key, text, [label]), key, weights, "part")
        rows = rows.where("part < 2").withColumn(
            "batch", F.when(F.col("part") == 0, F.pmod(key_hash(F.concat_ws(
                ":", F.lit(str(seed)), F.col(key).cast("string"))), F.lit(batches)))
            .otherwise(-1).cast("int"))
        (rows.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), "seq", "batch")
         .repartition("batch", "key").sortWithinPartitions("batch", "key", "label")
         .write.mode("overwrite").partitionBy("batch").parquet(data))
    saved = spark.read.schema("key string, label int, seq array<int>, batch int").parquet(data) \
        .drop("key")
    done = _saved_epochs(spark, path)
    history, step = [], 0
    params = net.flat(net.initial(seed)).astype(np.float64)
    acc = np.zeros(len(params))
    for epoch in done:
        row = spark.read.schema(STATE).parquet(f"{path}/epoch-{epoch}").first()
        history.append({k: row[k] for k in ("epoch", "loss", "accuracy", "n")})
        params, acc, step = np.frombuffer(row.params), np.frombuffer(row.acc), row.step
    model = SequenceModel(net, params.astype(np.float32), sequences, history)
    for epoch in range(done[-1] + 1 if done else 0, epochs):
        order = np.random.default_rng([seed, epoch]).permutation(batches)
        losses = []
        for b in order.tolist():
            g, loss, n = mean_gradient(saved.where(F.col("batch") == b), net,
                                       params.astype(np.float32), sequences.vectors)
            if n:
                params, acc = adagrad(params, g, acc, step, rate, decay)
                losses.append(loss)
            step += 1
        model.params = params.astype(np.float32)
        held = saved.where(F.col("batch") == -1).withColumn("key", F.lit(0))
        valid = topk_of_scores(model.score(held, "key"), top_k).first()
        state = (epoch, step, params.tobytes(), acc.tobytes(),
                 float(np.mean(losses)) if losses else None, valid.accuracy, valid.n)
        spark.createDataFrame([state], STATE).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/epoch-{epoch}")
        history.append({"epoch": epoch, "loss": state[4], "accuracy": valid.accuracy, "n": valid.n})
    return model


def load(spark: SparkSession, path: str, sequences: Sequences, classes: int,
         **layers) -> SequenceModel:
    """The model after the last whole epoch below ``path``."""
    done = _saved_epochs(spark, path)
    if not done:
        raise FileNotFoundError(f"no trained epoch below {path}")
    net = ConvNet(sequences.vectors.shape[1], classes, sequences.length, **layers)
    row = spark.read.schema(STATE).parquet(f"{path}/epoch-{done[-1]}").first()
    return SequenceModel(net, np.frombuffer(row.params).astype(np.float32), sequences)
