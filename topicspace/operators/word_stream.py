"""Skip-gram windows over the running word stream: the texts in key order as one
sequence of words, so that windows go on from one text into the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspace.session import shared_dir

#: Words whose pairs are made at a time, to bound a task's memory.
WORDS_TOGETHER = 1 << 16
_EDGES = "part int, n bigint, first array<string>, last array<string>"


def _pieces(batches: Iterator[pa.RecordBatch], tokens: str) -> Iterator[pa.Array]:
    """The words of a partition in order, at most ``WORDS_TOGETHER`` at a time, as Arrow
    strings (no Python object for a word)."""
    for batch in batches:
        words = batch.column(tokens).flatten().cast(pa.string())
        for at in range(0, len(words), WORDS_TOGETHER):
            yield words[at:at + WORDS_TOGETHER]


def _edge_task(tokens: str, window: int):
    """Arrow function: a partition's number of words, its first and its last few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last = 0, [], []
        for words in _pieces(batches, tokens):
            n += len(words)
            if len(first) < window:
                first = (first + words[:window].to_pylist())[:window]
            last = (last + words[max(0, len(words) - window):].to_pylist())[-window:]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64()),
            "first": pa.array([first], pa.list_(pa.string())),
            "last": pa.array([last], pa.list_(pa.string()))})

    return run


def _pair_task(tokens: str, window: int, halos: dict[int, tuple[int, list[str], list[str]]]):
    """Arrow function: the pairs whose center is in the partition, with the words that
    stand before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, after = halos[TaskContext.get().partitionId()]
        held = pa.array(before, pa.string())   # words whose pairs are done, then words that wait
        done = len(before)

        def give(stop: int) -> Iterator[pa.RecordBatch]:
            """Pairs of the waiting words up to place ``stop`` of ``held``."""
            for o in (*range(-window, 0), *range(1, window + 1)):
                lo, hi = max(done, -o), min(stop, len(held) - o)
                if lo < hi:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.arange(at + lo - done, at + hi - done, dtype=np.int64)),
                        held[lo:hi], held[lo + o:hi + o]], names=["pos", "center", "context"])

        for words in _pieces(batches, tokens):
            held = pa.concat_arrays([held, words])
            stop = max(done, len(held) - window)  # later words lack what follows them
            if stop > done:
                yield from give(stop)
                at += stop - done
                held = held[max(0, stop - window):]
                done = min(stop, window)
        stop = len(held)
        held = pa.concat_arrays([held, pa.array(after, pa.string())])
        yield from give(stop)

    return run


def stream_skipgrams(docs: DataFrame, key: str, tokens: str, window: int = 1,
                     text_order: list | None = None) -> DataFrame:
    """``(pos bigint, center, context)`` for every word of the stream and every neighbour
    within ``window`` on either side; ``pos`` counts words from 0 over all texts in the order
    of ``key`` (``text_order``: further columns for equal keys).

    The texts are sorted by range and saved. Every partition tells its number of words, its
    first and its last ``window`` ones (a few words for each partition are all that the driver
    sees), and then gets its place in the stream and the words that border on it."""
    if window < 1:
        raise ValueError("window must be >= 1")
    spark = docs.sparkSession
    shared_dir(spark)
    order = [F.col(key), *(text_order or [])]
    ordered = (docs.select(key, tokens, *(text_order or [])).orderBy(*order)
               .select(tokens).checkpoint(eager=True))
    edges = sorted(ordered.mapInArrow(_edge_task(tokens, window), _EDGES).collect(),
                   key=lambda r: r.part)
    halos: dict[int, tuple[int, list[str], list[str]]] = {}
    at, before = 0, []
    for e in edges:
        halos[e.part] = (at, list(before), [])
        at, before = at + e.n, (before + e.last)[-window:]
    after: list[str] = []
    for e in reversed(edges):
        halos[e.part] = (*halos[e.part][:2], list(after))
        after = (e.first + after)[:window] if e.n < window else e.first
    return ordered.mapInArrow(_pair_task(tokens, window, halos),
                              "pos bigint, center string, context string")
