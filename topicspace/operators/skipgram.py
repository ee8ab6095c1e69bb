"""Skip-gram (center, context) pairs for embedding training.

Every document's tokens are one array in one row, so the pairs are built inside
the row with array functions: no shuffle, no window over a giant document, and
windows never cross a document border."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose pairs are counted together, unless one text has more.
WORDS_TOGETHER = 1 << 20


def skipgrams(df: DataFrame, doc: str, tokens: str, window: int = 1,
              num_skips: int | None = None, seed: int = 0, pos: str = "pos",
              center: str = "center", context: str = "context") -> DataFrame:
    """``(doc, pos, center, context)`` for every position and every neighbour
    within ``window`` on either side. With ``num_skips < 2 * window`` each
    position keeps the ``num_skips`` neighbours with the smallest seeded hash
    (repeatable, no driver-side random state)."""
    if window < 1:
        raise ValueError("window must be >= 1")
    toks = F.col(tokens)
    n = F.size(toks)
    if num_skips is None or num_skips >= 2 * window:
        # every neighbour: for each offset o, zip the position sequence with two
        # shifted slices of the token array (built-in array functions only)
        parts = []
        for o in [o for o in range(-window, window + 1) if o != 0]:
            first = max(0, -o)                      # first center position with a neighbour at o
            length = F.greatest(n - abs(o), F.lit(0))
            pos_seq = F.when(length > 0, F.sequence(F.lit(first), F.lit(first) + length - 1))
            zipped = F.arrays_zip(pos_seq.alias(pos),
                                  F.slice(toks, first + 1, length).alias(center),
                                  F.slice(toks, first + o + 1, length).alias(context))
            parts.append(F.coalesce(zipped, F.array().cast(
                f"array<struct<{pos}:int,{center}:string,{context}:string>>")))
        pairs = F.concat(*parts)
    else:
        offsets = F.array(*[F.lit(o) for o in range(-window, window + 1) if o != 0])

        def chosen(i):
            valid = F.filter(offsets, lambda o: (i + o >= 0) & (i + o < n))
            keyed = F.transform(valid, lambda o: F.struct(
                F.xxhash64(F.lit(seed), F.col(doc), i, o).alias("h"), o.alias("o")))
            return F.transform(F.slice(F.array_sort(keyed), 1, num_skips), lambda s: s["o"])

        pairs = F.when(n > 0, F.flatten(F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.transform(chosen(i), lambda o: F.struct(
                i.alias(pos), F.element_at(toks, i + 1).alias(center),
                F.element_at(toks, i + o + 1).alias(context))))))
    # explode_outer + null filter: a plain explode would make Catalyst re-evaluate
    # the pair array in an inferred size() > 0 filter
    return (df.select(doc, F.explode_outer(pairs).alias("_p")).where(F.col("_p").isNotNull())
            .select(doc, F.col("_p")[pos].cast("int").alias(pos), F.col("_p")[center].alias(center),
                    F.col("_p")[context].alias(context)))


def pair_counts(codes: np.ndarray, owner: np.ndarray, window: int,
                n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(center, context, count) of all pairs within ``window`` in texts that lie end to
    end; ``owner`` is the text of each word. A pair and its mirror stand equally often."""
    met = [codes[:-o].astype(np.int64) * n_codes + codes[o:]
           for o in range(1, window + 1)]
    same = [owner[:-o] == owner[o:] for o in range(1, window + 1)]
    pairs, n = np.unique(np.concatenate([m[k] for m, k in zip(met, same)]), return_counts=True)
    a, b = pairs // n_codes, pairs % n_codes
    return np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((n, n))


def skipgram_counts(df: DataFrame, tokens: str, words: pa.Array, idx: np.ndarray,
                    window: int = 1) -> DataFrame:
    """``(c int, o int, n bigint)``: how often each pair of ``skipgrams`` without
    ``num_skips`` stands, as the indexes ``idx`` of ``words`` (0: any other). Each word is
    looked up once, and the pairs of many texts are counted before they leave the task."""
    if window < 1:
        raise ValueError("window must be >= 1")
    index = np.append(idx, 0).astype(np.int64)  # the last is that of any other word
    n_codes = int(index.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column(tokens)), 0)))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS_TOGETHER, "right")) - 1)
                texts = batch.column(tokens).slice(at, stop - at)
                flat = texts.flatten()
                place = pc.fill_null(pc.index_in(flat, value_set=words.cast(flat.type)), len(words))
                owner = np.repeat(np.arange(at, stop), np.diff(ends[at:stop + 1]))
                c, o, n = pair_counts(index[place.to_numpy()], owner, window, n_codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(n)],
                    names=["c", "o", "n"])
                at = stop

    return (df.select(tokens).mapInArrow(run, "c int, o int, n bigint")
            .groupBy("c", "o").agg(F.sum("n").alias("n")))
