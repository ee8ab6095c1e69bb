"""Vector operators over ``array<float|double>`` columns: grouped element-wise
sums and means, document vectors from word vectors, L2 normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspace.functions import vectors as V
from topicspace.operators.common import bounded_broadcast


def vector_dim(df: DataFrame, vec: str) -> int:
    """Length of the vectors in ``vec`` (read from one row)."""
    row = df.where(F.col(vec).isNotNull()).select(F.size(vec).alias("n")).head()
    return int(row["n"]) if row else 0


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def vector_sum(df: DataFrame, keys: str | Sequence[str], vec: str, how: str = "sum",
               dim: int | None = None, weight: str | None = None, out: str = "vec",
               count: str | None = None) -> DataFrame:
    """Element-wise sum or mean of the vectors of each group: ``(keys..., out)``.

    One generated hash aggregate with one ``sum`` per dimension: partial sums
    are taken map-side, so a group holding a third of all rows still sends one
    partial row per task through the shuffle. ``weight`` multiplies each vector
    first (a mean is then weighted). ``count`` also returns the number (or
    weight) of vectors in the group. A null vector counts for nothing, as in SQL's
    ``sum`` and ``avg`` (a group of nulls gives null); a vector of another length
    than ``dim`` fails the query.
    The aggregate is written as one SQL statement over ``df`` so that building
    it costs one call, not one per dimension.
    """
    if how not in ("sum", "mean"):
        raise ValueError("how must be 'sum' or 'mean'")
    keys = [keys] if isinstance(keys, str) else list(keys)
    d = vector_dim(df, vec) if dim is None else dim
    w = " * _w" if weight else ""
    n = "sum(CASE WHEN _x IS NOT NULL THEN _w END)" if weight else "count(_x)"
    ks = ", ".join(_q(k) for k in keys)
    sums = "".join(f"sum(CAST(_x[{i}] AS DOUBLE){w}) AS _s{i}, " for i in range(d))
    div = " / _n" if how == "mean" else ""
    arr = ", ".join(f"_s{i}{div}" for i in range(d))
    cnt = f", CAST(coalesce(_n, 0) AS BIGINT) AS {_q(count)}" if count else ""
    checked = (f"CASE WHEN {_q(vec)} IS NULL OR size({_q(vec)}) = {d} THEN {_q(vec)} ELSE "
               f"raise_error('a vector has another length than {d}') END AS _x")
    weighted = f", CAST({_q(weight)} AS DOUBLE) AS _w" if weight else ""
    whole = f"CASE WHEN coalesce(_n, 0) <> 0 THEN array({arr}) END" if how == "mean" else (
        f"CASE WHEN _any THEN array({arr}) END")
    sql = (f"SELECT {ks}, {whole} AS {_q(out)}{cnt} FROM "
           f"(SELECT {ks}, {sums}{n} AS _n, max(_x IS NOT NULL) AS _any FROM "
           f"(SELECT {ks}, {checked}{weighted} FROM {{src}}) GROUP BY {ks})")
    return df.sparkSession.sql(sql, src=df)


def document_vectors(encoded: DataFrame, word_vectors: DataFrame, doc: str = "doc_id",
                     idx: str = "idx", vec: str = "vec", how: str = "sum",
                     out: str = "vec", dim: int | None = None,
                     keys: list[str] | None = None) -> DataFrame:
    """Document vector = element-wise sum (or mean) of the vectors of its words.

    Every word position is looked up in the word-vector table (broadcast after a size
    check) and the vectors are summed per document in one aggregate: a document's
    positions come from one input row, so the map-side partial sums already hold whole
    documents and the shuffle carries one row per document. (Counting (document, word)
    first was measured slower: few words repeat within a document.) A word without a vector adds nothing (a
    zero vector); a document with no vector at all gives no row. ``keys`` are more
    document columns to keep (grouped with ``doc``). ``how='mean'`` divides by
    the number of positions that have a vector.
    """
    wv = bounded_broadcast(word_vectors.select(idx, vec))
    d = vector_dim(word_vectors, vec) if dim is None else dim
    joined = encoded.select(doc, idx, *(keys or [])).join(wv, idx, "inner")
    return vector_sum(joined, [doc, *(keys or [])], vec, how=how, dim=d, out=out)


def vectorize(sequences: DataFrame, word_vectors: DataFrame, dim: int, doc: str = "doc_id",
              seq: str = "seq", idx: str = "idx", vec: str = "vec",
              pos: str = "pos") -> DataFrame:
    """Index sequence -> vector sequence, one row per position:
    ``(doc, pos, vec array<float>)``. An index without a vector (padding 0,
    unknown words) gets the zero vector, so the sequence keeps its length."""
    wv = bounded_broadcast(word_vectors.select(idx, F.col(vec).cast("array<float>").alias("_wv")))
    ex = sequences.select(doc, F.posexplode_outer(seq).alias(pos, idx)).where(F.col(pos).isNotNull())
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (ex.join(wv, idx, "left")
            .select(doc, pos, F.coalesce(F.col("_wv"), zero).alias(vec)))


def l2_normalize(df: DataFrame, vec: str, out: str | None = None) -> DataFrame:
    """Divide each vector by its L2 norm; a zero vector stays zero."""
    return (df.withColumn("_norm", V.norm(vec))
            .withColumn(out or vec, V.l2_normalize(vec, "_norm"))
            .drop("_norm"))
