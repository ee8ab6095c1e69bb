"""Category operators: one vector per category, distances between category
pairs, names for the pairs, sorting, nearest neighbours and the symmetric
distance matrix."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from topicspace.functions.vectors import metric as metric_fn
from topicspace.operators.common import bounded_broadcast
from topicspace.operators.vectors import vector_dim, vector_sum
from topicspace.session import shared_dir

# Vectors per block in the blocked pair join, and the most vector elements a
# block side may hold (fewer rows per block for long vectors).
BLOCK_ROWS = 256
BLOCK_VALUES = 1 << 23
# A row is sent once for each block: beyond so many blocks their rows grow instead,
# so that what is shuffled stays in proportion to the input.
MAX_BLOCKS = 64
BUCKET_BLOCKS = 16      # the same within a bucket of a projection
TASKS_OF_A_CORE = 8
# Where every pair is given on: blocks for so many block pairs of a core, and no more of
# them, for their number is how often a row is shuffled.
PAIRS_OF_A_CORE = 3
# Elements of the difference array the numpy kernel builds at once (in the cache).
KERNEL_VALUES = 1 << 18
# Pairs whose distances are looked through or given on at once.
KERNEL_PAIRS = 1 << 20


def category_vectors(docs: DataFrame, vec: str, membership: DataFrame | None = None,
                     article: str = "article_id", category: str = "category_id",
                     categories: str | None = None, how: str | Callable = "mean",
                     out: str = "vec", dim: int | None = None) -> DataFrame:
    """One vector per category: the mean (or sum) of the vectors of its articles.

    Articles reach categories through a ``membership`` table (joined on
    ``article``), through an array column ``categories`` of the article row
    (exploded in place, no join), or ``docs`` already has a ``category`` column. ``how`` may be ``'mean'``, ``'sum'`` or a
    callable ``Column -> Column`` aggregate. Partial aggregation runs map-side, so
    a category holding a third of all articles costs one partial row per task.
    ML vectors (``VectorUDT``) are aggregated with ``Summarizer`` and come back as
    ``array<double>``. Give ``dim`` (the vector length) when known: otherwise one
    row of ``docs`` is computed to read it.
    """
    if categories is not None:
        rows = docs.select(F.explode(F.array_distinct(categories)).alias(category), vec)
    elif membership is not None:
        rows = docs.select(article, vec).join(membership.select(article, category).distinct(),
                                              article, "inner")
    elif category in docs.columns:
        rows = docs.select(category, vec)
    else:
        raise ValueError("give membership, categories or a category column")
    if callable(how):
        return rows.groupBy(category).agg(how(F.col(vec)).alias(out))
    if isinstance(docs.schema[vec].dataType, VectorUDT):
        summ = Summarizer.mean(F.col(vec)) if how == "mean" else Summarizer.sum(F.col(vec))
        return (rows.groupBy(category).agg(summ.alias("_v"))
                .select(category, vector_to_array("_v").alias(out)))
    return vector_sum(rows, category, vec, how=how, out=out, dim=dim)


def _block_ids(v: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Rows tagged with the block pairs they belong to: as the lower block
    (``_bi`` = own block, ``_bj`` >= it) and as the upper block."""
    tagged = v.withColumn("_b", F.pmod(F.xxhash64(F.col("_id")), F.lit(blocks)).cast("int"))
    left = tagged.select("_id", "_v", F.col("_b").alias("_bi"),
                         F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1))).alias("_bj"))
    # the right side gets its own column names (fresh attributes): both sides
    # come from the same rows, and shared attributes would confuse a co-group
    right = tagged.select(F.col("_id").alias("_rid"), F.col("_v").alias("_rv"),
                          F.col("_b").alias("_bj"),
                          F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_bi"))
    return left, right


def _block_count(v: DataFrame, most: int | None = None) -> int:
    """Blocks of about ``BLOCK_ROWS`` vectors; at most ``most`` (``MAX_BLOCKS``), of as many
    rows as that takes, while none holds more than ``BLOCK_VALUES`` numbers."""
    found = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("dim")).first()
    n, dim = found["n"], max(1, found["dim"] or 1)
    rows = max(BLOCK_ROWS, math.ceil(n / (most or MAX_BLOCKS)))
    return max(1, math.ceil(n / max(1, min(rows, BLOCK_VALUES // dim))))


def _most_blocks(tasks: int) -> int:
    """The fewest blocks with ``tasks`` block pairs, at most ``MAX_BLOCKS``."""
    return min(MAX_BLOCKS, math.ceil((math.sqrt(1 + 8 * max(1, tasks)) - 1) / 2))


def _vectors(vectors: DataFrame, id: str, vec: str) -> DataFrame:
    """``(_id, _v)`` of the rows that have an id; single precision stays as it is."""
    kind = vectors.schema[vec].dataType.simpleString()
    v = F.col(vec) if kind == "array<float>" else F.col(vec).cast("array<double>")
    return vectors.select(F.col(id).alias("_id"), v.alias("_v")).where(F.col("_id").isNotNull())


def _in_block_pairs(v: DataFrame, blocks: int, task: Callable, schema: str,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Run ``task`` (Arrow batches to Arrow batches) on every pair of blocks of the rows that
    are equal in ``keys``. A row goes once to each pair of blocks that its own (``_own``) is
    in; the pair is (``_bi``, ``_bj``), ``_bi <= _bj``. The partitions are set explicitly,
    so that AQE does not coalesce the small inputs of this CPU-heavy work into a few tasks."""
    spark = v.sparkSession
    own = F.pmod(F.xxhash64(F.col("_id")), F.lit(blocks)).cast("int")
    tagged = v.withColumn("_own", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tagged = tagged.withColumns({"_bi": F.least("_own", "_o"), "_bj": F.greatest("_own", "_o")}).drop("_o")
    by = [*keys, "_bi", "_bj"]
    cap = TASKS_OF_A_CORE * spark.sparkContext.defaultParallelism
    pairs = blocks * (blocks + 1) // 2
    if not keys and pairs <= cap:  # a task for each pair: a hash would put some together
        place = F.expr("cast(_bj * (_bj + 1) / 2 + _bi as int)")
        return (tagged.withColumn("_pair", place).repartitionById(pairs, F.col("_pair")).drop("_pair")
                .mapInArrow(task, schema))
    parts = cap if keys else max(1, min(pairs, cap))
    return tagged.repartition(parts, *by).groupBy(*by).applyInArrow(task, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as one matrix of doubles (a null component: NaN)."""
    column = pa.concat_arrays(column.chunks)
    if column.null_count or len(pa.compute.unique(pa.compute.list_value_length(column))) > 1:
        raise ValueError("vectors must all be there and have the same length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sides(batches: Iterator[pa.RecordBatch]):
    """A block pair: its table, ids and vectors, whether it is one block with itself, and the
    places of the rows of each side."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        none = np.zeros(0, dtype=np.int64)
        return None, none, np.zeros((0, 0)), True, none, none
    t = pa.Table.from_batches(batches)
    ids = t.column("_id").to_numpy()
    x = _matrix(t.column("_v"))
    own, bi, bj = (t.column(c).to_numpy() for c in ("_own", "_bi", "_bj"))
    left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
    return t, ids, x, bool(bi[0] == bj[0]), left, right


def _pair_rows(a, b, d, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(d, pa.float64())],
                                      names=["a", "b", "d"])


def _exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of paired rows."""
    if metric == "cosine":
        den = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        dot = np.einsum("ij,ij->i", a, b)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(den == 0, 1.0, 1.0 - dot / den)
    d = np.einsum("ij,ij->i", a - b, a - b)
    return np.sqrt(d) if metric == "euclidean" else d


def _rough(metric: str, a: np.ndarray, b: np.ndarray):
    """Rough distances by one matrix product, a few left rows at a time: (from, distances
    (squared for Euclidean ones), how far they may be off)."""
    eps = 8 * (a.shape[1] + 8) * np.finfo(np.float64).eps
    step = max(1, KERNEL_PAIRS // max(1, len(b)))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        if metric == "cosine":
            norms = (np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
            a, b = (np.where(n == 0, 0.0, x / n) for x, n in zip((a, b), norms))
            for s in range(0, len(a), step):
                yield s, 1.0 - a[s:s + step] @ b.T, np.full(len(a[s:s + step]), 4 * eps)
            return
        na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        most = np.nanmax(nb, initial=0.0, where=~np.isnan(nb))
        for s in range(0, len(a), step):
            d = a[s:s + step] @ b.T
            d *= -2
            d += nb
            d += na[s:s + step, None]
            yield s, d, eps * (na[s:s + step] + most)


def _pair_pieces(metric: str, within: float | None, li, a, ri, b, same: bool):
    """The distances of a block pair's pairs as (lower ids, higher ids, distances), some
    rows at a time; with ``within`` only those up to it, of which a matrix product finds all
    that may be."""

    def ordered(li, ri, ii, jj, d):
        swap = li[ii] > ri[jj]
        return np.where(swap, ri[jj], li[ii]), np.where(swap, li[ii], ri[jj]), d

    if within is not None:
        limit = within * within if metric == "euclidean" else within
        for s, d, off in _rough(metric, a, b):
            ii, jj = np.nonzero(~(d > limit + off[:, None] + 1e-9 * abs(limit)))
            ii = ii + s
            keep = li[ii] < ri[jj] if same else li[ii] != ri[jj]
            ii, jj = ii[keep.astype(bool)], jj[keep.astype(bool)]
            d = _exact(metric, a[ii], b[jj])
            ok = d <= within
            if ok.any():
                yield ordered(li, ri, ii[ok], jj[ok], d[ok])
        return
    if metric == "cosine":
        den = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    # exact differences, in tiles that bound the temporary array
    step = max(1, min(len(a), KERNEL_PAIRS // len(b)))
    wide = max(1, KERNEL_VALUES // max(1, step * b.shape[1]))
    for s in range(0, len(a), step):
        some = a[s:s + step]
        if metric == "cosine":
            n = np.outer(den[0][s:s + step], den[1])
            with np.errstate(invalid="ignore", divide="ignore"):
                d = np.where(n == 0, 1.0, 1.0 - (some @ b.T) / n)
        else:
            d = np.empty((len(some), len(b)))
            for t in range(0, len(b), wide):
                diff = some[:, None, :] - b[None, t:t + wide, :]
                np.multiply(diff, diff, out=diff)
                diff.sum(axis=-1, out=d[:, t:t + wide])
            d = np.sqrt(d) if metric == "euclidean" else d
        mine = li[s:s + step, None]
        ii, jj = np.nonzero(mine < ri[None, :]) if same else np.nonzero(mine != ri[None, :])
        if len(ii):
            yield ordered(li[s:s + step], ri, ii, jj, d[ii, jj])


def _pairs_task(metric: str, kind: pa.DataType, within: float | None):
    """Arrow function: ``_pair_pieces`` of a block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids, x, same, left, right = _sides(batches)
        if len(left) and len(right):
            for lo, hi, d in _pair_pieces(metric, within, ids[left], x[left], ids[right], x[right], same):
                yield _pair_rows(lo, hi, d, kind)

    return run


def _own_pairs(v: DataFrame, metric: str, within: float | None, schema: str) -> DataFrame:
    """The pairs of rows that fill one block at most, as one co-group."""
    import pandas as pd

    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sides = [(t.iloc[:, 0].to_numpy(), _matrix(pa.chunked_array([pa.array(t.iloc[:, 1])])))
                 for t in (left, right)]
        found = list(_pair_pieces(metric, within, *sides[0], *sides[1], True))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip("abd", zip(*found))} if found
                            else {"a": [], "b": [], "d": []})

    left, right = _block_ids(v, 1)
    return left.groupBy("_bi", "_bj").cogroup(right.groupBy("_bi", "_bj")).applyInPandas(fn, schema)


def pair_distances(vectors: DataFrame, id: str = "category_id", vec: str = "vec",
                   metric: str | Callable[[Column, Column], Column] = "sqeuclidean",
                   blocks: int | None = None, out: str = "distance",
                   id1: str = "cat1", id2: str = "cat2", method: str = "auto",
                   within: float | None = None) -> DataFrame:
    """Distance of every pair with ``id1 < id2`` (the upper triangle); with ``within``, of
    those at most so far apart.

    The output has n(n-1)/2 rows by definition. It is produced by a blocked
    equi-join, never a Cartesian product: ids are hashed into ``B`` blocks,
    every row is sent to the B block pairs it belongs to, and each block pair
    (i <= j) is one key, so the n^2/2 distance work is spread over B(B+1)/2
    groups. ``B`` defaults to ceil(n / r) with r = 256 rows per block, more of them once
    there are ``PAIRS_OF_A_CORE`` block pairs for each core (a row is shuffled B times, so
    what lies on disk is B times the vectors), fewer for long vectors (a block
    side holds at most ``BLOCK_VALUES`` numbers); then the input is
    checkpointed first, as it is read twice.

    ``method='numpy'`` (the default for the built-in metrics) brings the two
    sides of each block pair together and gives on the block's distances a few rows
    at a time, computed with numpy on Arrow batches; ``method='sql'`` (the only one
    for a metric given as a Column function) joins the rows and evaluates the
    metric with Spark SQL array functions.
    """
    custom = callable(metric)
    fn = metric_fn(metric)
    if method == "auto":
        method = "sql" if custom else "numpy"
    v, one = _vectors(vectors, id, vec), False
    if method == "sql":
        v = v.withColumn("_v", F.col("_v").cast("array<double>"))
    if blocks is None:
        # The vectors feed both sides and the block count: write them once to
        # the shared checkpoint folder (one row per category: small) so the
        # upstream work is not redone, and count the saved copy.
        shared_dir(vectors.sparkSession)
        v = v.checkpoint(eager=True)
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        blocks = _block_count(v, _most_blocks(PAIRS_OF_A_CORE * cores) if method == "numpy" else None)
        one = blocks == 1
    if method == "numpy":
        kind = vectors.schema[id].dataType
        schema = f"a {kind.simpleString()}, b {kind.simpleString()}, d double"
        res = _own_pairs(v, metric, within, schema) if one else _in_block_pairs(
            v, blocks, _pairs_task(metric, to_arrow_type(kind), within), schema)
        return res.select(F.col("a").alias(id1), F.col("b").alias(id2), F.col("d").alias(out))
    if method != "sql":
        raise ValueError("method must be 'auto', 'numpy' or 'sql'")
    left, right = _block_ids(v, blocks)
    # One partition per block pair (up to a cap), set explicitly so that AQE does
    # not coalesce the small inputs of this CPU-heavy join into a few tasks.
    spark = vectors.sparkSession
    n_pairs = blocks * (blocks + 1) // 2
    cap = 4 * max(spark.sparkContext.defaultParallelism,
                  int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    parts = max(1, min(n_pairs, cap))
    lt = left.select(F.col("_id").alias("_l"), F.col("_v").alias("_lv"), "_bi", "_bj")
    rt = right.select(F.col("_rid").alias("_r"), "_rv", "_bi", "_bj")
    joined = lt.repartition(parts, "_bi", "_bj").join(rt.repartition(parts, "_bi", "_bj"),
                                                       ["_bi", "_bj"], "inner")
    # same block: both orders meet, keep l < r; different blocks: each pair meets once
    keep = joined.where(((F.col("_bi") < F.col("_bj")) & (F.col("_l") != F.col("_r")))
                        | (F.col("_l") < F.col("_r")))
    lo = F.when(F.col("_l") < F.col("_r"), F.col("_l")).otherwise(F.col("_r"))
    hi = F.when(F.col("_l") < F.col("_r"), F.col("_r")).otherwise(F.col("_l"))
    found = keep.select(lo.alias(id1), hi.alias(id2), fn(F.col("_lv"), F.col("_rv")).alias(out))
    return found if within is None else found.where(F.col(out) <= within)


def name_pairs(distances: DataFrame, names: DataFrame, id: str = "category_id",
               name: str = "name", id1: str = "cat1", id2: str = "cat2",
               out1: str = "name1", out2: str = "name2", default: str = "",
               distance: str = "distance") -> DataFrame:
    """Replace both ids of a pair by names (unknown -> ``default``)."""
    nm = bounded_broadcast(names.select(id, name))
    a = nm.select(F.col(id).alias(id1), F.col(name).alias("_n1"))
    b = nm.select(F.col(id).alias(id2), F.col(name).alias("_n2"))
    res = distances.join(a, id1, "left").join(b, id2, "left")
    return res.select(F.coalesce("_n1", F.lit(default)).alias(out1),
                      F.coalesce("_n2", F.lit(default)).alias(out2), distance)


def sort_distances(distances: DataFrame, distance: str = "distance",
                   ties: Sequence[str] = ("name1", "name2")) -> DataFrame:
    """Ascending by distance (a distributed range sort)."""
    return distances.orderBy(distance, *ties)


def symmetric(distances: DataFrame, a: str = "name1", b: str = "name2",
              distance: str = "distance") -> DataFrame:
    """Both orientations of every pair: ``(a, b, distance)`` and ``(b, a, distance)``, from
    one reading of the pairs."""
    ways = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")),
                   F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    return distances.select(F.explode(ways).alias("_w"), distance).select(
        F.col("_w.a").alias(a), F.col("_w.b").alias(b), distance)


def symmetric_distances(distances: DataFrame, names: DataFrame, a: str = "name1",
                        b: str = "name2", distance: str = "distance", fill: float = 0.0,
                        name: str = "name") -> DataFrame:
    """The symmetric matrix in long form for any number of labels: every pair both
    ways, and each of ``names`` with itself at ``fill``."""
    own = names.select(F.col(name).alias(a), F.col(name).alias(b), F.lit(fill).alias(distance))
    return symmetric(distances, a, b, distance).unionByName(own)


def nearest(distances: DataFrame, k: int, a: str = "name1", b: str = "name2",
            distance: str = "distance", rank: str = "rank") -> DataFrame:
    """The ``k`` nearest other categories of every category, ranked 1..k
    (distance, then name). Each task keeps the k best rows it has of a category
    before they are shuffled (a group limit under the window), so the window gets at
    most k rows of a category from each."""
    sym = symmetric(distances, a, b, distance)
    w = Window.partitionBy(a).orderBy(F.col(distance).asc(), F.col(b).asc())
    return sym.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _fewest(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the ``k`` nearest of any other: of equal vectors, those with the
    ``k + 1`` smallest ids (one of them may be the row that asks)."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
                        if x.shape[1] else np.zeros(len(x)), return_inverse=True)
    _, place = np.unique(ids, return_inverse=True)
    by = np.lexsort((place, same))
    same, place = same[by], place[by]
    first = np.r_[True, same[1:] != same[:-1]]
    new = np.cumsum(first | np.r_[True, place[1:] != place[:-1]])
    start = np.maximum.accumulate(np.where(first, new, 0))
    return np.sort(by[new - start <= k])


def _numpy_block_nearest(metric: str, k: int):
    """Of each row its ``k`` nearest of the other side (and the other way round). A matrix
    product gives rough distances; rows that may be among the k nearest by these, as far as
    they can be off, are compared exactly."""
    import pandas as pd

    def one_way(li, a, ri, b):
        some = _fewest(ri, b, k)
        ri, b = ri[some], b[some]
        _, place = np.unique(np.concatenate((li, ri)), return_inverse=True)
        mine, other, out = place[:len(li)], place[len(li):], []
        for s, d, off in _rough(metric, a, b):
            own = mine[s:s + len(d), None] == other[None, :]
            d[np.isnan(d)] = np.inf
            d[own] = np.inf
            at = min(k, len(b)) - 1
            kth = np.partition(d, at, axis=1)[:, at]
            ii, jj = np.nonzero((d <= (kth + 2 * off)[:, None]) & ~own)
            ii = ii + s
            part = pd.DataFrame({"a": li[ii], "b": ri[jj], "d": _exact(metric, a[ii], b[jj]), "i": ii})
            part = part.sort_values(["i", "d", "b"], kind="stable")
            out.append(part[part.groupby("i", sort=False).cumcount() < k][["a", "b", "d"]])
        return pd.concat(out)

    def both(li, a, ri, b, same: bool):
        return pd.concat([one_way(li, a, ri, b)] if same
                         else [one_way(li, a, ri, b), one_way(ri, b, li, a)])

    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "d": []})
        return both(left["_id"].to_numpy(), np.stack(left["_v"].to_numpy()).astype(np.float64),
                    right["_rid"].to_numpy(), np.stack(right["_rv"].to_numpy()).astype(np.float64),
                    left["_bi"].iloc[0] == left["_bj"].iloc[0])

    fn.both = both
    return fn


def _nearest_task(metric: str, k: int, kind: pa.DataType):
    """Arrow function: ``_numpy_block_nearest`` on a block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids, x, same, left, right = _sides(batches)
        if len(left) and len(right):
            found = _numpy_block_nearest(metric, k).both(ids[left], x[left], ids[right], x[right], same)
            yield _pair_rows(found["a"].to_numpy(), found["b"].to_numpy(), found["d"].to_numpy(), kind)

    return run


def nearest_vectors(vectors: DataFrame, k: int, id: str = "category_id", vec: str = "vec",
                    metric: str = "sqeuclidean", id1: str = "cat1", id2: str = "cat2",
                    out: str = "distance", rank: str = "rank") -> DataFrame:
    """The ``k`` nearest other vectors of every vector, ranked 1..k (distance, then id),
    without the table of all distances: every pair of blocks is one group, whose kernel
    compares exactly only rows that a matrix product leaves and gives on the k best of each
    row. A window ranks the at most ``k`` x blocks rows of each vector."""
    if metric not in ("sqeuclidean", "euclidean", "cosine"):
        raise ValueError("metric must be 'sqeuclidean', 'euclidean' or 'cosine'")
    shared_dir(vectors.sparkSession)
    v = _vectors(vectors, id, vec).checkpoint(eager=True)
    kind = vectors.schema[id].dataType
    best = _in_block_pairs(v, _block_count(v), _nearest_task(metric, k, to_arrow_type(kind)),
                           f"a {kind.simpleString()}, b {kind.simpleString()}, d double")
    w = Window.partitionBy("a").orderBy("d", "b")
    return (best.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
            .select(F.col("a").alias(id1), F.col("b").alias(id2), F.col("d").alias(out), rank))


def _bucket_task(within: float, kind: pa.DataType):
    """Arrow function: pairs of a bucket's block pair at most ``within`` apart, lower id
    first, given by the first projection only in which they share a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, ids, x, same, left, right = _sides(batches)
        if not len(left) or not len(right):
            return
        h = _matrix(t.column("_h"))[:, :t.column("_t")[0].as_py()]
        a, b = x[left], x[right]
        for s, d, off in _rough("euclidean", a, b):
            ii, jj = np.nonzero(d <= within * within * (1 + 1e-9) + off[:, None])
            l, r = left[ii + s], right[jj]
            keep = (ids[l] < ids[r] if same else ids[l] != ids[r]).astype(bool)
            l, r = l[keep], r[keep]
            new = ~(h[l] == h[r]).any(axis=1)
            l, r = l[new], r[new]
            d = _exact("euclidean", x[l], x[r])
            l, r, d = l[d <= within], r[d <= within], d[d <= within]
            if len(d):
                swap = ids[l] > ids[r]
                yield _pair_rows(np.where(swap, ids[r], ids[l]), np.where(swap, ids[l], ids[r]), d, kind)

    return run


def close_pairs(vectors: DataFrame, within: float, id: str = "category_id", vec: str = "vec",
                bucket_length: float | None = None, tables: int = 4, seed: int = 0,
                id1: str = "cat1", id2: str = "cat2", out: str = "distance") -> DataFrame:
    """Pairs at a Euclidean distance of at most ``within``, by bucketed random projections:
    rows that share a bucket of a projection are compared, so the distances are exact and
    the pairs nearly all there (more ``tables`` find more). A bucket is by default four
    times as wide as the projection of such a pair's difference is expected to be. Large
    buckets are met block by block, and of a pair that shares several, one gives it."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    dim = max(1, vector_dim(vectors, vec))
    shared_dir(vectors.sparkSession)
    rows = _vectors(vectors, id, vec).checkpoint(eager=True)
    dense = rows.select("_id", "_v", array_to_vector(F.col("_v").cast("array<double>")).alias("_d"))
    lsh = BucketedRandomProjectionLSH(inputCol="_d", outputCol="_h", numHashTables=tables, seed=seed,
                                      bucketLength=bucket_length or 4.0 * within / math.sqrt(dim))
    model = lsh.fit(dense)
    hashed = model.transform(dense).select("_id", "_v", F.transform(
        "_h", lambda h: vector_to_array(h)[0]).alias("_h"))
    by_table = hashed.select("*", F.posexplode("_h").alias("_t", "_bucket"))
    kind = vectors.schema[id].dataType
    found = _in_block_pairs(by_table, _block_count(rows, BUCKET_BLOCKS),
                            _bucket_task(within, to_arrow_type(kind)),
                            f"a {kind.simpleString()}, b {kind.simpleString()}, d double", ["_t", "_bucket"])
    return found.select(F.col("a").alias(id1), F.col("b").alias(id2), F.col("d").alias(out))


def distance_matrix(distances: DataFrame, labels: Sequence[str], a: str = "name1",
                    b: str = "name2", distance: str = "distance", fill: float = 0.0,
                    row: str = "name") -> DataFrame:
    """Symmetric matrix over a fixed label list: one row per label, one column
    per label; missing pairs and the diagonal are ``fill``."""
    labels = list(labels)
    sym = symmetric(distances, a, b, distance).where(F.col(a).isin(labels) & F.col(b).isin(labels))
    piv = sym.groupBy(F.col(a).alias(row)).pivot(b, labels).agg(F.first(distance))
    spark = distances.sparkSession
    all_rows = spark.createDataFrame([(x,) for x in labels], f"{row} string")
    res = all_rows.join(piv, row, "left")
    return res.select(row, *[F.coalesce(F.col(f"`{x}`"), F.lit(fill)).alias(x) for x in labels])
