"""Nearest neighbours by a forest of hash-prefix trees.

Every tree gives a vector a long string of bits (the sides of random hyperplanes); the
strings of a block's vectors lie in a sorted array, in which the rows that share a
prefix with a query are one run. A query descends in all trees to its longest prefix
matches and then ascends in all of them together, level by level, until enough
candidates share its prefix in some tree; exact cosines rank them.

How many candidates are enough is fitted: on a bounded sample the share of rows that
holds the true neighbours is measured against brute force. Rows are dealt to blocks, and
every query goes through the forest of every block of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicspace.llm.common import materialize, read_table

TREES = 24
BITS = 64
SEED = 41
NEIGHBOURS = 5
#: Rows of a block, at most on average; small tables get up to SMALL_BLOCKS blocks of
#: SMALL_ROWS rows, so that several tasks share the work.
BLOCK_ROWS = 1 << 17
SMALL_BLOCKS, SMALL_ROWS = 8, 2048
#: Queries that go through a forest together.
QUERIES_TOGETHER = 1024
#: Vector lengths, most frequent first, for which the candidates' share is fitted.
FITTED_LENGTHS = 8
#: The sample on which the candidates' share is fitted, and its queries.
SAMPLE_ROWS, SAMPLE_QUERIES = 8192, 200
#: Hashes that order the sample, and how many times the sample is looked through for it.
HASHES, SPARE = 1 << 40, 4
#: Share of the sample's true neighbours that the candidates hold.
RECALL = 0.97
MIN_CANDIDATES = 64


def hash_strings(x: np.ndarray, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    """(trees, rows) bit strings of the rows of ``x`` as unsigned 64-bit integers."""
    planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((x.shape[1], trees * BITS))
    out = np.empty((trees, len(x)), dtype=np.uint64)
    for at in range(0, len(x), 4096):
        side = (x[at:at + 4096] @ planes) > 0
        bits = np.packbits(side.reshape(-1, trees, BITS), axis=2, bitorder="big")
        out[:, at:at + 4096] = bits.reshape(-1, trees, BITS // 8).view(">u8")[..., 0].T
    return out


class PrefixForest:
    """Sorted arrays of hash strings over the rows of a block."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.rows, self.trees, self.seed = len(x), trees, seed
        strings = hash_strings(x, trees, seed)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def runs(self, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) first and last + 1 of the run that shares ``level`` bits."""
        low = np.uint64((1 << BITS) - 1 >> level) if level < BITS else np.uint64(0)
        first = np.stack([np.searchsorted(s, q & ~low) for s, q in zip(self.sorted, strings)])
        last = np.stack([np.searchsorted(s, q | low, side="right")
                         for s, q in zip(self.sorted, strings)])
        return first, last

    def candidates(self, queries: np.ndarray, enough: int):
        """Rows for each query: all that share the longest prefix, in any tree, at which
        at least ``enough`` rows do (or all rows)."""
        strings = hash_strings(queries, self.trees, self.seed)
        open_ = np.arange(len(queries))
        mark = np.empty(self.rows, dtype=bool)
        for level in range(BITS, -1, -1):
            if not len(open_):
                return
            first, last = self.runs(strings[:, open_], level)
            left = []
            for i in np.arange(len(open_)):
                if (last[:, i] - first[:, i]).sum() < min(enough, self.rows) and level:
                    left.append(open_[i])
                    continue
                mark[:] = False
                for order, a, b in zip(self.order, first[:, i], last[:, i]):
                    mark[order[a:b]] = True
                found = np.flatnonzero(mark)
                if len(found) < min(enough, self.rows) and level:
                    left.append(open_[i])
                else:
                    yield int(open_[i]), found
            open_ = np.array(left, dtype=np.int64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: their cosines are the
    same to the last bit, and no square of a component overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of ``q`` with each row (both scaled): sums run in one order for every row, so
    equal vectors have equal scores."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def fit_share(sample: np.ndarray, k: int, trees: int = TREES, seed: int = SEED,
              recall: float = RECALL) -> float:
    """Smallest share of the rows that, taken by falling prefix length, holds ``recall``
    of the ``k`` true neighbours of the sample's first rows."""
    n = len(sample)
    if n <= k + 1:
        return 1.0
    x = unit(sample)
    strings = hash_strings(sample, trees, seed)
    places = []
    for i in range(min(SAMPLE_QUERIES, n)):
        score = x @ x[i]
        score[i] = -2
        differ = strings ^ strings[:, i:i + 1]
        # bits shared in the best tree: fewer leading bits differ, the smaller the number
        best = differ.min(axis=0)
        level = BITS - np.ceil(np.log2(best.astype(np.float64) + 1))
        for j in np.argsort(-score)[:k]:
            places.append((level >= level[j]).sum() / n)
    return float(np.quantile(places, recall))


class Block:
    """The rows of a block and their forest, built when the first query comes."""

    def __init__(self, k: int, share: float, trees: int, seed: int):
        self.k, self.share, self.trees, self.seed = k, share, trees, seed
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.forest: PrefixForest | None = None

    def add(self, uids: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((uids, ids, scaled(x)))

    def search(self, uids: np.ndarray, ids: np.ndarray, q: np.ndarray) -> list[tuple]:
        """(query row, query id, row, id, score) arrays of the best of some queries."""
        if not self.parts:
            return []
        if self.forest is None:
            self.uids, self.ids, self.x = (np.concatenate(p) for p in zip(*self.parts))
            self.parts = self.parts[:1]
            self.near = unit(self.x).astype(np.float32)
            self.forest = PrefixForest(self.x, self.trees, self.seed)
        q, k, out = scaled(q), self.k, []
        enough = max(MIN_CANDIDATES, int(np.ceil(self.share * len(self.x))))
        for i, found in self.forest.candidates(q, enough):
            found = found[self.uids[found] != uids[i]]
            if len(found) > 4 * k:
                rough = self.near[found] @ (q[i] / np.sqrt((q[i] * q[i]).sum())).astype(np.float32)
                # single precision only sorts out rows that can't be among the best
                bound = np.partition(rough, -k)[-k] - 1e-4
                found = found[rough >= bound]
            score = cosines(self.x[found], q[i])
            best = np.lexsort((self.uids[found], self.ids[found], -score))[:k]
            out.append((np.full(len(best), uids[i]), np.full(len(best), ids[i]),
                        self.uids[found][best], self.ids[found][best], score[best]))
        return out


FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def _search_task(k: int, shares: dict[int, float], other: float, trees: int, seed: int):
    """Arrow function over rows sorted by (d, b, kind): of each block first its rows, then
    the queries, which go through its forest batch by batch."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in (x.slice(at, QUERIES_TOGETHER) for x in batches
                      for at in range(0, x.num_rows, QUERIES_TOGETHER)):
            if not batch.num_rows:
                continue
            d, b, kind, uids, ids = (batch.column(c).to_numpy() for c in ("d", "b", "kind", "uid", "id"))
            cuts = np.flatnonzero((d[1:] != d[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)]):
                if key != (d[s], b[s]):
                    key = (d[s], b[s])
                    block = Block(k, shares.get(int(d[s]), other), trees, seed)
                x = batch.column("vec").slice(s, e - s).flatten().to_numpy().reshape(e - s, -1)
                if kind[s] == 0:
                    block.add(uids[s:e], ids[s:e], x)
                    continue
                out = block.search(uids[s:e], ids[s:e], x)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                                     names=names)

    return run


def usable(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """``(uid, id, d, vec)`` of the rows that take part: with an id and a vector without null
    or non-finite components, not all zero. ``uid`` tells rows apart that share an id; ``d``
    is the vector's length."""
    v = F.col("vec")
    inf = float("inf")
    fine = (v.isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & ~c.isin(inf, -inf))
            & F.exists(v, lambda c: c != 0))
    rows = df.select(F.col(id_col).cast("long").alias("id"),
                     F.col(vec).cast("array<double>").alias("vec")).where(fine)
    return materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "id",
                                   F.size("vec").alias("d"), "vec"), "forest-rows")


def fitted_shares(rows: DataFrame, k: int, trees: int, seed: int,
                  recall: float) -> tuple[dict[int, float], float]:
    """Shares of the candidates for the most frequent vector lengths, each fitted on a
    bounded sample of its rows, and the one for all other lengths: all rows if those are
    few, else the largest fitted one."""
    order = F.xxhash64(F.lit(seed), "id", "uid")
    place = F.pmod(order, F.lit(HASHES))
    sizes = (rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d"))
             .limit(FITTED_LENGTHS + 1).collect())
    shares = {}
    for d, n in ((r["d"], r["count"]) for r in sizes[:FITTED_LENGTHS]):
        # a hash bound leaves a few times the sample, however many rows there are
        some = (rows.where((F.col("d") == d) & (place < min(
            HASHES, HASHES * SPARE * SAMPLE_ROWS // max(n, 1))))
            .orderBy(place, "uid").limit(SAMPLE_ROWS).select("vec").collect())
        shares[d] = fit_share(scaled(np.array([r.vec for r in some], dtype=np.float64)), k, trees,
                              seed, recall)
    rest = sizes[FITTED_LENGTHS]["count"] if len(sizes) > FITTED_LENGTHS else 0
    return shares, max(shares.values()) if rest > SAMPLE_ROWS else 1.0


def search(df: DataFrame, queries, id_col: str = "vec_id", vec: str = "embedding",
           k: int = NEIGHBOURS, trees: int = TREES, seed: int = SEED, recall: float = RECALL,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each row that
    ``queries`` (a condition on the column ``id``) selects, among all other rows. Vectors of
    different lengths never meet; rows that share an id are rows of their own.

    Each row is hashed to one block of its length, whose number follows from the count of
    rows alone. A block's forest is built once, in one task, whose memory the block's size
    bounds; the queries stream through it. The driver gets the samples and a few counts.
    """
    rows = usable(df, id_col, vec)
    shares, other = fitted_shares(rows, k, trees, seed, recall)
    many = F.greatest(F.ceil(F.col("n") / F.lit(block_rows)),
                      F.least(F.lit(SMALL_BLOCKS), F.ceil(F.col("n") / F.lit(SMALL_ROWS)))).cast("int")
    sized = rows.join(rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")), "d") \
        .withColumn("blocks", many)
    b = F.pmod(F.xxhash64(F.lit(seed), "id", "uid"), F.col("blocks")).cast("int")
    held = sized.select("d", b.alias("b"), F.lit(0).alias("kind"), "uid", "id", "vec")
    asked = sized.where(queries(F.col("id"))).select(
        "d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(1).alias("kind"),
        "uid", "id", "vec")
    met = (held.unionByName(asked).repartition("d", "b")
           .sortWithinPartitions("d", "b", "kind", "uid"))
    found = met.mapInArrow(_search_task(k, shares, other, trees, seed), FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every vector whose id is divisible by 50.

    Null, zero and non-finite vectors and rows without an id take no part; vectors of
    different lengths never meet; repeated rows are rows of their own, also as each
    other's neighbours; ties go to the smaller id; components of any finite size are
    measured; an empty table gives no rows. Other columns of the table are not read."""
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(vectors, lambda i: i % 50 == 0)
