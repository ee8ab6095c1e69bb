"""Exact top-k by inner product (maximum inner-product search) with norm-sorted blocks.

Items are put in blocks by falling norm. Every query meets the first block, which gives
it k scores to beat; an item can beat them only if its norm times the query's reaches
the k-th, so each query block meets just the leading item blocks that this bound
leaves. No table of all scores is made."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspace.functions.vectors import norm
from topicspace.operators.labels import dense_labels
from topicspace.session import shared_dir

# Rows of an item block and of a query block.
BLOCK_ITEMS = 1024
BLOCK_QUERIES = 1024
MAX_BLOCKS = 1 << 14


def _kernel(k: int):
    import numpy as np
    import pandas as pd

    def fn(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if q.empty or i.empty:
            return pd.DataFrame({"q": [], "i": [], "s": []})
        i = i.sort_values("_item", kind="stable")
        ids = i["_item"].to_numpy()
        a = np.stack(q["_v"].to_numpy()).astype(np.float64)
        b = np.stack(i["_v"].to_numpy()).astype(np.float64)
        # one product at a time: each is summed in the same order in every block
        s = np.einsum("ik,jk->ij", a, b)
        some = min(k, len(ids))
        # ids ascend, so a stable sort leaves ties in id order
        best = np.argsort(-s, axis=1, kind="stable")[:, :some]
        return pd.DataFrame({"q": np.repeat(q["_query"].to_numpy(), some), "i": ids[best].ravel(),
                             "s": np.take_along_axis(s, best, axis=1).ravel()})

    return fn


def _scored(queries: DataFrame, items: DataFrame, k: int, kinds: str) -> DataFrame:
    """The best ``k`` of each (query, item block): both sides carry (qb, ib)."""
    # own names for the right side: both may come from the same rows
    right = items.select(F.col("qb").alias("_qb"), F.col("ib").alias("_ib"), "_item", "_v")
    return (queries.groupBy("qb", "ib").cogroup(right.groupBy("_qb", "_ib"))
            .applyInPandas(_kernel(k), kinds))


def top_inner_products(queries: DataFrame, items: DataFrame, k: int, query: str = "query",
                       item: str = "item", vec: str = "vec", out: str = "score",
                       rank: str = "rank", block_items: int = BLOCK_ITEMS,
                       block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``(query, item, score, rank)``: of each query the ``k`` items with the largest inner
    product, ranked 1..k (score descending, then item)."""
    spark = queries.sparkSession
    shared_dir(spark)
    v = F.col(vec).cast("array<double>")
    placed = dense_labels(items.select(F.col(item).alias("_item"), v.alias("_v"), norm(vec).alias("_n")),
                          [F.col("_n").desc(), F.col("_item")], out="_at", start=0)
    # at most MAX_BLOCKS of them, so that one number for each is a small list
    size = max(block_items, -(-placed.count() // MAX_BLOCKS))
    by_norm = placed.withColumn("ib", F.floor(F.col("_at") / size).cast("int")) \
        .drop("_at").checkpoint(eager=True)
    # the largest norm of each block, falling
    tops = [r.n for r in by_norm.groupBy("ib").agg(F.max("_n").alias("n")).orderBy("ib").collect()]
    asked = queries.select(F.col(query).alias("_query"), v.alias("_v"), norm(vec).alias("_n"))
    n_queries = max(1, math.ceil(asked.count() / block_queries))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("_query"), F.lit(n_queries)).cast("int")) \
        .checkpoint(eager=True)
    kinds = (f"q {queries.schema[query].dataType.simpleString()}, "
             f"i {items.schema[item].dataType.simpleString()}, s double")

    everyone = F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))
    first = _scored(asked.select("qb", F.lit(0).alias("ib"), "_query", "_v"),
                    by_norm.where("ib = 0").select(everyone.alias("qb"), "ib", "_item", "_v"),
                    k, kinds)
    if len(tops) > 1:
        first = first.checkpoint(eager=True)
        kth = (first.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"))
               .select(F.col("q").alias("_query"), F.when(F.col("n") >= k, F.col("s")).alias("_kth")))
        # a block matters to a query while its largest norm times the query's can reach the
        # k-th score (a little less, for rounding); a score of zero or less is always reached
        least = F.when((F.col("_kth") > 0) & (F.col("_n") > 0),
                       F.col("_kth") / (F.col("_n") * (1 + 1e-9))).otherwise(F.lit(-math.inf))
        reached = (asked.join(kth, "_query", "left").groupBy("qb").agg(F.min(least).alias("least"))
                   .withColumn("m", F.size(F.filter(F.lit(tops), lambda t: t >= F.col("least")))))
        meets = (reached.where("m > 1").select("qb", F.explode(F.sequence(F.lit(1), F.col("m") - 1))
                                               .alias("ib")).checkpoint(eager=True))
        rest = _scored(asked.join(meets, "qb").select("qb", "ib", "_query", "_v"),
                       by_norm.join(meets, "ib").select("qb", "ib", "_item", "_v"), k, kinds)
        first = first.unionByName(rest)
    w = Window.partitionBy("q").orderBy(F.col("s").desc(), "i")
    return (first.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
            .select(F.col("q").alias(query), F.col("i").alias(item), F.col("s").alias(out), rank))
