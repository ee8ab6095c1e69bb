"""Scoring rows against class vectors and top-k accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspace.functions.vectors import metric as metric_fn
from topicspace.operators.common import bounded_broadcast
from topicspace.session import shared_dir

# Class vectors of a block in the rank join.
BLOCK_CLASSES = 1024
# Rows of the scored table that meet one block of classes in one task, about.
SALT_ROWS = 1 << 18


def class_scores(rows: DataFrame, classes: DataFrame, vec: str = "vec", label: str = "label",
                 metric: str = "sqeuclidean", out: str = "scores") -> DataFrame:
    """Score every row against every class vector: ``out`` is an array of
    ``struct(label, score)`` with score = -distance (higher is better).

    At most ``BLOCK_CLASSES`` classes, a size that is counted, are folded into one row by a
    scalar subquery, so scoring is a narrow map over the rows with no join. More classes
    meet the rows block by block and the scores of a row are put together again: the row
    carries all of them by definition; where only the rank of the true class is needed,
    ``true_class_ranks`` carries none."""
    fn = metric_fn(metric)
    own = classes.select(F.col(label).alias("label"), F.col(vec).alias("v"))
    entry = F.struct("label", "v")
    n = own.count()
    if n <= BLOCK_CLASSES:
        folded = own.agg(F.array_sort(F.collect_list(entry))).scalar()
        return (rows.withColumn("_classes", folded)
                .withColumn(out, _scores("_classes", vec, fn)).drop("_classes"))
    shared_dir(rows.sparkSession)
    saved = rows.withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    n_blocks = -(-n // BLOCK_CLASSES)
    blocks = (own.withColumn("_b", F.pmod(F.xxhash64("label"), F.lit(n_blocks)).cast("int"))
              .groupBy("_b").agg(F.collect_list(entry).alias("_classes")))
    spread = saved.select("_id", vec, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_b"))
    parts = (spread.join(bounded_broadcast(blocks), "_b")
             .select("_id", _scores("_classes", vec, fn).alias("_s"))
             .groupBy("_id").agg(F.array_sort(F.flatten(F.collect_list("_s"))).alias(out)))
    return saved.join(parts, "_id").drop("_id")


def _scores(classes: str, vec: str, fn) -> Column:
    return F.transform(F.col(classes), lambda c: F.struct(
        c["label"].alias("label"), (-fn(F.col(vec), c["v"])).alias("score")))


def true_class_rank(scores: str = "scores", label: str = "label") -> F.Column:
    """1-based rank of the row's true class among its scores (higher score first;
    ties broken by class label)."""
    s = F.col(scores)
    true_score = F.aggregate(F.filter(s, lambda c: c["label"] == F.col(label)),
                             F.lit(None).cast("double"), lambda acc, c: c["score"])
    better = F.filter(s, lambda c: (c["score"] > true_score)
                      | ((c["score"] == true_score) & (c["label"] < F.col(label))))
    return F.when(true_score.isNull(), F.lit(None)).otherwise(F.size(better) + 1)


def true_class_ranks(rows: DataFrame, classes: DataFrame, vec: str = "vec", label: str = "label",
                     metric: str = "sqeuclidean", out: str = "rank") -> DataFrame:
    """``rows`` with ``rank``: the 1-based rank of its true class among all
    class vectors (nearest first, ties by class label; null for an unknown class), for
    any number of classes.

    A row first meets its own class (one join on the label) for the distance to beat;
    then every block of classes counts those that beat it, and the counts are added
    up. A block is joined on (block, salt): its copies, one for each salt, spread the
    rows that all meet it. Rows are saved with an id first, as they are read twice.
    """
    fn = metric_fn(metric)
    spark = rows.sparkSession
    shared_dir(spark)
    own = classes.select(F.col(label).alias("_l"), F.col(vec).alias("_v"))
    saved = rows.withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    asked = saved.select("_id", F.col(label).alias("_label"),
                         F.col(vec).cast("array<double>").alias("_x"))
    n_blocks = max(1, -(-own.count() // BLOCK_CLASSES))
    salts = max(1, -(-asked.count() // SALT_ROWS))
    beat = (asked.join(bounded_broadcast(own), F.col("_label") == F.col("_l"))
            .select("_id", "_label", "_x", fn(F.col("_x"), F.col("_v")).alias("_d")))
    blocks = (own.withColumn("_b", F.pmod(F.xxhash64("_l"), F.lit(n_blocks)).cast("int"))
              .groupBy("_b").agg(F.collect_list(F.struct("_l", "_v")).alias("_cs"))
              .withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    spread = beat.withColumns({
        "_b": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))),
        "_s": F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")})
    better = F.size(F.filter("_cs", lambda c: comes_before(
        fn(F.col("_x"), c["_v"]), F.col("_d"), c["_l"], F.col("_label"))))
    counts = (spread.join(bounded_broadcast(blocks), ["_b", "_s"])
              .select("_id", better.alias("_n")).groupBy("_id").agg(F.sum("_n").alias("_n")))
    return saved.join(counts, "_id", "left").select(
        *rows.columns, (F.col("_n") + 1).cast("int").alias(out))


def comes_before(a: Column, b: Column, a_tie: Column, b_tie: Column) -> Column:
    """Whether ``(a, a_tie)`` comes before ``(b, b_tie)``; each value is computed once."""
    return F.struct(a, a_tie) < F.struct(b, b_tie)


def topk_accuracy_from_ranks(ranked: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """``(k, accuracy, n)`` from a column of true-class ranks."""
    return ranked.agg(F.lit(k).alias("k"),
                      F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)).alias("accuracy"),
                      F.count(F.lit(1)).alias("n"))


def topk_accuracy(scored: DataFrame, k: int, scores: str = "scores", label: str = "label") -> DataFrame:
    """Share of rows whose true class is among their ``k`` best scores:
    one row ``(k, accuracy, n)``. A plain global aggregate (partial per task)."""
    rank = true_class_rank(scores, label)
    return scored.agg(F.lit(k).alias("k"),
                      F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias("accuracy"),
                      F.count(F.lit(1)).alias("n"))
