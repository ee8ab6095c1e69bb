"""Connected components of a link table by minimum labels, hooking and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspace.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node in ``links(a, b)``: ``root`` is the smallest
    node that can be reached. Rounds of min-label hooking (of a node and of its
    parent) and pointer jumping, each written to the shared folder; the number of
    rounds follows the logarithm of the longest chain. Only the count of changed
    rows reaches the driver."""
    edges = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(), "cc-edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("root"))
    while True:
        labels = materialize(labels, "cc-labels")
        near = (edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("r").alias("m")))
        hooks = (labels.join(near, "node").where(F.col("m") < F.col("root"))
                 .select(F.explode(F.array("node", "root")).alias("node"), "m")
                 .groupBy("node").agg(F.min("m").alias("m")))
        moved = labels.join(hooks, "node", "left").select(
            "node", F.least("root", F.coalesce("m", "root")).alias("up"), F.col("root").alias("old"))
        moved = materialize(moved, "cc-moved")
        if moved.where("up <> old").isEmpty():
            return labels
        jump = moved.where("up <> node").select(F.col("node").alias("up"), F.col("up").alias("top"))
        labels = moved.join(jump, "up", "left").select(
            "node", F.coalesce("top", "up").alias("root"))
