"""Repeatable splits and samples keyed by a hash of the row key, so the same
row lands in the same part whatever the partitioning, and the split can be
checked independently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The hash range: 60 bits, so a fraction is met to about 1e-18.
HASH_BITS = 60
HASH_RANGE = 1 << HASH_BITS


def key_hash(key: str | Column) -> Column:
    """0 .. HASH_RANGE - 1: the first 60 bits of the MD5 of the key's text."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def bound(fraction: float) -> int:
    """The end of the first ``fraction`` of the hash range."""
    return min(HASH_RANGE, max(0, round(fraction * HASH_RANGE)))


def hash_split(df: DataFrame, key: str, weights: Sequence[float], out: str = "split") -> DataFrame:
    """Label every row with its part 0..len(weights)-1 (weights are normalised)."""
    total = float(sum(weights))
    bounds, acc = [], 0.0
    for w in weights[:-1]:
        acc += w / total
        bounds.append(bound(acc))
    b = key_hash(key)
    part = F.lit(len(weights) - 1)
    for i in reversed(range(len(bounds))):
        part = F.when(b < bounds[i], F.lit(i)).otherwise(part)
    return df.withColumn(out, part.cast("int"))


def split_parts(df: DataFrame, key: str, weights: Sequence[float]) -> list[DataFrame]:
    """``randomSplit``-like list of DataFrames, but repeatable by key."""
    tagged = hash_split(df, key, weights, "_part")
    return [tagged.where(F.col("_part") == i).drop("_part") for i in range(len(weights))]


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows whose key hash falls in the first ``fraction`` of the hash range."""
    return df.where(key_hash(key) < F.lit(bound(fraction)))


def random_split(df: DataFrame, weights: Sequence[float], seed: int = 0) -> list[DataFrame]:
    """Spark's seeded ``randomSplit`` (repeatable only for the same input
    partitioning; ``split_parts`` is repeatable by key)."""
    return df.randomSplit(list(weights), seed)
