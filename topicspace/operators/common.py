"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DataType, MapType, NumericType, StringType,
                               StructType)

# Rows and bytes up to which a join side is sent whole to every task.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Bytes a string counts for where only the number of rows is proven.
STRING_BYTES = 128


def static_max_rows(df: DataFrame) -> int | None:
    """Row bound Catalyst proves from the plan alone (a limit, a global
    aggregate, a union of bounded parts ...), or None."""
    try:
        bound = df._jdf.queryExecution().optimizedPlan().maxRows()
        return int(bound.get()) if bound.isDefined() else None
    except Exception:  # pragma: no cover - plan API not reachable
        return None


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: strings and binaries by their length, arrays and maps
    by their elements, other values 8 each."""
    def size(c: Column, kind: DataType) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
        if isinstance(kind, ArrayType):
            if isinstance(kind.elementType, NumericType):
                return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") * 8
            return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)).cast("long")
        if isinstance(kind, (StructType, MapType)):
            return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)).cast("long")
        return F.lit(8).cast("long")

    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        total = total + size(F.col(f"`{f.name}`"), f.dataType)
    return total


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                      max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when it is proven to hold at most ``max_rows`` rows and
    ``max_bytes`` bytes.

    For rows of numbers and strings the proof is the plan's static row bound when
    Catalyst has one (e.g. a top-k vocabulary ends in a limit) times the row's width,
    so no job runs. Otherwise the rows and bytes of at most ``max_rows + 1`` rows are
    summed. Beyond the bound the side is returned as is: the join stays a shuffle join
    (AQE may still broadcast it at run time if the shuffled size proves small).
    """
    bound = static_max_rows(df)
    flat = [f.dataType for f in df.schema.fields]
    if bound is not None and bound <= max_rows and not any(
            isinstance(t, (ArrayType, MapType, StructType, BinaryType)) for t in flat):
        width = sum(STRING_BYTES if isinstance(t, StringType) else 8 for t in flat)
        if bound * width <= max_bytes:
            return F.broadcast(df)
    found = df.limit(max_rows + 1).select(row_bytes(df).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= max_rows and found["b"] <= max_bytes else df


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the plan (file sizes for a scan), no job run."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # pragma: no cover - plan API not reachable
        return None


SPREAD_MIN_BYTES = 1 << 20
SPREAD_MAX_BYTES = 4 << 30


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None,
           min_bytes: int = SPREAD_MIN_BYTES, max_bytes: int = SPREAD_MAX_BYTES) -> DataFrame:
    """Give a small scan at least the cluster's parallelism in partitions.

    A large input arrives in many files and splits, and is left alone (its
    exploded rows are combined map-side before any shuffle). A small input
    stored as one file with one row group is read by a single task; then
    everything per row (tokenising, exploding, partial aggregation) would run on
    one core. Such an input is dealt round robin over the cores, or, if ``key`` is
    given, by the hash of that column, which lets later aggregations by it skip their
    exchange; ``key`` must be a row id, for a repeated value would go whole to one
    task. Inputs under ``min_bytes`` are too small to gain from it, and those over
    ``max_bytes`` are never shuffled only to spread them, however many cores there
    are."""
    try:
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # pragma: no cover - no RDD view of the plan (e.g. a remote session)
        return df
    size = estimated_bytes(df)
    if parts >= want or (size is not None and not min_bytes <= size <= max_bytes):
        return df
    return df.repartition(want, key) if key else df.repartition(want)


def to_long(df: DataFrame, keys: list[str], vec: str, dim: str = "dim",
            value: str = "value") -> DataFrame:
    """One row per vector element: ``(keys..., dim, value)``, dim 0-based."""
    return (df.select(*keys, F.posexplode_outer(vec).alias(dim, value))
            .where(F.col(dim).isNotNull()))
