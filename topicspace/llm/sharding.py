"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records with a seeded hash into buckets small enough for a
task's memory; pass 2 applies a Fisher-Yates shuffle to each bucket. The buckets
in order, each shuffled, are one uniformly mixed sequence of all rows; a shard is
a run of that sequence, so the shards' row counts differ by at most one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from topicspace.llm.common import fresh_dir, read_table, utf8_bytes

#: Text bytes a bucket holds on average.
BUCKET_BYTES = 32 << 20
BUCKET, ORDER = "__bucket", "__order"
EMIT_ROWS = 2048


def scatter(df: DataFrame, buckets: int, seed: int, key: list[str]) -> DataFrame:
    """Add the bucket (seeded hash of ``key``) and the order in which the bucket's
    rows enter the shuffle: a second hash, so that arrival order has no effect."""
    return df.withColumns({
        BUCKET: F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).cast("int"),
        ORDER: F.xxhash64(F.lit(seed + 1), *key),
    })


def _fisher_yates(starts: dict[int, int], total: int, shards: int, seed: int, drop: list[str]):
    """Arrow function over partitions sorted by bucket: shuffles each bucket and
    gives every row its shard and slot."""
    q, r = divmod(total, shards)

    def place(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the first r shards hold q + 1 rows, the others q
        long_part = pos < r * (q + 1)
        rest = pos - r * (q + 1)
        shard = np.where(long_part, pos // (q + 1), r + rest // max(q, 1))
        slot = np.where(long_part, pos % (q + 1), rest % max(q, 1))
        return shard.astype(np.int32), slot.astype(np.int64)

    def shuffled(bucket: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).drop_columns(drop)
        order = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(table))
        shard, slot = place(starts[bucket] + np.arange(len(table)))
        for at in range(0, len(table), EMIT_ROWS):
            part = table.take(pa.array(order[at:at + EMIT_ROWS]))
            part = part.append_column("shard", pa.array(shard[at:at + EMIT_ROWS]))
            part = part.append_column("slot", pa.array(slot[at:at + EMIT_ROWS]))
            yield from part.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:
            ids = batch.column(BUCKET).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held is not None and ids[a] != held:
                    yield from shuffled(held, parts)
                    parts = []
                held = int(ids[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from shuffled(held, parts)

    return run


def shuffle_shards(df: DataFrame, shards: int, seed: int = 17, text: str = "text",
                   key: list[str] | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless
    from 0 in each shard).

    ``key`` names the columns whose seeded hash decides the bucket; by default
    all columns, so that equal ids with different contents still spread. Rows
    equal in every key column are interchangeable. Columns named ``shard`` or
    ``slot`` are replaced. The driver holds one row count for each bucket.
    """
    rest = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    df = df.select(*rest)
    key = key or rest
    size = df.agg(F.sum(utf8_bytes(text) + 1).alias("b")).first()["b"] or 0
    buckets = max(1, -(-size // bucket_bytes))
    scattered = scatter(df, buckets, seed, key)
    counts = dict(scattered.groupBy(BUCKET).count().collect())
    starts, total = {}, 0
    for bucket in sorted(counts):
        starts[bucket] = total
        total += counts[bucket]
    dealt = (scattered.repartitionById(buckets, F.col(BUCKET))
             .sortWithinPartitions(BUCKET, ORDER, *[c for c in key if c != text]))
    schema = StructType([*df.schema.fields, StructField("shard", IntegerType()),
                         StructField("slot", LongType())])
    return dealt.mapInArrow(_fisher_yates(starts, total, shards, seed, [BUCKET, ORDER]), schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=k`` for each shard, its files in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def op1_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of all documents under the law ``rows``: written as shard
    files, and the digest read back from them. A null text has size 1 and no
    checksum; repeated rows each get a slot of their own; an empty table gives no
    rows. ``grown_shard`` is null under this law."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    sharded = shuffle_shards(docs, 16)
    path = fresh_dir(spark, "op1-shards")
    write_shards(sharded, path)
    return read_shards(spark, path, sharded.schema).select(
        "doc_id", (utf8_bytes("text") + 1).alias("size"), F.crc32("text").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
