"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance.

Pigeonhole blocks: a fingerprint is cut into eight bytes. Two fingerprints that
differ in at most two bits differ in at most two bytes, so they agree on six of the
eight; each fingerprint is keyed once for every choice of six bytes (28 keys) and
fingerprints meet where a key is equal. A key fixes 48 bits, so a group holds at
most 65,536 different fingerprints, whatever the data. Inside a group the Hamming
distance is verified and a spanning forest of true links is returned, never all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from topicspace.llm.common import materialize, read_table
from topicspace.llm.components import connected_components

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
BLOCKS = 8
#: Shingle hashes counted at a time, to bound the memory of a very long text.
COUNT_ROWS = 1 << 17


def simhash(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Fingerprint of a text: a bit is 1 if set in over half of the shingle hashes.
    Null or wordless: zero. Fewer words than a shingle: the whole sequence."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:])]
    array = np.array(hashes, dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(array), COUNT_ROWS):
        bits = np.unpackbits(array[at:at + COUNT_ROWS].view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(array), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS,
                 seed: int = HASH_SEED, out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text`` as a signed long in column ``out``."""
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t, shingle, seed) for t in batch.column(text).to_pylist()],
                              dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)],
                                             names=[*batch.schema.names, out])

    schema = StructType([*df.schema.fields, StructField(out, LongType())])
    return df.mapInArrow(run, schema)


def _block_masks(max_bits: int) -> list[int]:
    width = 64 // BLOCKS
    kept = combinations(range(BLOCKS), BLOCKS - max_bits)
    masks = [sum(((1 << width) - 1) << (width * i) for i in c) for c in kept]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(group: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links within ``max_bits`` that span each component of a group of different
    fingerprints: a breadth-first walk in which a found member leaves the pool."""
    links, pool = [], group
    while len(pool):
        queue, pool = [pool[0]], pool[1:]
        while queue and len(pool):
            node = queue.pop()
            close = np.bitwise_count(pool ^ node) <= max_bits
            if close.any():
                found = pool[close]
                links += [(int(node), int(x)) for x in found]
                queue.extend(found)
                pool = pool[~close]
    return links


def _verify(max_bits: int):
    """Arrow function over rows sorted by (block, key, fingerprint): verified links."""

    def links_of(block, key, fp) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero((block[1:] != block[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate(([0], new))
        ends = np.concatenate((new, [len(fp)]))
        two = starts[ends - starts == 2]
        close = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= max_bits
        a, b = [fp[two[close]]], [fp[two[close] + 1]]
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            found = np.array(spanning_links(fp[s:e].view(np.uint64), max_bits),
                             dtype=np.uint64).reshape(-1, 2).view(np.int64)
            a.append(found[:, 0])
            b.append(found[:, 1])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("block", "key", "fp")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            block, key, _ = cols
            inside = np.flatnonzero((block != block[-1]) | (key != key[-1]))
            cut = int(inside[-1]) + 1 if len(inside) else 0
            held = [c[cut:] for c in cols]  # the last group may go on
            if cut:
                a, b = links_of(*(c[:cut] for c in cols))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held is not None:
            a, b = links_of(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Verified links ``(a, b)`` between the different fingerprints ``fps(fp)``:
    they connect exactly the fingerprints that chains of at most ``max_bits``
    differing bits connect."""
    if not 0 <= max_bits < BLOCKS:
        raise ValueError(f"max_bits must be from 0 to {BLOCKS - 1}")
    masks = F.array(*[F.lit(m).cast("long") for m in _block_masks(max_bits)])
    keyed = fps.select("fp", F.posexplode(masks).alias("block", "mask")).select(
        "block", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    met = keyed.repartition("block", "key").sortWithinPartitions("block", "key", "fp")
    return met.mapInArrow(_verify(max_bits), "a long, b long").distinct()


def near_duplicate_components(marked: DataFrame, fp: str = "fingerprint",
                              max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, root)``: the component of every different fingerprint in ``marked``,
    named by its smallest fingerprint."""
    fps = marked.groupBy(F.col(fp).alias("fp")).agg(F.lit(1).alias("one")).select("fp")
    roots = connected_components(fingerprint_links(fps, max_bits))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate component: the smallest id (null last), one
    of several such rows. All columns of ``docs`` stay. Rows with a null or
    wordless text share the zero fingerprint and so one component."""
    fp, uid = "__fingerprint", "__row"
    marked = materialize(
        fingerprints(docs, text, out=fp).withColumn(uid, F.monotonically_increasing_id()),
        "simhash-docs")
    best = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"),
                          F.col(uid).alias("u")))
    firsts = marked.groupBy(F.col(fp).alias("fp")).agg(best.alias("first"))
    keep = (firsts.join(near_duplicate_components(marked, fp), "fp")
            .groupBy("root").agg(F.min("first").alias("first"))
            .select(F.col("first.u").alias(uid)))
    return marked.join(keep, uid, "left_semi").select(*docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and wordless texts have
    fingerprint zero; a component whose documents all lack an id has a null id; an
    empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    marked = materialize(fingerprints(docs).drop("text"), "simhash-fingerprints")
    firsts = marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first"))
    classes = materialize(firsts.join(near_duplicate_components(marked), "fp"), "simhash-classes")
    names = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(names, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return marked.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")
