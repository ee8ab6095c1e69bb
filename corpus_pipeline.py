"""Corpus pipeline: documents through five of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; ``run``
writes each result as Parquet below the shared folder and gives it to the next
stage. All stages but the last return the columns of documents; an empty table gives
empty results all the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicspace.llm.common import materialize, read_table
from topicspace.llm.merge_dropout import encode_documents
from topicspace.llm.mixing import mix_documents
from topicspace.llm.pii import replace_pii
from topicspace.llm.quality import keep_documents
from topicspace.llm.simhash import deduplicate


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the label model accept. Null, empty and wordless
    texts go; repeated rows are judged each and alike; very long texts are judged whole."""
    return keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest id (null last), one of several
    such rows. Null and wordless texts are one component."""
    return deduplicate(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced in every text; null and empty texts stay as they
    are, and all other columns stay."""
    return replace_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them; one that it takes twice comes twice. A null source
    is a source of its own; a document without words has size 0."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as the piece ids of a seeded merge-dropout segmentation; a null text has
    null ids and an empty one none."""
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("pii_surrogates", surrogates),
    ("mix_sources", mix_sources),
    ("merge_dropout_encode", encode),
]

#: Several stages (XXH64 fingerprints, seeded order, tokenizer) have no equivalent
#: in SQL; tests/llm compares the stages with the operators that they call.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents", "*")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
