"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspace.session import shared_dir

#: A word: a run of characters other than space, tab, line feed, vertical tab,
#: form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared folder that all executors reach."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the
    lineage, and later steps read only the columns they use."""
    spark, schema = df.sparkSession, df.schema
    path = fresh_dir(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a one-element ``transform``
    binds it, so a lambda inside ``body`` never recomputes it per element."""
    return F.transform(F.array(value), body)[0]


def utf8_bytes(text: str) -> Column:
    """UTF-8 bytes of a text column, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def worker_held(key: Hashable, make: Callable[[], Any]) -> Any:
    """One object for each Python worker, kept across the tasks that it runs."""
    held = sys.modules.setdefault("_topicspace_held", types.ModuleType("_topicspace_held"))
    if key not in vars(held):
        vars(held)[key] = make()
    return vars(held)[key]


def single_spaced(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters."""
    words = text.split()
    gaps = len(words) - 1
    return (len(text) - sum(map(len, words)) == gaps
            and text.count(" ") + text.count("\n") == gaps)
