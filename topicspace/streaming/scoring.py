"""Applying fitted models to a stream of new documents.

The original has no streaming part. What carries over unchanged is the use of
its fitted models: a document stream read with Structured Streaming goes
through the same article view and the same fitted ``PipelineModel`` (TF-IDF
features, classifier), and is written with a checkpoint in the shared folder,
so a restarted query resumes where it stopped."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicspace.functions.text import first_line, join_rest_lines
from topicspace.session import shared_dir

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def article_stream(spark: SparkSession, path: str, schema: str = DOCUMENT_SCHEMA,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of documents arriving in ``path`` -> streaming
    ``(article_id, title, content, categories)``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.parquet(path)
    return docs.select(F.col("doc_id").alias("article_id"), first_line("text").alias("title"),
                       join_rest_lines("text").alias("content"),
                       F.array_distinct(F.filter(F.array("source", "lang"),
                                                 lambda c: c.isNotNull())).alias("categories"))


def score_stream(model: PipelineModel, stream: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Apply a fitted model to every micro-batch (a row-wise transform: no state)."""
    out = model.transform(stream)
    return out.select(*keep) if keep else out


def write_stream(stream: DataFrame, path: str, name: str, checkpoint: str | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Append the stream to Parquet at ``path``; the checkpoint lives in the
    shared folder unless given."""
    spark = stream.sparkSession
    ckpt = checkpoint or f"{shared_dir(spark)}/streams/{name}"
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", ckpt).option("path", path).queryName(name))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
