"""The "wiki view" of the driver's Parquet tables.

* article = a ``documents`` row, ``article_id = doc_id``; title = first line of
  ``text``; content = the other lines joined by one space.
* membership = (doc_id, source) and (doc_id, lang): two categories per article.
* category dictionary = distinct category names, dense 1-based ids in name order.
* category filter = the four languages and sources ``src0`` .. ``src9``.
* word vectors = ``embeddings`` (``vec_id`` is the word index).
* labelled vectors = ``embeddings(label, embedding)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspace.functions.text import first_line, join_rest_lines
from topicspace.operators.common import spread

# The category filter list of the wiki view.
FILTER_CATEGORIES = ["de", "en", "es", "fr",
                     "src0", "src1", "src2", "src3", "src4",
                     "src5", "src6", "src7", "src8", "src9"]


# Unique row key of a table: small inputs are spread over the cores by it, other
# tables round robin.
ROW_KEYS = {"documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the cores when stored as too few splits."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), ROW_KEYS.get(name))


def _categories_col():
    return F.array_distinct(F.filter(F.array("source", "lang"), lambda c: c.isNotNull()))


def articles(spark: SparkSession, sf_dir: str, with_categories: bool = False) -> DataFrame:
    """``(article_id, title, content)``, plus ``categories`` (the article's
    membership line) when asked: one scan, no join."""
    docs = table(spark, sf_dir, "documents")
    cols = [F.col("doc_id").alias("article_id"), first_line("text").alias("title"),
            join_rest_lines("text").alias("content")]
    if with_categories:
        cols.append(_categories_col().alias("categories"))
    return docs.select(*cols)


def article_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(article_id, categories array<string>)``: the membership line of each article."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("article_id"), _categories_col().alias("categories"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``(article_id, category)`` rows."""
    return article_categories(spark, sf_dir).select(
        "article_id", F.explode("categories").alias("category"))


def category_filter(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in FILTER_CATEGORIES], "category string")


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(idx int, vec array<float>)``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("idx"), F.col("embedding").alias("vec"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, label, vec array<float>)``."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").alias("vec"))


def label_names(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Names for the vector labels: ``(label, name)`` with name ``label<k>``."""
    return vectors.select(label).distinct().select(
        label, F.concat(F.lit("label"), F.col(label).cast("string")).alias("name"))
