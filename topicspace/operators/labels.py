"""Dictionary operators: dense labels, lookups with a default, id filters and
the labelled-article view (article -> its categories -> dense label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspace.operators.common import bounded_broadcast
from topicspace.session import shared_dir


def dense_labels(df: DataFrame, order: str | Sequence[str | Column], out: str = "label",
                 start: int = 1) -> DataFrame:
    """Dense consecutive labels ``start, start+1, ...`` following ``order``.

    No single-partition window: the rows are range-sorted in parallel, every
    sorted partition is counted, and a row's label is its partition's offset
    plus its place inside the partition. The sorted rows are checkpointed to the
    shared folder first, so both passes see the same partitions. ``order`` must
    be a total order (ties get an arbitrary but fixed order).
    """
    spark = df.sparkSession
    shared_dir(spark)
    order_cols = [order] if isinstance(order, (str, Column)) else list(order)
    tagged = (df.orderBy(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    # one row per partition: small by construction
    rows = sorted(counts.collect(), key=lambda r: r["_pid"])
    offsets, acc = [], start
    for r in rows:
        offsets.append((r["_pid"], acc - r["_first"]))
        acc += r["_n"]
    # one row per partition of the sorted data: bounded by the partition count
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _off bigint")
    return (tagged.join(F.broadcast(off), "_pid")
            .withColumn(out, (F.col("_mid") + F.col("_off")).cast("int"))
            .drop("_pid", "_mid", "_off"))


def lookup(df: DataFrame, dictionary: DataFrame, on: str | Sequence[str], value: str,
           default=None, out: str | None = None) -> DataFrame:
    """Left-join ``dictionary`` and replace a missing value by ``default``. A key that
    the dictionary holds more than once counts with its largest value (a dictionary
    with a file order goes through ``last_wins`` first), so no row of ``df`` is
    repeated."""
    keys = [on] if isinstance(on, str) else list(on)
    d = dictionary.groupBy(*keys).agg(F.max(value).alias("_lv"))
    res = df.join(d, keys, "left")
    filled = F.col("_lv") if default is None else F.coalesce(F.col("_lv"), F.lit(default))
    return res.withColumn(out or value, filled).drop("_lv")


def articles_with_ids(corpus: DataFrame, dictionary: DataFrame, title: str = "title",
                      article: str = "article_id", unknown: str = "keep",
                      missing_id: int = -1) -> DataFrame:
    """Attach article ids to a ``(title, content)`` corpus through the article
    dictionary ``(title, article_id)``; titles are compared in key form (spaces
    as underscores) on both sides. ``unknown='keep'`` keeps an unknown title with
    id ``missing_id`` (it has no category, but still counts as a document, e.g.
    in IDF); ``unknown='drop'`` drops it."""
    from topicspace.functions.text import normalize_title
    keyed = corpus.withColumn("_key", normalize_title(title))
    d = dictionary.select(normalize_title(title).alias("_key"), F.col(article))
    if unknown == "drop":
        return keyed.join(d, "_key", "inner").drop("_key")
    if unknown != "keep":
        raise ValueError("unknown must be 'keep' or 'drop'")
    return lookup(keyed, d, "_key", article, default=missing_id).drop("_key")


def semi_filter(df: DataFrame, ids: DataFrame, on: str, ids_col: str | None = None) -> DataFrame:
    """Keep the rows whose ``on`` value is in ``ids`` (a left-semi join)."""
    right = ids.select(F.col(ids_col or on).alias(on))
    return df.join(right, on, "left_semi")


def reverse(dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """Swap a dictionary's key and value columns."""
    return dictionary.select(F.col(value).alias(key), F.col(key).alias(value))


def duplicated_values(dictionary: DataFrame, value: str) -> DataFrame:
    """Values that occur more than once (a reverse lookup would be ambiguous)."""
    return dictionary.groupBy(value).count().where("count > 1")


def category_dictionary(membership: DataFrame, category: str = "category",
                        out: str = "category_id") -> DataFrame:
    """Dense 1-based ids for the distinct categories, in name order."""
    distinct = membership.select(category).distinct()
    return dense_labels(distinct, category, out=out)


def label_articles(articles: DataFrame, membership: DataFrame, labels: DataFrame,
                   article: str = "article_id", category: str = "category_id",
                   label: str = "label", mode: str = "explode",
                   unknown_label=0) -> DataFrame:
    """Labelled articles: every article joined to its categories, each category
    mapped to its dense label (unknown -> ``unknown_label``) and unknown labels
    dropped. ``mode='explode'`` keeps one row per (article, label);
    ``mode='first'`` keeps only the smallest label of an article."""
    mem = membership.select(article, category).distinct()
    lab = lookup(mem, labels.select(category, label), category, label, default=unknown_label)
    lab = lab.where(F.col(label) != F.lit(unknown_label)).select(article, label).distinct()
    if mode == "first":
        lab = lab.groupBy(article).agg(F.min(label).alias(label))
    elif mode != "explode":
        raise ValueError("mode must be 'explode' or 'first'")
    return articles.join(lab, article, "inner")
