"""TF-IDF features, exact per term and hashed into buckets.

IDF follows Spark ML: ``idf = ln((m + 1) / (df + 1))`` with ``m`` documents and
``df`` documents containing the term."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspace.functions.vectors import vector_entries


def term_frequency(df: DataFrame, doc: str, tokens: str, term: str = "term",
                   out: str = "tf") -> DataFrame:
    """Exact term counts per document: ``(doc, term, tf bigint)``. A document's
    tokens sit in one input row, so the map-side partial aggregate already
    collapses them and only distinct (doc, term) rows are shuffled."""
    ex = df.select(doc, F.explode_outer(tokens).alias(term)).where(F.col(term).isNotNull())
    return ex.groupBy(doc, term).agg(F.count(F.lit(1)).alias(out))


def document_frequency(tf: DataFrame, term: str = "term", out: str = "df") -> DataFrame:
    """Documents containing each term: ``(term, df bigint)``."""
    return tf.groupBy(term).agg(F.count(F.lit(1)).alias(out))


def idf_weights(doc_freq: DataFrame, n_docs: int, term: str = "term", df: str = "df",
                out: str = "idf") -> DataFrame:
    """``(term, idf)`` with ``idf = ln((n_docs + 1) / (df + 1))``."""
    return doc_freq.select(term, df, F.log((F.lit(n_docs) + 1.0) / (F.col(df) + 1.0)).alias(out))


def tfidf(tf: DataFrame, idf: DataFrame, term: str = "term", tf_col: str = "tf",
          idf_col: str = "idf", out: str = "tfidf", salt: int = 1,
          doc: str | None = None) -> DataFrame:
    """Join term counts to weights. The weight table is one row per term; AQE
    broadcasts it when small and splits a hot term's partition otherwise.

    ``salt > 1`` salts the join explicitly (for a weight table too large to
    broadcast without AQE skew handling): every term-count row gets a salt
    ``0..salt-1`` from a hash of its document (``doc``), every weight row is
    repeated once per salt, and the join key is (term, salt), so a term found
    in a third of all documents is spread over ``salt`` tasks."""
    w = idf.select(term, idf_col)
    if salt > 1:
        if doc is None:
            raise ValueError("salting needs the document column (doc)")
        left = tf.withColumn("_salt", F.pmod(F.xxhash64(F.col(doc)), F.lit(salt)).cast("int"))
        right = w.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        joined = left.join(right, [term, "_salt"], "inner").drop("_salt")
    else:
        joined = tf.join(w, term, "inner")
    return joined.withColumn(out, F.col(tf_col).cast("double") * F.col(idf_col))


def tfidf_exact(df: DataFrame, doc: str, tokens: str, n_docs: int | None = None) -> DataFrame:
    """Exact TF-IDF rows ``(doc, term, tf, idf, tfidf)`` for a tokenised corpus."""
    tf = term_frequency(df, doc, tokens)
    n = df.count() if n_docs is None else n_docs
    return tfidf(tf, idf_weights(document_frequency(tf), n))


def tfidf_model(num_features: int = 20, text: str = "content",
                out: str = "features") -> Pipeline:
    """Tokenizer -> HashingTF(num_features) -> IDF, as a Spark ML pipeline."""
    return Pipeline(stages=[
        Tokenizer(inputCol=text, outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol=out),
    ])


def tfidf_vectors(df: DataFrame, doc: str, text: str, num_features: int = 20,
                  out: str = "features") -> tuple[DataFrame, PipelineModel]:
    """Hashed TF-IDF vectors ``(doc, features)`` and the fitted model. Fitting
    makes one pass to collect the document-frequency vector (``num_features``
    long) on the driver."""
    model = tfidf_model(num_features, text, out).fit(df.select(doc, text))
    return model.transform(df.select(doc, text)).select(doc, out), model


def hashed_term_frequency(df: DataFrame, doc: str, tokens: str, num_features: int,
                          bucket: str = "bucket", out: str = "tf") -> DataFrame:
    """Hashed term counts in long form ``(doc, bucket, tf double)``, non-zero
    buckets only (the vectors' stored entries, whatever the number of buckets), with
    Spark ML's term hash (MurmurHash3 x86 32-bit, seed 42, over UTF-8 bytes,
    non-negative modulo ``num_features``)."""
    htf = HashingTF(inputCol=tokens, outputCol="_v", numFeatures=num_features)
    vecs = htf.transform(df.select(doc, tokens))
    ent = vecs.select(doc, F.explode(vector_entries("_v")).alias("_e"))
    return ent.select(doc, F.col("_e.index").alias(bucket), F.col("_e.value").alias(out)) \
        .where(F.col(out) != 0)
