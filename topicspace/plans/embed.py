"""Learning word embeddings (C6).

The original trains skip-gram embeddings with sampled softmax in a
single-process deep-learning tool. Here it is re-aimed at Spark ML's
distributed ``Word2Vec`` (skip-gram, hierarchical softmax) with the same
vocabulary rule: the ``vocab_size - 1`` most frequent words, every other word
encoded as ``UNK``; vectors are L2-normalised and written as text lines."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspace.operators import text as TX
from topicspace.operators.vectors import l2_normalize

NUM_PARTITIONS = 8


def unk_encoded_tokens(docs: DataFrame, doc: str, tokens: str, vocab_size: int,
                       out: str = "tokens") -> DataFrame:
    """Replace words outside the top ``vocab_size - 1`` by ``UNK``, keeping order."""
    vocab = TX.vocabulary(TX.word_counts(docs, tokens), vocab_size, unk=True)
    enc = TX.encode(docs, doc, tokens, vocab.where(F.col("idx") > 0), oov="unk")
    enc = enc.withColumn("word", F.when(F.col("idx") == 0, F.lit(TX.UNK)).otherwise(F.col("word")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), F.col("word").alias("w"))))
    return enc.groupBy(doc).agg(ordered.alias("_s")).select(
        doc, F.transform("_s", lambda s: s["w"]).alias(out))


def learn_embeddings(docs: DataFrame, doc: str = "article_id", text: str = "text",
                     vocab_size: int = 10000, dim: int = 100, window: int = 1,
                     min_count: int = 1, max_iter: int = 1, seed: int = 0,
                     num_partitions: int = NUM_PARTITIONS) -> DataFrame:
    """``(word, vec array<double>)`` with unit-length vectors, one row per
    vocabulary word (``UNK`` included). Training runs in ``num_partitions``
    parallel tasks; the number is part of the model (their results are averaged),
    so it does not follow the cluster. Texts are trained on whole, never cut."""
    toks = TX.tokenize(docs.select(doc, text), text, "tokens", "stream")
    enc = unk_encoded_tokens(toks, doc, "tokens", vocab_size)
    longest = toks.agg(F.max(F.size("tokens")).alias("n")).first()["n"] or 1
    w2v = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, maxIter=max_iter,
                   seed=seed, numPartitions=num_partitions, maxSentenceLength=max(1, longest),
                   inputCol="tokens", outputCol="_v")
    model = w2v.fit(enc)
    vecs = model.getVectors().select("word", vector_to_array("vector").alias("vec"))
    return l2_normalize(vecs, "vec")
