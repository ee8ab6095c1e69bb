"""Composite jobs: category distances from TF-IDF features (C1) and from word
embeddings (C2), and the symmetric distance matrix (C7)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspace.operators import categories as C
from topicspace.operators import text as TX
from topicspace.operators.common import bounded_broadcast
from topicspace.operators.labels import semi_filter
from topicspace.operators.tfidf import tfidf_model
from topicspace.operators.vectors import vector_dim, vector_sum
from topicspace.session import shared_dir


def category_tfidf_vectors(articles: DataFrame, categories: str, content: str = "content",
                           category: str = "category_id", num_features: int = 20,
                           how: str = "mean", keep: DataFrame | None = None) -> DataFrame:
    """Mean (or summed) hashed TF-IDF vector per category in **one pass** over
    the articles: ``(category, vec array<double>)``.

    TF-IDF is TF times a per-bucket weight, so a category's mean TF-IDF vector
    is its mean TF vector times the IDF weights. The stored entries of the TF
    vectors are summed by (category set, bucket), with one more bucket that counts
    the articles: articles share their sets, so the sums are few, and one path serves any
    number of buckets, whose rows are the non-zeros. The sums are checkpointed; from
    them come the document frequencies of all articles, ``idf = ln((m + 1) / (df + 1))``,
    and, once the sets are taken apart and ``keep`` (ids in column ``category``) is
    applied, the sums of the categories. The text is read once.
    """
    from pyspark.ml.feature import HashingTF, Tokenizer
    from topicspace.functions.vectors import vector_entries

    if how not in ("mean", "sum"):
        raise ValueError("how must be 'mean' or 'sum'")
    nf = num_features
    words = Tokenizer(inputCol=content, outputCol="_words").transform(
        articles.select(content, _category_set(articles, categories).alias("_set")))
    tf = HashingTF(inputCol="_words", outputCol="_tfv", numFeatures=nf).transform(words)
    one = F.array(F.struct(F.lit(-1).alias("index"), F.lit(1.0).alias("value")))
    entries = F.concat(one, F.filter(vector_entries("_tfv"), lambda e: e["value"] != 0))
    rows = tf.select("_set", F.explode(entries).alias("e")).select("_set", "e.index", "e.value")
    shared_dir(articles.sparkSession)
    sums = (rows.groupBy("_set", "index").agg(F.sum("value").alias("s"),
                                              F.count(F.lit(1)).alias("n"))
            .checkpoint(eager=True))
    total = sums.where("index = -1").agg(F.sum("n")).scalar()
    idf = (sums.where("index >= 0").groupBy("index").agg(F.sum("n").alias("n"))
           .select("index", F.log((total + 1.0) / (F.col("n") + 1.0)).alias("w")))
    own = sums.select(F.explode("_set").alias("c"), "index", "s", "n")
    if keep is not None:
        own = semi_filter(own, bounded_broadcast(keep.select(F.col(category).alias("c"))), "c")
    own = own.groupBy("c", "index").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    weighted = own.where("index >= 0").join(idf, "index").select(
        "c", "index", (F.col("s") * F.col("w")).alias("x"), F.lit(None).cast("bigint").alias("m"))
    zeros = own.where("index = -1").select(
        "c", F.explode(F.sequence(F.lit(0), F.lit(nf - 1))).alias("index"), F.lit(0.0).alias("x"),
        F.col("n").alias("m"))
    cells = weighted.unionByName(zeros).groupBy("c", "index").agg(F.sum("x").alias("x"),
                                                                  F.max("m").alias("m"))
    vecs = cells.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("index", "x"))).alias("e"),
                                  F.max("m").alias("m"))
    x = F.transform("e", lambda e: e["x"] / F.col("m") if how == "mean" else e["x"])
    return vecs.select(F.col("c").alias(category), x.alias("vec"))


def _category_set(articles: DataFrame, categories: str):
    """The article's different categories in order, an empty array for null: articles of
    the same categories have equal values."""
    kind = articles.schema[categories].dataType.simpleString()
    return F.array_sort(F.array_distinct(F.coalesce(F.col(categories), F.array().cast(kind))))


def category_distance_tfidf(articles: DataFrame, membership: DataFrame | None = None,
                            categories: str | None = None, keep: DataFrame | None = None,
                            names: DataFrame | None = None, article: str = "article_id",
                            content: str = "content", category: str = "category_id",
                            num_features: int = 20, how: str | Callable = "mean",
                            metric: str = "sqeuclidean", fused: bool | None = None) -> DataFrame:
    """C1: distances between categories from hashed TF-IDF article vectors.

    Tokenizer -> HashingTF(num_features) -> IDF over **all** articles (IDF counts
    every article, whatever its categories), then the mean vector per kept
    category, the pair distances of the upper triangle, names, ascending order.
    Output ``(name1, name2, distance)``; without ``names`` the category ids are
    the names.

    With the categories on the article row (``fused`` left as None) the category
    vectors come from one pass (``category_tfidf_vectors``); otherwise, and for a
    callable ``how`` (an aggregate over the articles' ``array<double>`` vectors), from
    the fitted ML pipeline (an IDF fitting pass, then a transform pass).
    """
    if fused is None:
        fused = categories is not None and not callable(how)
    if fused:
        cat_vecs = category_tfidf_vectors(articles, categories, content, category,
                                          num_features, how, keep)
        return _named_distances(cat_vecs, names, category, metric)
    model = tfidf_model(num_features, content, "features").fit(articles.select(content))
    feats = model.transform(articles)
    if callable(how):
        feats = feats.withColumn("features", vector_to_array("features"))
    if categories is not None:
        # categories sit on the article row: explode in place, no join
        rows = feats.select("features", F.explode(F.array_distinct(categories)).alias(category))
    else:
        rows = feats.select("features", article).join(
            membership.select(article, category).distinct(), article, "inner")
    if keep is not None:
        rows = semi_filter(rows, keep, category)
    cat_vecs = C.category_vectors(rows, "features", category=category, how=how)
    return _named_distances(cat_vecs, names, category, metric)


def _named_distances(cat_vecs: DataFrame, names: DataFrame | None, category: str,
                     metric) -> DataFrame:
    """Pair distances of category vectors, named and ascending."""
    pairs = C.pair_distances(cat_vecs, id=category, vec="vec", metric=metric)
    if names is None:
        named = pairs.select(F.col("cat1").alias("name1"), F.col("cat2").alias("name2"), "distance")
    else:
        named = C.name_pairs(pairs, names, id=category)
    return C.sort_distances(named)


def category_distance_embedding(articles: DataFrame, word_vectors: DataFrame,
                                membership: DataFrame | None = None,
                                categories: str | None = None, keep: DataFrame | None = None,
                                names: DataFrame | None = None, article: str = "article_id",
                                content: str = "content", category: str = "category_id",
                                vocab_size: int = 20000, skip_top: int = 10,
                                how: str | Callable = "sum", metric: str = "sqeuclidean",
                                min_len: int = 3, vocab_weight: str = "article",
                                vocab: DataFrame | None = None) -> DataFrame:
    """C2: distances between categories from word-embedding article vectors.

    Articles are tokenised into words, a vocabulary of the most frequent words
    of all articles is built (``skip_top`` most frequent dropped, ``vocab_size`` cap),
    every in-vocabulary word is looked up by name in ``word_vectors(word, vec)``, an
    article vector is the sum of its word vectors over the whole text, and a category
    vector is the sum (``how='sum'``, as published) or mean of its articles.
    Output ``(name1, name2, distance)`` ascending.

    A sum of sums is linear, so no article vector is built. With the categories on the
    article row every text is tokenised once: words are counted by (category set, word),
    a small table that gives the vocabulary and, once the sets are taken apart, the
    counts by (category, word); each different word is looked up once and one weighted
    vector sum gives the category vectors. ``how='mean'`` divides by the category's articles
    that hold a word with a vector; a callable ``how`` gets the article vectors themselves.

    ``vocab_weight='article'`` counts each article once when ranking words;
    ``'membership'`` counts it once per category it belongs to (the original's
    labelled-text expansion; needs ``categories``). A vocabulary ``(word, ...)`` that is
    already at hand is passed as ``vocab``.
    """
    if vocab_weight not in ("article", "membership"):
        raise ValueError("vocab_weight must be 'article' or 'membership'")
    if vocab_weight == "membership" and categories is None:
        raise ValueError("vocab_weight='membership' needs the categories column")
    by_set = None
    if categories is not None and not callable(how):
        toks = TX.tokenize(articles.select(content, _category_set(articles, categories).alias("_set")),
                           content, "tokens", "words", min_len)
        shared_dir(articles.sparkSession)
        by_set = (toks.select("_set", F.explode_outer("tokens").alias("word"))
                  .where(F.col("word").isNotNull())
                  .groupBy("_set", "word").agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True))
    if vocab is None:
        vocab = TX.vocabulary(
            _word_counts(articles, by_set, content, categories, vocab_weight, min_len), vocab_size,
            skip_top=skip_top)
    dim = vector_dim(word_vectors, "vec")  # from the small vector table, not the corpus
    kept_ids = None if keep is None else bounded_broadcast(keep.select(category))
    if categories is not None:
        # the article's categories ride along on its row: no membership join
        member = articles.select(article, content, F.explode(F.array_distinct(categories))
                                 .alias(category))
    else:
        member = articles.select(article, content).join(
            membership.select(article, category).distinct(), article, "inner")
    if keep is not None:
        member = semi_filter(member, kept_ids, category)
    # read twice below; one row for each vocabulary word that has a vector
    vectors = word_vectors.join(bounded_broadcast(vocab.select("word")), "word").select("word", "vec")
    kept = TX.tokenize(member, content, "tokens", "words", min_len)
    if callable(how):
        words = kept.select(category, article, F.explode_outer("tokens").alias("word"))
        counted = words.groupBy(category, article, "word").agg(F.count(F.lit(1)).alias("_n"))
        docs = vector_sum(counted.join(bounded_broadcast(vectors), "word"), [category, article],
                          "vec", dim=dim, weight="_n")
        return _named_distances(C.category_vectors(docs.select(category, "vec"), "vec",
                                                   category=category, how=how, dim=dim),
                                names, category, metric)
    if by_set is not None:
        counted = by_set.select(F.explode("_set").alias(category), "word", "_n")
        if keep is not None:
            counted = semi_filter(counted, kept_ids, category)
        counted = counted.groupBy(category, "word").agg(F.sum("_n").alias("_n"))
    else:
        words = (kept.select(category, F.explode_outer("tokens").alias("word"))
                 .where(F.col("word").isNotNull()))
        counted = words.groupBy(category, "word").agg(F.count(F.lit(1)).alias("_n"))
    cat_vecs = vector_sum(counted.join(vectors, "word"), category, "vec", dim=dim, weight="_n")
    if how == "mean":
        known = kept.select(category, article, F.explode_outer(F.array_distinct("tokens")).alias("word"))
        sizes = (known.join(bounded_broadcast(vectors.select("word")), "word", "left_semi")
                 .select(category, article).distinct()
                 .groupBy(category).agg(F.count(F.lit(1)).alias("_m")))
        cat_vecs = cat_vecs.join(sizes, category).select(
            category, F.transform("vec", lambda x: x / F.col("_m")).alias("vec"))
    elif how != "sum":
        raise ValueError("how must be 'sum', 'mean' or a callable")
    return _named_distances(cat_vecs, names, category, metric)


def _word_counts(articles: DataFrame, by_set: DataFrame | None, content: str,
                 categories: str | None, vocab_weight: str, min_len: int) -> DataFrame:
    """Word counts of all articles, from the counts by category set where they are at hand."""
    if by_set is not None:
        n = F.col("_n") if vocab_weight == "article" else F.col("_n") * F.size("_set")
        return (by_set.groupBy("word").agg(F.sum(n).cast("bigint").alias("cnt"))
                .where(F.col("cnt") > 0))
    cols = [content, *([categories] if categories else [])]
    counted = TX.tokenize(articles.select(*cols), content, "tokens", "words", min_len)
    weight = None
    if vocab_weight == "membership":
        counted, weight = counted.withColumn("_w", F.size(F.array_distinct(categories))), "_w"
    return TX.word_counts(counted, "tokens", weight=weight)


def distance_matrix(distances: DataFrame, labels: Sequence[str], fill: float = 0.0) -> DataFrame:
    """C7: the symmetric label x label matrix of named distances."""
    return C.distance_matrix(distances, labels, fill=fill)
