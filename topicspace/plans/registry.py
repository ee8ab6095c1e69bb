"""Registered queries over the driver's tables, one per operator or job of the
inventory. Each takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the SQL of the same name in ``topicspace.plans.oracles``.

Doubles that come out of sums are passed through ``stable`` (float precision),
so the same value summed in another order compares equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspace.functions.text import normalize_title
from topicspace.functions.vectors import stable
from topicspace.operators import categories as C
from topicspace.operators import labels as L
from topicspace.operators import text as TX
from topicspace.operators import tfidf as TF
from topicspace.operators.common import bounded_broadcast, to_long
from topicspace.operators.evaluation import class_scores, topk_accuracy as _topk
from topicspace.operators.sampling import hash_sample as _hash_sample
from topicspace.operators.sampling import hash_split as _hash_split
from topicspace.operators.skipgram import skipgrams
from topicspace.operators.vectors import (document_vectors, l2_normalize as _l2, vector_dim,
                                          vector_sum, vectorize)
from topicspace.plans import jobs
from topicspace.plans.materialize import commit, materialize, result_path, saved
from topicspace.session import shared_dir
from topicspace.sources import files as SF
from topicspace.sources import tables as TB
from topicspace.sources.writers import (word_vector_lines, write_csv, write_text,
                                        write_word_vectors)

Query = Callable[[SparkSession, str], DataFrame]


# Parameters of the registered queries.
TRIM_SKIP, TRIM_CAP = 10, 2000          # trimmed vocabulary: drop 10 most frequent, cap 2000
UNK_CAP = 1000                          # vocabulary with the unknown-word slot
SEQUENCE_LEN = 1000                     # fixed sequence length, as the original job
HASH_BUCKETS = 20                       # hashed term buckets, as the original job
SPARSE_BUCKETS = 1 << 18                # Spark ML's default bucket count
EMBED_VOCAB, EMBED_SKIP = 20000, 10     # vocabulary of the embedding distance job
SPLIT_WEIGHTS = (0.8, 0.1, 0.1)
SAMPLE_FRACTION = 0.2
TOP_K = 5
NEAREST_K = 3
MEDIAN_STEPS = 8                        # Weiszfeld steps
CLOSE_WITHIN = 1.15                     # distance of the approximate pair join
MATRIX_LABELS = [f"label{i}" for i in range(10)]   # columns of the wide matrix


def _arts(spark, sf):
    return TB.articles(spark, sf)


def _content_tokens(spark, sf, method="words"):
    return TX.tokenize(_arts(spark, sf).select("article_id", "content"), "content", "tokens", method)


def _trimmed_vocab(spark, sf):
    toks = _content_tokens(spark, sf)
    return TX.vocabulary(TX.word_counts(toks), TRIM_CAP, skip_top=TRIM_SKIP), toks


def _stream_tokens(spark, sf):
    docs = TB.table(spark, sf, "documents")
    return TX.tokenize(docs.select(F.col("doc_id").alias("article_id"), "text"),
                       "text", "tokens", "stream")


def _long_tokens(toks):
    return (toks.select("article_id", F.posexplode_outer("tokens").alias("pos", "token"))
            .where(F.col("pos").isNotNull()))


# --- sources and projections -------------------------------------------------

def corpus_articles(spark, sf):
    return _arts(spark, sf)


def corpus_file_roundtrip(spark, sf):
    """Write the documents as a blank-line separated corpus file (in doc_id
    order) to the shared folder, parse it back: a repeated title keeps its last
    article."""
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = TB.table(spark, sf, "documents").orderBy("doc_id")
    write_text(docs, "text", path, line_sep="\n\n")
    return SF.read_corpus(spark, path)


def _roundtrip_dir(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def article_dictionary_roundtrip(spark, sf):
    """Write ``title id`` lines (title in key form, doc_id order), read them with
    the dictionary reader: a repeated title keeps its last id."""
    path = _roundtrip_dir(spark, "articles_dict")
    lines = _arts(spark, sf).orderBy("article_id").select(
        F.concat_ws(" ", normalize_title("title"), F.col("article_id").cast("string")).alias("l"))
    write_text(lines, "l", path)
    return SF.read_article_dictionary(spark, path)


def membership_file_roundtrip(spark, sf):
    """Write ``article cat cat`` lines with dense category ids, read them with the
    membership reader."""
    path = _roundtrip_dir(spark, "categories")
    dictionary = L.category_dictionary(TB.membership(spark, sf), "category", "category_id")
    ids = TB.membership(spark, sf).join(bounded_broadcast(dictionary), "category")
    lines = ids.groupBy("article_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.col("category_id").cast("string"))), " ").alias("c"))
    write_text(lines.select(F.concat_ws(" ", F.col("article_id").cast("string"), "c").alias("l")),
               "l", path)
    return SF.read_membership(spark, path)


def word_vectors_roundtrip(spark, sf):
    """Write the vectors as word-vector text lines, read them back for a
    vocabulary: ``(idx, dim, value)``."""
    path = _roundtrip_dir(spark, "vectors")
    vecs = TB.labelled_vectors(spark, sf).select(
        F.concat(F.lit("W"), F.col("vec_id").cast("string")).alias("word"), "vec")
    write_word_vectors(vecs, path, mode="overwrite")
    vocab = TB.labelled_vectors(spark, sf).select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
        F.col("vec_id").cast("int").alias("idx"))
    back = SF.word_vectors_for_vocabulary(SF.read_word_vectors(spark, path, 64), vocab)
    return to_long(back.select("idx", F.col("vec").cast("array<double>").alias("vec")), ["idx"], "vec")


def title_normalize(spark, sf):
    return _arts(spark, sf).select("article_id", normalize_title("title").alias("title"))


def membership_explode(spark, sf):
    return TB.membership(spark, sf)


def dictionary_last_wins(spark, sf):
    ev = TB.table(spark, sf, "events").select(
        "user_id", "event_type", "value", F.struct("ts", "event_id").alias("_order"))
    return SF.last_wins(ev, "user_id", "_order")


def dense_category_labels(spark, sf):
    cats = TB.membership(spark, sf).select("category").distinct()
    return L.dense_labels(cats, "category", out="label")


def lookup_with_default(spark, sf):
    docs = TB.table(spark, sf, "documents").select("doc_id")
    return L.lookup(docs, TB.table(spark, sf, "labels"), "doc_id", "quality", default=-1)


def filter_categories(spark, sf):
    return L.semi_filter(TB.membership(spark, sf), TB.category_filter(spark), "category")


def labelled_articles(spark, sf):
    """Articles -> categories -> dense labels of the filter list; categories
    outside the list get label 0 and are dropped."""
    labels = L.dense_labels(TB.category_filter(spark), "category", out="label")
    arts = _arts(spark, sf).select("article_id")
    return L.label_articles(arts, TB.membership(spark, sf), labels, category="category")


# --- text ----------------------------------------------------------------------

def tokenize_words(spark, sf):
    return _long_tokens(_content_tokens(spark, sf, "words"))


def tokenize_whitespace(spark, sf):
    return _long_tokens(_content_tokens(spark, sf, "whitespace"))


def word_count(spark, sf):
    return TX.word_counts(_content_tokens(spark, sf))


def vocabulary_trimmed(spark, sf):
    return _trimmed_vocab(spark, sf)[0]


def vocabulary_unk(spark, sf):
    return TX.vocabulary(TX.word_counts(_stream_tokens(spark, sf)), UNK_CAP, unk=True)


def unk_count(spark, sf):
    toks = _stream_tokens(spark, sf)
    vocab = TX.vocabulary(TX.word_counts(toks), UNK_CAP, unk=True)
    return TX.unk_count(TX.encode(toks, "article_id", "tokens", vocab, oov="unk"))


def _sequences(spark, sf):
    vocab, toks = _trimmed_vocab(spark, sf)
    enc = TX.encode(toks, "article_id", "tokens", vocab, oov="drop")
    return TX.index_sequences(enc, "article_id")


def _seq_text(df, col="seq"):
    return df.select("article_id", F.array_join(F.col(col).cast("array<string>"), " ").alias("seq"))


def token_index_sequence(spark, sf):
    return _seq_text(_sequences(spark, sf))


def pad_or_truncate(spark, sf):
    return _seq_text(TX.pad(_sequences(spark, sf), "seq", SEQUENCE_LEN, side="post"))


def word_vector_lookup(spark, sf):
    vocab, _ = _trimmed_vocab(spark, sf)
    wv = vocab.select("word", "idx").join(TB.word_vectors(spark, sf), "idx", "inner")
    return to_long(wv.select("word", "idx", F.col("vec").cast("array<double>").alias("vec")),
                   ["word", "idx"], "vec")


def document_vector_sum(spark, sf):
    vocab, toks = _trimmed_vocab(spark, sf)
    enc = TX.encode(toks, "article_id", "tokens", vocab, oov="drop")
    wv = TB.word_vectors(spark, sf)
    dv = document_vectors(enc, wv, doc="article_id", dim=vector_dim(wv, "vec"))
    return to_long(dv, ["article_id"], "vec").select("article_id", "dim", stable("value").alias("value"))


# --- tf-idf --------------------------------------------------------------------

def _tf(spark, sf):
    """Term counts. The texts are brought together by id once, before they become many more
    bytes of (article, term) rows; the counts then need no exchange of their own."""
    texts = _arts(spark, sf).select("article_id", "content").repartition("article_id")
    return TF.term_frequency(TX.tokenize(texts, "content", "tokens", "whitespace"),
                             "article_id", "tokens")


def term_frequency(spark, sf):
    return _tf(spark, sf)


def document_frequency(spark, sf):
    return TF.document_frequency(_tf(spark, sf))


def _n_docs(spark, sf):
    return TB.table(spark, sf, "documents").count()


def idf_weights(spark, sf):
    w = TF.idf_weights(TF.document_frequency(_tf(spark, sf)), _n_docs(spark, sf))
    return w.select("term", "df", stable("idf").alias("idf"))


def tfidf_exact(spark, sf):
    tf = _tf(spark, sf)
    w = TF.tfidf(tf, TF.idf_weights(TF.document_frequency(tf), _n_docs(spark, sf)))
    return w.select("article_id", "term", stable("tfidf").alias("tfidf"))


def hashing_tf_sparse(spark, sf):
    """Hashed term counts with 2^18 buckets, read from the sparse vectors'
    non-zeros (no dense expansion)."""
    return TF.hashed_term_frequency(_content_tokens(spark, sf, "whitespace"), "article_id",
                                    "tokens", SPARSE_BUCKETS)


def hashing_tf(spark, sf):
    return TF.hashed_term_frequency(_content_tokens(spark, sf, "whitespace"), "article_id",
                                    "tokens", HASH_BUCKETS)


# --- categories ------------------------------------------------------------------

def _centroids(spark, sf, how):
    return vector_sum(TB.labelled_vectors(spark, sf), "label", "vec", how=how)


def _centroids_long(spark, sf, how):
    return to_long(_centroids(spark, sf, how), ["label"], "vec").select(
        "label", "dim", stable("value").alias("value"))


def category_centroid_mean(spark, sf):
    return _centroids_long(spark, sf, "mean")


def category_centroid_sum(spark, sf):
    return _centroids_long(spark, sf, "sum")


def _pairs(spark, sf):
    return C.pair_distances(_centroids(spark, sf, "mean"), id="label", vec="vec")


def category_pair_distance(spark, sf):
    return _pairs(spark, sf).select("cat1", "cat2", stable("distance").alias("distance"))


def _named(spark, sf):
    names = TB.label_names(TB.labelled_vectors(spark, sf))
    return C.name_pairs(_pairs(spark, sf), names, id="label")


def named_distances_sorted(spark, sf):
    """Named distances with their place in the ascending order."""
    placed = L.dense_labels(_named(spark, sf), ["distance", "name1", "name2"], out="position")
    return placed.select("position", "name1", "name2", stable("distance").alias("distance"))


def category_distance_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship (C1): TF-IDF category distances over the wiki view."""
    arts = TB.articles(spark, sf, with_categories=True)
    res = jobs.category_distance_tfidf(arts, categories="categories",
                                       keep=TB.category_filter(spark), category="category",
                                       num_features=HASH_BUCKETS)
    return res.select("name1", "name2", stable("distance").alias("distance"))


def _word_vector_file(spark, sf):
    """The vocabulary of the embedding job and a word-vector file for it, read back: the
    word of rank r has the vector of row r modulo the number of vectors. The file is written
    once for its inputs."""
    params = {"vocab": EMBED_VOCAB, "skip": EMBED_SKIP}
    inputs = [f"{sf.rstrip('/')}/{t}.parquet" for t in ("documents", "embeddings")]
    vecs = TB.word_vectors(spark, sf)

    def named():
        counts = TX.word_counts(_content_tokens(spark, sf))
        vocab = TX.vocabulary(counts, EMBED_VOCAB, skip_top=EMBED_SKIP)
        return (vocab.withColumn("_at", (F.col("idx") % F.lit(vecs.count())).cast("int"))
                .join(vecs.withColumnRenamed("idx", "_at"), "_at", "left").select("word", "idx", "vec"))

    vocab = materialize(spark, "embedding-vocabulary", named, params, inputs=inputs)
    path = result_path(spark, "word-vectors", params, inputs=inputs)
    if not saved(spark, path):
        made = _roundtrip_dir(spark, "word-vectors")
        write_word_vectors(vocab.where(F.col("vec").isNotNull()).select("word", "vec"), made)
        commit(spark, made, path)
    read = SF.read_word_vectors(spark, path, vector_dim(vecs, "vec"), encoding="UTF-8")
    return vocab.select("word", "idx"), SF.last_wins(read, "word")


def category_distance_embedding(spark, sf):
    """C2 with the vectors of a word-vector file, looked up by word."""
    shared_dir(spark)
    vocab, vectors = _word_vector_file(spark, sf)
    arts = TB.articles(spark, sf, with_categories=True)
    res = jobs.category_distance_embedding(arts, vectors, categories="categories",
                                           keep=TB.category_filter(spark), category="category",
                                           how="sum", vocab=vocab)
    return res.select("name1", "name2", stable("distance").alias("distance"))


def blocked_pair_distance(spark, sf):
    vecs = TB.labelled_vectors(spark, sf)
    res = C.pair_distances(vecs, id="vec_id", vec="vec", id1="id1", id2="id2")
    return res.select("id1", "id2", stable("distance").alias("distance"))


def distance_matrix(spark, sf):
    """The symmetric matrix in long form, for any number of labels."""
    names = TB.label_names(TB.labelled_vectors(spark, sf))
    return C.symmetric_distances(_named(spark, sf), names).select(
        "name1", "name2", stable("distance").alias("distance"))


def distance_matrix_wide(spark, sf):
    """The matrix of a given label list, one column for each label."""
    return jobs.distance_matrix(_named(spark, sf).select(
        "name1", "name2", stable("distance").alias("distance")), MATRIX_LABELS)


def nearest_categories(spark, sf):
    """The nearest other categories of each, straight from the category vectors."""
    named = _centroids(spark, sf, "mean").join(TB.label_names(TB.labelled_vectors(spark, sf)), "label")
    res = C.nearest_vectors(named, NEAREST_K, id="name", vec="vec", id1="name1", id2="name2")
    return res.select("name1", "name2", stable("distance").alias("distance"), "rank")


def nearest_vectors(spark, sf):
    """The nearest other rows of every row of the vector table."""
    res = C.nearest_vectors(TB.labelled_vectors(spark, sf), NEAREST_K, id="vec_id", vec="vec",
                            id1="id1", id2="id2")
    return res.select("id1", "id2", stable("distance").alias("distance"), "rank")


def rating_triples(spark, sf):
    """Named TF-IDF distances -> (user, item, rating) through the category
    dictionary (unknown name -> id 0)."""
    dist = jobs.category_distance_tfidf(TB.articles(spark, sf, with_categories=True),
                                        categories="categories", keep=TB.category_filter(spark),
                                        category="category", num_features=HASH_BUCKETS)
    dictionary = L.category_dictionary(TB.membership(spark, sf), "category", "category_id")
    u = L.lookup(dist, dictionary.select(F.col("category").alias("name1"),
                                         F.col("category_id").alias("user")), "name1", "user", 0)
    i = L.lookup(u, dictionary.select(F.col("category").alias("name2"),
                                      F.col("category_id").alias("item")), "name2", "item", 0)
    return i.select("user", "item", stable("distance").alias("rating"))


# --- vectors -------------------------------------------------------------------

def l2_normalize(spark, sf):
    v = _l2(TB.labelled_vectors(spark, sf), "vec")
    return to_long(v, ["vec_id"], "vec").select("vec_id", "dim", stable("value").alias("value"))


def embedding_text_rows(spark, sf):
    """Word-vector text lines; values scaled to integers so the text is exact."""
    v = TB.labelled_vectors(spark, sf).select(
        F.concat(F.lit("W"), F.col("vec_id").cast("string")).alias("word"),
        F.transform("vec", lambda x: F.round(x.cast("double") * 1e6).cast("bigint")).alias("vec"))
    return word_vector_lines(v, "word", "vec", out="line")


def skipgram_pairs(spark, sf):
    return skipgrams(_stream_tokens(spark, sf), "article_id", "tokens", window=1, num_skips=2)


# --- samples and evaluation ------------------------------------------------------

def hash_split(spark, sf):
    docs = TB.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"))
    return _hash_split(docs, "article_id", SPLIT_WEIGHTS)


def hash_sample(spark, sf):
    docs = TB.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"))
    return _hash_sample(docs, "article_id", SAMPLE_FRACTION)


def topk_accuracy(spark, sf):
    vecs = TB.labelled_vectors(spark, sf)
    scored = class_scores(vecs, _centroids(spark, sf, "mean"), vec="vec", label="label")
    res = _topk(scored, TOP_K)
    return res.select("k", stable("accuracy").alias("accuracy"), "n")


def topk_accuracy_ranks(spark, sf):
    """Same result as ``topk_accuracy`` through the path for class models of any size
    (rows meet blocks of classes)."""
    from topicspace.operators.evaluation import topk_accuracy_from_ranks, true_class_ranks
    ranked = true_class_ranks(TB.labelled_vectors(spark, sf), _centroids(spark, sf, "mean"))
    res = topk_accuracy_from_ranks(ranked, TOP_K)
    return res.select("k", stable("accuracy").alias("accuracy"), "n")


def category_distance_tfidf_pipeline(spark, sf):
    """The flagship through the fitted ML pipeline (IDF fitting pass + transform
    pass) instead of the one-pass aggregate: same result."""
    arts = TB.articles(spark, sf, with_categories=True)
    res = jobs.category_distance_tfidf(arts, categories="categories",
                                       keep=TB.category_filter(spark), category="category",
                                       num_features=HASH_BUCKETS, fused=False)
    return res.select("name1", "name2", stable("distance").alias("distance"))


def category_pair_cosine(spark, sf):
    res = C.pair_distances(_centroids(spark, sf, "mean"), id="label", vec="vec", metric="cosine")
    return res.select("cat1", "cat2", stable("distance").alias("distance"))


def document_vector_mean(spark, sf):
    vocab, toks = _trimmed_vocab(spark, sf)
    enc = TX.encode(toks, "article_id", "tokens", vocab, oov="drop")
    wv = TB.word_vectors(spark, sf)
    dv = document_vectors(enc, wv, doc="article_id", dim=vector_dim(wv, "vec"), how="mean")
    return to_long(dv, ["article_id"], "vec").select("article_id", "dim", stable("value").alias("value"))


def materialize_once(spark, sf):
    """Word counts through load-or-compute: the second call reads the saved copy."""
    params = {"query": "word_count"}
    inputs = [f"{sf.rstrip('/')}/documents.parquet"]
    materialize(spark, "word_count", lambda: word_count(spark, sf), params, inputs=inputs)
    return materialize(spark, "word_count", lambda: word_count(spark, sf), params, inputs=inputs)


# --- files and composed views -----------------------------------------------------

def corpus_title_join(spark, sf):
    """Corpus file and article dictionary file, both written from the documents and read
    back; articles get their ids by title, then the labels of their categories.
    ``(article_id, label)``; a title the dictionary lacks has id -1 and no label."""
    corpus = corpus_file_roundtrip(spark, sf)
    ids = L.articles_with_ids(corpus, article_dictionary_roundtrip(spark, sf))
    labels = L.dense_labels(TB.category_filter(spark), "category", out="label")
    return L.label_articles(ids.select("article_id"), TB.membership(spark, sf), labels,
                            category="category").select(F.col("article_id").cast("bigint"), "label")


def vectorized_sequences(spark, sf):
    """Text vectorisation: vocabulary, index sequence, padding to the fixed length, one
    vector per position (zero for padding). Of each article: its positions, and of each
    dimension the sum of the values, each times its position, so that a value at another
    position or dimension shows."""
    vocab, toks = _trimmed_vocab(spark, sf)
    enc = TX.encode(toks, "article_id", "tokens", vocab, oov="drop")
    seqs = TX.pad(TX.index_sequences(enc, "article_id"), "seq", SEQUENCE_LEN)
    wv = TB.word_vectors(spark, sf).where("idx > 0")  # 0 is the padding
    dim = vector_dim(wv, "vec")
    vecs = vectorize(seqs, wv, dim, doc="article_id")
    placed = vecs.withColumn("_w", F.col("pos") + 1)
    sums = vector_sum(placed, "article_id", "vec", dim=dim, weight="_w", count="w")
    return to_long(sums, ["article_id", "w"], "vec").select(
        "article_id", F.col("w").cast("bigint").alias("weights"), "dim",
        stable("value").alias("value"))


def skipgram_stream(spark, sf):
    """Skip-gram pairs over the running word stream of all documents in doc_id order."""
    from topicspace.operators.word_stream import stream_skipgrams
    return stream_skipgrams(_stream_tokens(spark, sf), "article_id", "tokens", window=EMBED_WINDOW)


def category_geometric_median(spark, sf):
    """A reducer that is no Column aggregate: Weiszfeld steps towards the point with the
    smallest summed distance to a label's vectors."""
    from topicspace.operators.reducers import geometric_medians
    vecs = geometric_medians(TB.labelled_vectors(spark, sf), "label", "vec", MEDIAN_STEPS)
    return to_long(vecs, ["label"], "vec").select("label", "dim", stable("value").alias("value"))


def category_midrange(spark, sf):
    """The middle between smallest and largest value, by a mergeable reducer in one pass."""
    from topicspace.operators.reducers import Midrange, reduce_vectors
    vecs = reduce_vectors(TB.labelled_vectors(spark, sf), "label", "vec", Midrange())
    return to_long(vecs, ["label"], "vec").select("label", "dim", stable("value").alias("value"))


def close_pairs_checked(spark, sf):
    """Pairs of vectors within a distance by bucketed random projections: how many there
    are, whether at least 0.9 of them are found, and whether all that is found is right."""
    vecs = TB.labelled_vectors(spark, sf)
    found = C.close_pairs(vecs, CLOSE_WITHIN, id="vec_id", vec="vec", id1="id1", id2="id2")
    exact = C.pair_distances(vecs, id="vec_id", vec="vec", metric="euclidean", id1="id1", id2="id2",
                             within=CLOSE_WITHIN)
    both = exact.join(found.select("id1", "id2", F.lit(1).alias("hit")).distinct(),
                      ["id1", "id2"], "full")
    return both.agg(F.count("distance").alias("n"),
                    (F.count(F.when(F.col("distance").isNotNull(), F.col("hit")))
                     >= 0.9 * F.count("distance")).alias("recalled"),
                    (F.count_if(F.col("distance").isNull()) == 0).alias("sound"))


def centroid_csv_roundtrip(spark, sf):
    """Named category centroids written as ``name,f1,...,fd`` lines and read back."""
    names = TB.label_names(TB.labelled_vectors(spark, sf))
    named = _centroids(spark, sf, "mean").join(names, "label")
    path = _roundtrip_dir(spark, "centroids")
    write_text(named.select(F.concat_ws(",", "name", F.array_join(
        F.transform("vec", lambda x: x.cast("string")), ",")).alias("l")), "l", path)
    return to_long(SF.read_centroids(spark, path), ["name"], "vec").select(
        "name", "dim", stable("value").alias("value"))


def category_files_roundtrip(spark, sf):
    """Category names and a category filter written as files and read back: the names of
    the listed categories."""
    dictionary = L.category_dictionary(TB.membership(spark, sf), "category", "category_id")
    names, listed = _roundtrip_dir(spark, "names"), _roundtrip_dir(spark, "filter")
    write_text(dictionary.select(F.concat_ws("\t", "category", F.col("category_id").cast("string"))
                                 .alias("l")), "l", names)
    keep = L.semi_filter(dictionary, TB.category_filter(spark), "category")
    write_text(keep.select(F.concat_ws(" ", F.col("category_id").cast("string"), "category")
                           .alias("l")), "l", listed)
    return L.semi_filter(SF.read_category_names(spark, names),
                         SF.read_category_filter(spark, listed), "category_id")


def rejected_membership_lines(spark, sf):
    """Membership lines of which some hold no ids: the lines that are read and those that
    are rejected, by kind."""
    path = _roundtrip_dir(spark, "membership-lines")
    lines = TB.table(spark, sf, "documents").select(F.concat_ws(
        " ", F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.lit("x")),
        F.when(F.col("doc_id") % 5 == 0, F.lit("1.5")),
        F.length("text").cast("string")).alias("l"))
    write_text(lines, "l", path)
    read = SF.read_membership(spark, path, bad_lines="drop").select(
        F.lit("read").alias("kind"), F.col("article_id").cast("string").alias("line"))
    bad = SF.rejected_lines(spark, path, "membership").select(
        F.lit("rejected").alias("kind"), F.col("value").alias("line"))
    return read.unionByName(bad)


def single_file_output(spark, sf):
    """Category counts written as one file and read back, with the number of files."""
    path = _roundtrip_dir(spark, "single")
    counts = TB.membership(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    write_csv(counts, path, single_file=True)
    back = spark.read.schema("category string, n bigint").csv(path)
    files = len(set(back.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]))
    return back.withColumn("files", F.lit(files).cast("int"))


def distance_csv_roundtrip(spark, sf):
    """Named distances written as CSV, read back, with their place by the first name."""
    path = _roundtrip_dir(spark, "distances")
    write_csv(_named(spark, sf).select("name1", "name2", "distance"), path)
    placed = L.dense_labels(SF.read_distance_triples(spark, path), ["name1", "name2"],
                            out="position")
    return placed.select("position", "name1", "name2", stable("distance").alias("distance"))


def reversed_dictionary(spark, sf):
    """The category dictionary turned round: id -> name, for the categories' members."""
    dictionary = L.category_dictionary(TB.membership(spark, sf), "category", "category_id")
    back = L.reverse(dictionary, "category", "category_id")  # the columns swap their values
    return back.select(F.col("category").alias("category_id"), F.col("category_id").alias("name"))


# --- models: results, then what the input alone decides about them ------------------

ALS_RANK, ALS_ITER, ALS_REG, SEED = 8, 6, 0.01, 0
EMBED_DIM, EMBED_WINDOW, LEARN_VOCAB = 100, 1, 10000
EMBED_STEPS, EMBED_EPOCHS = 8, 1        # shares of the pairs, times through them
EMBED_RATE, EMBED_SPREAD = 0.2, 0.02    # for a few large steps
OWN_WORD_COUNT, GROUP_WORDS = 100, 10   # checked: words that occur so often, so many of a language
CONV_LAYERS = {"channels": 32, "hidden": 64}
CONV_EPOCHS, CONV_BATCHES, CONV_RATE = 4, 8, 0.03


def _recommendations(spark, sf, side):
    from topicspace.plans import recommend as R
    dist = jobs.category_distance_tfidf(TB.articles(spark, sf, with_categories=True),
                                        categories="categories", keep=TB.category_filter(spark),
                                        category="category", num_features=HASH_BUCKETS)
    dictionary = L.category_dictionary(TB.membership(spark, sf), "category", "category_id") \
        .withColumnRenamed("category", "name")
    ratings = R.ratings_from_distances(dist, dictionary)
    model = R.fit_recommender(ratings, ALS_RANK, ALS_ITER, ALS_REG, seed=SEED)
    keep = L.semi_filter(dictionary, TB.category_filter(spark).withColumnRenamed("category", "name"),
                         "name")
    return R.recommend(model, TOP_K, side=side, keep=keep, names=dictionary)


def recommend_users_for_items(spark, sf):
    return _recommendations(spark, sf, "users_for_items")


def recommend_items_for_users(spark, sf):
    return _recommendations(spark, sf, "items_for_users")


def _labelled_content(spark, sf):
    labels = L.dense_labels(TB.category_filter(spark), "category", out="label")
    arts = _arts(spark, sf).select("article_id", "content")
    return L.label_articles(arts, TB.membership(spark, sf), labels, category="category")


def _trained(spark, sf):
    """The convolutional classifier on word-vector sequences, trained once for its inputs,
    and the test part of the labelled articles."""
    from topicspace.operators.sampling import split_parts
    from topicspace.plans import sequence_classifier as K
    params = {"layers": CONV_LAYERS, "epochs": CONV_EPOCHS, "batches": CONV_BATCHES,
              "rate": CONV_RATE, "seed": SEED}
    inputs = [f"{sf.rstrip('/')}/{t}.parquet" for t in ("documents", "embeddings")]
    vocab = materialize(spark, "classifier-vocabulary", lambda: _trimmed_vocab(spark, sf)[0], params,
                        inputs=inputs)
    wv = TB.word_vectors(spark, sf)
    vectors = K.vector_table(wv, vocab, vector_dim(wv, "vec"))
    sequences = K.Sequences(vocab, vectors, SEQUENCE_LEN)
    docs = _labelled_content(spark, sf)
    path = result_path(spark, "classifier", params, inputs=inputs)
    classes = len(TB.FILTER_CATEGORIES)
    trained = K.train(docs, sequences, classes, path, weights=SPLIT_WEIGHTS, epochs=CONV_EPOCHS,
                      batches=CONV_BATCHES, rate=CONV_RATE, top_k=TOP_K, seed=SEED, **CONV_LAYERS)
    model = K.load(spark, path, sequences, classes, **CONV_LAYERS)
    model.history = trained.history
    return model, split_parts(docs, "article_id", SPLIT_WEIGHTS)


def classifier_predictions(spark, sf):
    """Classes that the saved model predicts for the test part."""
    model, parts = _trained(spark, sf)
    return model.predict(parts[2]).select("article_id", "label", "prediction")


def classifier_topk(spark, sf):
    """Top-k accuracy of the saved model on the test part."""
    from topicspace.plans.classify import evaluate_topk
    model, parts = _trained(spark, sf)
    return evaluate_topk(model.predict(parts[2]), TOP_K)


def _learned(spark, sf):
    from topicspace.plans.skipgram_model import learn_skipgram
    docs = TB.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), "text")
    return learn_skipgram(docs, vocab_size=LEARN_VOCAB, dim=EMBED_DIM, window=EMBED_WINDOW,
                          steps=EMBED_STEPS, epochs=EMBED_EPOCHS, rate=EMBED_RATE,
                          spread=EMBED_SPREAD, seed=SEED)


def learned_embeddings(spark, sf):
    """Skip-gram embeddings (sampled softmax, Adagrad), normalised, as text lines."""
    return word_vector_lines(_l2(_learned(spark, sf), "vec"), "word", "vec", out="line")


def pca_centroids(spark, sf):
    from topicspace.plans.reduce import principal_components
    proj, ratio = principal_components(_centroids(spark, sf, "mean"), "label", "vec", k=1)
    return proj.select("label", F.col("pc")[0].alias("pc1"),
                       F.lit(ratio[0]).alias("explained_variance"))


def _checked_recommendations(recs, key):
    """Of each key: how many, whether ranked 1 to k, by falling rating, all known names."""
    from pyspark.sql import Window
    other = "user" if key == "item" else "item"
    before = F.lag("rating").over(Window.partitionBy(key).orderBy("rank"))
    return (recs.withColumn("_b", before).groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("n_recs"),
        (F.array_sort(F.collect_list("rank")) == F.sequence(
            F.lit(1), F.count(F.lit(1)).cast("int"))).alias("ranked"),
        F.bool_and(F.col("_b").isNull() | (F.col("_b") >= F.col("rating"))).alias("falling"),
        F.bool_and(F.col(other) != "").alias("known")).withColumnRenamed(key, "name"))


def recommend_users_for_items_checked(spark, sf):
    return _checked_recommendations(recommend_users_for_items(spark, sf), "item")


def recommend_items_for_users_checked(spark, sf):
    return _checked_recommendations(recommend_items_for_users(spark, sf), "user")


def recommendation_lines_checked(spark, sf):
    """The recommendation file's lines: how many, and whether each has three fields."""
    from topicspace.plans.recommend import recommendation_lines
    path = _roundtrip_dir(spark, "recommendations")
    write_text(recommendation_lines(recommend_users_for_items(spark, sf)), "line", path)
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.size(F.split("value", ",")) == 3).alias("three_fields"))


def classifier_predictions_checked(spark, sf):
    """Of each test row: whether the predicted class is one of the labels and the best
    scored, and whether the scores are probabilities."""
    known = [float(i + 1) for i in range(len(TB.FILTER_CATEGORIES))]
    model, parts = _trained(spark, sf)
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x["score"])
    best = F.aggregate("scores", F.lit(0.0), lambda a, x: F.greatest(a, x["score"]))
    own = F.filter("scores", lambda x: x["label"] == F.col("prediction"))[0]["score"]
    return model.predict(parts[2]).select(
        "article_id", F.col("label").cast("int").alias("label"),
        F.col("prediction").isin(known).alias("known"), (own == best).alias("best"),
        (F.abs(total - 1) < 1e-4).alias("probable"))


def classifier_topk_checked(spark, sf):
    """What a classifier must reach on the test part: a better top-k accuracy than naming
    the k most frequent labels of the training part for every row. And whether each epoch
    was validated, and the loss fell from the first to the last."""
    from topicspace.plans.classify import evaluate_topk
    model, parts = _trained(spark, sf)
    frequent = [r.label for r in parts[0].groupBy("label").count().orderBy(
        F.desc("count"), "label").limit(TOP_K).collect()]
    named = parts[2].agg(F.avg(F.col("label").isin(frequent).cast("double"))).first()[0]
    epochs = model.history
    fell = epochs[-1]["loss"] < epochs[0]["loss"]
    return evaluate_topk(model.predict(parts[2]), TOP_K).select(
        "k", "n", (F.col("accuracy") > F.lit(named)).alias("beats_majority"),
        F.lit(fell).alias("loss_fell"),
        F.lit(sum(1 for e in epochs if e["n"])).cast("bigint").alias("validated_epochs"))


def learned_embeddings_checked(spark, sf):
    """What embeddings must show: every vocabulary word has a vector of the asked length,
    and words that stand in the texts of one language only have their nearest neighbours
    among that language's words (the planted groups). One row for each language with
    enough such words."""
    vecs = _learned(spark, sf).checkpoint(eager=True)
    docs = TB.table(spark, sf, "documents").select("lang", "text")
    toks = TX.tokenize(docs, "text", "tokens", "stream").select(
        "lang", F.explode("tokens").alias("word"))
    counts = toks.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    own = counts.groupBy("word").agg(F.max(F.struct("n", "lang")).alias("top"), F.sum("n").alias("all"),
                                     F.count(F.lit(1)).alias("langs"))
    group = own.where((F.col("langs") == 1) & (F.col("all") >= OWN_WORD_COUNT)
                      & F.col("top.lang").isNotNull()).select("word", F.col("top.lang").alias("lang"))
    # (a group's words are fewer than the vocabulary)
    words = vecs.join(group, "word").checkpoint(eager=True)
    near = C.nearest_vectors(words, 1, id="word", vec="vec", metric="cosine", id1="word", id2="other")
    pairs = near.join(group, "word").join(
        group.select(F.col("word").alias("other"), F.col("lang").alias("other_lang")), "other")
    agree = pairs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("words"),
        (F.avg((F.col("lang") == F.col("other_lang")).cast("double")) >= 0.9).alias("grouped")) \
        .where(F.col("words") >= GROUP_WORDS)
    whole = vecs.agg(F.count(F.lit(1)).alias("n"), F.bool_and(
        (F.size("vec") == EMBED_DIM) & F.forall("vec", lambda x: ~F.isnan(x))).alias("full")).first()
    return agree.withColumns({"vocabulary": F.lit(whole.n).cast("bigint"),
                              "full": F.lit(bool(whole.full))})


def pca_centroids_checked(spark, sf):
    """The share of the variance that the first component explains."""
    return pca_centroids(spark, sf).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.max("explained_variance"), 5).alias("explained_variance"))


def queries() -> dict[str, Query]:
    return {
        "corpus_articles": corpus_articles,
        "corpus_file_roundtrip": corpus_file_roundtrip,
        "title_normalize": title_normalize,
        "article_dictionary_roundtrip": article_dictionary_roundtrip,
        "membership_file_roundtrip": membership_file_roundtrip,
        "word_vectors_roundtrip": word_vectors_roundtrip,
        "membership_explode": membership_explode,
        "dictionary_last_wins": dictionary_last_wins,
        "dense_category_labels": dense_category_labels,
        "lookup_with_default": lookup_with_default,
        "filter_categories": filter_categories,
        "labelled_articles": labelled_articles,
        "tokenize_words": tokenize_words,
        "tokenize_whitespace": tokenize_whitespace,
        "word_count": word_count,
        "vocabulary_trimmed": vocabulary_trimmed,
        "vocabulary_unk": vocabulary_unk,
        "unk_count": unk_count,
        "token_index_sequence": token_index_sequence,
        "pad_or_truncate": pad_or_truncate,
        "word_vector_lookup": word_vector_lookup,
        "document_vector_sum": document_vector_sum,
        "term_frequency": term_frequency,
        "document_frequency": document_frequency,
        "idf_weights": idf_weights,
        "tfidf_exact": tfidf_exact,
        "hashing_tf": hashing_tf,
        "hashing_tf_sparse": hashing_tf_sparse,
        "category_centroid_mean": category_centroid_mean,
        "category_centroid_sum": category_centroid_sum,
        "category_pair_distance": category_pair_distance,
        "named_distances_sorted": named_distances_sorted,
        "category_distance_tfidf": category_distance_tfidf,
        "category_distance_embedding": category_distance_embedding,
        "blocked_pair_distance": blocked_pair_distance,
        "distance_matrix": distance_matrix,
        "nearest_categories": nearest_categories,
        "rating_triples": rating_triples,
        "l2_normalize": l2_normalize,
        "embedding_text_rows": embedding_text_rows,
        "skipgram_pairs": skipgram_pairs,
        "hash_split": hash_split,
        "hash_sample": hash_sample,
        "topk_accuracy": topk_accuracy,
        "materialize_once": materialize_once,
        "topk_accuracy_ranks": topk_accuracy_ranks,
        "category_distance_tfidf_pipeline": category_distance_tfidf_pipeline,
        "category_pair_cosine": category_pair_cosine,
        "document_vector_mean": document_vector_mean,
        "recommend_users_for_items": recommend_users_for_items,
        "recommend_items_for_users": recommend_items_for_users,
        "classifier_predictions": classifier_predictions,
        "classifier_topk": classifier_topk,
        "learned_embeddings": learned_embeddings,
        "pca_centroids": pca_centroids,
        "distance_matrix_wide": distance_matrix_wide,
        "corpus_title_join": corpus_title_join,
        "vectorized_sequences": vectorized_sequences,
        "centroid_csv_roundtrip": centroid_csv_roundtrip,
        "category_files_roundtrip": category_files_roundtrip,
        "distance_csv_roundtrip": distance_csv_roundtrip,
        "reversed_dictionary": reversed_dictionary,
        "rejected_membership_lines": rejected_membership_lines,
        "single_file_output": single_file_output,
        "nearest_vectors": nearest_vectors,
        "skipgram_stream": skipgram_stream,
        "category_geometric_median": category_geometric_median,
        "category_midrange": category_midrange,
        "close_pairs_checked": close_pairs_checked,
        "recommend_users_for_items_checked": recommend_users_for_items_checked,
        "recommend_items_for_users_checked": recommend_items_for_users_checked,
        "recommendation_lines_checked": recommendation_lines_checked,
        "classifier_predictions_checked": classifier_predictions_checked,
        "classifier_topk_checked": classifier_topk_checked,
        "learned_embeddings_checked": learned_embeddings_checked,
        "pca_centroids_checked": pca_centroids_checked,
    }
