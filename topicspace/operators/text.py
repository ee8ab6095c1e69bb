"""Text operators: tokenising, word counts, vocabularies (trimmed or with an
unknown-word slot), encoding words as vocabulary indexes, and fixed-length
index sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspace.functions import text as T
from topicspace.operators.common import bounded_broadcast

UNK = "UNK"


def tokenize(df: DataFrame, text: str, out: str = "tokens", method: str = "words",
             min_len: int = 3) -> DataFrame:
    """Add a token array column.

    ``words``: lower-cased letter runs of at least ``min_len`` characters;
    ``whitespace``: the ML ``Tokenizer`` rule (lower-case, split on each single
    whitespace character); ``stream``: whitespace-separated tokens, case kept.
    """
    if method == "words":
        col = T.word_tokens(text, min_len)
    elif method == "whitespace":
        col = T.ml_tokens(text)
    elif method == "stream":
        col = T.stream_tokens(text)
    else:
        raise ValueError("method must be 'words', 'whitespace' or 'stream'")
    return df.withColumn(out, col)


def word_counts(df: DataFrame, tokens: str = "tokens", word: str = "word",
                out: str = "cnt", weight: str | None = None) -> DataFrame:
    """Occurrences of every word: ``(word, cnt bigint)``. (``explode_outer`` plus a
    null filter: a plain ``explode`` makes Catalyst add a ``size(tokens) > 0``
    filter that evaluates the tokeniser a second time.) With ``weight`` each row
    counts that many times (e.g. once per category of its article). Exploded
    tokens are combined map-side, so a very frequent word costs one row per task
    in the shuffle."""
    ex = df.select(F.explode_outer(tokens).alias(word), *([weight] if weight else [])) \
        .where(F.col(word).isNotNull())
    agg = F.sum(F.col(weight)).cast("bigint") if weight else F.count(F.lit(1))
    return ex.groupBy(word).agg(agg.alias(out))


def vocabulary(counts: DataFrame, cap: int, skip_top: int = 0, unk: bool = False,
               word: str = "word", cnt: str = "cnt", idx: str = "idx") -> DataFrame:
    """Most frequent words with a 1-based index by rank (count descending, then
    word ascending).

    ``skip_top`` drops that many most frequent words first (ranks skip_top+1 ..
    cap are kept and numbered from 1). With ``unk`` the vocabulary has
    ``cap - 1`` words plus ``(UNK, <count of all other tokens>, 0)``.

    Only ``cap`` rows ever reach one task: a top-k per partition, then a merge.
    """
    n_words = cap - 1 if unk else cap
    top = counts.select(word, cnt).orderBy(F.col(cnt).desc(), F.col(word).asc()).limit(n_words)
    rank = F.row_number().over(Window.orderBy(F.col(cnt).desc(), F.col(word).asc()))
    ranked = top.withColumn("_rank", rank)
    if not unk:
        return (ranked.where(F.col("_rank") > skip_top)
                .select(word, cnt, (F.col("_rank") - skip_top).cast("int").alias(idx)))
    words = ranked.select(word, cnt, F.col("_rank").cast("int").alias(idx))
    # count of every other token = all counts minus the kept ones: one global sum
    # over the counts and the negated kept counts (no join)
    signed = counts.select(F.col(cnt).cast("bigint").alias("_c")).unionByName(
        words.select((-F.col(cnt)).cast("bigint").alias("_c")))
    unk_row = signed.agg(F.lit(UNK).alias(word),
                         F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias(cnt),
                         F.lit(0).alias(idx))
    return unk_row.unionByName(words)


def encode(df: DataFrame, doc: str, tokens: str, vocab: DataFrame, oov: str = "drop",
           word: str = "word", idx: str = "idx", pos: str = "pos",
           carry: list[str] | None = None) -> DataFrame:
    """Word positions as vocabulary indexes: ``(doc, pos, word, idx, carry...)``.

    ``oov='drop'`` drops words outside the vocabulary; ``oov='unk'`` keeps them
    with index 0. The vocabulary is bounded by its cap, so it is broadcast after
    a size check and the join needs no shuffle of the token stream. ``carry``
    columns of the document row are kept on every position.
    """
    extra = list(carry or [])
    ex = df.select(doc, *extra, F.posexplode_outer(tokens).alias(pos, word)) \
        .where(F.col(pos).isNotNull())
    v = bounded_broadcast(vocab.select(word, idx))
    if oov == "drop":
        return ex.join(v, word, "inner").select(doc, pos, word, idx, *extra)
    if oov == "unk":
        return (ex.join(v, word, "left")
                .select(doc, pos, word, F.coalesce(F.col(idx), F.lit(0)).alias(idx), *extra))
    raise ValueError("oov must be 'drop' or 'unk'")


def unk_count(encoded: DataFrame, idx: str = "idx", out: str = "unk_count") -> DataFrame:
    """Number of word positions encoded as the unknown word (index 0)."""
    return encoded.agg(F.count_if(F.col(idx) == 0).cast("bigint").alias(out))


def index_sequences(encoded: DataFrame, doc: str = "doc_id", pos: str = "pos",
                    idx: str = "idx", out: str = "seq", times: str | None = None) -> DataFrame:
    """Per document, its indexes in word order: ``(doc, seq array<int>)``. One
    document's positions come together (a document is one input row already). With
    ``times`` a position stands for so many equal ones."""
    own = [F.col(times).alias("n")] if times else []
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(idx).alias("i"), *own)))
    seq = F.flatten(F.transform("_s", lambda s: F.array_repeat(s["i"], s["n"]))) if times \
        else F.transform("_s", lambda s: s["i"])
    return encoded.groupBy(doc).agg(ordered.alias("_s")).select(doc, seq.alias(out))


def pad(df: DataFrame, col: str, length: int, side: str = "post", value: int = 0,
        out: str | None = None) -> DataFrame:
    """Shape a sequence to exactly ``length`` items. ``side='post'`` keeps the
    first items and pads at the end; ``side='pre'`` keeps the last items and pads
    at the front."""
    c = F.col(col)
    n = F.size(c)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - n, F.lit(0)))
    if side == "post":
        shaped = F.concat(F.slice(c, 1, length), fill)
    elif side == "pre":
        start = F.greatest(n - F.lit(length) + 1, F.lit(1))
        shaped = F.concat(fill, F.slice(c, start, length))
    else:
        raise ValueError("side must be 'post' or 'pre'")
    return df.withColumn(out or col, shaped)


def decode(encoded: DataFrame, vocab: DataFrame, idx: str = "idx", word: str = "word",
           out: str = "word") -> DataFrame:
    """Index -> word (the reverse dictionary)."""
    rev = bounded_broadcast(vocab.select(F.col(idx), F.col(word).alias("_w")))
    return encoded.join(rev, idx, "left").withColumn(out, F.col("_w")).drop("_w")
