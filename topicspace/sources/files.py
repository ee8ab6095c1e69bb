"""Readers for the plain-text input formats: dictionaries, membership lists,
category filters, the blank-line corpus, word-vector text files and the CSV
results. Every reader is a distributed ``spark.read`` with an explicit schema;
nothing is loaded on the driver.

Where a later line must win over an earlier one with the same key (the input
is a map in file order), rows carry a file-order key made of the file path, the
start of the split and a per-partition increasing id; ``max_by`` over that key
picks the last line even when one file is read as many splits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspace.functions.text import WHITESPACE, first_line, join_rest_lines, normalize_title

ORDER = "_order"


def path_order(path: Column) -> Column:
    """Sortable key of a file path: its folder, the number of a part file, the path.
    ``part-100000`` comes after ``part-99999``, as it was written."""
    part = F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1)
    return F.struct(
        F.regexp_replace(path, r"[^/]*$", "").alias("folder"),
        F.when(part != "", part.cast("bigint")).otherwise(F.lit(-1)).alias("part"),
        path.alias("path"))


def file_order() -> Column:
    """Sortable key that follows line order in the input files."""
    return F.struct(
        path_order(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_lines(spark: SparkSession, path: str | Sequence[str], line_sep: str | None = None,
               encoding: str | None = None) -> DataFrame:
    """Text lines with their file-order key: ``(value string, _order struct)``."""
    reader = spark.read.format("text")
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    if encoding is not None:
        reader = reader.option("encoding", encoding)
    df = reader.load(path if isinstance(path, str) else list(path))
    return df.select("value", file_order().alias(ORDER))


def _token_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(value, _t array<string>, _order)``: the tokens of every line that has any."""
    toks = F.filter(F.split(F.col("value"), WHITESPACE + "+"), lambda t: t != "")
    return (read_lines(spark, path).select("value", toks.alias("_t"), ORDER)
            .where(F.size("_t") > 0))


def _whole(token: Column) -> Column:
    """The token as an int, null if it isn't one."""
    return token.try_cast("int")


def read_whitespace_table(spark: SparkSession, path: str | Sequence[str],
                          transform: Callable[[Column], list[Column]],
                          good: Callable[[Column], Column] | None = None,
                          bad_lines: str = "fail") -> DataFrame:
    """Generic loader: each line split on runs of whitespace, then ``transform``
    turns the token array into output columns. Blank lines are skipped.

    ``good`` is a condition on the token array. A line that doesn't meet it fails the
    read with the line's text (``bad_lines='fail'``) or is skipped (``'drop'``);
    ``rejected_lines`` gives those lines."""
    lines = _token_lines(spark, path)
    if good is not None:
        ok = F.coalesce(good(F.col("_t")), F.lit(False))
        if bad_lines == "drop":
            lines = lines.where(ok)
        elif bad_lines == "fail":
            message = F.concat(F.lit("bad line: "), F.col("value"))
            lines = lines.withColumn("_t", F.when(ok, F.col("_t")).otherwise(
                F.raise_error(message).cast("array<string>")))
        else:
            raise ValueError("bad_lines must be 'fail' or 'drop'")
    return lines.select(*transform(F.col("_t")), ORDER)


def _name_id(t: Column) -> Column:
    """A line of a name and an id."""
    return (F.size(t) >= 2) & _whole(F.get(t, 1)).isNotNull()


def _ids(t: Column) -> Column:
    """A line of ids alone."""
    return F.forall(t, lambda x: _whole(x).isNotNull())


def _first_id(t: Column) -> Column:
    """A line that begins with an id."""
    return _whole(F.get(t, 0)).isNotNull()


#: The condition on the lines of each kind of file.
LINE_RULES = {"article_dictionary": _name_id, "category_names": _name_id, "membership": _ids,
              "category_filter": _first_id}


def rejected_lines(spark: SparkSession, path: str | Sequence[str], kind: str) -> DataFrame:
    """``(value)``: the lines that a reader of ``kind`` (a key of ``LINE_RULES``) with
    ``bad_lines='drop'`` skips."""
    ok = F.coalesce(LINE_RULES[kind](F.col("_t")), F.lit(False))
    return _token_lines(spark, path).where(~ok).select("value")


def last_wins(df: DataFrame, key: str | Sequence[str], order: str = ORDER) -> DataFrame:
    """Keep, per key, the row that comes last by ``order`` (a map built in file
    order). One ``max_by`` aggregate with map-side partial results."""
    keys = [key] if isinstance(key, str) else list(key)
    values = [c for c in df.columns if c not in keys and c != order]
    picked = F.max_by(F.struct(*values), F.col(order)).alias("_v")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def read_article_dictionary(spark: SparkSession, path: str, bad_lines: str = "fail") -> DataFrame:
    """``title id`` lines -> ``(title, article_id)``; titles are normalised (spaces
    to underscores) and a repeated title keeps its last id."""
    df = read_whitespace_table(spark, path, lambda t: [
        normalize_title(t[0]).alias("title"), _whole(t[1]).alias("article_id")],
        _name_id, bad_lines)
    return last_wins(df, "title")


def read_category_names(spark: SparkSession, path: str, bad_lines: str = "fail") -> DataFrame:
    """``name id`` lines (tab separated, CRLF allowed) -> ``(category_id, name)``;
    a repeated id keeps its last name."""
    df = read_whitespace_table(spark, path, lambda t: [
        _whole(t[1]).alias("category_id"), t[0].alias("name")], _name_id, bad_lines)
    return last_wins(df, "category_id")


def read_category_labels(spark: SparkSession, path: str, bad_lines: str = "fail") -> DataFrame:
    """The category dictionary with a dense 1-based label in file order:
    ``(category_id, name, label)``. A repeated id keeps its last label."""
    df = read_whitespace_table(spark, path, lambda t: [
        _whole(t[1]).alias("category_id"), t[0].alias("name")], _name_id, bad_lines)
    from topicspace.operators.labels import dense_labels
    labelled = dense_labels(df, ORDER, out="label")
    return last_wins(labelled, "category_id").select("category_id", "name", "label")


def read_membership(spark: SparkSession, path: str, bad_lines: str = "fail") -> DataFrame:
    """``article cat cat ...`` lines -> distinct ``(article_id, category_id)`` rows.
    An article listed twice keeps its last line; a line with no category gives
    no row."""
    df = read_whitespace_table(spark, path, lambda t: [
        _whole(t[0]).alias("article_id"),
        F.array_distinct(F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                                     _whole)).alias("categories")], _ids, bad_lines)
    last = last_wins(df, "article_id")
    return last.select("article_id", F.explode("categories").alias("category_id"))


def read_category_filter(spark: SparkSession, path: str, bad_lines: str = "fail") -> DataFrame:
    """First token of every line -> distinct ``(category_id)``."""
    df = read_whitespace_table(spark, path, lambda t: [_whole(t[0]).alias("category_id")],
                               _first_id, bad_lines)
    return df.select("category_id").distinct()


def has_crlf(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether the first line of the input ends in carriage return and line feed."""
    first = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    row = first.limit(1).first()
    return row is not None and row["value"].endswith("\r")


def read_corpus(spark: SparkSession, path: str, line_sep: str | None = None,
                dedupe: bool = True) -> DataFrame:
    """Blank-line separated articles -> ``(title, content)``.

    The file is split on ``line_sep`` by the text source itself, so it is read
    in parallel splits; by default it is an empty line, ended as the input's first
    line is (line feed, or carriage return and line feed). Title = first line of a block; content = the other
    lines joined by one space. Empty blocks (extra blank lines) are skipped, the
    last block counts even without a blank line after it, and with ``dedupe`` a
    repeated title keeps its last article (the input is a map by title).
    """
    if line_sep is None:
        line_sep = "\r\n\r\n" if has_crlf(spark, path) else "\n\n"
    nl = "\r\n" if line_sep == "\r\n\r\n" else "\n"
    blocks = read_lines(spark, path, line_sep=line_sep)
    block = F.regexp_replace(F.col("value"), f"^({nl})+|({nl})+$", "")
    if nl == "\r\n":
        block = F.regexp_replace(block, "\r\n", "\n")
    df = (blocks.select(block.alias("b"), ORDER).where(F.col("b") != "")
          .select(first_line("b").alias("title"), join_rest_lines("b").alias("content"), ORDER))
    return last_wins(df, "title") if dedupe else df.drop(ORDER)


BAD_LINES = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "null": "PERMISSIVE"}


def read_word_vectors(spark: SparkSession, path: str, dim: int,
                      encoding: str = "ISO-8859-1", bad_lines: str = "fail") -> DataFrame:
    """``word f1 ... fdim`` lines (single spaces, no quoting) -> ``(word, vec array<float>)``.

    A line with a non-numeric value or the wrong number of values fails the
    read (``bad_lines='fail'``, as the original), is skipped (``'drop'``) or
    gives nulls (``'null'``)."""
    schema = "word string, " + ", ".join(f"f{i} float" for i in range(dim))
    df = (spark.read.schema(schema).option("sep", " ").option("quote", "")
          .option("encoding", encoding).option("mode", BAD_LINES[bad_lines]).csv(path))
    return df.select("word", F.array(*[F.col(f"f{i}") for i in range(dim)]).alias("vec"),
                     file_order().alias(ORDER))


def word_vectors_for_vocabulary(vectors: DataFrame, vocab: DataFrame,
                                word: str = "word", idx: str = "idx") -> DataFrame:
    """Keep the vectors of vocabulary words, keyed by the word's index: ``(idx, vec)``.
    A word listed twice keeps its last vector."""
    kept = vectors.join(vocab.select(word, idx), word, "inner")
    return last_wins(kept.select(idx, "vec", ORDER), idx)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """Reload a persisted result (Parquet)."""
    return spark.read.parquet(path)


def read_distance_triples(spark: SparkSession, path: str) -> DataFrame:
    """``name1,name2,distance`` CSV -> DataFrame sorted by the first name."""
    return (spark.read.schema("name1 string, name2 string, distance double").csv(path)
            .orderBy("name1", "name2"))


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """Wide CSV ``name,f1,...,fd`` -> ``(name, vec array<double>)``."""
    raw = spark.read.csv(path)
    cols = raw.columns
    return raw.select(F.col(cols[0]).alias("name"),
                      F.array(*[F.col(c).cast("double") for c in cols[1:]]).alias("vec"))
