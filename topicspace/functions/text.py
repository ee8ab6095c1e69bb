"""Column expressions over text. All built-in Spark SQL functions, so they stay
inside whole-stage code generation; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of Java's ``\s`` (space, tab, newline,
# vertical tab, form feed, carriage return), written out so the same class
# means the same thing in every engine.
WHITESPACE = "[ \\t\\n\\x0B\\f\\r]"
WHITESPACE_CHARS = " \t\n\x0b\f\r"
# Fixed value: a word is a maximal run of Unicode letters.
LETTER = "\\p{L}"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_title(col: Column | str) -> Column:
    """Title key form: every space becomes an underscore."""
    return F.translate(_c(col), " ", "_")


def lines(col: Column | str) -> Column:
    return F.split(_c(col), "\n")


def first_line(col: Column | str) -> Column:
    """Title of an article block: its first line."""
    return F.element_at(lines(col), 1)


def join_rest_lines(col: Column | str) -> Column:
    """Content of an article block: every line after the first, joined by one space."""
    ls = lines(col)
    return F.array_join(F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0))), " ")


def stream_tokens(col: Column | str) -> Column:
    """Plain word stream: whitespace-separated tokens, empty tokens dropped, case
    kept (the maximal runs of non-whitespace, extracted in one regex pass)."""
    return F.regexp_extract_all(_c(col), F.lit("[^" + WHITESPACE[1:-1] + "]+"), 0)


def ml_tokens(col: Column | str) -> Column:
    """Same tokens as ``pyspark.ml.feature.Tokenizer``: lower-case, split on every
    single whitespace character; leading and inner empty tokens are kept, trailing
    ones dropped, and an empty text gives one empty token."""
    low = F.lower(_c(col))
    stripped = F.rtrim(low, F.lit(WHITESPACE_CHARS))
    # a text made only of whitespace has no tokens; an empty text has one empty token
    return F.when((stripped == "") & (low != ""), F.array().cast("array<string>")) \
        .otherwise(F.split(stripped, WHITESPACE))


def word_tokens(col: Column | str, min_len: int = 3) -> Column:
    """Words: lower-cased runs of letters of at least ``min_len`` characters.

    One regex pass extracts them directly: a greedy ``\\p{L}{n,}`` match starts
    only at the start of a letter run and takes the whole run, so this equals
    splitting on non-letters and dropping words shorter than ``n``."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(LETTER + "{%d,}" % max(1, min_len)), 0)
