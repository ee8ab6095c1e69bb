"""Writers: text and CSV dumps, blank-line corpus files, word-vector text
files, fitted models. Output is multi-part unless ``single_file`` is asked for
(one task writes it, so only for small results)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(df: DataFrame, single_file: bool) -> DataFrame:
    return df.coalesce(1) if single_file else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Headerless CSV dump of a result (the text form of a saved result)."""
    _parts(df, single_file).write.mode(mode).csv(path)


def write_text(df: DataFrame, col: str | Column, path: str, mode: str = "overwrite",
               line_sep: str = "\n", single_file: bool = False) -> None:
    """One string column as text lines (or blocks, with ``line_sep``)."""
    c = F.col(col) if isinstance(col, str) else col
    _parts(df.select(c.alias("value")), single_file).write.mode(mode) \
        .option("lineSep", line_sep).text(path)


def write_corpus(df: DataFrame, title: str, content_lines: str | Column, path: str,
                 mode: str = "overwrite") -> None:
    """Articles as blank-line separated blocks: the title line, then the content
    lines (``content_lines`` is a text column that may hold newlines)."""
    c = F.col(content_lines) if isinstance(content_lines, str) else content_lines
    block = F.concat_ws("\n", F.col(title), c)
    write_text(df, block, path, mode=mode, line_sep="\n\n")


def word_vector_lines(df: DataFrame, word: str = "word", vec: str = "vec",
                      out: str = "line") -> DataFrame:
    """``lower(word) f1 f2 ...`` lines, the layout the word-vector reader takes."""
    vals = F.array_join(F.transform(F.col(vec), lambda x: x.cast("string")), " ")
    return df.select(F.concat_ws(" ", F.lower(F.col(word)), vals).alias(out))


def write_word_vectors(df: DataFrame, path: str, word: str = "word", vec: str = "vec",
                       mode: str = "append") -> None:
    """Write trained vectors as text; appends by default, like the original tool."""
    write_text(word_vector_lines(df, word, vec), "line", path, mode=mode)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
