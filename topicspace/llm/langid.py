"""Language identification by compression.

Each language is a raw-content zstandard dictionary made of labelled passages. A text
is compressed with every dictionary; the language whose dictionary gives the fewest
bytes is the prediction, and the relative margin to the second says how sure it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicspace.llm.common import read_table, worker_held

#: Labelled rows of each language that make its dictionary, and the characters taken
#: from each: the bounded sample that the classifier is fitted on.
SAMPLE_ROWS = 400
PASSAGE_CHARS = 400
SEED = 11
LEVEL = 5
#: Bytes compressed at a time: small enough for the dictionary to decide, not the text.
BLOCK_BYTES = 4096
#: Margins below this are rejected.
MIN_MARGIN = 0.02
UNKNOWN = "und"
#: Hashes that order the sample, and how many times the sample is looked through for it.
HASHES, SPARE = 1 << 40, 4
OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case words without digits, marks of punctuation and symbols."""
    return OTHER.sub(" ", text.lower())


def fit_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang",
                     key: str = "doc_id", sample_rows: int = SAMPLE_ROWS,
                     passage_chars: int = PASSAGE_CHARS, seed: int = SEED) -> dict[str, bytes]:
    """Dictionary content of each language in ``labelled``: passages from the middle of
    ``sample_rows`` rows, chosen by a seeded hash. Languages come in falling order of
    all their labelled rows, equal ones by code point. The driver gets the sample and
    one count for each language."""
    known = labelled.where(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0))
    counts = {str(r[0]): r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return {}
    # a hash bound for each language leaves a few times the sample, however many rows
    h = F.xxhash64(F.lit(seed), key, text)
    bounds = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (
        name, min(HASHES, HASHES * SPARE * sample_rows // n))])
    known = known.where(F.pmod(h, F.lit(HASHES)) < F.element_at(bounds, F.col(lang).cast("string")))
    middle = F.greatest(F.lit(1), (F.length(text) / 2 - passage_chars / 2).cast("int"))
    order = Window.partitionBy(lang).orderBy(F.pmod(h, F.lit(HASHES)), key)
    rows = (known.select(F.col(lang).alias("l"), F.row_number().over(order).alias("n"),
                    F.substring(text, middle, F.lit(passage_chars)).alias("t"))
            .where(F.col("n") <= sample_rows).collect())
    found: dict[str, list[tuple[int, str]]] = {}
    for row in rows:
        found.setdefault(str(row.l), []).append((row.n, plain(row.t)))
    return {name: " ".join(t for _, t in sorted(found[name])).encode("utf-8")
            for name in sorted(found, key=lambda name: (-counts[name], name))}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = list(dictionaries)  # equal sizes go to the first
        self.compressors = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(
                dictionaries[name].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(
                dict_data=content, write_content_size=False, write_checksum=False,
                write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Bytes of the whole text with each dictionary, block by block."""
        raw = plain(text).encode("utf-8", "replace")
        blocks = [raw[i:i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, relative margin, rejected). Without a letter, or without any
        learned language, it is ``und`` with margin 0; equal sizes go to the language
        with more labelled rows; a lone language has margin 1."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.names[0], 1.0, False
        margin = 1.0 - sizes[order[0]] / sizes[order[1]]
        return self.names[order[0]], margin, margin < MIN_MARGIN


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``lang_pred``, ``score`` and ``rejected`` (columns
    of these names are replaced)."""
    out = ["lang_pred", "score", "rejected"]
    kept = [c for c in df.columns if c != text and c.lower() not in out]
    df = df.select(*kept, text)
    sent = df.sparkSession.sparkContext.broadcast(dictionaries)  # SAMPLE_ROWS bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_held(("langid", hash(tuple(sent.value.items()))),
                          lambda: Classifier(sent.value))
        for batch in batches:
            found = [own.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.bool_())], names=[*kept, *out])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)
    return df.mapInArrow(run, f"{types}, lang_pred string, score double, rejected boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents whose id's
    CRC-32 leaves no remainder 1 modulo 3 (a null id counts as the empty text)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    dictionaries = fit_dictionaries(docs.where(fold != 1))
    asked = docs.select("doc_id", (fold == 1).alias("held_out"), "text")
    return identify(asked, dictionaries)
