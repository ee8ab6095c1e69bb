"""Token files: equal-length sequences of token ids in Arrow stream files.

Documents in ascending id order are dealt to files by range. A file is an Arrow
stream whose record batches hold two fixed-size-list columns: ``ids`` (``seq_len``
token ids in the smallest unsigned type that fits the vocabulary) and ``mask``
(true for real tokens, false for the padding of the file's last sequence). Beside
it lies a stream with the documents of the file: id, start within the file, number
of ids. Memory-mapped, both are read without a copy, any sequence directly.

Files are written below the shared folder under a temporary name and then moved,
so a repeated or lost task leaves one whole file; the name follows from the task's
place in the order, not from the attempt.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspace.llm.common import (fresh_dir, materialize, read_table, single_spaced,
                                    worker_held)

SEQ_LEN = 2048
BATCH_SEQUENCES = 512
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Cached pieces of text and their ids, at most, in one worker (and as many older ones).
CACHE_PIECES = 250_000
#: Places of the marks of pieces met once; a power of two.
MARKS = 1 << 21
#: Rows of an Arrow batch whose texts are taken at a time.
DOCS_PER_BATCH = 512
MANIFEST = "file int, path string, docs long, tokens long"

# Byte-level BPE pre-tokenisation starts a new piece at a space between two characters
# that are not white space, and around a line feed between two such characters,
# whatever stands farther off. So those pieces can be encoded one by one.
PIECE = re.compile(r"(?<=\S)(?= \S)")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes a byte that is a printable Latin-1 character as itself and
    the others, in order, as the characters from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


BYTE_ALPHABET = _byte_alphabet()


class Encoder:
    """The tokenizer with a cache of pieces, so that a repeated word is looked up. With
    ``special_text`` the strings of special tokens are ordinary text; without, as the
    library's ``encode(text, add_special_tokens=False)`` has it, they are those tokens."""

    def __init__(self, path: str, special_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_text
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.plain = (type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
                      and self.tokenizer.normalizer is None)
        added = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()
                 if t.content and not (t.special and special_text)}
        self.added = {content: i for content, (i, _) in added.items()}
        # the longest of those that start at one place, as the library takes them
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
                               + ")")
        self.plain_added = not any(t.lstrip or t.rstrip or t.single_word for _, t in added.values())
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the cache before it was last full
        self.units: dict[str, bytes] = {}
        # most pieces stand once: only those met again are kept
        self.met = bytearray(MARKS)

    def _met(self, piece: str) -> int:
        """Whether the piece (or another with its mark) was met before."""
        place = hash(piece) & MARKS - 1
        before = self.met[place]
        self.met[place] = 1
        return before

    def _ids(self, unit: str) -> bytes:
        """Ids of one unit of the pre-tokeniser, given in its byte alphabet."""
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(unit)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        """As ``_ids``, kept if met again."""
        found = self._ids(unit)
        if self._met(unit):
            if len(self.units) >= CACHE_PIECES:
                self.units.clear()
            self.units[unit] = found
        return found

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece: the library's pre-tokeniser cuts it into units and its
        model encodes them."""
        units = self.units
        return b"".join([units.get(u) or self._unit(u) for u, _ in
                         self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)])

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space (cached without it), or of a line feed and the
        word after it (cached as it is). Letters after a space are one unit, and a
        full stop or comma after them is one more."""
        stem = word[:-1] if word[-1] in ".," else word
        known = self.older.get(word)
        if known is not None:
            found = known
        elif stem.isalpha():
            found = None if stem is word else self.cache.get(stem) or self.older.get(stem)
            found = found or self._ids("\u0120" + (
                stem if stem.isascii() else
                stem.encode("utf-8").decode("latin-1").translate(BYTE_ALPHABET)))
            if stem is not word:
                found += self.units.get(word[-1]) or self._unit(word[-1])
        else:
            found = self._piece(word if word[0] == "\n" else f" {word}")
        if known is not None or self._met(word):
            if len(self.cache) >= CACHE_PIECES:
                self.older, self.cache = self.cache, {}
                self.met = bytearray(MARKS)
            self.cache[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=self.dtype)
        added = any(token in text for token in self.added)
        if not self.plain or added and not self.plain_added:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids,
                            dtype=self.dtype)
        if not added:
            return self._text(text)
        return np.concatenate([
            np.array([self.added[part]], dtype=self.dtype) if i % 2 else self._text(part)
            for i, part in enumerate(self.cuts.split(text)) if part])

    def _text(self, text: str) -> np.ndarray:
        """Ids of a text without added tokens."""
        cache = self.cache
        if not single_spaced(text):
            raw = [self._piece(p) for p in PIECE.split(text)]
        else:
            first, *words = text.replace("\n", " \n").split(" ")
            raw = [self._piece(first), *[cache.get(w) or self._word(w) for w in words]]
            # (a cache that filled up meanwhile is still searched until the text ends)
        return np.frombuffer(b"".join(raw), dtype=self.dtype)


def id_type(vocab_size: int) -> np.dtype:
    return np.dtype("<u2" if vocab_size <= 1 << 16 else "<u4")


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:")
                                    else f"file://{path}")


class SequenceWriter:
    """Packs ids into sequences and writes them batch by batch."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int):
        self.seq_len, self.dtype = seq_len, dtype
        self.schema = pa.schema([
            ("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)),
            ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.buffer = np.zeros(BATCH_SEQUENCES * seq_len, dtype=dtype)
        self.used = self.written = 0

    def _flush(self) -> None:
        rows = -(-self.used // self.seq_len)
        if rows:
            n = rows * self.seq_len
            self.buffer[self.used:n] = 0
            mask = np.arange(n) < self.used
            self.out.write_batch(pa.RecordBatch.from_arrays([
                pa.FixedSizeListArray.from_arrays(pa.array(self.buffer[:n].copy()), self.seq_len),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)],
                schema=self.schema))
        self.written += self.used
        self.used = 0

    def add(self, ids: np.ndarray) -> None:
        while len(ids):
            n = min(len(ids), len(self.buffer) - self.used)
            self.buffer[self.used:self.used + n] = ids[:n]
            self.used, ids = self.used + n, ids[n:]
            if self.used == len(self.buffer):
                self._flush()

    def close(self) -> None:
        self._flush()
        self.out.close()


class SequenceFile:
    """Random access to the sequences of one file, without a copy where the file
    system allows mapping."""

    def __init__(self, path: str):
        fs, name = _fs(path)
        source = (pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem)
                  else fs.open_input_file(name))
        self.batches = list(pa.ipc.open_stream(source))
        self.ids = [b.column("ids").flatten().to_numpy() for b in self.batches]
        self.ends = np.cumsum([len(a) for a in self.ids])
        self.seq_len = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        k = int(np.searchsorted(self.ends, i * self.seq_len, side="right"))
        row = i - (int(self.ends[k]) - len(self.ids[k])) // self.seq_len
        at = row * self.seq_len
        return (self.ids[k][at:at + self.seq_len],
                self.batches[k].column("mask")[row].values.to_numpy(zero_copy_only=False))

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start``, piece by piece."""
        k = int(np.searchsorted(self.ends, start, side="right"))
        while n > 0:
            at = start - (int(self.ends[k]) - len(self.ids[k]))
            piece = self.ids[k][at:at + n]
            yield piece
            start, n, k = start + len(piece), n - len(piece), k + 1


def _write_task(folder: str, tokenizer: str, seq_len: int, end_id: int, id_col: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), worker_held(
            ("tokenizer", tokenizer), lambda: Encoder(tokenizer, special_text=False))
        fs, base = _fs(folder)
        mark = uuid.uuid4().hex
        names = [f"{base}/{kind}-{part:06d}.arrow" for kind in ("tokens", "docs")]
        fs.create_dir(base, recursive=True)
        index = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
        docs = tokens = 0
        with fs.open_output_stream(f"{names[0]}.{mark}") as a, \
                fs.open_output_stream(f"{names[1]}.{mark}") as b:
            sequences, rows = SequenceWriter(a, encode.dtype, seq_len), pa.ipc.new_stream(b, index)
            for batch in (whole.slice(at, DOCS_PER_BATCH) for whole in batches
                          for at in range(0, whole.num_rows, DOCS_PER_BATCH)):
                ids, lengths = batch.column(id_col), []
                for value in batch.column(text).to_pylist():
                    found = encode(value)
                    sequences.add(found)
                    sequences.add(np.array([end_id], dtype=encode.dtype))
                    lengths.append(len(found) + 1)
                n = np.array(lengths, dtype=np.int64)
                starts = tokens + np.cumsum(n) - n
                rows.write_batch(pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), pa.array(starts), pa.array(n)], schema=index))
                docs, tokens = docs + len(n), tokens + int(n.sum())
            sequences.close()
            rows.close()
        for name in names:
            fs.move(f"{name}.{mark}", name)
        yield pa.RecordBatch.from_pydict(
            {"file": pa.array([part], pa.int32()), "path": [f"{folder}/tokens-{part:06d}.arrow"],
             "docs": [docs], "tokens": [tokens]})

    return run


def write_token_files(df: DataFrame, folder: str, tokenizer: str, seq_len: int = SEQ_LEN,
                      end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``df`` in ascending ``id_col`` order (null first, equal ids in the order
    of a hash of their text) and return the manifest ``(file, path, docs, tokens)``,
    one row for each file."""
    tie = "__tie"
    ordered = (df.select(id_col, text).withColumn(tie, F.xxhash64(text))
               .repartitionByRange(F.col(id_col), F.col(tie))
               .sortWithinPartitions(id_col, tie))
    run = _write_task(folder, tokenizer, seq_len, end_id, id_col, text)
    return materialize(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def _read_task(out_schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["docs"]:
                    continue
                tokens = SequenceFile(row["path"])
                fs, name = _fs(row["path"].replace("/tokens-", "/docs-"))
                for docs in pa.ipc.open_stream(fs.open_input_file(name)):
                    starts, lengths = (docs.column(c).to_numpy() for c in ("start", "n"))
                    sums = []
                    for start, n in zip(starts.tolist(), lengths.tolist()):
                        crc = 0
                        for piece in tokens.span(start, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc"), pa.array(starts + row["base"]), docs.column("n"),
                         pa.array(sums, pa.int64())], schema=out_schema)

    return run


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files. The
    manifest has one short row for each file; the driver sums those rows to the
    start of each file."""
    files, base = [], 0
    for row in manifest.orderBy("file").toLocalIterator():
        files.append((row.file, row.path, row.docs, base))
        base += row.tokens
    listed = spark.createDataFrame(files, "file int, path string, docs long, base long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])
    spread = listed.repartitionById(max(1, len(files)), F.col("file"))
    return spread.mapInArrow(_read_task(schema),
                             "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents and read every document back from the files.
    A null or empty text has the end id alone; an empty table gives no rows."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    folder = fresh_dir(spark, "op4-tokens")
    manifest = write_token_files(docs, folder, public_tokenizers.path(TOKENIZER))
    return read_documents(spark, manifest)
