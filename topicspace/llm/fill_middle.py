"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME_UNITS`` code
points, with the cumulative count of code points at the end of each frame. A cut needs
only the frame that holds it to be decompressed; every other frame is handed on as it
is, still compressed, when the parts change places. Digests and restored texts stream
the ordered frames one by one, so no step holds a whole decompressed text.

The stored table serves any number of passes (other seeds or rates) without reading the
documents again.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from topicspace.llm.common import materialize, read_table

FRAME_UNITS = 1 << 15
LEVEL = 1
SEED = 1
PLAIN_FROM = 90  # a third draw of 0 to 99 from here on leaves the text as it is
SPM_BELOW = 20   # a fourth draw of 0 to 99 below this puts the suffix first
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Rows of an Arrow batch given on at a time.
ROWS_TOGETHER = 1024

Frame = tuple[bytes, int]  # compressed text, code points in it
STORED = "struct<data:binary,upto:bigint>"


class Codec:
    """Packs and unpacks single frames; one for each task."""

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.unpacker = zstandard.ZstdDecompressor()

    def pack(self, text: str) -> Frame:
        return self.packer.compress(text.encode("utf-8")), len(text)

    def raw(self, frame: Frame) -> bytes:
        return self.unpacker.decompress(frame[0])

    def frames(self, text: str | None, units: int = FRAME_UNITS) -> list[Frame]:
        """The frames of a text; none for a null or empty one."""
        return [self.pack(text[i:i + units]) for i in range(0, len(text or ""), units)]

    def span(self, frames: list[Frame], ends: list[int], start: int, stop: int) -> list[Frame]:
        """The frames of code points ``start`` to ``stop``: whole frames as they are,
        the one or two that a cut goes through decompressed and cut."""
        found = []
        i = bisect_left(ends, start + 1)
        while start < stop:
            frame, end = frames[i], ends[i]
            first = end - frame[1]
            if start == first and stop >= end:
                found.append(frame)
            else:
                found.append(self.pack(self.raw(frame).decode("utf-8")[start - first:stop - first]))
            start, i = min(stop, end), i + 1
        return found

    def digest(self, frames: list[Frame]) -> str:
        """SHA-256 (hex) of the UTF-8 bytes of the ordered frames."""
        total = hashlib.sha256()
        for frame in frames:
            total.update(self.raw(frame))
        return total.hexdigest()

    def places(self, frames: list[Frame], marks: tuple[str, ...]) -> list[int]:
        """The code point at which each mark first stands in the ordered frames, -1 where
        it does not; a mark may lie across frames."""
        found, at, tail = [-1] * len(marks), 0, ""
        keep = max(map(len, marks)) - 1
        for frame in frames:
            window = tail + self.raw(frame).decode("utf-8")
            for k, mark in enumerate(marks):
                if found[k] < 0 and (i := window.find(mark)) >= 0:
                    found[k] = at - len(tail) + i
            if min(found) >= 0:
                break
            at, tail = at + frame[1], window[-keep:]
        return found


def draws(key: object, seed: int = SEED) -> list[int]:
    """Four 32-bit draws of a document: the first groups of eight digits of the hex
    SHA-256 of seed, colon and key (nothing for a null key)."""
    text = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(text[i:i + 8], 16) for i in range(0, 32, 8)]


def _as_frames(stored: list[dict]) -> list[Frame]:
    ends = [f["upto"] for f in stored]
    return [(f["data"], end - start) for f, start, end in zip(stored, [0, *ends], ends)]


def _as_stored(frames: list[Frame]) -> list[dict]:
    return [{"data": data, "upto": upto} for (data, _), upto in
            zip(frames, accumulate(n for _, n in frames))]


def _mapped(df: DataFrame, source: str, make, fields: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``source`` and ``drop``, with the columns that ``make(codec, row)``
    gives for each row; a new column replaces one of the same name."""
    added = StructType.fromDDL(fields)
    gone = {source, *drop, *added.names}
    kept = [f for f in df.schema.fields if f.name not in gone]
    schema = StructType([*kept, *(StructField(f.name, f.dataType) for f in added.fields)])
    names, wanted = [f.name for f in kept], df.columns
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(at, ROWS_TOGETHER)
                rows = [make(codec, dict(zip(wanted, row)))
                        for row in zip(*(part.column(c).to_pylist() for c in wanted))]
                new = [pa.array([r[f.name] for r in rows], arrow.field(f.name).type)
                       for f in added.fields]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new],
                                                 schema=arrow)

    return df.mapInArrow(run, schema)


def store_frames(df: DataFrame, text: str = "text", units: int = FRAME_UNITS) -> DataFrame:
    """``df`` with ``text`` replaced by ``frames`` (an array of compressed frames with the
    cumulative number of code points), its length ``n`` and ``marked``: whether the
    text holds one of the marks. A null text is stored as an empty one."""
    def make(codec, row):
        value = row[text] or ""
        return {"n": len(value), "marked": any(m in value for m in MARKS),
                "frames": _as_stored(codec.frames(value, units))}

    return _mapped(df, text, make, f"n bigint, marked boolean, frames array<{STORED}>")


def fill_in_middle(stored: DataFrame, id_col: str = "doc_id", seed: int = SEED,
                   plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """The stored texts with their parts in fill-in-the-middle order: ``form``,
    ``prefix_chars``, ``middle_chars`` and ``frames`` of the output.

    Cuts and form follow from ``seed`` and ``id_col`` alone. ``plain`` (an empty or marked
    text, or the draw) keeps the text and has null counts."""
    def make(codec, row):
        n, (h1, h2, h3, h4) = row["n"], draws(row[id_col], seed)
        frames = _as_frames(row["frames"])
        if not n or row["marked"] or h3 % 100 >= plain_from:
            return {"form": "plain", "prefix_chars": None, "middle_chars": None,
                    "frames": row["frames"]}
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        ends = list(accumulate(count for _, count in frames))
        form = "spm" if h4 % 100 < spm_below else "psm"
        parts = {PREFIX: (0, a), SUFFIX: (b, n), MIDDLE: (a, b)}
        out: list[Frame] = []
        for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
            out += [codec.pack(mark), *codec.span(frames, ends, *parts[mark])]
        return {"form": form, "prefix_chars": a, "middle_chars": b - a, "frames": _as_stored(out)}

    return _mapped(stored, "frames", make, "form string, prefix_chars bigint, middle_chars bigint, "
                                           f"frames array<{STORED}>", ("marked",))


def restored_frames(codec: Codec, frames: list[Frame], form: str) -> list[Frame]:
    """The frames of the text that an output was made from, found from the output and its
    form alone: the first place of each mark, then the spans between in text order."""
    if form == "plain":
        return frames
    ends = list(accumulate(n for _, n in frames))
    starts = dict(zip(MARKS, codec.places(frames, MARKS)))
    stops = sorted([*starts.values(), ends[-1]])
    parts = []
    for mark in (PREFIX, MIDDLE, SUFFIX):
        stop = stops[stops.index(starts[mark]) + 1]
        parts += codec.span(frames, ends, starts[mark] + len(mark), stop)
    return parts


def restore(outputs: DataFrame) -> DataFrame:
    """Outputs of ``fill_in_middle`` with ``frames`` of the original text."""
    def make(codec, row):
        return {"frames": _as_stored(restored_frames(codec, _as_frames(row["frames"]),
                                                     row["form"]))}

    return _mapped(outputs, "frames", make, f"frames array<{STORED}>")


def read_text(stored: DataFrame, out: str = "text") -> DataFrame:
    """Stored frames as whole texts again, in column ``out``."""
    def make(codec, row):
        return {out: b"".join(codec.raw(f) for f in _as_frames(row["frames"])).decode("utf-8")}

    return _mapped(stored, "frames", make, f"{out} string")


def digests(outputs: DataFrame) -> DataFrame:
    """Outputs without their frames, with the SHA-256 of the output and of the text that is
    rebuilt from the output and its form."""
    def make(codec, row):
        frames = _as_frames(row["frames"])
        return {"output_sha256": codec.digest(frames),
                "restored_sha256": codec.digest(restored_frames(codec, frames, row["form"]))}

    return _mapped(outputs, "frames", make, "output_sha256 string, restored_sha256 string")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's fill-in-the-middle output.

    A null text counts as empty and an empty text is plain; repeated rows give equal rows;
    a null id draws from the seed and colon alone; very long texts go frame by frame; an
    empty table gives no rows. Other columns of the table are not read."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    stored = materialize(store_frames(docs), "fim-frames")
    return digests(fill_in_middle(stored)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: DuckDB SQL of ``op11_fill_in_middle``.
OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1,
    ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
              OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM k),
q AS (
  SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM p)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM q
"""
