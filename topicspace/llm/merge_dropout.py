"""SentencePiece encoding and decoding with seeded merge-dropout.

The model's BPE merges are run from an agenda (best score first, then leftmost).
Each candidate that leaves the agenda is skipped when a keyed hash of its place and
piece falls below the dropout rate, so a word is cut in varied ways that all follow
the model's merge rules and decode to the same text. A rate of zero is the model's
own segmentation.

No piece holds a space after another character, so a text falls into words (spaces,
then other characters) that are segmented independently; so do the parts of a
word between two characters that no piece holds side by side, such as a letter and the
full stop after it. A word's key follows from the seed, the document, the word's place in it and
its characters.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, StructField,
                               StructType)

from topicspace.llm.common import read_table, single_spaced, worker_held

MODEL = "piece_bpe_32k.model"
RATE = 0.1
SEED = 31
#: Nodes of the words' trees that a task keeps between batches.
CACHE_SEGMENTS = 150_000
#: Longest word that has a tree; a longer one runs its agenda as a heap.
WIDE = 64
#: A place without a symbol.
ABSENT = np.int32(-(1 << 31))
#: Rows of an Arrow batch taken at a time.
ROWS_TOGETHER = 1024
#: How pieces write a space. Here words keep their space, so that a space mark that the
#: text itself holds has no piece and becomes its bytes.
MARK = "▁"
#: A word: spaces followed by other characters.
WORD = re.compile(" *[^ ]+| +")
#: Parts words. It is white space, so a text that holds it is not single-spaced.
CUT = "\x1f"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Cells of the matrices in which segments of one length are merged together.
MATRIX_CELLS = 1 << 17
#: Segments gathered from texts before the cache is asked.
SEGMENTS_TOGETHER = 100_000


class Pieces:
    """The pieces of a SentencePiece BPE model and the pairs that merge into one."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids: dict[str, int] = {}
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.out: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i).replace(MARK, " ")
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.out.append(b"")
            else:
                ids[piece] = i
                self.out.append(piece.encode("utf-8"))
        # character -> piece, or minus the code point where there is none
        self.chars = -np.arange(sys.maxunicode + 1, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        #: Neighbouring characters that some piece holds: no merge joins any others.
        self.inside = {ab for piece in ids for ab in zip(piece, piece[1:])}
        # pieces by falling score share ranks where scores are equal
        scores = sorted({model.get_score(i) for i in ids.values()}, reverse=True)
        place = {score: rank for rank, score in enumerate(scores)}
        self.rank = np.zeros(model.get_piece_size(), dtype=np.int32)
        for i in ids.values():
            self.rank[i] = place[model.get_score(i)]
        pairs = [(ids[piece[:k]], ids[piece[k:]], i) for piece, i in ids.items()
                 for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        self._table(np.array(pairs, dtype=np.int64).reshape(-1, 3))

    def _table(self, pairs: np.ndarray) -> None:
        """Open addressing over (left, right): a few probes find a pair or its absence."""
        self.bits = max(4, int(len(pairs) * 8).bit_length())
        self.pair = np.full(1 << self.bits, -1, dtype=np.int64)
        self.joined = np.full(1 << self.bits, -1, dtype=np.int32)
        keys, todo = pairs[:, 0] << 32 | pairs[:, 1], np.arange(len(pairs))
        slot = self._slot(keys)
        while len(todo):
            free = todo[self.pair[slot[todo]] == -1]
            self.pair[slot[free]] = keys[free]
            placed = self.pair[slot[todo]] == keys[todo]
            done = todo[placed]
            self.joined[slot[done]] = pairs[done, 2]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, -1 where the two don't merge."""
        # (a negative symbol makes a negative key, which no pair has)
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found, at = self.pair[slot], self.joined[slot]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found[open_], at[open_] = self.pair[slot[open_]], self.joined[slot[open_]]
            open_ = open_[(found[open_] != keys[open_]) & (found[open_] != -1)]
        return np.where(found == keys, at, -1)

    def simulate(self, words: list[str], skips: list[tuple[int, ...]] | None,
                 keys: np.ndarray | None = None, bound: np.uint64 = np.uint64(0)):
        """Run the agendas of some words together, each with its own candidates skipped
        (by code: place << 32 | piece), or those whose draw is below ``bound``. In each round the best candidate of every word (best
        score, then leftmost) leaves its agenda, and is skipped or merged; merged symbols
        are a linked list over the places, so nothing is moved.

        Gives two ragged arrays as (values, lengths): the pieces of each word, and the codes
        of the candidates that were merged once the last skipped one had been met.
        """
        none = np.iinfo(np.int32).max
        n, size = len(words), np.array([len(w) for w in words])
        width = int(size.max())
        places = np.arange(width + 1)
        inside = places[None, :] < size[:, None]
        symbols = np.full((n, width + 1), ABSENT, dtype=np.int32)
        symbols[inside] = self.chars[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        # places are cells of the flattened matrices
        base = np.arange(n) * (width + 1)
        after = (base[:, None] + np.minimum(places + 1, width)).ravel()
        before = (base[:, None] + np.where(places == 0, width, places - 1)).ravel()
        joined = np.full((n, width + 1), -1, dtype=np.int32)
        joined[:, :-1] = self.merged(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, -1)
        agenda = np.where(joined >= 0, self.rank[joined], none)
        standing = inside.copy()
        most = max(map(len, skips)) if skips else 0
        if most:
            forced = np.full((n, most), -1, dtype=np.int64)
            for i, own in enumerate(skips):
                forced[i, :len(own)] = own
            last = np.array([own[-1] if own else -1 for own in skips], dtype=np.int64)
            free = last < 0  # the last skipped candidate has been met
        symbol, due, pair, stands = symbols.ravel(), agenda.ravel(), joined.ravel(), standing.ravel()
        rows, taken_rows, taken = np.arange(n), [], []
        while len(rows):
            best = (agenda if len(rows) == n else agenda.take(rows, axis=0)).argmin(axis=1)
            cell = base.take(rows) + best
            live = due.take(cell) != none
            if not live.all():
                rows, best, cell = rows[live], best[live], cell[live]
            piece = pair.take(cell)
            code = best.astype(np.int64) << 32 | piece
            due[cell] = none
            if most:
                drop = (forced.take(rows, axis=0) == code[:, None]).any(axis=1)
                new = free[rows] & ~drop
                free[rows] |= code == last[rows]
                taken_rows.append(rows[new])
                taken.append(code[new])
                at, piece = cell[~drop], piece[~drop]
            elif keys is not None:
                keep = draws(keys.take(rows), code) >= bound
                at, piece = cell[keep], piece[keep]
            else:
                taken_rows.append(rows)
                taken.append(code)
                at = cell
            right = after.take(at)
            far = after.take(right)
            symbol[at] = piece
            stands[right] = False
            due[right] = none
            after[at] = far
            before[far] = at
            left = before.take(at)
            # the merged symbol with what stands before it and after it
            place = np.concatenate((left, at))
            met = self.merged(np.concatenate((symbol.take(left), piece)),
                              np.concatenate((piece, symbol.take(far))))
            pair[place] = met
            due[place] = np.where(met >= 0, self.rank.take(met), none)
        flat, lengths = self.bytes_of(symbols[standing], standing.sum(axis=1))
        if keys is not None:
            return (flat, lengths), None
        where = np.concatenate(taken_rows)
        order = np.argsort(where, kind="stable")
        return (flat, lengths), (np.concatenate(taken)[order], np.bincount(where, minlength=n))

    def bytes_of(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become their bytes."""
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return flat, lengths
        raw = [self.byte_ids[list(chr(-x).encode("utf-8"))] for x in flat[odd].tolist()]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        more = np.array([len(x) for x in raw])
        times = np.ones(len(flat), dtype=np.int64)
        times[odd] = more
        out = np.repeat(flat, times)
        starts = np.cumsum(times) - times
        for at, own in zip(starts[odd].tolist(), raw):
            out[at:at + len(own)] = own
        return out, np.bincount(owner, weights=times, minlength=len(lengths)).astype(np.int64)

    def heap_segment(self, word: str, key: int, bound: int) -> np.ndarray:
        """The pieces of one long word: the same agenda as a heap, so that a merge takes
        logarithmic time whatever the word's length. A candidate whose draw is below
        ``bound`` is skipped."""
        symbols = self.chars[np.frombuffer(word.encode("utf-32-le"), np.uint32)]
        own, n = symbols.tolist(), len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\x01") * n
        mask = (1 << self.bits) - 1

        def piece_of(a: int, b: int) -> int:
            if a < 0 or b < 0:
                return -1
            want = a << 32 | b
            slot = (want * int(GOLDEN) & (1 << 64) - 1) >> (64 - self.bits)
            while (found := int(self.pair[slot])) != want:
                if found == -1:
                    return -1
                slot = (slot + 1) & mask
            return int(self.joined[slot])

        first = self.merged(symbols[:-1], symbols[1:])
        # (rank, place, next place, their symbols, piece): stale once a symbol has changed
        heap = [(int(self.rank[first[i]]), i, i + 1, own[i], own[i + 1], int(first[i]))
                for i in np.flatnonzero(first >= 0).tolist()]
        heapq.heapify(heap)
        while heap:
            _, a, b, x, y, piece = heapq.heappop(heap)
            if not (alive[a] and after[a] == b and own[a] == x and own[b] == y):
                continue
            if draw_one(key, a, piece) < bound:
                continue
            own[a], alive[b], far = piece, 0, after[b]
            after[a] = far
            if far < n:
                before[far] = a
            for left, right in ((before[a], a), (a, far)):
                if left >= 0 and right < n and (new := piece_of(own[left], own[right])) >= 0:
                    heapq.heappush(heap, (int(self.rank[new]), left, right, own[left],
                                          own[right], new))
        left = np.array([own[i] for i in range(n) if alive[i]], dtype=np.int32)
        return self.bytes_of(left, np.array([len(left)]))[0]


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def draws(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Keyed 64-bit hashes of merge candidates (splitmix64 of key, place and piece)."""
    return _mix(_mix((keys ^ codes.view(np.uint64)) + GOLDEN))


def draw_one(key: int, place: int, piece: int) -> int:
    """As ``draws``, for one candidate."""
    z = (key ^ (place << 32 | piece)) + int(GOLDEN) & (1 << 64) - 1
    for _ in range(2):
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & (1 << 64) - 1
        z ^= z >> 31
    return z


class Ragged:
    """Rows of different lengths in one growing array."""

    def __init__(self, dtype):
        self.values, self.starts = np.zeros(1 << 12, dtype), np.zeros(1 << 10, np.int64)
        self.lengths, self.rows, self.used = np.zeros(1 << 10, np.int32), 0, 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        n, m = self.rows + len(lengths), self.used + len(values)
        self.values = self._room(self.values, m)
        self.starts, self.lengths = self._room(self.starts, n), self._room(self.lengths, n)
        self.values[self.used:m] = values
        self.lengths[self.rows:n] = lengths
        self.starts[self.rows:n] = self.used + np.cumsum(lengths) - lengths
        self.rows, self.used = n, m

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The values of some rows end to end, the place in ``rows`` that each belongs to,
        and its place within its row."""
        lengths = self.lengths[rows]
        owner = np.repeat(np.arange(len(rows)), lengths)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return self.values[self.starts[rows][owner] + within], owner, within


def alike(words: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of words that come by length: of like length, and not too many."""
    at = 0
    while at < len(words):
        width = -(-len(words[at]) // 4) * 4
        stop = min(bisect_right(words, width, at, key=len), at + max(1, MATRIX_CELLS // max(1, width)))
        yield at, stop
        at = stop


class Encoder:
    """Encodes and decodes whole texts.

    Every word of a text has a key of its own, from seed, document, place and
    characters. What a key leads to is found in a tree for each different word: the root
    is its agenda without a skip, and the child at candidate j is what follows if j is
    the first that is skipped. The draws of all words of a batch are hashed together
    along these paths; only nodes not met before are simulated.
    """

    def __init__(self, path: str, rate: float = RATE, seed: int = SEED):
        # the model's tables stay in the worker; the nodes go with the task
        self.pieces = worker_held(("pieces", path), lambda: Pieces(path))
        self.seed = seed
        self.bound = min(int(rate * (1 << 64)), (1 << 64) - 1)
        self._clear()
        inside = self.pieces.inside
        self.lone_feed = not any("\n" in ab for ab in inside)
        joined = {a for a, b in inside if b in ".,"} | {" ", CUT}
        self.last_mark = re.compile(f"(?<![{re.escape(''.join(sorted(joined)))}])([.,]){CUT}")

    def _clear(self) -> None:
        self.roots: dict[str, int] = {}
        self.children: dict[int, int] = {}  # node << 32 | candidate -> node
        self.words: list[str] = []          # of each node
        self.skips: list[tuple[int, ...]] = []
        self.ids, self.path = Ragged(np.int32), Ragged(np.int64)
        self.chars = np.zeros(0, dtype=np.uint64)  # of each root, by node

    def _grow(self, words: list[str], skips: list[tuple[int, ...]]) -> int:
        """Add a node for each of some words, which come by length, with its skipped
        candidates; gives the first one's number."""
        first = len(self.words)
        self.words += words
        self.skips += skips
        for start, stop in alike(words):
            ids, path = self.pieces.simulate(words[start:stop], skips[start:stop])
            self.ids.add(*ids)
            self.path.add(*path)
        return first

    def _root_nodes(self, words: list[str]) -> np.ndarray:
        """The root of each word. Words that are new and stand once have none, nor have
        words that are too long for the tree: -1."""
        new = sorted((w for w, n in Counter(words).items()
                      if n > 1 and w not in self.roots and len(w) <= WIDE), key=len)
        if new:
            first = self._grow(new, [()] * len(new))
            self.roots.update(zip(new, range(first, first + len(new))))
            self.chars = Ragged._room(self.chars, len(self.words))
            self.chars[first:first + len(new)] = [char_hash(w) for w in new]
        return np.fromiter(map(self.roots.get, words, repeat(-1)), np.int64, len(words))

    def _leaves(self, node: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The node at which each word ends: where none of the candidates that follow is
        skipped."""
        node, live = node.copy(), np.flatnonzero(node >= 0)
        while len(live) and self.bound:
            codes, owner, within = self.path.take(node[live])
            hits = np.flatnonzero(draws(keys[live][owner], codes) < np.uint64(self.bound))
            hit = owner[hits]
            first = np.ones(len(hit), dtype=bool)
            first[1:] = hit[1:] != hit[:-1]
            hits, hit = hits[first], hit[first]
            live = live[hit]
            edges, where, back = np.unique(node[live] << 32 | within[hits], return_index=True,
                                           return_inverse=True)
            known = [self.children.get(e, -1) for e in edges.tolist()]
            new = [(i, e >> 32, c) for i, (k, e, c) in enumerate(zip(
                known, edges.tolist(), codes[hits[where]].tolist())) if k < 0]
            if new:
                new.sort(key=lambda x: len(self.words[x[1]]))
                at = self._grow([self.words[p] for _, p, _ in new],
                                [(*self.skips[p], c) for _, p, c in new])
                for i, _, _ in new:
                    known[i] = self.children[int(edges[i])] = at
                    at += 1
            node[live] = np.array(known, dtype=np.int64)[back]
        return node

    def _words(self, text: str) -> list[str]:
        """The text's words, each with the space before it. Line feeds, and full stops and
        commas at the end of a word, are words of their own where no piece joins them to
        their neighbours."""
        if not single_spaced(text):
            return WORD.findall(f" {text}")
        parted = f" {text}{CUT}".replace(" ", f"{CUT} ")
        if self.lone_feed:
            parted = parted.replace("\n", f"{CUT}\n{CUT}")
        return [w for w in self.last_mark.sub(rf"{CUT}\1{CUT}", parted).split(CUT) if w]

    def _segment(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of some words end to end, and how many each has. ``keys`` are the words'
        places' keys."""
        if len(self.words) > CACHE_SEGMENTS:
            self._clear()
        node = self._root_nodes(words)
        known = node >= 0
        own = keys.copy()
        own[known] = _mix(own[known] ^ self.chars[node[known]])
        unknown = np.flatnonzero(~known)
        texts = [words[i] for i in unknown.tolist()]
        by_length = np.argsort(np.fromiter(map(len, texts), np.int64, len(texts)), kind="stable")
        alone, texts = unknown[by_length], [texts[i] for i in by_length.tolist()]
        own[alone] = _mix(own[alone] ^ np.fromiter(map(char_hash, texts), np.uint64, len(texts)))
        node = self._leaves(node, own)
        # the words without a tree run their own agendas; their rows stay for this call only
        rows, used = self.ids.rows, self.ids.used
        node[alone] = np.arange(rows, rows + len(alone))
        short = bisect_right(texts, WIDE, key=len)
        for start, stop in alike(texts[:short]):
            self.ids.add(*self.pieces.simulate(texts[start:stop], None, own[alone[start:stop]],
                                               np.uint64(self.bound))[0])
        for text, i in zip(texts[short:], alone[short:].tolist()):
            found = self.pieces.heap_segment(text, int(own[i]), self.bound)
            self.ids.add(found, np.array([len(found)]))
        taken = self.ids.take(node)[0], self.ids.lengths[node]
        self.ids.rows, self.ids.used = rows, used
        return taken

    def encode_batch(self, texts: list[str | None], documents: list[int]) -> list[np.ndarray]:
        """Piece ids of each text; ``documents`` are the keys of the texts."""
        done: list[np.ndarray] = []
        words: list[str] = []
        keys: list[np.ndarray] = []
        sizes: list[int] = []
        for i, text in enumerate(texts):
            own = self._words(text) if text else []
            z = np.uint64((documents[i] ^ self.seed) & (1 << 64) - 1) \
                + np.arange(1, len(own) + 1, dtype=np.uint64) * GOLDEN
            words += own
            keys.append(z)
            sizes.append(len(own))
            if len(words) >= SEGMENTS_TOGETHER or i == len(texts) - 1:
                if words:
                    ids, lengths = self._segment(words, _mix(np.concatenate(keys)))
                else:
                    ids = lengths = np.zeros(0, dtype=np.int32)
                ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *sizes])]
                done += [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                words, keys, sizes = [], [], []
        return done

    def decode(self, ids) -> str:
        """The text of the ids, without the space that encoding puts first."""
        out = self.pieces.out
        raw = b"".join(map(out.__getitem__, ids))
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def char_hash(word: str) -> int:
    """A 64-bit hash of a word's characters."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def encode_documents(df: DataFrame, model: str | None = None, rate: float = RATE,
                     seed: int = SEED, text: str = "text",
                     id_col: str = "doc_id", decode: bool = True) -> DataFrame:
    """``(id_col, ids, n_pieces, ids_crc32, lossless)`` for every row: the piece ids of
    the whole text, their number, the unsigned CRC-32 of the ids as little-endian
    32-bit integers, and whether they decode to the text.

    A null text has null ids, no pieces and null ``lossless``; an empty text has no
    ids. The document key is a hash of the id and the text, so equal rows are cut
    alike and equal texts of different documents differently. ``model`` is the path
    of a SentencePiece BPE model with byte fallback.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    schema = StructType([
        StructField(id_col, df.schema[id_col].dataType),
        StructField("ids", ArrayType(IntegerType())), StructField("n_pieces", IntegerType()),
        StructField("ids_crc32", LongType()), StructField("lossless", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, rate, seed)
        parts = (batch.slice(at, ROWS_TOGETHER) for batch in batches
                 for at in range(0, batch.num_rows, ROWS_TOGETHER))
        for batch in parts:
            ids, texts = batch.column(id_col), batch.column(text).to_pylist()
            flat, ends, sums, fits = array("i"), [0], [], []
            names = [xxhash.xxh64_intdigest(f"{own} {value}".encode(), seed)
                     for own, value in zip(ids.to_pylist(), texts)]
            for value, found in zip(texts, encoder.encode_batch(texts, names)):
                flat.frombytes(found.tobytes())
                ends.append(len(flat))
                sums.append(None if value is None else zlib.crc32(found.astype("<i4").tobytes()))
                fits.append(None if value is None else
                            encoder.decode(found.tolist()) == value if decode else None)
            nulls = np.array([v is None for v in texts], dtype=bool)
            offsets = pa.array(np.array(ends, dtype=np.int32),
                               mask=np.append(nulls, False))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(flat, np.int32)
                                                               if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([
                ids, lists, pa.array(np.diff(ends).astype(np.int32)), pa.array(sums, pa.int64()),
                pa.array(fits, pa.bool_())],
                names=schema.names)

    return df.select(id_col, text).mapInArrow(run, schema)


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents in a seeded merge-dropout segmentation, decoded
    again. An empty table gives no rows."""
    return encode_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))
