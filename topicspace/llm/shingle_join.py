"""N-gram Jaccard join by T-occurrence search.

A document's set holds its different shingles as 64-bit hashes; documents with equal sets
form a class. Classes link when their sets overlap enough, and each class gets the
component that chains of links connect.

1. *Meeting.* Sets that link differ in few shingles for their size. The hash range is cut
   into one segment more than that, so two linked sets agree on a whole segment; sizes fall
   into bands, and a set takes part in its own and the next one, so that linked sets share a
   band. Sets that share a segment are joined to coarse groups. Most sets share none and are
   done: only the others are looked at again.
2. *Search.* The sets of a coarse group are searched against each other with inverted
   lists: a set's longest lists are set aside, the short ones are heap-merged for sets that
   occur often enough, and those are probed in the long ones by binary search (DivideSkip).
   What a search finds leaves the lists, so copies give a spanning forest and never all
   pairs.

A coarse group that is too large for one task is cut into pieces, and every two pieces are
searched together.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspace.llm.common import materialize, read_table
from topicspace.llm.components import connected_components

SHINGLE_WORDS = 3
PERCENT = 90
#: Words hashed together, so that short texts share the cost of a numpy call.
WORDS_TOGETHER = 1 << 16
#: Segment keys of a task that are combined before they are shuffled.
KEYS_TOGETHER = 1 << 18
#: Shingles of a coarse group that one task searches.
BLOCK_SHINGLES = 1 << 20
#: Entries of short lists up to which a heap merges them; beyond, a stable sort merges the
#: lists laid end to end.
HEAP_ENTRIES = 1 << 12
#: Weight of a probe against a merge step in the choice of how many lists are long.
PROBE_WEIGHT = 0.0085

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)


def _mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = (z ^ (z >> _S30)) * _M1
    z = (z ^ (z >> _S27)) * _M2
    return z ^ (z >> _S31)


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text: of words (lower-case A-Z) hashed in
    turn. Fewer words than a shingle make one shingle of the whole sequence; a text
    without words, or a null one, has none."""
    digest = xxhash.xxh3_64_intdigest
    out: list[np.ndarray] = []
    words: list[bytes] = []
    sizes: list[int] = []

    def flush():
        w = np.fromiter(map(digest, words), np.uint64, len(words))
        h = _mix(w + _GOLDEN)
        for k in range(1, shingle):
            # h[i] covers words i to i + k
            h = _mix(h[:max(0, len(w) - k)] + w[k:] * _GOLDEN + _GOLDEN)
        at = 0
        for n in sizes:
            if n >= shingle:
                out.append(np.unique(h[at:at + n - shingle + 1]))
            elif n:
                out.append(np.array([digest(b" ".join(words[at:at + n]))], dtype=np.uint64))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += n
        words.clear()
        sizes.clear()

    for text in texts:
        own = text.encode("utf-8").lower().split() if text else []
        words += own
        sizes.append(len(own))
        if len(words) >= WORDS_TOGETHER:
            flush()
    flush()
    return out


def class_of(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def least_overlap(a: int, b, percent: int):
    """The overlap at which sets of sizes ``a`` and ``b`` link."""
    return -(-percent * (a + b) // (100 + percent))


class Bands:
    """Size bands for a similarity: linked sets are in one band or in neighbouring ones."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be from 1 to 100")
        self.percent, self.last = percent, [0, 1]  # the largest size of each band

    def band(self, size: int) -> int:
        while self.last[-1] < size and self.percent < 100:
            self.last.append(100 * (self.last[-1] + 1) // self.percent)
        return bisect_left(self.last, size) if self.percent < 100 else size

    def most(self, band: int) -> int:
        """The largest size of a band."""
        if self.percent == 100:
            return band
        while len(self.last) <= band:
            self.last.append(100 * (self.last[-1] + 1) // self.percent)
        return self.last[band]

    def segments(self, band: int) -> int:
        """One more than the shingles in which linked sets of the band can differ."""
        return (100 - self.percent) * 2 * self.most(band) // (100 + self.percent) + 1


def segment_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Hashes of (band, segment, the set's shingles in that segment) for every segment of the
    set's band and the next one."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_mix(shingles ^ _GOLDEN), dtype=np.uint64)))
    own = bands.band(len(shingles))
    keys = []
    for band in (own, own + 1):
        n = bands.segments(band)
        edges = np.arange(1, n, dtype=np.uint64) * np.uint64(min((1 << 64) // n, (1 << 64) - 1))
        ends = np.concatenate((np.searchsorted(shingles, edges), [len(shingles)]))
        starts = np.concatenate(([0], ends[:-1]))
        place = np.arange(n, dtype=np.uint64) + np.uint64(band << 44)
        keys.append(_mix((sums[ends] - sums[starts]) ^ _mix(place + _GOLDEN)))
    return np.concatenate(keys).view(np.int64)


class Lists:
    """Inverted lists: of each shingle the ascending places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray], owners: np.ndarray):
        self.owners = owners  # ascending: places of the indexed sets
        sizes = np.array([len(sets[i]) for i in owners])
        flat = np.concatenate([sets[i] for i in owners])
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.rows = np.repeat(owners, sizes)[order]
        self.starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        self.ends = np.concatenate((self.starts[1:], [len(flat)]))
        self.values = flat[self.starts]

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lists of some shingles."""
        at = np.searchsorted(self.values, shingles)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == shingles]
        return self.starts[at], self.ends[at]


def merge_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Members that occur on at least ``least`` of the sorted lists, with how often: a heap
    of the lists' heads; where too few heads agree, so many lists are popped that none of
    them alone can matter, and each skips by binary search to the next head."""
    heads = [(own[0], k, 0) for k, own in enumerate(lists) if own]
    heapq.heapify(heads)
    found: dict[int, int] = {}
    while len(heads) >= least:
        top, popped = heads[0][0], []
        while heads and heads[0][0] == top:
            popped.append(heapq.heappop(heads))
        if len(popped) >= least:
            found[top] = len(popped)
            goal = top + 1
        else:
            while heads and len(popped) < least - 1:
                popped.append(heapq.heappop(heads))
            if not heads:
                break
            goal = max(top + 1, heads[0][0])
        for _, k, at in popped:
            at = bisect_left(lists[k], goal, at)
            if at < len(lists[k]):
                heapq.heappush(heads, (lists[k][at], k, at))
    return found


def run_merge(runs: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``merge_skip`` for long lists: a stable sort merges the sorted runs."""
    members, counts = np.unique(np.sort(np.concatenate(runs), kind="stable"), return_counts=True)
    often = counts >= least
    return members[often], counts[often]


def search(index: Lists, query: np.ndarray, sizes: np.ndarray, alive: np.ndarray,
           percent: int) -> np.ndarray:
    """Places of the indexed sets, still alive, that link with the query (T-occurrence
    search by DivideSkip). ``sizes`` are ascending."""
    n = len(query)
    least = -(-percent * n // 100)  # no linked set shares fewer
    starts, ends = index.of(query)
    if len(starts) < least:
        return np.zeros(0, dtype=np.int64)
    low = np.searchsorted(sizes, least)
    high = np.searchsorted(sizes, 100 * n // percent, side="right")
    length = ends - starts
    order = np.argsort(length, kind="stable")
    longest = int(length[order[-1]])
    aside = min(least - 1, int(least / (PROBE_WEIGHT * math.log2(longest + 1) + 1)))
    short, long = order[:len(order) - aside], order[len(order) - aside:]
    need = least - aside
    runs = [index.rows[s:e] for s, e in zip(starts[short].tolist(), ends[short].tolist())]
    if int(length[short].sum()) <= HEAP_ENTRIES:
        found = merge_skip([[x for x in run.tolist() if low <= x < high and alive[x]]
                            for run in runs], need)
        members = np.fromiter(found.keys(), np.int64, len(found))
        counts = np.fromiter(found.values(), np.int64, len(found))
    else:
        rows = np.concatenate(runs)
        members, counts = run_merge([rows[alive[rows] & (rows >= low) & (rows < high)]], need)
    wanted = least_overlap(n, sizes[members], percent)
    left = len(long)
    for k in long.tolist():
        if not len(members):
            break
        run = index.rows[starts[k]:ends[k]]
        at = np.searchsorted(run, members)
        counts = counts + (run[np.minimum(at, len(run) - 1)] == members)
        left -= 1
        still = counts + left >= wanted
        members, counts, wanted = members[still], counts[still], wanted[still]
    return members[counts >= wanted]


def spanning_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that connect exactly the sets that chains of links
    connect. Each set is a query once; what it finds leaves the lists, which are built anew
    when half of them has gone."""
    by_size = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: len(sets[i]))
    own = [sets[i] for i in by_size]
    sizes = np.array([len(s) for s in own], dtype=np.int64)
    alive = np.ones(len(own), dtype=bool)
    links: list[tuple[int, int]] = []
    if len(own) < 2:
        return links
    index, left = Lists(own, np.arange(len(own))), len(own)
    for seed in range(len(own)):
        if not alive[seed]:
            continue
        alive[seed] = False
        left -= 1
        queue = [seed]
        while queue and left:
            if 2 * left < len(index.owners):
                index = Lists(own, np.flatnonzero(alive))
            query = queue.pop()
            found = search(index, own[query], sizes, alive, percent)
            alive[found] = False
            left -= len(found)
            queue += found.tolist()
            links += [(by_size[query], by_size[d]) for d in found.tolist()]
    return links


def _meet_task(id_col: str, text: str, shingle: int, percent: int):
    """Arrow function: per document its class, the keys for which it stands first in its
    task, and the classes it has met there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        ids: list[pa.Array] = []
        sets: list[tuple[int, bytes, np.ndarray]] = []
        held = 0

        def give() -> pa.RecordBatch:
            shorts = np.array([int.from_bytes(c[:8], "little", signed=True) for _, c, _ in sets],
                              dtype=np.int64)
            _, first = np.unique(shorts, return_index=True)
            is_first = np.zeros(len(sets), dtype=bool)
            is_first[first] = True
            counts = np.array([len(k) if is_first[i] else 0 for i, (_, _, k) in enumerate(sets)],
                              dtype=np.int64)
            keys = np.concatenate([np.zeros(0, dtype=np.int64),
                                   *(k for i, (_, _, k) in enumerate(sets) if is_first[i])])
            rows = np.repeat(np.arange(len(sets)), counts)
            order = np.argsort(keys, kind="stable")
            sorted_keys = keys[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = sorted_keys[1:] != sorted_keys[:-1]
            heads = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            leads = np.zeros(len(keys), dtype=bool)
            leads[order] = new
            # (member, head) of every local group, each once
            met = np.stack([rows[order][~new], rows[order][heads[~new]]], axis=1)
            met = np.unique(met, axis=0)
            met = met[met[:, 0] != met[:, 1]]

            def lists(owner: np.ndarray, values: np.ndarray) -> pa.Array:
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sets)))))
                return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))

            return pa.RecordBatch.from_arrays([
                pa.concat_arrays(ids), pa.array([n for n, _, _ in sets], pa.int64()),
                pa.array([c for _, c, _ in sets], pa.binary()), pa.array(shorts),
                lists(rows[leads], keys[leads]), lists(met[:, 0], shorts[met[:, 1]])],
                names=["doc_id", "n", "cls", "c", "keys", "near"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = shingle_sets(part.column(text).to_pylist(), shingle)
                ids.append(part.column(id_col))
                for own in found:
                    keys = segment_keys(own, bands) if len(own) else np.zeros(0, dtype=np.int64)
                    sets.append((len(own), class_of(own), keys))
                    held += len(keys)
                if held >= KEYS_TOGETHER:
                    yield give()
                    ids, sets, held = [], [], 0
        if sets:
            yield give()

    return run


def _first_of_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, c) sorted by both: (first c, other c) of each key."""
    last_key = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, c = (batch.column(x).to_numpy() for x in ("key", "c"))
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        head = c[at]
        if last_key is not None and key[0] == last_key:
            head[at == 0] = first
        last_key, first = key[-1], head[-1]
        other = head != c
        pairs = np.unique(np.stack([head[other], c[other]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]))
                                          for k in (0, 1)], names=["a", "b"])


def coarse_groups(marked: DataFrame) -> DataFrame:
    """``(node, root)`` of the classes (by their short names) that share a segment with
    another one."""
    keys = (marked.select(F.explode("keys").alias("key"), "c")
            .repartition("key").sortWithinPartitions("key", "c"))
    edges = keys.mapInArrow(_first_of_key, "a bigint, b bigint").unionByName(
        marked.select(F.explode("near").alias("a"), F.col("c").alias("b")))
    return connected_components(edges)


def _set_task(text: str, shingle: int):
    """Arrow function: the shingles of each row whose text is of the class it was joined
    for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = shingle_sets(part.column(text).to_pylist(), shingle)
                fits = [i for i, (own, c) in enumerate(zip(found, part.column("cls").to_pylist()))
                        if class_of(own) == c]
                kept = part.take(pa.array(fits, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("root"), kept.column("pieces"), kept.column("cls"),
                     pa.array([found[i].tobytes() for i in fits], pa.binary())],
                    names=["root", "pieces", "cls", "shingles"])

    return run


def _search_task(percent: int):
    """Arrow function over rows sorted by (root, i, j): the links of each block."""

    def links_of(names: list[bytes], raw: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        own = dict(zip(names, raw))  # a class once
        names = list(own)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in own.values()]
        for a, b in spanning_links(sets, percent):
            yield names[a], names[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, raw = None, [], []
        parts = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))
        for batch in parts:
            out: list[tuple[bytes, bytes]] = []
            keys = zip(*(batch.column(k).to_pylist() for k in ("root", "i", "j")))
            for key, name, own in zip(keys, batch.column("cls").to_pylist(),
                                      batch.column("shingles").to_pylist()):
                if key != block:
                    out += links_of(names, raw)
                    block, names, raw = key, [], []
                names.append(name)
                raw.append(own)
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.binary()),
                                                  "b": pa.array([b for _, b in out], pa.binary())})
        out = list(links_of(names, raw))
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.binary()),
                                          "b": pa.array([b for _, b in out], pa.binary())})

    return run


def _blocks(piece: Column, pieces: Column) -> Column:
    """The (i, j) blocks of a member in ``piece`` of ``pieces``: the only one of an uncut
    group, else every two pieces that include its own."""
    others = F.filter(F.sequence(F.lit(0), pieces - 1), lambda p: p != piece)
    return F.when(pieces == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))) \
        .otherwise(F.transform(others, lambda p: F.struct(
            F.least(piece, p).alias("i"), F.greatest(piece, p).alias("j"))))


def marked_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                     shingle: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n, cls, c, keys, near)`` of every document: the size and the name of its
    set, a short name, and what the meeting needs. Written once, as it is read again."""
    kind = docs.schema[id_col].dataType.simpleString()
    run = _meet_task(id_col, text, shingle, percent)
    return materialize(docs.select(id_col, text).mapInArrow(
        run, f"doc_id {kind}, n bigint, cls binary, c bigint, keys array<bigint>, "
             "near array<bigint>"), "shingle-docs")


def class_links(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text: str = "text",
                shingle: int = SHINGLE_WORDS, percent: int = PERCENT,
                block: int = BLOCK_SHINGLES) -> DataFrame:
    """Links ``(a, b)`` between classes of ``marked``: they connect exactly the classes that
    chains of links connect."""
    groups = materialize(coarse_groups(marked), "shingle-groups")
    # one document stands for a class; rows that repeat its id are told apart by their text
    classes = (marked.where("n > 0").join(groups, F.col("c") == F.col("node"))
               .groupBy("cls", "root").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    classes = materialize(classes, "shingle-classes")
    sizes = classes.groupBy("root").agg(
        F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("pieces"))
    wanted = classes.join(sizes, "root").select("rep", "cls", "root", "pieces")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    # always by shuffle: the wanted ids grow with the table, so no size of it proves small
    sets = (texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("rep")))
            .select("text", "root", "pieces", "cls")
            .mapInArrow(_set_task("text", shingle),
                        "root bigint, pieces int, cls binary, shingles binary"))
    piece = F.pmod(F.xxhash64("cls"), F.col("pieces")).cast("int")
    dealt = sets.select("root", "cls", "shingles",
                        F.explode(_blocks(piece, F.col("pieces"))).alias("w"))
    blocks = (dealt.select("root", "w.i", "w.j", "cls", "shingles")
              .repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"))
    return blocks.mapInArrow(_search_task(percent), "a binary, b binary")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                       shingle: int = SHINGLE_WORDS, percent: int = PERCENT,
                       block: int = BLOCK_SHINGLES) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` of every document: the size of its set and the
    smallest id that links reach (null ids are passed over where there are others).
    Documents link when 100 times the overlap of their sets is at least ``percent`` times
    the union. Shingles are compared by 64-bit hashes."""
    marked = marked_documents(docs, id_col, text, shingle, percent)
    links = materialize(class_links(docs, marked, id_col, text, shingle, percent, block),
                        "shingle-links")
    roots = connected_components(links)
    names = marked.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    rooted = materialize(names.join(roots, F.col("cls") == F.col("node"), "left").select(
        "cls", "first", F.coalesce("root", "cls").alias("root")), "shingle-names")
    reached = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(reached, "root").select("cls", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return marked.select("doc_id", "n", "cls").join(named, "cls", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op12_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document.

    A null or wordless text has an empty set and is its own component; documents with equal
    sets link, so repeated rows get equal results; a null id names no component unless all
    its documents lack one; very long texts are whole; an empty table gives no rows. Other
    columns of the table are not read."""
    return jaccard_components(read_table(spark, sf_dir, "documents", "doc_id", "text"))


#: DuckDB SQL of ``op12_shingle_join``.
OP12_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(l) = 0 THEN []::VARCHAR[]
    WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
    ELSE list_distinct(list_transform(range(1, len(l) - 1),
      lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) END AS l FROM w),
c AS (SELECT list_sort(l) AS l, min(doc_id) AS id FROM s GROUP BY 1),
n AS (SELECT id, len(l) AS n FROM c),
t AS (SELECT id, unnest(l) AS shingle FROM c),
pairs AS (
  SELECT a.id AS a, b.id AS b, count(*) AS shared FROM t a JOIN t b USING (shingle)
  WHERE a.id < b.id GROUP BY a.id, b.id),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.id = a JOIN n y ON y.id = b
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
  SELECT id, id FROM c UNION SELECT r.a, ways.b FROM reach r JOIN ways ON ways.a = r.b),
roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.l) AS BIGINT) AS n_shingles,
  CASE WHEN len(s.l) = 0 THEN s.doc_id ELSE roots.root END AS component_id
FROM s JOIN c ON c.l = list_sort(s.l) JOIN roots ON roots.id = c.id
"""
