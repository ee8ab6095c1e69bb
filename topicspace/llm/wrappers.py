"""Main text of web pages by wrappers: union-free regular expressions of a host's pages.

A page is a stream of block tags and text slots. Streams of one host are aligned one
after the other: where they differ, the tokens of one side become an optional group, or
a repeated group if they continue what stands before them. The result, a wrapper, is a
regular expression without unions that matches every page of the host. At its text
positions the strings of all pages are counted: one that most of the pages have there is
a constant of the template, the others fill a slot. A page's main text is what fills the
slots inside its article, outside of its menus, headers, footers, sidebars, notices,
adverts, forms and comments; which part that is, tags and class words of the page tell.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspace.llm.common import materialize, read_table, worker_held

#: Wrapper bytes in all that are sent to every task; more are joined by host.
BROADCAST_BYTES = 8 << 20
#: Groups in which a host's streams are aligned before their wrappers are.
SALTS = 16
#: A string is a constant of its position if at least so many different pages of the host
#: have it there, and this share of the pages that have the position.
CONSTANT_PAGES, CONSTANT_SHARE = 6, 0.8
#: Share of a page's text that marked parts hold at least to be its main text.
MAIN_SHARE = 0.25

# Element and attribute vocabulary of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "math"}
#: An element that ends when one of these starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"},
        "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SIDE_TAGS = {"nav", "header", "footer", "aside", "form", "head", "title", "button", "select",
             "dialog", "menu", "fieldset"}
MAIN_TAGS = {"article", "main"}
#: Elements that no class word makes a side part.
FRAME_TAGS = {"html", "body", "article", "main"}
SIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored",
              "promo", "cookie", "cookies", "consent", "notice", "sidebar", "menu", "nav",
              "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead",
              "share", "sharing", "social", "related", "recommended", "comment", "comments",
              "reply", "replies", "discussion", "newsletter", "subscribe", "popup", "modal",
              "widget", "pagination", "toolbar", "login", "signup", "search"}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}

# An item of a stream or wrapper: [label, items inside, repeated, optional]. A text slot
# has the label "#".
TEXT = "#"


def label_of(name: str, attributes: str) -> str:
    """The element's name with the telling words of its class, id and role."""
    if "=" not in attributes:
        return name
    words = {w for value in NAMED.findall(attributes)
             for w in re.split(r"[^a-z]+", value.lower())}
    told = sorted(words & (SIDE_WORDS | MAIN_WORDS))
    return ".".join([name, *told])


def parse(page: str) -> list:
    """Nested items of a page; a text item is ``["#", text]``, its white space made one
    space, its character references decoded. Inline tags are no tokens; missing end
    tags are supplied; scripts, styles and comments are left out."""
    root: list = ["", []]
    stack, text, at = [root], [], 0

    def end_text() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                stack[-1][1].append([TEXT, whole])

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in RAW and not m[1]:
            close = None if m[3].endswith("/") else RAW_END[name].search(page, at)
            at = close.end() if close else at if m[3].endswith("/") else len(page)
            continue
        if name == "br":
            text.append(" ")
        if name in INLINE or name in VOID or name in RAW:
            continue
        end_text()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][2] == name:
                    del stack[depth:]
                    break
            continue
        if stack[-1][-1] == "p" and len(stack) > 1:
            stack.pop()
        while len(stack) > 1 and name in ENDS.get(stack[-1][2], ()):
            stack.pop()
        item = [label_of(name, m[3]), [], name]
        stack[-1][1].append(item)
        if not m[3].endswith("/"):
            stack.append(item)
    end_text()
    return root[1]


def stream(items: list) -> list:
    """The folded stream of parsed items: neighbours of one label are one repeated
    item."""
    return fold([[TEXT, [], False, False] if x[0] == TEXT else [x[0], stream(x[1]), False, False]
                 for x in items])


def fold(items: list) -> list:
    """Runs of equal labels become one repeated item that fits all of them; runs of equal
    pairs of labels become a repeated group."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            out[-1] = [item[0], align(out[-1][1], item[1]), True, out[-1][3] and item[3]]
            continue
        out.append(item)
        if len(out) >= 4 and [x[0] for x in out[-4:-2]] == [x[0] for x in out[-2:]]:
            out[-4:] = [["()", align(out[-4:-2], out[-2:]), True, False]]
        elif len(out) >= 3 and out[-3][0] == "()" and \
                [x[0] for x in out[-3][1]] == [x[0] for x in out[-2:]]:
            out[-3:] = [["()", align(out[-3][1], out[-2:]), True, out[-3][3]]]
    return out


def align(a: list, b: list) -> list:
    """The union-free expression that matches what ``a`` or ``b`` match: items that meet
    are aligned inside, the others become optional."""
    if not a or not b:
        return [[x[0], x[1], x[2], True] for x in a or b]
    if [x[0] for x in a] == [x[0] for x in b]:
        pairs = list(zip(range(len(a)), range(len(b))))
    else:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = (best[i + 1][j + 1] + 1 if a[i][0] == b[j][0]
                              else max(best[i + 1][j], best[i][j + 1]))
        pairs, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i][0] == b[j][0]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += [[x[0], x[1], x[2], True] for x in a[i:p] + b[j:q]]
        if p < len(a):
            out.append([a[p][0], align(a[p][1], b[q][1]), a[p][2] or b[q][2], a[p][3] or b[q][3]])
        i, j = p + 1, q + 1
    return fold(out) if any(x[0] == y[0] for x, y in zip(out, out[1:])) else out


def expression(items: list) -> str:
    """A wrapper as a readable regular expression."""
    parts = []
    for label, inside, repeated, optional in items:
        text = ("(.*)" if label == TEXT else f"(?:{expression(inside)})" if label == "()"
                else f"<{label}>{expression(inside)}</{label.split('.')[0]}>")
        mark = {(True, True): "*", (True, False): "+", (False, True): "?"}.get((repeated, optional))
        parts.append(f"(?:{text}){mark}" if mark else text)
    return "".join(parts)


def is_side(label: str, in_main: bool, most: bool = False) -> bool:
    """Whether an element is a side part. One with ``most`` of the page's text is not so
    for a class word or as a form."""
    name, *words = label.split(".")
    if name == "header" and in_main and not words:
        return False
    if name in SIDE_TAGS:
        return name != "form" or not most
    return name not in FRAME_TAGS and not most and bool(SIDE_WORDS & set(words))


def is_main(label: str) -> bool:
    name, *words = label.split(".")
    return name in MAIN_TAGS or bool(MAIN_WORDS & set(words))


def main_of(wrapper: list) -> str:
    """What marks the main text in a wrapper or page: ``tag`` if an article or main element
    stands outside of the side parts, else ``word`` if a telling class does, else the
    whole ``page``."""
    found = set()

    def walk(items: list) -> None:
        for label, inside, *_ in items:
            if label == TEXT or is_side(label, False):
                continue
            if is_main(label):
                found.add("tag" if label.split(".")[0] in MAIN_TAGS else "word")
            walk(inside)

    walk(wrapper)
    return next((kind for kind in ("tag", "word") if kind in found), "page")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(),
                          "little", signed=True)


def slots(wrapper: list, path: str = "", out: dict | None = None) -> dict:
    """The wrapper's positions: what is inside of each label, and for ``#`` the position's
    hash. Items of one label side by side are one position."""
    out = {} if out is None else out
    for label, inside, *_ in wrapper:
        if label == TEXT:
            out[TEXT] = _hash(path)
        elif label == "()":
            slots(inside, path, out)
        else:
            slots(inside, f"{path}/{label}", out.setdefault(label, {}))
    return out


def strings(items: list, known: dict) -> tuple[int, list[tuple[int, int | None]]]:
    """A hash of a page's text outside of its side parts, and ``(position, string)`` hashes
    of it, each once; a position alone has the string None. ``known`` keeps the hashes
    of positions."""
    found, whole = {}, []

    def walk(inside: list, path: str, side: bool) -> None:
        for x in inside:
            if x[0] != TEXT:
                if x[2] not in SIDE_TAGS or x[2] in ("header", "form"):
                    walk(x[1], f"{path}/{x[0]}", side or is_side(x[0], False))
                continue
            if path not in known:
                if len(known) > 65536:
                    known.clear()
                known[path] = _hash(path)
            text = _hash(f"{path}\0{x[1]}")
            found[known[path], None] = found[known[path], text] = True
            if not side:
                whole.append(text)

    walk(items, "", False)
    return _hash(repr(whole)), list(found)


def weigh(items: list) -> int:
    """Characters of text outside of the side tags; each element keeps its own number."""
    n = 0
    for x in items:
        if x[0] == TEXT:
            n += len(x[1])
        else:
            x[3:] = [weigh(x[1])]
            n += x[3] if x[2] not in SIDE_TAGS or x[2] == "form" else 0
    return n


def extract(items: list, wrapper_slots: dict, constants: dict, mark: str, half: float,
            path: str = "", in_main: bool = False) -> list[str]:
    """Text of a weighed page inside the parts that ``mark`` tells, in page order, without
    the constants of the wrapper's positions. An element with more text than ``half``
    holds most of the page."""
    out = []
    for x in items:
        label, inside = x[0], x[1]
        known = wrapper_slots.get(label)
        if label == TEXT:
            fixed = constants.get(known)
            if in_main and not (fixed and _hash(f"{path}\0{inside}") in fixed):
                out.append(inside)
        elif not is_side(label, in_main, x[3] > half):
            name = x[2]
            opens = (name in MAIN_TAGS if mark == "tag" else is_main(label) if mark == "word"
                     else name not in ("html", "head"))
            out += extract(inside, known or {}, constants, mark, half, f"{path}/{label}",
                           in_main or opens)
    return out


def main_text(items: list, wrapper_slots: dict, constants: dict) -> list[str]:
    """A page's main text: its article and main elements, or the elements with a telling
    class, or the whole page; a mark counts where its parts hold enough of the page's
    text. Text that is constant altogether, as on copies of one page, is kept."""
    half = weigh(items) / 2
    for fixed in ([constants, {}] if constants else [{}]):
        rest = sum(map(len, extract(items, wrapper_slots, fixed, "page", float("inf"))))
        for mark in ("tag", "word", "page"):
            found = extract(items, wrapper_slots, fixed, mark, half)
            if found and (mark == "page" or sum(map(len, found)) >= MAIN_SHARE * rest):
                return found
    return []


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(
        url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _streams(page: str):
    kind = pa.list_(pa.struct([("place", pa.int64()), ("string", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            found, wholes, texts = [], [], []
            for p in batch.column(page).to_pylist():
                items = parse(p or "")
                found.append(json.dumps(stream(items), separators=(",", ":")))
                whole, own = strings(items, known)
                wholes.append(whole)
                texts.append([{"place": a, "string": b} for a, b in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(found, pa.string()), pa.array(wholes, pa.int64()),
                 pa.array(texts, kind)], names=["host", "stream", "whole", "texts"])

    return run


def page_streams(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``(host, stream, whole, texts)`` of every page: its stream and what ``strings``
    tells, kept in the shared folder."""
    return materialize(pages.select(_host(url).alias("host"), page).mapInArrow(
        _streams(page), "host string, stream string, whole long, "
                        "texts array<struct<place:long,string:long>>"), "wrapper-pages")


def _align_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns the streams of each host in turn; rows come sorted by host. Only the
    running wrapper is held."""
    host, wrapper = None, []

    def one() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "host": [host], "stream": [json.dumps(wrapper, separators=(",", ":"))]})

    for batch in batches:
        for name, text in zip(batch.column("host").to_pylist(), batch.column("stream").to_pylist()):
            if name != host:
                if host is not None:
                    yield one()
                host, wrapper = name, json.loads(text)
            else:
                wrapper = align(wrapper, json.loads(text))
    if host is not None:
        yield one()


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``(host, stream)``: the wrapper of every host, from all its pages."""
    return _wrappers(page_streams(pages, url, page))


def infer_constants(found: DataFrame) -> DataFrame:
    """``(host, constants)`` from ``page_streams``: the ``position:string`` hashes of a
    host's constants. Pages whose text outside of the side parts is equal count once."""
    counts = materialize(
        found.groupBy("host", "whole").agg(F.first("texts").alias("texts"))
        .select("host", F.explode("texts").alias("t")).groupBy("host", "t.place", "t.string")
        .count().where(F.col("count") >= CONSTANT_PAGES), "wrapper-strings")
    places = counts.where("string IS NULL").select("host", "place", F.col("count").alias("all"))
    return (counts.where("string IS NOT NULL").join(places, ["host", "place"])
            .where(F.col("count") >= CONSTANT_SHARE * F.col("all")).groupBy("host")
            .agg(F.concat_ws(",", F.sort_array(F.collect_list(
                F.concat_ws(":", "place", "string")))).alias("constants")))


def _wrappers(found: DataFrame) -> DataFrame:
    """The wrappers of ``page_streams``. Pages with equal streams count once; a host's
    different streams are aligned in ``SALTS`` groups first and the groups' wrappers
    then, so a busy host is spread."""
    # the most frequent streams first: they make the frame that others are aligned with
    different = materialize(found.groupBy("host", "stream").count(), "wrapper-streams")
    salt = F.pmod(F.xxhash64("stream"), F.lit(SALTS))
    parts = (different.withColumn("salt", salt).repartition("host", "salt")
             .sortWithinPartitions("host", "salt", F.desc("count"), "stream")
             .select(F.concat_ws("\u0001", "host", "salt").alias("host"), "stream")
             .mapInArrow(_align_sorted, "host string, stream string")
             .withColumn("host", F.substring_index("host", "\u0001", 1)))
    return (parts.repartition("host").sortWithinPartitions("host", F.desc(F.length("stream")),
                                                           "stream")
            .mapInArrow(_align_sorted, "host string, stream string"))


def _constants(listed: str | None) -> dict[int, set[int]]:
    out: dict = {}
    for pair in (listed or "").split(",") if listed else ():
        place, string = pair.split(":")
        out.setdefault(int(place), set()).add(int(string))
    return out


def _extract_task(page: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = worker_held("wrappers", dict)
        for batch in batches:
            texts = []
            for p, *w in zip(*[batch.column(c).to_pylist() for c in (page, "stream", "constants")]):
                w = tuple(w)
                if w not in made:
                    if len(made) > 4096:
                        made.clear()
                    made[w] = slots(json.loads(w[0] or "[]")), _constants(w[1])
                texts.append("\n\n".join(main_text(parse(p or ""), *made[w])))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, url: str = "url", page: str = "html",
                      keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` and ``url``, with ``text`` (the page's main text, its blocks
    joined by an empty line; empty if it has none) and ``n_chars``. A null page is
    empty; pages without a host in their address share one wrapper."""
    keep = [*keep, url]
    found = page_streams(pages, url, page)
    wrappers = materialize(_wrappers(found).join(infer_constants(found), "host", "left"), "wrappers")
    size = wrappers.agg(F.sum(F.length("stream") + F.length("host") + F.coalesce(
        F.length("constants"), F.lit(0))).alias("b")).first()["b"] or 0
    side = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    joined = (pages.select(*keep, page, _host(url).alias("host"))
              .join(side, "host", "left").select(*keep, page, "stream", "constants"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                      for f in pages.select(*keep).schema)
    return joined.mapInArrow(_extract_task(page, keep), f"{types}, text string, n_chars long")


def op6_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. An empty table gives no rows."""
    return extract_main_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
