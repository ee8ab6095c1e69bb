"""Source divergence audit: how the words of each source of a language differ.

Each language keeps the terms that enough of its documents hold. A group's (a source of
a language, or the whole language) smoothed share of a term follows from its count of the
term alone, so everything is worked out for cells of equal counts, not for terms:

* terms of a group are grouped by (count in the group, count in the language), the
  difference of the shares is evaluated once for each cell, cells of equal value are
  merged, and values are ranked by their cumulative number of terms; only the values that
  reach the asked ranks are expanded to terms, in UTF-8 order;
* the distance of two sources is a sum over (count here, count there) cells; a term that
  neither holds, or only one, needs no meeting of the two, so only terms that both hold
  are joined.

Counts are summed within each task before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicspace.llm.common import materialize, read_table

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTH = 5
SCALE = 1_000_000_000
#: Counted (group, term) entries that a task holds before it gives them on.
HELD_ENTRIES = 1 << 18

# In UTF-8 every byte of a character beyond ASCII is at least 0x80, so terms are runs of
# letter bytes and such bytes.
TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalpha() else 32
                   for b in range(256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang",
                source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term in each group and
    the documents that hold it; an empty term stands for the group itself, with no
    occurrences. Null text, lang and source count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}

        def give():
            for key, found in counts.items():
                own, n = held[key], len(found) + 1
                yield pa.RecordBatch.from_pydict({
                    "lang": [key[0]] * n, "source": [key[1]] * n,
                    "term": pa.array([b"", *found], pa.binary()).cast(pa.string()),
                    "n": pa.array([0, *found.values()], pa.int64()),
                    "docs": pa.array([0, *(own[t] for t in found)], pa.int64())})
            counts.clear()
            held.clear()

        entries = 0
        for batch in batches:
            for value, a, b in zip(*(batch.column(c).to_pylist() for c in (text, lang, source))):
                key = (a or "", b or "")
                if key not in counts:
                    counts[key], held[key] = Counter(), Counter()
                words = Counter((value or "").encode("utf-8").translate(TERM_BYTES).split())
                before = len(counts[key])
                counts[key].update(words)
                held[key].update(words.keys())
                entries += len(counts[key]) - before
                if entries > HELD_ENTRIES:
                    yield from give()
                    entries = 0
        yield from give()

    parts = docs.select(text, lang, source).mapInArrow(
        run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"),
                                                       F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)) of three bigint columns,
    in exact decimals; 1 where nothing is kept."""
    return F.expr(f"CASE WHEN `{kept}` > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10,0)) * "
                  f"(`{count}` + {SMOOTH})) div (`{total}` + {SMOOTH} * `{kept}`) ELSE 1L END")


def kept_counts(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, source, term, n, all_n)``: the counts of the terms that at least
    ``min_docs`` documents of their language hold, with the count in the language."""
    terms = counts.where("term <> ''")
    kept = (terms.groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("all_n"))
            .where(F.col("d") >= min_docs).select("lang", "term", "all_n"))
    return terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n")


def group_totals(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, total, all_total, v, zero)``: of every group the occurrences of kept
    terms in it and in its language, the number of kept terms and its share of a term that
    it lacks. One short row for each group."""
    langs = (kept.select("lang", "term", "all_n").distinct().groupBy("lang")
             .agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_total")))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("bigint")
    return (counts.where("term = ''").select("lang", "source", none.alias("no"))
            .join(own, ["lang", "source"], "left").join(langs, "lang", "left")
            .select("lang", "source", "no", *[F.coalesce(c, none).alias(c)
                                              for c in ("total", "all_total", "v")])
            .withColumn("zero", share("no", "total", "v")).drop("no"))


def exceeding_terms(kept: DataFrame, totals: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, item, value, rank)``: terms of a group whose share in it exceeds
    the language's, to rank ``top``, by count cells: no term is ranked whose cell can't
    reach the asked ranks."""
    group = ["lang", "source"]
    cells = (kept.groupBy(*group, "n", "all_n").agg(F.count(F.lit(1)).alias("many"))
             .join(totals, group)
             .withColumn("value", share("n", "total", "v") - share("all_n", "all_total", "v"))
             .where("value > 0").select(*group, "n", "all_n", "many", "value"))
    values = cells.groupBy(*group, "value").agg(F.sum("many").alias("many"))
    falling = Window.partitionBy(*group).orderBy(F.col("value").desc())
    # each value has a term at least, so only the first ``top`` values can count
    first = values.withColumn("place", F.row_number().over(falling)).where(F.col("place") <= top)
    before = F.sum("many").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    reached = (first.withColumn("before", F.coalesce(before, F.lit(0)))
               .where(F.col("before") < top).select(*group, "value"))
    open_cells = cells.join(reached, [*group, "value"]).select(*group, "n", "all_n", "value")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("value").desc(), "term"))
    return (kept.join(open_cells, [*group, "n", "all_n"]).withColumn("rank", rank)
            .where(F.col("rank") <= top).select(*group, F.col("term").alias("item"), "value", "rank"))


def source_distances(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, source, item, value, rank)``: the summed absolute differences of the shares
    of all kept terms between a group and each other source of its language.

    Where ``z`` is the share of a term that a group lacks, the sum over all terms is
    ``v * |za - zb|``, plus ``|p - zb| - |za - zb|`` for the terms of a, the like for those of
    b, plus a correction for the terms of both. The first two need only how often each
    count stands in a group."""
    p = kept.join(totals.select("lang", "source", "total", "v", "zero"), ["lang", "source"]) \
        .select("lang", "source", "term", "n", share("n", "total", "v").alias("p"), "zero")
    own = p.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("many"))
    other = totals.select("lang", F.col("source").alias("item"), F.col("zero").alias("z"))
    gap = F.abs(F.col("zero") - F.col("z"))
    single = (own.join(other, "lang").where("source <> item")
              .groupBy("lang", "source", "item")
              .agg(F.sum(F.col("many") * (F.abs(F.col("p") - F.col("z")) - gap)).alias("s")))
    left = p.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"),
                    F.col("zero").alias("za"))
    right = p.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"),
                     F.col("zero").alias("zb"))
    extra = (F.abs(F.expr("pa - pb")) - F.abs(F.expr("pa - zb")) - F.abs(F.expr("pb - za"))
             + F.abs(F.expr("za - zb")))
    both = (left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b")
            .agg(F.sum(extra).alias("s")))
    # each undirected sum goes to both directions
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    turned = single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "s")
    base = (totals.join(other, "lang").where("source <> item")
            .select("lang", "source", "item", (F.col("v") * gap).alias("s")))
    meet = both.select("lang", ways.alias("w"), "s").select("lang", "w.source", "w.item", "s")
    summed = (base.unionByName(single).unionByName(turned).unionByName(meet)
              .groupBy("lang", "source", "item").agg(F.sum("s").alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(
        F.col("value").desc(), "item"))
    return summed.withColumn("rank", rank)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: of every (lang, source) group its
    distances to the language's other sources (part ``pair``, all ranks) and the terms whose
    share most exceeds the language's (part ``term``, ranks to ``top``). Ties rank by item
    in UTF-8 order."""
    counts = materialize(term_counts(docs, text, lang, source), "divergence-counts")
    kept = materialize(kept_counts(counts, min_docs), "divergence-kept")
    totals = materialize(group_totals(counts, kept), "divergence-totals")
    columns = ("lang", "source", "part", "item", "value", "rank")
    return (source_distances(kept, totals).withColumn("part", F.lit("pair")).select(*columns)
            .unionByName(exceeding_terms(kept, totals, top).withColumn("part", F.lit("term"))
                         .select(*columns)))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every (lang, source) group of documents.

    Null text, lang and source count as empty strings; a document without terms still makes
    its group; repeated rows count each time; a language without kept terms has pairs of
    value 0 and no terms; an only source has no pairs; an empty table gives no rows. Other
    columns of the table are not read."""
    return audit(read_table(spark, sf_dir, "documents", "text", "lang", "source"))


#: DuckDB SQL of ``op13_source_divergence``.
OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS l FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, unnest(l) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term)
      GROUP BY lang, source, term),
v AS (SELECT g.lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM g) g
      LEFT JOIN kept ON kept.lang = g.lang GROUP BY g.lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g
       LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
ln AS (SELECT lang, sum(total)::HUGEINT AS total FROM gn GROUP BY lang),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn.total + 5 * v.v) AS p
      FROM gn JOIN v ON v.lang = gn.lang JOIN kept k ON k.lang = gn.lang
      LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT lc.lang, lc.term, 1 + (1000000000::HUGEINT * (lc.n + 5)) // (ln.total + 5 * v.v) AS q
      FROM lc JOIN ln ON ln.lang = lc.lang JOIN v ON v.lang = lc.lang),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
        coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term
                  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
      FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value
      FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part
        ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
