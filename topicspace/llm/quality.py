"""Quality rules as weak supervision.

Each rule looks at one statistic of a text and votes good, bad or abstains. The votes
of all documents are counted by pattern; expectation-maximisation on those counts
estimates how often each rule votes good, bad or not at all on a good and on a bad
document; the posterior probability of a good document, not a conjunction of rules,
decides.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspace.llm.common import WORD, let, materialize, read_table

MIN_WORDS = 50
#: base_failed: 100 * n_repeat_words > MAX_REPEAT * n_words.
MAX_REPEAT = 50
WINDOW = 3
KEEP = 0.5
ROUNDS = 200
#: Bits of a window's place in the packed sort key; a longer text takes the slower key.
PLACE_BITS = 24

GOOD, BAD, ABSTAIN = 1, -1, 0

#: Rules: name, statistic, bounds. Up to the first bound the vote is the first one, from
#: the second bound on the last one, between them the rule abstains.
RULES = [
    ("word_length_low", "word_chars / n_words", 2.5, 3.5, BAD, GOOD),
    ("word_length_high", "word_chars / n_words", 7.0, 10.0, GOOD, BAD),
    ("symbols", "n_symbols / n_words", 0.05, 0.2, GOOD, BAD),
    ("repeated_lines", "n_dup_lines / n_lines", 0.1, 0.3, GOOD, BAD),
    ("repeated_words", "n_repeat_words / n_words", 0.15, 0.35, GOOD, BAD),
    ("letters", "n_letters / word_chars", 0.75, 0.92, BAD, GOOD),
    ("words_with_letters", "n_lettered / n_words", 0.7, 0.85, BAD, GOOD),
    ("capitals", "n_capitals / n_letters", 0.2, 0.5, GOOD, BAD),
    ("ended_lines", "n_ended_lines / n_lines", 0.3, 0.6, BAD, GOOD),
]


def words(text: str | Column) -> Column:
    """The words of a text; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)),
                      F.array().cast("array<string>"))


def _covered(places: Column) -> Column:
    """Words in the windows that begin at the ascending ``places``."""
    return F.coalesce(F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("int").alias("n"),
            p.cast("int").alias("last")),
        lambda acc: acc["n"]), F.lit(0))


def _repeated(pairs: Column, same) -> Column:
    """Elements of a sorted array that equal a neighbour."""
    return F.filter(pairs, lambda x, i: F.coalesce(same(x, F.get(pairs, i - 1)), F.lit(False))
                    | F.coalesce(same(x, F.get(pairs, i + 1)), F.lit(False)))


def repeat_words(w: Column) -> Column:
    """Words that lie in a window of three found at least twice, first one included.

    The windows' hashes are sorted together with their places. To sort plain longs, a
    hash's upper bits and the place share one long; a document in which two different
    windows share those bits (or with too many words) takes the pair of whole hash
    and place instead, so the count is the same either way.
    """
    low = F.lit((1 << PLACE_BITS) - 1)

    def counted(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-(1 << PLACE_BITS)))
                                          .bitwiseOR(i.cast("long"))))
        near = let(packed, lambda s: _repeated(
            s, lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)))

        def from_near(n: Column) -> Column:
            # neighbours in the sorted order that share the upper bits but not the hash
            mixed = F.exists(F.sequence(F.lit(0), F.size(n) - 2), lambda i: (
                F.shiftright(n[i], PLACE_BITS) == F.shiftright(n[i + 1], PLACE_BITS))
                & (h[n[i].bitwiseAND(low).cast("int")]
                   != h[n[i + 1].bitwiseAND(low).cast("int")]))
            places = F.sort_array(F.transform(n, lambda x: x.bitwiseAND(low).cast("int")))
            return (F.when(F.size(n) == 0, 0).when(F.size(n) == 1, 0)
                    .when(mixed, whole(h)).otherwise(_covered(places)))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).when(
            F.size(h) > (1 << PLACE_BITS), whole(h)).otherwise(let(near, from_near))

    def whole(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: _covered(F.sort_array(F.transform(
            _repeated(s, lambda a, b: a["h"] == b["h"]), lambda x: x["i"]))))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                          lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))
    return F.when(F.size(w) < WINDOW + 1, 0).otherwise(let(windows, counted)).cast("long")


def statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the statistics of ``text``, each named ``prefix`` + its name."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    ended = F.lit(r"[.!?:;…\"')\]][\x20\x09-\x0D]*$")
    whole = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.coalesce(F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
                   F.lit(0).cast("long")).alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: F.regexp_like(y, ended))).cast("long")
        .alias("n_ended_lines")))
    part = ["__words", "__lines"]
    df = df.withColumns({
        part[0]: whole, part[1]: by_line,
        f"{prefix}n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        f"{prefix}n_letters": F.regexp_count(t, F.lit(r"\p{L}")).cast("long"),
        f"{prefix}n_lettered": F.regexp_count(
            # from the start of a word on, so that a long run without letters is read once
            t, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]*+\p{L}")).cast("long"),
        f"{prefix}n_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long")})
    return df.withColumns({
        **{f"{prefix}{c}": F.col(part[0])[c] for c in ("n_words", "word_chars", "n_repeat_words")},
        **{f"{prefix}{c}": F.col(part[1])[c] for c in ("n_lines", "n_dup_lines", "n_ended_lines")},
    }).drop(*part)


def votes(prefix: str = "") -> Column:
    """Array of the rules' votes; a statistic that is null abstains."""
    def vote(rule):
        _, stat, low, high, first, last = rule
        above, below = (f"`{prefix}{x.strip()}`" for x in stat.split("/"))
        value = F.expr(f"{above} / nullif({below}, 0)")
        return (F.when(value <= low, first).when(value >= high, last)
                .otherwise(ABSTAIN).cast("tinyint"))

    return F.array(*[vote(r) for r in RULES])


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rules: int,
                    rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior probability of a good document for each vote pattern.

    Two classes; given the class the rules are independent, each with its own chances
    of voting good, bad or nothing. Starts from rules that are right in four of five
    votes and good documents as frequent as good votes; one count is added to each
    cell so that no chance is zero.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return {}
    cast = sum(n for p, n in patterns for v in p if v) or 1
    good = min(0.95, max(0.05, sum(n for p, n in patterns for v in p if v == GOOD) / cast))
    chance = [[{GOOD: 0.4, BAD: 0.1, ABSTAIN: 0.5} for _ in range(rules)],
              [{GOOD: 0.1, BAD: 0.4, ABSTAIN: 0.5} for _ in range(rules)]]

    def posterior(p: tuple[int, ...]) -> float:
        # a rule's abstention is no evidence
        odds = log(good) - log(1 - good) + sum(
            log(chance[0][j][v] / (chance[0][j][GOOD] + chance[0][j][BAD]))
            - log(chance[1][j][v] / (chance[1][j][GOOD] + chance[1][j][BAD]))
            for j, v in enumerate(p) if v)
        return 1 / (1 + exp(-max(-700.0, min(700.0, odds))))

    for _ in range(rounds):
        weight = [(p, n, posterior(p)) for p, n in patterns]
        before = good
        good = (sum(n * q for _, n, q in weight) + 1) / (total + 2)
        chance = [[{v: (sum(n * (q if k == 0 else 1 - q) for p, n, q in weight if p[j] == v) + 1)
                    for v in (GOOD, BAD, ABSTAIN)} for j in range(rules)] for k in range(2)]
        if abs(good - before) < 1e-9:
            break
    return {p: posterior(p) for p, _ in patterns}


def judge(df: DataFrame, text: str = "text", prefix: str = "",
          carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``df`` (by default all) with its statistics, ``base_failed``, ``quality`` (the posterior) and
    ``kept``, all named with ``prefix``.

    The vote patterns of the documents that pass the base rules are counted over the
    whole table; there are at most 3 to the number of rules of them, and only they
    reach the driver. A document that fails a base rule is not kept, whatever its
    posterior. A null or empty text has no words and fails; repeated rows are judged each
    and alike; an empty table gives no rows. A column of ``df`` with the name of one that is
    added gives way to it: choose ``prefix`` so that none does.
    """
    p = prefix
    scored = statistics(df, text, p)
    if carry is not None:
        scored = scored.drop(*[c for c in df.columns if c not in carry])
    scored = materialize(scored.withColumns({
        f"{p}base_failed": (F.col(f"{p}n_words") < MIN_WORDS)
        | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT * F.col(f"{p}n_words")),
        "__votes": votes(p)}), "quality-votes")
    counts = (scored.where(~F.col(f"{p}base_failed")).groupBy("__votes").count().collect())
    model = fit_label_model(sorted((tuple(r["__votes"]), r["count"]) for r in counts),
                            len(RULES))
    if not model:
        posterior = F.lit(0.0)
    else:
        key = F.concat_ws(",", F.col("__votes").cast("array<string>"))
        table = F.broadcast(df.sparkSession.createDataFrame(  # at most 3 ** rules rows
            [(",".join(map(str, v)), q) for v, q in model.items()], "__key string, __q double"))
        scored = scored.withColumn("__key", key).join(table, "__key", "left").drop("__key")
        posterior = F.coalesce("__q", F.lit(0.0))
    return scored.withColumns({
        f"{p}quality": posterior,
        f"{p}kept": ~F.col(f"{p}base_failed") & (posterior >= KEEP)}).drop("__votes", "__q")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows that :func:`judge` keeps, with the columns of ``docs``."""
    return judge(docs, prefix="__quality_").where("__quality_kept").select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document.

    A null, empty or wordless text has no words and fails the base rules; equal texts get
    equal rows, however often they stand; very long texts are whole; an empty table gives no
    rows. Other columns of the table are not read."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality")
