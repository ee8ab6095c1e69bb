"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).
The flow network is small: a pattern offers its tokens once for each repetition,
each repetition dearer than the one before (a convex cost), and may route them to
the quota of any of its sources. The cheapest flow that fills the quotas says how
many tokens each pattern gives; documents are then taken in the order of a seeded
hash up to that number.
"""

from __future__ import annotations

import heapq
from itertools import cycle, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspace.llm.common import WORD, materialize, read_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
SEED = 23
#: Rows of the pattern table that the driver solves; more is an error, not a cut.
MAX_PATTERNS = 200_000
#: Cells of the hash range, 2 ** CELL_BITS.
CELL_BITS = 16
#: Walks through a pattern's rows before the last one is chosen by its size.
ROUNDS = 3
OUT = ("copies", "source_size", "target")
#: Flips the sign bit: the signed order of the result is the unsigned order.
SIGN = -(1 << 63)


def capped_targets(sizes: list[int], weights: list[float], total: float,
                   cap: float = MAX_REPEATS) -> list[float]:
    """Share ``total`` by weight; a target stops at ``cap`` times its size and the
    excess is shared again by weight among the rest."""
    targets = [0.0] * len(sizes)
    open_, left = [i for i, w in enumerate(weights) if w > 0], float(total)
    while open_ and left > 0:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def min_cost_flow(supply: list[int], members: list[list[int]], quotas: list[int],
                  repeats: int) -> list[list[int]]:
    """Tokens that each pattern gives in each repetition, for the cheapest flow
    among the fullest. Successive shortest paths: a path leaves by the cheapest
    repetition that a pattern has left, may move flow of another pattern from one
    quota to the next, and ends at an open quota. As moving costs nothing, a path
    costs what the repetition at its start costs."""
    given = [[0] * repeats for _ in supply]
    routed: list[dict[int, int]] = [{} for _ in supply]      # pattern -> quota -> tokens
    feeding: list[set[int]] = [set() for _ in quotas]        # quota -> patterns with flow
    left = list(quotas)

    def path(p: int) -> list[tuple[int, int]] | None:
        """(pattern, quota) steps from ``p`` to a quota with room."""
        came: dict[int, tuple[int, int | None]] = {}
        front = [(p, None)]
        while front:
            after = []
            for pattern, via in front:
                for q in members[pattern]:
                    if q in came:
                        continue
                    came[q] = (pattern, via)
                    if left[q] > 0:
                        steps, at = [], q
                        while at is not None:
                            pattern_, via_ = came[at]
                            steps.append((pattern_, at))
                            at = via_
                        return steps[::-1]
                    after += [(other, q) for other in sorted(feeding[q]) if other != pattern]
            front = after
        return None

    queue = [(r, p) for r in range(repeats) for p in range(len(supply))]
    heapq.heapify(queue)
    stuck: set[int] = set()
    while queue:
        r, p = heapq.heappop(queue)
        while given[p][r] < supply[p] and p not in stuck:
            steps = path(p)
            if steps is None:
                stuck.add(p)
                break
            flow = min(supply[p] - given[p][r], left[steps[-1][1]])
            for (_, q), (other, _) in zip(steps, steps[1:]):
                flow = min(flow, routed[other][q])
            for k, (pattern, q) in enumerate(steps):
                if k:
                    before = steps[k - 1][1]
                    routed[pattern][before] -= flow
                    if not routed[pattern][before]:
                        feeding[before].discard(pattern)
                routed[pattern][q] = routed[pattern].get(q, 0) + flow
                feeding[q].add(pattern)
            left[steps[-1][1]] -= flow
            given[p][r] += flow
    return given


def mix(df: DataFrame, sources: str = "sources", size: str = "size", key: list[str] | None = None,
        weights: dict | None = None, share: float = SHARE, repeats: int = MAX_REPEATS,
        seed: int = SEED, out: tuple[str, str, str] = OUT) -> DataFrame:
    """``df`` with three columns named by ``out`` (columns of these names are
    replaced): how often the mix takes the row (0 to ``repeats``), and the tokens and
    the target of its sources.

    ``sources`` is an array column (the row's sources; a null element is a source
    of its own), ``size`` its tokens, ``key`` the columns whose seeded hash orders
    the rows of a pattern (by default all others). ``weights`` maps a source to its
    weight; by default sources in code point order, null last, weigh 5, 2, 1,
    repeating. Rows with equal keys are taken or left together.

    The order of a pattern is cut in two steps, so that one large pattern never
    meets in a task: tokens are summed by cell of the hash range, and only the
    cell in which the quota ends is resolved row by row.
    """
    df = df.drop(*out)
    rest = [c for c in df.columns if c not in (sources, size)]
    pattern = F.array_sort(F.array_distinct(F.transform(
        F.coalesce(sources, F.array()),
        lambda s: F.struct(s.isNull().alias("n"), F.coalesce(s, F.lit("")).alias("s")))))
    own = {"__pattern": pattern, "__h": F.xxhash64(F.lit(seed), *(key or rest))}
    rows = materialize(df.withColumns(own).select("__pattern", "__h", F.col(size).alias("__n")),
                       "mix-rows")
    found = (rows.groupBy("__pattern").agg(F.sum("__n").alias("n"))
             .limit(MAX_PATTERNS + 1).collect())
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    plan = F.broadcast(df.sparkSession.createDataFrame(
        _plan([r["__pattern"] for r in found], [r["n"] or 0 for r in found], weights, share,
              repeats),
        rows.select("__pattern").schema.add("__base", "integer").add("__extra", "long")
        .add(f"__{out[1]}", "long").add(f"__{out[2]}", "double")))
    cuts = _cuts(rows.join(plan, "__pattern").where("__extra > 0 AND __n > 0"))
    placed = df.withColumns(own).join(plan, "__pattern").join(_small(cuts), "__pattern", "left")
    place = F.col("__h").bitwiseXOR(F.lit(SIGN))
    within = F.exists("__runs", lambda r: (
        (place >= r["start"]) & (F.coalesce(r["stop"], F.lit(-SIGN - 1)) > place)
        & (F.col(size) <= r["fits"])))
    more = (F.col("__extra") > 0) & (F.coalesce(within, F.lit(False)) | F.coalesce(
        F.col("__h") == F.col("__also"), F.lit(False)))
    return placed.select(*df.columns, (F.col("__base") + more.cast("int")).alias(out[0]),
                         F.col(f"__{out[1]}").alias(out[1]), F.col(f"__{out[2]}").alias(out[2]))


def _plan(patterns: list, supply: list[int], weights: dict | None, share: float,
          repeats: int) -> list[tuple]:
    """(pattern, whole repetitions, tokens of the next one, tokens and target of its
    sources) for each pattern."""
    order = sorted(range(len(patterns)), key=lambda i: [(x.n, x.s) for x in patterns[i]])
    patterns, supply = [patterns[i] for i in order], [supply[i] for i in order]
    names = sorted({(x.n, x.s) for own in patterns for x in own})
    index = {name: i for i, name in enumerate(names)}
    members = [[index[(x.n, x.s)] for x in own] for own in patterns]
    w = (list(islice(cycle(WEIGHTS), len(names))) if weights is None
         else [weights.get(None if n else s, 0) for n, s in names])
    sizes = [0] * len(names)
    for n, own in zip(supply, members):
        for q in own:
            sizes[q] += n
    targets = capped_targets(sizes, w, share * sum(supply), repeats)
    given = min_cost_flow(supply, members, [round(t) for t in targets], repeats)
    plan = []
    for own, n, g, m in zip(patterns, supply, given, members):
        whole = next((k for k in range(repeats) if g[k] < n), repeats) if n else 0
        plan.append((own, whole, g[whole] if n and whole < repeats else 0,
                     sum(sizes[q] for q in m), float(sum(targets[q] for q in m))))
    return plan


def _fill(keyed: DataFrame, state: DataFrame) -> DataFrame:
    """One round for each pattern in ``state(__pattern, gap, start, fits)``: walks the rows
    from ``start`` in hash order that are no larger than ``fits`` and stops before the
    first that would pass ``gap``. Gives ``stop`` (null if none does) and the gap left."""
    cell = F.shiftrightunsigned("__h", 64 - CELL_BITS)
    running = "sum(n) OVER (PARTITION BY __pattern ORDER BY {} ROWS UNBOUNDED PRECEDING)"
    rows = (keyed.join(_small(state), "__pattern")
            .withColumn("o", F.col("__h").bitwiseXOR(F.lit(SIGN)))
            .where((F.col("o") >= F.col("start")) & (F.col("__n") <= F.col("fits"))))
    cells = (rows.groupBy("__pattern", "gap", cell.alias("cell")).agg(F.sum("__n").alias("n"))
             .withColumn("upto", F.expr(running.format("cell"))))
    ends = (cells.groupBy("__pattern", "gap").agg(
        F.min(F.when(F.col("upto") > F.col("gap"), F.struct("cell", "upto", "n"))).alias("m"),
        F.max("upto").alias("all"))
        .select("__pattern", "gap", "all", F.col("m.cell").alias("cut"),
                (F.col("m.upto") - F.col("m.n")).alias("before")))
    ends = materialize(ends, "mix-cells")
    stops = (rows.drop("gap").join(_small(ends.where("cut IS NOT NULL")), "__pattern")
             .where(cell == F.col("cut"))
             .groupBy("__pattern", "gap", "before", "o").agg(F.sum("__n").alias("n"))
             .withColumn("upto", F.expr(f"before + {running.format('o')}"))
             .where("upto > gap").groupBy("__pattern", "gap")
             .agg(F.min(F.struct("o", "upto", "n")).alias("m"))
             .select("__pattern", F.col("m.o").alias("stop"),
                     (F.col("gap") - F.col("m.upto") + F.col("m.n")).alias("left")))
    return state.join(ends.select("__pattern", "all"), "__pattern", "left").join(
        stops, "__pattern", "left").select(
        "__pattern", "gap", "start", "fits", "stop",
        F.coalesce("left", F.col("gap") - F.coalesce("all", F.lit(0))).alias("left"))


def _cuts(keyed: DataFrame) -> DataFrame:
    """``(__pattern, __runs, __also)``: what the pattern gives beyond its whole repetitions.
    Rows in hash order are taken up to the first that passes the tokens; it is skipped,
    and the walk goes on with rows that fit into what is left, for ``ROUNDS`` rounds. A
    run is (start, stop, size that fits). The rest, smaller than the row at the last
    stop, goes to the row behind it whose size is nearest, if that brings the pattern
    nearer to its tokens."""
    state = keyed.groupBy("__pattern").agg(F.first("__extra").alias("gap")).select(
        "__pattern", "gap", F.lit(SIGN).alias("start"), F.lit(-SIGN - 1).alias("fits"))
    runs = None
    for _ in range(ROUNDS):
        state = materialize(_fill(keyed, state), "mix-round")
        one = state.select("__pattern", F.struct("start", "stop", "fits").alias("run"))
        runs = one if runs is None else runs.unionByName(one)
        last = state
        state = state.where("stop IS NOT NULL AND left > 0").select(
            "__pattern", F.col("left").alias("gap"), F.col("stop").alias("start"),
            F.col("left").alias("fits"))
    off = F.abs(F.col("__n") - F.col("left"))
    tops = (keyed.join(_small(last.where("stop IS NOT NULL AND left > 0")), "__pattern")
            .where((F.col("__h").bitwiseXOR(F.lit(SIGN)) >= F.col("stop")) & (off < F.col("left")))
            .groupBy("__pattern").agg(F.min(F.struct(off.alias("off"), F.col("__h").alias("h")))
                                      .alias("m"))
            .select("__pattern", F.col("m.h").alias("__also")))
    all_runs = runs.groupBy("__pattern").agg(F.collect_list("run").alias("__runs"))
    return materialize(all_runs.join(tops, "__pattern", "left"), "mix-cuts")


def _small(per_pattern: DataFrame) -> DataFrame:
    """Broadcast a table of one row for each pattern: at most MAX_PATTERNS rows."""
    return F.broadcast(per_pattern)


def word_count(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, each in the one source it names. A null source is
    a source of its own, last; a text that is null or wordless has size 0 and adds
    nothing; an empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    sized = docs.select("doc_id", word_count("text").alias("size"),
                        F.array("source").alias("sources"), F.xxhash64("text").alias("t"))
    mixed = mix(materialize(sized, "mix-sizes"), key=["doc_id", "t"])
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row that it takes twice comes twice."""
    given = docs.withColumns({"__sources": F.array("source"), "__words": word_count("text")})
    mixed = mix(given, "__sources", "__words", key=["doc_id", "text"],
                out=("__copies", "__source_size", "__target"))
    taken = F.explode(F.array_repeat(F.lit(1), F.col("__copies")))
    return mixed.select(*docs.columns, taken.alias("__taken")).drop("__taken")
