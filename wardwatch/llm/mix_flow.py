"""Mixing overlapping sources to target weights by min-cost flow.

Documents are added up by membership pattern (the set of sources that may
claim them).  A flow network carries each pattern's words to the quotas of
its sources; the words of a pattern may be used again, up to ``max_repeats``
times, at a convex price: every later pass costs more than any earlier one.
As the price depends on the pass alone, cheapest augmenting paths open pass
by pass, so the min-cost flow is a maximum flow (Dinic) that is continued
each time the next pass is opened.  A source that shares no pattern with
another is a network of its own, whose flow is the lesser of its quota and
its passes; such sources are settled as rows of a table, however many there
are.  The others make one network on the driver, a node per pattern and
source; their number doesn't grow with the documents, and more than
``MAX_PATTERNS`` patterns that overlap are refused.

The flow gives each pattern a number of whole passes and a rest.  The rest
is filled with documents in seeded hash order, each one taken if it fits what
is still open and passed over if not.  That is done in steps: of the
documents that fit now, a histogram of 256 hash ranges finds the range where
they no longer do, one of that range's 256 parts finds the part, the documents
of that part alone are ordered to find the hash, and the next step goes on behind it with the documents that
fit what is then open, until none is left (in random order the number of
steps grows with the logarithm of the documents).  One more document, the one
whose size fits what is still missing best, tops it up.  A row is thus
selected by its pattern, hash and size alone, in one pass without a shuffle
(up to ``BROADCAST_ROWS`` patterns); rows equal in all columns count as one
document, and those of them that don't fit together while one alone would are
listed and joined.

Defined results: a null text has size 0; null sources form a source of their
own that comes last; sources without words have target 0; documents without
sources are not taken; rows that are equal in all columns are taken alike;
an empty table gives an empty one; extra columns may have any names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwatch.llm.common import fresh, ranked, row_hash, sized
from wardwatch.session import cut_lineage

MAX_PATTERNS = 50_000
MAX_REPEATS = 3
#: Leading bits of a hash that name the ranges of the histograms which find where a pattern's rest ends, one within the other.
RANGE_BITS = (8, 16)
#: Above all hashes, which have 63 bits.
ALL = 2**63 - 1


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_targets(sources: DataFrame, weights: tuple[float, ...], max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: all sizes shared by weight, weights dealt over the sources in code point order.

    What a source can't take within ``max_repeats`` passes is shared among
    the others.  Each round is one aggregate, whose two sums reach the
    driver; the share of a unit of weight only grows, so it ends.
    """
    places = ranked(sources, [F.col("source").isNull(), F.col("source")], "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    rows = cut_lineage(places.select("source", "source_size", weight.alias("weight"), (max_repeats * F.col("source_size")).cast("double").alias("cap")))
    left, total, settled = None, None, F.lit(False)
    while True:
        first = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(settled, F.col("cap"))).alias("full"), F.sum(F.when(~settled, F.col("weight"))).alias("open")).first()
        before, left, total = (left, total), float(first["all"] or 0) - (first["full"] or 0.0), first["open"]
        if not total or before == (left, total):
            break
        settled = F.lit(left) * F.col("weight") / F.lit(total) > F.col("cap")
    share = F.lit(left) * F.col("weight") / F.lit(total) if total else F.col("cap")
    return rows.select("source", "source_size", F.when(settled, F.col("cap")).otherwise(share).alias("target"))


def route(patterns: Mapping[tuple, int], quotas: Mapping[str | None, int], max_repeats: int = MAX_REPEATS) -> dict[tuple, int]:
    """Words to take of each pattern, by a flow of least repetition cost that fills the quotas as far as possible."""
    names, sources = list(patterns), list(quotas)
    start, goal, first = 0, 1, 2
    node = {s: first + len(names) + i for i, s in enumerate(sources)}
    heads: list[list[int]] = [[] for _ in range(first + len(names) + len(sources))]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, capacity: int) -> int:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((capacity, 0))
        return len(to) - 2

    feeds = [arc(start, first + i, 0) for i in range(len(names))]
    for i, pattern in enumerate(names):
        for s in dict.fromkeys(pattern):
            if s in node:
                arc(first + i, node[s], sum(quotas.values()))
    for s in sources:
        arc(node[s], goal, quotas[s])

    def layers() -> list[int] | None:
        level, todo = [-1] * len(heads), deque([start])
        level[start] = 0
        while todo:
            a = todo.popleft()
            for e in heads[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        return level if level[goal] >= 0 else None

    for _ in range(max_repeats):
        for i, pattern in enumerate(names):
            room[feeds[i]] += patterns[pattern]
        while (level := layers()) is not None:
            at = [0] * len(heads)
            path: list[int] = []
            while True:
                a = to[path[-1]] if path else start
                if a == goal:
                    least = min(room[e] for e in path)
                    for e in path:
                        room[e] -= least
                        room[e ^ 1] += least
                    path = path[: next(i for i, e in enumerate(path) if not room[e])]
                    continue
                while at[a] < len(heads[a]) and not (room[heads[a][at[a]]] and level[to[heads[a][at[a]]]] == level[a] + 1):
                    at[a] += 1
                if at[a] < len(heads[a]):
                    path.append(heads[a][at[a]])
                elif path:
                    at[to[path.pop() ^ 1]] += 1
                else:
                    break
    return {pattern: room[feeds[i] + 1] for i, pattern in enumerate(names)}


def _within(step: Column, u: Column, size: Column) -> Column:
    return (u > step["after"]) & (u < step["cut"]) & (size <= step["cap"])


def _fill(units: DataFrame, rests: DataFrame) -> DataFrame:
    """(pattern, steps) for ``rests`` (pattern, rest): steps (after, cut, cap) that take, in hash order, every unit which fits what is still open."""
    ranged = units.select("*", *[F.shiftright("u", 63 - bits).alias(f"span{bits}") for bits in RANGE_BITS])
    open_ = cut_lineage(rests.where("rest > 0").select("pattern", "rest", F.lit(-1).cast("long").alias("after")))
    steps = open_.select("pattern", "after", F.lit(0).cast("long").alias("cut"), F.col("rest").alias("cap")).limit(0)
    while not open_.isEmpty():
        left = ranged.join(sized(open_), "pattern").where((F.col("u") > F.col("after")) & (F.col("size") <= F.col("rest"))).withColumn("before", F.lit(0).cast("long"))
        ends = None
        for bits in RANGE_BITS:
            upto = F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy(f"span{bits}"))
            ranges = left.groupBy("pattern", "rest", "after", "before", f"span{bits}").agg(F.sum("size").alias("size")).withColumn("upto", upto)
            over = F.when(F.col("upto") > F.col("rest"), F.struct(f"span{bits}", (F.col("upto") - F.col("size")).alias("got")))
            found = cut_lineage(ranges.groupBy("pattern", "rest", "after").agg(F.min(over).alias("end")))
            ends = found if ends is None else ends
            inner = found.where("end IS NOT NULL").select("pattern", F.col(f"end.span{bits}").alias(f"span{bits}"), F.col("end.got").alias("before"))
            left = left.drop("before").join(sized(inner), ["pattern", f"span{bits}"])
        running = F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("u"))
        last = left.withColumn("running", running).where("running > rest")
        cuts = last.groupBy("pattern").agg(F.min(F.struct("u", (F.col("running") - F.col("size")).alias("got"))).alias("cut"))
        # A pattern without a range that runs over takes all that is left.
        done = cut_lineage(ends.join(cuts, "pattern", "left").select("pattern", "after", F.coalesce(F.col("cut.u"), F.lit(ALL)).alias("cut"), F.col("rest").alias("cap"), F.col("cut.got").alias("got")))
        steps = cut_lineage(steps.union(done.select("pattern", "after", "cut", "cap")))
        open_ = cut_lineage(done.where("cap > got").select("pattern", (F.col("cap") - F.col("got")).alias("rest"), F.col("cut").alias("after")))
    return steps.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("after", "cut", "cap"))).alias("steps"))


def _routed(patterns: DataFrame, targets: DataFrame, max_repeats: int) -> DataFrame:
    """``patterns`` (pattern, members, size) with ``taken``, the words that the flow takes of each."""
    spark = patterns.sparkSession
    quotas = targets.select("source", F.round("target").cast("long").alias("quota"))
    claimed = patterns.select("pattern", F.size("members").alias("n"), F.explode_outer("members").alias("source"))
    shared = cut_lineage(claimed.where("n > 1").select("source").distinct())
    lone = patterns.where(F.size("members") == 1).withColumn("source", F.get("members", F.lit(0)))
    if shared.isEmpty():
        network = None
    else:
        # Patterns of the sources that overlap: all with several members, and those of these sources alone.
        same = lone["source"].eqNullSafe(shared["source"])
        network = patterns.where(F.size("members") > 1).unionByName(lone.join(shared, same, "left_semi").drop("source"))
        lone = lone.join(shared, same, "left_anti")
    alone = lone.join(quotas.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    taken = alone.select("pattern", "size", F.least("quota", max_repeats * F.col("size")).alias("taken"))
    if network is not None:
        rows = network.limit(MAX_PATTERNS + 1).collect()
        if len(rows) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} membership patterns that overlap; group their sources first")
        wanted = {r.source: r.quota for r in quotas.join(shared, quotas["source"].eqNullSafe(shared["source"]), "left_semi").collect()}
        flow = route({tuple(r.members): r.size for r in rows}, wanted, max_repeats)
        taken = taken.union(spark.createDataFrame([(r.pattern, r.size, flow[tuple(r.members)]) for r in rows], "pattern string, size long, taken long"))
    return taken


def _plan(base: DataFrame, patterns: DataFrame, targets: DataFrame, max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """(pattern, passes, steps, fit): whole passes, the steps within which one more is due, and a hash that gets one more too; (pattern, u) of equal rows that a step passes over as they only fit one by one."""
    taken = _routed(patterns, targets, max_repeats).where("size > 0")
    parts = cut_lineage(taken.select("pattern", F.expr("taken DIV size").alias("passes"), (F.col("taken") % F.col("size")).alias("rest")))
    units = cut_lineage(base.groupBy("pattern", "u").agg(F.sum("size").alias("size"), F.max("size").alias("own")))
    steps = cut_lineage(_fill(units, parts))
    plan = cut_lineage(parts.join(steps, "pattern", "left"))
    chosen = lambda size: F.exists("steps", lambda x: _within(x, F.col("u"), F.col(size)))
    units = units.join(sized(plan.where("steps IS NOT NULL")), "pattern").withColumn("chosen", chosen("size"))
    gaps = units.groupBy("pattern", "rest").agg(F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0)).alias("got"))
    gaps = cut_lineage(gaps.select("pattern", (F.col("rest") - F.col("got")).alias("gap")))
    beyond = units.where("NOT chosen").join(sized(gaps), "pattern").withColumn("off", F.abs(F.col("size") - F.col("gap"))).where("off < gap")
    fits = beyond.groupBy("pattern").agg(F.min(F.struct("off", "u")).alias("best")).select("pattern", F.col("best.u").alias("fit"))
    plan = cut_lineage(plan.join(fits, "pattern", "left").select("pattern", "passes", "steps", "fit"))
    alike = units.where((F.col("size") > F.col("own")) & ~F.col("chosen") & chosen("own")).select("pattern", "u")
    return plan, cut_lineage(alike)


def repeats(docs: DataFrame, members: Column, size: Column, quotas: Mapping[str | None, int] | None = None, weights: tuple[float, ...] = (1.0,), max_repeats: int = MAX_REPEATS, seed: int = 42):
    """``(rows, plan, targets)``: helper columns for each row, the selection by pattern, and (source, source_size, target).

    ``members`` is an array of source names, null allowed as a name.
    ``quotas`` names the words wanted of each source; without it all words
    are shared by ``weights``, dealt over the sources in code point order.
    """
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))).alias("m")))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), row_hash(docs)), 1)
    rows = docs.select("*", pattern.alias(fresh(docs, "pattern")), size.cast("long").alias(fresh(docs, "size")), u.alias(fresh(docs, "u")))
    base = cut_lineage(rows.select(*(F.col(fresh(docs, x)).alias(x) for x in ("pattern", "size", "u"))))
    patterns = base.groupBy("pattern").agg(F.sum("size").alias("size"))
    patterns = cut_lineage(patterns.select("pattern", F.coalesce(F.from_json("pattern", "m array<string>")["m"], F.array()).alias("members"), "size"))
    sources = patterns.select(F.explode("members").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    if quotas is None:
        targets = share_targets(sources, weights, max_repeats)
    else:
        wanted = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in quotas.items()], "of string, wanted double")
        targets = sources.join(wanted, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", F.coalesce("wanted", F.lit(0.0)).alias("target"))
    targets = cut_lineage(targets)
    return rows, _plan(base, patterns, targets, max_repeats), targets


def _selected(docs: DataFrame, rows: DataFrame, plan: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, str]:
    """Rows with the number of times each is taken."""
    pattern, size, u = (F.col(fresh(docs, x)) for x in ("pattern", "size", "u"))
    names = {c: fresh(rows, f"plan_{c}") for c in plan[0].columns}
    small = plan[0].select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = rows.join(sized(small), pattern == F.col(names["pattern"]), "left")
    taken = F.exists(names["steps"], lambda x: _within(x, u, size))
    if not plan[1].isEmpty():
        over = {c: fresh(joined, f"over_{c}") for c in plan[1].columns}
        alike = plan[1].select(*[F.col(c).alias(n) for c, n in over.items()])
        joined = joined.join(sized(alike), (pattern == F.col(over["pattern"])) & (u == F.col(over["u"])), "left")
        taken &= F.col(over["u"]).isNull()
    extra = (F.coalesce(taken, F.lit(False)) | F.coalesce(u == F.col(names["fit"]), F.lit(False))).cast("long")
    times = fresh(joined, "times")
    return joined.withColumn(times, F.coalesce(F.col(names["passes"]), F.lit(0)) + extra), times


def mix_words(docs: DataFrame, weights: tuple[float, ...], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken; each document belongs to its own source alone."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    narrow = cut_lineage(narrow.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("mark")))
    rows, plan, targets = repeats(narrow, F.array("source"), F.col("words"), weights=weights, max_repeats=max_repeats, seed=seed)
    selected, times = _selected(narrow, rows, plan)
    return selected.join(sized(targets.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", F.col("words").alias("size"), "source_size", "target", (F.col("words") * F.col(times)).alias("taken")
    )


def mix(docs: DataFrame, members: Column, size: Column, quotas: Mapping[str | None, int] | None = None, weights: tuple[float, ...] = (1.0,), max_repeats: int = MAX_REPEATS, seed: int = 42) -> DataFrame:
    """The mixture itself: each selected row of ``docs`` as often as it is taken."""
    rows, plan, _ = repeats(docs, members, size, quotas, weights, max_repeats, seed)
    selected, times = _selected(docs, rows, plan)
    copies = F.explode(F.when(F.col(times) > 0, F.sequence(F.lit(1).cast("long"), F.col(times))).otherwise(F.array().cast("array<long>")))
    return selected.select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias(fresh(selected, "copy"))).select(*[F.col(f"`{c}`") for c in docs.columns])
