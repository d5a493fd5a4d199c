"""Quality rules: base limits and a learned decision list.

Statistics of whole texts are built-in expressions.  A decision list is
learned from the statistics of a bounded sample of labelled rows
(``SAMPLE_PER_LABEL`` of each label) by sequential covering: a conjunction of
threshold tests is grown on two thirds of the sample by the gain in
information until it covers no good text, pruned on the other third as long
as that raises its worth there, and its rows are taken out before the next
one is grown.  The list is emitted as one ordered ``when ... otherwise``
expression over the statistics columns.

Defined results: a null or empty text has no words, so it fails the base
limits; without labelled rows of both kinds the list is empty and the base
limits decide; null and repeated ids are kept as they are; an empty table
gives an empty one; extra columns are ignored.  Built-in DataFrame functions
only; the driver sees no more than the sample's statistics.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.common import ASCII_SPACE, labelled_sample

#: Labelled rows of each label that the list is learned from.
SAMPLE_PER_LABEL = 10_000
THRESHOLDS = 48
MAX_RULES, MAX_TESTS = 24, 4
#: A rule must be this precise on the rows held back for pruning.
MIN_PRECISION = 0.97
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "digit_share", "words_per_line")


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, so that later uses read them instead of computing them anew."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def statistics(docs: DataFrame, carry: list, text_col: str = "text") -> DataFrame:
    """``carry`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of the rules."""
    text = F.col("text_")
    first = docs.select(*carry, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text_"))
    spaced = F.translate(text, ASCII_SPACE[1:], " " * 5)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(ASCII_SPACE)) != "")
    split = _step(
        first,
        words_=F.array_remove(F.split(spaced, " "), ""),
        lines_=lines,
        word_chars=F.length(F.translate(text, ASCII_SPACE, "")).cast("long"),
        n_symbols=(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        n_digits_=(F.length(text) - F.length(F.translate(text, "0123456789", ""))).cast("long"),
    )
    words = F.col("words_")
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    counted = _step(
        split,
        n_words=F.size(words).cast("long"),
        n_distinct_=F.size(F.array_distinct(words)),
        n_lines_=F.size("lines_"),
        n_dup_lines=(F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
        windows_=F.when(F.size(words) >= 3, hashed).otherwise(F.array().cast("array<bigint>")),
    ).drop("words_", "lines_", "text_")
    windows, found = F.col("windows_"), F.col("sorted_")
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = _step(counted, sorted_=F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed).otherwise(empty)).drop("windows_")
    twice = F.filter(found, lambda x, j: (F.get(found, j - 1)["h"] == x["h"]) | (F.get(found, j + 1)["h"] == x["h"]))
    spots = _step(placed, spots_=F.transform(twice, lambda x: x["i"])).drop("sorted_")
    covered = F.array_distinct(F.flatten(F.transform("spots_", lambda i: F.array(i, i + 1, i + 2))))
    done = _step(spots, n_repeat_words=F.size(covered).cast("long")).drop("spots_")
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_words")), F.lit(0.0))
    return done.select(
        *[c for c in first.columns[:-1]],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        per_word("word_chars").alias("mean_word"),
        per_word("n_symbols").alias("symbols_per_word"),
        F.coalesce(F.try_divide(F.col("n_dup_lines"), F.col("n_lines_")), F.lit(0.0)).alias("dup_line_share"),
        per_word("n_repeat_words").alias("repeat_share"),
        per_word("n_distinct_").alias("distinct_share"),
        F.coalesce(F.try_divide(F.col("n_digits_"), F.col("word_chars")), F.lit(0.0)).alias("digit_share"),
        F.coalesce(F.try_divide(F.col("n_words"), F.col("n_lines_")), F.lit(0.0)).alias("words_per_line"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """``feature >= limit`` or ``feature <= limit``."""

    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.limit if self.above else F.col(self.feature) <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.limit:g}"


def _tests(rows: list[dict[str, float]]) -> dict[Test, int]:
    """Candidate tests with the set of rows each holds for, as bits."""
    found = {}
    for f in FEATURES:
        values = [r[f] for r in rows]
        ordered = sorted(values)
        distinct = sorted(set(values))
        if len(distinct) > THRESHOLDS:
            even = {ordered[(k * (len(ordered) - 1)) // THRESHOLDS] for k in range(THRESHOLDS + 1)}
            ends = {ordered[int(len(ordered) * q)] for q in (0.001, 0.003, 0.006, 0.994, 0.997, 0.999)}
            distinct = sorted(even | ends)
        at_least = [0] * len(distinct)  # rows by the largest limit they reach
        for i, v in enumerate(values):
            k = bisect.bisect_right(distinct, v) - 1
            if k >= 0:
                at_least[k] |= 1 << i
        everyone, above = (1 << len(rows)) - 1, 0
        for k in range(len(distinct) - 1, -1, -1):
            above |= at_least[k]
            found[Test(f, True, distinct[k])] = above
            exact = sum(1 << i for i, v in enumerate(values) if v == distinct[k]) if k == 0 else 0
            below = everyone & ~above | exact
            if k and below:
                found[Test(f, False, math.nextafter(distinct[k], -math.inf))] = below
            elif below:
                found[Test(f, False, distinct[0])] = below
    return found


def learn(rows: list[dict[str, float]], junk: list[bool], min_precision: float = MIN_PRECISION) -> list[tuple[Test, ...]]:
    """An ordered list of conjunctions, each describing junk, by sequential covering with grow and prune sets."""
    if not any(junk) or all(junk):
        return []
    tests = _tests(rows)
    bits = lambda keep: sum(1 << i for i in range(len(rows)) if keep(i))
    bad, prune = bits(lambda i: junk[i]), bits(lambda i: i % 3 == 2)
    left, rules = (1 << len(rows)) - 1, []
    least = max(3, bad.bit_count() // 200)
    while len(rules) < MAX_RULES:
        rule: list[Test] = []
        cover = left & ~prune
        while len(rule) < MAX_TESTS:
            p, n = (cover & bad).bit_count(), (cover & ~bad).bit_count()
            if not p or not n:
                break
            before, best, best_gain = math.log2(p / (p + n)), None, 1e-9
            for test, holds in tests.items():
                now = cover & holds
                p1 = (now & bad).bit_count()
                if p1 and (gain := p1 * (math.log2(p1 / now.bit_count()) - before)) > best_gain:
                    best, best_gain = test, gain
            if best is None:
                break
            rule.append(best)
            cover &= tests[best]

        def worth(part: list[Test]) -> tuple[float, int]:
            held = left & prune
            for t in part:
                held &= tests[t]
            p, n = (held & bad).bit_count(), (held & ~bad).bit_count()
            return ((p - n) / (p + n) if p + n else -1.0), -len(part)

        pruned = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=[])
        cover = left
        for t in pruned:
            cover &= tests[t]
        p, held = (cover & bad).bit_count(), cover & prune
        if not pruned or p < least or (held & bad).bit_count() < min_precision * held.bit_count() or p < min_precision * cover.bit_count():
            break
        rules.append(tuple(pruned))
        left &= ~cover
    return rules


def as_column(rules: list[tuple[Test, ...]]) -> Column:
    """True where a text is kept: the first rule that holds decides, otherwise the text stays."""
    verdict = None
    for rule in rules:
        holds = rule[0].column()
        for t in rule[1:]:
            holds = holds & t.column()
        verdict = (F if verdict is None else verdict).when(holds, F.lit(False))
    return verdict.otherwise(F.lit(True)) if verdict is not None else F.lit(True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_PER_LABEL, held_out: tuple[int, int] = (1, 1)) -> list[tuple[Test, ...]]:
    """The decision list of the labelled sample; only rows that pass the base limits take part.

    ``held_out`` (modulus, remainder of the id's crc32) leaves rows out; by default none.
    """
    rows = labelled_sample(docs, labels, "quality", *held_out, sample, id_col, text_col)
    seen = statistics(rows, ["doc_id", "label"]).where(~base_failed()).select("doc_id", "label", *FEATURES).collect()
    seen.sort(key=lambda r: str(r.doc_id))
    return learn([{f: float(r[f]) for f in FEATURES} for r in seen], [r.label == 0 for r in seen])


def judge(docs: DataFrame, rules: list[tuple[Test, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the statistics, base_failed and kept."""
    rows = statistics(docs, [F.col(f"`{id_col}`").alias("doc_id")], text_col)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & as_column(rules))
