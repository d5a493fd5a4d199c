"""Toxicity scores behind a noisy-channel deobfuscation.

1.  A character trigram model is counted over all documents: each task adds
    up dense trigram counts with numpy and Spark sums them.  The alphabet has
    64 classes by rule, so the model has a fixed size and its counts grow
    with the corpus.
2.  Spots that may be disguised (all runs that hold a digit or sign, words
    with a doubled letter, single letters set apart, tokens with separators
    inside) are restored: each spot is a lattice in which a character may
    stand for itself, for the letters it looks like, repeat the one before or
    only separate, and Viterbi decoding over all states finds the reading
    that channel and language model together favour.  A text's words are its
    words as written and those of the readings.
3.  Words and word beginnings of the restored texts are counted for a bounded
    sample of labelled rows (``SAMPLE_PER_LABEL``); those that tell toxic
    texts apart become features of a logistic regression, which scores every
    restored text.

Defined results: null and empty texts are scored on no words at all; without
labels of both kinds every score is the same (under 0.5 unless all labels are
1); null ids are never learned from; repeated rows give repeated rows; an
empty table gives none; extra columns are kept by ``drop_toxic`` whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.common import crc_mod, fit_logistic, fresh, labelled_sample, slices
from wardwatch.session import cut_lineage

#: Labelled rows of each label that the scorer is fitted on, and features it keeps.
SAMPLE_PER_LABEL = 2500
MAX_FEATURES = 4000
HELD_OUT = (5, 0)

#: Classes of the character model: 0 for all that ends a word, a-z, the accented Latin-1 letters, one for other letters.
CLASSES = 64
OTHER = 63
#: Letters that a sign may stand for, with the cost in nats of writing it so.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz",
}
SIGN_COST, WILD_COST, SIGN_KEPT, SEPARATOR_DROPPED, SEPARATOR_KEPT = 1.0, 2.5, 9.0, 0.3, 2.0
REPEAT_COST = {2: 3.0, 3: 0.2}
#: Marks a path that a character leaves in its state; less is a class before a letter, more one before a separator.
STAY = 64
#: Characters whose back pointers are held at a time; of longer spots the states between segments are kept and segments decoded again.
SEGMENT = 2048

_L = r"[^\W\d_]"
_SIGN = r"[0-9@$!|+€£(*]"
_C = r"\w@$!|+€£(*"  # where "_" has become "-"
#: A run of letters and signs with a sign in it; a token with separators inside; characters set apart by separators of any length.
_SIGNED = re.compile(rf"(?<![{_C}]){_L}*+{_SIGN}[{_C}]*+")
_JOINED = re.compile(rf"(?<![{_C}])[{_C}]++(?:[^{_C}\s]++[{_C}]++)++")
_APART = re.compile(rf"(?<![{_C}])[{_C}](?![{_C}])(?:[^{_C}]++[{_C}](?![{_C}])){{2,}}+")
#: Signs that punctuation puts at the ends of a word; a run is read with them and without.
_ENDS = "!|+(*"
_DOUBLED = re.compile(rf"({_L})\1")
_ANY_SIGN = re.compile(_SIGN)
_WORD = re.compile(rf"{_L}+")


def spots(low: str, words: set[str]) -> set[str]:
    """All that may be disguised in a lower-case text with these words: doubled letters, signs, and separators within."""
    low = low.replace("_", "-")
    found = {w for w in words if _DOUBLED.search(w)}
    tokens = " ".join({t for t in low.split() if not t.isalpha() and not t[:-1].isalpha() or t[-1] in _ENDS or _ANY_SIGN.match(t[-1])})
    for run in _SIGNED.findall(tokens):
        found.add(run)
        bare = run.strip(_ENDS)
        if bare != run and _ANY_SIGN.search(bare):
            found.add(bare)
    found.update(_JOINED.findall(tokens))
    found.update(_APART.findall(low))
    return found


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    accented = [c for c in range(0xDF, 0x100) if c != 0xF7]
    table[accented] = np.arange(27, 27 + len(accented))
    return table


_CLASS = _class_table()


def _class_of(char: str) -> int:
    code = ord(char)
    return int(_CLASS[code]) if code < 256 else OTHER if char.isalpha() else 0


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for batch in slices(batches):
        text = "  ".join(t for t in batch.column(0).to_pylist() if t)
        codes = np.frombuffer(f"  {text}  ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(codes < 256, _CLASS[np.minimum(codes, 255)], OTHER)
        total += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs (negative logs) of a character after two others, from all documents; at most 64^3 sums reach the driver."""
    grams = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(_trigram_counts, "gram long, n long")
    sums = grams.groupBy("gram").agg(F.sum("n").alias("n")).collect()
    tri = np.zeros(CLASSES**3)
    for r in sums:
        tri[r.gram] = r.n
    tri = tri.reshape(CLASSES, CLASSES, CLASSES)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * CLASSES)
    p2 = (bi + 4 * p1) / (bi.sum(1, keepdims=True) + 4)
    p3 = (tri + 8 * p2[None]) / (tri.sum(2, keepdims=True) + 8)
    return -np.log(p3)


def _table(paths: dict[tuple[int, int], float]) -> np.ndarray:
    costs = np.full((CLASSES, CLASSES), np.inf)
    costs[tuple(zip(*paths))] = list(paths.values())
    return costs


class Restorer:
    """Viterbi decoding of disguised spots under a character model; readings are kept for spots seen before."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.seen = costs, {}
        self._at = costs.tolist()

    def _options(self, spot: str, i: int) -> list[tuple[str | None, float]]:
        """Readings of a character, with their costs; None: nothing of its own."""
        char = spot[i]
        run = 1
        while run <= min(i, 2) and spot[i - run] == char:
            run += 1
        again = REPEAT_COST[3 if run > 2 or run == 2 and spot[i + 1 : i + 2] == char else 2]
        if char.isalpha():
            return [(char, 0.0), (None, again)] if run > 1 else [(char, 0.0)]
        letters = LOOKS_LIKE.get(char, "")
        cost = WILD_COST if len(letters) > 2 else SIGN_COST
        found: list[tuple[str | None, float]] = [(x, cost) for x in letters]
        if not letters or char == "*":
            mask = char == "*" and "*" in (spot[i - 1 : i], spot[i + 1 : i + 2])  # several together stand for letters sooner than they separate
            found += [(None, WILD_COST if mask else SEPARATOR_DROPPED), (" ", SEPARATOR_KEPT)]
        else:
            found.append((" ", SIGN_KEPT))
            if run > 1:
                found.append((None, again))
        return found

    def read(self, spot: str) -> str:
        """The likeliest words behind a lower-case spot: the cheapest of all paths, by back pointers."""
        known = self.seen.get(spot)
        if known is not None:
            return known
        states: list = [({(0, 0): 0.0}, None)]
        back: list = []
        for start in range(0, len(spot), SEGMENT):
            back = []
            states.append(self._segment(spot, start, states[-1], back))
        paths, dense = states.pop()
        if dense is not None:
            state = divmod(int((dense + self.costs[:, :, 0]).argmin()), CLASSES)
        else:
            state = min((cost + self._at[a][b][0], (a, b)) for (a, b), cost in paths.items())[1]
        said = []
        for number in range(len(states) - 1, -1, -1):
            if number < len(states) - 1:
                back = []
                self._segment(spot, number * SEGMENT, states[number], back)
            for come in reversed(back):
                if isinstance(come, dict):
                    state, out = come[state]
                else:
                    (a, b), at = state, int(come[state])
                    if at < STAY:
                        state, out = (at, a), chr(ord("a") + b - 1)
                    else:
                        state, out = (state, "") if at == STAY else ((at - STAY - 1, a), " ")
                said.append(out)
        best = "".join(reversed(said))
        if len(self.seen) < 100_000 and len(spot) < 200:
            self.seen[spot] = best
        return best

    def _segment(self, spot: str, start: int, state: tuple, back: list) -> tuple:
        """The state (paths, dense) after the segment from ``start`` on; back pointers are added to ``back``, one entry a character."""
        paths, dense = state
        rows, end, i = self._at, min(len(spot), start + SEGMENT), start
        while i < end:
            after: dict[tuple[int, int], float] = {}
            come: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            options = self._options(spot, i)
            i += 1
            if len(options) > 8:
                before = _table(paths) if dense is None else dense
                dense, come = self._any_letter(before, dict(options))
                back.append(come)
                # Within a run of the sign all costs soon grow alike; from there on each step is the same (but for rounding).
                reached = dense < np.inf
                if spot[i - 2 : i + 1] == "***" and (reached == (before < np.inf)).all() and np.ptp(grown := dense[reached] - before[reached]) < 1e-9:
                    steps = 0
                    while i + steps < end and spot[i + steps] == "*":
                        steps += 1
                    dense = dense + steps * grown.mean()
                    back.extend([come] * steps)
                    i += steps
                continue
            if dense is not None:
                at = np.nonzero(np.isfinite(dense))
                paths, dense = dict(zip(zip(*(x.tolist() for x in at)), dense[at].tolist())), None
            options = [(out, price, 0 if out is None else _class_of(out)) for out, price in options]
            for state, cost in paths.items():
                a, b = state
                for out, price, c in options:
                    if out is None or out == " " and b == 0:
                        to, total, out = state, cost + price, ""
                    else:
                        to, total = (b, c), cost + price + rows[a][b][c]
                    if to not in after or total < after[to]:
                        after[to], come[to] = total, (state, out)
            paths = after
            back.append(come)
        return paths, dense

    def _any_letter(self, costs: np.ndarray, price: dict[str | None, float]) -> tuple[np.ndarray, np.ndarray]:
        """Costs of all states after a sign that may stand for any letter, separate or be dropped; where each came from."""
        open_ = costs < np.inf
        firsts, lasts = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        known = costs[np.ix_(firsts, lasts)][:, :, None] + self.costs[firsts[:, None], lasts, :27]
        after, come = np.full((CLASSES, CLASSES), np.inf), np.full((CLASSES, CLASSES), STAY)
        after[lasts, :27], come[lasts, :27] = known.min(0), firsts[known.argmin(0)]
        after[:, 1:27] += price["a"]
        after[:, 0] += price[" "]
        come[:, 0] += STAY + 1
        after[0, 0], come[0, 0] = np.inf, STAY  # a separator adds nothing to another
        stay = costs + price[None]
        stay[:, 0] = np.minimum(stay[:, 0], costs[:, 0] + price[" "])
        come = np.where(stay <= after, STAY, come).astype(np.uint8)
        return np.minimum(after, stay), come

    def words(self, text: str | None) -> set[str]:
        """The distinct lower-case words of a text, disguised ones restored (the whole text counts)."""
        low = (text or "").lower()
        found = set(_WORD.findall(low))
        for spot in spots(low, found):
            found.update(_WORD.findall(self.read(spot)))
        return found


def marks(words: set[str]) -> set[str]:
    """Features of a set of words: the words, and the beginnings of four and five letters of longer ones."""
    return {f"={w}" for w in words} | {w[:4] for w in words if len(w) > 4} | {w[:5] for w in words if len(w) > 5}


class Scorer:
    """A fitted model: character costs, feature weights and intercept; small enough to broadcast."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], intercept: float):
        self.costs, self.intercept = costs, intercept
        self.whole = {k[1:]: v for k, v in weights.items() if k[0] == "="}
        self.starts = {k: v for k, v in weights.items() if k[0] != "="}
        self._restorer = None

    def __getstate__(self):
        return self.__dict__ | {"_restorer": None}

    def score(self, text: str | None) -> float:
        if self._restorer is None:
            self._restorer = Restorer(self.costs)
        words = self._restorer.words(text)
        z = self.intercept + sum(self.whole[w] for w in words & self.whole.keys())
        if self.starts:
            starts = {w[:4] for w in words if len(w) > 4} | {w[:5] for w in words if len(w) > 5}
            z += sum(self.starts[s] for s in starts & self.starts.keys())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_PER_LABEL, held_out: tuple[int, int] = HELD_OUT) -> Scorer:
    """Count the character model over ``docs`` and fit the scorer on the labelled sample."""
    costs = character_model(docs, text_col)
    rows = labelled_sample(docs, labels, label_col, *held_out, sample, id_col, text_col)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in slices(batches, 64):
            found = [sorted(marks(restorer.words(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["doc_id", "label", "marks"])

    marked = cut_lineage(rows.mapInArrow(features, "doc_id string, label int, marks array<string>"))
    sizes = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    counts = marked.select("label", F.explode("marks").alias("mark")).groupBy("mark").agg(F.sum("label").alias("k1"), F.count_if(F.col("label") == 0).alias("k0"))
    gain = F.log((F.col("k1") + 0.5) / (n1 + 1)) - F.log((F.col("k0") + 0.5) / (n0 + 1))
    chosen = counts.where((F.col("k1") >= 4) & (gain >= 1.5)).orderBy((gain * F.sqrt("k1")).desc(), "mark").limit(MAX_FEATURES)
    names = [r.mark for r in chosen.collect()]
    index = {m: i for i, m in enumerate(names)}
    table = marked.select("label", F.array_intersect("marks", F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("marks"), "doc_id")
    table = sorted(table.collect(), key=lambda r: r.doc_id)
    weights, intercept = fit_logistic([[index[m] for m in r.marks] for r in table], [r.label for r in table], len(names))
    return Scorer(costs, {m: float(w) for m, w in zip(names, weights) if abs(w) > 1e-6}, intercept)


def score(docs: DataFrame, scorer: Scorer, carry: list, text_col: str = "text") -> DataFrame:
    """``carry`` columns of every row and the score of its whole text."""
    kept = docs.select(*carry, F.col(f"`{text_col}`").cast("string").alias("text_"))
    names = kept.columns[:-1]
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [model.value.score(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(values, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in kept.dtypes[:-1])
    return kept.mapInArrow(scored, f"{schema}{', ' * bool(names)}score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_PER_LABEL) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    scorer = fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample)
    rows = score(docs, scorer, [F.col(f"`{id_col}`").alias("doc_id")], text_col)
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5, sample: int = SAMPLE_PER_LABEL) -> DataFrame:
    """The rows scored below ``limit``, with all their columns."""
    scorer = fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample)
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def rated(texts):
        return texts.map(lambda t: model.value.score(t if isinstance(t, str) else None))

    mark = fresh(docs, "score")
    return docs.withColumn(mark, rated(F.col(f"`{text_col}`").cast("string"))).where(F.col(mark) < limit).select(*[F.col(f"`{c}`") for c in docs.columns])
