"""Quality scores by a factorisation machine.

A text is a sparse vector: its distinct words hashed to ``BUCKETS`` places
(of joint length one), statistics of its structure, and numeric metadata
columns of its row.  A factorisation machine weighs all places and, by
low-rank factors, all pairs of places.  The pairs are scored in linear time
with the sum-of-squares identity:
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

The machine is fitted on a bounded sample of labelled rows
(``SAMPLE_PER_LABEL`` of each label) by full-batch adaptive gradient descent
on the class-balanced logistic loss; scoring is one pass over whole texts.
Ids, labels, language and source are never inputs.

Defined results: a null text is empty; an empty text has all-zero words and
statistics; a null metadata value is zero with a flag; without labels of both
kinds all scores are equal; repeated rows give repeated rows; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.common import crc_mod, labelled_sample, slices
from wardwatch.session import cut_lineage

SAMPLE_PER_LABEL = 2000
BUCKETS, FACTORS = 4096, 6
ROUNDS, RATE, RIDGE, SEED = 150, 0.08, 2e-4, 7
HELD_OUT = (3, 1)

_SIGNS = re.compile(r"[^\w\s]")
_DIGITS = re.compile(r"[0-9]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
STRUCTURE = 14
_place: dict[str, int] = {}


def _bucket(word: str) -> int:
    at = _place.get(word)
    if at is None:
        at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(_place) < 300_000:
            _place[word] = at
    return at


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """Statistics of a text's structure, each roughly between 0 and 1."""
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * STRUCTURE
    lines = [x for x in text.split("\n") if x.strip()]
    signs = len(_SIGNS.findall(text))
    same = sum(a == b for a, b in zip(words, words[1:]))
    triples = n - 2
    distinct = len(set(zip(words, words[1:], words[2:]))) if triples > 0 else 0
    letters = sum(map(len, counts))
    return [
        1.0,
        math.log1p(n) / 10,
        min(2.0, (chars - n) / n / 10),
        letters / len(counts) / 10 if letters < 50 * len(counts) else 5.0,
        min(3.0, 5 * signs / chars),
        min(3.0, 5 * len(_DIGITS.findall(text)) / chars),
        min(3.0, 5 * len(_CAPITALS.findall(text)) / chars),
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        same / n,
        1 - distinct / triples if triples > 0 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        math.log1p(n / max(1, len(lines))) / 8,
        1.0 if n < 50 else 0.0,
    ]


def vector(text: str | None, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's sparse vector."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    places = sorted({_bucket(w) for w in counts})
    values = [1 / math.sqrt(len(places))] * len(places) if places else []
    dense = structure(text, words, counts)
    for m in metadata:
        known = m is not None and math.isfinite(m)
        dense += [math.copysign(math.log1p(abs(m)), m) / 15 if known else 0.0, 0.0 if known else 1.0]
    at = [i for i, v in enumerate(dense) if v]
    return np.array(places + [BUCKETS + i for i in at], np.int64), np.array(values + [dense[i] for i in at], float)


class Machine:
    """Weights ``w``, factors ``v`` and intercept of a fitted machine."""

    def __init__(self, n: int):
        self.w, self.v, self.b = np.zeros(n), np.random.default_rng(SEED).normal(0, 0.05, (n, FACTORS)), 0.0

    def margin(self, places: np.ndarray, values: np.ndarray) -> float:
        v = self.v[places]
        inner = values @ v
        return float(self.b + values @ self.w[places] + 0.5 * (inner @ inner - (values**2) @ (v**2).sum(1)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rounds: int = ROUNDS) -> Machine:
        y, n = np.asarray(labels, float), len(self.w)
        pos = y.sum()
        if not 0 < pos < len(y):
            self.v[:], self.b = 0, -2.0 if len(y) and pos == 0 else 2.0
            return self
        share = np.where(y == 1, 0.5 / pos, 0.5 / (len(y) - pos))
        row = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
        col = np.concatenate([p for p, _ in rows])
        val = np.concatenate([x for _, x in rows])
        by_col = np.argsort(col, kind="stable")
        row, col, val = row[by_col], col[by_col], val[by_col]
        sums = lambda x: np.bincount(row, x, len(y))
        seen = np.full((n, FACTORS + 1), 1e-8)
        seen_b = 1e-8
        for _ in range(rounds):
            inner = np.stack([sums(val * self.v[col, f]) for f in range(FACTORS)], axis=1)
            square = sums(val**2 * (self.v**2).sum(1)[col])
            z = self.b + sums(val * self.w[col]) + 0.5 * ((inner**2).sum(1) - square)
            g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            gv = g[row] * val
            step = np.empty((n, FACTORS + 1))
            step[:, 0] = np.bincount(col, gv, n) + RIDGE * self.w
            own = np.bincount(col, gv * val, n)
            for f in range(FACTORS):
                step[:, 1 + f] = np.bincount(col, gv * inner[row, f], n) - own * self.v[:, f] + RIDGE * self.v[:, f]
            seen += step**2
            seen_b += g.sum() ** 2
            move = RATE * step / np.sqrt(seen)
            self.w -= move[:, 0]
            self.v -= move[:, 1:]
            self.b -= RATE * g.sum() / math.sqrt(seen_b)
        return self


def _columns(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    have = {c.lower() for c in docs.columns}
    meta = [F.col(f"`{m}`").cast("double") if m.lower() in have else F.lit(None).cast("double") for m in metadata]
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.array(*meta).cast("array<double>").alias("meta"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE_PER_LABEL, held_out: tuple[int, int] = HELD_OUT) -> Machine:
    """Fit a machine on the labelled sample; vectors are made by Spark, at most 2 x ``sample`` of them reach the driver."""
    packed = _columns(docs, id_col, text_col, metadata).select("doc_id", F.to_json(F.struct("text", "meta")).alias("text"))
    rows = labelled_sample(packed, labels.withColumnRenamed(id_col, "doc_id"), label_col, *held_out, sample)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "label", F.from_json("text", "text string, meta array<double>").alias("r")).select("doc_id", "label", "r.text", "r.meta")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            made = [vector(t, m) for t, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.astype("<i4").tobytes() for p, _ in made], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary())],
                ["doc_id", "label", "places", "vals"],
            )

    found = cut_lineage(rows.mapInArrow(vectors, "doc_id string, label int, places binary, vals binary"))
    taken = sorted(found.collect(), key=lambda r: r.doc_id)
    vecs = [(np.frombuffer(bytes(r.places), "<i4").astype(np.int64), np.frombuffer(bytes(r.vals), "<f4").astype(float)) for r in taken]
    return Machine(BUCKETS + STRUCTURE + 2 * len(metadata)).fit(vecs, [r.label for r in taken])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE_PER_LABEL) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    machine = fit(docs, labels, id_col=id_col, text_col=text_col, metadata=metadata, sample=sample)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            z = [model.value.margin(*vector(t, m)) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            scores = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    rows = _columns(docs, id_col, text_col, metadata)
    rows = rows.mapInArrow(scored, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
