"""Whitening of embeddings along their leading principal components.

Three passes over the vectors fit the projection, a last one applies it.

1.  Exact sums: entries become whole numbers ``floor(1024 c) + 100000``;
    each task adds them up per dimension, Spark adds the tasks.
2.  Centred covariance: each task takes the mean off its vectors, multiplies
    block by block and passes on one matrix; its rows are dealt by row number,
    so that the sums of the matrices are spread over the tasks too.
3.  The driver holds the matrix alone (at most ``MAX_DIM`` squared).
    Householder reflections make it tridiagonal, Sturm counts bisect the
    leading eigenvalues, inverse iteration finds their vectors, and vectors
    of eigenvalues that lie close together are made orthogonal to each other.
4.  The components are broadcast.  A pass over all vectors measures how far
    the covariance of the whitened values is from the identity, and the last
    one gives each vector its values.

Defined results: vectors that are null or hold null or non-finite entries
have no rows; of vectors of different lengths the shorter ones count as
filled with zeros; entries beyond +-2^50 count as that; repeated rows and ids
are kept, each counts; components without variance (a rank below the number
of components, a single vector, equal vectors) have null values, an explained
share of 0, and no part in the identity error; ``deviation`` is null where
the exact number exceeds a long, and ``deviation_wide`` has it still; an
empty table gives an empty one; extra columns are ignored by ``whiten`` and
all columns but the id and the vector may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
#: The covariance of this many dimensions is 128 MB.
MAX_DIM = 4096
SCALE, SHIFT = 1024, 100_000
LIMIT = 2.0**50
#: Rows that are turned into a matrix at a time.
BLOCK_ROWS = 2048
#: Eigenvalues this close, as a share of the matrix norm, count as one cluster.
CLUSTER = 1e-3
_HALF = 25


def _blocks(batches: Iterator[pa.RecordBatch], dims: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with (numbers of the rows that count, whole numbers, lengths); short vectors are filled up."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(at, BLOCK_ROWS)
            column = batch.column(batch.num_columns - 1)
            valid = np.asarray(column.is_valid())
            flat = column.flatten().cast(pa.float64())
            entries = np.asarray(flat.fill_null(float("nan")))
            sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
            good = np.flatnonzero(valid & (bad[ends] == bad[ends - sizes]))
            width = int(sizes[good].max(initial=0)) if dims is None else dims
            x = np.full((len(good), width), SHIFT, np.int64)
            place = np.arange(width)[None] < sizes[good][:, None]
            source = (ends - sizes)[good][:, None] + np.arange(width)[None]
            x[place] = np.floor(np.clip(entries[source[place]], -LIMIT / SCALE, LIMIT / SCALE) * SCALE).astype(np.int64) + SHIFT
            yield batch, good, x, sizes[good]


@dataclass
class Fit:
    """What the passes leave: count, exact sums, eigenvalues, unit components (rows), and the total variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def __post_init__(self):
        self.mean = np.array([s // self.n for s in self.sums], float) + np.array([(s % self.n) / self.n for s in self.sums]) if self.n else np.zeros(0)
        with_variance = self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)
        self.live = int(with_variance.sum())

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values along the components that have variance."""
        return ((x - self.mean) @ self.components[: self.live].T) / np.sqrt(self.values[: self.live])

    def explained(self) -> list[float]:
        return [float(v / self.trace) if i < self.live else 0.0 for i, v in enumerate(self.values)]

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n x - S)^2, as Python numbers."""
        largest = max([int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums), 0])
        if largest >= 2**62:
            return [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist()]
        d = np.abs(self.n * x - np.array(self.sums, np.int64))
        if int(d.max(initial=0)) >= 2**50:
            return [sum(a * a for a in row) for row in d.tolist()]
        high, low = d >> _HALF, d & (2**_HALF - 1)  # squares and their sums over the dimensions stay below 2^62
        parts = ((high * high).sum(1), (high * low).sum(1), (low * low).sum(1))
        return [(a << 2 * _HALF) + (b << _HALF + 1) + c for a, b, c in zip(*(p.tolist() for p in parts))]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, rows, high, low): per dimension the number of vectors and the sum of entries in two halves; dim -1 counts vectors."""
    n, rows, high, low = 0, *(np.zeros(0, np.int64) for _ in range(3))
    for _, good, x, sizes in _blocks(batches):
        n += len(good)
        more = x.shape[1] - len(rows)
        if more > 0:
            rows, high, low = (np.concatenate([a, np.zeros(more, np.int64)]) for a in (rows, high, low))
        present = np.arange(x.shape[1])[None] < sizes[:, None]
        rows[: x.shape[1]] += present.sum(0)
        high[: x.shape[1]] += np.where(present, x >> _HALF, 0).sum(0)
        low[: x.shape[1]] += np.where(present, x & (2**_HALF - 1), 0).sum(0)
    dims = np.arange(-1, len(rows), dtype=np.int64)
    columns = [dims, *(np.concatenate([[first], a]).astype(np.int64) for first, a in ((n, rows), (0, high), (0, low)))]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "rows", "high", "low"])


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    found = vectors.mapInArrow(_moments, "dim long, rows long, high long, low long").groupBy("dim")
    table = found.agg(*[F.sum(c).alias(c) for c in ("rows", "high", "low")]).limit(MAX_DIM + 2).collect()
    at = {r.dim: r for r in table}
    if len(at) > MAX_DIM + 1:
        raise ValueError(f"vectors of more than {MAX_DIM} dimensions")
    n = at.pop(-1).rows if -1 in at else 0
    return n, [(at[d].high << _HALF) + at[d].low + SHIFT * (n - at[d].rows) for d in range(len(at))]


def _products(vectors: DataFrame, dims: int, centred) -> np.ndarray:
    """Sum over all vectors of the outer product of ``centred(x)``; matrices of the tasks are added by row."""
    width = dims

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = None, False
        for _, good, x, _ in _blocks(batches, dims):
            if len(good):
                y = centred(x)
                part = y.T @ y
                total = part if total is None else total + part
                used = True
        if used:
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * len(total), pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), rows], ["at", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten())
            for i, row in zip(batch.column(0).to_pylist(), flat.reshape(batch.num_rows, -1)):
                sums[i] = sums[i] + row if i in sums else row.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([r.tolist() for r in sums.values()], pa.list_(pa.float64()))], ["at", "part"])

    parts = vectors.mapInArrow(each, "at long, part array<double>").repartition(max(1, min(width, vectors.sparkSession.sparkContext.defaultParallelism)), "at")
    rows = {r.at: r.part for r in parts.mapInArrow(added, "at long, part array<double>").collect()}
    return np.array([rows[i] for i in range(len(rows))]) if rows else np.zeros((0, 0))


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal, off-diagonal and reflections (v, beta) of Householder's reduction of a symmetric matrix."""
    a = np.array(matrix, float)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x[1:]).max(initial=0.0)
        if scale == 0.0:
            reflections.append((np.zeros(d - k - 1), 0.0))
            continue
        length = np.abs(x).max()
        v = x / length
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        beta = 2.0 / (v @ v)
        below = a[k + 1 :, k + 1 :]
        p = beta * (below @ v)
        w = p - (beta / 2 * (p @ v)) * v
        below -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = x[0] - beta * (v @ x) * v[0]
        reflections.append((v, beta))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def count_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix lie below each shift."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float((off**2).max(initial=0.0)))
    pivot = diagonal[0] - shifts
    below = (pivot < 0).astype(int)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - shifts - off[i - 1] ** 2 / pivot
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its bounds are neighbouring numbers."""
    d = len(diagonal)
    radius = np.zeros(d)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    low, high = np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    pad = np.finfo(float).eps * d * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high = low - pad, high + pad
    rank = d - np.arange(k)  # the i-th largest has fewer than this many eigenvalues below it
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return low + (high - low) / 2
        above = count_below(diagonal, off, middle) >= rank
        high = np.where(open_ & above, middle, high)
        low = np.where(open_ & ~above, middle, low)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; vanishing pivots are replaced by a tiny number."""
    d = len(diagonal)
    main, above, second, x = diagonal - shift, np.append(off, 0.0), np.zeros(d), b.copy()
    for i in range(d - 1):
        low = off[i]
        if abs(main[i]) >= abs(low):
            if abs(main[i]) < tiny:
                main[i] = tiny
            f = low / main[i]
            main[i + 1] -= f * above[i]
            x[i + 1] -= f * x[i]
        else:
            f = main[i] / low
            main[i], next_main = low, main[i + 1]
            main[i + 1] = above[i] - f * next_main
            above[i], next_above = next_main, above[i + 1]
            second[i], above[i + 1] = next_above, -f * next_above
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    for i in range(d - 1, -1, -1):
        if i + 1 < d:
            x[i] -= above[i] * x[i + 1]
        if i + 2 < d:
            x[i] -= second[i] * x[i + 2]
        pivot = main[i] if abs(main[i]) >= tiny else np.copysign(tiny, main[i])
        x[i] /= pivot
        if abs(x[i]) > 1e150:
            x /= abs(x[i])
    return x


def _across(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix by inverse iteration; those of a cluster are orthogonal."""
    d = len(diagonal)
    norm = max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    tiny = np.finfo(float).eps * norm
    rng = np.random.default_rng(7)
    found: list[np.ndarray] = []
    first = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * norm:
            first = i
        x = rng.uniform(-1, 1, d)
        for _ in range(6):
            for _ in range(2):
                for other in found[first:]:
                    x -= (other @ x) * other
            x /= np.sqrt(x @ x)
            grown = _solve(diagonal, off, value, x, tiny)
            grown /= np.abs(grown).max()
            x = grown / np.sqrt(grown @ grown)
        for _ in range(2):
            for other in found[first:]:
                x -= (other @ x) * other
            x /= np.sqrt(x @ x)
        found.append(x)
    return np.array(found)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    k = min(k, len(matrix))
    if k == 0:
        return np.zeros(0), np.zeros((0, len(matrix)))
    scale = np.abs(matrix).max()
    if scale == 0 or len(matrix) == 1:
        return np.diag(matrix)[:k].astype(float), np.eye(len(matrix))[:k]
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = _across(diagonal, off, values)
    for j in range(len(reflections) - 1, -1, -1):
        v, beta = reflections[j]
        if beta:
            vectors[:, j + 1 :] -= np.outer(beta * (vectors[:, j + 1 :] @ v), v)
    return values * scale, vectors


def fit(rows: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Fit:
    """Mean, components and eigenvalues of all vectors, and the identity error measured over them."""
    vectors = rows.select(F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    n, sums = _sums(vectors)
    dims = len(sums)
    empty = Fit(n, sums, np.zeros(0), np.zeros((0, dims)), 0.0)
    if not n or not dims:
        return empty
    matrix = _products(vectors, dims, lambda x, mean=empty.mean: x - mean) / n
    values, across = leading_components((matrix + matrix.T) / 2, components)
    found = Fit(n, sums, values, across, float(np.trace(matrix)))
    if found.live:
        white = _products(vectors, dims, found.project) / n
        found.identity_error = float(np.abs(white - np.eye(found.live)).max())
    return found


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector that counts and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide."""
    found = fit(rows, vec_col, components)
    many, dims, explained = len(found.values), len(found.sums), found.explained()
    model = rows.sparkSession.sparkContext.broadcast(found)
    vectors = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Fit = model.value
        for batch, good, x, _ in _blocks(batches, dims):
            if not len(good) or not many:
                continue
            white = np.full((len(good), many), np.nan)
            white[:, : fitted.live] = fitted.project(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1) * many, pa.int32()), pa.array(white.ravel(), mask=np.isnan(white.ravel())))
            exact = fitted.deviations(x)
            long = pa.array([d if d < 2**63 else None for d in exact], pa.int64())
            wide = pa.array([Decimal(d) if d < 10**38 else None for d in exact], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), lists, long, wide], ["vec_id", "white", "deviation", "deviation_wide"])

    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, white array<double>, deviation long, deviation_wide decimal(38,0)"
    out = vectors.mapInArrow(valued, schema)
    shares = F.array(*[F.lit(e) for e in explained]) if explained else F.array().cast("array<double>")
    return out.select("vec_id", F.posexplode("white").alias("place", "whitened"), "deviation", "deviation_wide").select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
        "deviation_wide",
    )
