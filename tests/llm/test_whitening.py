"""Whitening against numpy's own eigenvalues and exact Python numbers, and the edge cases."""

import numpy as np
import pytest

from wardwatch.llm import embedding_whitening as ew

SF = "/root/testdata/sf0.01"


def _whole(c):
    return [int(np.floor(1024 * float(np.float32(v)))) + 100_000 for v in c]


def _check(got, vectors, components=8):
    x = np.array([_whole(v) for _, v in vectors], object)
    n, sums = len(x), x.sum(0)
    y = (x - np.array([s / n for s in sums])).astype(float)
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    white = y @ v / np.sqrt(np.abs(e))
    rows = {}
    for r in got:
        rows.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(rows) == list(range(1, min(components, len(e)) + 1))
    for c, by_id in rows.items():
        assert len(by_id) == n
        mine = np.array([by_id[i].whitened for i, _ in vectors])
        sign = np.sign(mine @ white[:, c - 1])
        assert np.allclose(mine * sign, white[:, c - 1], atol=1e-8)
        assert by_id[vectors[0][0]].explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-10)
    for (i, _), row in zip(vectors, x):
        want = sum((n * a - s) ** 2 for a, s in zip(row, sums))
        assert rows[1][i].deviation == want == int(rows[1][i].deviation_wide)
        assert rows[1][i].n == n and rows[1][i].identity_error <= 1e-9


def test_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    _check(ew.whiten(table).collect(), vectors)


def test_rows_that_do_not_count(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<float>, whitened string").repartition(7)
    _check(ew.whiten(df).collect(), good)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, `Component` int"
    assert ew.whiten(spark.createDataFrame([], schema)).collect() == []
    assert ew.whiten(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    same = ew.whiten(spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], schema)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.n == 3 for r in same)
    ragged = ew.whiten(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0, 0.0], 1), (3, [], 1), (4, [0.0, 0.0, 1.0], 1)], schema)).collect()
    full = ew.whiten(spark.createDataFrame([(1, [1.0, 0.0, 0.0], 1), (2, [1.0, 2.0, 0.0], 1), (3, [0.0, 0.0, 0.0], 1), (4, [0.0, 0.0, 1.0], 1)], schema)).collect()
    key = lambda r: (r.vec_id, r.component)
    assert [(key(r), r.deviation, round(abs(r.whitened), 9)) for r in sorted(ragged, key=key)] == [(key(r), r.deviation, round(abs(r.whitened), 9)) for r in sorted(full, key=key)]
    huge = ew.whiten(spark.createDataFrame([(1, [3e38], 1), (2, [-3e38], 1), (3, [0.5], 1)], schema)).collect()
    x = [2**50 + 100_000, -(2**50) + 100_000, 100_512]
    assert {r.vec_id: (int(r.deviation_wide), r.deviation) for r in huge} == {i + 1: ((3 * a - sum(x)) ** 2, None if (3 * a - sum(x)) ** 2 >= 2**63 else (3 * a - sum(x)) ** 2) for i, a in enumerate(x)}


@pytest.mark.parametrize("n", [1, 10**4, 10**8, 10**13])
def test_deviations_are_exact(n):
    rng = np.random.default_rng(1)
    x = rng.integers(99_000, 101_000, (20, 6))
    sums = [n * 100_000 + int(rng.integers(0, n + 1)) for _ in range(6)]
    found = ew.Fit(n, sums, np.zeros(0), np.zeros((0, 6)), 1.0)
    assert found.deviations(x) == [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]


@pytest.mark.parametrize("case", ["random", "clusters", "diagonal", "rank", "graded", "block"])
def test_eigen(case):
    rng = np.random.default_rng(11)
    d = 40
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    spread = {"random": rng.uniform(0, 9, d), "clusters": np.repeat([5.0, 5.0 + 1e-9, 2.0, 1.0], 10), "rank": np.r_[3.0, 2.0, np.zeros(d - 2)], "graded": 10.0 ** -np.arange(d)}.get(case)
    a = np.diag(np.arange(d, dtype=float)) if case == "diagonal" else np.kron(np.eye(d // 4), rng.normal(size=(4, 4))) if case == "block" else (q * spread) @ q.T
    a = (a + a.T) / 2
    values, vectors = ew.leading_components(a, 8)
    norm = np.abs(a).max()
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:8], atol=1e-13 * d * norm)
    assert np.abs(vectors @ vectors.T - np.eye(8)).max() < 1e-10
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11 * norm


def test_sturm_count():
    d, e = np.array([2.0, -1.0, 0.5, 3.0]), np.array([1.0, 0.0, 2.0])
    eig = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    shifts = np.array([-5.0, 0.0, 1.0, 2.2, 9.0])
    assert ew.count_below(d, e, shifts).tolist() == [(eig < s).sum() for s in shifts]
