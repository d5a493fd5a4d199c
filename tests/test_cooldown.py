"""Cooldown: golden example and brute force with a hot patient across many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from wardwatch.operators.cooldown import accepted_keys, apply_cooldown, gap_runs, skipped_per_patient


def _frame(spark, rows):
    return spark.createDataFrame(rows, "alert_id string, patient_id string, secs long").withColumn(
        "timestamp_utc", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, secs)")
    )


def _brute(rows, cooldown):
    last, out = {}, set()
    for aid, pid, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if pid not in last or t - last[pid] >= cooldown:
            last[pid] = t
            out.add(aid)
    return out


def test_golden_sequence(spark):
    times = [0, 30, 59, 60, 90, 119, 120, 200]
    rows = [(f"a{t}", "PT-1", t) for t in times] + [(f"b{t}", "PT-2", t) for t in times[:2]]
    got = {r.alert_id for r in apply_cooldown(_frame(spark, rows), 60, num_partitions=3).where("accepted").collect()}
    assert got == {"a0", "a60", "a120", "a200", "b0"}


@pytest.mark.parametrize("parts", [1, 5, 13])
def test_hot_patient_matches_fold(spark, parts):
    rnd = random.Random(7)
    rows, t = [], 0
    for i in range(3000):
        pid = "PT-HOT" if i % 3 == 0 else f"PT-{rnd.randrange(40)}"
        t += rnd.randrange(0, 40)
        rows.append((f"x{i}", pid, t))
    want = _brute(rows, 60)
    got = {r.alert_id for r in apply_cooldown(_frame(spark, rows), 60, num_partitions=parts).where("accepted").collect()}
    assert got == want


def _hot(seed, n=4000, step=40):
    """One patient with half of all alerts, equal times and redelivered alerts among them."""
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice((0, 1, rnd.randrange(step), rnd.randrange(200) if i % 97 == 0 else 0))
        rows.append((f"x{i}", "PT-HOT" if i % 2 else f"PT-{rnd.randrange(30)}", t))
        if i % 11 == 0:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("parts", [None, 50])
@pytest.mark.parametrize("cooldown", [60, 10**6])
def test_half_of_all_rows(spark, parts, cooldown):
    rows = _hot(cooldown)
    want = _brute(set(rows), cooldown)
    df = _frame(spark, rows).repartition(3)
    assert sorted(r.alert_id for r in accepted_keys(df, cooldown, num_partitions=parts).collect()) == sorted(want)
    marked = apply_cooldown(df, cooldown, num_partitions=parts).collect()
    assert len(marked) == len(rows) and sorted(r.alert_id for r in marked if r.accepted) == sorted(want)
    counts = {r.patient_id: (r.n_alerts, r.n_accepted, r.n_skipped) for r in skipped_per_patient(df, cooldown, num_partitions=parts).collect()}
    assert counts["PT-HOT"][0] == sum(p == "PT-HOT" for _, p, _ in rows) and sum(c[1] for c in counts.values()) == len(want)
    assert all(a - b == c for a, b, c in counts.values())


@pytest.mark.parametrize("parts", [None, 50])
def test_runs(spark, parts):
    rows = _hot(3)
    want = []
    for p in {p for _, p, _ in rows}:
        times = sorted(t for _, q, t in rows if q == p)
        start = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] >= 60:
                want.append((p, times[start], times[i - 1], i - start))
                start = i
    got = gap_runs(_frame(spark, rows), 60, num_partitions=parts)
    secs = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {c})")
    assert sorted(tuple(r) for r in got.select("patient_id", secs("run_start"), secs("run_end"), "n_alerts").collect()) == sorted(want)


def test_no_rows_and_nulls(spark):
    none = _frame(spark, [])
    assert accepted_keys(none, 60).collect() == [] and apply_cooldown(none, 60).collect() == [] and gap_runs(none, 60).collect() == []
    rows = [("a", None, 0), ("b", None, 30), ("c", "PT-1", None), ("d", "PT-1", 5), (None, "PT-2", 1), (None, "PT-2", 90)]
    marked = apply_cooldown(_frame(spark, rows), 60).collect()
    assert len(marked) == 6 and sorted(str(r.alert_id) for r in marked if r.accepted) == ["None", "None", "a", "d"]


def test_chains_hold_one_cooldown(spark):
    """The first pass holds the alerts of one cooldown at most, and fewer as chains meet."""
    import numpy as np

    from wardwatch.operators.cooldown import _Chains

    rng = np.random.default_rng(2)
    t = np.cumsum(rng.integers(1, 4, 200_000))
    chains = _Chains(60, int(t[0]))
    for at in range(0, len(t), 1000):
        chains.add(t[at : at + 1000])
        assert len(chains.cand) <= 61
    assert len(chains.cand) <= 2
