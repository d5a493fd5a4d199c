"""Filling a pattern's rest in hash order, against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from wardwatch.llm import mix_flow

SCHEMA = "pattern string, size long, u long"


def _loop(units, rest):
    taken = set()
    for u, size in sorted(units.items()):
        if size <= rest:
            taken.add(u)
            rest -= size
    return taken, rest


def test_steps_like_a_loop(spark):
    rng = random.Random(4)
    sizes = {"one": [95_000] + [400] * 112, "mixed": [rng.choice((1, 30, 900, rng.randint(1, 5000))) for _ in range(400)], "few": [10, 10]}
    units = {k: {rng.getrandbits(63): n for n in v} for k, v in sizes.items()}
    rests = {"one": 45_000, "mixed": 70_000, "few": 19}
    df = spark.createDataFrame([(k, n, u) for k, v in units.items() for u, n in v.items()], SCHEMA)
    steps = {r.pattern: r.steps for r in mix_flow._fill(df, spark.createDataFrame(list(rests.items()), "pattern string, rest long")).collect()}
    for k, v in units.items():
        got = {u for u, n in v.items() if any(a < u < cut and n <= cap for a, cut, cap in steps[k])}
        assert got == _loop(v, rests[k])[0], k


@pytest.mark.parametrize("seed", range(4))
def test_long_document_does_not_end_the_selection(spark, seed):
    rows = [(0, "big", 95_000)] + [(i, "big", 400) for i in range(1, 113)] + [(1000 + i, "other", 50) for i in range(20)]
    rows += [(2000, "alike", 30)] * 9 + [(3000 + i, "alike", 7) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long")
    quotas = {"big": 45_000, "other": 1000, "alike": 200}
    got = mix_flow.mix(docs, mix_flow.F.array("source"), mix_flow.F.col("words"), quotas, seed=seed)
    sums = {r.source: r.n for r in got.groupBy("source").agg(mix_flow.F.sum("words").alias("n")).collect()}
    assert abs(sums["big"] - 45_000) <= 400 and sums["other"] == 1000 and abs(sums["alike"] - 200) <= 7
    assert got.where("doc_id = 2000").count() in (0, 9)


def _targets(sizes, weights, max_repeats=3):
    left, open_, targets = float(sum(sizes.values())), list(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / total > max_repeats * sizes[s]]
        if not full:
            return targets | {s: left * weights[s] / total for s in open_}
        targets |= {s: float(max_repeats * sizes[s]) for s in full}
        left -= sum(targets[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return targets


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_targets_like_plain_sharing(spark, n):
    rng = random.Random(n)
    sizes = {None if i == 4 else f"{rng.choice('sßz')}{i}": rng.choice((0, 1, 7, 10 ** rng.randint(1, 6))) for i in range(n)}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    got = mix_flow.share_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5.0, 2.0, 1.0)).collect()
    want = _targets(sizes, {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)})
    assert {r.source: r.target for r in got} == pytest.approx(want, rel=1e-9)


def test_more_sources_than_a_network_holds(spark, monkeypatch):
    """Sources that overlap no other need no network, however many there are; only overlapping patterns are bounded."""
    monkeypatch.setattr(mix_flow, "MAX_PATTERNS", 10)
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("h"), F.col("id") % 50_002).alias("source"), (F.col("id") % 7 + 1).alias("words"))
    texts = docs.withColumn("text", F.repeat(F.lit("w "), F.col("words").cast("int")))
    got = mix_flow.mix_words(texts, (5.0, 2.0, 1.0))
    assert got.count() == 60_000 and got.where("taken > 3 * size").isEmpty()
    off = texts.select("doc_id", "source").join(got, "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("longest"))
    assert off.where("abs(taken - target) > longest").isEmpty() and off.count() == 50_002
    both = docs.withColumn("m", F.when(F.col("doc_id") < 9, F.array(F.lit("x"), F.concat(F.lit("y"), F.col("doc_id")))).otherwise(F.array("source")))
    assert mix_flow.mix(both, F.col("m"), F.col("words"), {"x": 10, "h50": 4}).agg(F.sum("words")).first()[0] in range(10, 22)
    many = docs.withColumn("m", F.array(F.lit("x"), F.col("source")))
    with pytest.raises(ValueError):
        mix_flow.mix(many, F.col("m"), F.col("words"), {"x": 10})


@pytest.mark.parametrize("seed", range(2))
def test_few_broadcast_patterns_like_many(spark, monkeypatch, seed):
    """Plans that are too long to be broadcast select the same rows; clashing column names are kept."""
    rng = random.Random(seed)
    rows = [(i, f"s{rng.randrange(4)}", rng.randint(1, 50), "a", 1, 2, 3, "p") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long, pattern string, size int, u int, copy int, plan_pattern string")
    mixed = lambda: sorted(mix_flow.mix(docs, F.array("source"), F.col("words"), weights=(5.0, 2.0, 1.0), seed=seed).collect())
    first = mixed()
    monkeypatch.setattr(mix_flow, "sized", lambda small: small.hint("shuffle_hash"))
    assert mixed() == first and first[0].asDict().keys() == {"doc_id", "source", "words", "pattern", "size", "u", "copy", "plan_pattern"}
