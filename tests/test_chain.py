"""The two-topic chain, duplicate suppression and the live join over several micro-batches, with faults and replays."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardwatch import schemas
from wardwatch.operators import rules as ru
from wardwatch.streaming import chain as ch
from wardwatch.streaming.topic import consume, once_per_key, publish
from tests.test_streaming import START, _accepted

VITALS = (130, 85, 50, 90.5, 28, 39.25)


def _alerts(spark, rows):
    """(alert_id, patient_id, time) rows as full alert records."""
    full = [(a, f"e-{a}", p, "H", "W", "1", t, "HIGH", ["R1 x", "R3 \"y\" é"], VITALS, None) for a, p, t in rows]
    return spark.createDataFrame(full, schemas.ALERT)


def _rows(n, seed=1, disorder=900):
    rnd = random.Random(seed)
    rows = [(f"a{i:04d}", "hot" if i % 3 else f"p{i % 17}", START + timedelta(seconds=9 * i, microseconds=i)) for i in range(n)]
    return sorted(rows, key=lambda r: r[2] + timedelta(seconds=rnd.uniform(0, disorder)))


def _send(spark, topic, rows, faults=()):
    """One file of messages: the rows and some payloads as they are."""
    sent = ru.to_keyed_json(_alerts(spark, rows)) if rows else spark.createDataFrame([], "key string, value string")
    bad = spark.createDataFrame([("k", v) for v in faults], "key string, value string")
    sent.unionByName(bad).coalesce(1).write.mode("append").parquet(topic)


def test_chain_with_faults_and_replays(spark, tmp_path):
    rows = _rows(1500)
    chain = ch.Chain(str(tmp_path))
    long = '{"alert_id": "' + "x" * 900
    no_severity = '{"alert_id": "z", "patient_id": "PT-1", "severity": "NONE", "timestamp_utc": "2024-01-01T00:00:00.000000"}'
    faults = [None, "", "{", long, "[1]", no_severity, '"text"']
    for n in range(5):
        again = rows[max(0, (n - 1) * 300) : n * 300 : 4]  # repeats of the batch before
        _send(spark, chain.alerts, rows[n * 300 : (n + 1) * 300] + again, faults if n in (1, 3) else ())
    for _ in range(2):  # the second time everything is replayed from the checkpoints: nothing new comes out
        ch.check_alerts(spark, chain, delay="40 minutes", files_per_batch=1)
        clean = spark.read.schema(schemas.ALERT).parquet(chain.clean).collect()
        assert sorted(r.alert_id for r in clean) == sorted(r[0] for r in rows)
        assert all(tuple(r.vitals_snapshot) == VITALS and r.triggered_rules[1] == "R3 \"y\" é" for r in clean)
        dead = sorted(r.error_preview for r in ch.dead_letters(spark, chain).collect())
        assert dead == sorted(f[:200] for f in 2 * faults if f is not None) and max(map(len, dead)) == 200
    want = _accepted(rows, 60)
    assert {r.alert_id for r in ch.accept_alerts(spark, chain, 60, "40 minutes").collect()} == want
    fresh = ch.Chain(str(tmp_path / "again"))  # a new consumer from the start of the same topic, into the same audit table
    ch.publish(consume(spark, chain.clean, schemas.ALERT), fresh.clean, fresh.clean_checkpoint).awaitTermination()
    before = spark.read.parquet(f"{chain.accepted}/table").count()
    ch.audit_sink(consume(spark, f"{chain.accepted}/table", spark.read.parquet(f"{chain.accepted}/table").schema), f"{chain.accepted}/table", fresh.audit_checkpoint).awaitTermination()
    assert spark.read.parquet(f"{chain.accepted}/table").count() == before == len(want)


def test_published_alerts_come_back(spark, tmp_path):
    chain = ch.Chain(str(tmp_path))
    rows = _rows(40)
    _alerts(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.ALERT).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ch.publish_alerts(stream, chain)
        got, dead = ch.read_alerts(spark.read.schema("key string, value string").parquet(chain.alerts))
        assert sorted((r.alert_id, r.patient_id, r.timestamp_utc) for r in got.collect()) == sorted(rows) and dead.isEmpty()


def test_state_of_suppression_is_bounded(spark, tmp_path):
    """Keys leave the state once the watermark has passed them; repeats are suppressed all the same, as late rows."""
    chain = ch.Chain(str(tmp_path))
    rows = [(f"a{i:03d}", "p", START + timedelta(minutes=i)) for i in range(400)]
    for n in range(8):
        _send(spark, chain.alerts, rows[n * 50 : (n + 1) * 50] + rows[max(0, n - 1) * 50 : n * 50] + rows[:20])
    found, _ = ch.read_alerts(consume(spark, chain.alerts, files_per_batch=1))
    query = publish(once_per_key(found, delay="60 minutes"), chain.clean, chain.clean_checkpoint)
    query.awaitTermination()
    assert sorted(r.alert_id for r in spark.read.parquet(chain.clean).collect()) == [r[0] for r in rows]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 8 and held[-1] <= 150


@pytest.mark.parametrize("files", [1, None])
def test_live_join(spark, tmp_path, files):
    rows = _rows(600, disorder=300)
    rnd = random.Random(4)
    answers = []
    for a, _, t in rows:
        wait = rnd.choice((None, 0.25, 5, 19.999, 20, 20.001, 300, -3))
        if wait is not None:
            answers.append((a, "URGENT", t + timedelta(seconds=wait)))
    answers.sort(key=lambda r: r[2] + timedelta(seconds=rnd.uniform(0, 200)))
    schema_a, schema_r = "alert_id string, patient_id string, timestamp_utc timestamp_ntz", "alert_id string, urgency_level string, generated_at timestamp_ntz"
    for n in range(4):
        spark.createDataFrame(rows[n * 150 : (n + 1) * 150], schema_a).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        part = answers[n * len(answers) // 4 : (n + 1) * len(answers) // 4]
        spark.createDataFrame(part, schema_r).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    from pyspark.sql.types import _parse_datatype_string as parse

    a, r = (consume(spark, str(tmp_path / x), parse(s), files) for x, s in (("a", schema_a), ("r", schema_r)))
    got = {x.alert_id: x for x in ch.drain_live_join(a, r, "20 seconds", "1 hour", str(tmp_path / "out")).collect()}
    found = {i: round((g - t).total_seconds() * 1000) for i, _, g in answers for j, _, t in rows if i == j}
    assert set(got) == {i for i, _, _ in rows}
    for i, x in got.items():
        inside = i in found and 0 <= found[i] <= 20_000
        assert (x.status, x.elapsed_ms) == (("complete", found[i]) if inside else ("processing", None))


def test_elapsed_ms(spark):
    at = [datetime(2024, 1, 1, 0, 0, 0), datetime(2024, 1, 2, 0, 0, 1, 1999)]
    row = spark.createDataFrame([tuple(at), (at[0], None)], "a timestamp_ntz, b timestamp_ntz").select(ch.elapsed_ms(F.col("a"), F.col("b")).alias("ms"))
    assert [r.ms for r in row.collect()] == [86_401_001, None]
