"""Streaming cooldown over several out-of-order micro-batches, and the audit sink under replay."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException

from wardwatch.operators.audit import append_audit, stored
from wardwatch.streaming.cooldown_state import drain_cooldown

SCHEMA = "alert_id string, patient_id string, timestamp_utc timestamp_ntz"
START = datetime(2024, 1, 1)


def _accepted(rows, cooldown_s):
    by_patient = defaultdict(list)
    for aid, pid, t in rows:
        by_patient[pid].append((t, aid))
    out = set()
    for hits in by_patient.values():
        last = None
        for t, aid in sorted(hits):
            if last is None or (t - last).total_seconds() >= cooldown_s:
                last = t
                out.add(aid)
    return out


def test_cooldown_over_out_of_order_batches(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(f"a{i:05d}", "hot" if i % 3 else f"p{i % 40}", START + timedelta(seconds=i * 7, microseconds=i)) for i in range(4000)]
    late = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rnd.uniform(0, 1500)))  # at most 1500 s out of order
    for n in range(5):
        spark.createDataFrame(late[n * 800:(n + 1) * 800], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    assert "RocksDB" in spark.conf.get(key)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [r.alert_id for r in drain_cooldown(stream, 60, "30 minutes").collect()]
    assert len(got) == len(set(got))
    assert set(got) == _accepted(rows, 60)


@pytest.mark.parametrize("time", [None, "timestamp_utc"])
def test_a_replayed_batch_appends_nothing(spark, tmp_path, time):
    path = str(tmp_path / "audit")
    rows = [(f"a{i}", "p", START + timedelta(hours=9 * i)) for i in range(6)] + [("no-time", "p", None)]
    first = spark.createDataFrame(rows[:4] + rows[:2], SCHEMA)
    assert append_audit(first, path, time=time) == 4
    assert append_audit(first, path, time=time) == 0
    assert append_audit(spark.createDataFrame(rows, SCHEMA), path, time=time) == 3
    assert append_audit(spark.createDataFrame(rows, SCHEMA), path, time=time) == 0
    assert append_audit(spark.createDataFrame([], SCHEMA), path, time=time) == 0
    assert sorted(r.alert_id for r in spark.read.parquet(path).collect()) == sorted(r[0] for r in rows)


def test_a_redelivery_past_midnight_appends_nothing(spark, tmp_path):
    path = str(tmp_path / "audit")
    night = datetime(2024, 1, 1, 23, 59, 59)
    for moved in (0, 2, -2):
        batch = spark.createDataFrame([("a", "p", night + timedelta(seconds=moved))], SCHEMA)
        assert append_audit(batch, path, time="timestamp_utc") == (1 if moved == 0 else 0)


def test_other_read_errors_are_raised(spark):
    with pytest.raises((AnalysisException, Py4JJavaError)):
        stored(spark, "nosuchscheme://x/y", spark.createDataFrame([], SCHEMA).schema)
