"""Derived alerts, the first write of the audit table and batches of a topic: work that grows no faster than the input."""

import glob
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wardwatch.operators.audit import append_audit
from wardwatch.plans import catalog

START = datetime(2024, 1, 1)
#: HotSpot interprets methods beyond this many bytes of code.
COMPILED = 8000


def _events(spark, folder, n=1500):
    rows = [(i, START + timedelta(minutes=11 * i), i % 40, ("view", "error", "signup", "purchase", None)[i % 5], 1.5, "{}") for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_methods_small_enough_to_be_compiled(spark, tmp_path):
    plan = catalog.alerts(spark, _events(spark, tmp_path))._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(plan)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) < COMPILED, sizes


def test_first_audit_batch_is_derived_once(spark, tmp_path):
    derived = spark.sparkContext.accumulator(0)

    @F.udf("timestamp_ntz")
    def at(i):
        derived.add(1)
        return START + timedelta(hours=i)

    batch = spark.range(100).select(F.col("id").cast("string").alias("alert_id"), at("id").alias("created_at"))
    assert append_audit(batch, str(tmp_path / "t"), "alert_id", time="created_at") == 100
    assert derived.value == 100
    assert append_audit(batch, str(tmp_path / "t"), "alert_id", time="created_at") == 0
    assert append_audit(batch.where("false"), str(tmp_path / "none"), "alert_id", time="created_at") == 0
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100


def test_batches_of_many_files(spark, tmp_path, monkeypatch):
    """A topic's batches are written in files by their size, and each alert still comes out once."""
    monkeypatch.setattr(catalog, "ROWS_A_FILE", 50)
    monkeypatch.setattr("wardwatch.streaming.alert_stream.scratch_checkpoint", lambda spark, name: str(tmp_path / name))
    folder = _events(spark, tmp_path)
    want = catalog.alerts(spark, folder)
    got = catalog.q_stream_dedup(spark, folder)
    ids = sorted(r.alert_id for r in want.select("alert_id").collect())
    assert len(ids) > 300 and sorted(r.alert_id for r in got.select("alert_id").collect()) == ids
    assert len(glob.glob(str(tmp_path / "dedup" / "alerts" / "*.parquet"))) > 2 * 4
