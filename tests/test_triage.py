"""The triage chain with a caller's embedding and model functions, and the Kafka row shape."""

from datetime import datetime

from pyspark.sql import functions as F

from tests.stand_ins import hashing_embedder, rule_based_replier
from wardwatch.operators import keyword_index as ki
from wardwatch.operators import reasoning as rs
from wardwatch.plans import catalog
from wardwatch.plans.triage import triage
from wardwatch.sources import tables as tb
from wardwatch.streaming.alert_stream import kafka_messages, telemetry_to_alerts

SF = "/root/testdata/sf0.001"


def test_chain_with_functions(spark):
    al = catalog.alerts(spark, SF).orderBy("alert_id").limit(60).cache()
    dims = 24
    docs = tb.sops(spark, SF).limit(40).drop("embedding")
    docs = rs.embed(docs, "content", hashing_embedder(dims), "embedding").cache()
    index = ki.build(docs.select(F.col("id").alias("doc_id"), "title", "content"), F.concat_ws(" ", "title", "content"), buckets=2)
    asked = []

    def reply(prompts: list[str]) -> list[str]:
        asked.extend(prompts)
        return ["not json" if "severity=HIGH" in p and i % 5 == 0 else r for i, (p, r) in enumerate(zip(prompts, rule_based_replier(prompts)))]

    out = triage(
        al, tb.patients(spark, SF), tb.triage_events_from_alerts(al), docs, index,
        embed=lambda q: rs.embed(q, "text", hashing_embedder(dims), "vec"),
        reply=lambda p: rs.score(p, reply),
        cooldown_s=1, model_name="stand-in",
    )
    prompts = {r.alert_id: r for r in out.prompts.collect()}
    parsed = {r.alert_id: r for r in out.parsed.collect()}
    assert set(prompts) == set(parsed) == {r.alert_id for r in al.collect()}
    assert all(len(r.retrieved_sops) == 3 and r.prompt.count("protocol=") == 3 for r in prompts.values())
    for r in prompts.values():  # documents in rank order, with their texts
        at = [r.prompt.index(f"protocol={i + 1}/{d.category}/{d.title}") for i, d in enumerate(r.retrieved_sops)]
        assert at == sorted(at) and all(f"<<<\n{d.content}\n>>>" in r.prompt for d in r.retrieved_sops)
    recs = {r.alert_id: r for r in out.recommendations.collect()}
    assert set(recs) == {i for i, r in parsed.items() if r.llm_error is None}
    urgency = {"CRITICAL": "IMMEDIATE", "HIGH": "URGENT", "MEDIUM": "SEMI_URGENT"}
    assert all(r.urgency_level == urgency[prompts[i].severity] and r.llm_model_used == "stand-in" for i, r in recs.items())


def test_failing_model_loses_no_alert(spark):
    def broken(prompts: list[str]) -> list[str]:
        if any("x" in p for p in prompts):
            raise RuntimeError("quota")
        return rule_based_replier(prompts)

    rows = spark.createDataFrame([("a", "severity=HIGH\n"), ("b", "x"), ("c", "severity=LOW\n")], "alert_id string, prompt string").coalesce(1)
    got = {r.alert_id: r for r in rs.score(rows, broken).collect()}
    assert got["b"].raw_reply is None and "quota" in got["b"].model_error
    assert got["a"].raw_reply and got["c"].raw_reply and got["a"].model_error is None


def test_kafka_rows(spark):
    at = datetime(2024, 1, 1)
    body = b'{"patient_id": "pt-001", "hospital_id": "H", "ward": "W", "bed_number": "1", "vitals": {"heart_rate_bpm": 127, "systolic_bp_mmhg": 79, "diastolic_bp_mmhg": 47, "spo2_percent": 87.5, "respiratory_rate_rpm": 31, "temperature_celsius": 40.2}}'
    rows = [(None, bytearray(body), "vitals", 3, 41, at, 0), (None, None, "vitals", 3, 42, at, 0), (None, bytearray(b"{"), "vitals", 3, 43, at, 0)]
    kafka = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int")
    alerts, rejects = telemetry_to_alerts(kafka_messages(kafka))
    got = alerts.first()
    assert (got.source_event_id, got.patient_id, got.severity, got.timestamp_utc) == ("offset-vitals-3-41", "PT-001", "CRITICAL", at)
    assert [r.rejection_reasons for r in rejects.collect()] == [["malformed_json"]]


def test_recommendations_never_go_through_the_driver(spark):
    """there are as many recommendations as alerts, so their join must not be a broadcast, however small the file of events looks."""
    plan = catalog.q_feed_display(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_prompts_are_saved_in_columns(spark):
    """prompts hold whole documents; they are kept as compressed files, not as a checkpoint of every byte."""
    al = catalog.alerts(spark, SF).orderBy("alert_id").limit(5).cache()
    docs = tb.sops(spark, SF).limit(30).drop("embedding")
    docs = rs.embed(docs, "content", hashing_embedder(8), "embedding").cache()
    index = ki.build(docs.select(F.col("id").alias("doc_id"), "title", "content"), F.concat_ws(" ", "title", "content"), buckets=2)
    out = triage(al, tb.patients(spark, SF), tb.triage_events_from_alerts(al), docs, index,
                 embed=lambda q: rs.embed(q, "text", hashing_embedder(8), "vec"), reply=lambda p: rs.score(p, rule_based_replier), cooldown_s=1)
    assert len(out.prompts.inputFiles()) >= 1 and out.prompts.count() == 5
