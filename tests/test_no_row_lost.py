"""Rows that an earlier version lost: odd vectors, equal titles, offsets of several partitions, clamped pages."""

import json

import pytest

from wardwatch.operators import analytics as an
from wardwatch.operators import audit
from wardwatch.operators import retrieval as rt
from wardwatch.operators import rules as ru
from wardwatch.operators import validate as va


@pytest.mark.parametrize("block_bytes", [200, 1 << 26])
def test_odd_vectors_cost_only_their_own_rows(spark, block_bytes):
    good = [(i, [1.0, float(i)]) for i in range(6)]
    odd = [(90, [1.0, 2.0, 3.0]), (91, None), (92, []), (93, [0.0, 0.0])]
    docs = spark.createDataFrame(good + odd, "doc_id long, vec array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("long", [1.0, 2.0, 3.0])], "query_id string, vec array<double>")
    hits = rt.vector_topk(queries, docs, k=3, block_bytes=block_bytes, dims=2).collect()
    assert sorted((h.rank, h.doc_id) for h in hits if h.query_id == "q") == [(1, 0), (2, 1), (3, 2)]
    assert [(h.rank, h.doc_id) for h in hits if h.query_id == "long"] == [(1, 90)]


def test_documents_of_one_beginning_are_kept_apart(spark):
    start = "x" * 80
    corpus = spark.createDataFrame(
        [(1, start + "a"), (2, start + "b"), (3, start + "b"), (4, start + "c"), (5, None), (6, None)], "id long, content string"
    )
    stored = spark.createDataFrame([(start + "c",)], "content string")
    assert sorted(r.id for r in audit.load_new_documents(corpus, stored).collect()) == [1, 2, 5]


def _message(**vitals):
    v = dict(heart_rate_bpm=127, systolic_bp_mmhg=79, diastolic_bp_mmhg=47, spo2_percent=87.5,
             respiratory_rate_rpm=31, temperature_celsius=40.2) | vitals
    return json.dumps(dict(patient_id="PT-001", hospital_id="H", ward="W", bed_number="1", vitals=v))


def test_offsets_of_two_partitions_are_two_alerts(spark):
    raw = spark.createDataFrame(
        [("t", 0, 7, _message()), ("t", 1, 7, _message(heart_rate_bpm=120))],
        "msg_topic string, msg_partition int, msg_offset long, value string",
    ).selectExpr("*", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS received_at")
    valid, _ = va.split_valid(va.validate_telemetry(va.parse_telemetry(raw)))
    alerts = ru.detect_alerts(valid)
    stored = audit.insert_if_absent(alerts, alerts.limit(0))
    assert stored.count() == 2


def test_numbers_with_a_type_letter_are_refused(spark):
    rows = [(i, _message(heart_rate_bpm=x)) for i, x in enumerate(["120d", "120f", "Infinity", "1e2", " 120 "])]
    raw = spark.createDataFrame(rows, "msg_offset long, value string").selectExpr(
        "*", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS received_at")
    got = va.validate_telemetry(va.parse_telemetry(raw)).orderBy("msg_offset").collect()
    assert [len(r.rejection_reasons) for r in got] == [1, 1, 1, 0, 0]


def test_limits_out_of_range_are_refused(spark):
    events = spark.createDataFrame([], "patient_id string")
    for call in (lambda: an.patient_history(events, "PT-1", 101), lambda: an.patient_history(events, "PT-1", 0),
                 lambda: an.recent_feed(events, 0), lambda: an.recent_feed(events, 1, 500)):
        with pytest.raises(ValueError):
            call()
