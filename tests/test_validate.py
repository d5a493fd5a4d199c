"""Validation of raw JSON readings (lax coercion, bounds, defaults, reasons)."""

import json

from wardwatch.operators import validate as va

BASE = {
    "event_id": "e", "patient_id": "PT-001", "hospital_id": "H", "ward": "W", "bed_number": "1",
    "timestamp_utc": "2024-01-01 00:00:00",
    "vitals": {"heart_rate_bpm": 75, "systolic_bp_mmhg": 120, "diastolic_bp_mmhg": 80, "spo2_percent": 98.0,
               "respiratory_rate_rpm": 14, "temperature_celsius": 36.8},
}


def _msg(**change):
    m = json.loads(json.dumps(BASE))
    vit = change.pop("vitals", {})
    m["vitals"].update(vit)
    for k, v in change.items():
        if v is ...:
            m.pop(k)
        else:
            m[k] = v
    return json.dumps(m)


def _run(spark, texts):
    rows = [(i, None, t) for i, t in enumerate(texts)]
    raw = spark.createDataFrame(rows, "msg_offset long, received_at timestamp_ntz, value string")
    out = va.validate_telemetry(va.parse_telemetry(raw)).orderBy("msg_offset").collect()
    return out


def test_validation_examples(spark):
    texts = [
        _msg(vitals={"diastolic_bp_mmhg": 120}),      # 0 DBP = SBP rejected
        _msg(vitals={"heart_rate_bpm": 19}),          # 1 rejected
        _msg(vitals={"heart_rate_bpm": 20}),          # 2 accepted
        _msg(vitals={"heart_rate_bpm": 300}),         # 3 accepted
        _msg(vitals={"heart_rate_bpm": 301}),         # 4 rejected
        _msg(patient_id="pt-001"),                    # 5 normalised
        _msg(patient_id="PT-"),                       # 6 too short
        _msg(patient_id="XX-001"),                    # 7 bad prefix
        _msg(nursing_notes="x" * 1001),               # 8 too long
        _msg(vitals={"heart_rate_bpm": "120"}),       # 9 lax string
        _msg(vitals={"heart_rate_bpm": 120.0}),       # 10 lax float
        _msg(vitals={"heart_rate_bpm": 120.5}),       # 11 fractional rejected
        _msg(extra_key=1),                            # 12 ignored
        _msg(event_id=...),                           # 13 default id
        _msg(ward=...),                               # 14 missing ward
        '{"event_id": "x", "patient',                 # 15 malformed
    ]
    out = _run(spark, texts)
    reasons = [r.rejection_reasons for r in out]
    assert reasons[0] == ["diastolic_not_below_systolic"]
    assert reasons[1] == ["out_of_range:heart_rate_bpm"]
    assert reasons[2] == [] and reasons[3] == []
    assert reasons[4] == ["out_of_range:heart_rate_bpm"]
    assert reasons[5] == [] and out[5].patient_id == "PT-001"
    assert reasons[6] == ["patient_id_length"]
    assert reasons[7] == ["patient_id_prefix"]
    assert reasons[8] == ["nursing_notes_too_long"]
    assert reasons[9] == [] and out[9].vitals.heart_rate_bpm == 120
    assert reasons[10] == [] and out[10].vitals.heart_rate_bpm == 120
    assert reasons[11] == ["not_an_integer:heart_rate_bpm"]
    assert reasons[12] == []
    assert reasons[13] == [] and out[13].event_id == "offset-13"
    assert reasons[14] == ["missing:ward"]
    assert reasons[15] == ["malformed_json"]
    assert out[2].is_simulated is False


def test_split_and_reasons(spark):
    raw = spark.createDataFrame(
        [(0, None, _msg()), (1, None, _msg(vitals={"heart_rate_bpm": 10})), (2, None, None)],
        "msg_offset long, received_at timestamp_ntz, value string",
    )
    valid, rejects = va.split_valid(va.validate_telemetry(va.parse_telemetry(raw)))
    assert valid.count() == 1  # the tombstone is skipped
    counts = {r.reason: r.n_rejected for r in va.rejects_by_reason(rejects).collect()}
    assert counts == {"out_of_range:heart_rate_bpm": 1}
