"""Golden rule rows derived by hand from the rule definitions (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from wardwatch import schemas
from wardwatch.operators import rules as ru

BASE = dict(heart_rate_bpm=75, systolic_bp_mmhg=120, diastolic_bp_mmhg=80, spo2_percent=98.0,
            respiratory_rate_rpm=14, temperature_celsius=36.8)

CASES = [
    ({}, [], None),
    ({"heart_rate_bpm": 110}, [], None),
    ({"heart_rate_bpm": 111}, ["R1"], "MEDIUM"),
    ({"heart_rate_bpm": 45}, [], None),
    ({"heart_rate_bpm": 44}, ["R2"], "MEDIUM"),
    ({"spo2_percent": 94.0}, [], None),
    ({"spo2_percent": 93.9}, ["R3"], "MEDIUM"),
    ({"systolic_bp_mmhg": 90, "diastolic_bp_mmhg": 60}, [], None),
    ({"systolic_bp_mmhg": 89, "diastolic_bp_mmhg": 60}, ["R4"], "MEDIUM"),
    ({"systolic_bp_mmhg": 180}, [], None),
    ({"systolic_bp_mmhg": 181}, ["R5"], "MEDIUM"),
    ({"respiratory_rate_rpm": 22}, [], None),
    ({"respiratory_rate_rpm": 23}, ["R6"], "MEDIUM"),
    ({"temperature_celsius": 38.3}, [], None),
    ({"temperature_celsius": 38.4}, ["R7"], "MEDIUM"),
    ({"temperature_celsius": 35.9}, [], None),
    ({"heart_rate_bpm": 90, "respiratory_rate_rpm": 21}, [], None),
    ({"heart_rate_bpm": 91, "respiratory_rate_rpm": 21}, ["R9"], "HIGH"),
    ({"heart_rate_bpm": 91, "temperature_celsius": 35.9}, ["R9"], "HIGH"),
    ({"heart_rate_bpm": 91, "temperature_celsius": 36.0}, [], None),
    ({"heart_rate_bpm": 44, "spo2_percent": 93.9}, ["R2", "R3"], "HIGH"),
    ({"heart_rate_bpm": 101, "systolic_bp_mmhg": 99, "diastolic_bp_mmhg": 60, "spo2_percent": 94.9}, ["R8"], "CRITICAL"),
    ({"heart_rate_bpm": 100, "systolic_bp_mmhg": 99, "diastolic_bp_mmhg": 60, "spo2_percent": 94.9}, [], None),
    ({"heart_rate_bpm": 101, "systolic_bp_mmhg": 99, "diastolic_bp_mmhg": 60, "spo2_percent": 94.9,
      "respiratory_rate_rpm": 21}, ["R8", "R9"], "CRITICAL"),
    ({"heart_rate_bpm": 127, "systolic_bp_mmhg": 79, "diastolic_bp_mmhg": 47, "spo2_percent": 87.5,
      "respiratory_rate_rpm": 31, "temperature_celsius": 40.2}, ["R8", "R9", "R1", "R3", "R4", "R6", "R7"], "CRITICAL"),
]


@pytest.fixture(scope="module")
def evaluated(spark):
    rows = []
    for i, (change, _, _) in enumerate(CASES):
        v = {**BASE, **change}
        rows.append((str(i), "PT-1", "H", "W", "1", v, None))
    df = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], r[4], tuple(r[5][n] for n in schemas.VITAL_NAMES), r[6]) for r in rows],
        "event_id string, patient_id string, hospital_id string, ward string, bed_number string, "
        "vitals struct<heart_rate_bpm:int,systolic_bp_mmhg:int,diastolic_bp_mmhg:int,spo2_percent:double,"
        "respiratory_rate_rpm:int,temperature_celsius:double>, nursing_notes string",
    ).withColumn("timestamp_utc", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    out = ru.detect_alerts(df).collect()
    return {r.source_event_id: r for r in out}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_golden_rule_rows(evaluated, i):
    _, rules, severity = CASES[i]
    row = evaluated.get(str(i))
    if not rules:
        assert row is None
        return
    assert [t.split(" ")[0] for t in row.triggered_rules] == rules
    assert row.severity == severity


def test_sirs_text(evaluated):
    row = evaluated[str(len(CASES) - 1)]
    assert row.triggered_rules[1] == "R9 SIRS (3/3 criteria): Temp=40.2°C, HR=127 bpm, RR=31 rpm"
    assert row.triggered_rules[0] == "R8 SHOCK PATTERN: HR=127 bpm, SBP=79 mmHg, SpO2=87.5%"


def test_alert_id_is_deterministic(evaluated):
    row = evaluated["2"]
    import hashlib

    assert row.alert_id == hashlib.sha256(b"alert|2").hexdigest()
