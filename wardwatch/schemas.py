"""Declared record types, bounds and enumerations.

Values in the FIXED VALUES blocks must stay equal to the source system's
contract for results to agree; they are written out plainly on purpose.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- FIXED VALUES: vital-sign plausibility bounds (inclusive) ---------------
# name, spark type, low, high
VITAL_BOUNDS = [
    ("heart_rate_bpm", "int", 20, 300),
    ("systolic_bp_mmhg", "int", 50, 260),
    ("diastolic_bp_mmhg", "int", 30, 160),
    ("spo2_percent", "double", 50.0, 100.0),
    ("respiratory_rate_rpm", "int", 4, 60),
    ("temperature_celsius", "double", 32.0, 43.0),
]
PATIENT_ID_MIN_LEN = 4
PATIENT_ID_MAX_LEN = 32
PATIENT_ID_PREFIX = "PT-"
NURSING_NOTES_MAX_LEN = 1000

# --- FIXED VALUES: enumerations --------------------------------------------
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]  # ascending rank 0..3
URGENCY_LEVELS = ["IMMEDIATE", "URGENT", "SEMI_URGENT", "NON_URGENT"]
ENVELOPE_TYPES = ["ping", "alert_received", "triage_recommendation"]
DASHBOARD_PERIOD = "last_24_hours"
DEFAULT_COOLDOWN_SECONDS = 60
RRF_K = 60
PRICE_PER_TRIAGE = 0.05

VITAL_NAMES = [b[0] for b in VITAL_BOUNDS]


def _spark_type(name: str) -> T.DataType:
    return T.IntegerType() if name == "int" else T.DoubleType()


VITALS = T.StructType([T.StructField(n, _spark_type(t), True) for n, t, _, _ in VITAL_BOUNDS])

TELEMETRY = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("patient_id", T.StringType(), False),
        T.StructField("hospital_id", T.StringType(), False),
        T.StructField("ward", T.StringType(), False),
        T.StructField("bed_number", T.StringType(), False),
        T.StructField("timestamp_utc", T.TimestampNTZType(), False),
        T.StructField("vitals", VITALS, False),
        T.StructField("nursing_notes", T.StringType(), True),
        T.StructField("is_simulated", T.BooleanType(), False),
    ]
)

# Raw JSON is parsed with *string* numbers so that lax numeric coercion
# ("120", 120.0 -> 120) can be decided afterwards with try_cast, and with
# VARIANT texts, which keep the kind that the message has.
TEXT_FIELDS = ["event_id", "patient_id", "hospital_id", "ward", "bed_number", "nursing_notes"]
RAW_VITALS = T.StructType([T.StructField(n, T.StringType(), True) for n in VITAL_NAMES])
RAW_TELEMETRY = T.StructType(
    [
        *[T.StructField(n, T.VariantType(), True) for n in TEXT_FIELDS],
        T.StructField("timestamp_utc", T.StringType(), True),
        T.StructField("vitals", RAW_VITALS, True),
        T.StructField("is_simulated", T.StringType(), True),
        T.StructField("_corrupt_record", T.StringType(), True),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("alert_id", T.StringType(), False),
        T.StructField("source_event_id", T.StringType(), False),
        T.StructField("patient_id", T.StringType(), False),
        T.StructField("hospital_id", T.StringType(), False),
        T.StructField("ward", T.StringType(), False),
        T.StructField("bed_number", T.StringType(), False),
        T.StructField("timestamp_utc", T.TimestampNTZType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("triggered_rules", T.ArrayType(T.StringType(), False), False),
        T.StructField("vitals_snapshot", VITALS, False),
        T.StructField("nursing_notes", T.StringType(), True),
    ]
)

ACTION = T.StructType(
    [
        T.StructField("priority", T.IntegerType(), True),
        T.StructField("action", T.StringType(), True),
        T.StructField("rationale", T.StringType(), True),
        T.StructField("time_window", T.StringType(), True),
    ]
)

# Model reply as parsed from JSON text (all keys nullable; required-ness is
# checked as data, not by failing the task).
REPLY = T.StructType(
    [
        T.StructField("urgency_level", T.StringType(), True),
        T.StructField("clinical_summary", T.StringType(), True),
        T.StructField("primary_concern", T.StringType(), True),
        T.StructField("recommended_actions", T.ArrayType(ACTION), True),
        T.StructField("contraindications", T.ArrayType(T.StringType()), True),
        T.StructField("sops_referenced", T.ArrayType(T.StringType()), True),
        T.StructField("confidence_score", T.DoubleType(), True),
    ]
)

MEDICATION = T.MapType(T.StringType(), T.StringType())

PATIENTS = T.StructType(
    [
        T.StructField("patient_id", T.StringType(), False),
        T.StructField("full_name", T.StringType(), True),
        T.StructField("date_of_birth", T.DateType(), True),
        T.StructField("gender", T.StringType(), True),
        T.StructField("blood_type", T.StringType(), True),
        T.StructField("weight_kg", T.DoubleType(), True),
        T.StructField("allergies", T.ArrayType(T.StringType()), True),
        T.StructField("chronic_conditions", T.ArrayType(T.StringType()), True),
        T.StructField("active_medications", T.ArrayType(MEDICATION), True),
        T.StructField("hospital_id", T.StringType(), True),
        T.StructField("ward", T.StringType(), True),
        T.StructField("bed_number", T.StringType(), True),
    ]
)

ENVELOPE = T.StructType(
    [
        T.StructField("event_type", T.StringType(), False),
        T.StructField("payload", T.StringType(), True),
        T.StructField("timestamp", T.TimestampNTZType(), True),
    ]
)
