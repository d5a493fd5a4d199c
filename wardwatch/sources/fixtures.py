"""Record types derived from the driver's generic tables.

The telemetry, patient, audit, document and reply tables of this domain are
derived deterministically from ``events``, ``customer``, ``documents`` and
``embeddings``.  Each derivation is written ONCE as SQL expression text that
both Spark SQL and DuckDB accept (a two-entry dialect switch covers array and
map literals), so the Spark inputs and the oracle's inputs are the same
tables by construction.  The operators under test never use these
expressions; they are written independently with the DataFrame API.

All derivations are projections (no join, no shuffle) except ``sops``: all
documents, left-joined to the vectors that some of them have.
"""

from __future__ import annotations

# --- fixture parameters (chosen for this library) ------------------------------
# profile per events.event_type (others -> steady)
PROFILE_OF_EVENT_TYPE = [("error", "infected"), ("signup", "bleeding"), ("purchase", "pressure")]
PROFILES = ["infected", "bleeding", "pressure", "steady"]
# inclusive ranges; SpO2 and temperature are in tenths
PROFILE_RANGES = {
    #            HR          SBP         DBP        SpO2x10     RR        Tx10
    "infected": [(99, 134), (81, 109), (41, 64), (855, 949), (20, 35), (377, 407)],
    "bleeding": [(94, 129), (74, 103), (36, 59), (911, 961), (16, 28), (349, 368)],
    "pressure": [(69, 97), (151, 189), (89, 113), (933, 972), (13, 24), (361, 381)],
    "steady": [(51, 86), (103, 141), (58, 79), (949, 999), (10, 17), (358, 375)],
}
# value = low + (event_id * p + user_id * q) % span, per vital in the order above
VITAL_MULTIPLIERS = [(7919, 31), (104729, 17), (1299709, 13), (15485863, 7), (32452843, 5), (49979687, 3)]
WARDS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NOTE_TEXTS = [
    "Slept badly, asks for water",
    "Cannula replaced in left arm",
    "Walked to the window with help",
    "Dinner untouched",
    "Dizzy on sitting up",
    "Relatives called twice",
    "Drain emptied, 40 ml",
]
BLOOD_TYPES = ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"]
ALLERGIES = ["penicillin", "latex", "sulfa", "iodine"]
CONDITIONS = ["hypertension", "type 2 diabetes", "asthma", "COPD", "chronic kidney disease"]
MEDICATIONS = [("metoprolol", "25mg"), ("metformin", "500mg"), ("salbutamol", "100mcg"), ("lisinopril", "10mg")]
FIXTURE_MODEL = "fixture-model"

SPARK = "spark"
DUCKDB = "duckdb"


def _arr(dialect: str, items: list[str]) -> str:
    inner = ", ".join(items)
    return f"array({inner})" if dialect == SPARK else f"list_value({inner})"


def _map(dialect: str, pairs: list[tuple[str, str]]) -> str:
    if dialect == SPARK:
        return "map(" + ", ".join(f"{k}, {v}" for k, v in pairs) + ")"
    return "MAP {" + ", ".join(f"{k}: {v}" for k, v in pairs) + "}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case_index(expr: str, values: list[str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} ELSE {default} END"


def profile_expr() -> str:
    whens = " ".join(f"WHEN {_q(t)} THEN {PROFILES.index(p)}" for t, p in PROFILE_OF_EVENT_TYPE)
    return f"CASE event_type {whens} ELSE {PROFILES.index('steady')} END"


def vital_raw(i: int) -> str:
    """Un-injected integer value of vital ``i`` (tenths for SpO2 / T); needs column ``prof``."""
    p, q = VITAL_MULTIPLIERS[i]
    branches = []
    for k, prof in enumerate(PROFILES):
        lo, hi = PROFILE_RANGES[prof][i]
        span = hi - lo + 1
        branches.append(
            f"WHEN {k} THEN {lo} + ((event_id % {span}) * {p % span} + (user_id % {span}) * {q % span}) % {span}"
        )
    return f"CAST(CASE prof {' '.join(branches)} END AS INT)"


def telemetry_columns(dialect: str) -> list[tuple[str, str]]:
    """(name, expression) over ``events`` giving one bedside reading per event."""
    sbp_raw = "sbp_raw"
    return [
        ("event_id", "CAST(event_id AS STRING)"),
        ("event_seq", "event_id"),
        (
            "patient_id",
            "CASE WHEN event_id % 7 = 0 THEN 'pt-' ELSE 'PT-' END || lpad(CAST(user_id AS STRING), 6, '0')",
        ),
        ("hospital_id", "'HOSP-' || lpad(CAST(user_id % 25 AS STRING), 3, '0')"),
        ("ward", _case_index("user_id % 5", [_q(w) for w in WARDS])),
        ("bed_number", "CAST(user_id % 50 AS STRING)"),
        ("timestamp_utc", "ts"),
        (
            "heart_rate_bpm",
            f"CASE WHEN event_id % 97 = 0 THEN 10 WHEN event_id % 103 = 0 THEN 40 ELSE {vital_raw(0)} END",
        ),
        ("systolic_bp_mmhg", f"CASE WHEN event_id % 107 = 0 THEN 190 ELSE {sbp_raw} END"),
        ("diastolic_bp_mmhg", f"CASE WHEN event_id % 101 = 0 THEN {sbp_raw} ELSE {vital_raw(2)} END"),
        ("spo2_percent", f"CAST({vital_raw(3)} AS DOUBLE) / 10"),
        ("respiratory_rate_rpm", vital_raw(4)),
        ("temperature_celsius", f"CAST({vital_raw(5)} AS DOUBLE) / 10"),
        ("nursing_notes", _case_index("event_id % 11", [_q(n) for n in NOTE_TEXTS])),
        ("is_simulated", "event_id % 2 = 1"),
    ]


def telemetry_select_sql(dialect: str, source: str = "events") -> str:
    cols = ",\n  ".join(f"{e} AS {n}" for n, e in telemetry_columns(dialect))
    # profile and un-injected SBP are computed once in inner projections
    inner = f"SELECT *, {profile_expr()} AS prof FROM {source}"
    mid = f"SELECT *, {vital_raw(1)} AS sbp_raw FROM ({inner}) e0"
    return f"SELECT\n  {cols}\nFROM ({mid}) e1"


def raw_telemetry_select_sql(dialect: str, source: str = "events") -> str:
    """Kafka-like raw rows ``(offset, received_at, value)`` with JSON text.

    Variants exercise lax coercion ("120", 120.0), a fractional int (120.5),
    missing required / defaulted keys, an unknown key, a too-long note and a
    truncated message and a tombstone.
    """
    tel = telemetry_select_sql(dialect, source)
    hr = "CAST(heart_rate_bpm AS STRING)"
    hr_text = (
        f"CASE WHEN event_seq % 13 = 0 THEN '\"' || {hr} || '\"' "
        f"WHEN event_seq % 17 = 0 THEN {hr} || '.0' "
        f"WHEN event_seq % 19 = 0 THEN {hr} || '.5' ELSE {hr} END"
    )
    body = (
        "'{' || "
        "CASE WHEN event_seq % 29 = 0 THEN '' ELSE '\"event_id\": \"' || event_id || '\", ' END || "
        "'\"patient_id\": \"' || patient_id || '\", ' || "
        "'\"hospital_id\": \"' || hospital_id || '\", ' || "
        "CASE WHEN event_seq % 23 = 0 THEN '' ELSE '\"ward\": \"' || ward || '\", ' END || "
        "'\"bed_number\": \"' || bed_number || '\", ' || "
        "CASE WHEN event_seq % 37 = 0 THEN '' ELSE '\"timestamp_utc\": \"' || CAST(timestamp_utc AS STRING) || '\", ' END || "
        "'\"vitals\": {\"heart_rate_bpm\": ' || hr_text || "
        "', \"systolic_bp_mmhg\": ' || CAST(systolic_bp_mmhg AS STRING) || "
        "', \"diastolic_bp_mmhg\": ' || CAST(diastolic_bp_mmhg AS STRING) || "
        "', \"spo2_percent\": ' || CAST(spo2_percent AS STRING) || "
        "', \"respiratory_rate_rpm\": ' || CAST(respiratory_rate_rpm AS STRING) || "
        "', \"temperature_celsius\": ' || CAST(temperature_celsius AS STRING) || '}' || "
        "CASE WHEN event_seq % 41 = 0 THEN ', \"nursing_notes\": \"' || repeat('x', 1001) || '\"' "
        "WHEN nursing_notes IS NULL THEN '' ELSE ', \"nursing_notes\": \"' || nursing_notes || '\"' END || "
        "CASE WHEN event_seq % 2 = 0 THEN '' ELSE ', \"is_simulated\": true' END || "
        "CASE WHEN event_seq % 31 = 0 THEN ', \"unknown_field\": 1' ELSE '' END || '}'"
    )
    value = "CASE WHEN event_seq % 83 = 0 THEN NULL WHEN event_seq % 89 = 0 THEN substr(body, 1, 60) ELSE body END"
    # received_at: broker time one second after the reading
    received = "timestamp_utc + INTERVAL 1 SECOND" if dialect == SPARK else "timestamp_utc + INTERVAL '1 second'"
    hr_sql = f"SELECT *, {hr_text} AS hr_text FROM ({tel}) t0"
    body_sql = f"SELECT *, {body} AS body FROM ({hr_sql}) t1"
    return f"SELECT event_seq AS msg_offset, {received} AS received_at, {value} AS value FROM ({body_sql}) t2"


def patients_columns(dialect: str) -> list[tuple[str, str]]:
    k = "c_custkey"
    meds = [_map(dialect, [("'name'", _q(n)), ("'dose'", _q(d))]) for n, d in MEDICATIONS]
    return [
        ("patient_id", f"'PT-' || lpad(CAST({k} AS STRING), 6, '0')"),
        ("full_name", "c_name"),
        ("date_of_birth", f"DATE '1930-01-01' + CAST({k} * 37 % 29000 AS INT)"),
        ("gender", f"CASE WHEN {k} % 2 = 0 THEN 'F' ELSE 'M' END"),
        (
            "blood_type",
            f"CASE WHEN {k} % 11 = 0 THEN NULL ELSE {_case_index(f'{k} % 8', [_q(b) for b in BLOOD_TYPES])} END",
        ),
        (
            "weight_kg",
            f"CASE WHEN {k} % 9 = 0 THEN NULL WHEN {k} % 13 = 0 THEN CAST(0 AS DOUBLE) "
            f"ELSE CAST(45 + {k} % 70 AS DOUBLE) END",
        ),
        (
            "allergies",
            f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE "
            f"{_case_index(f'{k} % 4', [_arr(dialect, [_q(a)]) for a in ALLERGIES])} END",
        ),
        (
            "chronic_conditions",
            f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE "
            f"{_case_index(f'{k} % 5', [_arr(dialect, [_q(CONDITIONS[i]), _q(CONDITIONS[(i + 2) % 5])]) for i in range(5)])} END",
        ),
        (
            "active_medications",
            f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE "
            f"{_case_index(f'{k} % 4', [_arr(dialect, [meds[i], meds[(i + 1) % 4]]) for i in range(4)])} END",
        ),
        ("hospital_id", f"'HOSP-' || lpad(CAST(c_nationkey AS STRING), 3, '0')"),
        ("ward", "c_mktsegment"),
        ("bed_number", f"CAST({k} % 50 AS STRING)"),
    ]


def patients_select_sql(dialect: str, source: str = "customer") -> str:
    cols = ",\n  ".join(f"{e} AS {n}" for n, e in patients_columns(dialect))
    return f"SELECT\n  {cols}\nFROM {source}"


def triage_event_columns() -> list[tuple[str, str]]:
    """Audit-row fields derived from an alert row (``event_seq`` = events.event_id)."""
    return [
        ("id", "event_seq"),
        ("recommendation_text", "'Triage ' || severity || ' for ' || patient_id"),
        ("confidence_score", "CAST(event_seq % 101 AS DOUBLE) / 100"),
        ("processing_ms", "CAST(1000 + event_seq * 7 % 29000 AS INT)"),
        ("llm_model_used", _q(FIXTURE_MODEL)),
        ("stripe_event_id", "CAST(NULL AS STRING)"),
        ("created_at", "timestamp_utc"),
    ]


def sops_select_sql(dialect: str) -> str:
    return (
        "SELECT d.doc_id AS id, substr(d.text, 1, 60) AS title, d.source AS category, "
        f"{_arr(dialect, ['d.lang'])} AS tags, d.text AS content, e.embedding AS embedding "
        "FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"
    )


def reply_text_sql(dialect: str) -> str:
    """Deterministic model reply per alert row (``event_seq``, severity, patient_id).

    Every 10th reply is truncated inside the action list, every 25th carries
    trailing text after the object, every 35th is not JSON at all.
    """
    urgency = (
        "CASE severity WHEN 'CRITICAL' THEN 'IMMEDIATE' WHEN 'HIGH' THEN 'URGENT' "
        "WHEN 'MEDIUM' THEN 'SEMI_URGENT' ELSE 'NON_URGENT' END"
    )
    n_actions = "CAST(2 + event_seq % 4 AS INT)"
    action = (
        "'{{\"priority\": ' || CAST({p} AS STRING) || ', \"action\": \"step {p}\", "
        "\"rationale\": \"per protocol\", \"time_window\": \"within {w} minutes\"}}'"
    )
    a1 = action.format(p=1, w=15)
    a2 = action.format(p=2, w=30)
    a3 = action.format(p=3, w=60)
    a4 = action.format(p=4, w=120)
    actions = (
        f"CASE {n_actions} WHEN 2 THEN {a1} || ', ' || {a2} "
        f"WHEN 3 THEN {a1} || ', ' || {a2} || ', ' || {a3} "
        f"WHEN 4 THEN {a1} || ', ' || {a2} || ', ' || {a3} || ', ' || {a4} "
        f"ELSE {a1} || ', ' || {a3} || ', ' || {a2} || ', ' || {a4} || ', ' || {a4} END"
    )
    full = (
        f"'{{\"urgency_level\": \"' || ({urgency}) || '\", "
        "\"clinical_summary\": \"Summary for ' || patient_id || '\", "
        "\"primary_concern\": \"' || severity || ' deterioration\", "
        f"\"recommended_actions\": [' || ({actions}) || '], "
        "\"contraindications\": [], "
        "\"confidence_score\": ' || CAST(CAST(event_seq % 100 AS DOUBLE) / 100 AS STRING) || '}'"
    )
    head = (
        f"'{{\"urgency_level\": \"' || ({urgency}) || '\", "
        "\"clinical_summary\": \"Summary for ' || patient_id || '\", "
        "\"primary_concern\": \"' || severity || ' deterioration\", "
        "\"confidence_score\": 0.5, "
        "\"recommended_actions\": [{\"priority\": 1, \"action\": \"x\"}, {\"priority\": 2, \"act'"
    )
    return (
        f"CASE WHEN event_seq % 35 = 0 THEN 'model unavailable' "
        f"WHEN event_seq % 10 = 0 THEN {head} "
        f"WHEN event_seq % 25 = 0 THEN {full} || ' -- end of reply' "
        f"ELSE {full} END"
    )


def request_log_select_sql(dialect: str, source: str = "events") -> str:
    """Request log rows ``(ts, method, path, status, duration_ms, client)`` from events.

    Every 50th request is a health check; every tenth comes from one client
    within the first minute of the month.
    """
    if dialect == SPARK:
        minute = "CAST(date_trunc('MONTH', ts) AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, CAST(event_id % 60 AS INT))"
    else:
        minute = "date_trunc('month', ts) + to_seconds(event_id % 60)"
    return (
        f"SELECT CASE WHEN event_id % 10 = 3 THEN {minute} ELSE ts END AS ts, 'GET' AS method, "
        "CASE WHEN event_id % 50 = 0 THEN '/health' ELSE '/' || event_type END AS path, "
        "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS duration_ms, "
        "CASE WHEN event_id % 10 = 3 THEN 'client-burst' ELSE 'client-' || lpad(CAST(user_id % 20 AS STRING), 2, '0') END AS client "
        f"FROM {source}"
    )


def kind_messages_select_sql(dialect: str, source: str = "events") -> str:
    """Messages ``(msg_offset, received_at, value)`` whose fields come as other JSON kinds than declared, a case for each eighth event."""
    case = lambda pairs, default: "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in pairs) + f" ELSE {_q(default)} END"
    rate = case([(1, '"120"'), (2, "120.0"), (3, "120.5"), (4, "true")], "120")
    fields = [
        ("patient_id", case([(5, "17")], '"pt-000017"')),
        ("hospital_id", case([(6, "5")], '"HOSP-005"')),
        ("ward", case([(7, '["A"]')], '"A"')),
        ("bed_number", case([(6, "12")], '"12"')),
        ("nursing_notes", case([(7, "null"), (5, "3.5")], '"calm"')),
    ]
    parts = ["'{'", *[x for n, v in fields for x in (_q(f'"{n}": '), v, _q(", "))]]
    vitals = "'\"vitals\": {\"heart_rate_bpm\": ' || " + rate + (
        " || ', \"systolic_bp_mmhg\": 118, \"diastolic_bp_mmhg\": 76, \"spo2_percent\": \"97.5\", "
        "\"respiratory_rate_rpm\": 15, \"temperature_celsius\": 36.9}}'"
    )
    return f"SELECT event_id AS msg_offset, ts AS received_at, {' || '.join(parts)} || {vitals} AS value FROM {source}"


def acks_select_sql(dialect: str, source: str = "events") -> str:
    """Per patient the last time a nurse viewed the record (``view`` events)."""
    return (
        "SELECT 'PT-' || lpad(CAST(user_id AS STRING), 6, '0') AS patient_id, max(ts) AS acked_at "
        f"FROM {source} WHERE event_type = 'view' GROUP BY user_id"
    )
