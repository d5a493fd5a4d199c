"""Independent DuckDB SQL for every registered query (the correctness oracle).

Fixture tables are produced by the shared derivation text of
``wardwatch.sources.fixtures``; every operator under test (validation, rules,
cooldown, joins, windows, retrieval, parsing ...) is re-written here in plain
SQL, independently of the Spark code.
"""

from __future__ import annotations

from wardwatch.sources import fixtures as fx

D = fx.DUCKDB

TEL = fx.telemetry_select_sql(D, "events")
RAW = fx.raw_telemetry_select_sql(D, "events")
PATIENTS = fx.patients_select_sql(D, "customer")
SOPS = fx.sops_select_sql(D)

VALID_WHERE = """
  heart_rate_bpm BETWEEN 20 AND 300 AND systolic_bp_mmhg BETWEEN 50 AND 260
  AND diastolic_bp_mmhg BETWEEN 30 AND 160 AND spo2_percent BETWEEN 50 AND 100
  AND respiratory_rate_rpm BETWEEN 4 AND 60 AND temperature_celsius BETWEEN 32 AND 43
  AND diastolic_bp_mmhg < systolic_bp_mmhg
  AND length(patient_id) BETWEEN 4 AND 32 AND upper(patient_id) LIKE 'PT-%'
  AND (nursing_notes IS NULL OR length(nursing_notes) <= 1000)
"""

RULE_FLAGS = """
  heart_rate_bpm > 100 AND systolic_bp_mmhg < 100 AND spo2_percent < 95.0 AS f8,
  (CASE WHEN temperature_celsius > 38.0 OR temperature_celsius < 36.0 THEN 1 ELSE 0 END
   + CASE WHEN heart_rate_bpm > 90 THEN 1 ELSE 0 END
   + CASE WHEN respiratory_rate_rpm > 20 THEN 1 ELSE 0 END) AS n9,
  heart_rate_bpm > 110 AS f1, heart_rate_bpm < 45 AS f2, spo2_percent < 94.0 AS f3,
  systolic_bp_mmhg < 90 AS f4, systolic_bp_mmhg > 180 AS f5, respiratory_rate_rpm > 22 AS f6,
  temperature_celsius > 38.3 AS f7
"""

RULE_TEXTS = """
  list_filter([
    CASE WHEN f8 THEN 'R8 SHOCK PATTERN: HR=' || heart_rate_bpm || ' bpm, SBP=' || systolic_bp_mmhg
         || ' mmHg, SpO2=' || CAST(spo2_percent AS VARCHAR) || '%' END,
    CASE WHEN n9 >= 2 THEN 'R9 SIRS (' || n9 || '/3 criteria): ' || concat_ws(', ',
         CASE WHEN temperature_celsius > 38.0 OR temperature_celsius < 36.0
              THEN 'Temp=' || CAST(temperature_celsius AS VARCHAR) || '°C' END,
         CASE WHEN heart_rate_bpm > 90 THEN 'HR=' || heart_rate_bpm || ' bpm' END,
         CASE WHEN respiratory_rate_rpm > 20 THEN 'RR=' || respiratory_rate_rpm || ' rpm' END) END,
    CASE WHEN f1 THEN 'R1 Tachycardia: HR=' || heart_rate_bpm || ' bpm (threshold >110)' END,
    CASE WHEN f2 THEN 'R2 Bradycardia: HR=' || heart_rate_bpm || ' bpm (threshold <45)' END,
    CASE WHEN f3 THEN 'R3 Hypoxia: SpO2=' || CAST(spo2_percent AS VARCHAR) || '% (threshold <94%)' END,
    CASE WHEN f4 THEN 'R4 Hypotension: SBP=' || systolic_bp_mmhg || ' mmHg (threshold <90)' END,
    CASE WHEN f5 THEN 'R5 Hypertensive Crisis: SBP=' || systolic_bp_mmhg || ' mmHg (threshold >180)' END,
    CASE WHEN f6 THEN 'R6 Tachypnea: RR=' || respiratory_rate_rpm || ' rpm (threshold >22)' END,
    CASE WHEN f7 THEN 'R7 Fever: Temp=' || CAST(temperature_celsius AS VARCHAR) || '°C (threshold >38.3)' END
  ], lambda x: x IS NOT NULL)
"""

# CTE chain: tel -> valid -> flagged -> alerts
ALERTS_CTE = f"""
tel AS ({TEL}),
valid AS (SELECT * FROM tel WHERE {VALID_WHERE}),
flagged AS (SELECT *, {RULE_FLAGS} FROM valid),
texted AS (SELECT *, {RULE_TEXTS} AS rules FROM flagged),
alerts AS (
  SELECT sha256('alert|' || event_id) AS alert_id, event_id AS source_event_id,
         upper(patient_id) AS patient_id, hospital_id, ward, bed_number, timestamp_utc,
         CASE WHEN f8 THEN 'CRITICAL' WHEN n9 >= 2 THEN 'HIGH' WHEN len(rules) >= 2 THEN 'HIGH'
              ELSE 'MEDIUM' END AS severity,
         rules AS triggered_rules, nursing_notes, event_seq,
         heart_rate_bpm, systolic_bp_mmhg, diastolic_bp_mmhg, spo2_percent,
         respiratory_rate_rpm, temperature_celsius
  FROM texted WHERE len(rules) > 0
)"""

TRIAGE_CTE = (
    ALERTS_CTE
    + """,
triage_events AS (
  SELECT event_seq AS id, alert_id, patient_id, hospital_id, severity, triggered_rules,
         'Triage ' || severity || ' for ' || patient_id AS recommendation_text,
         CAST(event_seq % 101 AS DOUBLE) / 100 AS confidence_score,
         CAST(1000 + event_seq * 7 % 29000 AS INT) AS processing_ms,
         timestamp_utc AS created_at
  FROM alerts
)"""
)

_VITALS = [
    ("heart_rate_bpm", True, 20, 300),
    ("systolic_bp_mmhg", True, 50, 260),
    ("diastolic_bp_mmhg", True, 30, 160),
    ("spo2_percent", False, 50, 100),
    ("respiratory_rate_rpm", True, 4, 60),
    ("temperature_celsius", False, 32, 43),
]


def _parsed_cte(raw: str = RAW) -> str:
    fields = ["event_id", "patient_id", "hospital_id", "ward", "bed_number", "timestamp_utc", "nursing_notes", "is_simulated"]
    ext = ",\n    ".join(f"CASE WHEN ok THEN json_extract_string(value, '$.{f}') END AS j_{f}" for f in fields)
    vit = ",\n    ".join(f"CASE WHEN ok THEN json_extract_string(value, '$.vitals.{n}') END AS t_{n}" for n, *_ in _VITALS)
    nums = ",\n    ".join(f"TRY_CAST(t_{n} AS DOUBLE) AS d_{n}" for n, *_ in _VITALS)
    has_v = "CASE WHEN ok THEN json_extract(value, '$.vitals') IS NOT NULL END AS has_vitals"
    reasons = [
        f"CASE WHEN ok AND json_type(value, '$.{f}') NOT IN ('VARCHAR', 'NULL') THEN 'not_text:{f}' END"
        for f in ["event_id", "patient_id", "hospital_id", "ward", "bed_number", "nursing_notes"]
    ]
    reasons.append("CASE WHEN NOT ok THEN 'malformed_json' END")
    for f in ["patient_id", "hospital_id", "ward", "bed_number"]:
        reasons.append(f"CASE WHEN ok AND j_{f} IS NULL THEN 'missing:{f}' END")
    reasons.append("CASE WHEN ok AND NOT has_vitals THEN 'missing:vitals' END")
    okv = []
    for n, is_int, lo, hi in _VITALS:
        present = f"(ok AND has_vitals AND t_{n} IS NOT NULL)"
        isnum = f"(d_{n} IS NOT NULL AND NOT isnan(d_{n}))"
        reasons.append(f"CASE WHEN ok AND has_vitals AND t_{n} IS NULL THEN 'missing:{n}' END")
        reasons.append(f"CASE WHEN {present} AND NOT {isnum} THEN 'not_a_number:{n}' END")
        typ = isnum
        if is_int:
            reasons.append(f"CASE WHEN {present} AND {isnum} AND floor(d_{n}) <> d_{n} THEN 'not_an_integer:{n}' END")
            typ = f"({isnum} AND floor(d_{n}) = d_{n})"
        reasons.append(f"CASE WHEN {present} AND {typ} AND NOT (d_{n} BETWEEN {lo} AND {hi}) THEN 'out_of_range:{n}' END")
        okv.append(f"({present} AND {typ} AND d_{n} BETWEEN {lo} AND {hi})")
    reasons.append(
        f"CASE WHEN {' AND '.join(okv)} AND d_diastolic_bp_mmhg >= d_systolic_bp_mmhg THEN 'diastolic_not_below_systolic' END"
    )
    reasons.append("CASE WHEN j_patient_id IS NOT NULL AND NOT (length(j_patient_id) BETWEEN 4 AND 32) THEN 'patient_id_length' END")
    reasons.append(
        "CASE WHEN j_patient_id IS NOT NULL AND length(j_patient_id) BETWEEN 4 AND 32 "
        "AND NOT starts_with(upper(j_patient_id), 'PT-') THEN 'patient_id_prefix' END"
    )
    reasons.append("CASE WHEN length(j_nursing_notes) > 1000 THEN 'nursing_notes_too_long' END")
    reasons.append("CASE WHEN j_timestamp_utc IS NOT NULL AND TRY_CAST(j_timestamp_utc AS TIMESTAMP) IS NULL THEN 'bad_timestamp' END")
    reasons.append(
        "CASE WHEN j_is_simulated IS NOT NULL AND lower(j_is_simulated) NOT IN ('true','1','false','0') "
        "THEN 'bad_boolean:is_simulated' END"
    )
    rlist = ",\n      ".join(reasons)
    return f"""
raw AS ({raw}),
j AS (SELECT msg_offset, received_at, value, json_valid(value) AS ok FROM raw WHERE value IS NOT NULL),
x AS (SELECT *,
    {ext},
    {vit},
    {has_v}
  FROM j),
n AS (SELECT *, {nums} FROM x),
checked AS (SELECT *, list_filter([
      {rlist}
    ], lambda r: r IS NOT NULL) AS reasons FROM n)"""


PARSED_CTE = _parsed_cte()


def _w(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def cooldown_cte(seconds: int) -> str:
    """Greedy cooldown as a recursive walk over 'next alert at least C later' pointers."""
    return (
        ALERTS_CTE
        + f""",
a AS (SELECT alert_id, patient_id, timestamp_utc, epoch_us(timestamp_utc) AS t,
             epoch_us(timestamp_utc) + CAST({seconds} AS BIGINT) * 1000000 AS tc FROM alerts),
nx AS (SELECT a1.alert_id, a2.alert_id AS next_id
       FROM a a1 ASOF LEFT JOIN a a2 ON a1.patient_id = a2.patient_id AND a1.tc <= a2.t),
firsts AS (SELECT arg_min(alert_id, t) AS alert_id FROM a GROUP BY patient_id),
chain AS (
  SELECT nx.alert_id, nx.next_id FROM firsts JOIN nx USING (alert_id)
  UNION ALL
  SELECT nx.alert_id, nx.next_id FROM chain c JOIN nx ON nx.alert_id = c.next_id
),
accepted AS (SELECT a.* FROM a JOIN chain USING (alert_id))"""
    )


AGE_SQL = (
    "CAST(year({on}) - year({born}) - CASE WHEN month({on}) * 100 + day({on}) "
    "< month({born}) * 100 + day({born}) THEN 1 ELSE 0 END AS INT)"
)
MEDS_SQL = (
    "array_to_string(list_transform(coalesce({m}, []), "
    "lambda x: coalesce(x['name'], '?') || ' ' || coalesce(x['dose'], '')), ', ')"
)
REPORT_CTE = TRIAGE_CTE + f""",
patients AS ({PATIENTS}),
ref_time AS (SELECT max(ts) AS as_of FROM events)"""
SUMMARY_COLS = """id, alert_id, patient_id, severity, CAST(NULL AS VARCHAR) AS urgency_level, recommendation_text,
       CASE WHEN confidence_score <> 0 THEN confidence_score END AS confidence_score, processing_ms, created_at"""


def _patient_list(where: str) -> str:
    return _w(
        REPORT_CTE,
        f"""SELECT p.patient_id, p.full_name, {AGE_SQL.format(on='CAST(a.as_of AS DATE)', born='p.date_of_birth')} AS age_years,
       p.gender, p.ward, p.bed_number,
       array_to_string(coalesce(p.chronic_conditions, []), ', ') AS conditions,
       {MEDS_SQL.format(m='p.active_medications')} AS medications,
       count(t.id) AS recent_alert_count
FROM patients p CROSS JOIN ref_time a
LEFT JOIN triage_events t ON t.patient_id = p.patient_id AND t.created_at > a.as_of - INTERVAL 24 HOURS
WHERE {where}
GROUP BY ALL""",
    )


# Fixed values, written out here too so that a change on the other side shows: words that are not searched for.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they "
    "this to was will with"
).split()


def _stop_list() -> str:
    return "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _tokens(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), "
        f"lambda t: length(t) > 0 AND NOT list_contains({_stop_list()}, t))"
    )


# The head of every prompt, written out here too.
PROMPT_HEAD = """Propose the next steps for the bedside alert described by these fields.
Answer with one JSON object only, no other text, with the keys urgency_level (IMMEDIATE, URGENT, SEMI_URGENT or NON_URGENT), clinical_summary, primary_concern, recommended_actions (3 to 5 objects with priority 1-5, action, rationale, time_window, most urgent first), contraindications (list of text), sops_referenced (list of titles) and confidence_score (0.0 to 1.0). A CRITICAL alert requires urgency IMMEDIATE or URGENT.
"""

QUERY_TEXT = """lower(severity) || ' care for ' || array_to_string(triggered_rules, ' and ')
       || '; pulse ' || heart_rate_bpm || '; systolic ' || systolic_bp_mmhg || '; diastolic ' || diastolic_bp_mmhg
       || '; oxygen ' || CAST(spo2_percent AS VARCHAR) || '; breathing ' || respiratory_rate_rpm
       || '; temperature ' || CAST(temperature_celsius AS VARCHAR)"""

FUSED_SQL = """u AS (SELECT query_id, doc_id, rank AS v_rank, CAST(NULL AS BIGINT) AS k_rank FROM vh
      UNION ALL SELECT query_id, doc_id, NULL, rank FROM kw),
g AS (SELECT query_id, doc_id, sum(1.0 / (60 + coalesce(v_rank, k_rank))) AS rrf,
             min(v_rank) AS v_rank, min(k_rank) AS k_rank FROM u GROUP BY query_id, doc_id),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY round(rrf, 9) DESC, v_rank ASC NULLS LAST, k_rank) AS rank FROM g)"""

BM25_CTE = f"""sops AS ({SOPS}),
dt AS (SELECT doc_id, term, count(*) AS tf FROM (
         SELECT id AS doc_id, unnest({_tokens("title || ' ' || content")}) AS term FROM sops) GROUP BY doc_id, term),
dl AS (SELECT doc_id, sum(tf) AS dl FROM dt GROUP BY doc_id),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
dfreq AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
w AS (SELECT dt.doc_id, dt.term,
        ln(1 + (st.n_docs - dfreq.df + 0.5) / (dfreq.df + 0.5)) * dt.tf * 2.2
        / (dt.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl)) AS w
      FROM dt JOIN dfreq USING (term) JOIN dl USING (doc_id) CROSS JOIN st)"""


def _keyword_sql(query_src: str, all_terms: bool, k: int = 5) -> str:
    cond = "WHERE sc.matched = nq.n_terms" if all_terms else ""
    return f"""qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({_tokens("text")}) AS term FROM ({query_src}))),
nq AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY query_id),
sc AS (SELECT qt.query_id, w.doc_id, sum(w.w) AS score, count(*) AS matched FROM qt JOIN w USING (term)
       GROUP BY qt.query_id, w.doc_id),
kr AS (SELECT sc.query_id, sc.doc_id, sc.score,
         row_number() OVER (PARTITION BY sc.query_id ORDER BY round(sc.score, 9) DESC, sc.doc_id) AS rank
       FROM sc JOIN nq USING (query_id) {cond}),
kw AS (SELECT * FROM kr WHERE rank <= {k})"""


def _vector_sql(query_src: str, k: int = 5) -> str:
    return f"""vs AS (SELECT q.query_id, s.id AS doc_id,
         list_cosine_similarity(CAST(q.vec AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) AS score
       FROM ({query_src}) q CROSS JOIN sops s),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
       FROM vs WHERE score IS NOT NULL AND NOT isnan(score)),
vh AS (SELECT * FROM vr WHERE rank <= {k})"""


REPLY_CTE = (
    ALERTS_CTE
    + f""",
rep AS (SELECT alert_id, severity, {fx.reply_text_sql(D)} AS raw FROM alerts),
r1 AS (SELECT *, raw IS NOT NULL AND json_valid(raw) AND starts_with(trim(raw), '{{')
                 AND ends_with(trim(raw), '}}') AS first_ok,
              regexp_extract(raw, '(?s)^(.*\\}})', 1) AS cut FROM rep),
r2 AS (SELECT *, CASE WHEN NOT first_ok AND raw IS NOT NULL AND cut <> '' THEN
                   cut || CASE WHEN length(cut) - length(replace(cut, '{{', '')) > length(cut) - length(replace(cut, '}}', ''))
                               THEN '}}' ELSE '' END END AS fixed FROM r1),
r3 AS (SELECT *, fixed IS NOT NULL AND json_valid(fixed) AND starts_with(trim(fixed), '{{')
                 AND ends_with(trim(fixed), '}}') AS second_ok FROM r2),
r4 AS (SELECT *, CASE WHEN first_ok THEN raw WHEN second_ok THEN fixed END AS pj FROM r3),
r5 AS (SELECT *,
         json_extract_string(pj, '$.urgency_level') AS urgency_level,
         json_extract_string(pj, '$.clinical_summary') AS clinical_summary,
         json_extract_string(pj, '$.primary_concern') AS primary_concern,
         from_json(json_extract(pj, '$.recommended_actions'),
           '[{{"priority":"INTEGER","action":"VARCHAR","rationale":"VARCHAR","time_window":"VARCHAR"}}]') AS actions,
         TRY_CAST(json_extract_string(pj, '$.confidence_score') AS DOUBLE) AS confidence_score FROM r4),
r6 AS (SELECT *, CASE
         WHEN raw IS NULL THEN 'reply_not_json'
         WHEN NOT first_ok AND fixed IS NULL THEN 'reply_not_closed'
         WHEN pj IS NULL THEN 'reply_not_json'
         WHEN urgency_level IS NULL THEN 'missing required key: urgency_level'
         WHEN clinical_summary IS NULL THEN 'missing required key: clinical_summary'
         WHEN primary_concern IS NULL THEN 'missing required key: primary_concern'
         WHEN actions IS NULL THEN 'missing required key: recommended_actions'
         WHEN confidence_score IS NULL THEN 'missing required key: confidence_score'
         WHEN urgency_level NOT IN ('IMMEDIATE', 'URGENT', 'SEMI_URGENT', 'NON_URGENT') THEN 'invalid value: urgency_level'
         WHEN NOT (confidence_score BETWEEN 0 AND 1) THEN 'invalid value: confidence_score'
         WHEN len(list_filter(actions, lambda a: a.priority IS NULL OR NOT (a.priority BETWEEN 1 AND 5)
              OR a.action IS NULL OR a.rationale IS NULL OR a.time_window IS NULL)) > 0
              THEN 'invalid value: recommended_actions'
         END AS llm_error FROM r5)"""
)


LIVE_CTE = REPLY_CTE + """,
recs AS (SELECT alert_id, urgency_level, confidence_score FROM r6 WHERE llm_error IS NULL)"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    # the feed and the live views start from the accepted alerts
    taken = "WITH RECURSIVE " + cooldown_cte(60)
    shown = "shown AS (SELECT l.* FROM alerts l JOIN accepted USING (alert_id))"
    answered = taken + LIVE_CTE[len(ALERTS_CTE):] + ",\n" + shown
    q["feed_envelope"] = answered + """
SELECT 'alert_received' AS event_type, alert_id AS key, timestamp_utc AS timestamp FROM shown
UNION ALL
SELECT 'triage_recommendation', r.alert_id, s.timestamp_utc FROM recs r JOIN shown s USING (alert_id)"""
    q["feed_demux"] = taken + ",\n" + shown + """
SELECT alert_id, patient_id, severity, timestamp_utc, array_to_string(triggered_rules, ' | ') AS rules_text,
       spo2_percent FROM shown"""
    q["live_feed_join"] = answered + """
SELECT s.alert_id, CASE WHEN r.urgency_level IS NULL THEN 'processing' ELSE 'complete' END AS status,
       r.urgency_level FROM shown s LEFT JOIN recs r USING (alert_id)"""
    display = """
SELECT alert_id, patient_id, timestamp_utc,
       array_to_string(list_transform(triggered_rules, lambda r: split_part(r, ':', 1)), ', ') AS rule_labels,
       substr('[' || severity || '] ' || patient_id || ' @ ' || ward || '/' || bed_number || ' — '
              || array_to_string(triggered_rules, ', '), 1, 60) || '...' AS summary_short
FROM shown """
    newest = "QUALIFY row_number() OVER (ORDER BY timestamp_utc DESC, alert_id DESC) <= 50"
    q["live_feed_top50"] = taken + ",\n" + shown + display + newest
    q["live_feed_patient"] = taken + ",\n" + shown + display + "WHERE patient_id = 'PT-000007' " + newest
    q["stream_live_top50"] = taken + "\nSELECT alert_id, patient_id, timestamp_utc FROM accepted " + newest
    q["live_counts_after_ack"] = q["stream_live_counts"] = (
        taken + f", acks AS ({fx.acks_select_sql(D)}), patients AS ({PATIENTS})" + """
SELECT patient_id, live_count, CASE WHEN live_count > 0 THEN 'red' ELSE 'green' END AS status
FROM (SELECT p.patient_id, count(s.alert_id) FILTER (WHERE k.acked_at IS NULL OR s.timestamp_utc > k.acked_at) AS live_count
      FROM patients p LEFT JOIN accepted s USING (patient_id) LEFT JOIN acks k USING (patient_id) GROUP BY p.patient_id)"""
    )
    q["ward_roster"] = _w(
        f"patients AS ({PATIENTS})",
        "SELECT ward, bed_number, patient_id, full_name, count(*) OVER (PARTITION BY ward) AS n_in_ward FROM patients",
    )
    q["feed_display"] = _w(
        LIVE_CTE + TRIAGE_CTE[len(ALERTS_CTE):],
        """SELECT t.alert_id,
       CAST(round(t.confidence_score * 100, 0) AS BIGINT) || '%' AS confidence_text,
       CAST(floor((t.processing_ms + 50) / 100) AS BIGINT) // 10 || '.'
         || CAST(floor((t.processing_ms + 50) / 100) AS BIGINT) % 10 || 's' AS processing_text,
       replace(r.urgency_level, '_', '-') AS urgency_text
FROM triage_events t LEFT JOIN recs r USING (alert_id)""",
    )
    q["request_log_rollup"] = _w(
        f"log AS ({fx.request_log_select_sql(D)})",
        """SELECT path, status, count(*) AS n_requests, round(avg(duration_ms), 3) AS avg_ms, max(duration_ms) AS max_ms,
       quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms
FROM log WHERE path <> '/health' GROUP BY path, status""",
    )
    q["request_rate_breach"] = _w(
        f"log AS ({fx.request_log_select_sql(D)})",
        """SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, client, count(*) AS n_requests
FROM log GROUP BY 1, 2 HAVING count(*) > 60""",
    )
    stream_valid = PARSED_CTE + """,
valid AS (SELECT coalesce(j_event_id, 'offset-' || msg_offset) AS event_id, upper(j_patient_id) AS patient_id,
       coalesce(TRY_CAST(j_timestamp_utc AS TIMESTAMP), received_at) AS timestamp_utc,
       CAST(d_heart_rate_bpm AS INT) AS heart_rate_bpm, CAST(d_systolic_bp_mmhg AS INT) AS systolic_bp_mmhg,
       CAST(d_diastolic_bp_mmhg AS INT) AS diastolic_bp_mmhg, d_spo2_percent AS spo2_percent,
       CAST(d_respiratory_rate_rpm AS INT) AS respiratory_rate_rpm, d_temperature_celsius AS temperature_celsius
  FROM checked WHERE len(reasons) = 0),
flagged AS (SELECT *, """ + RULE_FLAGS + """ FROM valid),
texted AS (SELECT *, """ + RULE_TEXTS + """ AS rules FROM flagged),
alerts AS (SELECT sha256('alert|' || event_id) AS alert_id, patient_id, timestamp_utc FROM texted WHERE len(rules) > 0),
a AS (SELECT alert_id, patient_id, timestamp_utc, epoch_us(timestamp_utc) AS t,
             epoch_us(timestamp_utc) + CAST(60 AS BIGINT) * 1000000 AS tc FROM alerts),
nx AS (SELECT a1.alert_id, a2.alert_id AS next_id
       FROM a a1 ASOF LEFT JOIN a a2 ON a1.patient_id = a2.patient_id AND a1.tc <= a2.t),
firsts AS (SELECT arg_min(alert_id, t) AS alert_id FROM a GROUP BY patient_id),
chain AS (
  SELECT nx.alert_id, nx.next_id FROM firsts JOIN nx USING (alert_id)
  UNION ALL
  SELECT nx.alert_id, nx.next_id FROM chain c JOIN nx ON nx.alert_id = c.next_id
)"""
    q["stream_cooldown"] = "WITH RECURSIVE " + stream_valid + """
SELECT a.alert_id, a.patient_id, a.timestamp_utc FROM a JOIN chain USING (alert_id)"""
    def lit(x: str) -> str:
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    def line(name: str, value: str) -> str:
        return f"'{name}=' || coalesce(nullif(CAST({value} AS VARCHAR), ''), '?') || chr(10)"

    meds = MEDS_SQL.format(m="p.active_medications")
    person = " || ".join([
        line("allergic_to", "array_to_string(p.allergies, ', ')"),
        line("takes", meds),
        line("conditions", "array_to_string(p.chronic_conditions, ', ')"),
        line("alerts_past_day", """(SELECT count(*) FROM triage_events t WHERE t.patient_id = a.patient_id
            AND t.created_at > a.timestamp_utc - INTERVAL 24 HOURS AND t.created_at < a.timestamp_utc)"""),
        line("age", AGE_SQL.format(on="CAST(a.timestamp_utc AS DATE)", born="p.date_of_birth")),
        line("sex", "p.gender"),
        line("weight_kg", "CASE WHEN p.weight_kg <> 0 THEN p.weight_kg END"),
        line("blood", "p.blood_type"),
        line("name", "p.full_name"),
    ])
    bedside = " || ".join([
        "array_to_string(list_transform(a.triggered_rules, lambda r: 'fired=' || r || chr(10)), '')",
        line("severity", "a.severity"),
        line("temp_c", "a.temperature_celsius"),
        line("resp_per_min", "a.respiratory_rate_rpm"),
        line("spo2_pct", "a.spo2_percent"),
        line("pulse_per_min", "a.heart_rate_bpm"),
        line("pressure_mmhg", "a.systolic_bp_mmhg || ' over ' || a.diastolic_bp_mmhg"),
        line("nurse_wrote", "a.nursing_notes"),
        line("bed", "a.bed_number || ' in ' || a.ward"),
        line("patient_id", "a.patient_id"),
    ])
    def prompt_sql(protocols: str) -> str:
        return f"""{lit(PROMPT_HEAD)} || {protocols}
  || CASE WHEN p.patient_id IS NULL THEN 'record=missing' || chr(10) ELSE {person} END || {bedside}"""

    prompt = prompt_sql("'protocol=none' || chr(10)")
    block = "'protocol=' || f.rank || '/' || s.category || '/' || s.title || chr(10) || '<<<' || chr(10) || s.content || chr(10) || '>>>' || chr(10)"
    q["prompt_with_documents"] = (
        "WITH RECURSIVE "
        + cooldown_cte(60)
        + REPORT_CTE[len(ALERTS_CTE):]
        + f""",
qa AS (SELECT l.alert_id AS query_id, l.event_seq, {QUERY_TEXT} AS text FROM accepted x JOIN alerts l USING (alert_id)),
"""
        + BM25_CTE + ",\n"
        + _vector_sql("SELECT qa.query_id, e.embedding AS vec FROM qa JOIN embeddings e ON e.vec_id = qa.event_seq % (SELECT count(*) FROM embeddings)") + ",\n"
        + _keyword_sql("SELECT query_id, text FROM qa", False) + ",\n"
        + FUSED_SQL
        + f""",
docs AS (SELECT f.query_id, count(*) AS n, string_agg({block}, '' ORDER BY f.rank) AS body
         FROM f JOIN sops s ON s.id = f.doc_id WHERE f.rank <= 3 GROUP BY f.query_id)
SELECT alert_id, n_documents, CAST(length(prompt) AS BIGINT) AS prompt_length, sha256(prompt) AS prompt_sha256 FROM (
  SELECT a.alert_id, d.n AS n_documents, {prompt_sql("coalesce(d.body, 'protocol=none' || chr(10))")} AS prompt
  FROM accepted x JOIN alerts a USING (alert_id) LEFT JOIN patients p ON p.patient_id = a.patient_id LEFT JOIN docs d ON d.query_id = a.alert_id)"""
    )
    q["triage_recommendations"] = (
        "WITH RECURSIVE "
        + cooldown_cte(60)
        + REPLY_CTE[len(ALERTS_CTE):]
        + """
SELECT r.alert_id, l.patient_id, r.urgency_level, r.confidence_score, CAST(len(r.actions) AS BIGINT) AS n_actions
FROM r6 r JOIN accepted USING (alert_id) JOIN alerts l USING (alert_id) WHERE r.llm_error IS NULL"""
    )
    q["vector_index_recall"] = _w(
        f"sops AS ({SOPS}), " + _vector_sql("SELECT vec_id AS query_id, embedding AS vec FROM embeddings"),
        "SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_exact, true AS reaches_90_percent FROM vh",
    )
    q["prompt_text"] = _w(
        REPORT_CTE,
        f"""SELECT alert_id, CAST(length(prompt) AS BIGINT) AS prompt_length, sha256(prompt) AS prompt_sha256 FROM (
  SELECT a.alert_id, {prompt} AS prompt
  FROM alerts a LEFT JOIN patients p ON p.patient_id = a.patient_id)""",
    )
    q["stream_alerts"] = _w(
        PARSED_CTE + """,
valid AS (SELECT coalesce(j_event_id, 'offset-' || msg_offset) AS event_id, upper(j_patient_id) AS patient_id,
       coalesce(TRY_CAST(j_timestamp_utc AS TIMESTAMP), received_at) AS timestamp_utc,
       CAST(d_heart_rate_bpm AS INT) AS heart_rate_bpm, CAST(d_systolic_bp_mmhg AS INT) AS systolic_bp_mmhg,
       CAST(d_diastolic_bp_mmhg AS INT) AS diastolic_bp_mmhg, d_spo2_percent AS spo2_percent,
       CAST(d_respiratory_rate_rpm AS INT) AS respiratory_rate_rpm, d_temperature_celsius AS temperature_celsius
  FROM checked WHERE len(reasons) = 0),
flagged AS (SELECT *, """ + RULE_FLAGS + """ FROM valid),
texted AS (SELECT *, """ + RULE_TEXTS + """ AS rules FROM flagged)""",
        """SELECT sha256('alert|' || event_id) AS alert_id, patient_id,
       CASE WHEN f8 THEN 'CRITICAL' WHEN n9 >= 2 THEN 'HIGH' WHEN len(rules) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       timestamp_utc
FROM texted WHERE len(rules) > 0""",
    )
    q["reply_repair"] = _w(
        REPLY_CTE,
        """SELECT alert_id, CASE WHEN cut <> '' THEN cut || CASE WHEN length(cut) - length(replace(cut, '{', ''))
       > length(cut) - length(replace(cut, '}', '')) THEN '}' ELSE '' END END AS repaired_text FROM r1""",
    )
    q["reply_parse"] = _w(
        REPLY_CTE,
        """SELECT alert_id, (NOT first_ok AND second_ok) AS repaired, llm_error,
       CASE WHEN llm_error IS NULL THEN urgency_level END AS urgency_level,
       CASE WHEN llm_error IS NULL THEN CAST(len(actions) AS BIGINT) END AS n_actions,
       CASE WHEN llm_error IS NULL THEN confidence_score END AS confidence_score
FROM r6""",
    )
    q["reply_policy"] = _w(
        REPLY_CTE,
        """SELECT alert_id, len(actions) BETWEEN 3 AND 5 AS actions_count_ok,
       list_sort(list_transform(actions, lambda a: a.priority)) = list_transform(actions, lambda a: a.priority)
         AS actions_ordered_ok,
       (severity <> 'CRITICAL' OR urgency_level IN ('IMMEDIATE', 'URGENT')) AS urgency_ok
FROM r6 WHERE llm_error IS NULL""",
    )
    q["audit_insert_if_absent"] = _w(
        REPORT_CTE,
        """SELECT DISTINCT b.id, b.alert_id, b.patient_id, b.severity
FROM (SELECT * FROM triage_events UNION ALL SELECT * FROM triage_events) b
WHERE NOT EXISTS (SELECT 1 FROM triage_events s
                  WHERE s.created_at < TIMESTAMP '2024-01-15 00:00:00' AND s.alert_id = b.alert_id)""",
    )
    q["corpus_incremental_load"] = _w(
        f"""sops AS ({SOPS}),
docs AS (SELECT s.id, s.title, s.category, s.content, d.lang FROM sops s JOIN documents d ON d.doc_id = s.id),
firsts AS (SELECT min(id) AS id FROM docs GROUP BY content)""",
        """SELECT d.id, d.title, d.category FROM docs d JOIN firsts USING (id)
WHERE NOT EXISTS (SELECT 1 FROM docs e WHERE e.lang = 'en' AND e.content IS NOT DISTINCT FROM d.content)""",
    )
    q["retrieval_query_text"] = _w(
        ALERTS_CTE,
        f"SELECT alert_id, {QUERY_TEXT} AS query_text FROM alerts",
    )
    q["keyword_terms"] = _w(
        ALERTS_CTE,
        """SELECT alert_id, array_to_string(list_filter(flatten(list_transform(triggered_rules,
         lambda r: regexp_split_to_array(r, '\\s+'))), lambda x: length(x) > 4), ' | ') AS terms FROM alerts""",
    )
    q["vector_top5"] = _w(
        f"sops AS ({SOPS}), " + _vector_sql("SELECT vec_id AS query_id, embedding AS vec FROM embeddings"),
        "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM vh",
    )
    for mode, flag in (("any", False), ("all", True)):
        q[f"keyword_top5_{mode}"] = _w(
            BM25_CTE + ",\n" + _keyword_sql("SELECT item_id AS query_id, text FROM benchmark", flag),
            "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM kw",
        )
    q["rrf_top3"] = _w(
        BM25_CTE + ",\n"
        + _vector_sql("SELECT id AS query_id, embedding AS vec FROM sops WHERE embedding IS NOT NULL") + ",\n"
        + _keyword_sql("SELECT id AS query_id, title || ' ' || content AS text FROM sops WHERE embedding IS NOT NULL", False)
        + ",\n" + FUSED_SQL,
        """SELECT query_id, doc_id, rank, round(rrf, 6) AS relevance_score,
       CASE WHEN v_rank IS NOT NULL AND k_rank IS NOT NULL THEN 'hybrid'
            WHEN v_rank IS NOT NULL THEN 'vector' ELSE 'keyword' END AS retrieval_method
FROM f WHERE rank <= 3""",
    )
    q["patient_list"] = _patient_list("1 = 1")
    q["patient_list_filtered"] = _patient_list("p.hospital_id = 'HOSP-001' AND p.ward = 'BUILDING'")
    q["patient_history"] = _w(
        REPORT_CTE,
        f"SELECT {SUMMARY_COLS} FROM triage_events WHERE patient_id = upper('pt-000007') "
        "ORDER BY created_at DESC, id DESC LIMIT 10",
    )
    q["recent_feed_page"] = _w(
        REPORT_CTE,
        f"SELECT {SUMMARY_COLS} FROM triage_events WHERE severity = upper('critical') "
        "ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20",
    )
    q["recent_feed_total"] = _w(REPORT_CTE, "SELECT count(*) AS total FROM triage_events WHERE severity = upper('critical')")
    q["dashboard_stats"] = _w(
        REPORT_CTE,
        """SELECT 'last_24_hours' AS period, count(*) AS total_events,
       count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count,
       count(*) FILTER (WHERE severity = 'HIGH') AS high_count,
       count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_count,
       coalesce(round(avg(confidence_score), 3), 0) AS avg_confidence,
       CAST(coalesce(round(avg(processing_ms), 0), 0) AS BIGINT) AS avg_processing_ms,
       count(DISTINCT patient_id) AS patients_triaged
FROM triage_events, ref_time WHERE created_at > as_of - INTERVAL 24 HOURS""",
    )
    q["stream_dashboard_stats"] = q["dashboard_stats"]
    q["billing_by_hospital_day"] = _w(
        REPORT_CTE,
        """SELECT hospital_id, CAST(created_at AS DATE) AS day, count(DISTINCT alert_id) AS units,
       round(CAST(count(DISTINCT alert_id) AS DOUBLE) * 0.05, 2) AS amount
FROM triage_events GROUP BY hospital_id, CAST(created_at AS DATE)""",
    )
    ctx_body = f"""SELECT a.alert_id, a.patient_id, p.full_name,
       {AGE_SQL.format(on='CAST(a.timestamp_utc AS DATE)', born='p.date_of_birth')} AS age_years,
       p.gender, p.blood_type, CASE WHEN p.weight_kg <> 0 THEN p.weight_kg END AS weight_kg,
       CASE WHEN p.patient_id IS NOT NULL THEN array_to_string(coalesce(p.allergies, []), ', ') END AS allergies,
       CASE WHEN p.patient_id IS NOT NULL THEN array_to_string(coalesce(p.chronic_conditions, []), ', ') END AS conditions,
       CASE WHEN p.patient_id IS NOT NULL THEN {MEDS_SQL.format(m='p.active_medications')} END AS medications,
       CASE WHEN p.patient_id IS NOT NULL THEN (SELECT count(*) FROM triage_events t WHERE t.patient_id = a.patient_id
            AND t.created_at > a.timestamp_utc - INTERVAL 24 HOURS AND t.created_at < a.timestamp_utc) END
            AS recent_triage_count,
       CASE WHEN p.patient_id IS NULL THEN 'unknown_patient:' || a.patient_id END
            AS context_fetch_error
FROM alerts a LEFT JOIN patients p ON p.patient_id = a.patient_id"""
    q["alert_patient_context"] = _w(REPORT_CTE, ctx_body)
    q["context_misses"] = _w(
        REPORT_CTE + f", ctx AS ({ctx_body})",
        "SELECT count(*) AS n_alerts, count(context_fetch_error) AS n_missing FROM ctx",
    )
    q["trailing_24h_count"] = _w(
        REPORT_CTE,
        """SELECT a.alert_id, a.patient_id, count(t.id) AS recent_count
FROM alerts a LEFT JOIN triage_events t ON t.patient_id = a.patient_id
  AND t.created_at > a.timestamp_utc - INTERVAL 24 HOURS AND t.created_at < a.timestamp_utc
GROUP BY a.alert_id, a.patient_id""",
    )
    q["patient_age"] = _w(
        f"patients AS ({PATIENTS}), ref_time AS (SELECT max(ts) AS as_of FROM events)",
        f"SELECT patient_id, date_of_birth, {AGE_SQL.format(on='CAST(as_of AS DATE)', born='date_of_birth')} AS age_years "
        "FROM patients, ref_time",
    )
    q["cooldown_60s"] = "WITH RECURSIVE " + cooldown_cte(60) + "\nSELECT alert_id, patient_id, timestamp_utc FROM accepted"
    q["cooldown_12h"] = "WITH RECURSIVE " + cooldown_cte(43200) + "\nSELECT alert_id, patient_id, timestamp_utc FROM accepted"
    q["cooldown_skipped"] = (
        "WITH RECURSIVE "
        + cooldown_cte(60)
        + """
SELECT a.patient_id, count(*) AS n_alerts, count(acc.alert_id) AS n_accepted,
       count(*) - count(acc.alert_id) AS n_skipped
FROM a LEFT JOIN accepted acc USING (alert_id) GROUP BY a.patient_id"""
    )
    q["cooldown_runs"] = _w(
        ALERTS_CTE
        + """,
g AS (SELECT patient_id, timestamp_utc AS t,
             epoch_us(timestamp_utc) - lag(epoch_us(timestamp_utc)) OVER (PARTITION BY patient_id ORDER BY timestamp_utc) AS gap FROM alerts),
r AS (SELECT *, count(*) FILTER (gap IS NULL OR gap >= 43200000000) OVER (PARTITION BY patient_id ORDER BY t) AS run FROM g)""",
        """SELECT patient_id, min(t) AS run_start, max(t) AS run_end, count(*) AS n_alerts FROM r GROUP BY patient_id, run""",
    )
    q["stream_triage_chain"] = (
        "WITH RECURSIVE "
        + cooldown_cte(60)
        + """
SELECT 'accepted' AS kind, alert_id, patient_id, timestamp_utc, CAST(NULL AS VARCHAR) AS error_preview FROM accepted
UNION ALL
SELECT 'dead_letter', NULL, patient_id, NULL, '{"alert_id":"' || alert_id || '","source_eve' FROM alerts WHERE event_seq % 53 = 0"""
    )
    q["stream_dedup"] = _w(ALERTS_CTE, "SELECT alert_id, patient_id, severity, timestamp_utc FROM alerts")
    q["stream_live_join"] = (
        "WITH RECURSIVE "
        + cooldown_cte(60)
        + LIVE_CTE[len(ALERTS_CTE):]
        + """
SELECT a.alert_id, a.patient_id, a.timestamp_utc, r.urgency_level,
       CASE WHEN r.alert_id IS NOT NULL THEN CAST(1000 + l.event_seq * 7 % 29000 AS BIGINT) END AS elapsed_ms,
       CASE WHEN r.alert_id IS NULL THEN 'processing' ELSE 'complete' END AS status
FROM accepted a JOIN alerts l USING (alert_id)
LEFT JOIN recs r ON r.alert_id = a.alert_id AND 1000 + l.event_seq * 7 % 29000 <= 20000"""
    )
    q["alert_json"] = _w(
        ALERTS_CTE,
        """SELECT CAST(11 AS BIGINT) AS n_keys, patient_id AS key, alert_id, source_event_id, patient_id,
       strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp_utc, severity, nursing_notes,
       heart_rate_bpm, temperature_celsius, triggered_rules[1] AS first_rule FROM alerts""",
    )
    q["alerts_by_own_rules"] = _w(
        f"tel AS ({TEL}), valid AS (SELECT * FROM tel WHERE {VALID_WHERE})" + """,
own AS (SELECT sha256('alert|' || event_id) AS alert_id, spo2_percent < 96.0 AND respiratory_rate_rpm > 18 AS n2,
       systolic_bp_mmhg > 185 OR diastolic_bp_mmhg > 110 AS n3, heart_rate_bpm > 95 AS n1, * FROM valid),
said AS (SELECT *, list_filter([
    CASE WHEN n2 THEN 'N2 airway: ' || CAST(spo2_percent AS VARCHAR) || '/' || respiratory_rate_rpm END,
    CASE WHEN n3 THEN 'N3 pressure (' || ((systolic_bp_mmhg > 185)::INT + (diastolic_bp_mmhg > 110)::INT) || '): '
      || concat_ws(', ', CASE WHEN systolic_bp_mmhg > 185 THEN 'sys ' || systolic_bp_mmhg END, CASE WHEN diastolic_bp_mmhg > 110 THEN 'dia ' || diastolic_bp_mmhg END) END,
    CASE WHEN n1 THEN 'N1 fast: ' || heart_rate_bpm END], lambda x: x IS NOT NULL) AS rules FROM own)""",
        """SELECT alert_id, CASE WHEN n3 THEN 'CRITICAL' WHEN n2 THEN 'LOW' WHEN len(rules) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       array_to_string(rules, ' | ') AS rules_text FROM said WHERE len(rules) > 0""",
    )
    q["lax_coercion"] = _w(
        _parsed_cte(fx.kind_messages_select_sql(D, "events")),
        """SELECT msg_offset, array_to_string(reasons, ' ') AS reasons,
       CASE WHEN floor(d_heart_rate_bpm) = d_heart_rate_bpm THEN CAST(d_heart_rate_bpm AS INT) END AS heart_rate_bpm,
       d_spo2_percent AS spo2_percent FROM checked""",
    )
    q["patient_id_normalised"] = _w(
        PARSED_CTE, "SELECT upper(j_patient_id) AS patient_id, count(*) AS n_readings FROM checked WHERE len(reasons) = 0 GROUP BY 1"
    )
    q["embedding_input"] = _w(
        f"sops AS ({SOPS}), t AS (SELECT id, title || chr(10) || regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS text FROM sops)",
        "SELECT id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM t",
    )
    q["pipeline_counters"] = "WITH RECURSIVE " + stream_valid + """,
c AS (SELECT (SELECT count(*) FROM checked) AS processed, (SELECT count(*) FROM checked WHERE len(reasons) > 0) AS rejected,
             (SELECT count(*) FROM alerts) AS published, (SELECT count(*) FROM chain) AS accepted)
SELECT 'processed' AS counter, processed AS n FROM c UNION ALL SELECT 'rejected', rejected FROM c
UNION ALL SELECT 'published', published FROM c UNION ALL SELECT 'skipped', published - accepted FROM c UNION ALL SELECT 'errors', 0"""
    q["telemetry_valid"] = _w(
        f"tel AS ({TEL})",
        f"""SELECT event_id, upper(patient_id) AS patient_id, timestamp_utc, heart_rate_bpm, systolic_bp_mmhg,
       diastolic_bp_mmhg, spo2_percent, respiratory_rate_rpm, temperature_celsius
FROM tel WHERE {VALID_WHERE}""",
    )
    q["telemetry_parsed"] = _w(
        PARSED_CTE,
        """SELECT coalesce(j_event_id, 'offset-' || msg_offset) AS event_id, upper(j_patient_id) AS patient_id,
       j_hospital_id AS hospital_id, j_ward AS ward, j_bed_number AS bed_number,
       coalesce(TRY_CAST(j_timestamp_utc AS TIMESTAMP), received_at) AS timestamp_utc,
       CAST(d_heart_rate_bpm AS INT) AS heart_rate_bpm, CAST(d_systolic_bp_mmhg AS INT) AS systolic_bp_mmhg,
       CAST(d_diastolic_bp_mmhg AS INT) AS diastolic_bp_mmhg, d_spo2_percent AS spo2_percent,
       CAST(d_respiratory_rate_rpm AS INT) AS respiratory_rate_rpm, d_temperature_celsius AS temperature_celsius,
       j_nursing_notes AS nursing_notes,
       coalesce(lower(j_is_simulated) IN ('true', '1'), false) AS is_simulated
FROM checked WHERE len(reasons) = 0""",
    )
    q["telemetry_rejects_by_reason"] = _w(
        PARSED_CTE,
        """SELECT reason, count(*) AS n_rejected FROM (SELECT unnest(reasons) AS reason FROM checked) GROUP BY reason""",
    )
    q["rule_hits"] = _w(
        f"tel AS ({TEL}), valid AS (SELECT * FROM tel WHERE {VALID_WHERE}), flagged AS (SELECT {RULE_FLAGS} FROM valid)",
        """SELECT rule_id, hits FROM (
  SELECT 'R8' AS rule_id, count_if(f8) AS hits FROM flagged UNION ALL
  SELECT 'R9', count_if(n9 >= 2) FROM flagged UNION ALL
  SELECT 'R1', count_if(f1) FROM flagged UNION ALL SELECT 'R2', count_if(f2) FROM flagged UNION ALL
  SELECT 'R3', count_if(f3) FROM flagged UNION ALL SELECT 'R4', count_if(f4) FROM flagged UNION ALL
  SELECT 'R5', count_if(f5) FROM flagged UNION ALL SELECT 'R6', count_if(f6) FROM flagged UNION ALL
  SELECT 'R7', count_if(f7) FROM flagged)""",
    )
    q["alerts"] = _w(
        ALERTS_CTE,
        """SELECT alert_id, source_event_id, patient_id, hospital_id, ward, bed_number, timestamp_utc, severity,
       array_to_string(triggered_rules, ' | ') AS rules_text, CAST(len(triggered_rules) AS BIGINT) AS n_rules
FROM alerts""",
    )
    q["alerts_by_severity"] = _w(ALERTS_CTE, "SELECT severity, count(*) AS n_alerts FROM alerts GROUP BY severity")
    q["alerts_by_ward"] = _w(
        ALERTS_CTE,
        "SELECT hospital_id, ward, severity, count(*) AS n_alerts, count(DISTINCT patient_id) AS n_patients "
        "FROM alerts GROUP BY hospital_id, ward, severity",
    )
    q["alert_summary"] = _w(
        ALERTS_CTE,
        """SELECT alert_id, '[' || severity || '] ' || patient_id || ' @ ' || ward || '/' || bed_number || ' — '
       || array_to_string(triggered_rules, ', ') AS summary FROM alerts""",
    )
    q["rule_labels"] = _w(
        ALERTS_CTE,
        """SELECT alert_id, array_to_string(list_transform(triggered_rules, lambda r: split_part(r, ':', 1)), ',') AS labels
FROM alerts""",
    )
    return q
