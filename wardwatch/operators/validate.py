"""Parse and validate telemetry.

``parse_telemetry`` turns raw JSON messages into a row with every declared
field as text; ``validate_telemetry`` adds typed columns and an array of
rejection reasons; ``split_valid`` yields the typed valid rows and the
dead-letter rows.  Everything is one projection: no shuffle, whole-stage
codegen, identical on batch and streaming inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch import schemas

# --- FIXED VALUES: rejection reason codes ----------------------------------
MALFORMED = "malformed_json"
MISSING = "missing:"  # + field name
NOT_A_NUMBER = "not_a_number:"  # + vital
NOT_AN_INTEGER = "not_an_integer:"  # + vital
OUT_OF_RANGE = "out_of_range:"  # + vital
BP_ORDER = "diastolic_not_below_systolic"
PATIENT_ID_LENGTH = "patient_id_length"
PATIENT_ID_PREFIX = "patient_id_prefix"
NOTES_TOO_LONG = "nursing_notes_too_long"
BAD_TIMESTAMP = "bad_timestamp"
BAD_BOOLEAN = "bad_boolean:is_simulated"
NOT_TEXT = "not_text:"  # + field

NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
REQUIRED_TEXT_FIELDS = ["patient_id", "hospital_id", "ward", "bed_number"]


def parse_once(df: DataFrame, parsed: Column, name: str) -> DataFrame:
    """Add ``parsed`` as column ``name``, evaluated exactly once per row.

    Validation references the parsed struct dozens of times and ends in a
    filter; Catalyst would push that filter through a plain projection and
    inline the parser into every reference (and the JSON optimizer would then
    split it per field).  A one-element ``explode`` is a Generate node: the
    parser runs once per row and predicates on its output stay above it.
    """
    return df.select("*", F.explode(F.array(parsed)).alias(name))


def parse_telemetry(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Tombstones dropped, JSON parsed into ``_msg``: numbers as text, texts as VARIANT, which tells 5 from "5"."""
    # a null payload parses to null (dropped as a tombstone); a malformed one
    # to a struct carrying the corrupt record.  Filtering on the parsed column
    # keeps the predicate above the parse barrier.
    parsed = parse_once(
        raw,
        F.from_json(
            F.col(value_col).cast("string"),
            schemas.RAW_TELEMETRY,
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
        ),
        "_msg",
    )
    return parsed.where(F.col("_msg").isNotNull())


def _reason(cond: Column, code: str) -> Column:
    return F.when(cond, F.lit(code))


def validate_telemetry(
    parsed: DataFrame,
    offset_col: str = "msg_offset",
    received_col: str = "received_at",
) -> DataFrame:
    """P02-P08 over ``parse_telemetry`` output.

    Adds the typed telemetry columns plus ``rejection_reasons``
    (``array<string>``, empty for a valid row).  Defaults: ``event_id`` is
    ``offset-<offset>``, led by topic and partition where the input has the
    columns ``msg_topic`` and ``msg_partition`` (an offset alone is unique in
    one partition only), ``timestamp_utc`` the broker receive time,
    ``is_simulated`` false.

    Staged projections (texts -> numbers -> groups of reasons) so that every
    cast is computed once per row.  Each group of reasons is a step of its own,
    joined as text in generated code (a lambda over an array is interpreted),
    so that no generated method grows beyond what the JVM compiles.
    """
    m = F.col("_msg")
    stage1 = parsed.select(
        "*",
        (m.isNull() | m["_corrupt_record"].isNotNull()).alias("_bad_json"),
        m["vitals"].isNotNull().alias("_has_vitals"),
        *[m["vitals"][n].alias(f"_t_{n}") for n in schemas.VITAL_NAMES],
        *[F.try_variant_get(m[f], "$", "string").alias(f"_j_{f}") for f in schemas.TEXT_FIELDS],
        *[F.schema_of_variant(m[f]).alias(f"_k_{f}") for f in schemas.TEXT_FIELDS],
        *[m[f].alias(f"_j_{f}") for f in ["timestamp_utc", "is_simulated"]],
    )
    stage2 = stage1.select(
        "*",
        # the pattern keeps out what a cast takes beside plain numbers ("120d", "120f", "Infinity")
        *[
            F.when(F.col(f"_t_{n}").rlike(NUMBER_TEXT), F.expr(f"try_cast(_t_{n} AS DOUBLE)")).alias(f"_d_{n}")
            for n in schemas.VITAL_NAMES
        ],
        F.expr("try_cast(try_cast(_j_timestamp_utc AS TIMESTAMP) AS TIMESTAMP_NTZ)").alias("_ts"),
        F.lower("_j_is_simulated").alias("_sim"),
    )

    place = [c for c in ("msg_topic", "msg_partition") if c in parsed.columns]
    default_id = F.concat(F.lit("offset-"), *[x for c in place for x in (F.col(c).cast("string"), F.lit("-"))],
                          F.col(offset_col).cast("string"))

    bad = F.col("_bad_json")
    has_v = F.col("_has_vitals")
    # numbers may come as texts, but texts not as numbers
    groups: list[list[Column]] = [[]]
    reasons = groups[0]
    reasons += [_reason(~bad & ~F.col(f"_k_{f}").isin("STRING", "VOID"), NOT_TEXT + f) for f in schemas.TEXT_FIELDS]
    reasons.append(_reason(bad, MALFORMED))
    for f in REQUIRED_TEXT_FIELDS:
        reasons.append(_reason(~bad & F.col(f"_j_{f}").isNull(), MISSING + f))
    reasons.append(_reason(~bad & ~has_v, MISSING + "vitals"))

    typed_vitals: dict[str, Column] = {}
    field_ok: list[Column] = []
    for place, (name, kind, lo, hi) in enumerate(schemas.VITAL_BOUNDS):
        if place % 2 == 0:
            groups.append(reasons := [])
        txt, num = F.col(f"_t_{name}"), F.col(f"_d_{name}")
        present = ~bad & has_v & txt.isNotNull()
        is_num = num.isNotNull() & ~F.isnan(num)
        reasons.append(_reason(~bad & has_v & txt.isNull(), MISSING + name))
        reasons.append(_reason(present & ~is_num, NOT_A_NUMBER + name))
        if kind == "int":
            integral = F.floor(num) == num
            reasons.append(_reason(present & is_num & ~integral, NOT_AN_INTEGER + name))
            ok_type = is_num & integral
            value = F.when(ok_type & (F.abs(num) < 2147483648.0), num.cast("int"))
        else:
            ok_type = is_num
            value = F.when(ok_type, num)
        in_range = (num >= F.lit(lo)) & (num <= F.lit(hi))
        reasons.append(_reason(present & ok_type & ~in_range, OUT_OF_RANGE + name))
        typed_vitals[name] = value
        field_ok.append(present & ok_type & in_range)

    all_vitals_ok = field_ok[0]
    for c in field_ok[1:]:
        all_vitals_ok = all_vitals_ok & c
    # the cross-field rule runs only when every vital passed its own checks
    groups.append(reasons := [])
    reasons.append(_reason(all_vitals_ok & (F.col("_d_diastolic_bp_mmhg") >= F.col("_d_systolic_bp_mmhg")), BP_ORDER))

    pid = F.col("_j_patient_id")
    pid_len_ok = F.length(pid).between(schemas.PATIENT_ID_MIN_LEN, schemas.PATIENT_ID_MAX_LEN)
    reasons.append(_reason(pid.isNotNull() & ~pid_len_ok, PATIENT_ID_LENGTH))
    reasons.append(
        _reason(pid.isNotNull() & pid_len_ok & ~F.upper(pid).startswith(schemas.PATIENT_ID_PREFIX), PATIENT_ID_PREFIX)
    )
    notes = F.col("_j_nursing_notes")
    reasons.append(_reason(F.length(notes) > schemas.NURSING_NOTES_MAX_LEN, NOTES_TOO_LONG))
    reasons.append(_reason(F.col("_j_timestamp_utc").isNotNull() & F.col("_ts").isNull(), BAD_TIMESTAMP))
    sim_txt = F.col("_sim")
    sim_val = F.when(sim_txt.isin("true", "1"), True).when(sim_txt.isin("false", "0"), False)
    reasons.append(_reason(sim_txt.isNotNull() & sim_val.isNull(), BAD_BOOLEAN))

    for i, group in enumerate(groups):
        stage2 = parse_once(stage2, F.nullif(F.concat_ws(" ", *group), F.lit("")), f"_reasons_{i}")
    joined = F.concat_ws(" ", *[f"_reasons_{i}" for i in range(len(groups))])
    listed = F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))
    out = stage2.select(
        *parsed.columns,
        F.coalesce(F.col("_j_event_id"), default_id).alias("event_id"),
        F.upper(pid).alias("patient_id"),
        F.col("_j_hospital_id").alias("hospital_id"),
        F.col("_j_ward").alias("ward"),
        F.col("_j_bed_number").alias("bed_number"),
        F.coalesce(F.col("_ts"), F.col(received_col).cast("timestamp_ntz")).alias("timestamp_utc"),
        F.named_struct(*[x for n in schemas.VITAL_NAMES for x in (F.lit(n), typed_vitals[n])]).alias("vitals"),
        notes.alias("nursing_notes"),
        F.coalesce(sim_val, F.lit(False)).alias("is_simulated"),
        # barrier: filters on the reasons must not be inlined into the stages below
        F.explode(F.array(listed)).alias("rejection_reasons"),
    )
    return out


def check_typed(telemetry: DataFrame) -> DataFrame:
    """P03-P05, P07 for already typed rows; adds ``rejection_reasons`` and upper-cases the id."""
    v = F.col("vitals")
    reasons: list[Column] = []
    for name, _kind, lo, hi in schemas.VITAL_BOUNDS:
        reasons.append(_reason(v[name].isNull(), MISSING + name))
        reasons.append(_reason(~v[name].between(lo, hi), OUT_OF_RANGE + name))
    all_ok = None
    for name, _kind, lo, hi in schemas.VITAL_BOUNDS:
        c = v[name].between(lo, hi)
        all_ok = c if all_ok is None else all_ok & c
    reasons.append(_reason(all_ok & (v["diastolic_bp_mmhg"] >= v["systolic_bp_mmhg"]), BP_ORDER))
    pid = F.col("patient_id")
    pid_len_ok = F.length(pid).between(schemas.PATIENT_ID_MIN_LEN, schemas.PATIENT_ID_MAX_LEN)
    reasons.append(_reason(~pid_len_ok, PATIENT_ID_LENGTH))
    reasons.append(_reason(pid_len_ok & ~F.upper(pid).startswith(schemas.PATIENT_ID_PREFIX), PATIENT_ID_PREFIX))
    for f in REQUIRED_TEXT_FIELDS[1:]:
        reasons.append(_reason(F.col(f).isNull(), MISSING + f))
    reasons.append(_reason(F.length("nursing_notes") > schemas.NURSING_NOTES_MAX_LEN, NOTES_TOO_LONG))
    # as in validate_telemetry: groups joined as text, since a lambda over an array is interpreted
    groups = [reasons[i:i + 6] for i in range(0, len(reasons), 6)]
    names = [f"_reasons_{i}" for i in range(len(groups))]
    checked = telemetry.withColumn("patient_id", F.upper(pid))
    for name, group in zip(names, groups):
        checked = parse_once(checked, F.concat_ws(" ", *group), name)
    joined = F.concat_ws(" ", *[F.nullif(F.col(n), F.lit("")) for n in names])
    listed = F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))
    return parse_once(checked, listed, "rejection_reasons").drop(*names)


TELEMETRY_COLUMNS = [f.name for f in schemas.TELEMETRY.fields]


def split_valid(checked: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid typed rows, dead-letter rows with reasons)."""
    keep = keep or [c for c in checked.columns if c in TELEMETRY_COLUMNS or c == "event_seq"]
    ok = F.size("rejection_reasons") == 0
    valid = checked.where(ok).select(*keep)
    rejects = checked.where(~ok).drop("_msg")
    return valid, rejects


def valid_telemetry(telemetry: DataFrame) -> DataFrame:
    """Typed rows that pass every check (fixture path)."""
    valid, _ = split_valid(check_typed(telemetry), keep=telemetry.columns)
    return valid


def rejects_by_reason(rejects: DataFrame) -> DataFrame:
    """Dead-letter counts per reason (a row with two reasons counts under both)."""
    return (
        rejects.select(F.explode("rejection_reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n_rejected"))
    )


def alert_parse(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Alert messages re-validated against the alert contract.

    Adds ``alert`` (struct, null when invalid) and ``error_preview`` (first
    200 chars of an unparseable payload).
    """
    parsed = parse_once(
        raw.where(F.col(value_col).isNotNull()),
        F.from_json(F.col(value_col).cast("string"), schemas.ALERT, {"mode": "PERMISSIVE"}),
        "_a",
    )
    a = F.col("_a")
    ok = (
        a.isNotNull()
        & a["alert_id"].isNotNull()
        & a["patient_id"].isNotNull()
        & a["severity"].isin(*schemas.SEVERITIES)
        & a["triggered_rules"].isNotNull()
        & a["vitals_snapshot"].isNotNull()
        & a["timestamp_utc"].isNotNull()
    )
    return parsed.select(
        "*",
        F.when(ok, a).alias("alert"),
        F.when(~ok, F.substring(F.col(value_col).cast("string"), 1, 200)).alias("error_preview"),
    ).drop("_a")
