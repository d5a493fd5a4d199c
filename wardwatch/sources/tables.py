"""Table access: parquet scans of the driver's tables and the derived domain tables.

Every reader is lazy; Catalyst prunes columns and pushes filters into the
parquet scan of whatever the caller finally selects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch import schemas
from wardwatch.operators.validate import parse_once
from wardwatch.sources import fixtures as fx

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", "events.parquet").load(sf_dir)


def _derive(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    # literal braces (JSON text) must not be taken for frame placeholders
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in frames:
        sql = sql.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(sql, **frames)


def telemetry_flat(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Typed bedside readings, one per ``events`` row (vitals flat)."""
    rows = table(spark, sf_dir, "events") if events is None else events
    # Columns of fx.telemetry_select_sql, step by step: in one projection the
    # generated method is larger than what the JVM compiles.
    rows = parse_once(parse_once(rows, F.expr(fx.profile_expr()), "prof"), F.expr(fx.vital_raw(1)), "sbp_raw")
    columns = dict(fx.telemetry_columns(fx.SPARK))
    for name in schemas.VITAL_NAMES:
        rows = parse_once(rows, F.expr(columns[name]), name)
    return rows.select(*[F.col(n) if n in schemas.VITAL_NAMES else F.expr(e).alias(n) for n, e in columns.items()])


def telemetry(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Typed readings in the declared ``TELEMETRY`` shape (+ ``event_seq``)."""
    flat = telemetry_flat(spark, sf_dir, events)
    return flat.select(
        "event_id",
        "event_seq",
        "patient_id",
        "hospital_id",
        "ward",
        "bed_number",
        "timestamp_utc",
        F.struct(*[F.col(n) for n in schemas.VITAL_NAMES]).alias("vitals"),
        "nursing_notes",
        "is_simulated",
    )


def raw_telemetry(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Kafka-shaped raw messages ``(offset, received_at, value)`` with JSON text."""
    return _derive(spark, fx.raw_telemetry_select_sql(fx.SPARK, "{events}"), events=table(spark, sf_dir, "events") if events is None else events)


def kind_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages whose fields come as other JSON kinds than declared."""
    return _derive(spark, fx.kind_messages_select_sql(fx.SPARK, "{events}"), events=table(spark, sf_dir, "events"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, fx.patients_select_sql(fx.SPARK, "{customer}"), customer=table(spark, sf_dir, "customer"))


def sops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All protocol documents; ``embedding`` is null where a document has no vector."""
    sql = fx.sops_select_sql(fx.SPARK).replace("FROM documents d LEFT JOIN embeddings e", "FROM {documents} d LEFT JOIN {embeddings} e")
    return _derive(
        spark, sql, documents=table(spark, sf_dir, "documents"), embeddings=table(spark, sf_dir, "embeddings")
    )


def triage_events_from_alerts(alerts: DataFrame) -> DataFrame:
    """Audit rows for a set of alerts (fixture: every alert was triaged)."""
    extra = [F.expr(e).alias(n) for n, e in fx.triage_event_columns()]
    return alerts.select(
        extra[0],
        "alert_id",
        "patient_id",
        "hospital_id",
        "severity",
        "triggered_rules",
        "vitals_snapshot",
        *extra[1:3],
        F.array().cast("array<struct<priority:int,action:string,rationale:string,time_window:string>>").alias(
            "recommended_actions"
        ),
        F.array().cast("array<string>").alias("sops_referenced"),
        *extra[3:],
    )


def model_replies(alerts: DataFrame) -> DataFrame:
    """Deterministic reply text per alert, standing in for an external model."""
    return alerts.select("alert_id", "event_seq", "patient_id", "hospital_id", "timestamp_utc", "severity", F.expr(fx.reply_text_sql(fx.SPARK)).alias("raw_reply"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, fx.request_log_select_sql(fx.SPARK, "{events}"), events=table(spark, sf_dir, "events"))


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, fx.acks_select_sql(fx.SPARK, "{events}"), events=table(spark, sf_dir, "events"))
