"""Live dashboard feed as table/stream operators (S10, U01, U02, J07, T07, A09, A10, A15, X24-X27, ST10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_JSON_OPTS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def envelope(df: DataFrame, event_type: str, ts_col: str, key_col: str = "alert_id") -> DataFrame:
    """``(event_type, key, payload JSON, timestamp)`` for one record type."""
    return df.select(
        F.lit(event_type).alias("event_type"),
        F.col(key_col).alias("key"),
        F.to_json(F.struct(*df.columns), _JSON_OPTS).alias("payload"),
        F.col(ts_col).alias("timestamp"),
    )


def feed(alerts: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Alerts and recommendations merged into one tagged feed."""
    return envelope(alerts, "alert_received", "timestamp_utc").unionByName(
        envelope(recommendations, "triage_recommendation", "generated_at")
    )


def demux(feed_df: DataFrame, event_type: str, schema: T.StructType) -> DataFrame:
    """One record type back out of the feed; unknown tags and bad payloads are ignored."""
    parsed = feed_df.where(F.col("event_type") == event_type).select(
        F.from_json("payload", schema).alias("r")
    )
    return parsed.where(F.col("r").isNotNull()).select("r.*")


def feed_status(alerts: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Each alert with its recommendation if any; ``processing`` until one arrives."""
    recs = recommendations.select("alert_id", "urgency_level", "confidence_score").hint("merge")  # as many as alerts: never through the driver
    j = alerts.join(recs, "alert_id", "left")
    return j.withColumn("status", F.when(F.col("urgency_level").isNull(), "processing").otherwise("complete"))


def latest(alerts: DataFrame, n: int = 50, patient_id: str | None = None, ts_col: str = "timestamp_utc") -> DataFrame:
    """Newest ``n`` alerts (optionally one patient); a top-k, not a full sort."""
    a = alerts.where(F.col("patient_id") == patient_id) if patient_id else alerts
    return a.orderBy(F.desc(ts_col), F.desc("alert_id")).limit(n)


def display_columns(df: DataFrame) -> DataFrame:
    """Dashboard text columns."""
    from wardwatch.functions.text import short_rule_labels

    out = df
    if "triggered_rules" in df.columns:
        out = out.withColumn("rule_labels", F.array_join(short_rule_labels(F.col("triggered_rules")), ", "))
    if "summary" in df.columns:
        out = out.withColumn("summary_short", F.concat(F.substring("summary", 1, 60), F.lit("...")))
    if "confidence_score" in df.columns:
        pct = F.round(F.col("confidence_score") * 100, 0).cast("bigint")
        out = out.withColumn("confidence_text", F.concat(pct.cast("string"), F.lit("%")))
    if "processing_ms" in df.columns:
        tenths = F.floor((F.col("processing_ms") + 50) / 100).cast("bigint")  # half-up on exact milliseconds
        out = out.withColumn(
            "processing_text",
            F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("s")),
        )
    if "urgency_level" in df.columns:
        out = out.withColumn("urgency_text", F.replace(F.col("urgency_level"), F.lit("_"), F.lit("-")))
    return out


def live_counts(alerts: DataFrame, acks: DataFrame, patients: DataFrame) -> DataFrame:
    """Per patient of ``patients`` the alerts since the last acknowledgement; red when > 0.

    A patient without alerts has 0; an alert of an unknown patient counts
    nowhere.  ``acks(patient_id, acked_at)`` has one row per patient.  Alerts
    are counted before they meet the patients, and the acknowledgement is
    compared there: per patient and time first, so the joins carry counts.
    """
    hits = alerts.groupBy("patient_id", "timestamp_utc").agg(F.count(F.lit(1)).alias("_n"))
    new = hits.join(acks, "patient_id", "left").where(
        F.col("acked_at").isNull() | (F.col("timestamp_utc") > F.col("acked_at"))
    )
    counts = new.groupBy("patient_id").agg(F.sum("_n").alias("_live"))
    live = F.coalesce("_live", F.lit(0)).cast("bigint")
    return patients.select("patient_id").join(counts, "patient_id", "left").select(
        "patient_id", live.alias("live_count"), F.when(live > 0, "red").otherwise("green").alias("status")
    )


def ward_roster(patients: DataFrame) -> DataFrame:
    """A10: the patients of each ward, with the ward's size; order by ward and bed to show them.

    The size is joined from a partial aggregate, so a ward that holds a third
    of all patients is not brought into one task.
    """
    sizes = patients.groupBy("ward").agg(F.count(F.lit(1)).alias("n_in_ward"))
    listed = patients.select("ward", "bed_number", "patient_id", "full_name")
    return listed.join(sizes.withColumnRenamed("ward", "_w"), F.col("ward").eqNullSafe(F.col("_w"))).drop("_w")


def request_log_rollup(log: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Requests per path and status with latency figures; health checks excluded.

    ``p50_ms`` and ``p95_ms`` come from a mergeable quantile sketch, whose rank
    error is one in ``accuracy`` (none in groups of fewer rows).
    """
    return (
        log.where(F.col("path") != "/health")
        .groupBy("path", "status")
        .agg(
            F.count(F.lit(1)).alias("n_requests"),
            F.round(F.avg("duration_ms"), 3).alias("avg_ms"),
            F.max("duration_ms").alias("max_ms"),
            F.approx_percentile("duration_ms", [0.5, 0.95], accuracy).alias("_p"),
        )
        .select("path", "status", "n_requests", "avg_ms", "max_ms", F.col("_p")[0].alias("p50_ms"), F.col("_p")[1].alias("p95_ms"))
    )


def rate_breaches(log: DataFrame, limit_per_minute: int = 60) -> DataFrame:
    """ST10: clients above the request limit in a one-minute tumbling window."""
    return (
        log.groupBy(F.window("ts", "1 minute").alias("w"), "client")
        .agg(F.count(F.lit(1)).alias("n_requests"))
        .where(F.col("n_requests") > limit_per_minute)
        .select(F.col("w.start").alias("window_start"), "client", "n_requests")
    )

