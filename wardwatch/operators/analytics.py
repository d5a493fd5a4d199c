"""Reporting queries over the audit and patient tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch import schemas
from wardwatch.operators.context import age_years, empty_if_null, null_if_zero


def _since(as_of: Column, hours: int = 24) -> Column:
    return as_of - F.expr(f"INTERVAL {hours} HOURS")


def _bind(df: DataFrame, as_of: Column) -> DataFrame:
    """Evaluate ``as_of`` (often a scalar subquery) once per input instead of once per reference."""
    return df.withColumn("_as_of", as_of)


def _trailing(triage_events: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """the events of the trailing window; of a table partitioned by ``audit_day`` only its days are read."""
    if "audit_day" in triage_events.columns:
        triage_events = triage_events.where(F.col("audit_day") >= F.to_date(_since(as_of, hours)))
    return _bind(triage_events, as_of).where(F.col("created_at") > _since(F.col("_as_of"), hours))


def recent_counts(triage_events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """``COUNT(id)`` per patient over the trailing window (pre-aggregated before the join)."""
    return (
        _trailing(triage_events, as_of, hours)
        .groupBy("patient_id")
        .agg(F.count("id").alias("recent_alert_count"))
    )


def patient_list(
    patients: DataFrame,
    triage_events: DataFrame,
    as_of: Column,
    hospital_id: str | None = None,
    ward: str | None = None,
) -> DataFrame:
    """Every (filtered) patient with its trailing alert count, by ward and bed."""
    p = patients
    if hospital_id:
        p = p.where(F.col("hospital_id") == hospital_id)
    if ward:
        p = p.where(F.col("ward") == ward)
    j = _bind(p, F.to_date(as_of)).join(recent_counts(triage_events, as_of), "patient_id", "left")
    return j.select(
        "patient_id",
        "full_name",
        age_years(F.col("date_of_birth"), F.col("_as_of")).alias("age_years"),
        "gender",
        "ward",
        "bed_number",
        empty_if_null(F.col("chronic_conditions")).alias("chronic_conditions"),
        empty_if_null(F.col("active_medications"), "map<string,string>").alias("active_medications"),
        F.coalesce(F.col("recent_alert_count"), F.lit(0)).cast("bigint").alias("recent_alert_count"),
    ).orderBy("ward", "bed_number", "patient_id")


def event_summary(triage_events: DataFrame) -> DataFrame:
    """The 9-field history/feed row; urgency is never stored (null), zero confidence -> null."""
    return triage_events.select(
        "id",
        "alert_id",
        "patient_id",
        "severity",
        F.lit(None).cast("string").alias("urgency_level"),
        "recommendation_text",
        null_if_zero(F.col("confidence_score")).alias("confidence_score"),
        "processing_ms",
        "created_at",
    )


#: Most rows that one page or history may ask for.
MAX_PAGE = 100


def _check_range(name: str, value: int, low: int, high: int | None = None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else ""))


def patient_history(triage_events: DataFrame, patient_id: str, limit: int = 10) -> DataFrame:
    """Newest ``limit`` events of one patient; ``id`` breaks ties. Raises outside 1..100."""
    _check_range("limit", limit, 1, MAX_PAGE)
    rows = triage_events.where(F.col("patient_id") == F.upper(F.lit(patient_id)))
    return event_summary(rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit))


def _feed_filter(triage_events: DataFrame, severity: str | None) -> DataFrame:
    if severity:
        return triage_events.where(F.col("severity") == F.upper(F.lit(severity)))
    return triage_events


def _newest_days(rows: DataFrame, wanted: int) -> DataFrame:
    """The newest days of a table partitioned by ``audit_day`` that hold ``wanted`` rows; one count per day reaches the driver."""
    found = 0
    for day, n in rows.groupBy("audit_day").count().orderBy(F.col("audit_day").desc_nulls_last()).toLocalIterator():
        found += n
        if found >= wanted:
            return rows if day is None else rows.where(F.col("audit_day") >= F.lit(day))
    return rows


def recent_feed(triage_events: DataFrame, page: int = 1, page_size: int = 20, severity: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(page of items newest first, one-row total). Raises for a page below 1 or a size outside 1..100."""
    _check_range("page", page, 1)
    _check_range("page_size", page_size, 1, MAX_PAGE)
    rows = _feed_filter(triage_events, severity)
    days = rows if "audit_day" not in rows.columns else _newest_days(rows, page * page_size)
    items = event_summary(
        days.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * page_size).limit(page_size)
    )
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return items, total


def dashboard_stats(triage_events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """One row of trailing-window counters; one aggregation pass."""
    t = _trailing(triage_events, as_of, hours)
    sev = F.col("severity")
    return t.agg(
        F.lit(schemas.DASHBOARD_PERIOD).alias("period"),
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(sev == "CRITICAL").alias("critical_count"),
        F.count_if(sev == "HIGH").alias("high_count"),
        F.count_if(sev == "MEDIUM").alias("medium_count"),
        F.coalesce(F.round(F.avg("confidence_score"), 3), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.round(F.avg("processing_ms"), 0), F.lit(0.0)).cast("bigint").alias("avg_processing_ms"),
        F.count_distinct("patient_id").alias("patients_triaged"),
    )


def billing_rollup(triage_events: DataFrame, price: float = schemas.PRICE_PER_TRIAGE) -> DataFrame:
    """One billable unit per distinct stored alert, per hospital and day."""
    return (
        triage_events.groupBy("hospital_id", F.to_date("created_at").alias("day"))
        .agg(F.count_distinct("alert_id").alias("units"))
        .withColumn("amount", F.round(F.col("units") * F.lit(price), 2))
    )

