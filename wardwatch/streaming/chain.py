"""Two-topic chain and the live join (ST08, S02, P09, P10, ST06, J07, X30).

The first query turns telemetry into alerts and publishes them as keyed JSON;
the second reads that topic, checks every payload against the alert contract,
sets bad ones aside as dead letters and suppresses repeats; the third keeps
the cooldown and appends what is accepted to the audit table.  Each has a
checkpoint of its own, so each can be restarted alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch import schemas
from wardwatch.operators import rules as ru
from wardwatch.operators import validate as va
from wardwatch.operators.audit import stored
from wardwatch.streaming.alert_stream import audit_sink, scratch_checkpoint
from wardwatch.streaming.cooldown_state import drain_cooldown
from wardwatch.streaming.topic import consume, event_time, once_per_key, publish, with_end

DEAD_LETTER = "key string, error_preview string"


def read_alerts(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts, dead letters) of keyed messages; batch or stream. Tombstones vanish, a bad payload keeps its first 200 characters."""
    parsed = va.alert_parse(messages)
    alerts = parsed.where(F.col("alert").isNotNull()).select("alert.*")
    return alerts, parsed.where(F.col("error_preview").isNotNull()).select("key", "error_preview")


@dataclass
class Chain:
    """Folders of a chain: ``alerts`` (the topic), ``dead_letters``, ``clean`` (read once, checked) and ``accepted/table``."""

    at: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.at.rstrip('/')}/{name}"


def publish_alerts(alerts: DataFrame, chain: Chain) -> None:
    """First query: alerts of a stream to the topic, as JSON keyed by patient."""
    publish(ru.to_keyed_json(alerts), chain.alerts, chain.publish_checkpoint).awaitTermination()


def check_alerts(spark: SparkSession, chain: Chain, delay: str = "1 hour", files_per_batch: int | None = None) -> None:
    """Second query: the topic to checked alerts, each once, and to dead letters."""
    alerts, dead = read_alerts(consume(spark, chain.alerts, files_per_batch=files_per_batch))
    publish(once_per_key(alerts, delay=delay), chain.clean, chain.clean_checkpoint).awaitTermination()
    publish(dead, chain.dead_letters, chain.dead_checkpoint).awaitTermination()


def accept_alerts(spark: SparkSession, chain: Chain, cooldown_s: int = schemas.DEFAULT_COOLDOWN_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Third query: checked alerts through the cooldown into the audit table, to the end of the input."""
    return drain_cooldown(consume(spark, chain.clean, schemas.ALERT), cooldown_s, delay, chain.accepted)


def dead_letters(spark: SparkSession, chain: Chain) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    return stored(spark, chain.dead_letters, _parse_datatype_string(DEAD_LETTER))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from one time to the other."""
    return F.timestamp_diff("MILLISECOND", start, end)


def live_join(alerts: DataFrame, recommendations: DataFrame, within: str = "20 seconds", delay: str = "0 seconds") -> DataFrame:
    """J07 as a stream: each alert with the recommendation that came ``within`` the bound, if any.

    alert_id, patient_id, timestamp_utc, urgency_level, elapsed_ms, status.  A
    match comes out at once; an alert without one as ``processing``, as soon as
    the watermarks of both sides have passed the bound, which is also when its
    state goes.
    """
    a = alerts.select("alert_id", "patient_id", "timestamp_utc", event_time().alias("alert_time")).withWatermark("alert_time", delay)
    r = recommendations.select(F.col("alert_id").alias("rec_of"), "urgency_level", "generated_at", event_time("generated_at").alias("rec_time")).withWatermark("rec_time", delay)
    inside = F.expr(f"alert_id = rec_of AND rec_time >= alert_time AND rec_time <= alert_time + INTERVAL {within}")
    status = F.when(F.col("urgency_level").isNull(), "processing").otherwise("complete")
    elapsed = elapsed_ms(F.col("timestamp_utc"), F.col("generated_at"))
    return a.join(r, inside, "leftOuter").select("alert_id", "patient_id", "timestamp_utc", "urgency_level", elapsed.alias("elapsed_ms"), status.alias("status"))


def drain_live_join(alerts: DataFrame, recommendations: DataFrame, within: str = "20 seconds", delay: str = "0 seconds", at: str | None = None) -> DataFrame:
    """All rows of the live join to the end of both inputs, read back from an audit table."""
    spark = alerts.sparkSession
    at = at or scratch_checkpoint(spark, "live-join")
    a, end_alerts = with_end(alerts.select("alert_id", "patient_id", "timestamp_utc"), f"{at}/end-alerts", "timestamp_utc")
    r, end_recs = with_end(recommendations.select("alert_id", "urgency_level", "generated_at"), f"{at}/end-recs", "generated_at", alert_id="end of input")
    out = live_join(a, r, within, delay)
    audit_sink(out, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    end_alerts()
    end_recs()
    audit_sink(out, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return stored(spark, f"{at}/table", out.schema)
