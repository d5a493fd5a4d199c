"""Structured Streaming entry points (S01-S03, ST01, ST05, ST08, UD1-UD3).

The batch operators are plain ``DataFrame -> DataFrame`` functions, so the
stream job is the same chain on a ``readStream`` input: parse -> validate ->
rules -> keyed JSON -> sink, one stage without shuffles.  Exactly-once
delivery comes from the checkpoint plus idempotent sinks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardwatch.operators import rules as ru
from wardwatch.operators import validate as va
from wardwatch.operators.audit import append_audit, stored
from wardwatch.session import ensure_checkpoint_dir
from wardwatch.streaming.counters import counted


def telemetry_to_alerts(raw: DataFrame, rules: tuple = ru.DEFAULT_RULES) -> tuple[DataFrame, DataFrame]:
    """Raw ``(msg_offset, received_at, value)`` rows -> (alerts, dead letters); batch or stream."""
    checked = va.validate_telemetry(va.parse_telemetry(raw))
    valid, rejects = va.split_valid(checked)
    return ru.detect_alerts(valid, rules), rejects


def counted_alerts(raw: DataFrame, rules: tuple = ru.DEFAULT_RULES) -> DataFrame:
    """The alerts of raw messages, with the counts ``telemetry.processed``, ``telemetry.rejected`` and ``alerts.published``."""
    checked = va.validate_telemetry(va.parse_telemetry(raw))
    checked = counted(checked, "telemetry", processed=F.lit(True), rejected=F.size("rejection_reasons") > 0)
    valid, _ = va.split_valid(checked)
    return counted(ru.detect_alerts(valid, rules), "alerts", published=F.lit(True))


def kafka_messages(rows: DataFrame) -> DataFrame:
    """Rows of a Kafka source in the raw row shape."""
    return rows.selectExpr(
        "topic AS msg_topic", "partition AS msg_partition", "offset AS msg_offset",
        "CAST(timestamp AS TIMESTAMP_NTZ) AS received_at", "CAST(value AS STRING) AS value",
    )


def kafka_reader(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Kafka source starting at the latest offsets, mapped to the raw row shape.

    Needs the Kafka connector on the classpath; the rest of the chain does not.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", options.pop("startingOffsets", "latest"))
    )
    for k, v in options.items():
        reader = reader.option(k, v)
    return kafka_messages(reader.load())


def kafka_writer(alerts: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Alerts keyed by patient as JSON values."""
    return (
        ru.to_keyed_json(alerts)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def scratch_checkpoint(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def audit_sink(
    df: DataFrame, path: str, checkpoint: str, key: str = "alert_id", order: list[str] | None = None, time: str | None = None
) -> StreamingQuery:
    """ST05/UD3: drain what is available into an audit table, each micro-batch through ``append_audit``."""
    return (
        df.writeStream.foreachBatch(lambda batch, _: append_audit(batch, path, key, order, time) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_available(df: DataFrame, name: str, key: str = "alert_id", order: list[str] | None = None, time: str | None = None) -> DataFrame:
    """Drain a streaming DataFrame once (``availableNow``) into an audit table in the shared folder and read it back.

    Rows go from the executors to Parquet; none passes through the driver.
    """
    at = scratch_checkpoint(df.sparkSession, name)
    audit_sink(df, f"{at}/table", f"{at}/checkpoint", key, order, time).awaitTermination()
    schema = df.schema if time is None else T.StructType([*df.schema.fields, T.StructField("audit_day", T.DateType())])
    return stored(df.sparkSession, f"{at}/table", schema).select(*df.columns)
