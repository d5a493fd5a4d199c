"""Refreshed statistics and running state of the dashboard (ST09, A06, T07, A09).

Each micro-batch leaves its own part under ``batch=<id>`` and overwrites that
part when it is run again, so a replay changes nothing; readers merge the
parts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from wardwatch import schemas
from wardwatch.operators.audit import append_audit, stored
from wardwatch.session import ship_package

# --- one-hour panes of the trailing statistics ------------------------------------

_SUMS = ("n", "critical", "high", "medium", "confidence", "n_confidence", "ms", "n_ms")


def _sums(events: DataFrame, *by: Column) -> DataFrame:
    sev = F.col("severity")
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sev == "CRITICAL").alias("critical"),
        F.count_if(sev == "HIGH").alias("high"),
        F.count_if(sev == "MEDIUM").alias("medium"),
        F.sum("confidence_score").alias("confidence"),
        F.count("confidence_score").alias("n_confidence"),
        F.sum("processing_ms").alias("ms"),
        F.count("processing_ms").alias("n_ms"),
    )


def _audit(spark: SparkSession, at: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("audit_day", T.DateType())])
    return stored(spark, f"{at}/audit", full)


def upsert_panes(batch: DataFrame, batch_id: int, at: str) -> None:
    """Append the new audit rows of a micro-batch and write the hourly panes of exactly those rows.

    Panes are taken from the rows that the table holds for this batch, so a
    batch that is run again after a failure between the two steps gives the
    same panes; rows delivered before count in their first batch alone.
    """
    spark = batch.sparkSession
    append_audit(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), f"{at}/audit", "alert_id", time="created_at")
    mine = _audit(spark, at, batch.schema).where(F.col("batch_id") == batch_id)
    pane = F.date_trunc("HOUR", F.col("created_at")).cast("timestamp_ntz").alias("pane")
    _sums(mine, pane).write.mode("overwrite").parquet(f"{at}/panes/batch={batch_id}")
    mine.select(pane, "patient_id").distinct().write.mode("overwrite").parquet(f"{at}/people/batch={batch_id}")


def refresh_panes(events: DataFrame, at: str, every: str | None = None) -> StreamingQuery:
    """ST09: keep the panes at ``at`` up to date from a stream of audit rows, ``every`` interval or for what is available."""
    writer = events.writeStream.foreachBatch(lambda batch, i: upsert_panes(batch, i, at)).option("checkpointLocation", f"{at}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def trailing_stats(spark: SparkSession, at: str, events: T.StructType, as_of, hours: int = 24) -> DataFrame:
    """The row of ``analytics.dashboard_stats`` at the instant ``as_of`` (a datetime) from panes.

    Whole panes are merged; only the hour that the window's edge cuts is read
    from the audit table, one day's partition of it.
    """
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    edge = stamp(as_of) - F.expr(f"INTERVAL {hours} HOURS")
    hour = F.date_trunc("HOUR", edge).cast("timestamp_ntz")
    inside = hour + F.expr("INTERVAL 1 HOUR")
    rows = _audit(spark, at, events).where((F.col("audit_day") == F.to_date(hour)) & (F.col("created_at") > edge) & (F.col("created_at") < inside))
    kinds = ", ".join(f"{c} {'double' if c == 'confidence' else 'long'}" for c in _SUMS)
    panes = _table(spark, f"{at}/panes", f"pane timestamp_ntz, {kinds}").where(F.col("pane") >= inside)
    people = _table(spark, f"{at}/people", "pane timestamp_ntz, patient_id string").where(F.col("pane") >= inside)
    total = panes.select(*_SUMS).unionByName(_sums(rows).select(*_SUMS)).agg(*[F.sum(c).alias(c) for c in _SUMS])
    seen = people.select("patient_id").union(rows.select("patient_id")).agg(F.count_distinct("patient_id").alias("patients_triaged"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return total.select(
        F.lit(schemas.DASHBOARD_PERIOD).alias("period"),
        zero("n").alias("total_events"),
        zero("critical").alias("critical_count"),
        zero("high").alias("high_count"),
        zero("medium").alias("medium_count"),
        F.coalesce(F.round(F.try_divide("confidence", "n_confidence"), 3), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.round(F.try_divide("ms", "n_ms"), 0), F.lit(0.0)).cast("bigint").alias("avg_processing_ms"),
        seen.scalar().alias("patients_triaged"),
    )


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parts below ``path`` with their ``batch``; empty if there are none yet."""
    return stored(spark, path, T._parse_datatype_string(f"{schema}, batch long"))


# --- the newest alerts ---------------------------------------------------------------

def merge_newest(batch: DataFrame, batch_id: int, at: str, n: int = 50, ts: str = "timestamp_utc") -> None:
    """The newest ``n`` of the list before this micro-batch and the batch's own newest ``n``."""
    spark = batch.sparkSession
    own = batch.dropDuplicates(["alert_id"]).orderBy(F.desc(ts), F.desc("alert_id")).limit(n)
    before = newest(spark, at, batch.schema, before=batch_id)
    merged = before.unionByName(own).dropDuplicates(["alert_id"]).orderBy(F.desc(ts), F.desc("alert_id")).limit(n)
    merged.coalesce(1).write.mode("overwrite").parquet(f"{at}/newest/batch={batch_id}")  # n rows


def newest(spark: SparkSession, at: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The list as the last micro-batch (or the last one before ``before``) left it."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = stored(spark, f"{at}/newest", full)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == (-1 if last is None else last)).drop("batch")


def follow_newest(alerts: DataFrame, at: str, n: int = 50, every: str | None = None) -> StreamingQuery:
    writer = alerts.writeStream.foreachBatch(lambda batch, i: merge_newest(batch, i, at, n)).option("checkpointLocation", f"{at}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# --- alerts since the last acknowledgement --------------------------------------------

COUNT = T.StructType([T.StructField("patient_id", T.StringType()), T.StructField("live_count", T.LongType())])


class UnacknowledgedProcessor(StatefulProcessor):
    """Per patient the times of the alerts since the last acknowledgement; alerts and acknowledgements may come in any order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.acked = handle.getValueState("acked", "t LONG")
        self.times = handle.getListState("times", "t LONG")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last = self.acked.get()[0] if self.acked.exists() else None
        new = []
        acked = last
        for r in rows:
            t = int(r["ts_us"])
            if r["is_ack"]:
                acked = t if acked is None else max(acked, t)
            else:
                new.append(t)
        held = [int(x[0]) for x in self.times.get()] if self.times.exists() else []
        left = [t for t in held + new if acked is None or t > acked]
        if acked != last:
            self.acked.update((acked,))
        if left:
            self.times.put([(t,) for t in left])
        else:
            self.times.clear()
        return iter([Row(patient_id=key[0], live_count=len(left))])

    def close(self) -> None:
        pass


def live_counts(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """A09 as running state: (patient_id, live_count) of each patient that a micro-batch touched.

    ``alerts`` (patient_id, timestamp_utc), ``acks`` (patient_id, acked_at).
    """
    ship_package(alerts.sparkSession)
    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})").alias("ts_us")
    both = alerts.select("patient_id", F.lit(False).alias("is_ack"), us("timestamp_utc")).unionByName(acks.select("patient_id", F.lit(True).alias("is_ack"), us("acked_at")))
    return both.where("patient_id IS NOT NULL AND ts_us IS NOT NULL").groupBy("patient_id").transformWithState(UnacknowledgedProcessor(), COUNT, "Update", "None")


def follow_counts(alerts: DataFrame, acks: DataFrame, at: str, every: str | None = None) -> StreamingQuery:
    """Keep the counts at ``at``; a micro-batch writes the patients it touched."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/counts/batch={batch_id}")

    spark = alerts.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writer = live_counts(alerts, acks).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current_counts(spark: SparkSession, at: str, patients: DataFrame) -> DataFrame:
    """(patient_id, live_count, status) of every patient as the last micro-batch left them."""
    rows = _table(spark, f"{at}/counts", "patient_id string, live_count long")
    last = rows.groupBy("patient_id").agg(F.max_by("live_count", "batch").alias("_n"))
    live = F.coalesce("_n", F.lit(0)).cast("bigint")
    return patients.select("patient_id").join(last, "patient_id", "left").select("patient_id", live.alias("live_count"), F.when(live > 0, "red").otherwise("green").alias("status"))
