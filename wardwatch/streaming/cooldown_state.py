"""Streaming per-patient cooldown (ST03 in streaming form, ST04).

``transformWithState`` in event time.  Per patient: a list state of the rows
that are not final yet, the last accepted time, and ONE timer, set to the
earliest pending row.  When the watermark passes it, all pending rows below
the watermark are folded in event-time order and the timer moves on, so a
micro-batch costs one pass over what is pending, also for a hot patient.
Without pending rows the timer waits for the end of the cooldown and then
clears the state: any later row would be accepted anyway.

Out-of-order arrival within the watermark delay gives the answer of the
batch scan.  Accepted alerts are emitted once they are final, that is below
the watermark.  A row without ``alert_id``, far in the future (``topic.with_end``),
ends the stream: it moves the watermark past all rows, which are then
final; whatever comes later is late.
"""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from wardwatch.operators.audit import stored
from wardwatch.session import ship_package
from wardwatch.streaming.alert_stream import audit_sink, scratch_checkpoint
from wardwatch.streaming.topic import with_end

OUT = T.StructType(
    [
        T.StructField("patient_id", T.StringType()),
        T.StructField("alert_id", T.StringType()),
        T.StructField("ts_us", T.LongType()),
    ]
)


class CooldownProcessor(StatefulProcessor):
    def __init__(self, cooldown_s: int) -> None:
        self.cooldown_us = int(cooldown_s) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_accepted", "t LONG")
        self.timer = handle.getValueState("timer", "ms LONG")
        self.pending = handle.getListState("pending", "alert_id STRING, t LONG")

    def _set_timer(self, ms: int) -> None:
        if self.timer.exists():
            at = self.timer.get()[0]
            if at == ms:
                return
            self.handle.deleteTimer(at)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(r["alert_id"], int(r["ts_us"])) for r in rows if r["alert_id"] is not None]
        if new:
            held = self.pending.exists()
            self.pending.appendList(new)
            due = min(t for _, t in new) // 1000 + 1
            # a timer that waits for the cooldown's end gives way to one for the rows
            self._set_timer(min(due, self.timer.get()[0]) if held and self.timer.exists() else due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()  # Spark has removed the timer that expired
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(((p[0], int(p[1])) for p in self.pending.get()), key=lambda x: (x[1], x[0]))
        ready = [x for x in rows if x[1] < wm_us]
        rest = rows[len(ready):]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for aid, t in ready:
            if last is None or t - last >= self.cooldown_us:
                last = t
                out.append(Row(patient_id=key[0], alert_id=aid, ts_us=t))
        self.pending.clear()
        if rest:
            self.pending.put(rest)
        free_us = None if last is None else last + self.cooldown_us
        if free_us is None or free_us <= wm_us:
            self.last.clear()
        else:
            self.last.update((last,))
        if rest:
            self._set_timer(rest[0][1] // 1000 + 1)
        elif free_us is not None and free_us > wm_us:
            self._set_timer(-(-free_us // 1000) + 1)
        return iter(out)

    def close(self) -> None:
        pass


def stream_cooldown(alerts: DataFrame, cooldown_s: int = 60, delay: str = "0 seconds") -> DataFrame:
    """Accepted alerts of a streaming (or batch) alert DataFrame; event time ``timestamp_utc``."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', timestamp_utc)")
    keyed = alerts.select("patient_id", "alert_id", micros.alias("ts_us")).withColumn(
        "event_time", F.timestamp_micros("ts_us")
    )
    if alerts.isStreaming:
        keyed = keyed.withWatermark("event_time", delay)
    out = keyed.groupBy("patient_id").transformWithState(
        CooldownProcessor(cooldown_s), OUT, "Append", "EventTime"
    )
    return out.select(
        "alert_id", "patient_id",
        F.expr("timestampadd(MICROSECOND, ts_us, TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("timestamp_utc"),
    )


def drain_cooldown(alerts: DataFrame, cooldown_s: int = 60, delay: str = "0 seconds", at: str | None = None) -> DataFrame:
    """All accepted alerts of a streaming DataFrame, its newest included; the table stays at ``at``/table.

    The available input is drained; the row that ends it is then written to a
    folder which the same query also reads, and the query goes on from its
    checkpoint, which emits what was still pending.
    """
    spark = alerts.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        # transformWithState keeps its state in the RocksDB state store
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship_package(spark)
    at = at or scratch_checkpoint(spark, "cooldown")
    both, end = with_end(alerts.select("alert_id", "patient_id", "timestamp_utc"), f"{at}/end", "timestamp_utc")
    out = stream_cooldown(both.withColumn("patient_id", F.coalesce("patient_id", F.lit(""))), cooldown_s, delay)
    audit_sink(out, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    end()
    audit_sink(out, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return stored(spark, f"{at}/table", out.schema)
