"""Topics as stored tables, their end, and duplicate suppression (S02, S03, ST05, ST06, ST08).

A topic is a Parquet table that one query writes and another reads as a
stream.  The file sink commits its files by micro-batch, and the file source
of the reader sees committed files only, so a restart neither loses a message
nor publishes one twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Event time of the row that ends a stream.
END_OF_INPUT = "9999-01-01 00:00:00"
MESSAGE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def publish(messages: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to the topic at ``path``; what is available once, or ``every`` interval for good."""
    writer = messages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def consume(spark: SparkSession, path: str, schema: T.StructType = MESSAGE, files_per_batch: int | None = None) -> DataFrame:
    """The topic at ``path`` as a stream, oldest files first."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def event_time(ts: str = "timestamp_utc"):
    """A zone-less timestamp column as the instant of the same UTC reading, for watermarks."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)"))


def once_per_key(stream: DataFrame, key: str = "alert_id", ts: str = "timestamp_utc", delay: str = "1 hour") -> DataFrame:
    """ST06: the first delivery of each key; repeats within ``delay`` of it in event time are suppressed.

    The state holds the keys of that span alone.  Rows later than the
    watermark are dropped, so ``delay`` must cover the disorder of first
    deliveries too.
    """
    timed = stream.withColumn("_event_time", event_time(ts)).withWatermark("_event_time", delay)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_event_time")


def with_end(stream: DataFrame, folder: str, time: str, **filled: str) -> tuple[DataFrame, Callable[[], None]]:
    """``stream`` with an input that can be ended, and the function that ends it.

    The end is one row, null but for a far ``time`` and the ``filled`` columns,
    which moves the watermark past all others.  A column that an inner side of
    a join compares must be filled: its nulls are filtered before the watermark.
    """
    spark = stream.sparkSession
    values = [F.lit({**filled, time: END_OF_INPUT}.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    end = spark.range(1).select(*values)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema.fields])
    end.where("false").write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(schema).parquet(folder)), lambda: end.write.mode("append").parquet(folder)
