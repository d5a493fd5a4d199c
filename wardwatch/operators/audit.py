"""Idempotent sinks: audit insert-if-absent, incremental corpus load (S08, S09, J08, ST06)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Deterministic de-duplication: the first row per key in ``order``; a sort aggregate, partial before the shuffle."""
    cols = [c for c in df.columns]
    best = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def insert_if_absent(batch: DataFrame, existing: DataFrame, key: str = "alert_id", order: list[str] | None = None) -> DataFrame:
    """Rows of ``batch`` to append: one per new key (``ON CONFLICT (key) DO NOTHING``).

    Duplicates inside the batch keep the first in ``order``; keys already
    stored are removed by a left-anti join on the key column only (the
    stored side is pruned to that one column before the shuffle).
    """
    order = order or [key]
    dedup = first_per_key(batch, key, order)
    return dedup.join(existing.select(key), key, "left_anti")


def _found(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table at ``path``, None if there is none yet. Any other read error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``; empty if there is none yet. Any other read error is raised."""
    table = _found(spark, path, schema)
    return spark.createDataFrame([], schema) if table is None else table


def append_audit(
    batch: DataFrame, target_path: str, key: str = "alert_id", order: list[str] | None = None, time: str | None = None
) -> int:
    """``foreachBatch`` body: append only new keys to a parquet audit table; returns the number of rows appended.

    Re-running a micro-batch after a failure appends nothing twice: the
    anti-join sees the rows of the first attempt.  With ``time`` the table is
    partitioned by that column's date (``audit_day``) and only the batch's
    range of dates, a day wider at both ends, is searched: an event without a
    time of its own carries that of its delivery, which a redelivery may move
    past midnight.  A key must come with dates no further apart than that.
    A first batch meets no table, so it is derived once and nothing is searched.
    """
    spark = batch.sparkSession
    if time is not None:
        batch = batch.withColumn("audit_day", F.to_date(time))
    existing = _found(spark, target_path, batch.schema)
    if time is not None and existing is not None:
        first, last = batch.agg(F.min("audit_day"), F.max("audit_day")).first()
        if first is None and batch.isEmpty():
            return 0
        in_range = F.col("audit_day").isNull()  # rows without a time
        if first is not None:
            in_range |= F.col("audit_day").between(F.date_sub(F.lit(first), 1), F.date_add(F.lit(last), 1))
        existing = existing.where(in_range)
    seen = Observation()
    absent = first_per_key(batch, key, order or [key]) if existing is None else insert_if_absent(batch, existing, key, order)
    new_rows = absent.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = new_rows.write.mode("append")
    (writer.partitionBy("audit_day") if time is not None else writer).parquet(target_path)
    return seen.get["n"]


def load_new_documents(corpus: DataFrame, existing: DataFrame, text: str = "content", order: list[str] | None = None) -> DataFrame:
    """Documents of ``corpus`` whose whole text is not stored yet (first per text).

    Texts are compared by SHA-256; a null text is a text of its own.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_text_key", F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("")))

    return insert_if_absent(keyed(corpus), keyed(existing), "_text_key", order or ["id"]).drop("_text_key")
