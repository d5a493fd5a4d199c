"""Places of rows in a total order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardwatch.session import cut_lineage


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place (from 0) in the order as column ``name``; rows that tie get places of their own.

    Rows are dealt by ranges of the order and numbered within each; the
    number of rows in the ranges before, one row per range, is broadcast.
    """
    numbered = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranges = numbered.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = ranges.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    joined = numbered.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(before), "_range")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*rows.columns, place.alias(name))
