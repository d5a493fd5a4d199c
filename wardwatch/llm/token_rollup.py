"""Token counts by source, language and tokenizer version, kept by signed deltas.

Counts are additive, so a change of the documents is a sum of signed rows: an
insert adds the new counts, a delete takes the old ones off, and a revised
count does both.  ``delta`` sums them by (source, lang, version) before they
are shuffled, so a hot source costs one row a task.

A ``Rollup`` keeps the deltas in a shared folder.  ``commit`` appends a
batch's delta under an attempt number of its own and then one row (batch,
attempt) to the log; a single small file appears whole or not at all, and
only attempts that the log names are counted.  Of several attempts of a batch
the first in order counts, so sending a batch again, also at the same time or
after a failure half way, changes nothing.  ``compact`` sums the deltas
counted so far into one batch that stands for them.

Defined results: a null or empty text is a document of 0 tokens; null
sources and languages are groups of their own; repeated rows count each;
groups whose documents and tokens are all taken off vanish from the totals;
an empty table makes an empty delta, which can be committed; extra columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch.llm.common import slices
from wardwatch.llm.mbs_packing import Vocabulary

GROUP = ("source", "lang", "version")
DELTA = "source string, lang string, version string, n_docs long, n_tokens long, n_changes long"
LOG = "batch string, attempt string, replaces array<string>"


def public_vocabularies() -> dict[str, Vocabulary]:
    """Two tokenizer versions, read by the driver and broadcast."""
    import public_tokenizers

    names = ("byte_bpe_50k", "byte_bpe_multi_50k")
    return {n: Vocabulary(public_tokenizers.path(f"{n}.tiktoken"), public_tokenizers.PATTERN) for n in names}


def count_tokens(docs: DataFrame, vocabularies: Mapping[str, Vocabulary], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, version, tokens: one row per input row and tokenizer version, over whole texts."""
    kept = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(dict(vocabularies))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(3).to_pylist()
            for version, vocabulary in shared.value.items():
                n = pa.array([len(vocabulary.encode(t)) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * len(texts), pa.string()), n], ["doc_id", "source", "lang", "version", "tokens"])

    return kept.mapInArrow(counted, f"doc_id {dict(kept.dtypes)['doc_id']}, source string, lang string, version string, tokens long")


def delta(new: DataFrame | None = None, old: DataFrame | None = None) -> DataFrame:
    """Signed sums of a batch: rows of ``new`` are inserted, rows of ``old`` deleted, rows in both are revised."""
    sides = [
        side.select(*[F.col(c).cast("string").alias(c) for c in GROUP], F.lit(sign).cast("long").alias("sign"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
        for side, sign in ((new, 1), (old, -1))
        if side is not None
    ]
    if not sides:
        raise ValueError("a delta needs rows to insert or rows to delete")
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return both.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"), F.count(F.lit(1)).alias("n_changes"))


class Rollup:
    """Totals of all committed batches in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], LOG).write.mode("append").parquet(f"{self.path}/log")
        spark.createDataFrame([], f"{DELTA}, batch string, attempt string").write.mode("append").parquet(f"{self.path}/deltas")

    def _attempts(self) -> DataFrame:
        """The attempt of each batch that counts, without the batches that a compacted one stands for."""
        log = self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        counted = log.groupBy("batch").agg(F.min_by("replaces", "attempt").alias("replaces"), F.min("attempt").alias("attempt"))
        gone = counted.select(F.explode("replaces").alias("batch")).distinct()
        return counted.join(gone, "batch", "left_anti")

    def committed(self, batch: str) -> bool:
        return not self.spark.read.schema(LOG).parquet(f"{self.path}/log").where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, change: DataFrame, replaces: tuple[str, ...] = ()) -> bool:
        """Add a batch's delta; False, and no change, if the batch has been committed before."""
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        rows = change.withColumn("batch", F.lit(batch)).withColumn("attempt", F.lit(attempt))
        rows.write.mode("append").parquet(f"{self.path}/deltas")
        self.spark.createDataFrame([(batch, attempt, list(replaces))], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return True

    def _counted(self) -> DataFrame:
        rows = self.spark.read.schema(f"{DELTA}, batch string, attempt string").parquet(f"{self.path}/deltas")
        return rows.join(self._attempts().select("batch", "attempt"), ["batch", "attempt"], "left_semi")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens, n_changes of all committed batches."""
        sums = self._counted().groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_changes")])
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, batch: str) -> bool:
        """Stand one summed batch for all batches counted now; their ids stay taken.  One writer at a time may compact."""
        names = tuple(sorted(r.batch for r in self._attempts().collect()))
        sums = self._counted().where(F.col("batch").isin(*names)).groupBy(*GROUP)
        return self.commit(batch, sums.agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_changes")]), names)
