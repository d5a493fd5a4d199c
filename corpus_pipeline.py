"""The corpus pipeline: filter, deduplicate, mix and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  Between stages the rows are
written as Parquet and read again.

Defined results: null and empty texts pass the first stage, are equal to each
other in the second (the largest id stays, null ids lose), have no words to
mix (their source may still be taken whole) and pack as a single end mark;
null ids and rows equal in all columns count as rows, of which the second
stage keeps one; a null source is a source of its own; extra columns, whatever
their names, are carried as they are to the last stage; empty tables give no
pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch.llm import exact_dedup, mbs_packing, mix_flow, simhash_golay, toxicity
from wardwatch.llm.queries import MIX_WEIGHTS
from wardwatch.session import ensure_checkpoint_dir, ship_package


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores under one half."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: that with the largest id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class (3 words, 3 bits): that with the smallest id."""
    ship_package(spark)
    return simhash_golay.drop_near(docs, width=3, max_bits=3)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sources weighing 5, 2, 1 in turn."""
    return mix_flow.mix(docs, F.array("source"), mix_flow.word_count(F.col("text")), weights=MIX_WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    ship_package(spark)
    return mbs_packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mix", mixed),
    ("best_fit_packing", packed),
]

#: The stages learn, decode and search; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
