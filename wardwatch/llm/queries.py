"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch.llm import embedding_whitening, exact_dedup, filter_audit, license_scan, mbs_packing, mix_flow, pii_disclosure, quality_fm, quality_rules, quote_links, simhash_golay, token_rollup, toxicity
from wardwatch.session import cut_lineage, ensure_checkpoint_dir

#: Weights of the sources in code point order, repeating.
MIX_WEIGHTS = (5.0, 2.0, 1.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_disclosure.find(_table(spark, sf_dir, "documents"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_golay.near_classes(_table(spark, sf_dir, "documents"), width=3, max_bits=3)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with estimates (a token for four characters), then revised to true counts; both batches are sent twice."""
    true = cut_lineage(token_rollup.count_tokens(_table(spark, sf_dir, "documents"), token_rollup.public_vocabularies()).drop("doc_id"))
    docs = _table(spark, sf_dir, "documents").select("source", "lang", F.coalesce(F.ceil(F.length("text") / 4), F.lit(0)).alias("tokens"))
    versions = F.explode(F.array(*map(F.lit, token_rollup.public_vocabularies()))).alias("version")
    estimated = cut_lineage(docs.select("source", "lang", versions, "tokens"))
    rollup = token_rollup.Rollup(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    for _ in range(2):
        rollup.commit("estimates", token_rollup.delta(new=estimated))
        rollup.commit("true-counts", token_rollup.delta(new=true, old=estimated))
    return rollup.totals()


def op5_mix_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_flow.mix_words(_table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op6_mbs_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mbs_packing.pack(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = quality_rules.judge(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.rendered(quote_links.format_chats(_table(spark, sf_dir, "conversations")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(_table(spark, sf_dir, "embeddings"))


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pii_disclosure, op2_quality_fm, op3_simhash_golay, op4_token_rollup, op5_mix_flow, op6_mbs_packing, op7_toxicity, op8_exact_dedup, op9_quality_rules, op10_quote_links, op11_filter_audit, op12_license_scan, op13_embedding_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op12_license_scan": license_scan.oracle_sql(),
        "op8_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, row_number() OVER () AS r FROM documents)
            SELECT doc_id,
                   first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY h) AS group_size,
                   row_number() OVER w = 1 AS kept,
                   h AS text_sha256
            FROM d WINDOW w AS (PARTITION BY h ORDER BY doc_id DESC NULLS LAST, r)
        """,
    }
