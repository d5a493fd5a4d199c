"""End-to-end triage over a table (or micro-batch) of alerts (run_triage_agent, UD7).

The four agent stages become successive DataFrame transforms; each stage
can fail for a row and leave its columns null (context miss, no documents,
model or parse error) while the rows go on:

    accepted alerts (cooldown) -> patient context + trailing count
    -> retrieval query text -> query embedding (caller's hook)
    -> vector top-k + keyword top-k -> RRF top-k -> documents attached
    -> prompt -> model reply (caller's hook) -> parse/repair/validate
    -> recommendations + audit rows

The hooks are DataFrame functions: a table of stored vectors or replies can be
joined, and ``reasoning.embed`` and ``reasoning.score`` wrap a caller's batch
function.  Every prompt is built whole; its length and SHA-256 are saved, and
its text, many times the size of the documents, is built again from saved rows
for whoever reads it.  Replies are saved, so that several outputs may be written
without asking the model again.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.operators.context import with_patient_context
from wardwatch.operators.cooldown import accepted_alerts
from wardwatch.operators.keyword_index import KeywordIndex, search
from wardwatch.operators.reasoning import build_prompts, parse_replies, recommendations
from wardwatch.operators.retrieval import attach_documents, query_text, rrf_fuse, vector_topk
from wardwatch.session import cut_lineage, saved


class Triaged(NamedTuple):
    """``prompts``, ``parsed`` and ``asked`` have every accepted alert, ``recommendations`` those with a valid reply.

    ``asked`` is the stored record of the prompts: documents, length and SHA-256.
    """

    recommendations: DataFrame
    parsed: DataFrame
    prompts: DataFrame
    asked: DataFrame


def triage(
    alerts: DataFrame,
    patients: DataFrame,
    triage_events: DataFrame,
    docs: DataFrame,
    index: KeywordIndex,
    embed: Callable[[DataFrame], DataFrame],
    reply: Callable[[DataFrame], DataFrame],
    cooldown_s: int = 60,
    k_each: int = 5,
    k_final: int = 3,
    match: str = "any",
    model_name: str = "caller-model",
) -> Triaged:
    """The chain over ``alerts``; ``index`` is the keyword index of ``docs``.

    ``embed`` takes (alert_id, text) and returns (alert_id, vec); ``reply``
    takes the prompts (alert_id, prompt, ...) and returns (alert_id, raw_reply).
    """
    accepted = accepted_alerts(alerts, cooldown_s)
    ctx = saved(with_patient_context(accepted, patients, triage_events))
    q = ctx.select("alert_id", query_text(F.col("triggered_rules"), F.col("vitals_snapshot"), F.col("severity")).alias("text"))
    vectors = embed(q).select(F.col("alert_id").alias("query_id"), "vec")
    doc_vecs = docs.where(F.col("embedding").isNotNull()).select(F.col("id").alias("doc_id"), F.col("embedding").alias("vec"))
    v_hits = vector_topk(vectors, doc_vecs, k_each)
    k_hits = search(q.select(F.col("alert_id").alias("query_id"), "text"), index, k_each, match)
    sops = attach_documents(rrf_fuse(v_hits, k_hits, k_final), docs, ctx.withColumnRenamed("alert_id", "query_id"))
    prompts = build_prompts(sops.withColumnRenamed("query_id", "alert_id").select(*ctx.columns, "retrieved_sops"), "retrieved_sops")
    asked = saved(prompts.select(
        "alert_id", "patient_id", "hospital_id", "severity", "timestamp_utc", F.size("retrieved_sops").cast("bigint").alias("n_documents"),
        F.length("prompt").cast("bigint").alias("prompt_length"), F.sha2("prompt", 256).alias("prompt_sha256"),
    ))
    replies = cut_lineage(reply(prompts).select("alert_id", "raw_reply"))
    of_alert = asked.select("alert_id", "patient_id", "hospital_id", "severity", "timestamp_utc")
    parsed = parse_replies(of_alert.join(replies, "alert_id", "left"))
    return Triaged(recommendations(parsed, model_name), parsed, prompts, asked)
