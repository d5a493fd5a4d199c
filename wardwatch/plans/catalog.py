"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's parquet tables (through the fixture
derivations) and runs the library operators over whole tables.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch.operators import rules as ru
from wardwatch.operators import validate as va
from wardwatch.sources import tables as tb

Query = Callable[[SparkSession, str], DataFrame]


# --- shared building blocks --------------------------------------------------

def valid_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.valid_telemetry(tb.telemetry(spark, sf_dir))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.detect_alerts(valid_telemetry(spark, sf_dir))


def alerts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts for a query that uses them more than once: derived in one scan and stored."""
    from wardwatch.session import cut_lineage

    return cut_lineage(alerts(spark, sf_dir))


def parsed_raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    checked = va.validate_telemetry(va.parse_telemetry(tb.raw_telemetry(spark, sf_dir)))
    return va.split_valid(checked)


# --- queries -----------------------------------------------------------------

def q_telemetry_valid(spark, sf_dir):
    v = F.col("vitals")
    return valid_telemetry(spark, sf_dir).select(
        "event_id", "patient_id", "timestamp_utc",
        *[v[n].alias(n) for n in ["heart_rate_bpm", "systolic_bp_mmhg", "diastolic_bp_mmhg",
                                  "spo2_percent", "respiratory_rate_rpm", "temperature_celsius"]],
    )


def q_telemetry_parsed(spark, sf_dir):
    valid, _ = parsed_raw(spark, sf_dir)
    v = F.col("vitals")
    return valid.select(
        "event_id", "patient_id", "hospital_id", "ward", "bed_number", "timestamp_utc",
        *[v[n].alias(n) for n in ["heart_rate_bpm", "systolic_bp_mmhg", "diastolic_bp_mmhg",
                                  "spo2_percent", "respiratory_rate_rpm", "temperature_celsius"]],
        "nursing_notes", "is_simulated",
    )


def q_telemetry_rejects_by_reason(spark, sf_dir):
    _, rejects = parsed_raw(spark, sf_dir)
    return va.rejects_by_reason(rejects)


def q_rule_hits(spark, sf_dir):
    return ru.rule_hits(valid_telemetry(spark, sf_dir))


def q_alerts(spark, sf_dir):
    return alerts(spark, sf_dir).select(
        "alert_id", "source_event_id", "patient_id", "hospital_id", "ward", "bed_number", "timestamp_utc",
        "severity", F.array_join("triggered_rules", " | ").alias("rules_text"),
        F.size("triggered_rules").cast("bigint").alias("n_rules"),
    )


def q_alerts_by_severity(spark, sf_dir):
    return alerts(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n_alerts"))


def q_alerts_by_ward(spark, sf_dir):
    return alerts(spark, sf_dir).groupBy("hospital_id", "ward", "severity").agg(
        F.count(F.lit(1)).alias("n_alerts"), F.count_distinct("patient_id").alias("n_patients")
    )


def q_alert_summary(spark, sf_dir):
    return ru.with_summary(alerts(spark, sf_dir)).select("alert_id", "summary")


def q_rule_labels(spark, sf_dir):
    from wardwatch.functions.text import short_rule_labels

    return alerts(spark, sf_dir).select("alert_id", F.array_join(short_rule_labels(F.col("triggered_rules")), ",").alias("labels"))


def q_alert_json(spark, sf_dir):
    """The keyed JSON messages, read back with a JSON path each, and the number of their top-level keys."""
    m = ru.to_keyed_json(alerts(spark, sf_dir))
    at = lambda path: F.get_json_object("value", f"$.{path}")
    return m.select(
        "key",
        F.json_object_keys("value").alias("_k"),
        *[at(c).alias(c) for c in ("alert_id", "source_event_id", "patient_id", "timestamp_utc", "severity", "nursing_notes")],
        at("vitals_snapshot.heart_rate_bpm").cast("int").alias("heart_rate_bpm"),
        at("vitals_snapshot.temperature_celsius").cast("double").alias("temperature_celsius"),
        at("triggered_rules[0]").alias("first_rule"),
    ).select(F.size("_k").cast("bigint").alias("n_keys"), "*").drop("_k")


#: A caller's own rule table: other thresholds, texts and severities than the default one.
NIGHT_RULES = (
    ru.Rule("N1", "simple", when=lambda v: v("heart_rate_bpm") > 95, template="N1 fast: {hr}"),
    ru.Rule("N2", "all", when=lambda v: (v("spo2_percent") < 96.0) & (v("respiratory_rate_rpm") > 18), template="N2 airway: {spo2}/{rr}", severity="LOW"),
    ru.Rule(
        "N3", "at_least", template="N3 pressure ({n}): ", severity="CRITICAL", min_met=1,
        criteria=(ru.Criterion(lambda v: v("systolic_bp_mmhg") > 185, "sys {sbp}"), ru.Criterion(lambda v: v("diastolic_bp_mmhg") > 110, "dia {dbp}")),
    ),
)


def q_alerts_by_own_rules(spark, sf_dir):
    """UD4: alerts by a rule table of the caller's."""
    al = ru.detect_alerts(valid_telemetry(spark, sf_dir), NIGHT_RULES)
    return al.select("alert_id", "severity", F.array_join("triggered_rules", " | ").alias("rules_text"))


def q_lax_coercion(spark, sf_dir):
    """What becomes of JSON fields of other kinds: numbers may be texts or whole decimals, texts must be texts."""
    checked = va.validate_telemetry(va.parse_telemetry(tb.kind_messages(spark, sf_dir)))
    return checked.select("msg_offset", F.array_join("rejection_reasons", " ").alias("reasons"), F.col("vitals.heart_rate_bpm").alias("heart_rate_bpm"), F.col("vitals.spo2_percent").alias("spo2_percent"))


def q_patient_id_normalised(spark, sf_dir):
    valid, _ = parsed_raw(spark, sf_dir)
    return valid.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_readings"))


def q_embedding_input(spark, sf_dir):
    """The text that a document is embedded by."""
    from wardwatch.functions.text import embedding_input

    text = embedding_input(F.col("title"), F.col("content"))
    return tb.sops(spark, sf_dir).select("id", F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def q_pipeline_counters(spark, sf_dir):
    """What a run of the stream processed, rejected, published, skipped and failed on."""
    from wardwatch.streaming import chain as ch
    from wardwatch.streaming.alert_stream import counted_alerts, scratch_checkpoint
    from wardwatch.streaming.counters import counted, totals
    from wardwatch.streaming.topic import consume, publish

    chain = ch.Chain(scratch_checkpoint(spark, "counters"))
    al = counted_alerts(tb.raw_telemetry(spark, sf_dir, tb.events_stream(spark, sf_dir)))
    run = publish(ru.to_keyed_json(al), chain.alerts, chain.publish_checkpoint)
    run.awaitTermination()
    found, dead = ch.read_alerts(consume(spark, chain.alerts))
    read = publish(found, chain.clean, chain.clean_checkpoint)
    read.awaitTermination()
    bad = publish(counted(dead, "dead_letters", errors=F.lit(True)), chain.dead_letters, chain.dead_checkpoint)
    bad.awaitTermination()
    taken = ch.accept_alerts(spark, chain, 60).count()
    n = totals(run) | totals(bad)
    rows = [
        ("processed", n["telemetry.processed"]), ("rejected", n["telemetry.rejected"]), ("published", n["alerts.published"]),
        ("skipped", n["alerts.published"] - taken), ("errors", n.get("dead_letters.errors", 0)),
    ]
    return spark.createDataFrame(rows, "counter string, n long")


def q_cooldown_60s(spark, sf_dir):
    from wardwatch.operators.cooldown import accepted_keys

    return accepted_keys(alerts(spark, sf_dir), 60)


def q_cooldown_12h(spark, sf_dir):
    from wardwatch.operators.cooldown import accepted_keys

    return accepted_keys(alerts(spark, sf_dir), 12 * 3600)


def q_cooldown_skipped(spark, sf_dir):
    from wardwatch.operators.cooldown import skipped_per_patient

    return skipped_per_patient(alerts(spark, sf_dir), 60)


def q_cooldown_runs(spark, sf_dir):
    from wardwatch.operators.cooldown import gap_runs

    return gap_runs(alerts(spark, sf_dir), 12 * 3600)


def triage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.triage_events_from_alerts(alerts(spark, sf_dir))


_audit_tables: dict[tuple[str, str], str] = {}


def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored audit table, partitioned by date, that all reports of an application read."""
    from pyspark.sql import types as T

    from wardwatch.operators.audit import append_audit, stored
    from wardwatch.streaming.alert_stream import scratch_checkpoint

    at = (spark.sparkContext.applicationId, sf_dir)
    events = triage_events(spark, sf_dir)
    if at not in _audit_tables:
        path = f"{scratch_checkpoint(spark, 'audit')}/table"
        append_audit(events, path, "alert_id", ["id"], time="created_at")
        _audit_tables[at] = path
    return stored(spark, _audit_tables[at], T.StructType([*events.schema.fields, T.StructField("audit_day", T.DateType())]))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts that pass the cooldown, derived once: what the feed and the live views show."""
    from wardwatch.operators.cooldown import accepted_alerts
    from wardwatch.session import cut_lineage

    return cut_lineage(accepted_alerts(cut_lineage(alerts(spark, sf_dir)), 60))


def as_of(spark: SparkSession, sf_dir: str):
    """Reporting instant: the newest reading (scalar subquery, no driver round trip)."""
    return tb.table(spark, sf_dir, "events").select(F.max("ts")).scalar()


def q_patient_list(spark, sf_dir, hospital_id=None, ward=None):
    from wardwatch.operators import analytics as an
    from wardwatch.operators.context import medication_text

    pl = an.patient_list(tb.patients(spark, sf_dir), audit_table(spark, sf_dir), as_of(spark, sf_dir), hospital_id, ward)
    return pl.select(
        "patient_id", "full_name", "age_years", "gender", "ward", "bed_number",
        F.array_join("chronic_conditions", ", ").alias("conditions"),
        medication_text(F.col("active_medications")).alias("medications"),
        "recent_alert_count",
    )


def q_patient_list_filtered(spark, sf_dir):
    return q_patient_list(spark, sf_dir, hospital_id="HOSP-001", ward="BUILDING")


def q_patient_history(spark, sf_dir):
    from wardwatch.operators import analytics as an

    return an.patient_history(audit_table(spark, sf_dir), "pt-000007", 10)


def q_recent_feed_page(spark, sf_dir):
    from wardwatch.operators import analytics as an

    items, _ = an.recent_feed(audit_table(spark, sf_dir), page=2, page_size=20, severity="critical")
    return items


def q_recent_feed_total(spark, sf_dir):
    from wardwatch.operators import analytics as an

    _, total = an.recent_feed(audit_table(spark, sf_dir), page=2, page_size=20, severity="critical")
    return total


def q_dashboard_stats(spark, sf_dir):
    from wardwatch.operators import analytics as an

    return an.dashboard_stats(audit_table(spark, sf_dir), as_of(spark, sf_dir))


def q_billing_by_hospital_day(spark, sf_dir):
    from wardwatch.operators import analytics as an

    return an.billing_rollup(audit_table(spark, sf_dir))


def q_alert_patient_context(spark, sf_dir):
    from wardwatch.operators.context import medication_text, with_patient_context

    al = alerts_once(spark, sf_dir)
    ctx = with_patient_context(al, tb.patients(spark, sf_dir), tb.triage_events_from_alerts(al))
    c = F.col("patient_context")
    return ctx.select(
        "alert_id", "patient_id", c["full_name"].alias("full_name"), c["age_years"].alias("age_years"),
        c["gender"].alias("gender"), c["blood_type"].alias("blood_type"), c["weight_kg"].alias("weight_kg"),
        F.array_join(c["allergies"], ", ").alias("allergies"),
        F.array_join(c["chronic_conditions"], ", ").alias("conditions"),
        F.when(c.isNotNull(), medication_text(c["active_medications"])).alias("medications"),
        c["recent_triage_count"].alias("recent_triage_count"),
        "context_fetch_error",
    )


def q_context_misses(spark, sf_dir):
    """Alerts whose patient has no record, over the whole patient table."""
    from wardwatch.operators.context import with_patient_context

    al = alerts_once(spark, sf_dir)
    ctx = with_patient_context(al, tb.patients(spark, sf_dir), tb.triage_events_from_alerts(al))
    return ctx.agg(F.count(F.lit(1)).alias("n_alerts"), F.count("context_fetch_error").alias("n_missing"))


def q_trailing_24h_count(spark, sf_dir):
    from wardwatch.operators.context import trailing_count

    al = alerts_once(spark, sf_dir)
    te = tb.triage_events_from_alerts(al)
    return trailing_count(al.select("alert_id", "patient_id", "timestamp_utc"), te, "patient_id", "timestamp_utc", "created_at").select("alert_id", "patient_id", "recent_count")


def q_patient_age(spark, sf_dir):
    from wardwatch.operators.context import age_years

    p = tb.patients(spark, sf_dir).withColumn("_on", F.to_date(as_of(spark, sf_dir)))
    return p.select("patient_id", "date_of_birth", age_years(F.col("date_of_birth"), F.col("_on")).alias("age_years"))


def q_retrieval_query_text(spark, sf_dir):
    from wardwatch.operators.retrieval import query_text

    al = alerts(spark, sf_dir)
    return al.select("alert_id", query_text(F.col("triggered_rules"), F.col("vitals_snapshot"), F.col("severity")).alias("query_text"))


def q_keyword_terms(spark, sf_dir):
    from wardwatch.operators.retrieval import keyword_terms

    return alerts(spark, sf_dir).select("alert_id", keyword_terms(F.col("triggered_rules")).alias("terms"))


def _sop_vectors(spark, sf_dir):
    vectors = tb.sops(spark, sf_dir).where(F.col("embedding").isNotNull())
    return vectors.select(F.col("id").alias("doc_id"), F.col("embedding").alias("vec"))


_indexes: dict[tuple[str, str], object] = {}


def _sop_index(spark, sf_dir):
    """The stored keyword index over all documents; built once for all searches of an application."""
    from wardwatch.operators import keyword_index as ki

    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _indexes:
        s = tb.sops(spark, sf_dir).select(F.col("id").alias("doc_id"), "title", "content")
        _indexes[at] = ki.build(s, F.concat_ws(" ", "title", "content"))
    return _indexes[at]


def q_vector_top5(spark, sf_dir):
    from wardwatch.operators.retrieval import vector_topk

    hits = vector_topk(_query_vectors(spark, sf_dir), _sop_vectors(spark, sf_dir), k=5)
    return hits.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def _query_vectors(spark, sf_dir):
    return tb.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def q_vector_index_top5(spark, sf_dir):
    """The search of vector_top5 on the stored index: approximate, so without SQL; its recall is the query below."""
    from wardwatch.operators import vector_index as vi

    hits = vi.search(_query_vectors(spark, sf_dir), vi.build(_sop_vectors(spark, sf_dir)), k=5)
    return hits.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def q_vector_index_recall(spark, sf_dir):
    """Recall of vector_index_top5 against vector_top5 over all queries: the counts, and whether it reaches 0.9."""
    from wardwatch.operators import vector_index as vi

    found = vi.recall(q_vector_index_top5(spark, sf_dir), q_vector_top5(spark, sf_dir))
    return found.select("n_queries", "n_exact", (F.col("recall") >= 0.9).alias("reaches_90_percent"))


def _keyword(spark, sf_dir, match):
    from wardwatch.operators.keyword_index import search

    q = tb.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = search(q, _sop_index(spark, sf_dir), k=5, match=match)
    return hits.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def q_keyword_top5_any(spark, sf_dir):
    return _keyword(spark, sf_dir, "any")


def q_keyword_top5_all(spark, sf_dir):
    return _keyword(spark, sf_dir, "all")


def q_rrf_top3(spark, sf_dir):
    from wardwatch.operators.keyword_index import search
    from wardwatch.operators.retrieval import rrf_fuse, vector_topk

    vec = _sop_vectors(spark, sf_dir)
    v_hits = vector_topk(vec.withColumnRenamed("doc_id", "query_id"), vec, k=5)
    asked = tb.sops(spark, sf_dir).where(F.col("embedding").isNotNull())  # a fused query has a vector and a text
    texts = asked.select(F.col("id").alias("query_id"), F.concat_ws(" ", "title", "content").alias("text"))
    k_hits = search(texts, _sop_index(spark, sf_dir), k=5, match="any")
    fused = rrf_fuse(v_hits, k_hits, k_final=3)
    return fused.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "relevance_score", "retrieval_method")


def _parsed_replies(spark, sf_dir, al=None):
    from wardwatch.operators.reasoning import parse_replies

    return parse_replies(tb.model_replies(alerts(spark, sf_dir) if al is None else al))


def q_reply_parse(spark, sf_dir):
    r = F.col("reply")
    return _parsed_replies(spark, sf_dir).select(
        "alert_id", "repaired", "llm_error", r["urgency_level"].alias("urgency_level"),
        F.when(r.isNotNull(), F.size(r["recommended_actions"])).cast("bigint").alias("n_actions"),
        r["confidence_score"].alias("confidence_score"),
    )


def q_reply_repair(spark, sf_dir):
    from wardwatch.operators.reasoning import repair_json

    return tb.model_replies(alerts(spark, sf_dir)).select("alert_id", repair_json(F.col("raw_reply")).alias("repaired_text"))


def q_reply_policy(spark, sf_dir):
    from wardwatch.operators.reasoning import policy_checks

    p = _parsed_replies(spark, sf_dir).where(F.col("llm_error").isNull())
    return policy_checks(p).select("alert_id", "actions_count_ok", "actions_ordered_ok", "urgency_ok")


def q_prompt_text(spark, sf_dir):
    from wardwatch.operators.context import with_patient_context
    from wardwatch.operators.reasoning import build_prompts

    al = alerts_once(spark, sf_dir)
    ctx = with_patient_context(al, tb.patients(spark, sf_dir), tb.triage_events_from_alerts(al))
    pr = build_prompts(ctx, None)
    return pr.select("alert_id", F.length("prompt").cast("bigint").alias("prompt_length"), F.sha2("prompt", 256).alias("prompt_sha256"))


def q_audit_insert_if_absent(spark, sf_dir):
    from wardwatch.operators.audit import insert_if_absent

    te = triage_events(spark, sf_dir)
    stored = te.where(F.col("created_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    batch = te.unionByName(te)  # every alert delivered twice (at-least-once)
    return insert_if_absent(batch, stored, "alert_id", ["id"]).select("id", "alert_id", "patient_id", "severity")


def q_corpus_incremental_load(spark, sf_dir):
    from wardwatch.operators.audit import load_new_documents

    docs = tb.sops(spark, sf_dir).join(
        tb.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id"
    )
    stored = docs.where(F.col("lang") == "en")
    return load_new_documents(docs.select("id", "title", "category", "content"), stored.select("content")).select("id", "title", "category")


def _recommendations(spark, sf_dir, al=None):
    from wardwatch.operators.reasoning import recommendations

    return recommendations(_parsed_replies(spark, sf_dir, al), "fixture-model")


def q_feed_envelope(spark, sf_dir):
    from wardwatch.operators import live

    al = accepted(spark, sf_dir)
    f = live.feed(al.drop("event_seq"), _recommendations(spark, sf_dir, al))
    return f.select("event_type", "key", "timestamp")


def q_feed_demux(spark, sf_dir):
    from wardwatch import schemas
    from wardwatch.operators import live

    al = accepted(spark, sf_dir)
    f = live.feed(al.drop("event_seq"), _recommendations(spark, sf_dir, al))
    back = live.demux(f, "alert_received", schemas.ALERT)
    return back.select("alert_id", "patient_id", "severity", "timestamp_utc",
                       F.array_join("triggered_rules", " | ").alias("rules_text"),
                       F.col("vitals_snapshot.spo2_percent").alias("spo2_percent"))


def q_live_feed_join(spark, sf_dir):
    from wardwatch.operators import live

    al = accepted(spark, sf_dir)
    return live.feed_status(al, _recommendations(spark, sf_dir, al)).select("alert_id", "status", "urgency_level")


def _shown(top):
    from wardwatch.operators import live

    return live.display_columns(top).select("alert_id", "patient_id", "timestamp_utc", "rule_labels", "summary_short")


def q_live_feed_top50(spark, sf_dir):
    from wardwatch.operators import live

    return _shown(live.latest(ru.with_summary(accepted(spark, sf_dir)), 50))


def q_live_feed_patient(spark, sf_dir):
    """the feed of one patient."""
    from wardwatch.operators import live

    return _shown(live.latest(ru.with_summary(accepted(spark, sf_dir)), 50, "PT-000007"))


def q_live_counts_after_ack(spark, sf_dir):
    from wardwatch.operators import live

    return live.live_counts(accepted(spark, sf_dir), tb.acks(spark, sf_dir), tb.patients(spark, sf_dir))


def q_ward_roster(spark, sf_dir):
    from wardwatch.operators import live

    return live.ward_roster(tb.patients(spark, sf_dir))


def q_feed_display(spark, sf_dir):
    from wardwatch.operators import live

    recs = _recommendations(spark, sf_dir).select("alert_id", "urgency_level").hint("merge")  # as many as alerts, though files of events are small
    te = triage_events(spark, sf_dir).join(recs, "alert_id", "left")
    return live.display_columns(te).select("alert_id", "confidence_text", "processing_text", "urgency_text")


def q_request_log_rollup(spark, sf_dir):
    from wardwatch.operators import live

    return live.request_log_rollup(tb.request_log(spark, sf_dir))


def q_request_rate_breach(spark, sf_dir):
    from wardwatch.operators import live

    return live.rate_breaches(tb.request_log(spark, sf_dir), 60)


def q_stream_alerts(spark, sf_dir):
    from wardwatch.streaming.alert_stream import run_available, telemetry_to_alerts

    out, _ = telemetry_to_alerts(tb.raw_telemetry(spark, sf_dir, tb.events_stream(spark, sf_dir)))
    return run_available(out.select("alert_id", "patient_id", "severity", "timestamp_utc"), "stream_alerts", time="timestamp_utc")


def q_stream_cooldown(spark, sf_dir):
    """Streaming cooldown over the alert stream, drained to the end of its input."""
    from wardwatch.streaming.alert_stream import telemetry_to_alerts
    from wardwatch.streaming.cooldown_state import drain_cooldown

    al, _ = telemetry_to_alerts(tb.raw_telemetry(spark, sf_dir, tb.events_stream(spark, sf_dir)))
    return drain_cooldown(al, 60)


def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of ``alerts`` as a stream."""
    return ru.detect_alerts(va.valid_telemetry(tb.telemetry(spark, sf_dir, tb.events_stream(spark, sf_dir))))


def _unreliable(messages: DataFrame) -> DataFrame:
    """Keyed messages as a bad line delivers them: every second twice, some cut short too, some followed by a tombstone."""
    seq, value = F.col("event_seq"), F.col("value")
    sent = F.array(
        F.struct(F.lit(True).alias("sent"), value.alias("value")),
        F.struct((seq % 2 == 0).alias("sent"), value.alias("value")),
        F.struct((seq % 53 == 0).alias("sent"), F.substring(value, 1, 90).alias("value")),
        F.struct((seq % 59 == 0).alias("sent"), F.lit(None).cast("string").alias("value")),
    )
    return messages.select("key", F.explode(sent).alias("m")).where("m.sent").select("key", "m.value")


def q_stream_triage_chain(spark, sf_dir):
    """Telemetry -> alert topic -> checked alerts -> cooldown -> audit table, and the dead letters of the topic."""
    from wardwatch.streaming import chain as ch
    from wardwatch.streaming.alert_stream import scratch_checkpoint
    from wardwatch.streaming.topic import publish

    chain = ch.Chain(scratch_checkpoint(spark, "chain"))
    messages = _unreliable(ru.to_keyed_json(alert_stream(spark, sf_dir), keep=("event_seq",)))
    publish(messages, chain.alerts, chain.publish_checkpoint).awaitTermination()
    ch.check_alerts(spark, chain)
    accepted = ch.accept_alerts(spark, chain, 60)
    dead = ch.dead_letters(spark, chain)
    none = lambda kind: F.lit(None).cast(kind)
    return accepted.select(F.lit("accepted").alias("kind"), "alert_id", "patient_id", "timestamp_utc", none("string").alias("error_preview")).unionByName(
        dead.select(F.lit("dead_letter").alias("kind"), none("string").alias("alert_id"), F.col("key").alias("patient_id"), none("timestamp_ntz").alias("timestamp_utc"), "error_preview")
    )


ROWS_A_FILE = 100_000


def q_stream_dedup(spark, sf_dir):
    """Alerts delivered up to three times over several micro-batches, each once: five days a batch, repeats in the same batch and the next."""
    from wardwatch import schemas
    from wardwatch.streaming import chain as ch
    from wardwatch.streaming.alert_stream import scratch_checkpoint
    from wardwatch.streaming.topic import consume, once_per_key, publish

    days = F.expr("CAST(floor(timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', timestamp_utc) / 5) AS INT)")
    chain = ch.Chain(scratch_checkpoint(spark, "dedup"))
    # stored by batch, so that a batch reads its own rows and those of the one before, not all
    messages = ru.to_keyed_json(alerts(spark, sf_dir).withColumn("batch", days), keep=("event_seq", "batch"))
    messages.write.partitionBy("batch").option("compression", "zstd").parquet(chain.sent)
    sent = spark.read.schema(messages.schema).parquet(chain.sent)
    sizes = {r.batch: r["count"] for r in sent.groupBy("batch").count().collect()}
    batches = sorted(sizes)
    files = max(2, max(sizes.values(), default=0) // ROWS_A_FILE)
    for batch in [*batches, *[b + 1 for b in batches[-1:]]]:
        now, before = sent.where(F.col("batch") == batch), sent.where(F.col("batch") == batch - 1)
        deliveries = now.unionByName(now.where("event_seq % 2 = 0")).unionByName(before.where("event_seq % 3 = 0"))
        deliveries.select("key", "value").repartition(files).write.mode("append").parquet(chain.alerts)
    found, _ = ch.read_alerts(consume(spark, chain.alerts, files_per_batch=files))
    publish(once_per_key(found, delay="12 days"), chain.clean, chain.clean_checkpoint).awaitTermination()
    return spark.read.schema(schemas.ALERT).parquet(chain.clean).select("alert_id", "patient_id", "severity", "timestamp_utc")


def q_stream_live_join(spark, sf_dir):
    """Accepted alerts, a stream read from their audit table, joined to the stream of recommendations within 20 seconds."""
    from wardwatch.operators.reasoning import parse_replies, recommendations
    from wardwatch.streaming import chain as ch
    from wardwatch.streaming.alert_stream import scratch_checkpoint
    from wardwatch.streaming.cooldown_state import drain_cooldown
    from wardwatch.streaming.topic import consume

    chain = ch.Chain(scratch_checkpoint(spark, "live-join"))
    accepted = drain_cooldown(alert_stream(spark, sf_dir), 60, at=chain.accepted)
    replied = F.expr("timestampadd(MILLISECOND, 1000 + event_seq * 7 % 29000, timestamp_utc)")
    recs = recommendations(parse_replies(tb.model_replies(alert_stream(spark, sf_dir)).withColumn("replied", replied)), "fixture-model", "replied")
    return ch.drain_live_join(consume(spark, f"{chain.accepted}/table", accepted.schema), recs, at=chain.joined)


def q_stream_dashboard_stats(spark, sf_dir):
    """The statistics row from hourly panes that a stream of audit rows keeps up to date."""
    from wardwatch.streaming import live_state as ls
    from wardwatch.streaming.alert_stream import scratch_checkpoint

    at = scratch_checkpoint(spark, "panes")
    events = tb.triage_events_from_alerts(alert_stream(spark, sf_dir))
    ls.refresh_panes(events, at).awaitTermination()
    now = tb.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return ls.trailing_stats(spark, at, events.schema, now)


def _accepted_stream(spark, sf_dir, name):
    """The accepted alerts as a stream, read from the audit table that the streaming cooldown writes."""
    from wardwatch.streaming.alert_stream import scratch_checkpoint
    from wardwatch.streaming.cooldown_state import drain_cooldown
    from wardwatch.streaming.topic import consume

    at = scratch_checkpoint(spark, name)
    table = drain_cooldown(alert_stream(spark, sf_dir), 60, at=f"{at}/accepted")
    return consume(spark, f"{at}/accepted/table", table.schema), at


def q_stream_live_counts(spark, sf_dir):
    """live_counts_after_ack as running state: accepted alerts counted, views of the record reset them."""
    from wardwatch.streaming import live_state as ls

    taken, at = _accepted_stream(spark, sf_dir, "counts")
    views = tb.events_stream(spark, sf_dir).where("event_type = 'view'")
    acks = views.select(F.concat(F.lit("PT-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("patient_id"), F.col("ts").alias("acked_at"))
    ls.follow_counts(taken, acks, at).awaitTermination()
    return ls.current_counts(spark, at, tb.patients(spark, sf_dir))


def q_stream_live_top50(spark, sf_dir):
    """The newest 50 accepted alerts, merged micro-batch by micro-batch."""
    from wardwatch.streaming import live_state as ls

    taken, at = _accepted_stream(spark, sf_dir, "newest")
    ls.follow_newest(taken, at, 50).awaitTermination()
    return ls.newest(spark, at, taken.schema)


def _triaged(spark, sf_dir):
    """The agent chain on every accepted alert; vectors of the queries and replies of the model come from tables."""
    from wardwatch.plans.triage import triage
    from wardwatch.session import saved

    al = saved(alerts(spark, sf_dir))
    vectors = tb.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    many = vectors.agg(F.count(F.lit(1)).alias("many"))
    seq = al.select("alert_id", (F.col("event_seq") % many.scalar()).alias("vec_id"))
    replies = tb.model_replies(al).select("alert_id", "raw_reply")
    return triage(
        al, tb.patients(spark, sf_dir), tb.triage_events_from_alerts(al), tb.sops(spark, sf_dir), _sop_index(spark, sf_dir),
        embed=lambda queries: queries.join(seq, "alert_id").join(vectors, "vec_id").select("alert_id", "vec"),
        reply=lambda prompts: prompts.select("alert_id").join(replies, "alert_id"),
        model_name="stored-replies",
    )


def q_triage_recommendations(spark, sf_dir):
    return _triaged(spark, sf_dir).recommendations.select(
        "alert_id", "patient_id", "urgency_level", "confidence_score", F.size("recommended_actions").cast("bigint").alias("n_actions")
    )


def q_prompt_with_documents(spark, sf_dir):
    """The prompts of the accepted alerts, with the three fused documents in them."""
    return _triaged(spark, sf_dir).asked.select("alert_id", "n_documents", "prompt_length", "prompt_sha256")


def build() -> dict[str, Query]:
    return {
        "telemetry_valid": q_telemetry_valid,
        "telemetry_parsed": q_telemetry_parsed,
        "telemetry_rejects_by_reason": q_telemetry_rejects_by_reason,
        "rule_hits": q_rule_hits,
        "alerts": q_alerts,
        "alerts_by_severity": q_alerts_by_severity,
        "alerts_by_ward": q_alerts_by_ward,
        "alert_summary": q_alert_summary,
        "rule_labels": q_rule_labels,
        "alert_json": q_alert_json,
        "alerts_by_own_rules": q_alerts_by_own_rules,
        "lax_coercion": q_lax_coercion,
        "patient_id_normalised": q_patient_id_normalised,
        "embedding_input": q_embedding_input,
        "pipeline_counters": q_pipeline_counters,
        "cooldown_60s": q_cooldown_60s,
        "cooldown_12h": q_cooldown_12h,
        "cooldown_skipped": q_cooldown_skipped,
        "cooldown_runs": q_cooldown_runs,
        "patient_list": q_patient_list,
        "patient_list_filtered": q_patient_list_filtered,
        "patient_history": q_patient_history,
        "recent_feed_page": q_recent_feed_page,
        "recent_feed_total": q_recent_feed_total,
        "dashboard_stats": q_dashboard_stats,
        "billing_by_hospital_day": q_billing_by_hospital_day,
        "alert_patient_context": q_alert_patient_context,
        "context_misses": q_context_misses,
        "trailing_24h_count": q_trailing_24h_count,
        "patient_age": q_patient_age,
        "retrieval_query_text": q_retrieval_query_text,
        "keyword_terms": q_keyword_terms,
        "vector_top5": q_vector_top5,
        "vector_index_top5": q_vector_index_top5,
        "vector_index_recall": q_vector_index_recall,
        "keyword_top5_any": q_keyword_top5_any,
        "keyword_top5_all": q_keyword_top5_all,
        "rrf_top3": q_rrf_top3,
        "reply_parse": q_reply_parse,
        "reply_repair": q_reply_repair,
        "reply_policy": q_reply_policy,
        "prompt_text": q_prompt_text,
        "audit_insert_if_absent": q_audit_insert_if_absent,
        "corpus_incremental_load": q_corpus_incremental_load,
        "feed_envelope": q_feed_envelope,
        "feed_demux": q_feed_demux,
        "live_feed_join": q_live_feed_join,
        "live_feed_top50": q_live_feed_top50,
        "live_feed_patient": q_live_feed_patient,
        "live_counts_after_ack": q_live_counts_after_ack,
        "ward_roster": q_ward_roster,
        "feed_display": q_feed_display,
        "request_log_rollup": q_request_log_rollup,
        "request_rate_breach": q_request_rate_breach,
        "stream_alerts": q_stream_alerts,
        "stream_cooldown": q_stream_cooldown,
        "stream_triage_chain": q_stream_triage_chain,
        "stream_dedup": q_stream_dedup,
        "stream_live_join": q_stream_live_join,
        "stream_dashboard_stats": q_stream_dashboard_stats,
        "stream_live_counts": q_stream_live_counts,
        "stream_live_top50": q_stream_live_top50,
        "triage_recommendations": q_triage_recommendations,
        "prompt_with_documents": q_prompt_with_documents,
    }
