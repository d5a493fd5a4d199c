"""Threshold rule table and alert construction.

Rules are rows of a table; evaluating them is one projection that stays in
whole-stage codegen: an ``array`` of ``CASE WHEN`` texts filtered for
non-null, a severity ``CASE`` over compound flags, and a ``where`` that drops
normal readings right away.  No shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch import schemas
from wardwatch.functions.text import alert_summary, render

Vitals = Callable[[str], Column]  # vital name -> Column
Predicate = Callable[[Vitals], Column]


@dataclass(frozen=True)
class Criterion:
    when: Predicate
    template: str  # text of this criterion when it is met (count rules)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str  # "simple" | "all" | "at_least"
    when: Predicate | None = None  # simple / all
    template: str = ""  # rendered with vitals (+ {n} for at_least)
    severity: str | None = None  # compound rules carry a severity
    criteria: tuple[Criterion, ...] = field(default_factory=tuple)
    min_met: int = 0

    @property
    def compound(self) -> bool:
        return self.kind != "simple"


# --- FIXED VALUES: rule thresholds and texts --------------------------------
# Placeholders: {hr} heart rate, {sbp} systolic, {dbp} diastolic, {spo2},
# {rr} respiratory rate, {t} temperature, {n} number of criteria met.
# Compound rules are evaluated (and listed) before simple rules.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        "R8", "all",
        when=lambda v: (v("heart_rate_bpm") > 100) & (v("systolic_bp_mmhg") < 100) & (v("spo2_percent") < 95.0),
        template="R8 SHOCK PATTERN: HR={hr} bpm, SBP={sbp} mmHg, SpO2={spo2}%",
        severity="CRITICAL",
    ),
    Rule(
        "R9", "at_least",
        template="R9 SIRS ({n}/3 criteria): ",
        severity="HIGH",
        criteria=(
            Criterion(lambda v: (v("temperature_celsius") > 38.0) | (v("temperature_celsius") < 36.0), "Temp={t}°C"),
            Criterion(lambda v: v("heart_rate_bpm") > 90, "HR={hr} bpm"),
            Criterion(lambda v: v("respiratory_rate_rpm") > 20, "RR={rr} rpm"),
        ),
        min_met=2,
    ),
    Rule("R1", "simple", when=lambda v: v("heart_rate_bpm") > 110, template="R1 Tachycardia: HR={hr} bpm (threshold >110)"),
    Rule("R2", "simple", when=lambda v: v("heart_rate_bpm") < 45, template="R2 Bradycardia: HR={hr} bpm (threshold <45)"),
    Rule("R3", "simple", when=lambda v: v("spo2_percent") < 94.0, template="R3 Hypoxia: SpO2={spo2}% (threshold <94%)"),
    Rule("R4", "simple", when=lambda v: v("systolic_bp_mmhg") < 90, template="R4 Hypotension: SBP={sbp} mmHg (threshold <90)"),
    Rule(
        "R5", "simple", when=lambda v: v("systolic_bp_mmhg") > 180,
        template="R5 Hypertensive Crisis: SBP={sbp} mmHg (threshold >180)",
    ),
    Rule("R6", "simple", when=lambda v: v("respiratory_rate_rpm") > 22, template="R6 Tachypnea: RR={rr} rpm (threshold >22)"),
    Rule("R7", "simple", when=lambda v: v("temperature_celsius") > 38.3, template="R7 Fever: Temp={t}°C (threshold >38.3)"),
)

_SHORT = {
    "hr": "heart_rate_bpm",
    "sbp": "systolic_bp_mmhg",
    "dbp": "diastolic_bp_mmhg",
    "spo2": "spo2_percent",
    "rr": "respiratory_rate_rpm",
    "t": "temperature_celsius",
}


def _accessor(vitals_col: str) -> Vitals:
    return lambda name: F.col(vitals_col)[name]


def _values(v: Vitals) -> dict[str, Column]:
    return {k: v(n) for k, n in _SHORT.items()}


def rule_fired(rule: Rule, v: Vitals) -> Column:
    if rule.kind == "at_least":
        met = [F.when(c.when(v), 1).otherwise(0) for c in rule.criteria]
        total = met[0]
        for m in met[1:]:
            total = total + m
        return total >= rule.min_met
    return rule.when(v)


def rule_text(rule: Rule, v: Vitals) -> Column:
    vals = _values(v)
    if rule.kind == "at_least":
        met_texts = [F.when(c.when(v), render(c.template, vals)) for c in rule.criteria]
        met = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in met_texts[1:]), F.when(met_texts[0].isNotNull(), 1).otherwise(0))
        return F.concat(render(rule.template, {**vals, "n": met}), F.concat_ws(", ", *met_texts))
    return render(rule.template, vals)


def _ordered(rules: tuple[Rule, ...]) -> list[Rule]:
    # compound rules first (table order), then simple rules (table order)
    return [r for r in rules if r.compound] + [r for r in rules if not r.compound]


def rule_texts(vitals_col: str = "vitals", rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """The text of each rule in order, null where it did not fire."""
    v = _accessor(vitals_col)
    return F.array(*[F.when(rule_fired(r, v), rule_text(r, v)) for r in _ordered(rules)])


def severity(vitals_col: str, rules_col: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """highest compound severity; else 2+ rules HIGH; else MEDIUM."""
    v = _accessor(vitals_col)
    ranks = [F.when(rule_fired(r, v), F.lit(schemas.SEVERITIES.index(r.severity))) for r in rules if r.compound]
    compound_rank = F.greatest(*ranks) if len(ranks) > 1 else (ranks[0] if ranks else F.lit(None))
    sev_by_rank = F.element_at(F.array(*[F.lit(s) for s in schemas.SEVERITIES]), compound_rank + 1)
    return (
        F.when(compound_rank.isNotNull(), sev_by_rank)
        .when(F.size(rules_col) >= 2, F.lit("HIGH"))
        .otherwise(F.lit("MEDIUM"))
    )


def alert_id(source_event_id: Column) -> Column:
    """Deterministic alert id: a redelivered event maps to the same alert (Q1)."""
    return F.sha2(F.concat(F.lit("alert|"), source_event_id), 256)


def detect_alerts(telemetry: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, keep: tuple[str, ...] = ("event_seq",)) -> DataFrame:
    """Valid telemetry -> alerts (one row per reading where a rule fired)."""
    from wardwatch.operators.validate import parse_once

    # barrier: the "any rule fired" filter must stay here, not be pushed (with the
    # whole rule array inlined) below an upstream repartition into its map side
    # the texts are a step of their own, which is compiled; the lambda over them is interpreted
    texts = parse_once(telemetry, rule_texts("vitals", rules), "_texts")
    with_rules = parse_once(texts, F.filter("_texts", lambda x: x.isNotNull()), "_rules")
    extra = [c for c in keep if c in telemetry.columns]
    return (
        with_rules.where(F.size("_rules") > 0)  # normal readings leave here
        .select(
            alert_id(F.col("event_id")).alias("alert_id"),
            F.col("event_id").alias("source_event_id"),
            "patient_id",
            "hospital_id",
            "ward",
            "bed_number",
            "timestamp_utc",
            severity("vitals", F.col("_rules"), rules).alias("severity"),
            F.col("_rules").alias("triggered_rules"),
            F.col("vitals").alias("vitals_snapshot"),
            "nursing_notes",
            *extra,
        )
    )


def rule_hits(telemetry: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Rows ``(rule_id, hits)``: one global aggregate (map-side partial counts)."""
    v = _accessor("vitals")
    agg = telemetry.agg(*[F.count_if(rule_fired(r, v)).alias(r.rule_id) for r in rules])
    return agg.unpivot([], [r.rule_id for r in rules], "rule_id", "hits")


def with_summary(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn(
        "summary",
        alert_summary(F.col("severity"), F.col("patient_id"), F.col("ward"), F.col("bed_number"), F.col("triggered_rules")),
    )


def to_keyed_json(alerts: DataFrame, key_col: str = "patient_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Kafka ``key``/``value`` pair (and the columns ``keep``); key falls back to ``unknown``; nulls kept."""
    cols = [c for c in schemas.ALERT.fieldNames() if c in alerts.columns]
    return alerts.select(
        F.coalesce(F.col(key_col), F.lit("unknown")).alias("key"),
        F.to_json(
            F.struct(*cols),
            {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
        ).alias("value"),
        *keep,
    )
