"""Column-level text builders (all JVM-side expressions, no UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACEHOLDER = re.compile(r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}")


def num_text(c: Column) -> Column:
    """Shortest round-trip text of a number: ints plain, doubles like ``89.0`` / ``39.15``."""
    return c.cast("string")


def render(template: str, values: dict[str, Column]) -> Column:
    """Render ``"HR={hr} bpm"`` with ``values['hr']`` as one ``concat`` expression."""
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos : m.start()]))
        parts.append(num_text(values[m.group(1)]))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def alert_summary(severity: Column, patient_id: Column, ward: Column, bed: Column, rules: Column) -> Column:
    """``[SEV] PT-1 @ ward/bed — rule, rule``."""
    return F.concat(
        F.lit("["), severity, F.lit("] "), patient_id, F.lit(" @ "), ward, F.lit("/"), bed, F.lit(" — "),
        F.array_join(rules, ", "),
    )


def short_rule_labels(rules: Column) -> Column:
    """Text before the first colon of each rule."""
    return F.transform(rules, lambda r: F.substring_index(r, ":", 1))


def collapse_ws_trim(c: Column) -> Column:
    """Strip leading/trailing whitespace of any kind (Python ``str.strip``)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def embedding_input(title: Column, content: Column) -> Column:
    """``title + "\\n" + stripped content``."""
    return F.concat(title, F.lit("\n"), collapse_ws_trim(content))
