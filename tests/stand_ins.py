"""Offline stand-ins for the external models, for tests of the hooks."""

import json
import zlib
from typing import Callable

import numpy as np

def hashing_embedder(dims: int) -> Callable[[list[str]], list[list[float]]]:
    """Bag of lower-case tokens hashed (crc32) into ``dims`` signed buckets, L2-normalised."""

    def fn(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for tok in (t or "").lower().split():
                h = zlib.crc32(tok.encode())
                v[h % dims] += 1.0 if (h >> 16) & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return fn


def rule_based_replier(prompts: list[str]) -> list[str]:
    """A deterministic reply: urgency from the severity line, three ordered actions."""
    out = []
    for p in prompts:
        sev = "MEDIUM"
        for line in p.splitlines():
            if line.startswith("severity="):
                sev = line.split("=", 1)[1].strip()
        urgency = {"CRITICAL": "IMMEDIATE", "HIGH": "URGENT", "MEDIUM": "SEMI_URGENT"}.get(sev, "NON_URGENT")
        out.append(
            json.dumps(
                {
                    "urgency_level": urgency,
                    "clinical_summary": f"{sev} alert reviewed against retrieved protocols.",
                    "primary_concern": sev.lower(),
                    "recommended_actions": [
                        {"priority": i, "action": f"step {i}", "rationale": "protocol", "time_window": f"{15 * i} minutes"}
                        for i in (1, 2, 3)
                    ],
                    "contraindications": [],
                    "sops_referenced": [],
                    "confidence_score": 0.5,
                }
            )
        )
    return out
