"""License scans against plain Python on whole tables, planted notices, and the edge cases."""

import random
import re

import pytest

from wardwatch.llm import license_scan as ls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, `Label` int"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, notices=ls.NOTICES):
    words = words_of(text)
    places, base = [], set()
    for phrase, label in BASE.items():
        said = phrase.split()
        at = [i for i in range(len(words) - len(said) + 1) if words[i : i + len(said)] == said]
        places += at
        base |= {label} if at else set()
    labels, best = set(base), 0.0
    templates = [(x, p.split(), 2, True) for p, x in BASE.items()] + [(x, words_of(t), 5, False) for x, t in notices]
    for label, said, k, phrase in templates:
        seeds = {}
        for i in range(len(words) - k + 1):
            for j in range(len(said) - k + 1):
                if words[i : i + k] == said[j : j + k]:
                    seeds.setdefault(i - j, set()).update(range(j, j + k))
        for d in seeds:
            hit = set().union(*(seeds.get(d + x, set()) for x in range(ls.DRIFT + 1)))
            best = max(best, len(hit) / len(said))
            if not phrase and len(hit) / len(said) >= ls.COVERAGE:
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best


def _check(spark, rows):
    got = ls.scan(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = [(i, *brute(t)) for i, t in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_whole_table(spark):
    _check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def _varied(seed):
    """Notices with words changed, put in and left out, among other words."""
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        text = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            said = rng.choice([*BASE, *(t for _, t in ls.NOTICES)]).split(" ")
            for _ in range(rng.choice((0, 0, 1, 3))):
                x = rng.randrange(len(said))
                said[x : x + rng.randrange(2)] = rng.choice(([], ["other"], ["cc", "by"]))
                said = said or ["the"]
            text += [rng.choice((w, w.upper())) for w in said] + ["x"] * rng.randrange(3)
        rows.append((i, rng.choice((" ", "\n", "-", " ")).join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_varied_notices(spark, seed):
    _check(spark, _varied(seed))


EDGE = [
    (1, None),
    (2, ""),
    (None, "CC BY"),
    (3, "mit license mit license"),
    (3, "mit license mit license"),
    (4, "cc by " * 60_000),
    (5, "-- \x7f\x00 #"),
    (6, "mit licenſe, mİt license, ca public license K mit é license"),
    (7, "GNU GENERAL\nPUBLIC--LICENSE"),
    (8, "apache licenses"),
    (9, "cc"),
    (10, "cc by cc by cc"),
]


def test_edges(spark):
    _check(spark, EDGE)
    assert ls.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_templates(spark):
    rows = ls.template_positions(spark).collect()
    assert all(r.full <= ls.MAX_TEMPLATE and len(r.said) == r.width for r in rows)
    with pytest.raises(ValueError):
        ls.template_positions(spark, notices=(("x", "too short"),))
