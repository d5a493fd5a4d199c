"""The filter audit against plain Python over all orders, and the matrix behind it."""

import itertools
import random
import re
import sys
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest

from wardwatch.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, lang string, codes string, `Part` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, "en", "x", 1) for i, t, s in rows], SCHEMA).repartition(parts)


def _labels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, kept string")


def brute(rows, labels):
    good, bad = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {f for f, hit in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text))) if hit}
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            fails.add("E")
        docs.append((source or "", fails, i in good, i in bad))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                all_ = [d for d in docs if d[0] == part and f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), len(all_) - len(gone), sum(d[1] == {f} for d in all_), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def _some(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1]
        else:
            text = rng.choice([" ", "\n", "\t \x0b", "\x1c"]).join(rng.choices([f"w{k}" for k in range(rng.choice((20, 300)))] + ["WORD", "é", "a#b", "\x85"], k=rng.randint(0, 120)))
        rows.append((rng.choice((i, i, i, i // 2)), text, rng.choice(("a", "b", "", None))))
    return rows


EDGE = [(1, None, "a"), (2, "", "a"), (None, "", "a"), (None, "x y", None), (3, "x y", ""), (3, "x y", "b"), (4, "Word " * 90_000, "b"), (5, " \t\n", "b"), (5, "A#", "b"), (9, "x y", "b")]


@pytest.mark.parametrize("rows", [EDGE, _some(1), _some(2)], ids=["edge", "some", "more"])
@pytest.mark.parametrize("shard_bytes", [200, 8_000_000])
def test_like_plain_python(spark, rows, shard_bytes):
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 150, 3)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (4, None, None)]
    got = filter_audit.audit(_docs(spark, rows), _labels(spark, labels), shard_bytes=shard_bytes).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(got) == 600 * len({s or "" for _, _, s in rows})
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == brute(rows, labels)


def test_no_rows(spark):
    assert filter_audit.audit(_docs(spark, []), _labels(spark, [])).collect() == []


@pytest.mark.parametrize("code_bits", [63, 4])
def test_matrix_holds_all_words(spark, code_bits):
    """Also where many words have the same code."""
    rows = _some(3)
    dictionary, shards = filter_audit.document_term_matrix(_docs(spark, rows), shard_bytes=2000, code_bits=code_bits)
    words = {r.code: bytes(r.word).decode() for r in dictionary.collect()}
    assert len(set(words.values())) == len(words) == dictionary.count()
    found = []
    for s in shards.collect():
        for i, (a, b) in enumerate(zip(s.bounds, s.bounds[1:])):
            found.append((s.doc_id[i], Counter({words[s.codes[c]]: n for c, n in zip(s.columns[a:b], s.counts[a:b])})))
    key = lambda x: (x[0], sorted(x[1].items()))
    assert sorted(found, key=key) == sorted(((i, Counter(WORD.findall(t or ""))) for i, t, _ in rows), key=key)


def test_words_cost_no_python_step_each(monkeypatch):
    """A text's words are counted and numbered in a few calls, however many distinct ones it has."""
    monkeypatch.setattr(filter_audit, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [" ".join(f"w{j}" for j in range(i, i + 500)).encode() for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "part": ["a"] * 20, "digest": texts, "points": [len(t) for t in texts], "text": texts})
    calls = Counter()
    sys.setprofile(lambda frame, event, _: calls.update([event]))
    try:
        out = list(filter_audit._shards(iter([batch]), 1 << 20, 63))
    finally:
        sys.setprofile(None)
    assert [len(x.column("columns")[0]) for x in out] == [20 * 500] and len(out[0].column("vocabulary")[0]) == 519
    assert sum(calls.values()) < 5000
