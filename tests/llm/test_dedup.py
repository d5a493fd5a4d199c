"""Exact and near duplicates against brute force, and the edge cases of both."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from wardwatch.llm import exact_dedup, simhash_golay

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, `Rank` int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "d", 1) for i, t in rows], SCHEMA)


EDGE = [(1, None), (2, ""), (None, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (4, "x " * 90_000), (5, " \t"), (6, "one"), (6, "ONE"), (7, "\x1c  ")]


def brute_print(text):
    words = [w for w in (text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_classes(rows, bits=3):
    prints = [brute_print(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                at[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(root(i), []).append(d)
    return [(d, prints[i], min((x for x in low[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def some_texts(seed, n=120):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = (rng.choice(rows)[1] or "w0").split(" ")
            base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.randint(1, 200)))))
    return rows


def _key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("rows", [EDGE, some_texts(1), []], ids=["edge", "copies", "empty"])
def test_near_classes(spark, rows):
    got = [(r.doc_id, r.print & (2**64 - 1), r.component_id) for r in simhash_golay.near_classes(_docs(spark, rows)).collect()]
    want = brute_classes(rows)
    assert sorted(got, key=_key) == sorted(want, key=_key)
    for limit in (200_000, 0):
        kept = simhash_golay.drop_near(_docs(spark, rows), broadcast_rows=limit)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "digest", "Rank"]
        kept = [r.doc_id for r in kept.collect()]
        roots = {c: d for d, _, c in want}
        assert sorted(kept, key=lambda x: (x is None, x or 0)) == sorted(roots, key=lambda x: (x is None, x or 0))


@pytest.mark.parametrize("block", [4, 50, 4096])
def test_links_connect_like_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    prints = set(rng.integers(-(2**63), 2**63, 40).tolist())
    for p in list(prints):  # chains and clusters of words one to three bits apart
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                p ^= (1 << b) if b < 63 else -(2**63)
            prints.add(p)
    center = rng.integers(0, 2**62)
    prints |= {int(center) ^ 1 << int(b) for b in range(60)}
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    edges = {(r.src, r.dst) for r in simhash_golay.links(df, block=block).collect()}
    m = 2**64 - 1
    assert all(((a ^ b) & m).bit_count() <= 3 and a != b for a, b in edges)
    at = {p: p for p in prints}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        at[root(a)] = root(b)
    todo = sorted(prints)
    for i, a in enumerate(todo):
        for b in todo[:i]:
            if ((a ^ b) & m).bit_count() <= 3:
                assert root(a) == root(b)


def test_golay_is_perfect():
    home, near, start = simhash_golay.golay_keys()
    assert home.max() < 4096 and np.diff(start).max() <= 6
    for w in (0, 1, 0xBEEF, 0xFFFF):
        near_w = set(near[start[w] : start[w + 1]].tolist())
        assert all(int(home[w ^ 1 << b]) in near_w for b in range(16)) and int(home[w]) in near_w


@pytest.mark.parametrize("top,counters", [(2, 16), (1024, 16384)])
@pytest.mark.parametrize("rows", [EDGE, [(i, "same" if i % 3 else f"t{i % 40}") for i in range(400)], []], ids=["edge", "hot", "empty"])
def test_exact(spark, rows, top, counters):
    got = exact_dedup.mark_copies(_docs(spark, rows), top=top, counters=counters).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(d)
    best = {h: max((d for d in g if d is not None), default=None) for h, g in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == (best[r.text_sha256], len(groups[r.text_sha256]))
        assert not r.kept or r.doc_id == r.keep_id
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(groups)
    for limit in (200_000, 0):
        kept = exact_dedup.drop_copies(_docs(spark, rows), top=top, counters=counters, broadcast_groups=limit)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "digest", "Rank"]
        assert sorted(hashlib.sha256((r.text or "").encode()).hexdigest() + str(r.doc_id) for r in kept.collect()) == sorted(h + str(best[h]) for h in groups)


def test_texts_are_not_sorted(spark):
    """The rows with their texts pass hash joins only, whatever the number of groups."""
    docs = _docs(spark, [(i, f"t{i % 50}") for i in range(200)])
    for kept in (exact_dedup.drop_copies(docs), exact_dedup.drop_copies(docs, broadcast_groups=0), simhash_golay.drop_near(docs), simhash_golay.drop_near(docs, broadcast_rows=0)):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Window" not in plan and ("BroadcastHashJoin" in plan or "ShuffledHashJoin" in plan)
