"""Retrieval: fusion golden rows, cosine and BM25 top-k against brute force."""

import dataclasses
import math
import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from wardwatch.operators import keyword_blocks as kb
from wardwatch.operators import keyword_index as ki
from wardwatch.operators import retrieval as rt
from wardwatch.operators import vector_index as vi


def test_rrf_golden(spark):
    v = spark.createDataFrame([(1, d, r) for r, d in enumerate([10, 11, 12, 13, 14], 1)], "query_id long, doc_id long, rank int")
    k = spark.createDataFrame([(1, 12, 1), (1, 15, 2)], "query_id long, doc_id long, rank int")
    out = rt.rrf_fuse(v, k, 3).orderBy("rank").collect()
    assert [(r.doc_id, r.retrieval_method, r.relevance_score) for r in out] == [
        (12, "hybrid", 0.032266), (10, "vector", 0.016393), (11, "vector", 0.016129)
    ]


@pytest.mark.parametrize("block_bytes", [2000, 64 << 20])
def test_cosine_topk_matches_numpy(spark, block_bytes):
    rnd = np.random.default_rng(3)
    q = rnd.normal(size=(30, 8))
    d = rnd.normal(size=(120, 8))
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(len(q))], "query_id long, vec array<double>")
    ddf = spark.createDataFrame([(100 + j, d[j].tolist()) for j in range(len(d))], "doc_id long, vec array<double>")
    got = {}
    for r in rt.vector_topk(qdf, ddf, k=5, block_bytes=block_bytes, dims=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    sims = (q @ d.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1))
    for i in range(len(q)):
        want = [100 + j for j in np.argsort(-sims[i], kind="stable")[:5]]
        assert [doc for _, doc in sorted(got[i])] == want


def test_bm25_modes(spark):
    docs = spark.createDataFrame(
        [(1, "heart rate high heart"), (2, "oxygen low"), (3, "heart oxygen"), (4, "the of and")],
        "doc_id long, text string",
    )
    index = ki.build(docs, docs["text"], buckets=2)
    q = spark.createDataFrame([(1, "Heart oxygen"), (2, "rate")], "query_id long, text string")
    any_ = {(r.query_id, r.doc_id) for r in ki.search(q, index, 5, "any").collect()}
    all_ = {(r.query_id, r.doc_id) for r in ki.search(q, index, 5, "all").collect()}
    assert any_ == {(1, 1), (1, 2), (1, 3), (2, 1)}
    assert all_ == {(1, 3), (2, 1)}


def test_matrix_from_arrow_slices_ragged_and_null():
    import pyarrow as pa

    m = rt._matrix(pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, 4.0]]).slice(1, 2))
    assert m.tolist() == [[1.0, 2.0], [3.0, 4.0]]
    r = rt._matrix(pa.array([[1.0, 2.0], None, [3.0]]))
    assert r[0].tolist() == [1.0, 2.0] and np.isnan(r[1]).all() and r[2, 0] == 3.0 and np.isnan(r[2, 1])
    assert rt._lengths(pa.array([["a"], None, []])).tolist() == [1, 0, 0]


def test_codegen_tokenizers_agree_with_reference_filter(spark):
    from pyspark.sql import functions as F

    texts = ["The Patient, the PATIENT and a sepsis-risk: SpO2 < 90%!", "", "of the and", "Élan naïve 12 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    ref = {r.id: r.t for r in df.select("id", rt.tokens(F.col("text")).alias("t")).collect()}
    dist = {r.id: r.t for r in df.select("id", rt.distinct_tokens(F.col("text")).alias("t")).collect()}
    for i, toks in ref.items():
        assert dist[i] == list(dict.fromkeys(toks))
    exploded = {}
    for r in rt.explode_tokens(df, "id", F.col("text")).collect():
        exploded.setdefault(r.id, []).append(r.term)
    for i, toks in ref.items():
        assert sorted(exploded.get(i, [])) == sorted(toks)


def _brute_bm25(docs, queries, k, need_all):
    import re

    words = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w and w not in rt.STOP_WORDS]
    bags = {d: words(t) for d, t in docs}
    bags = {d: b for d, b in bags.items() if b}
    avg = sum(map(len, bags.values())) / len(bags)
    df = {}
    for b in bags.values():
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, t in queries:
        asked = set(words(t))
        scores = []
        for d, b in bags.items():
            hit = [w for w in asked if w in b]
            if hit and (not need_all or len(hit) == len(asked)):
                total = 0.0
                for w in hit:
                    tf = b.count(w)
                    total += math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / avg))
                scores.append((-round(total, 9), d))
        if scores:
            out[q] = [d for _, d in sorted(scores)[:k]]
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rnd.choices(vocab, weights, k=rnd.randint(0, 60)))) for i in range(500)] + [(900, None), (901, "the of"), (902, "w1 " * 5000), (903, "w7"), (904, "w7")]
    queries = [(f"q{i}", " ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 8)))) for i in range(60)] + [("none", ""), ("null", None), ("new", "unheard of"), ("part", "w1 unheard"), ("doc", docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return docs, queries, ki.build(df, F.col("text"), block_docs=16, buckets=3)


@pytest.mark.parametrize("match,prune", [("any", False), ("any", True), ("all", False)])
def test_index_like_brute_force(spark, corpus, match, prune):
    docs, queries, index = corpus
    asked = spark.createDataFrame(queries, "query_id string, text string")
    got = {}
    for r in ki.search(asked, index, 5, match, prune).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.doc_id
    assert {q: [x[i] for i in sorted(x)] for q, x in got.items()} == _brute_bm25(docs, queries, 5, match == "all")


def test_index_paths_agree(spark, corpus, monkeypatch):
    """Query sets too large to broadcast or to push, and seeds of any number, give the same answer."""
    _, queries, index = corpus
    asked = spark.createDataFrame(queries, "query_id string, text string")
    want = sorted((r.query_id, r.rank, r.doc_id) for r in ki.search(asked, index).collect())
    for seeds in (1, 7):
        assert sorted((r.query_id, r.rank, r.doc_id) for r in ki.search(asked, index, prune=True, seed_blocks=seeds).collect()) == want
    monkeypatch.setattr(ki, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(ki, "PUSHED_TERMS", 3)
    assert sorted((r.query_id, r.rank, r.doc_id) for r in ki.search(asked, index).collect()) == want


def test_scores_are_not_shuffled(spark, corpus):
    """A document's terms are added up in its bucket: the only exchange is that of the best k."""
    _, queries, index = corpus
    plan = ki.search(spark.createDataFrame(queries, "query_id string, text string"), index)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan and "SelectedBucketsCount" in plan


def _cloud(seed, n, dims=16, groups=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims))
    return centers[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, dims))


@pytest.mark.parametrize("cell_rows,query_rows", [(4096, 1024), (30, 7)])
def test_vector_index(spark, cell_rows, query_rows):
    d, q = _cloud(1, 1500), _cloud(1, 1700)[1500:]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0, 2.0]), (5005, [2.0, 1.0])]
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(d)] + odd, "doc_id long, vec array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)] + [("none", None), ("zero", [0.0] * 16), ("two", [1.0, 1.9]), ("three", [1.0, 1.0, 1.0])], "query_id string, vec array<double>")
    index = vi.build(docs, cell_rows=cell_rows)
    assert index.vectors.count() == 1502 and index.vectors.groupBy("cell", "part").count().agg(F.max("count")).first()[0] <= max(cell_rows * 2, 60) + (4096 if cell_rows > 1000 else 0)
    found, exact = vi.search(asked, index, 5, query_rows=query_rows), rt.vector_topk(asked, docs, 5)
    got = vi.recall(found, exact).first()
    assert got.n_queries == 201 and got.n_exact == 1002 and got.recall >= 0.9
    scores = {(r.query_id, r.doc_id): r.score for r in exact.collect()}
    assert all(abs(scores[r.query_id, r.doc_id] - r.score) < 1e-9 for r in found.collect() if (r.query_id, r.doc_id) in scores)
    every = vi.search(asked, index, 5, probes=10**6, query_rows=query_rows)  # all cells: the exact answer
    assert sorted((r.query_id, r.rank, r.doc_id) for r in every.collect()) == sorted((r.query_id, r.rank, r.doc_id) for r in exact.collect())


def test_vectors_unseen_by_the_sample(spark):
    """Lengths that the sample does not hold are filed and found all the same."""
    d = _cloud(2, 60)
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(d)] + [(100 + i, [float(i), 1.0]) for i in range(40)], "doc_id long, vec array<double>")
    index = vi.build(docs, sample=1)
    assert index.vectors.count() == 100
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(50 + i, x.tolist()) for i, x in enumerate(d[:5])], "query_id long, vec array<double>")
    got = {r.query_id: r.doc_id for r in vi.search(asked, index, 1).collect()}
    assert got == {**{i: 100 + i for i in range(5)}, **{50 + i: i for i in range(5)}}
    empty = vi.build(docs.limit(0))
    assert vi.search(asked, empty, 3).collect() == []


def test_best_k_of_any_number_of_scores():
    """K places a query are held however many scores come; ties go to the smaller id, what isn't finite has no score."""
    rng = np.random.default_rng(8)
    scores, ids = rng.integers(0, 6, (40, 300)) / 5.0, rng.permutation(300)
    scores[rng.random(scores.shape) < 0.2] = np.nan
    scores[3], scores[4, :297] = np.nan, -np.inf
    best = rt._Best(40, 5)
    for lo in range(0, 300, 7):
        rows = rng.permutation(40)
        best.add(rows, scores[rows, lo : lo + 7], ids[lo : lo + 7])
    got = {}
    for q, d, s in zip(*best.rows()):
        got.setdefault(int(q), []).append((-float(s), int(d)))
    want = {q: sorted((-s, int(d)) for s, d in zip(row, ids) if np.isfinite(s))[:5] for q, row in enumerate(scores.tolist())}
    assert {q: x for q, x in want.items() if x} == got and best.ids.shape == (40, 5)


@pytest.mark.parametrize("block_bytes", [300, 64 << 20])
def test_queries_with_equal_vectors_or_ids(spark, block_bytes):
    """equal vectors are one search, each query gets its rows; rows with equal ids share k places."""
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 8)], "doc_id long, vec array<double>")
    asked = [("a", [1.0, 1.0]), ("b", [1.0, 1.0]), ("c", [7.0, 1.0]), ("c", [7.0, 1.0]), ("d", [5.0, 1.0]), ("d", [1.0, 1.0])]
    rows = rt.vector_topk(spark.createDataFrame(asked, "query_id string, vec array<double>"), docs, 2, block_bytes).collect()
    got = sorted((r.query_id, r.rank, r.doc_id) for r in rows)
    assert got == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 2), ("c", 1, 7), ("c", 2, 7), ("d", 1, 1), ("d", 2, 5)]


def test_vector_blocks_are_not_held_as_rows(spark):
    """a pair of blocks is a group of two tables, not a row with two lists of vectors."""
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "query_id long, vec array<double>")
    plan = rt.vector_topk(rows, rows.withColumnRenamed("query_id", "doc_id"), 3, block_bytes=500)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan


def test_index_search_sends_a_query_once_per_shard(spark, monkeypatch):
    """However many cells are probed, a query goes to each shard once."""
    d = _cloud(4, 600)
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(d)], "doc_id long, vec array<double>")
    index = vi.build(docs, cells=60, cell_rows=5)
    asked = docs.withColumnRenamed("doc_id", "query_id")
    want = sorted((r.query_id, r.rank, r.doc_id) for r in rt.vector_topk(asked, docs, 3).collect())
    monkeypatch.setattr(vi, "BLOCK_BYTES", 30_000)
    for probes in (3, 60):
        found = vi.search(asked, index, 3, probes=probes)
        assert "shard" in found._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.query_id, r.rank, r.doc_id) for r in found.collect())
        assert len({r[0] for r in rows}) == 600 and (probes == 3 or rows == want)


def test_postings_stay_with_their_documents(spark):
    """a segment holds a term once; a document in several rows and partitions, or without an id, counts once."""
    texts = [(1, "pulse oxygen pulse"), (2, "oxygen"), (None, "pulse low"), (1, "low pulse"), (None, "oxygen oxygen"), (3, "of the")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    index = ki.build(docs, F.col("text"), buckets=2)
    rows = index.postings.collect()
    assert (index.n_docs, index.avgdl) == (3, (5 + 1 + 4) / 3)
    assert sum(r.df for r in rows if r.term == "oxygen") == 3 and sum(sum(r.n) for r in rows if r.term == "pulse") == 4
    assert len({(r.segment, r.term) for r in rows}) == len(rows)
    got = [(r.query_id, r.doc_id, r.rank) for r in ki.search(spark.createDataFrame([("a", "Pulse oxygen"), ("b", "oxygen pulse"), (None, "pulse")], "query_id string, text string"), index).collect()]
    assert sorted(got, key=str) == sorted([("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 2), (None, 1, 1)], key=str)


@pytest.mark.parametrize("match,way,parts", [("any", "prefix", 1), ("any", "document", 3), ("all", "document", 3)])
def test_blocks_of_queries_against_parts(spark, corpus, monkeypatch, match, way, parts):
    """Many queries meet the index block by block, by either way and over any number of parts, with the same rows."""
    docs, queries, index = corpus
    queries = queries + [("twice", "w1 w5"), ("twice", "w9 w5"), (None, "w3 w4")]
    asked = spark.createDataFrame(queries, "query_id string, text string").repartition(3)
    hits = lambda rows: {(r.query_id, r.rank, r.doc_id): r.score for r in rows.collect()}
    want = hits(ki.search(asked, index, 5, match))
    monkeypatch.setattr(ki, "BROADCAST_SCORES", 0)
    monkeypatch.setattr(kb, "BLOCK_TERMS", 100)
    monkeypatch.setattr(kb, "TASK_PARTS", 2)
    monkeypatch.setattr(kb, "PART_POSTINGS", 10**9 if parts == 1 else 1)
    monkeypatch.setattr(kb, "PUSHED_TERMS", 5 if parts == 1 else 1000)
    index = dataclasses.replace(index, shards=8) if parts == 1 else index
    if way == "document":
        monkeypatch.setattr(kb, "PREFIX_PLACES", 0)
    got = kb.search_blocks(asked.select("query_id", rt.distinct_tokens(F.col("text")).alias("words")), index, 5, match)
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()
    assert hits(got) == pytest.approx(want, abs=1e-9) and got.count() == len(want)


def test_ways_of_a_block_agree():
    """By prefix and by document find the same documents, with ties, in a part of documents in any order."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    held = rng.random((40, 300)) < rng.random((40, 1)) ** 3
    held[:, 200:] = held[:, :100]  # copies
    term, doc = np.nonzero(held)
    n, ids = 1 + (term + doc % 100) % 3, rng.permutation(300)
    value = kb._packed(ids=pa.array(ids), length=(50 + np.arange(300) % 100).astype(np.int32), terms=pa.array([f"t{i}" for i in range(40)]), sizes=held.sum(1).astype(np.int32), at=doc.astype(np.int32), n=n.astype(np.int32))
    sets = [np.flatnonzero(rng.random(42) < rng.choice([0.03, 0.2, 0.6])) for _ in range(200)]
    sets = [s for s in sets if len(s)] + [np.array([3, 5]), np.array([3, 5]), np.array([41])]
    block = {n: pa.array(x) for n, x in {"ids": np.arange(len(sets)), "sizes": [len(s) for s in sets], "places": np.concatenate(sets), "terms": [f"t{i}" for i in range(42)], "df": np.append(held.sum(1), [9, 9])}.items()}
    part = kb._Part(pa.scalar(value), 60.0)
    asked = kb._Asked(block, part, 300)
    plan = kb._by_prefix(asked)
    assert plan is not None

    def best(found):
        (query, ids, score, rank), _ = kb._best_hits([(found[0], part.ids.take(pa.array(part.order[found[1]])), found[2])], len(sets), 5)
        return list(zip(query.tolist(), rank.tolist(), ids.to_pylist(), score.tolist()))  # sums are exact, so copies score alike by either way

    want = best(kb._document_search(asked, 5, "any", np.full(len(sets), -np.inf)))
    assert best(kb._prefix_search(asked, plan, 5)) == want and len(want) > 500


def test_documents_go_once_to_a_group(spark):
    """queries share the texts of their documents by group; ids that are missing, null or there twice give the rows of a plain join."""
    docs = spark.createDataFrame([(i, f"t{i}", "c", f"text {i}") for i in range(6)] + [(3, "again", "c", "more"), (None, "x", "c", "none")], "id long, title string, category string, content string")
    hits = [(f"q{q}", d, r, 1.0 / r, "vector") for q in range(40) for r, d in enumerate([q % 6, 3 if q % 6 != 3 else 4, 90 + q], 1)] + [("lost", 77, 1, 1.0, "keyword"), ("null", None, 1, 1.0, "keyword")]
    fused = spark.createDataFrame(hits, "query_id string, doc_id long, rank int, relevance_score double, retrieval_method string")
    joined = fused.join(docs.withColumnRenamed("id", "doc_id"), "doc_id").collect()
    want = {}
    for r in joined:
        want.setdefault(r.query_id, []).append((r.rank, r.title, r.category, r.content, r.relevance_score, r.retrieval_method))
    want = {q: sorted(x) for q, x in want.items()}
    for rows in (1, 7, 512):
        found = rt.attach_documents(fused, docs, group_rows=rows)
        assert {r.query_id: [tuple(x) for x in r.retrieved_sops] for r in found.collect()} == want
    asked = spark.createDataFrame([(f"q{q}", q) for q in range(41)] + [("lost", 50), ("null", 51), (None, 52), ("q0", 53)], "query_id string, n long")
    got = rt.attach_documents(fused, docs, asked)
    assert got.columns == ["query_id", "n", "retrieved_sops"]
    assert sorted((r.n, [tuple(x) for x in r.retrieved_sops or []]) for r in got.collect()) == sorted((r.n, want.get(r.query_id, [])) for r in asked.collect())


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """query vectors beyond the broadcast are told apart first, also where two of them have one key; blocks hold each once."""
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 8)], "doc_id long, vec array<double>")
    asked = spark.createDataFrame([(f"q{i}", [float(1 + i % 3), 1.0]) for i in range(60)] + [("none", None), ("q0", [7.0, 1.0])], "query_id string, vec array<double>")
    want = sorted((r.query_id, r.rank, r.doc_id) for r in rt.vector_topk(asked, docs, 2).collect())
    for same_key in (False, True):
        if same_key:
            monkeypatch.setattr(rt, "_vector_key", lambda: F.lit(1))
        numbered, members = rt._distinct_vectors(asked)
        assert numbered.count() == 4 and members.count() == 61
        assert sorted((r.query_id, r.rank, r.doc_id) for r in rt.vector_topk(asked, docs, 2, block_bytes=100).collect()) == want
