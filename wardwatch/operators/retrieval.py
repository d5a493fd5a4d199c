"""Hybrid document retrieval: cosine top-k, BM25 top-k, reciprocal rank fusion
(X03-X10, F09, J04-J06, J09, A13, A14, W02, W03, T04-T06).

Vector search here is exact: documents are scored where they lie against
broadcast queries (or, for query sets that are too large, block by block),
and only the best k of each partition leave a task.  ``vector_index`` holds
the search on a stored index, ``keyword_index`` the keyword search.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardwatch import schemas
from wardwatch.operators.validate import parse_once
from wardwatch.session import saved, ship_package

# --- FIXED VALUES: retrieval parameters --------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
RANK_DECIMALS = 9  # scores are compared at this precision so ties are engine-independent
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
    "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they",
    "this", "to", "was", "will", "with",
]

def _hits_schema(qtype: T.DataType) -> tuple[T.StructType, pa.Schema]:
    """Output of a scoring task; the query id keeps the caller's type (long or string)."""
    st = T.StructType(
        [
            T.StructField("query_id", qtype),
            T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    qa = pa.string() if isinstance(qtype, T.StringType) else pa.int64()
    return st, pa.schema([("query_id", qa), ("doc_id", pa.int64()), ("score", pa.float64())])


# --- text -------------------------------------------------------------------

def _words(text: Column) -> Column:
    return F.split(F.lower(text), TOKEN_SPLIT)


def _is_token(word: Column) -> Column:
    return (F.length(word) > 0) & ~word.isin(STOP_WORDS)


def tokens(text: Column) -> Column:
    """Lower-case word tokens without English stop words (no stemming).

    A lambda ``filter`` is evaluated interpreted (outside whole-stage
    codegen); the hot paths below use ``explode_tokens`` / ``distinct_tokens``.
    """
    return F.filter(_words(text), _is_token)


def explode_tokens(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, term)`` per token occurrence: explode, then a codegen'd ``IN`` filter."""
    return df.select(F.col(key), F.explode(_words(text)).alias("term")).where(_is_token(F.col("term")))


def distinct_tokens(text: Column) -> Column:
    """Distinct tokens in first-occurrence order (``array_except`` removes duplicates)."""
    return F.array_except(_words(text), F.array(*[F.lit(w) for w in STOP_WORDS + [""]]))


def query_text(rules: Column, vitals: Column, severity: Column) -> Column:
    """Retrieval query built from an alert: the severity, what fired, then the readings."""
    readings = [
        ("pulse", vitals["heart_rate_bpm"]), ("systolic", vitals["systolic_bp_mmhg"]), ("diastolic", vitals["diastolic_bp_mmhg"]),
        ("oxygen", vitals["spo2_percent"]), ("breathing", vitals["respiratory_rate_rpm"]), ("temperature", vitals["temperature_celsius"]),
    ]
    parts = [x for name, value in readings for x in (F.lit(f"; {name} "), value.cast("string"))]
    return F.concat(F.lower(severity), F.lit(" care for "), F.array_join(rules, " and "), *parts)


def keyword_terms(rules: Column) -> Column:
    """Whitespace words of the rule texts longer than four characters, joined `` | ``."""
    words = F.flatten(F.transform(rules, lambda r: F.split(r, r"\s+")))
    return F.array_join(F.filter(words, lambda w: F.length(w) > 4), " | ")


# --- the best k ----------------------------------------------------------------

def _merge_topk(hits: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", RANK_DECIMALS)), F.asc("doc_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- Arrow -> numpy without per-element Python objects ------------------------

def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(vecs: pa.Array) -> np.ndarray:
    """Rows of a ``list<double>`` array as a dense float64 matrix (NaN-padded if ragged or null)."""
    lens = _lengths(vecs)
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    width = int(lens.max()) if len(lens) else 0
    if vecs.null_count == 0 and (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.full((len(lens), width), np.nan)
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    for r in np.flatnonzero(lens):
        out[r, : lens[r]] = flat[starts[r] : starts[r] + lens[r]]
    out[np.asarray(vecs.is_null().to_numpy(zero_copy_only=False))] = np.nan
    return out


# --- vector search -------------------------------------------------------------

MAX_CELLS = 4_000_000  # dense score cells per sub-batch (32 MB of float64)


#: Rows of hits that a task hands over at a time.
HITS_ROWS = 100_000


class _Best:
    """The k best (rounded score desc, document asc) of ``n`` queries, as arrays: 24 k bytes a query, however many scores are seen."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.rounded = np.full((n, k), -np.inf)
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.zeros((n, k), np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (len(rows) x len(ids)) of the queries ``rows``, each given once; what isn't finite has no score."""
        if not scores.size:
            return
        if not np.isfinite(scores).all():
            scores = np.where(np.isfinite(scores), scores, -np.inf)
        least = self.rounded[rows, -1]
        if scores.shape[1] > self.k and np.isneginf(least).any():  # not k of them yet: the k best of these scores bound it
            new = np.flatnonzero(np.isneginf(least))
            least[new] = np.maximum(least[new], np.partition(scores[new], -self.k, axis=1)[:, -self.k])
        near = np.where(np.isneginf(least), np.finfo(float).min, least - 2 * 10.0**-RANK_DECIMALS)
        q, d = np.nonzero(scores >= near[:, None])  # all that may round to a place among the k best
        if not len(q):
            return
        exact, found, at = scores[q, d], ids[d], rows[q]
        rounded = np.round(exact, RANK_DECIMALS)
        worst, last = self.rounded[at, -1], self.ids[at, -1]
        better = (rounded > worst) | ((rounded == worst) & (found < last))
        touched = np.unique(at[better])
        if not len(touched):
            return
        q = np.concatenate([at[better], np.repeat(touched, self.k)])
        rounded = np.concatenate([rounded[better], self.rounded[touched].ravel()])
        found = np.concatenate([found[better], self.ids[touched].ravel()])
        exact = np.concatenate([exact[better], self.scores[touched].ravel()])
        order = np.lexsort((found, -rounded, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = order[place < self.k]
        self.rounded[touched] = rounded[kept].reshape(-1, self.k)
        self.ids[touched] = found[kept].reshape(-1, self.k)
        self.scores[touched] = exact[kept].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of all that was found."""
        q, place = np.nonzero(np.isfinite(self.rounded))
        return q, self.ids[q, place], self.scores[q, place]


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _score_into(best: _Best, places: np.ndarray, queries: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> None:
    """Cosines of unit vectors, a bounded block of scores at a time."""
    wide = max(1, MAX_CELLS // 1024)
    for lo in range(0, len(docs), wide):
        part = docs[lo : lo + wide].T
        step = max(1, MAX_CELLS // part.shape[1])
        for a in range(0, len(queries), step):
            with np.errstate(invalid="ignore", over="ignore"):
                best.add(places[a : a + step], queries[a : a + step] @ part, ids[lo : lo + wide])


def _against(k: int, chunks, schema: pa.Schema):
    """Best k of a partition for the broadcast queries (numbered), batch by batch."""

    def fn(batches):
        best = [_Best(len(qm), k) for _, _, qm in chunks.value]
        for b in batches:
            vecs, ids = b.column("vec"), b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            lens = _lengths(vecs)
            for (width, _, qm), found in zip(chunks.value, best):
                at = np.flatnonzero(lens == width)
                if len(at):
                    _score_into(found, np.arange(len(qm)), qm, _unit(_matrix(vecs.take(pa.array(at)))), ids[at])
        for (_, numbers, _), found in zip(chunks.value, best):
            q, d, s = found.rows()
            for lo in range(0, len(q), HITS_ROWS):
                part = slice(lo, lo + HITS_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[q[part]]), pa.array(d[part]), pa.array(s[part])], schema=schema)

    return fn


def _pair(k: int, schema: pa.Schema):
    """Best k of a block of documents for a block of queries."""

    def fn(queries: pa.Table, docs: pa.Table) -> pa.Table:
        parts = []
        q, d = queries.column("vec").combine_chunks(), docs.column("vec").combine_chunks()
        ids = docs.column("doc_id").to_numpy().astype(np.int64)
        q_len, d_len = _lengths(q), _lengths(d)
        # a cosine is defined between vectors of one length only, so each length is scored by itself
        for width in np.intersect1d(q_len[q_len > 0], d_len[d_len > 0]):
            q_at, d_at = np.flatnonzero(q_len == width), np.flatnonzero(d_len == width)
            best = _Best(len(q_at), k)
            _score_into(best, np.arange(len(q_at)), _unit(_matrix(q.take(pa.array(q_at)))), _unit(_matrix(d.take(pa.array(d_at)))), ids[d_at])
            places, found, scores = best.rows()
            parts.append(pa.Table.from_arrays([queries.column("query_id").take(pa.array(q_at[places])), pa.array(found), pa.array(scores)], names=schema.names).cast(schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return fn


def _bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.coalesce(F.size("vec"), F.lit(0)).cast("long") * 8 + 16)).first()[0] or 0


def _vector_key() -> Column:
    return F.xxhash64("vec")


def _distinct_vectors(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec) of the distinct vectors, numbered, and (query_id, number) of the queries that have them."""
    keyed = asked.where("size(vec) > 0").withColumn("key", _vector_key())
    numbered = saved(keyed.select("key", "vec").distinct().withColumn("number", F.monotonically_increasing_id()))
    found = numbered.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("key").alias("keys")).first()
    on = ["key"] if found["keys"] == found["vectors"] else ["key", "vec"]  # two vectors with one key are told apart by themselves
    members = saved(keyed.join(numbered.select("number", *on), on).select("query_id", "number"))
    return numbered.select(F.col("number").alias("query_id"), "vec"), members


def _blocked(queries: DataFrame, docs: DataFrame, n_q: int, n_d: int, of_q: str = "query_id", of_d: str = "doc_id"):
    """Queries and documents grouped by all pairs of their blocks: a block is copied, a pair is not held by anything but its task."""
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_q", F.pmod(F.xxhash64(of_q), F.lit(n_q)).cast("int")).withColumn("_d", span(n_d))
    right = docs.withColumn("_d", F.pmod(F.xxhash64(of_d), F.lit(n_d)).cast("int")).withColumn("_q", span(n_q))
    return left.groupBy("_q", "_d").cogroup(right.groupBy("_q", "_d"))


def vector_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    block_bytes: int = 64 << 20,
    dims: int = 768,
    distinct: bool = False,
) -> DataFrame:
    """T04/X07, exact: ``queries(query_id, vec)`` x ``docs(doc_id, vec)`` -> ``(query_id, doc_id, score, rank)``.

    Queries that fit ``block_bytes`` are broadcast, equal ones as one, and the
    documents are scored where they lie: one pass, no shuffle but that of the
    best k of each partition.  Of more queries equal ones are taken as one first
    (unless they are known to be ``distinct``); if that isn't enough, they meet
    the documents block by block;
    a task holds one block of each, half of ``block_bytes`` at most, so its
    memory doesn't grow with either table.  Blocks are sized by the vectors'
    own lengths (``dims`` is kept for callers that give it).
    Vectors of different lengths, empty, null and zero vectors have no cosine:
    such pairs get no score, whatever block their rows fall into.
    """
    spark = queries.sparkSession
    ship_package(spark)
    st, ar = _hits_schema(queries.schema["query_id"].dataType)
    asked = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    size = _bytes(asked)
    if size > block_bytes and not distinct:
        numbered, members = _distinct_vectors(asked)
        found = vector_topk(numbered, rows, k, block_bytes, dims, distinct=True).withColumnRenamed("query_id", "number")
        hits = found.join(members, "number").select("query_id", "doc_id", "score", "rank")
        twice = members.groupBy("query_id").count().where("count > 1").limit(1).count()
        return _merge_topk(hits.drop("rank"), k) if twice else hits  # rows with equal ids share their k places
    if size > block_bytes:
        n_q, n_d = (max(1, math.ceil(2 * x / block_bytes)) for x in (size, _bytes(rows)))
        return _merge_topk(_blocked(asked, rows, n_q, n_d).applyInArrow(_pair(k, ar), st), k)
    table = asked.toArrow()
    vecs, ids = table.column("vec").combine_chunks(), table.column("query_id").combine_chunks()
    lens = _lengths(vecs) if len(ids) else np.zeros(0, np.int64)
    chunks, members, n = [], [], 0
    for width in np.unique(lens[lens > 0]).tolist():
        at = np.flatnonzero(lens == width)
        unit = _unit(_matrix(vecs.take(pa.array(at))))
        _, first, like = np.unique(unit.view(np.dtype((np.void, unit.itemsize * width))).ravel(), return_index=True, return_inverse=True)
        chunks.append((width, n + np.arange(len(first)), unit[first]))
        members.append((n + like.ravel(), at))
        n += len(first)
    of = np.concatenate([m for m, _ in members]) if members else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(n + 1))
    shared = spark.sparkContext.broadcast(chunks)
    askers = spark.sparkContext.broadcast((starts, ids.take(pa.array(np.concatenate([a for _, a in members])[order] if members else of))))
    number, numbered = _hits_schema(T.LongType())
    best = _merge_topk(rows.mapInArrow(_against(k, shared, numbered), number), k)

    def named(batches):
        """A hit of a vector for each query that has it."""
        for b in batches:
            starts, ids = askers.value
            q = b.column("query_id").to_numpy()
            many = starts[q + 1] - starts[q]
            for lo, hi in _cuts(many):
                row = np.repeat(np.arange(lo, hi), many[lo:hi])
                own = np.arange(len(row)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
                kept = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts[q[row]] + own)), *kept.columns[1:]], names=kept.schema.names)

    hits = best.mapInArrow(named, T.StructType([*st.fields, T.StructField("rank", T.IntegerType())]))
    alone = len(ids) == pc.count_distinct(ids, mode="all").as_py()
    return hits if alone else _merge_topk(hits.drop("rank"), k)  # rows with equal ids share their k places


def _cuts(sizes: np.ndarray):
    """(from, to) of runs of rows that give about ``HITS_ROWS`` rows each."""
    if len(sizes):
        part = np.cumsum(sizes) // HITS_ROWS
        edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]))
        yield from zip(edges[:-1].tolist(), edges[1:].tolist())


#: Queries that share one copy of their documents' texts.
GROUP_ROWS = 512


# --- fusion -----------------------------------------------------------------------

def rrf_fuse(vector_hits: DataFrame, keyword_hits: DataFrame, k_final: int = 3, rrf_k: int = schemas.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists per query.

    Ties keep the order of a stable sort over "vector hits by rank, then
    keyword-only hits by rank".
    """
    v = vector_hits.select("query_id", "doc_id", F.col("rank").alias("v_rank"), F.lit(None).cast("int").alias("k_rank"))
    kw = keyword_hits.select("query_id", "doc_id", F.lit(None).cast("int").alias("v_rank"), F.col("rank").alias("k_rank"))
    u = v.unionByName(kw).repartition("query_id")  # the sum and the ranks need no other exchange
    term = 1.0 / (F.lit(rrf_k) + F.coalesce(F.col("v_rank"), F.col("k_rank")))
    g = u.groupBy("query_id", "doc_id").agg(
        F.sum(term).alias("rrf"), F.min("v_rank").alias("v_rank"), F.min("k_rank").alias("k_rank")
    )
    method = (
        F.when(F.col("v_rank").isNotNull() & F.col("k_rank").isNotNull(), "hybrid")
        .when(F.col("v_rank").isNotNull(), "vector")
        .otherwise("keyword")
    )
    w = W.partitionBy("query_id").orderBy(
        F.desc(F.round("rrf", RANK_DECIMALS)), F.asc_nulls_last("v_rank"), F.asc("k_rank")
    )
    return (
        g.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k_final)
        .select("query_id", "doc_id", "rank", F.round("rrf", 6).alias("relevance_score"), method.alias("retrieval_method"))
    )


def attach_documents(fused: DataFrame, docs: DataFrame, onto: DataFrame | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per query the fused documents as an ordered ``array<struct>``, by themselves or as a column of ``onto`` (which has ``query_id``).

    Queries in the order of their documents are cut into groups, and a
    document goes once to each group that has it, not once to each query: the
    texts that move are those of the documents, not those of all answers.
    """
    hit = F.struct("rank", "doc_id", "relevance_score", "retrieval_method")
    hits = saved(fused.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits")))
    ordered = hits.repartitionByRange("hits").sortWithinPartitions("hits")
    hits = saved(ordered.withColumn("_group", F.floor(F.monotonically_increasing_id() / group_rows)))
    most = hits.agg(F.max(F.size("hits"))).first()[0] or 0

    wanted = hits.select("_group", F.explode(F.col("hits.doc_id")).alias("doc_id")).distinct()
    texts = wanted.join(docs.select(F.col("id").alias("doc_id"), F.struct("title", "category", "content").alias("copy")), "doc_id").repartition("_group")
    texts = texts.groupBy("_group", "doc_id").agg(F.collect_list("copy").alias("copies"))
    texts = texts.groupBy("_group").agg(F.collect_list(F.struct("doc_id", "copies")).alias("_texts"))

    rows = hits if onto is None else onto.join(hits, "query_id", "left")
    alone = -1 - F.pmod(F.xxhash64("query_id"), F.lit(1 << 20))  # rows without documents are no group
    rows = rows.withColumn("_group", F.coalesce("_group", alone)).join(texts, "_group", "left")
    found = []
    for i in range(most):
        own = F.get("hits", F.lit(i))
        place = F.array_position(F.col("_texts.doc_id"), own["doc_id"]).cast("int") - 1
        found.append(F.struct(own.alias("hit"), F.get("_texts", F.when(place >= 0, place))["copies"].alias("copies")))
    # a step of its own, so that a row takes its own documents out of its group's and nothing else is copied
    rows = parse_once(rows, F.array(*found), "_found").drop("hits", "_group", "_texts")
    sops = F.flatten(F.transform(
        F.filter("_found", lambda x: x["copies"].isNotNull()),
        lambda x: F.transform(x["copies"], lambda d: F.struct(
            x["hit"]["rank"].alias("rank"), d["title"].alias("title"), d["category"].alias("category"), d["content"].alias("content"),
            x["hit"]["relevance_score"].alias("relevance_score"), x["hit"]["retrieval_method"].alias("retrieval_method"),
        )),
    ))
    rows = parse_once(rows, F.array_sort(sops), "retrieved_sops").drop("_found")
    if onto is None:
        return rows.where("size(retrieved_sops) > 0")
    return rows.withColumn("retrieved_sops", F.when(F.size("retrieved_sops") > 0, F.col("retrieved_sops")))
