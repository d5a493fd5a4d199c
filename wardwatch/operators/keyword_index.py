"""Stored inverted index for keyword search.

The index is built once and searched many times.  Documents are indexed where
they lie: a task counts the words of some thousand documents and writes them as
a *segment*, so no posting is ever shuffled.  One table is written, bucketed
by ``shard`` (some segments of together about ``SHARD_DOCS`` documents):

- a row per segment and term: ``at`` the documents, by number within the
  segment, that hold it, ``n`` how often, ``df`` how many they are;
- a row per segment without a term: ``ids`` its documents, ``n`` their lengths,
  ``packed`` the whole segment once more, for searches of many terms.

Numbers of documents and of terms' documents are sums over the segments, so a
search computes the BM25 weights itself, of its own terms alone.  It numbers
the terms of its queries, takes queries with the same known terms as one, and
scores them shard by shard where the postings lie; no score is shuffled, only
the best k of each query and shard.  That holds for queries of up to
``BROADCAST_ROWS`` terms, which are broadcast; more of them, or of the scores
of their pairs with documents, are searched by ``keyword_blocks``.

With ``prune`` the documents of a shard are put in the order of their length
and cut into blocks of ``block_docs``; a search bounds the score of any
document of a block by the sum of its terms' largest weights there, scores the
best ``seed_blocks`` blocks of each query to learn a score that k documents
reach, and then only the blocks whose bound reaches it too.  The result is the
same and exact.  It pays for few short queries; ``keyword_blocks`` has a way of
its own for many.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardwatch.operators.keyword_blocks import packed_postings, search_blocks
from wardwatch.operators.retrieval import BM25_B, BM25_K1, STOP_WORDS, _Best, _lengths, _merge_topk, _words, distinct_tokens
from wardwatch.session import cut_lineage, ensure_checkpoint_dir, saved, ship_package

BLOCK_DOCS = 64
SEED_BLOCKS = 2
#: Documents of a shard; a segment is closed at so many, or at so many postings.
SHARD_DOCS, SEGMENT_POSTINGS, MAX_BUCKETS = 4096, 4_000_000, 4096
#: Documents whose words are counted at a time.
COUNTED_DOCS = 512
#: Bounds are sums of doubles in another order than the scores.
ROUNDING = 1e-6
#: Query terms that are broadcast (16 bytes each) and scores that are worked out one by one; more go to ``keyword_blocks``.
BROADCAST_ROWS, BROADCAST_SCORES = 2_000_000, 200_000_000
#: Rows with texts (terms, ids) that are broadcast to a join.
BROADCAST_TEXTS = 200_000
#: Distinct terms that are pushed to the scan of the postings as a filter.
PUSHED_TERMS = 1000
#: Scores that are held at a time, and weights of a shard's frequent terms.
HELD_SCORES, FREQUENT_WEIGHTS = 1_000_000, 2_000_000
#: A term in so large a part of a shard's documents is added up as a row of a matrix.
FREQUENT = 1 / 16


@dataclass(frozen=True)
class KeywordIndex:
    """An index: its bucketed postings by table name, the folder of its files, and the numbers of its corpus."""

    spark: SparkSession
    path: str
    table: str
    shards: int
    block_docs: int
    n_docs: int
    avgdl: float

    @property
    def postings(self) -> DataFrame:
        return self.spark.table(self.table)


def _segment(held: list, ids: list, kind: pa.DataType, shard: int, segment: int) -> Iterator[pa.RecordBatch]:
    """The rows of a segment from (document, word, count, words) of its batches; documents without words are left out."""
    n_docs, terms = len(ids), pa.concat_arrays([h[3] for h in held]).dictionary_encode()
    codes, first = terms.indices.to_numpy().astype(np.int64), 0
    keys, counts = [], []
    for doc, word, n, words in held:
        keys.append(codes[first + word] * n_docs + doc)
        counts.append(n)
        first += len(words)
    key, counts = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key, starts = np.unique(key[order], return_index=True)
    counts = np.add.reduceat(counts[order], starts)
    term, doc = key // n_docs, key % n_docs
    lengths = np.bincount(doc, counts, minlength=n_docs).astype(np.int64)
    kept = np.flatnonzero(lengths)
    doc = (np.cumsum(lengths > 0) - 1)[doc].astype(np.int32)
    listed = lambda values, kind, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values, kind))
    names = ["shard", "segment", "term", "df", "at", "n", "ids", "packed"]

    def rows(many: int, term: pa.Array, df: pa.Array, at: pa.Array, n: pa.Array, ids: pa.Array, packed: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(many, shard, np.int32)), pa.array(np.full(many, segment, np.int64)), term, df, at, n, ids, packed], names)

    numbers, starts = np.unique(term, return_index=True)
    sizes = np.diff(np.append(starts, len(term)))
    words, of = terms.dictionary.take(pa.array(numbers)), pa.array([ids[i] for i in kept], kind)
    packed = pa.array([packed_postings(of, lengths[kept], words, sizes, doc, counts)], pa.binary())
    yield rows(1, pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), listed(lengths[kept], pa.int32(), [len(kept)]), listed(of, kind, [len(kept)]), packed)
    yield rows(
        len(numbers), words, pa.array(sizes.astype(np.int64)),
        listed(doc, pa.int32(), sizes), listed(counts, pa.int32(), sizes), pa.nulls(len(numbers), pa.list_(kind)), pa.nulls(len(numbers), pa.binary()),
    )


def _segments(shards: int):
    """Segments of a partition's (doc_id, words); rows of one document follow each other."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        stop, kind = pa.array(["", *STOP_WORDS]), None
        held, ids, size, done = [], [], 0, 0

        def closed() -> Iterator[pa.RecordBatch]:
            return _segment(held, ids, kind, (task + done) % shards, (task << 33) + done)

        for batch in batches:
            for lo in range(0, batch.num_rows, COUNTED_DOCS):
                part = batch.slice(lo, COUNTED_DOCS)
                own, kind = part.column(0).to_pylist(), part.column(0).type
                if ids and (len(ids) >= SHARD_DOCS or size >= SEGMENT_POSTINGS) and own[0] != ids[-1]:
                    yield from closed()
                    held, ids, size, done = [], [], 0, done + 1
                place = np.empty(len(own), np.int64)
                for i, doc in enumerate(own):
                    if not ids or doc != ids[-1]:
                        ids.append(doc)
                    place[i] = len(ids) - 1
                words = part.column(1)
                flat = words.flatten().dictionary_encode()
                code = flat.indices.to_numpy().astype(np.int64)
                known = ~pc.is_in(flat.dictionary, stop).to_numpy(zero_copy_only=False)
                many = max(1, len(flat.dictionary))
                is_term = known[code]
                key, n = np.unique((np.repeat(place, _lengths(words)) * many + code)[is_term], return_counts=True)
                held.append((key // many, key % many, n, flat.dictionary))
                size += len(key)
        if held:
            yield from closed()

    return fn


def build(docs: DataFrame, text: Column, path: str | None = None, block_docs: int = BLOCK_DOCS, buckets: int | None = None) -> KeywordIndex:
    """Index ``docs`` (doc_id and what ``text`` needs) at ``path``, by default a fresh folder beside the checkpoints.

    Rows with equal ids are one document; only if there are any are the texts shuffled.
    """
    spark = docs.sparkSession
    ship_package(spark)
    name = f"keyword_postings_{uuid.uuid4().hex}"
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    rows = docs.select("doc_id", text.alias("text"))
    many, most = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if most and most > 1:
        rows = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    shards = buckets or max(1, min(MAX_BUCKETS, math.ceil((many or 0) / SHARD_DOCS)))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()),
        T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(kind)), T.StructField("packed", T.BinaryType()),
    ])
    found = rows.select("doc_id", _words(F.col("text")).alias("words")).mapInArrow(_segments(shards), schema)
    # more buckets than shards, so that few shards share one
    found.write.option("path", f"{path}/postings").bucketBy(buckets or min(MAX_BUCKETS, 4 * shards), "shard").saveAsTable(name)
    heads = spark.table(name).where("term IS NULL").select(F.size("ids").alias("docs"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))
    corpus = heads.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n_docs = corpus["docs"] or 0
    return KeywordIndex(spark, path, name, shards, block_docs, n_docs, (corpus["words"] or 0) / max(1, n_docs))


def _sized(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


class _Shard:
    """The asked terms' postings of a shard: ``at`` and ``weight`` by term, and within it by document."""

    def __init__(self, rows: pa.Table, n_docs: int, avgdl: float, block_docs: int | None) -> None:
        rows = rows.combine_chunks()
        column = lambda name: rows.column(name).combine_chunks()
        tid, segment = column("tid"), column("segment").to_numpy()
        is_head = tid.is_null().to_numpy(zero_copy_only=False)
        heads, lists = np.flatnonzero(is_head), np.flatnonzero(~is_head)
        heads = heads[np.argsort(segment[heads])]
        of = lambda name, at: column(name).take(pa.array(at))
        self.ids = of("ids", heads).flatten()
        length = of("n", heads).flatten().to_numpy().astype(float)
        sizes = _lengths(of("n", heads))
        base = np.cumsum(sizes) - sizes
        tids = tid.take(pa.array(lists)).to_numpy(zero_copy_only=False).astype(np.int64)
        start = base[np.searchsorted(segment[heads], segment[lists])] if len(heads) else np.zeros(0, np.int64)
        order = np.lexsort((start, tids))
        lists, tids, start = lists[order], tids[order], start[order]
        many = _lengths(of("at", lists))
        at = of("at", lists).flatten().to_numpy().astype(np.int64) + np.repeat(start, many)
        n = of("n", lists).flatten().to_numpy().astype(float)
        df = of("df", lists).to_numpy(zero_copy_only=False).astype(float)
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        weight = np.repeat(idf, many) * n * (BM25_K1 + 1) / (n + BM25_K1 * (1 - BM25_B + BM25_B * length[at] / avgdl))
        self.tids, slot = np.unique(tids, return_inverse=True)
        slot = np.repeat(slot, many)
        self.n_blocks, self.block_docs = 0, block_docs
        if block_docs:  # the documents by length, so that blocks have like weights
            by_length = np.argsort(length, kind="stable")
            self.ids = self.ids.take(pa.array(by_length))
            place = np.empty(len(by_length), np.int64)
            place[by_length] = np.arange(len(by_length))
            at = place[at]
            order = np.lexsort((at, slot))
            slot, at, weight = slot[order], at[order], weight[order]
            self.n_blocks = max(1, -(-len(self.ids) // block_docs))
            self.edges = np.searchsorted(slot * self.n_blocks + at // block_docs, np.arange(len(self.tids) * self.n_blocks + 1))
            self.tops = np.zeros((len(self.tids), self.n_blocks))
            np.maximum.at(self.tops, (slot, at // block_docs), weight)
        self.at, self.weight = at, weight
        self.edge = np.searchsorted(slot, np.arange(len(self.tids) + 1))
        self.lost = np.flatnonzero(self.ids.is_null().to_numpy(zero_copy_only=False))  # a document without an id counts, but isn't found

    def slots(self, tids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.tids, tids)
        there = at < len(self.tids)
        at, tids = at[there], tids[there]
        return at[self.tids[at] == tids]

    def score(self, slots: np.ndarray, need: int, blocks: np.ndarray | None = None) -> np.ndarray:
        """Scores of all documents; of those with fewer than ``need`` of the terms, or in none of the ``blocks``, minus infinity."""
        if blocks is None:
            cuts = [slice(a, b) for a, b in zip(self.edge[slots].tolist(), self.edge[slots + 1].tolist())]
        else:
            cells = (slots[:, None] * self.n_blocks + blocks).ravel()
            cuts = [slice(a, b) for a, b in zip(self.edges[cells].tolist(), self.edges[cells + 1].tolist()) if a < b]
        if not cuts:
            return np.full(len(self.ids), -np.inf)
        at = np.concatenate([self.at[c] for c in cuts])
        scores = np.bincount(at, np.concatenate([self.weight[c] for c in cuts]), minlength=len(self.ids))
        out = scores <= 0 if need <= 1 else np.bincount(at, minlength=len(self.ids)) < need
        scores[out] = -np.inf
        scores[self.lost] = -np.inf
        return scores

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """(slots, their weights in all documents) of the most frequent terms."""
        many = np.diff(self.edge)
        most = np.argsort(-many, kind="stable")[: FREQUENT_WEIGHTS // max(1, len(self.ids))]
        most = np.sort(most[many[most] >= FREQUENT * len(self.ids)])
        weights = np.zeros((len(most), len(self.ids)))
        for row, slot in enumerate(most.tolist()):
            cut = slice(self.edge[slot], self.edge[slot + 1])
            weights[row, self.at[cut]] = self.weight[cut]
        return most, weights

    def score_any(self, sets: list[np.ndarray], most: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """``score`` of some queries: their frequent terms by a product of matrices, the others by posting."""
        place = np.full(len(self.tids), -1)
        place[most] = np.arange(len(most))
        asks, rest = np.zeros((len(sets), len(most))), []
        for i, slots in enumerate(sets):
            at = place[slots]
            asks[i, at[at >= 0]] = 1
            rest.append(slots[at < 0])
        scores = asks @ weights
        for i, slots in enumerate(rest):
            cuts = [slice(a, b) for a, b in zip(self.edge[slots].tolist(), self.edge[slots + 1].tolist())]
            if cuts:
                scores[i] += np.bincount(np.concatenate([self.at[c] for c in cuts]), np.concatenate([self.weight[c] for c in cuts]), minlength=len(self.ids))
        scores[scores <= 0] = -np.inf
        scores[:, self.lost] = -np.inf
        return scores

    def pruned(self, slots: np.ndarray, need: int, k: int, seed_blocks: int) -> np.ndarray:
        bounds = self.tops[slots].sum(0)
        seeds = np.argsort(-bounds, kind="stable")[:seed_blocks]
        reached = np.sort(self.score(slots, need, seeds))[::-1]
        floor = reached[k - 1] if len(reached) >= k else -np.inf
        return self.score(slots, need, np.flatnonzero((bounds > 0) & (bounds >= floor - ROUNDING)))


def _scored(k: int, match: str, index: KeywordIndex, prune: bool, seed_blocks: int, schema: pa.Schema):
    n_docs, avgdl, block_docs = index.n_docs, index.avgdl, index.block_docs if prune else None

    def fn(rows: pa.Table, gids: np.ndarray, starts: np.ndarray, tids: np.ndarray) -> pa.Table:
        shard = _Shard(rows, n_docs, avgdl, block_docs) if rows.num_rows else None
        if shard is None or not len(shard.ids) or not len(gids):
            return schema.empty_table()
        order = pc.sort_indices(shard.ids).to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        best, step = _Best(len(gids), k), max(1, HELD_SCORES // len(order))
        by_matrix = match == "any" and not prune
        frequent = shard.frequent() if by_matrix else None
        for lo in range(0, len(gids), step):
            places, sets, needs = [], [], []
            for i in range(lo, min(len(gids), lo + step)):
                asked = tids[starts[i] : starts[i + 1]]
                slots = shard.slots(asked)
                if len(slots) and (match == "any" or len(slots) == len(asked)):
                    places.append(i)
                    sets.append(slots)
                    needs.append(len(asked) if match == "all" else 1)
            if not places:
                continue
            if by_matrix:
                scores = shard.score_any(sets, *frequent)
            else:
                scores = np.stack([shard.pruned(x, need, k, seed_blocks) if prune else shard.score(x, need) for x, need in zip(sets, needs)])
            best.add(np.array(places), scores, rank)
        query, doc, score = best.rows()
        return pa.Table.from_arrays([pa.array(gids[query]), shard.ids.take(pa.array(order[doc])), pa.array(score)], schema=schema)

    return fn


def _term_numbers(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    sets = lists.combine_chunks()
    sizes = _lengths(sets)
    return np.concatenate(([0], np.cumsum(sizes))), sets.flatten().to_numpy().astype(np.int64)


def search(queries: DataFrame, index: KeywordIndex, k: int = 5, match: str = "any", prune: bool = False, seed_blocks: int = SEED_BLOCKS) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the best k documents of each query of ``queries`` (query_id, text).

    ``match="all"`` keeps documents with every distinct query term, ``"any"``
    those with at least one.  A query without terms, or of unknown terms
    alone, has no rows; rows with equal ids are one query.
    """
    if match not in ("any", "all"):
        raise ValueError('match is "any" or "all"')
    spark = index.spark
    ship_package(spark)
    asked = saved(queries.select("query_id", distinct_tokens(F.col("text")).alias("words")).where("size(words) > 0"))
    size = asked.agg(F.count(F.lit(1)).alias("queries"), F.sum(F.size("words")).alias("terms")).first()
    if (size["terms"] or 0) > BROADCAST_ROWS or (not prune and size["queries"] * index.n_docs > BROADCAST_SCORES):
        return search_blocks(asked, index, k, match)
    terms = asked.select("query_id", F.explode("words").alias("term"))
    wanted = cut_lineage(terms.select("term").distinct())
    pushed = [r.term for r in wanted.limit(PUSHED_TERMS + 1).collect()]
    lists = index.postings.where("term IS NOT NULL").select("term", "df")
    lists = lists.where(F.col("term").isin(pushed)) if len(pushed) <= PUSHED_TERMS else lists.join(_sized(wanted, BROADCAST_TEXTS), "term", "left_semi")
    known = cut_lineage(lists.groupBy("term").agg(F.sum("df").alias("df")).withColumn("tid", F.monotonically_increasing_id()))
    small = _sized(known, BROADCAST_TEXTS)
    asked = terms.join(small.select("term", "tid"), "term", "left").groupBy("query_id")
    sets = asked.agg(F.sort_array(F.collect_set("tid")).alias("tids"), F.max(F.col("tid").isNull()).alias("unknown")).where("size(tids) > 0")
    if match == "all":
        sets = sets.where("query_id IS NOT NULL AND NOT unknown")
    sets = cut_lineage(sets.select("query_id", "tids"))
    groups = cut_lineage(sets.select("tids").distinct().withColumn("gid", F.monotonically_increasing_id()))
    postings = index.postings
    if len(pushed) <= PUSHED_TERMS:
        postings = postings.where(F.col("term").isNull() | F.col("term").isin(pushed))
    held = postings.drop("df").join(small, "term", "left").where("term IS NULL OR tid IS NOT NULL").select("shard", "segment", "tid", "df", "at", "n", "ids")

    kind = index.postings.schema["ids"].dataType.elementType
    struct = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("query_id", pa.int64()), ("doc_id", to_arrow_type(kind)), ("score", pa.float64())])
    scored = _scored(k, match, index, prune, seed_blocks, schema)
    table = groups.select("gid", "tids").toArrow()
    shared = spark.sparkContext.broadcast((table.column("gid").to_numpy(), *_term_numbers(table.column("tids"))))
    hits = held.groupBy("shard").applyInArrow(lambda rows: scored(rows, *shared.value), struct)
    best = _merge_topk(hits, k).withColumnRenamed("query_id", "gid")
    members = sets.join(_sized(groups, BROADCAST_TEXTS), "tids").select("query_id", "gid")
    return best.join(_sized(members, BROADCAST_TEXTS), "gid").select("query_id", "doc_id", "score", "rank")
