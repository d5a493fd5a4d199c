"""Keyword search of many queries: blocks of queries against parts of the index.

A *block* is a row with the term sets of some queries, ``BLOCK_TERMS`` terms at
most; a *part* is a row with the asked postings of some documents, a shard or,
where few postings are asked, several.  Both are small compressed tables, kept
once beside the checkpoints, and a task reads the ones it needs: every block
meets every part, and nothing is copied for that into shuffle files.  Only the
best k of each query and part leave a task; with a single part they are final.

Blocks and parts hold their terms as texts, matched within a task, so that no
posting is joined to a number.  Of few asked terms the postings are read by a
pushed filter, of more the packed segments.

Within a pair of a block and a part there are two exact ways, and the cheaper
one by their counted steps is taken:

- *by prefix*: queries in the order of their terms, the most frequent first.  A
  query goes on from the scores of the terms that it shares with the one before
  and adds its other terms' postings; as scores only grow, its best k are among
  the best k before and the documents of those postings.
- *by document*: scores of all documents of the part, frequent terms by a
  product of matrices and the others by posting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wardwatch.operators.retrieval import BM25_B, BM25_K1, HITS_ROWS, RANK_DECIMALS, _lengths, _merge_topk
from wardwatch.session import cut_lineage

#: Terms of a block of queries, at least and at most; a block is closed at so many queries, too.
LEAST_TERMS, BLOCK_TERMS, BLOCK_QUERIES = 100_000, 2_000_000, 50_000
#: Asked postings of a part, and parts that a task reads.
PART_POSTINGS, TASK_PARTS = 3_000_000, 8
#: Terms that are pushed to the scan of the postings.
PUSHED_TERMS = 1000
#: Scores held at a time, weights of a part's frequent terms, and what is frequent.
HELD_SCORES, FREQUENT_WEIGHTS, FREQUENT = 500_000, 4_000_000, 1 / 8
#: Lists of so few postings are gathered at once.
SHORT_LIST = 32
#: Places of the table of queries by prefix.
PREFIX_PLACES = 16_000_000
#: Measured seconds of a step by prefix and of a posting there, of a query by document and of a document there.
STEP_S, POSTING_S, QUERY_S, DOCUMENT_S = 1e-5, 4e-9, 1e-4, 2.5e-8
#: What lies nearer to the k-th best score may round to it.
NEAR = 2 * 10.0**-RANK_DECIMALS
#: Bits of a weight after the point: sums up to 32,768 are exact, so that copies of a text score alike in whatever part and order.
WEIGHT_BITS = 38


# --- small tables as one value ---------------------------------------------------

def _packed(**columns) -> bytes:
    """Lists of any lengths as one compressed value."""
    arrays = {n: x if isinstance(x, pa.Array) else pa.array(x) for n, x in columns.items()}
    rows = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays.values()], list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(value: pa.Scalar) -> dict[str, pa.Array]:
    rows = pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks()
    return {n: rows.column(n).combine_chunks().flatten() for n in rows.column_names}


def _numpy(values: pa.Array, kind=np.int64) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


# --- blocks of queries -----------------------------------------------------------

def _blocks(block_terms: int):
    """Rows (query_id, words) as blocks, a row each."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, terms, many = 0, [], 0, 0
        task = TaskContext.get().partitionId()

        def closed() -> pa.RecordBatch:
            ids = pa.concat_arrays([h.column(0) for h in held])
            sets = pa.concat_arrays([h.column(1) for h in held])
            words = sets.flatten().dictionary_encode()
            value = _packed(ids=ids, sizes=_lengths(sets).astype(np.int32), places=words.indices, terms=words.dictionary)
            return pa.RecordBatch.from_arrays([pa.array([(task << 33) + done], pa.int64()), pa.array([value], pa.binary())], ["block", "value"])

        for batch in batches:
            edges = np.concatenate(([0], np.cumsum(_lengths(batch.column(1)))))
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(edges, edges[lo] + block_terms - terms, "right")) - 1
                hi = min(max(hi, lo + (not held)), lo + BLOCK_QUERIES - many, batch.num_rows)  # one query at least
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                    terms, many, lo = terms + int(edges[hi] - edges[lo]), many + hi - lo, hi
                if lo < batch.num_rows:
                    yield closed()
                    done, held, terms, many = done + 1, [], 0, 0
        if held:
            yield closed()

    return fn


def _asked_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, term) of the distinct terms of each block."""
    for batch in batches:
        for block, value in zip(batch.column(0), batch.column(1)):
            terms = _unpacked(value)["terms"]
            for lo in range(0, len(terms), HITS_ROWS):
                part = terms[lo : lo + HITS_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block.as_py(), np.int64)), part], ["block", "term"])


def _known_sets(match: str):
    """A block with its queries' known terms alone and the ``df`` of its terms."""

    def fn(blocks: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        terms, df = known.column("term").combine_chunks(), known.column("df").combine_chunks()
        for block, value in zip(blocks.column("block"), blocks.column("value")):
            rows = _unpacked(value)
            sizes = _numpy(rows["sizes"])
            query = np.repeat(np.arange(len(sizes)), sizes)
            places = _places(rows["terms"], terms)[_numpy(rows["places"])]
            there = places >= 0
            kept = np.bincount(query[there], minlength=len(sizes))
            stays = kept > 0
            if match == "all":
                stays &= (kept == sizes) & ~rows["ids"].is_null().to_numpy(zero_copy_only=False)
            there &= stays[query]
            if there.any():
                value = _packed(ids=rows["ids"].filter(pa.array(stays)), sizes=kept[stays].astype(np.int32), places=places[there].astype(np.int32), terms=terms, df=df)
                out.append((block.as_py(), value))
        return pa.Table.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([v for _, v in out], pa.binary())], ["block", "value"])

    return fn


def _places(terms: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of each term among others, or -1."""
    return pc.fill_null(pc.index_in(terms, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


# --- parts of the index ----------------------------------------------------------

def packed_postings(ids: pa.Array, length: np.ndarray, terms: pa.Array, sizes: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """Postings of some documents: ``at`` and ``n`` by term; ``sizes`` how many a term has."""
    return _packed(ids=ids, length=length.astype(np.int32), terms=terms, sizes=sizes.astype(np.int32), at=at.astype(np.int32), n=n.astype(np.int32))


def _joined(ids: pa.Array, length: np.ndarray, terms: pa.Array, sizes: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Table:
    """A part of the postings of some segments; terms may come more than once, documents without any or without an id are left out."""
    code = terms.dictionary_encode()
    number = np.repeat(_numpy(code.indices), sizes)
    kept = ~ids.is_null().to_numpy(zero_copy_only=False)[at]
    number, at, n = number[kept], at[kept], n[kept]
    order = np.argsort(number, kind="stable")
    docs = np.flatnonzero(np.bincount(at, minlength=len(ids)))
    place = np.zeros(len(ids), np.int32)
    place[docs] = np.arange(len(docs))
    value = packed_postings(ids.take(pa.array(docs)), length[docs], code.dictionary, np.bincount(number, minlength=len(code.dictionary)), place[at[order]], n[order])
    return pa.Table.from_arrays([pa.array([value] if len(docs) else [], pa.binary())], ["postings"])


def _part(rows: pa.Table) -> pa.Table:
    """A part of rows of the index."""
    rows = rows.combine_chunks()
    column = lambda name: rows.column(name).combine_chunks()
    term, segment = column("term"), column("segment").to_numpy()
    is_head = term.is_null().to_numpy(zero_copy_only=False)
    heads, lists = np.flatnonzero(is_head), np.flatnonzero(~is_head)
    heads = heads[np.argsort(segment[heads])]
    of = lambda name, at: column(name).take(pa.array(at))
    sizes = _lengths(of("n", heads))
    base = np.cumsum(sizes) - sizes
    start = base[np.searchsorted(segment[heads], segment[lists])] if len(heads) else np.zeros(0, np.int64)
    many = _lengths(of("at", lists))
    at = _numpy(of("at", lists).flatten()) + np.repeat(start, many)
    return _joined(of("ids", heads).flatten(), _numpy(of("n", heads).flatten()), of("term", lists), many, at, _numpy(of("n", lists).flatten(), np.int32))


def _part_of_segments(rows: pa.Table) -> pa.Table:
    """A part of whole segments."""
    found = [_unpacked(x) for x in rows.column("packed")]
    base = np.cumsum([0, *[len(x["ids"]) for x in found]])
    of = lambda name, kind: np.concatenate([_numpy(x[name], kind) for x in found])
    at = np.concatenate([_numpy(x["at"], np.int32) + np.int32(b) for x, b in zip(found, base)])
    return _joined(pa.concat_arrays([x["ids"] for x in found]), of("length", np.int32), pa.concat_arrays([x["terms"] for x in found]), of("sizes", np.int64), at, of("n", np.int32))


# --- a block against a part ------------------------------------------------------

class _Part:
    def __init__(self, value: pa.Scalar, avgdl: float) -> None:
        rows = _unpacked(value)
        self.ids, self.terms = rows["ids"], rows["terms"]
        self.order = pc.sort_indices(self.ids).to_numpy().astype(np.int64)  # documents are numbered by their ids
        rank = np.empty(len(self.order), np.int64)
        rank[self.order] = np.arange(len(rank))
        self.many = _numpy(rows["sizes"])
        at, n = _numpy(rows["at"]), _numpy(rows["n"]).astype(float)
        self.tf = n * (BM25_K1 + 1) / (n + BM25_K1 * (1 - BM25_B + BM25_B * _numpy(rows["length"])[at] / avgdl))
        self.at = rank[at]


class _Asked:
    """A block's queries against a part: ``slots`` of all queries' terms one after another, cut at ``starts``, and the postings' weights."""

    def __init__(self, block: dict[str, pa.Array], part: _Part, n_docs: int) -> None:
        sizes, df = _numpy(block["sizes"]), _numpy(block["df"]).astype(float)
        of = _places(block["terms"], part.terms)
        slots = of[_numpy(block["places"])]
        query = np.repeat(np.arange(len(sizes)), sizes)
        self.query, self.slots = query[slots >= 0], slots[slots >= 0]
        self.sizes = np.bincount(self.query, minlength=len(sizes))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.whole = self.sizes == sizes
        idf = np.zeros(len(part.terms))
        idf[of[of >= 0]] = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))[of >= 0]
        self.many, self.edge = part.many, np.concatenate(([0], np.cumsum(part.many)))
        self.weight = np.ldexp(np.rint(np.ldexp(np.repeat(idf, self.many) * part.tf, WEIGHT_BITS)), -WEIGHT_BITS)
        self.at, self.n_docs = part.at, len(part.ids)


def _by_prefix(asked: _Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(queries in the order of their terms, terms by query as a table padded with -1, terms shared with the query before), or None if that costs more."""
    n, width = len(asked.sizes), int(asked.sizes.max(initial=0))
    if not width or n * width > PREFIX_PLACES:
        return None
    by_df = np.argsort(-asked.many, kind="stable")
    rank = np.empty(len(by_df), np.int64)
    rank[by_df] = np.arange(len(by_df))
    ranks = rank[asked.slots]
    order = np.lexsort((ranks, asked.query))
    table = np.full((n, width), -1, np.int32)
    table[asked.query, np.arange(len(asked.query)) - asked.starts[asked.query]] = ranks[order]
    queries = np.lexsort(table.T[::-1])
    table = table[queries]
    shared = np.zeros(n, np.int64)
    same = (table[1:] == table[:-1]) & (table[1:] >= 0)
    shared[1:] = np.logical_and.accumulate(same, axis=1).sum(1)
    new = (np.arange(width) >= shared[:, None]) & (table >= 0)
    cost = STEP_S * new.sum() + POSTING_S * asked.many[by_df[table[new]]].sum()
    if cost > n * (QUERY_S + DOCUMENT_S * asked.n_docs):
        return None
    return queries, np.where(table >= 0, by_df[table], -1), shared


def _better(best: list, scores: np.ndarray, docs: np.ndarray, k: int) -> list:
    """The best k of ``best`` and of documents with new, higher scores; places are (-rounded score, document, score)."""
    if len(scores) > 4 * k:
        first = np.lexsort((docs, -np.round(scores, RANK_DECIMALS)))[:k]
        scores, docs = scores[first], docs[first]
    new = [(-r, d, s) for r, d, s in zip(np.round(scores, RANK_DECIMALS).tolist(), docs.tolist(), scores.tolist())]
    again = {x[1] for x in new}
    return sorted([x for x in best if x[1] not in again] + new)[:k]


def _prefix_search(asked: _Asked, plan: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    queries, table, shared = plan
    scores = np.zeros(asked.n_docs)
    edges, at, weight = asked.edge.tolist(), asked.at, asked.weight
    sizes, following = asked.sizes[queries].tolist(), np.append(shared[1:], 0).tolist()
    undo: list = []  # (documents, their scores before) of each term applied
    best: list = [[]]
    found_q, found_d, found_s = [], [], []
    for query, row, size, common, ahead in zip(queries.tolist(), table.tolist(), sizes, shared.tolist(), following):
        while len(undo) > common:
            docs, before = undo.pop()
            scores[docs] = before
        del best[common + 1 :]
        for depth in range(common, size):
            lo, hi = edges[row[depth]], edges[row[depth] + 1]
            docs = at[lo:hi]
            before = scores[docs]
            now = before + weight[lo:hi]
            top = best[-1]
            if len(top) < k:
                if len(now) > 4 * k:  # the k best of them bound the rest
                    near = np.flatnonzero(now >= np.partition(now, -k)[-k] - NEAR)
                else:
                    near = np.arange(len(now))
            else:
                near = (now >= -top[-1][0] - NEAR).nonzero()[0]
            best.append(_better(top, now[near], docs[near], k) if len(near) else top)
            if depth < max(ahead, size - 1):  # more terms of this query, or the next one, go on from here
                scores[docs] = now
                undo.append((docs, before))
        for _, doc, score in best[-1]:
            found_q.append(query)
            found_d.append(doc)
            found_s.append(score)
    return np.array(found_q, np.int64), np.array(found_d, np.int64), np.array(found_s, float)


def _document_search(asked: _Asked, k: int, match: str, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``floor``: scores that k documents of each query reach already."""
    n_docs, n = asked.n_docs, len(asked.sizes)
    frequent = np.argsort(-asked.many, kind="stable")[: FREQUENT_WEIGHTS // max(1, n_docs)]
    frequent = frequent[asked.many[frequent] >= FREQUENT * n_docs] if match == "any" else frequent[:0]
    place = np.full(len(asked.many), -1)
    place[frequent] = np.arange(len(frequent))
    weights = np.zeros((len(frequent), n_docs))
    for row, slot in enumerate(frequent.tolist()):
        cut = slice(asked.edge[slot], asked.edge[slot + 1])
        weights[row, asked.at[cut]] = asked.weight[cut]
    at, weight, edge, many = asked.at, asked.weight, asked.edge, asked.many
    lists = np.flatnonzero((many >= SHORT_LIST) & (place < 0))
    place_of = np.full(len(many), -1)
    place_of[lists] = np.arange(len(lists))
    cuts = [slice(a, b) for a, b in zip(edge[lists].tolist(), edge[lists + 1].tolist())]
    ats, weighs = [at[c] for c in cuts], [weight[c] for c in cuts]
    found, step = [], max(1, HELD_SCORES // max(1, n_docs))
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        own = slice(asked.starts[lo], asked.starts[hi])
        slots, query = asked.slots[own], asked.query[own] - lo
        is_row, is_list = place[slots] >= 0, place_of[slots] >= 0
        asks = np.zeros((hi - lo, len(frequent)))
        asks[query[is_row], place[slots[is_row]]] = 1
        scores = asks @ weights
        short, its_query = slots[~is_row & ~is_list], query[~is_row & ~is_list]
        sizes = many[short]
        ends = np.cumsum(sizes)
        near = np.repeat(edge[short] - ends + sizes, sizes) + np.arange(sizes.sum())
        docs, weighed = at[near], weight[near]
        ends = np.searchsorted(np.repeat(its_query, sizes), np.arange(hi - lo + 1)).tolist()
        long = place_of[slots[is_list]].tolist()
        bounds = np.searchsorted(query[is_list], np.arange(hi - lo + 1)).tolist()
        for i in range(hi - lo):
            of, own = long[bounds[i] : bounds[i + 1]], slice(ends[i], ends[i + 1])
            its_docs = np.concatenate([docs[own], *[ats[j] for j in of]])
            scores[i] += np.bincount(its_docs, np.concatenate([weighed[own], *[weighs[j] for j in of]]), minlength=n_docs)
            if match == "all":
                scores[i][(np.bincount(its_docs, minlength=n_docs) < asked.sizes[lo + i]) | ~asked.whole[lo + i]] = 0
        least = floor[lo:hi] - NEAR
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and n_docs > k:  # not k of them yet: the k best of these scores bound them
            least[new] = np.partition(scores[new], -k, axis=1)[:, -k] - NEAR
        least = np.where(least > 0, least, np.finfo(float).tiny)
        q, d = np.nonzero(scores >= least[:, None])
        found.append((q + lo, d, scores[q, d]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _best_hits(hits: list[tuple], n: int, k: int) -> tuple[tuple, np.ndarray]:
    """The best k hits of each query among hits (query, id, score), with their ranks, and the score that the k-th reaches."""
    query, score = (np.concatenate([h[i] for h in hits]) for i in (0, 2))
    ids = pa.concat_arrays([h[1] for h in hits])
    number = np.empty(len(ids), np.int64)
    number[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((number, -np.round(score, RANK_DECIMALS), query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    order, place = order[place < k], place[place < k]
    floor = np.full(n, -np.inf)
    floor[query[order[place == k - 1]]] = np.round(score, RANK_DECIMALS)[order[place == k - 1]]
    return (query[order], ids.take(pa.array(order)), score[order], place + 1), floor


def _crossed(k: int, match: str, n_docs: int, avgdl: float, schema: pa.Schema):
    """Rows (block, value, postings): the best k of each query of a block in the parts that follow each other."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, best, floor = None, None, None, None

        def closed() -> Iterator[pa.RecordBatch]:
            if best is not None:
                query, ids, score, rank = best
                for lo in range(0, len(query), HITS_ROWS):
                    cut = slice(lo, lo + HITS_ROWS)
                    yield pa.RecordBatch.from_arrays([block["ids"].take(pa.array(query[cut])), ids[cut], pa.array(score[cut]), pa.array(rank[cut].astype(np.int32))], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != number:
                    yield from closed()
                    number, block, best = batch.column(0)[i].as_py(), _unpacked(batch.column(1)[i]), None
                    floor = np.full(len(block["sizes"]), -np.inf)
                part = _Part(batch.column(2)[i], avgdl)
                asked = _Asked(block, part, n_docs)
                plan = _by_prefix(asked) if match == "any" else None
                query, doc, score = _prefix_search(asked, plan, k) if plan else _document_search(asked, k, match, floor)
                hits = [(query, part.ids.take(pa.array(part.order[doc])), score)]
                best, floor = _best_hits([best[:3], *hits] if best else hits, len(floor), k)
        yield from closed()

    return fn


# --- the search ------------------------------------------------------------------

def search_blocks(asked: DataFrame, index, k: int, match: str) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` of the queries ``asked`` (query_id, words: their distinct terms)."""
    if asked.groupBy("query_id").count().where("count > 1").limit(1).count():  # rows with equal ids are one query
        asked = asked.select("query_id", F.explode("words").alias("word")).groupBy("query_id").agg(F.collect_set("word").alias("words"))
    few = [r.term for r in asked.select(F.explode("words").alias("term")).distinct().limit(PUSHED_TERMS + 1).collect()]
    by_term = len(few) <= PUSHED_TERMS
    lists = index.postings.where("term IS NOT NULL")
    if by_term:
        lists = lists.where(F.col("term").isin(few))
    postings = lists.agg(F.sum("df")).first()[0] or 0
    parts = min(index.shards, max(1, math.ceil(postings / PART_POSTINGS)))
    key = F.pmod("shard", F.lit(parts)).alias("part")
    if by_term:
        rows = index.postings.where(F.col("term").isNull() | F.col("term").isin(few)).select(key, "segment", "term", "at", "n", "ids")
        packed = rows.groupBy("part").applyInArrow(_part, "postings binary")
    else:
        packed = index.postings.where("term IS NULL").select(key, "packed").groupBy("part").applyInArrow(_part_of_segments, "postings binary")
    spread = max(1, math.ceil(parts / TASK_PARTS))
    packed = cut_lineage(packed.repartition(spread))

    tasks = 3 * asked.sparkSession.sparkContext.defaultParallelism
    size = asked.agg(F.sum(F.greatest(F.size("words"), F.lit(0)))).first()[0] or 0
    block_terms = min(BLOCK_TERMS, max(LEAST_TERMS, math.ceil(size * spread / tasks)))
    raw = cut_lineage(asked.where("size(words) > 0").mapInArrow(_blocks(block_terms), "block long, value binary"))
    known = raw.mapInArrow(_asked_terms, "block long, term string").join(lists.groupBy("term").agg(F.sum("df").alias("df")), "term")
    blocks = raw.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_known_sets(match), "block long, value binary")
    blocks = cut_lineage(blocks.repartitionByRange(max(1, raw.count()), "block"))

    kind, of = index.postings.schema["ids"].dataType.elementType, asked.schema["query_id"].dataType
    struct = T.StructType([T.StructField("query_id", of), T.StructField("doc_id", kind), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    schema = pa.schema([("query_id", to_arrow_type(of)), ("doc_id", to_arrow_type(kind)), ("score", pa.float64()), ("rank", pa.int32())])
    pairs = blocks.hint("shuffle_replicate_nl").crossJoin(packed)
    hits = pairs.mapInArrow(_crossed(k, match, index.n_docs, index.avgdl, schema), struct)
    return hits if parts <= TASK_PARTS else _merge_topk(hits.drop("rank"), k)
