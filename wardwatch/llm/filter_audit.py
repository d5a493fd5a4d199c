"""Interaction of five text filters, from a sparse document-term matrix.

1.  Each task cuts its documents into shards of about ``SHARD_BYTES`` of text
    (at least one document) and writes each as a compressed sparse row matrix:
    a vocabulary with codes, row bounds, columns, and counts.  The shards are
    written to the shared checkpoint folder as a table.
2.  The dictionary of all shards makes the codes global.  A word's code is a
    hash of 63 bits; an aggregate over all vocabularies finds codes that more
    than one word has (told apart by a second hash of another kind), and such
    words get negative codes of their own, joined to the shards that use them.
    Only codes are shuffled, and a word once for each task that has it, so
    frequent words don't gather; the matrix itself stays where it is.
3.  A row's sum is its document's number of words, its number of stored
    entries that of distinct words; they decide the filters A and B.  C, D and
    the digest for E come with the rows: E needs the least id of each digest,
    joined to rows that are aggregated beforehand.
4.  Each part's documents are added up by the set of filters they fail (32
    sets).  All orders and steps follow from those 32 sums alone.

A: under 50 words.  B: 100 x distinct words < 65 x words.  C: 100 x capitals
(A-Z) > 5 x code points.  D: holds any of ``#$%&*|``.  E: identical to the
text of a smaller id.

Defined results: a null text counts as empty (it fails A and, beside a
smaller id without text, E); the words are maximal runs of characters that
aren't ASCII white space; a null source is the part "", together with an empty
one; a null id is neither smaller nor larger than others, so it never fails E;
rows with equal ids don't make each other fail E; of several labels of one id
the largest counts, null labels and ids don't; a table without rows has no
parts, so its audit is empty; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwatch.session import cut_lineage, ensure_checkpoint_dir

FILTERS = "ABCDE"
SIGNS = b"#$%&*|"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
#: Text of one shard; its arrays take about as much.
SHARD_BYTES = 8_000_000

_CARRIED = ("doc_id", "part", "digest")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CODE_BITS = 63


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int, code_bits: int) -> Iterator[pa.RecordBatch]:
    """One row per shard: its number, vocabulary and codes, the carried columns, C and D, and the matrix's row bounds, columns and counts."""
    task, made = TaskContext.get().partitionId(), 0
    kept: list[pa.RecordBatch] = []
    words: defaultdict[bytes, int] = defaultdict()
    words.default_factory = words.__len__  # a word not seen before gets the next column
    late, bounds, columns, counts, size = array("b"), array("q", [0]), array("i"), array("i"), 0

    def shard() -> pa.RecordBatch:
        carried = pa.Table.from_batches(kept).combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array([0, carried.num_rows], pa.int32()), c.combine_chunks()) for c in carried.columns]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        codes = (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - code_bits)).astype(np.int64)
        numbers = [codes, np.frombuffer(late, np.int8), np.frombuffer(bounds, np.int64), np.frombuffer(columns, np.int32), np.frombuffer(counts, np.int32)]
        arrays = [pa.array([(task << 33) + made], pa.int64()), one(pa.array(list(words), pa.binary())), *lists, *[one(pa.array(x)) for x in numbers]]
        return pa.RecordBatch.from_arrays(arrays, ["shard", "vocabulary", *_CARRIED, "codes", "late", "bounds", "columns", "counts"])

    for batch in batches:
        narrow, points, texts, first = batch.select(list(_CARRIED)), batch.column("points").to_pylist(), batch.column("text"), 0
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            found = Counter(text.split())  # bytes are split at ASCII white space only
            columns.extend(map(words.__getitem__, found))
            counts.extend(found.values())
            bounds.append(len(columns))
            capitals = len(text) - len(text.translate(None, _CAPITALS))
            late.append(4 * (100 * capitals > CAPITALS_PERCENT * points[i]) + 8 * (len(text.translate(None, SIGNS)) < len(text)))
            size += len(text)
            if size >= shard_bytes:
                kept.append(narrow.slice(first, i + 1 - first))
                yield shard()
                made, first, size = made + 1, i + 1, 0
                kept = []
                words.clear()
                late, bounds, columns, counts = array("b"), array("q", [0]), array("i"), array("i")
        if first < batch.num_rows:
            kept.append(narrow.slice(first))
    if kept:
        yield shard()


def document_term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_bytes: int = SHARD_BYTES, code_bits: int = CODE_BITS) -> tuple[DataFrame, DataFrame]:
    """``(dictionary, shards)``: (word, code) of all words, and the matrix's shards.

    A shard has ``codes`` (the dictionary's code of each of its columns),
    ``bounds``, ``columns`` and ``counts`` of a compressed sparse row matrix,
    and for each row the carried columns and the bits of C and D.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.length(text).alias("points"),
        text.cast("binary").alias("text"),
    )
    kinds = ", ".join(f"{c} array<{dict(rows.dtypes)[c]}>" for c in _CARRIED)
    schema = f"shard long, vocabulary array<binary>, {kinds}, codes array<long>, late array<tinyint>, bounds array<long>, columns array<int>, counts array<int>"
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/terms-{uuid.uuid4().hex}"
    rows.mapInArrow(lambda batches: _shards(batches, shard_bytes, code_bits), schema).write.parquet(at)
    shards = spark.read.schema(schema).parquet(at)
    used = shards.select("shard", F.explode(F.arrays_zip("vocabulary", "codes")).alias("w")).select("shard", F.col("w.vocabulary").alias("word"), F.col("w.codes").alias("code"))
    other = F.shiftleft(F.crc32("word"), 32).bitwiseOR(F.hash("word").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    shared = used.select("code", other.alias("other")).groupBy("code").agg(F.min("other").alias("a"), F.max("other").alias("b"))
    shared = cut_lineage(shared.where("a <> b").select("code"))
    dictionary = used.select("word", "code").distinct()
    if shared.isEmpty():
        return dictionary, shards
    own = used.join(shared, "code", "left_semi").select("word").distinct()
    own = cut_lineage(own.select("word", (-1 - F.monotonically_increasing_id()).alias("own")))
    dictionary = dictionary.join(own, "word", "left").select("word", F.coalesce("own", "code").alias("code"))
    changed = used.join(own, "word").groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("word", "own"))).alias("own"))  # no longer than a shard's vocabulary
    shards = shards.join(changed, "shard", "left")
    replaced = F.transform("vocabulary", lambda w, i: F.coalesce(F.try_element_at("own", w), F.get("codes", i)))
    return dictionary, shards.withColumn("codes", F.when(F.col("own").isNull(), F.col("codes")).otherwise(replaced)).drop("own")


def _row_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with its number of words and of distinct words, from the matrix alone."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name: batch.column(name).slice(i, 1).flatten()  # noqa: E731, B023
            bounds = np.asarray(get("bounds"))
            sums = np.diff(np.concatenate([[0], np.cumsum(np.asarray(get("counts")), dtype=np.int64)])[bounds])
            yield pa.RecordBatch.from_arrays([*[get(c) for c in (*_CARRIED, "late")], pa.array(sums), pa.array(np.diff(bounds))], [*_CARRIED, "late", "n_words", "n_distinct"])


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_bytes: int = SHARD_BYTES, code_bits: int = CODE_BITS) -> DataFrame:
    """One row per document: doc_id, part, digest, n_words, n_distinct and ``fails``, the bits of the filters A-D it fails."""
    _, shards = document_term_matrix(docs, id_col, text_col, source_col, shard_bytes, code_bits)
    kinds = dict(shards.dtypes)
    schema = ", ".join(f"{c} {kinds[c][6:-1]}" for c in (*_CARRIED, "late"))
    matrix = shards.select(*_CARRIED, "late", "bounds", "counts")  # a column's code is that of one word, so entries of a row are distinct words
    rows = matrix.mapInArrow(_row_flags, f"{schema}, n_words long, n_distinct long")
    short, same = F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words")
    bits = F.when(short, 1).otherwise(0) + F.when(same, 2).otherwise(0) + F.col("late").cast("int")
    return rows.select("doc_id", "part", "digest", "n_words", "n_distinct", bits.alias("fails"))


def failure_sets(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, fails, n, good, toxic): documents of each part by the set of filters they fail, E included."""
    votes = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).where("doc_id IS NOT NULL")
    votes = votes.groupBy("doc_id").agg((F.max("q") == 1).alias("good"), (F.max("t") == 1).alias("bad"))
    known = rows.join(votes, "doc_id", "left").select("doc_id", "part", "digest", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "bad")])
    # Copies are added up before they meet by digest.
    by_id = known.groupBy("digest", "part", "fails", "good", "bad")
    added = by_id.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("no_id"))
    same = known.select("digest", "doc_id").where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    same = same.where("copies > 1").select("digest", "first")
    firsts = known.join(same, (known["digest"] == same["digest"]) & (known["doc_id"] == same["first"]), "left_semi")
    firsts = firsts.groupBy("digest", "part", "fails", "good", "bad").agg(F.count(F.lit(1)).alias("at_first"))
    keys = ["digest", "part", "fails", "good", "bad"]
    met = added.join(same, "digest", "left").join(firsts, keys, "left")
    passes = F.when(F.col("first").isNull(), F.col("n")).otherwise(F.coalesce("at_first", F.lit(0)) + F.col("no_id"))
    split = met.select("part", "fails", "good", "bad", F.explode(F.array(F.struct(F.lit(0).alias("e"), passes.alias("k")), F.struct(F.lit(16).alias("e"), (F.col("n") - passes).alias("k")))).alias("s"))
    out = split.where("s.k > 0").groupBy("part", (F.col("fails") + F.col("s.e")).alias("fails"))
    return out.agg(*[F.sum(c).alias(n) for c, n in ((F.col("s.k"), "n"), (F.when(F.col("good"), F.col("s.k")).otherwise(0), "good"), (F.when(F.col("bad"), F.col("s.k")).otherwise(0), "toxic"))])


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bits of the filters before, bit of this filter) of all orders and steps."""
    found = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            found.append(("".join(FILTERS[x] for x in order), step + 1, before, 1 << f))
            before |= 1 << f
    return found


def interactions(sets: DataFrame) -> DataFrame:
    """One row per part, order and step with the counts of that step, from (part, fails, n, good, toxic)."""
    spark, plan_rows = sets.sparkSession, orders()
    share = (F.lit(len(plan_rows)) / len(FILTERS) / F.greatest(F.bit_count("fails"), F.lit(1))).cast("long").alias("first")  # orders in which a failed filter comes before the others
    table = sets.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic", share)).alias("sets"))  # at most 32 a part
    plan = spark.createDataFrame(plan_rows, "filter_order string, step int, before int, bit int")
    bits = F.explode(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])).alias("bit")
    rows = table.select("part", "sets", bits).join(F.broadcast(plan), "bit")

    def total(where, value: str = "n") -> Column:
        return F.aggregate(F.filter("sets", where), F.lit(0).cast("long"), lambda a, x: a + x[value])

    before, bit = F.col("before"), F.col("bit")
    failed = lambda x: x["fails"].bitwiseAND(bit) != 0
    earlier = lambda x: x["fails"].bitwiseAND(before) != 0
    here = lambda x: failed(x) & ~earlier(x)
    shapley = F.aggregate(F.filter("sets", failed), F.lit(0).cast("long"), lambda a, x: a + x["n"] * x["first"])
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda x: ~failed(x) & ~earlier(x)).alias("kept"),
        total(here).alias("removed"),
        total(lambda x: failed(x) & earlier(x)).alias("redundant"),
        total(lambda x: x["fails"] == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The whole audit: failure sets of all documents, and each part's counts in every order."""
    rows = cut_lineage(flagged(docs, id_col, text_col, source_col, shard_bytes))
    return interactions(failure_sets(rows, labels, id_col))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(l.q = 1, false) AS good, coalesce(l.x = 1, false) AS bad,
         (len(w) < 50) AS a,
         (100 * len(list_distinct(w)) < 65 * len(w)) AS b,
         (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t)) AS c,
         regexp_matches(t, '[#$%&*|]') AS s,
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
p AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * s::INT + 16 * e::INT AS fails,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS toxic
  FROM f GROUP BY ALL),
x(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.k <> b.k AND c.k NOT IN (a.k, b.k) AND d.k NOT IN (a.k, b.k, c.k) AND e.k NOT IN (a.k, b.k, c.k, d.k)),
g AS (
  SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
         list_sum([0] || [1 << (ascii(substr(filter_order, i, 1)) - 65) FOR i IN range(1, step)])::INT AS before
  FROM o, (SELECT unnest(range(1, 6))::INT AS step))
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * (120 // greatest(bit_count(fails), 1))) FILTER (fails & bit <> 0), 0)::BIGINT AS shapley
FROM p, g GROUP BY part, filter_order, step, bit, before
"""
