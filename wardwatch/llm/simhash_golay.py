"""Near-duplicate classes by SimHash fingerprints and Golay-code fuzzy keys.

The 64-bit fingerprint is cut into four 16-bit segments.  If two
fingerprints differ in at most three bits, some segment is equal in both
while the next one (cyclically) differs in one bit at most: otherwise each
equal segment would be followed by one with two or more errors, which with
three errors in all leaves a single equal segment, and the other two would
add two errors more.  So four kinds of key are enough: an equal segment as
it stands together with a fuzzy key of the next one.

The fuzzy key comes from the perfect binary [23, 12, 7] Golay code: a
segment, padded to 23 bits, decodes to the index of the one codeword within
three bits.  A fingerprint is filed under the codeword of its own segment
and looked up under the codewords of all words within one bit (six at most),
so segments with one error always meet.

Fingerprints are grouped first, so copies count once.  Each key's members
are verified by their whole bit distance with numpy, in buckets streamed in
key order; a bucket over ``BLOCK`` members is cut into pairs of blocks, each
a bucket of its own.  A bucket reports a spanning forest of its verified
links and not all its pairs; the components of all forests are the classes.

Defined results: a null or empty text, or one without words, has fingerprint
zero and links like any other; a text with fewer words than a shingle is one
shingle; a null id never becomes a component id unless all ids of the class
are null; repeated rows give repeated rows; an empty table gives none; extra
columns are ignored by ``near_classes`` and kept by ``drop_near``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.common import BROADCAST_ROWS, connected_components, fresh, one_of_equal, row_hash, slices
from wardwatch.session import cut_lineage

SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16
#: Members of a key that are compared in one task.
BLOCK = 4096
#: Generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the binary Golay code.
GOLAY = 0b101011100011


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    total, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 65536):
        total += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


@cache
def golay_keys() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 16-bit word: its codeword index; and the indices near it, flat with offsets."""

    def syndrome(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ GOLAY << bit - 11, rest)
        return rest

    one = np.concatenate([[0], 1 << np.arange(23)])
    errors = np.unique((one[:, None, None] ^ one[:, None] ^ one).ravel())  # all of weight 3 or less: 1 and 0 twice make 0 and 1
    leader = np.zeros(2048, np.int64)
    leader[syndrome(errors)] = errors
    words = np.arange(1 << SEGMENT_BITS)
    home = words ^ leader[syndrome(words)]
    home >>= 11
    near = np.sort(np.stack([home, *(home[words ^ 1 << b] for b in range(SEGMENT_BITS))], axis=1), axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    return home, near[new], np.concatenate([[0], np.cumsum(new.sum(1))])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    home, near, start = golay_keys()
    for batch in slices(batches, 8192):
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        parts = prints.view(np.uint64)[:, None] >> np.arange(0, 64, SEGMENT_BITS, np.uint64) & np.uint64(0xFFFF)
        parts = parts.astype(np.int64)
        for i in range(SEGMENTS):
            equal, fuzzy = parts[:, i], parts[:, (i + 1) % SEGMENTS]
            many = start[fuzzy + 1] - start[fuzzy]
            row = np.repeat(np.arange(len(prints)), many)
            index = near[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + start[fuzzy][row]]
            key = (np.int64(i) << 28) | (equal[row] << 12) | index
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row]), pa.array(index == home[fuzzy][row])], ["key", "print", "home"])


def _forest(members: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the graph of members that differ in few bits."""
    left = members
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            linked = np.bitwise_count(left ^ at) <= bits
            if linked.any():
                found, left = left[linked], left[~linked]
                stack.extend(found)
                yield from ((int(at), int(x)) for x in found)


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Verified links of each bucket; rows come in bucket order, a bucket may span batches."""

    def edges(buckets: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate([[True], (buckets[1:] != buckets[:-1]).any(1)])) if len(buckets) else np.zeros(0, int)
        size = np.diff(np.append(begin, len(buckets)))
        two = begin[size == 2]
        close = np.bitwise_count(prints[two] ^ prints[two + 1]) <= bits
        a, b = prints[two][close], prints[two + 1][close]
        more = [x for at, n in zip(begin[size > 2], size[size > 2]) for x in _forest(np.unique(prints[at : at + n]), bits)]
        if more:
            far = np.array(more, np.uint64)
            a, b = np.concatenate([a, far[:, 0]]), np.concatenate([b, far[:, 1]])
        same = a == b
        return pa.RecordBatch.from_arrays([pa.array(a[~same].view(np.int64)), pa.array(b[~same].view(np.int64))], ["src", "dst"])

    buckets, prints = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets = np.concatenate([buckets, np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)])
        prints = np.concatenate([prints, batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
        open_ = int(np.flatnonzero((buckets == buckets[-1]).all(1))[0])
        yield edges(buckets[:open_], prints[:open_])
        buckets, prints = buckets[open_:], prints[open_:]
    yield edges(buckets, prints)


def links(prints: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) that connect the distinct fingerprints of ``prints`` (print) as all pairs within ``max_bits`` would."""
    if not 0 <= max_bits <= 3:
        raise ValueError("four segments find fingerprints that differ in 0 to 3 bits")
    keys = prints.select("print").mapInArrow(_key_rows, "key long, print long, home boolean")
    large = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).where(F.col("n") > block)
    parts = F.ceil(F.col("n") / block), F.ceil(F.greatest(F.col("homes"), F.lit(1)) / block)
    rows = keys.join(large.select("key", parts[0].alias("asks"), parts[1].alias("files")), "key", "left")
    spot = F.abs(F.xxhash64("print") % (1 << 30))
    filed = F.transform(F.sequence(F.lit(0), F.col("asks") - 1), lambda x: F.struct((spot % F.col("files")).alias("file"), x.alias("ask")))
    asked = F.transform(F.sequence(F.lit(0), F.col("files") - 1), lambda x: F.struct(x.alias("file"), (spot % F.col("asks")).alias("ask")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("ask")))
    both = F.when(F.col("asks").isNull(), one).when(F.col("home"), F.array_union(filed, asked)).otherwise(asked)
    dealt = rows.select("key", "print", F.explode(both).alias("b")).select("key", F.col("b.file").alias("file"), F.col("b.ask").alias("ask"), "print")
    dealt = dealt.repartition(F.col("key"), F.col("file"), F.col("ask")).sortWithinPartitions("key", "file", "ask")
    return dealt.mapInArrow(lambda batches: _links(batches, max_bits), "src long, dst long").distinct()


def _fingerprints(docs: DataFrame, text_col: str, width: int, carry: list) -> DataFrame:
    """``carry`` columns and the fingerprint of each row."""
    kept = docs.select(*carry, F.col(f"`{text_col}`").cast("string").alias("text_"))
    names = kept.columns[:-1]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = [fingerprint(t, width) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(marks, pa.int64())], [*names, "print"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in kept.dtypes[:-1])
    return kept.mapInArrow(prints, f"{schema}, print long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per input row: doc_id, print (signed 64-bit fingerprint), component_id (smallest id of the class)."""
    marked = cut_lineage(_fingerprints(docs, text_col, width, [F.col(f"`{id_col}`").alias("doc_id")]))
    return marked.join(_classes(marked.groupBy("print").agg(F.min("doc_id").alias("low")), max_bits), "print", "left").select("doc_id", "print", "component_id")


def _classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """``(print, component_id)`` from distinct fingerprints and their smallest value ``low``."""
    prints = cut_lineage(prints)
    roots = connected_components(links(prints, max_bits))
    member = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    lows = member.groupBy("root").agg(F.min("low").alias("component_id"))
    return member.join(lows, "root").select("print", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row of each class: that with the smallest id (null ids last), with all its columns.

    The rows to drop are found on narrow rows (id, hash of the row,
    fingerprint); the texts only pass an anti join by hash, broadcast up to
    ``broadcast_rows`` of them, and are never sorted.
    """
    tie = fresh(docs, "tie")
    ident = F.struct(F.col(f"`{id_col}`").isNull().alias("no"), F.col(f"`{id_col}`").alias("id"), row_hash(docs).alias("hash"))
    marked = cut_lineage(_fingerprints(docs, text_col, width, [ident["no"].alias("no"), ident["id"].alias("id"), ident["hash"].alias("hash")]))
    marked = marked.select("print", F.struct("no", "id", "hash").alias(tie))
    low = marked.groupBy("print").agg(F.min(tie).alias("low"))
    placed = cut_lineage(marked.join(_classes(low, max_bits), "print").select(tie, (F.col(tie) == F.col("component_id")).alias("stays")))
    gone = cut_lineage(placed.where("NOT stays").select(tie).distinct())
    equal = cut_lineage(placed.where("stays").groupBy(tie).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(tie))
    small = gone.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = docs.withColumn(tie, ident).join(gone.hint("broadcast" if small else "shuffle_hash"), tie, "left_anti")
    return one_of_equal(rows, tie, equal, broadcast_rows).select(*[F.col(f"`{c}`") for c in docs.columns])
