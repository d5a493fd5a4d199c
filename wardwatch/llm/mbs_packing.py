"""Best-fit packing of tokenised documents by minimum bin slack.

Texts become token ids and an end mark; documents longer than a sequence are
cut into whole sequences from the end, so only the first piece may be short.
A narrow table of pieces (no ids) is dealt at random into shards of about
``SHARD_PIECES`` pieces.  In a shard the lengths are counted, and sequences
are filled one by one: starting from the longest length left, a bitset
subset-sum dynamic programme over the lengths available (bit s: s tokens can
be filled) finds the fullest feasible combination, which is taken out.  As
long as the counts last, the next search would find the same combination
again, so it is taken as often as they allow at once; a search needs no more
work for a million equal pieces than for one.  Each shard wastes at most a
few sequences at its end.

The ids come from the ranks of a public byte-level vocabulary by way of
``tiktoken``; they are the ids that the ``tokenizers`` form of the same
vocabulary gives, at several times its speed (the tests compare the two).
Strings of special tokens within a text are ordinary text.

Defined results: a null or empty text is the end mark alone; repeated rows
are packed each; an empty table gives an empty one; extra columns are
ignored.  Null ids are packed like any other.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwatch.llm.common import slices
from wardwatch.session import cut_lineage

SEQUENCE = 2048
SHARD_PIECES = 50_000
END_ID = 0


class Vocabulary:
    """Byte-level ranks, read by the driver and broadcast; workers need no file."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = f.read()
        self.pattern, self._encoding = pattern, None

    def __getstate__(self):
        return self.__dict__ | {"_encoding": None}

    def encode(self, text: str) -> list[int]:
        if self._encoding is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._encoding.encode_ordinary(text)


def public_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pieces(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*words.value.encode(text or ""), end_id], "<u4")
                short = len(ids) % sequence or sequence
                bounds = [0, *range(short, len(ids) + 1, sequence)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(kept.dtypes)["doc_id"]
    return kept.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each within its count, that fill ``room`` as far as any choice can; longer lengths are tried first."""
    mask, reach = (1 << room + 1) - 1, 1
    steps: list[tuple[int, int, int, int]] = []  # what a step adds, what could be reached before it, its length and how often
    for length in sorted((x for x in counts if x <= room), reverse=True):
        many, share = min(counts[length], room // length), 1
        while many:
            take = min(share, many)
            steps.append((take * length, reach, length, take))
            reach = (reach | reach << take * length) & mask
            many -= take
            share *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for total, before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * take
            at -= total
    return chosen


def fill(counts: dict[int, int], sequence: int = SEQUENCE) -> Iterator[tuple[list[int], int]]:
    """Minimum-bin-slack sequences: (lengths in a sequence, number of such sequences) until nothing is left."""
    left = {k: v for k, v in counts.items() if v}
    for longest in sorted(left, reverse=True):
        while left.get(longest):
            left[longest] -= 1
            chosen = [longest, *fullest({k: v for k, v in left.items() if v}, sequence - longest)]
            left[longest] += 1
            need = Counter(chosen)
            times = min(left[x] // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= n * times
            yield chosen, times


def _pack_shard(table: pa.Table, sequence: int) -> pa.Table:
    """Sequence numbers and offsets of one shard's pieces, which are at most a few times ``SHARD_PIECES``."""
    length = table.column("length").to_numpy()
    order = np.argsort(-length, kind="stable")
    sizes, begin, count = np.unique(-length[order], return_index=True, return_counts=True)
    next_ = {int(-s): int(b) for s, b in zip(sizes, begin)}
    numbers, offsets, number = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), 0
    for chosen, times in fill({int(-s): int(n) for s, n in zip(sizes, count)}, sequence):
        at = 0
        for size in chosen:
            mine = order[next_[size] : next_[size] + times]
            next_[size] += times
            numbers[mine] = number + np.arange(times)
            offsets[mine] = at
            at += size
        number += times
    shard = table.column("shard").to_numpy().astype(np.int64)
    out = table.drop_columns(["shard"])
    return out.append_column("sequence_id", pa.array((shard << 32) + numbers)).append_column("offset", pa.array(offsets))


def pack(docs: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = cut_lineage(pieces(docs, vocabulary or public_vocabulary(), id_col, text_col, sequence))
    full = cut.where(F.col("length") == sequence).select("*", F.monotonically_increasing_id().alias("n"))
    whole = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut.where(F.col("length") < sequence)
    shards = max(1, -(-short.count() // shard_pieces))
    dealt = short.withColumn("shard", F.pmod(F.xxhash64(*cut.columns, F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    kind = dict(cut.dtypes)["doc_id"]
    packed = dealt.groupBy("shard").applyInArrow(
        lambda t: _pack_shard(t, sequence), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return whole.unionByName(packed)
