"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwatch.session import cut_lineage

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256
#: The ASCII white space that separates words, \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Keys of a narrow table that are broadcast at most (some ten MB); more of them meet by shuffled hash join.
BROADCAST_ROWS = 200_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of all hashable columns, to order rows that tie otherwise."""
    usable = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*usable) if usable else F.lit(0)


def one_of_equal(rows: DataFrame, key: str, repeated: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with one row of each key in ``repeated`` (key); rows of other keys pass a hash join alone, unsorted.

    ``row_number() = 1`` is applied before the shuffle too, so equal rows
    don't gather in one task.
    """
    many = repeated.limit(broadcast_rows + 1).count()
    if not many:
        return rows
    hinted = repeated.hint("broadcast" if many <= broadcast_rows else "shuffle_hash")
    rank = fresh(rows, "rank")
    first = rows.join(hinted, key, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return rows.join(hinted, key, "left_anti").unionByName(first.where(F.col(rank) == 1).drop(rank))


def sized(small: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table of few columns for an equi-join: broadcast if it has no more than ``broadcast_rows``, otherwise shuffled and hashed."""
    return small.hint("broadcast" if small.limit(broadcast_rows + 1).count() <= broadcast_rows else "shuffle_hash")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place (from 0) in the order as column ``name``.

    Rows are dealt by ranges of the order and numbered within each; the
    number of rows in the ranges before, one row per range, is broadcast.
    The places are distinct also among rows that tie.
    """
    at = fresh(rows, "at")
    numbered = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    ranges = numbered.groupBy(F.shiftright(at, 33).alias("range_")).agg(F.count(F.lit(1)).alias("n_"))
    before = ranges.select("range_", (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("before_"))
    joined = numbered.join(F.broadcast(before), F.shiftright(at, 33) == F.col("range_"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("before_") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches into short ones, so that few texts at a time live as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_mod(id_column: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the undirected ``edges`` (src, dst); root is the smallest node reachable.

    Contraction by rounds: every node points at the smallest of itself and
    its neighbours, edges move to the pointed-at nodes, and loops go.  A
    round leaves at most about half of the nodes, so the number of rounds is
    logarithmic; each is cut with a reliable checkpoint, and nothing but the
    count of remaining edges reaches the driver.
    """
    left = cut_lineage(
        edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct()
    )
    assigned = None
    while not left.isEmpty():
        both = left.select("src", "dst").union(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        to = cut_lineage(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("to")))
        moved = (
            left.join(to.select(F.col("node").alias("src"), F.col("to").alias("a")), "src")
            .join(to.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst")
            .where("a <> b")
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
            .distinct()
        )
        if assigned is None:
            assigned = to.withColumnRenamed("to", "root")
        else:
            assigned = cut_lineage(
                assigned.join(to.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            )
        left = cut_lineage(moved)
    if assigned is None:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return assigned


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, per_label: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, label, text)`` of at most ``per_label`` labelled rows of each label, 0 and 1.

    Only ids whose crc32 modulo ``modulus`` is not ``held_out`` take part;
    of those the ones with the smallest hash are taken, so the choice is the
    same on every run.  Null labels don't count; of several labels of one id
    the mean decides, from one half on for 1.  A repeated id counts once.
    """
    voted = (
        labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("vote"))
        .where("doc_id IS NOT NULL AND vote IS NOT NULL")
        .where(crc_mod(F.col("doc_id"), modulus) != held_out)
        .groupBy("doc_id")
        .agg((F.avg("vote") >= 0.5).cast("int").alias("label"))
    )
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = [voted.where(F.col("label") == x).orderBy(order, "doc_id").limit(per_label) for x in (0, 1)]
    chosen = cut_lineage(chosen[0].union(chosen[1]))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))


def fit_logistic(rows: list[list[int]], labels: list[int], n_features: int, rounds: int = 300, ridge: float = 0.02):
    """Weights and intercept of a class-balanced logistic regression on 0/1 features, by accelerated full-batch descent."""
    import numpy as np

    y = np.asarray(labels, float)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((x for r in rows for x in r), np.int64, len(row))
    pos = y.sum()
    if not 0 < pos < len(y):
        return np.zeros(n_features), -4.0 if pos == 0 else 4.0
    share = np.where(y == 1, 0.5 / pos, 0.5 / (len(y) - pos))
    w, b, grads = np.zeros(n_features), 0.0, np.full(n_features + 1, 1e-8)
    for _ in range(rounds):
        z = b + np.bincount(row, w[col], len(y))
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        step = np.append(np.bincount(col, g[row], n_features) + ridge * w / len(y), g.sum())
        grads += step**2
        move = 0.5 * step / np.sqrt(grads)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)
