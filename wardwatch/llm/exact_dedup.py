"""Exact duplicate removal with a heavy-hitter split.

A Misra-Gries style frequent-items summary (``approx_top_k``, a mergeable
counter sketch of fixed size) names the digests that may be frequent.  Their
exact counts and winners are then verified with one partial aggregate over
the rows of those digests only, and the verified table, never longer than
the sketch's ``k``, is broadcast: rows of frequent digests are settled on
the map side and never shuffled.  All other digests occur in at most a small
fixed share of the rows each (the sketch's error bound), so an ordinary
shuffle spreads them evenly.

Defined results: a null text counts as empty; empty texts are equal to each
other; of equal texts the row with the largest id stays (null ids lose), and
of rows that also tie in the id exactly one stays.  Input columns keep their
names and types, whatever they are called; an empty table gives an empty one.
Built-in DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwatch.llm.common import BROADCAST_ROWS, fresh, one_of_equal, row_hash
from wardwatch.session import cut_lineage

#: Frequent digests that are verified and broadcast, and counters of the sketch.
TOP_DIGESTS = 1024
COUNTERS = 16384


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the whole text as it stands; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _winners(rows: DataFrame, digest: str, best: str, top: int, counters: int) -> DataFrame:
    """Verified ``(digest, win, n)`` of the frequent digests; at most ``top`` sketch items wide."""
    short = F.xxhash64(digest)
    frequent = rows.select(short.alias("item")).agg(F.expr(f"approx_top_k(item, {top}, {counters})").alias("tops"))
    candidates = frequent.select(F.explode("tops").alias("t")).where("t.count > 1").select(F.col("t.item").alias("item"))
    return (
        rows.select(digest, best)
        .withColumn("item", short)
        .join(F.broadcast(candidates), "item", "left_semi")
        .groupBy(digest)
        .agg(F.max(best).alias("win"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP_DIGESTS, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    base = cut_lineage(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            text_digest(F.col(f"`{text_col}`")).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        )
    ).withColumn("best", F.struct("doc_id", "row"))
    winners = cut_lineage(_winners(base, "text_sha256", "best", top, counters))
    settled = base.join(F.broadcast(winners), "text_sha256").select(
        "doc_id", F.col("win.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("win.row")).alias("kept"), "text_sha256"
    )
    rest = base.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")
    rest = rest.withColumn("win", F.max("best").over(group)).withColumn("n", F.count(F.lit(1)).over(group))
    return settled.unionByName(
        rest.select("doc_id", F.col("win.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("win.row")).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP_DIGESTS, counters: int = COUNTERS, broadcast_groups: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Winners are decided on narrow rows (digest, id, hash of the row).  The
    texts then only pass a hash join with the groups that have copies: the
    frequent ones are broadcast, the others too as long as there are no more
    than ``broadcast_groups``; beyond that the rows are shuffled, but never
    sorted.  Rows that equal their winner in every column are the only ones
    that meet once more.
    """
    digest, best = fresh(docs, "digest"), fresh(docs, "best")
    rows = docs.withColumn(digest, F.unhex(text_digest(F.col(f"`{text_col}`")))).withColumn(
        best, F.struct(F.col(f"`{id_col}`").alias("id"), row_hash(docs).alias("tie"))
    )
    small = cut_lineage(rows.select(F.col(digest).alias("digest_"), F.col(best).alias("best_")))
    frequent = cut_lineage(_winners(small, "digest_", "best_", top, counters).select("digest_", "win"))
    rest = small.join(F.broadcast(frequent.select("digest_")), "digest_", "left_anti").groupBy("digest_").agg(F.max("best_").alias("win"), F.count(F.lit(1)).alias("n"))
    rest = cut_lineage(rest.where("n > 1").select("digest_", "win"))
    settled = [F.broadcast(frequent), rest.hint("broadcast" if rest.count() <= broadcast_groups else "shuffle_hash")]
    equal = []
    for groups in settled:
        win = fresh(rows, "win")
        equal.append(small.join(groups, "digest_").where("best_ = win").groupBy(F.col("digest_").alias(digest)).agg(F.count(F.lit(1)).alias("n")))
        groups = groups.select(F.col("digest_").alias(digest), F.col("win").alias(win))
        rows = rows.join(groups, digest, "left").where(F.col(win).isNull() | (F.col(best) == F.col(win))).drop(win)
    equal = cut_lineage(equal[0].union(equal[1]).where("n > 1").select(digest))
    return one_of_equal(rows, digest, equal, broadcast_groups).select(*[F.col(f"`{c}`") for c in docs.columns])
