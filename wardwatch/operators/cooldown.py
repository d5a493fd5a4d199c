"""Per-patient alert cooldown and gap runs (ST03, W05, A12), exact and skew-safe.

Semantics: an alert is accepted when the patient has no earlier accepted
alert or the last accepted one is at least ``cooldown_s`` older; skipped
alerts do not restart the clock.  Of alerts with equal times the one with the
smallest id counts; alerts without a time are never accepted, and those
without a patient count as one patient's.  This is a greedy fold, not a window: the answer depends
on the last *accepted* alert.

Plan (a segmented scan; no group, partition or wide row is ever collected):

1. Only (patient, time, id) takes part.  Alerts with equal times are merged
   by a partial aggregate, then dealt by ``repartitionByRange(patient, time)``
   and sorted by Spark, so a patient holding half of all rows is spread over
   many tasks.  A reliable checkpoint pins the partitions.
2. A first pass folds each partition batch by batch.  Only the first patient
   of a partition may be one that goes on from the partition before, and only
   if the gap between the two is shorter than the cooldown: a longer gap
   starts a new run, whose first alert is always accepted.  For that first
   patient the pass follows every possible first accepted alert (those within
   one cooldown of the start, and the next) at once, as intervals: chains that
   meet go on as one, so the pass holds no more than the alerts of one
   cooldown, and emits one row per interval with a common exit.
3. One row per partition tells which partitions are entered by a run.  Their
   intervals alone are read, in order and one at a time, to find each
   partition's entry.
4. A second pass folds each partition from its entry and emits the accepted
   alerts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardwatch.session import cut_lineage, ship_package

_SUMMARY = (
    "pid int, first_key string, first_t long, last_key string, last_t long, single boolean, "
    "last_exit long, cand long, cand_exit long"
)
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _micros(df: DataFrame, ts: str):
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{ts}`)")
    return F.unix_micros(F.col(ts))


def _pinned(alerts: DataFrame, key: str, ts: str, order: str, num_partitions: int | None) -> DataFrame:
    """(k, t, id, n, pid): distinct (patient, time) in order, the smallest id and the number of alerts there."""
    ship_package(alerts.sparkSession)
    narrow = alerts.select(F.col(key).alias("k"), _micros(alerts, ts).alias("t"), F.col(order).alias("id")).where("t IS NOT NULL")
    merged = narrow.groupBy("k", "t").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    ranged = merged.repartitionByRange(*([num_partitions] if num_partitions else []), "k", "t")
    return cut_lineage(ranged.sortWithinPartitions("k", "t").withColumn("pid", F.spark_partition_id()))


def _segments(keys: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) ranges of equal consecutive keys."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(keys)])).tolist()))


def _numpy(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("k").to_numpy(zero_copy_only=False), batch.column("t").to_numpy(zero_copy_only=False).astype(np.int64)


def _fold(t: np.ndarray, last: int | None, cooldown: int) -> tuple[list[int], int | None]:
    """Places accepted in sorted ``t`` after ``last``, and the last accepted time."""
    places = []
    i = 0 if last is None else int(np.searchsorted(t, last + cooldown))
    while i < len(t):
        places.append(i)
        last = int(t[i])
        i = int(np.searchsorted(t, last + cooldown))
    return places, last


class _Chains:
    """All ways to enter a run at once: intervals of first accepted alerts whose chains have met."""

    def __init__(self, cooldown: int, start: int):
        self.cooldown, self.start, self.open = cooldown, start, True
        self.cand = np.zeros(0, np.int64)  # the last first alert of each interval
        self.at = np.zeros(0, np.int64)  # where its chain has come to

    def add(self, t: np.ndarray) -> None:
        if self.open:
            near = int(np.searchsorted(t, self.start + self.cooldown))
            self.open = near == len(t)
            new = t[: near + 1]
            self.cand, self.at = np.concatenate((self.cand, new)), np.concatenate((self.at, new))
        while True:
            ahead = np.searchsorted(t, self.at + self.cooldown)
            moves = ahead < len(t)
            if not moves.any():
                return
            at = self.at.copy()
            at[moves] = t[ahead[moves]]
            last = np.append(at[1:] != at[:-1], True)  # chains keep their order, so those that meet are neighbours
            self.cand, self.at = self.cand[last], at[last]


def _summarize(cooldown: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, pid, first, key, last, last_t, single = None, None, None, None, None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, t = _numpy(batch)
            for s, e in _segments(keys):
                if chains is None:
                    pid, key, first = batch.column("pid")[0].as_py(), keys[s], (keys[s], int(t[s]))
                    chains = _Chains(cooldown, int(t[s]))
                if keys[s] != key:
                    key, last, single = keys[s], None, False
                if single:
                    chains.add(t[s:e])
                else:
                    last = _fold(t[s:e], last, cooldown)[1]
            last_t = int(t[-1])
        if chains is None:
            return
        n = len(chains.cand)
        head = [pid, *first, key, last_t, single, last]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
        columns = [pa.array([v] * n, k) for v, k in zip(head, kinds)]
        names = [x.split()[0] for x in _SUMMARY.split(", ")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(chains.cand), pa.array(chains.at)], names)

    return fn


def _enter(cooldown: int):
    """Entries of partitions from rows in the order of (pid, cand); holds one partition's state at a time."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, entry, exit_, found = None, None, None, False
        for batch in batches:
            pids, entries = [], []
            for r in batch.to_pylist():
                if r["pid"] != pid:
                    # what the partition before leaves behind, if this one goes on with its run
                    if r["entered"]:
                        entry = exit_ if found else entry
                        pids.append(r["pid"])
                        entries.append(entry)
                    else:
                        entry = None
                    pid, found = r["pid"], False
                if not found and (entry is None or r["cand"] >= entry + cooldown):
                    found, exit_ = True, r["cand_exit"]
                if not r["single"]:
                    found, exit_ = True, r["last_exit"]
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(entries, pa.int64())], ["pid", "entry"])

    return fn


def _accept(cooldown: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, started = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, t = _numpy(batch)
            kept: list[int] = []
            for s, e in _segments(keys):
                if not started:
                    started, key, last = True, keys[s], batch.column("entry")[0].as_py()
                elif keys[s] != key:
                    key, last = keys[s], None
                places, last = _fold(t[s:e], last, cooldown)
                kept += [s + i for i in places]
            yield batch.select(["k", "t", "id"]).take(pa.array(kept, pa.int64()))

    return fn


def _entered(summaries: DataFrame, cooldown: int) -> DataFrame:
    """One row per partition, with ``entered``: its first alert goes on with the run of the partition before."""
    heads = summaries.groupBy("pid").agg(*[F.first(c).alias(c) for c in ("first_key", "first_t", "last_key", "last_t", "single")])
    w = W.orderBy("pid")
    same = (F.lag("last_key").over(w).eqNullSafe(F.col("first_key"))) & (F.col("first_t") - F.lag("last_t").over(w) < cooldown)
    return heads.withColumn("entered", F.coalesce(same, F.lit(False)))


def accepted_keys(
    alerts: DataFrame,
    cooldown_s: int = 60,
    key: str = "patient_id",
    ts: str = "timestamp_utc",
    order: str = "alert_id",
    num_partitions: int | None = None,
) -> DataFrame:
    """(order, key, ts) of the accepted alerts, under the input's names; no other column is read."""
    cooldown = int(cooldown_s) * 1_000_000
    pinned = _pinned(alerts, key, ts, order, num_partitions)
    narrow = pinned.select("k", "t", "id", "pid")
    summaries = cut_lineage(narrow.mapInArrow(_summarize(cooldown), _SUMMARY))
    heads = _entered(summaries, cooldown)
    # a partition's intervals matter where a run enters it or, for its exit, where a run leaves it
    w = W.orderBy("pid")
    needed = heads.select("pid", "entered", (F.col("entered") | F.lead("entered", 1, False).over(w)).alias("_needed")).where("_needed")
    rows = summaries.select("pid", "single", "last_exit", "cand", "cand_exit").join(F.broadcast(needed.drop("_needed")), "pid")
    entries = rows.repartition(1).sortWithinPartitions("pid", "cand").mapInArrow(_enter(cooldown), "pid int, entry long")
    kinds = dict(narrow.dtypes)
    joined = narrow.join(F.broadcast(entries), "pid", "left")
    out = joined.mapInArrow(_accept(cooldown), f"k {kinds['k']}, t long, id {kinds['id']}")
    stamp = F.expr(f"timestampadd(MICROSECOND, t, {_EPOCH})") if isinstance(alerts.schema[ts].dataType, T.TimestampNTZType) else F.timestamp_micros("t")
    return out.select(F.col("id").alias(order), F.col("k").alias(key), stamp.alias(ts))


def apply_cooldown(alerts: DataFrame, cooldown_s: int = 60, key: str = "patient_id", ts: str = "timestamp_utc", order: str = "alert_id", num_partitions: int | None = None) -> DataFrame:
    """All input rows plus ``accepted`` (bool); of rows with equal id, key and time one at most is accepted.

    The rows meet the accepted keys by a shuffle on all three columns; they
    are numbered only where an accepted key stands in several rows.
    """
    keys = cut_lineage(accepted_keys(alerts, cooldown_s, key, ts, order, num_partitions).withColumn("accepted", F.lit(True)))
    on = [order, key, ts]
    k = keys.select(*[F.col(c).alias(f"_{c}") for c in on], "accepted")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    marked = alerts.join(k, same[0] & same[1] & same[2], "left").select(*alerts.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))
    repeated = marked.where("accepted").groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if repeated.isEmpty():
        return marked
    first = F.row_number().over(W.partitionBy(*on, "accepted").orderBy(F.monotonically_increasing_id()))
    one = marked.where("accepted").withColumn("_i", first).withColumn("accepted", F.col("_i") == 1).drop("_i")
    return marked.where("NOT accepted").unionByName(one)


def accepted_alerts(alerts: DataFrame, cooldown_s: int = 60, **kw) -> DataFrame:
    """The accepted alerts with all their columns."""
    return apply_cooldown(alerts, cooldown_s, **kw).where("accepted").drop("accepted")


def skipped_per_patient(alerts: DataFrame, cooldown_s: int = 60, key: str = "patient_id", **kw) -> DataFrame:
    """A12-style counters per patient: alerts, accepted, skipped; counted before the two sides meet."""
    taken = accepted_keys(alerts, cooldown_s, key=key, **kw).groupBy(key).agg(F.count(F.lit(1)).alias("n_accepted"))
    every = alerts.groupBy(key).agg(F.count(F.lit(1)).alias("n_alerts"))
    both = every.join(taken.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("n_accepted", F.coalesce("n_accepted", F.lit(0).cast("long")))
    return both.select(key, "n_alerts", "n_accepted", (F.col("n_alerts") - F.col("n_accepted")).alias("n_skipped"))


def _part_runs(cooldown: int):
    """Runs of a partition (k, start, stop, n, edge): edge 1 the first, 2 the last, 3 both."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, open_, edge = None, None, 1
        names = ["pid", "k", "start", "stop", "n", "edge"]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, t = _numpy(batch)
            counts = np.concatenate(([0], np.cumsum(batch.column("n").to_numpy(zero_copy_only=False))))
            pid = batch.column("pid")[0].as_py()
            new = np.flatnonzero((keys[1:] != keys[:-1]) | (t[1:] - t[:-1] >= cooldown)) + 1
            starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(t)]))
            rows = []
            for s, e in zip(starts.tolist(), ends.tolist()):
                n = int(counts[e] - counts[s])
                if open_ is not None and open_[0] == keys[s] and int(t[s]) - open_[2] < cooldown:
                    open_ = (open_[0], open_[1], int(t[e - 1]), open_[3] + n)
                    continue
                if open_ is not None:
                    rows.append((pid, *open_, edge))
                    edge = 0
                open_ = (keys[s], int(t[s]), int(t[e - 1]), n)
            yield packed(rows)
        if open_ is not None:
            yield packed([(pid, *open_, edge + 2)])

    return fn


def gap_runs(alerts: DataFrame, cooldown_s: int, key: str = "patient_id", ts: str = "timestamp_utc", order: str = "alert_id", num_partitions: int | None = None) -> DataFrame:
    """One row per run (key, run_start, run_end, n_alerts); a gap >= cooldown to the previous alert starts a new run.

    Times are compared in whole microseconds.  Partitions are cut into runs
    by themselves; only their first and last runs, two rows a partition, are
    joined to those of the neighbours.
    """
    cooldown = int(cooldown_s) * 1_000_000
    pinned = _pinned(alerts, key, ts, order, num_partitions)
    runs = cut_lineage(pinned.select("k", "t", "n", "pid").mapInArrow(_part_runs(cooldown), "pid int, k string, start long, stop long, n long, edge int"))
    w = W.orderBy("pid", "edge")
    edges = runs.where("edge > 0")
    goes_on = F.lag("k").over(w).eqNullSafe(F.col("k")) & (F.lag("pid").over(w) < F.col("pid")) & (F.col("start") - F.lag("stop").over(w) < cooldown)
    grouped = edges.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    joined = grouped.groupBy("k", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"))
    whole = runs.where("edge = 0").select("k", "start", "stop", "n").unionByName(joined.drop("run"))
    stamp = lambda c: F.expr(f"timestampadd(MICROSECOND, {c}, {_EPOCH})")
    return whole.select(F.col("k").alias(key), stamp("start").alias("run_start"), stamp("stop").alias("run_end"), F.col("n").alias("n_alerts"))
