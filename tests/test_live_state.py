"""Panes, newest alerts, running counts and counters over several micro-batches, with replays."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wardwatch.operators import analytics as an
from wardwatch.operators.audit import append_audit, stored
from wardwatch.streaming import live_state as ls
from wardwatch.streaming.counters import CounterListener, counted, totals
from wardwatch.streaming.topic import consume, publish

START = datetime(2024, 1, 1)
EVENT = "alert_id string, patient_id string, severity string, confidence_score double, processing_ms int, created_at timestamp_ntz"


def _events(n, seed=1):
    rnd = random.Random(seed)
    rows = [(f"a{i}", f"p{rnd.randrange(40)}", rnd.choice(("CRITICAL", "HIGH", "MEDIUM")), rnd.choice((None, 0.25, 0.5)), rnd.choice((None, 900, 1500)), START + timedelta(seconds=rnd.randrange(3 * 86_400))) for i in range(n)]
    return rows + [("edge", "p-edge", "HIGH", 0.5, 100, START + timedelta(days=2)), ("after", "p-after", "HIGH", 0.5, 100, START + timedelta(days=2, microseconds=1)), ("full", "p-full", "HIGH", 0.5, 1, START + timedelta(days=2, hours=1))]


def _batches(spark, path, rows, schema, n):
    for k in range(n):
        spark.createDataFrame(rows[k * len(rows) // n : (k + 1) * len(rows) // n], schema).coalesce(1).write.mode("append").parquet(path)


def test_panes_like_one_pass(spark, tmp_path):
    rows = _events(900)
    random.Random(2).shuffle(rows)
    _batches(spark, str(tmp_path / "in"), rows + rows[::5], EVENT, 5)  # a fifth is delivered twice
    schema = spark.createDataFrame([], EVENT).schema
    stream = consume(spark, str(tmp_path / "in"), schema, 1)
    at = str(tmp_path / "panes")
    ls.refresh_panes(stream, at).awaitTermination()
    whole = spark.createDataFrame(rows, EVENT)
    for now in (START + timedelta(days=3), START + timedelta(days=2, hours=5, minutes=7), START + timedelta(days=9), START):
        want = an.dashboard_stats(whole, F.lit(now).cast("timestamp_ntz")).first()
        assert ls.trailing_stats(spark, at, schema, now).first() == want, now
    before = ls.trailing_stats(spark, at, schema, START + timedelta(days=3)).first()
    ls.upsert_panes(spark.read.schema(EVENT).parquet(str(tmp_path / "in")).limit(300), 3, at)  # a batch that runs again after a failure
    assert ls.trailing_stats(spark, at, schema, START + timedelta(days=3)).first() == before
    assert spark.read.parquet(f"{at}/audit").count() == len(rows)


def test_no_events(spark, tmp_path):
    schema = spark.createDataFrame([], EVENT).schema
    row = ls.trailing_stats(spark, str(tmp_path), schema, START).first()
    assert row == an.dashboard_stats(spark.createDataFrame([], EVENT), F.lit(START).cast("timestamp_ntz")).first()


def test_newest_list(spark, tmp_path):
    rnd = random.Random(4)
    schema = "alert_id string, timestamp_utc timestamp_ntz"
    rows = [(f"a{i:03d}", START + timedelta(seconds=rnd.randrange(300))) for i in range(400)]
    _batches(spark, str(tmp_path / "in"), rows + rows[:40], schema, 6)
    stream = consume(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    ls.follow_newest(stream, str(tmp_path / "out"), 50).awaitTermination()
    want = sorted(rows, key=lambda r: (r[1], r[0]))[-50:]
    read = lambda: sorted((r.timestamp_utc, r.alert_id) for r in ls.newest(spark, str(tmp_path / "out"), stream.schema).collect())
    assert read() == sorted((t, a) for a, t in want)
    ls.merge_newest(spark.createDataFrame(rows[-40:], schema), 5, str(tmp_path / "out"), 50)  # run again
    assert read() == sorted((t, a) for a, t in want)
    assert ls.newest(spark, str(tmp_path / "none"), stream.schema).isEmpty()


def test_running_counts(spark, tmp_path):
    rnd = random.Random(6)
    alerts = [(f"p{rnd.randrange(12)}" if i % 2 else "hot", START + timedelta(seconds=rnd.randrange(5000))) for i in range(900)]
    acks = [(f"p{rnd.randrange(9)}", START + timedelta(seconds=rnd.randrange(6000))) for _ in range(25)] + [("hot", START + timedelta(seconds=900))]
    sa, sk = "patient_id string, timestamp_utc timestamp_ntz", "patient_id string, acked_at timestamp_ntz"
    _batches(spark, str(tmp_path / "a"), alerts, sa, 4)
    _batches(spark, str(tmp_path / "k"), acks, sk, 3)
    a, k = (consume(spark, str(tmp_path / x), spark.createDataFrame([], s).schema, 1) for x, s in (("a", sa), ("k", sk)))
    ls.follow_counts(a, k, str(tmp_path / "out")).awaitTermination()
    patients = spark.createDataFrame([(f"p{i}",) for i in range(14)] + [("hot",)], "patient_id string")
    last = {}
    for p, t in acks:
        last[p] = max(last.get(p, t), t)
    for r in ls.current_counts(spark, str(tmp_path / "out"), patients).collect():
        n = sum(p == r.patient_id and (p not in last or t > last[p]) for p, t in alerts)
        assert (r.live_count, r.status) == (n, "red" if n else "green")


def test_counters(spark, tmp_path):
    _batches(spark, str(tmp_path / "in"), [(i,) for i in range(100)], "x long", 4)
    stream = consume(spark, str(tmp_path / "in"), spark.createDataFrame([], "x long").schema, 1)
    listener = CounterListener()
    spark.streams.addListener(listener)
    try:
        kept = counted(counted(stream, "in", all=F.lit(True), odd=F.col("x") % 2 == 1).where("x > 9"), "out", all=F.lit(True))
        query = publish(kept, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
        want = {"in.all": 100, "in.odd": 50, "out.all": 90}
        assert totals(query) == want
        for _ in range(100):
            if str(query.runId) in listener.ended:
                break
            time.sleep(0.1)
        assert dict(listener.counts) == want and listener.failed == 0
    finally:
        spark.streams.removeListener(listener)


def test_reports_read_only_their_days(spark, tmp_path):
    """Reports on a table partitioned by date prune its partitions, and answer as on the plain rows."""
    rows = [(i, *r[:3], "text", r[3], r[4], r[5]) for i, r in enumerate(_events(500))] + [(9000, "no-time", "p1", "HIGH", "text", 0.5, 5, None)]
    schema = "id long, alert_id string, patient_id string, severity string, recommendation_text string, confidence_score double, processing_ms int, created_at timestamp_ntz"
    plain = spark.createDataFrame(rows, schema)
    append_audit(plain, str(tmp_path), "alert_id", ["id"], time="created_at")
    table = stored(spark, str(tmp_path), plain.withColumn("audit_day", F.to_date("created_at")).schema)
    now = F.lit(START + timedelta(days=3)).cast("timestamp_ntz")
    stats = an.dashboard_stats(table, now)
    assert stats.first() == an.dashboard_stats(plain, now).first()
    for size in (1, 20, 100):
        for page in (1, 3, 9):
            items, total = an.recent_feed(table, page, size, "high")
            want, n = an.recent_feed(plain, page, size, "high")
            assert items.collect() == want.collect() and total.first() == n.first()
    for plan in (stats, an.recent_feed(table, 1, 20)[0], an.recent_counts(table, now)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(audit_day" in text or "PartitionFilters: [(audit_day" in text, text
