"""Age rule and the trailing 24h count against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wardwatch.operators.context import age_years, trailing_count


def test_age_rows(spark):
    rows = [("2000-02-29", "2001-02-28", 0), ("2000-02-29", "2001-03-01", 1),
            ("1960-06-15", "2024-06-14", 63), ("1960-06-15", "2024-06-15", 64)]
    df = spark.createDataFrame(rows, "b string, o string, want int")
    out = df.select(age_years(F.to_date("b"), F.to_date("o")).alias("a"), "want").collect()
    assert all(r.a == r.want for r in out)


def test_trailing_count_brute_force(spark):
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    ev = [(f"p{rnd.randrange(4)}", base + dt.timedelta(seconds=rnd.randrange(0, 5 * 86400))) for _ in range(400)]
    left = spark.createDataFrame([(str(i), p, t) for i, (p, t) in enumerate(ev)], "id string, patient_id string, ts timestamp_ntz")
    right = spark.createDataFrame(ev, "patient_id string, created_at timestamp_ntz")
    got = {r.id: r.recent_count for r in trailing_count(left, right, "patient_id", "ts", "created_at").collect()}
    for i, (p, t) in enumerate(ev):
        want = sum(1 for q, s in ev if q == p and t - dt.timedelta(hours=24) < s < t)
        assert got[str(i)] == want


def test_context_misses_over_all_patients(spark, tmp_path):
    """Only an alert of a patient without a record is a miss, whatever the patient's id ends in."""
    from wardwatch.plans import catalog

    users = [7, 17, 27, 8, 99]
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    events = [(i, at + dt.timedelta(hours=i), u, "error", 1.0, "{}") for i, u in enumerate(users, 1)]
    ntz = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, ntz).write.parquet(f"{tmp_path}/events.parquet")
    customers = [(u, f"Customer#{u}", 1, "BUILDING") for u in users[:-1]]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.q_context_misses(spark, str(tmp_path)).first()
    n = catalog.alerts(spark, str(tmp_path)).count()
    missing = catalog.alerts(spark, str(tmp_path)).where("patient_id = 'PT-000099'").count()
    assert n == len(users) and missing == 1
    assert (got.n_alerts, got.n_missing) == (n, missing)
