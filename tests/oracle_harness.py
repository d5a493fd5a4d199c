"""Run registered Spark queries next to their DuckDB oracle SQL and compare.

Mirrors the driver's check: columns sorted by name, row multiset compared
order-insensitively (floats rounded), row counts and column names equal.

CLI: ``python tests/oracle_harness.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t)), [cols[i] for i in order]


def compare(spark, sf_dir: str, names=None, verbose=True):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as se

    qs, sqls = se.queries(), se.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        if name not in sqls:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            results[name] = ("rows-only", n, round(time.time() - t0, 2))
            if verbose:
                print(f"{name:34s} rows-only n={n} {results[name][2]}s", flush=True)
            continue
        t0 = time.time()
        sdf = qs[name](spark, sf_dir)
        scols = sdf.columns
        srecs = [tuple(r) for r in sdf.collect()]
        t1 = time.time()
        rel = con.sql(sqls[name])
        dcols = rel.columns
        drecs = rel.fetchall()
        srows, sc = _rows(scols, srecs)
        drows, dc = _rows(dcols, drecs)
        ok = sc == dc and srows == drows
        why = ""
        if sc != dc:
            why = f"cols spark={sc} duck={dc}"
        elif len(srows) != len(drows):
            why = f"rows spark={len(srows)} duck={len(drows)}"
        elif srows != drows:
            diff = [(a, b) for a, b in zip(srows, drows) if a != b][:2]
            why = f"values differ e.g. {diff}"
        results[name] = ("ok" if ok else "FAIL", len(srows), round(t1 - t0, 2), why)
        if verbose:
            print(f"{name:34s} {'ok' if ok else 'FAIL'} n={len(srows)} spark={t1 - t0:.2f}s {why[:600]}", flush=True)
    return results


if __name__ == "__main__":
    sys.path.insert(0, ROOT)
    from wardwatch.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] == "FAIL"]
    print("FAILED:", bad)
