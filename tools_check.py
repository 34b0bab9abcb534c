"""Run registered queries in Spark and DuckDB side by side and compare the rows.

    python tools_check.py [sf] [key prefix ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import threading
import time

import duckdb

from tracegraph.plans import ORACLES, QUERIES
from tracegraph.session import local_session
from tracegraph.sources.starview import TABLES


def normal(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return f"{value:.9g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def limited(seconds, stop, work):
    """Run ``work`` and call ``stop`` when it takes too long."""
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return work()
    finally:
        timer.cancel()


def compare(spark, con, key, directory):
    t0 = time.time()

    def run():
        df = QUERIES[key](spark, directory)
        return df, df.collect()

    df, collected = limited(90, spark.sparkContext.cancelAllJobs, run)
    got = rows_of(df.columns, collected)
    took = time.time() - t0
    if key not in ORACLES:
        return "rows-only", len(got), took, ""
    t1 = time.time()
    cur = limited(60, con.interrupt, lambda: con.execute(ORACLES[key]))
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    duck = time.time() - t1
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(columns)}"
    if got == want:
        note = f"duck {duck:.1f}s" if duck > 3 else ""
        return "ok", len(got), took, note
    have, need = set(got), set(want)
    missing = [r for r in want if r not in have][:3]
    extra = [r for r in got if r not in need][:3]
    return "DIFF", len(got), took, f"spark {len(got)} duck {len(want)}\n   cols {sorted(columns)}\n   only duck {missing}\n   only spark {extra}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = [a for a in sys.argv[2:] if not a.startswith("from=")]
    since = next((a[5:] for a in sys.argv[2:] if a.startswith("from=")), None)
    directory = f"/root/testdata/sf{sf}"
    spark = local_session(cores="8")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    bad = 0
    for key in QUERIES:
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        if since and key != since:
            continue
        since = None
        try:
            status, n, took, note = compare(spark, con, key, directory)
        except Exception as err:  # noqa: BLE001
            status, n, took, note = "ERROR", 0, 0.0, str(err)[:700]
        bad += status not in ("ok", "rows-only")
        print(f"{status:9s} {key:40s} {n:8d} rows {took:6.1f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
