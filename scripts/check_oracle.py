"""Run registered queries in Spark and their SQL twins in DuckDB, compare the results.

usage: python scripts/check_oracle.py [sf_dir] [name ...]
Rows are compared as multisets after sorting columns by name and rounding doubles to 6 digits.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def main():
    import duckdb
    from codegauge.session import get_session
    from codegauge.plans.registry import load_all
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    queries, oracle = load_all()
    names = names or list(queries)
    spark = get_session("local[8]", 8)
    if os.environ.get("CG_TZ"):  # run the Spark side in another session time zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["CG_TZ"])
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = queries[n](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} SPARK ERROR {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in oracle:
            print(f"{n:28s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.sql(oracle[n])
            drows = res.fetchall()
            dcols = res.columns
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} DUCKDB ERROR {str(e)[:400]}")
            bad += 1
            continue
        a, ac = rows_of(scols, srows)
        b, bc = rows_of(dcols, drows)
        ok = a == b and ac == bc
        bad += not ok
        print(f"{n:28s} {'OK ' if ok else 'MISMATCH'} spark={len(srows)} duck={len(drows)} {ts:.1f}s")
        if not ok:
            if ac != bc:
                print("   cols", ac, bc)
            da, db = a - b, b - a
            print("   spark-only", list(da.items())[:3])
            print("   duck-only ", list(db.items())[:3])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
