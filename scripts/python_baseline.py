"""Single-process baseline: the per-file metric rules over the same line views, as window SQL in DuckDB on one thread.

The reference publishes no timings and is not run here. For a single-node figure on the same data this times the SQL twin
of the per-file metrics (sizes, counts, folds, long functions, duplicates) in one process with one thread.
usage: python scripts/python_baseline.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    import duckdb
    from codegauge.plans.registry import load_all
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    _, oracle = load_all()
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet')")
    out = {}
    for name in ("maintainability_and_debt", "long_functions", "cognitive_complexity", "cyclomatic_complexity", "duplicate_blocks"):
        t = time.time()
        rows = len(con.sql(oracle[name]).fetchall())
        out[name] = {"rows": rows, "sec": round(time.time() - t, 3)}
    print(json.dumps({"baseline": "DuckDB SQL, one thread, per-file metric rules", "sf": sf, "queries": out}))


if __name__ == "__main__":
    main()
