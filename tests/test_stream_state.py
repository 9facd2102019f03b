"""Debounced batches as a stream, late rows, progress, and whole snapshots."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from codegauge.operators import snapshot_store as ST
from codegauge.session import checkpoint_dir
from codegauge.streaming import changes as CH
from codegauge.streaming import debounce as DB
from codegauge.streaming import progress as PG

GAP = 600


def t(seconds):
    return dt.datetime(2024, 3, 1) + dt.timedelta(seconds=seconds)


def folder(spark, name):
    return f"{checkpoint_dir(spark)}/test-{name}-{uuid.uuid4().hex}"


def batch_result(spark, rows, watermark):
    """Closed sessions by the batch operators: those that end no later than the last event time less the delay."""
    ch = spark.createDataFrame(rows, CH.CHANGE_SCHEMA)
    m = CH.monitored(CH.expand_moves(ch))
    last = m.agg(F.max("ts")).first()[0]
    s = CH.debounce_sessions(m, GAP, ["event_id", "sub"]).filter(F.col("session_end") <= F.lit(last - dt.timedelta(seconds=watermark)))
    d = CH.debounced_changes(ch, GAP).join(s.select("project_id", "session_no", "session_start", "session_end"), ["project_id", "session_no"])
    return sorted(map(tuple, d.select("project_id", "session_start", "session_end", "path", "change_type", "ts", "event_id").collect()))


def test_chains_merge_like_sessions():
    r = random.Random(1)
    for _ in range(300):
        points = [[x, x, i, 0, "m"] for i, x in enumerate(r.sample(range(60), r.randrange(1, 9)))]
        want, order = [], sorted(points)
        for p in order:
            if want and p[0] < want[-1][1] + 7:
                want[-1] = [want[-1][0], *p[1:]]
            else:
                want.append(list(p))
        r.shuffle(points)
        got = []
        for k in range(0, len(points), 2):  # in any order, a few at a time
            got = DB.merge_chains(got + points[k:k + 2], 7)
        assert got == want
    same = DB.merge_chains([[5, 5, 2, 0, "a"], [5, 5, 2, 1, "b"], [5, 5, 1, 9, "c"]], 7)
    assert same == [[5, 5, 2, 1, "b"]]  # of equal times the larger event id, then the later half


def test_sessions_over_runs_and_disorder(spark):
    """Four batches within the watermark's delay, two runs from the same checkpoints; a project with most changes, moves and several chains of a path in a session."""
    r = random.Random(7)
    rows, now = [], 0
    for i in range(240):
        now += r.choice([20, 90, 300, 900])
        kind = r.choice(["created", "modified", "deleted", "moved"])
        rows.append((r.choice([1, 1, 1, 2]), f"src/p{r.randrange(6)}.py", f"src/q{r.randrange(3)}.py" if kind == "moved" else None, kind, t(now), i))
    base = folder(spark, "debounce")
    for part in (rows[:60], rows[60:130], rows[130:200], rows[200:]):
        r.shuffle(part)
    done = []
    for k in (0, 130):
        more = rows[k:k + 130]
        spark.createDataFrame(more, CH.CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/src")
        done += more
        got = DB.run_debounce_stream(spark, f"{base}/src", base, GAP, watermark="2 hours")
        cols = got.select("project_id", "session_start", "session_end", "path", "change_type", "ts", "event_id")
        assert sorted(map(tuple, cols.collect())) == batch_result(spark, done, 7200)
    assert cols.count() > 100


def test_no_changes(spark):
    base = folder(spark, "nothing")
    spark.createDataFrame([], CH.CHANGE_SCHEMA).write.parquet(f"{base}/src")
    q = DB.run_chain_stream(spark, f"{base}/src", f"{base}/chains", f"{base}/ck", GAP)
    assert not q.isActive


def test_progress_is_kept_per_batch(spark):
    base = folder(spark, "progress")
    rows = [(1, "src/a.py", None, "created", t(0), 1), (1, "src/a.py", None, "modified", t(90000), 2)]
    for k in range(2):
        spark.createDataFrame([rows[k]], CH.CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/src")
        q = DB.run_chain_stream(spark, f"{base}/src", f"{base}/chains", f"{base}/ck", GAP)
        PG.record_progress(spark, q, f"{base}/progress", name="c")
        PG.record_progress(spark, q, f"{base}/progress", name="c")  # twice: still one row per batch
    p = PG.read_progress(spark, f"{base}/progress")
    assert p.count() == p.select("batch_id").distinct().count() and p.agg(F.sum("input_rows")).first()[0] == 2
    s = PG.stream_status(p).first()
    assert (s.name, s.monitoring, s.input_rows, s.dropped_rows) == ("c", False, 2, 0) and s.last_batch_time is not None


# ------------------------------------------------------------------ whole snapshots
def frames(spark, files, entities, edges, contexts):
    f = spark.createDataFrame(files, "project_id LONG, branch STRING, path STRING, language STRING, size_bytes LONG, line_count LONG, complexity_level STRING, last_modified TIMESTAMP_NTZ, more INT")
    e = spark.createDataFrame(entities, "project_id LONG, branch STRING, path STRING, name STRING, line_number LONG, docstring STRING")
    g = spark.createDataFrame(edges, "project_id LONG, branch STRING, src STRING, dst STRING, relation_type STRING, strength DOUBLE")
    c = spark.createDataFrame(contexts, "project_id LONG, branch STRING, framework STRING")
    return ST.context_rows(c, f, F.concat(F.lit("/r/"), F.col("project_id").cast("string"))), f, e, g


def everything(spark, path):
    s = ST.load(spark, path)
    return ({(r.project_id, r.branch): (r.framework, r.total_files, r.total_lines, r.low, r.high) for r in s["context"].collect()},
            sorted((r.project_id, r.branch, r.path, r.size_bytes, r.last_modified) for r in s["file"].collect()),
            sorted((r.project_id, r.branch, r.path, r.name, r.docstring or "") for r in s["entity"].collect()),
            sorted((r.project_id, r.branch, r.src, r.dst, r.relation_type, r.strength) for r in s["edge"].collect()))


def test_snapshot_of_all_kinds(spark):
    path = folder(spark, "store")
    files = [(p, b, x, "python", 10, 3, lvl, t(1) if x == "a.py" else None, 9) for p in (1, 2) for b in ("main", "dev") for x, lvl in (("a.py", "low"), ("b.py", "high"))]
    ents = [(1, "main", "a.py", "f", 1, "doc"), (1, "main", "gone.py", "g", 1, None), (2, "dev", "b.py", "h", 2, None)]
    edges = [(1, "main", "a.py", "b.py", None, None), (1, "main", "a.py", "gone.py", "imports", 0.8), (2, "main", "b.py", "a.py", "imports", 0.8)]
    ctx = [(p, b, "node") for p in (1, 2) for b in ("main", "dev")]
    ST.save(path, *frames(spark, files, ents, edges, ctx))
    c, f, e, g = everything(spark, path)
    assert c[1, "main"] == ("node", 2, 6, 1, 1) and len(f) == 8 and f[0][-1] == t(1) and f[1][-1] is None
    assert e == [(1, "main", "a.py", "f", "doc"), (2, "dev", "b.py", "h", "")]
    assert g == [(1, "main", "a.py", "b.py", "unknown", 1.0), (2, "main", "b.py", "a.py", "imports", 0.8)]
    one = ST.load(spark, path, project_id=1, branch="main")["context"].first()
    import hashlib
    assert one.project_key == hashlib.md5(b"/r/1").hexdigest() and one.branch_key == hashlib.md5(b"/r/1#main").hexdigest()
    # project 1 main loses all files, and rows of branches that the save does not name are not written
    ST.save(path, *frames(spark, [(2, "dev", "new.py", "python", 1, 1, "low", None, 0)], ents, edges, [(1, "main", "none")]))
    c2, f2, e2, g2 = everything(spark, path)
    assert c2[1, "main"] == ("none", 0, 0, 0, 0) and len(f2) == 6 and (1, "main") not in {x[:2] for x in f2}
    assert e2 == [(2, "dev", "b.py", "h", "")] and g2 == [(2, "main", "b.py", "a.py", "imports", 0.8)]


def test_snapshot_filter_prunes_partitions(spark):
    path = folder(spark, "prune")
    ST.save(path, *frames(spark, [(p, "main", "a.py", "python", 1, 1, "low", None, 0) for p in (1, 2, 3)], [], [], [(p, "main", "x") for p in (1, 2, 3)]))
    plan = ST.load(spark, path, project_id=2)["file"]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(project_id" in plan


@pytest.mark.parametrize("name", ["stream_graph", "stream_late", "stream_status", "stream_debounced", "snapshot_full"])
def test_twins(spark, name):
    import sys
    sys.path.insert(0, "scripts")
    import duckdb
    from check_oracle import TABLES, rows_of
    import __spark_entry__ as se
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = se.queries()[name](spark, sf)
    r = con.execute(se.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(x) for x in df.collect()]) == rows_of([d[0] for d in r.description], r.fetchall())
