import datetime as dt
import os
import tempfile
import uuid

import pytest

from pyspark.sql import functions as F

from codegauge.session import checkpoint_dir
from codegauge.sources import files as SRC
from codegauge.sources import fixtures as FX
from codegauge.streaming import changes as CH

from conftest import SF001


def test_scan_and_decode(spark):
    root = tempfile.mkdtemp(prefix="cg-scan-")
    layout = {"src/a.py": b"x = 1\r\ny = 2\r\n", "src/b.TS": b"let a", "node_modules/m.js": b"1",
              "build/z.py": b"1", "src/bad.py": b"\xff\xfe", "README.md": b"#", "inc/h.h": b"int x;"}
    for rel, data in layout.items():
        os.makedirs(os.path.join(root, os.path.dirname(rel)), exist_ok=True)
        with open(os.path.join(root, rel), "wb") as f:
            f.write(data)
    g = {r.path for r in SRC.scan_source_files(spark, root, project_id=1).collect()}
    assert g == {"src/a.py", "src/bad.py", "inc/h.h"}
    s = {r.path for r in SRC.scan_source_files(spark, root, project_id=1, scoring=True).collect()}
    assert s == {"src/a.py", "src/b.TS", "node_modules/m.js", "build/z.py", "src/bad.py", "inc/h.h"}
    d = {r.path: r for r in SRC.decode_source(SRC.scan_source_files(spark, root, project_id=1)).collect()}
    assert "src/bad.py" not in d
    assert d["src/a.py"].content == "x = 1\ny = 2\n" and d["src/a.py"].raw_hash != d["src/a.py"].content_hash


def test_monitor_filter(spark):
    paths = ["src/a.py", "node_modules/x.js", "src/.git/c.py", "a/b.log", "x.TSX", "notes.txt", "dist/y.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    got = {r.path: r.m for r in df.select("path", CH.should_monitor(F.col("path")).alias("m")).collect()}
    assert got == {"src/a.py": True, "node_modules/x.js": False, "src/.git/c.py": False, "a/b.log": False,
                   "x.TSX": True, "notes.txt": False, "dist/y.md": False}


def test_stream_sessions_equal_batch_for_closed_sessions(spark):
    ch = FX.file_changes(spark, SF001)
    base = f"{checkpoint_dir(spark)}/test-stream-{uuid.uuid4().hex}"
    ch.write.parquet(f"{base}/src")
    CH.run_session_stream(spark, f"{base}/src", f"{base}/out", f"{base}/ck", gap="600 seconds", watermark="10 minutes")
    streamed = {(r.project_id, r.session_start.replace(tzinfo=None), r.n_events)
                for r in spark.read.parquet(f"{base}/out").collect()}
    mon = CH.monitored(CH.expand_moves(ch))
    batch = CH.debounce_sessions(mon, 600).collect()
    last = mon.agg(F.max("ts")).first()[0]
    closed = {(r.project_id, r.session_start, r.n_events) for r in batch
              if r.session_end < last - __import__("datetime").timedelta(minutes=10)}
    assert closed and closed <= streamed
    assert len(streamed - {(r.project_id, r.session_start, r.n_events) for r in batch}) == 0


def test_apply_stream_equals_batch(spark):
    ch = FX.file_changes(spark, SF001)
    base = f"{checkpoint_dir(spark)}/test-apply-{uuid.uuid4().hex}"
    ch.repartition(5, "event_id").write.parquet(f"{base}/src")  # batches in no order of time
    CH.run_apply_stream(spark, f"{base}/src", f"{base}/snap", f"{base}/ck", max_files=1)
    assert spark.read.parquet(f"{base}/snap").select("batch").distinct().count() >= 4
    streamed = sorted((r.project_id, r.path) for r in CH.read_snapshot_files(spark, f"{base}/snap").collect())
    latest = CH.latest_change_per_path(CH.monitored(CH.expand_moves(ch)))
    empty = spark.createDataFrame([], "project_id LONG, path STRING")
    assert streamed == sorted((r.project_id, r.path) for r in CH.apply_changes(empty, latest).collect())


def test_late_batch_does_not_override(spark):
    base = f"{checkpoint_dir(spark)}/test-late-{uuid.uuid4().hex}"
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    for rows in ([(1, "src/a.py", None, "deleted", t(10), 5), (1, "src/b.py", None, "created", t(2), 2)],
                 [(1, "src/a.py", None, "modified", t(1), 1), (2, "src/a.py", None, "created", t(1), 3)]):
        spark.createDataFrame(rows, CH.CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/src")
        CH.run_apply_stream(spark, f"{base}/src", f"{base}/snap", f"{base}/ck")
    got = sorted((r.project_id, r.path) for r in CH.read_snapshot_files(spark, f"{base}/snap").collect())
    assert got == [(1, "src/b.py"), (2, "src/a.py")]  # the deletion at 00:10 stands


def test_stored_views_follow_their_input(spark, tmp_path):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    d = str(tmp_path)
    li.limit(40).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    before = FX.code_lines(spark, d).count(), FX.code_files(spark, d).count()
    assert before[0] == 40
    li.orderBy(F.desc("l_partkey")).limit(25).coalesce(1).write.mode("append").parquet(f"{d}/lineitem.parquet")
    assert FX.code_lines(spark, d).count() == 65 and FX.code_files(spark, d).count() > before[1]


def test_shared_folder_is_required_off_local_masters(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_callers_settings_stay(spark):
    from codegauge.session import tune
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64MB")
    tune(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "64MB"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_emptied_snapshot_partition(spark):
    from codegauge.operators import snapshots as SN
    path = f"{checkpoint_dir(spark)}/test-snap-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([("a", 1, "main"), ("b", 2, "main")], "path STRING, project_id LONG, branch STRING")
    SN.write_snapshot(rows, path)
    SN.write_snapshot(rows.filter("false"), path, replaced=[(1, "main")])
    assert [r.path for r in SN.read_snapshot(spark, path).collect()] == ["b"]


def test_tree_to_score_with_defaults(spark, tmp_path):
    """Scan, decode, lines, metrics, extraction, edges and score of a real tree, string project id and all."""
    from codegauge.operators import extract as E
    from codegauge.operators import findings as FD
    from codegauge.operators import graph as G
    from codegauge.operators import metrics as M
    from codegauge.operators import scoring as SC
    root = tmp_path / "tree+(1).x"
    layout = {"src/a.py": "import os\n\ndef f(a):\n    if a:\n        return 1\n", "src/u.js": "const k = (x) => x\n" * 3 + "class Q {}\n",
              "src/m.js": "import q from './u'\nfunction go(x) {\n}\n", "node_modules/z.js": "import a from '../src/u'\n", "notes.txt": "x"}
    for rel, text in layout.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(text)
    files = SRC.decode_source(SRC.scan_source_files(spark, str(root))).withColumn("lang", G.graph_language("path"))
    assert sorted(r.path for r in files.collect()) == ["src/a.py", "src/m.js", "src/u.js"]
    keys = ["project_id", "path"]
    ext = E.analyze_files(files).cache()
    ents = {(r.path, r.name, r.line_number) for r in E.entities(ext).collect()}
    assert ents == {("src/a.py", "f", 3), ("src/u.js", "k", 1), ("src/u.js", "k", 2), ("src/u.js", "k", 3), ("src/u.js", "Q", 4), ("src/m.js", "go", 2)}
    nodes = G.file_nodes(files)
    edges = G.import_edges(G.resolve_imports(E.imports(ext), files.select(*keys)), nodes)
    assert [(r.src, r.dst) for r in edges.collect()] == [("src/m.js", "src/u.js")]
    m = M.file_metrics(SRC.file_lines(files, keys), keys).withColumnRenamed("lang", "language")
    none = FD.finding_counts(spark.createDataFrame([], "project_id STRING, path STRING, severity STRING, category STRING, rule_id STRING, message STRING"), keys)
    scores = SC.score_files(m, none, SC.derived_issue_penalty(m, keys), keys).collect()
    assert len(scores) == 3 and all(0 <= r.total_score <= 110 and r.grade for r in scores)
    assert len({r.project_id for r in scores}) == 1


def test_entry_contract(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.count() == 5
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
