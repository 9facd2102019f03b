"""File contexts as rows, directory events, folder moves."""

import datetime as dt

from codegauge.operators.context_store import ContextStore
from codegauge.streaming import changes as CH

T = dt.datetime(2024, 1, 1)


def store(spark):
    files = spark.createDataFrame([(1, "a.js", "javascript", 10, 2, 0.3, T), (1, "b.js", "javascript", 5, 1, 0.0, None), (2, "a.js", None, 1, 1, 0.0, None)],
                                  "project_id LONG, path STRING, language STRING, size_bytes LONG, line_count LONG, risk_score DOUBLE, last_modified TIMESTAMP_NTZ")
    ents = spark.createDataFrame([(1, "a.js", "f", "function", 1), (2, "a.js", "g", "class", 4), (1, "gone.js", "x", "class", 1)], "project_id LONG, path STRING, name STRING, entity_type STRING, line_number LONG")
    edges = spark.createDataFrame([(1, "a.js", "b.js", "imports"), (1, "b.js", "b.js", "imports")], "project_id LONG, src STRING, dst STRING, relation_type STRING")
    imps = spark.createDataFrame([(1, "a.js", "./b"), (1, "a.js", "./b"), (1, "b.js", "./b")], "project_id LONG, path STRING, specifier STRING")
    return ContextStore(spark, 4).save(files, ents, edges, imps)


def test_context_rows(spark):
    s = store(spark)
    got = sorted(map(tuple, s.rows().collect()))
    assert got == sorted([(1, "a.js", "file", "", "javascript|10|2|3|2024-01-01 00:00:00"), (1, "b.js", "file", "", "javascript|5|1|0|"), (2, "a.js", "file", "", "|1|1|0|"),
                          (1, "a.js", "entity", "f", "function|1"), (2, "a.js", "entity", "g", "class|4"),
                          (1, "a.js", "dependency", "b.js", "imports"), (1, "b.js", "dependency", "b.js", "imports"),
                          (1, "b.js", "dependent", "a.js", "imports"), (1, "b.js", "dependent", "b.js", "imports"),
                          (1, "a.js", "import", "./b", "2"), (1, "b.js", "import", "./b", "1")])
    one = spark.createDataFrame([(1, "b.js"), (1, "b.js"), (7, "none.js")], "project_id LONG, path STRING")
    assert sorted(map(tuple, s.rows(one).collect())) == [x for x in got if x[:2] == (1, "b.js")]
    s.drop()


def test_context_joins_do_not_shuffle(spark):
    s = store(spark)
    for kind in ("entities", "dependencies", "imports"):
        joined = s.table(kind).join(s.table("files").select("project_id", "path"), ["project_id", "path"], "left_semi")
        assert "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
    s.drop()


def test_directories_and_folder_moves(spark):
    rows = [(1, "src", "lib", "moved", T, 1, True), (1, "src/", None, "modified", T, 2, True), (1, "src/a.py", None, "modified", T, 3, False), (1, "x.py", None, "created", T, 4, None),
            (1, "src/in", "out/in", "moved", T, 5, True), (1, "src", None, "moved", T, 6, True)]
    events = spark.createDataFrame(rows, CH.EVENT_SCHEMA)
    assert sorted(r.event_id for r in CH.file_events(events).collect()) == [3, 4]
    files = spark.createDataFrame([(1, "src/a.py"), (1, "src/in/b.py"), (1, "srcs/c.py"), (2, "src/a.py"), (1, "top.py")], "project_id LONG, path STRING")
    moves = sorted((r.event_id, r.path, r.dest_path) for r in CH.folder_moves(events, files).collect())
    assert moves == [(1, "src/a.py", "lib/a.py"), (1, "src/in/b.py", "lib/in/b.py"), (5, "src/in/b.py", "out/in/b.py")]
    both = CH.file_events(events).unionByName(CH.folder_moves(events, files))
    last = {r.path: r.change_type for r in CH.latest_change_per_path(CH.monitored(CH.expand_moves(both))).collect()}
    assert last["lib/a.py"] == "created" and last["out/in/b.py"] == "created" and last["src/in/b.py"] == "deleted"
