import datetime as dt
import random

from pyspark.sql import functions as F

from codegauge.operators import project as PR
from codegauge.operators import snapshots as SN
from codegauge.operators.ordered import sessionize


def test_sessionize_across_buckets_matches_loop(spark):
    rng = random.Random(9)
    base = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for proj in range(3):
        t = base
        for _ in range(rng.randint(5, 60)):
            t = t + dt.timedelta(seconds=rng.choice([1, 5, 30, 59, 60, 61, 200, 600, 601, 3000]))
            for _ in range(rng.choice([1, 1, 2])):      # equal timestamps, ordered by event id
                rows.append((proj, t, eid))
                eid += 1
    df = spark.createDataFrame(rows, "project_id LONG, ts TIMESTAMP_NTZ, event_id LONG")
    got = {r.event_id: r.session_no for r in sessionize(df, ["project_id"], "ts", 60, ["event_id"]).collect()}
    for proj in range(3):
        n, prev = 0, None
        for _, t, e in sorted(x for x in rows if x[0] == proj):
            if prev is None or (t - prev).total_seconds() >= 60:
                n += 1
            prev = t
            assert got[e] == n, (proj, e)


def test_git_log_and_numstat_ingest(spark):
    logs = spark.createDataFrame([("abc|1700000000|ann",), ("abc|x|ann",), ("abc|1",), ("a|1|b|c",)], "line STRING")
    got = SN.ingest_git_log(logs).collect()
    assert [(r.commit_hash, r.author, r.commit_time) for r in got] == [("abc", "ann", dt.datetime(2023, 11, 14, 22, 13, 20))]
    ns = spark.createDataFrame([("10\t15\ta.py",), ("-\t-\tb.bin",), ("90\t20\tc.py",), ("x\t1\td.py",)], "line STRING")
    got = [(r.lines_changed, r.risk_level) for r in SN.ingest_numstat(ns).collect()]
    assert got == [(25, "medium"), (0, "low"), (110, "high"), (0, "low")]


def test_changes_stay_in_their_project(spark):
    """Two projects with the same path: each takes its own diff counts and commit times."""
    files = spark.createDataFrame([(1, "a.py", "h1"), (2, "a.py", "h1")], "project_id LONG, path STRING, file_hash STRING")
    later = spark.createDataFrame([(1, "a.py", "h2"), (2, "a.py", "h3")], "project_id LONG, path STRING, file_hash STRING")
    stat = spark.createDataFrame([(1, "a.py", "400", "101", 1, 1), (2, "a.py", "3", "-", 1, 2), (2, "a.py", "9", "9", 0, 9)],
                                 "project_id LONG, path STRING, added STRING, deleted STRING, commit_seq LONG, line_no LONG")
    got = {r.project_id: (r.lines_changed, r.risk_level) for r in SN.change_summary(files, later, stat).collect()}
    assert got == {1: (501, "high"), 2: (3, "low")}
    t = lambda d: dt.datetime(2024, 1, d)
    seen = spark.createDataFrame([(1, "a.py", t(1)), (2, "a.py", t(1))], "project_id LONG, path STRING, last_modified TIMESTAMP_NTZ")
    done = spark.createDataFrame([(1, "a.py", t(5)), (1, "a.py", t(3))], "project_id LONG, path STRING, commit_time TIMESTAMP_NTZ")
    assert {r.project_id: r.last_modified for r in SN.attach_commit_time(seen, done).collect()} == {1: t(5), 2: t(1)}


def test_git_log_strips_carriage_returns(spark):
    got = SN.ingest_git_log(spark.createDataFrame([("abc|1700000000|ann\r",)], "line STRING")).first()
    assert got.author == "ann"


def test_project_context_rules(spark):
    listing = [
        (1, "package.json", '{"version": "2.1.0", "dependencies": {"react": "1"}, "devDependencies": {"next": "1"}}'),
        (1, "yarn.lock", ""), (1, "webpack.config.js", ""), (1, "Packages/x.js", ""), (1, "src/a.ts", ""),
        (1, "src/b.ts", ""), (1, "src/c.py", ""),
        (2, "package.json", '{"dependencies": '), (2, "pyproject.toml", 'name = "x"\nversion = "0.9"\n'),
        (2, "Makefile", ""), (2, "requirements.txt", ""), (2, "SRC/a.py", ""), (2, "views/v.js", ""),
        (3, "x/pom.xml", ""), (3, "Controllers/c.java", ""), (3, "models/m.java", ""), (3, "views/v.java", ""),
        (3, "a.h", ""), (3, "b.h", ""), (3, "c.java", ""),
    ]
    df = spark.createDataFrame(listing, "project_id LONG, path STRING, content STRING")
    got = {r.project_id: (r.framework, r.architecture, r.build_system, r.package_manager, r.version, r.main_language)
           for r in PR.project_context(df).collect()}
    assert got[1] == ("next", "monorepo", "webpack", "yarn", "2.1.0", "javascript")   # 2 js (config counts) vs 2 ts
    assert got[2] == ("python", "spa", "make", "pip", "0.9", "javascript")   # tie py/js -> language name order
    assert got[3] == ("unknown", "mvc", "unknown", "unknown", "0.0.0", "java")  # nested pom.xml is not a root marker


def test_snapshot_compare_and_upsert(spark):
    a = spark.createDataFrame([(1, "x", "h1"), (1, "y", "h2")], "project_id LONG, path STRING, file_hash STRING")
    b = spark.createDataFrame([(1, "y", "h3"), (1, "z", "h4")], "project_id LONG, path STRING, file_hash STRING")
    got = {r.path: (r.status, r.modified) for r in SN.compare_snapshots(a, b).collect()}
    assert got == {"x": ("removed", False), "y": ("common", True), "z": ("added", False)}
    old = spark.createDataFrame([(1, "main", "v1"), (1, "dev", "v2")], "project_id LONG, branch STRING, version STRING")
    new = spark.createDataFrame([(1, "main", "v9")], "project_id LONG, branch STRING, version STRING")
    assert {(r.branch, r.version) for r in SN.upsert_branch_contexts(old, new).collect()} == {("main", "v9"), ("dev", "v2")}
    bt = spark.createDataFrame([(b_,) for b_ in ["main", "dev", "feature/a", "hotfix/b", "release/c", "x"]], "b STRING")
    kinds = [r.k for r in bt.select(SN.branch_type(F.col("b")).alias("k")).collect()]
    assert kinds == ["main", "develop", "feature", "hotfix", "release", "other"]
