"""Steps that grew faster than the input: numbering of lines, texts of files, duplicate blocks, extraction, chain state."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from codegauge.operators import extract as E
from codegauge.operators import metrics as M
from codegauge.operators import ordered as O
from codegauge.plans import q_changes, q_misc
from codegauge.session import checkpoint_dir
from codegauge.sources import fixtures as FX
from codegauge.streaming import debounce as DB

from conftest import SF001


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def lineitem(spark):
    r = random.Random(3)
    rows = [(r.randrange(1 << 16), r.choice([1, 1, 1, 2, 3, 4, None]), r.randrange(1, 4), r.randrange(1, 5)) for _ in range(400)]
    sf = f"{checkpoint_dir(spark)}/test-lines-{uuid.uuid4().hex}"
    d = spark.createDataFrame(rows + rows[:40], "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT")  # some rows come twice
    d.write.parquet(f"{sf}/lineitem.parquet")
    return sf, rows + rows[:40]


def test_rows_of_long_and_short_files(spark):
    """short files are one window, long ones go by buckets; both number alike, and only the key columns are shuffled."""
    sf, rows = lineitem(spark)
    got = [sorted(map(tuple, FX.code_rows(spark, sf, "l_partkey", long_file=n).collect())) for n in (10, 1 << 16)]
    assert got[0] == got[1] and len(got[0]) == sum(r[1] is not None for r in rows)
    for file in (1, 2, 3, 4):
        mine = sorted((r[0], r[3], r[2]) for r in rows if r[1] == file)
        assert [(x[2], x[3]) for x in got[1] if x[0] == file] == [(i, o) for i, (o, _, _) in enumerate(mine)]
    assert exchanges(FX.code_rows(spark, sf, "l_partkey")) == 1


def test_files_hold_their_lines_in_order(spark):
    """texts and paths from one exchange per key; paths alone need no text."""
    sf, rows = lineitem(spark)
    files = {r.path: r for r in FX.code_files(spark, sf).collect()}
    assert {(r.project_id, r.path) for r in files.values()} == {tuple(r) for r in FX.file_paths(spark, sf).collect()}
    lines = FX.code_rows(spark, sf, "l_suppkey").withColumn("line", F.expr(FX.S.RENDER_LINE)).filter("file_id = 1").orderBy("pos")
    assert files["lib/s1.js"].content == "\n".join(r.line for r in lines.collect())
    assert files["lib/s1.js"].size_bytes == len(files["lib/s1.js"].content)


def test_folder_moves_read_no_text(spark, monkeypatch):
    """only the paths of the files are built."""
    def fail(*_):
        raise AssertionError("texts are built")
    monkeypatch.setattr(FX, "code_files", fail)
    assert q_changes.folder_moves(spark, SF001).count() > 0


def test_short_files_are_windows_in_place(spark):
    """The same folds, markers and duplicates as by blocks, with one exchange by file."""
    r = random.Random(5)
    rows = [(f, "python", i, r.choice(["def a(b):", "    if x:", "x = 1", "x = 1", "", "end"])) for f, n in ((1, 9), (2, 120), (3, 33), (4, 2)) for i in range(n)]
    lines = spark.createDataFrame(rows + [(None, "python", 0, "x")], "file_id LONG, lang STRING, pos INT, line STRING")
    K = ["file_id"]
    for call in (lambda b: M.duplicate_blocks(lines, K, block_size=b), lambda b: M.long_functions(lines, K, block_size=b),
                 lambda b: O.clamped_scan(lines.withColumn("s", F.length("line") % 3 - 1), K, "pos", {"s": "p"}, b),
                 lambda b: O.next_marker(lines.filter("line = 'end'"), K, "pos", block_size=b)):
        some = [sorted(map(repr, map(tuple, call(b).collect()))) for b in (8, 64, 4096)]
        assert some[0] == some[1] == some[2]
    assert exchanges(M.duplicate_blocks(lines, K)) == 1 and exchanges(M.fold_metrics(lines, K)) == 1


def test_patterns_run_where_their_parts_occur(spark):
    """Every pattern has the literal parts that each of its matches holds, and finds what it found."""
    text = {E.JS_FUNCTION_PATTERNS[0]: "function a (", E.JS_FUNCTION_PATTERNS[1]: "const a = (", E.JS_FUNCTION_PATTERNS[2]: "a: function (",
            E.JS_FUNCTION_PATTERNS[3]: "a => ", E.JS_CLASS_PATTERN: "class a", E.JS_IMPORT_PATTERNS[0]: "import x from 'a'",
            E.JS_IMPORT_PATTERNS[1]: "import 'a'", E.JS_IMPORT_PATTERNS[2]: "require('a')"}
    assert set(E.JS_PARTS) == set(text) and all(part in text[p] for p, parts in E.JS_PARTS.items() for part in parts)
    rows = [(1, f"f{i}.js", "javascript", "\n" + x) for i, x in enumerate(text.values())] + [(1, "n.js", "javascript", "x = 1")]
    got = E.analyze_files(spark.createDataFrame(rows, "project_id LONG, path STRING, lang STRING, content STRING")).collect()
    assert sorted(r.path for r in got) == [f"f{i}.js" for i in range(8)] and {r.name for r in got} == {"a"}


def test_report_extracts_once(spark, monkeypatch):
    """both halves of the report share the extracted files and their ratings."""
    calls, real = [], E.analyze_files
    monkeypatch.setattr(E, "analyze_files", lambda files: calls.append(1) or real(files))
    q_misc.project_report(spark, SF001)
    assert len(calls) == 1


class Handle:
    """State in memory that counts the calls."""

    def __init__(self):
        self.map, self.value, self.calls, self.timers = {}, None, 0, set()

    def getMapState(self, *_):
        outer = self

        class Map:
            def getValue(self, k):
                outer.calls += 1
                return outer.map.get(k)

            def updateValue(self, k, v):
                outer.calls += 1
                outer.map[k] = v

            def removeKey(self, k):
                outer.calls += 1
                del outer.map[k]

            def iterator(self):
                return iter(list(outer.map.items()))
        return Map()

    def getValueState(self, *_):
        outer = self

        class Value:
            def exists(self):
                return outer.value is not None

            def get(self):
                return outer.value

            def update(self, v):
                outer.value = v

            def clear(self):
                outer.value = None
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_calls_do_not_grow_with_paths():
    """a batch of 2,000 paths costs two calls a cell, and every chain comes out once the watermark has passed it."""
    p, h = DB.PathChains(10_000_000), Handle()
    p.init(h)
    ts = dt.datetime(2024, 1, 1)
    rows = [(1, 0, f"src/p{i}.py", "modified", s * 1_000_000, i * 10 + s, 0, ts) for i in range(2000) for s in (0, 5, 60)]
    p.handleInputRows((1, 0), iter(rows), Now(0))
    assert h.calls <= 2 * DB.CELLS
    first = list(p.handleExpiredTimer((1, 0), Now(20_000), None))
    assert len(first) == 2000 and {(r.start_us, r.last_us) for r in first} == {(0, 5_000_000)}
    rest = list(p.handleExpiredTimer((1, 0), Now(80_000), None))
    assert len(rest) == 2000 and not h.map and {r.path for r in rest} == {r[2] for r in rows}
