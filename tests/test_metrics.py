import random

from pyspark.sql import functions as F

from codegauge.functions.text import leading_ws, py_strip
from codegauge.operators import metrics as M
from codegauge.operators.graph import graph_language, metric_language
from codegauge.operators.ordered import clamped_scan, next_marker, ordinal, top_k

from conftest import lines_df

SAMPLE = "def f(a):\n    if a > 1:\n        return a\n    return 0\n"


def test_language_maps(spark):
    df = spark.createDataFrame([("module.py",), ("component.tsx",), ("archive.custom",), ("x.H",), ("lib.h",)], "p STRING")
    got = {r.p: (r.m, r.g) for r in df.select("p", metric_language("p").alias("m"), graph_language("p").alias("g")).collect()}
    assert got["module.py"] == ("python", "python")
    assert got["component.tsx"] == ("typescript", "typescript")
    assert got["archive.custom"] == (None, None)
    assert got["lib.h"] == (None, "c")      # listed in the graph, not scorable
    assert got["x.H"] == (None, None)       # graph suffix is case-sensitive


def test_python_strip_semantics(spark):
    s = "\t \u001c  x y  \r"
    r = spark.createDataFrame([(s,)], "l STRING").select(py_strip("l").alias("a"), leading_ws("l").alias("b")).first()
    assert r.a == s.strip()
    assert r.b == len(s) - len(s.lstrip())


def test_small_file_metrics(spark):
    m = M.file_metrics(lines_df(spark, {1: ("python", SAMPLE)}), ["file_id"]).first()
    assert m.lines_of_code > 0
    assert 0 <= m.maintainability_index <= 100
    assert m.technical_debt_minutes >= 0
    assert m.cyclomatic == 1 + SAMPLE.count("if") + SAMPLE.count("for") + SAMPLE.count("or")  # 'for' has an 'or'
    assert (m.cognitive, m.max_nesting) == (1, 2)  # "def" nests but scores nothing; the "if" scores level 1


FOLDS = [  # (language, lines, cognitive complexity, deepest nesting), worked by hand from the rules
    ("python", ["if a:", "    for b in c:", "        x = 1", "endif"], 3, 2),       # levels 1 + 2
    ("python", ["if a:", "x = 1", "if b:"], 3, 1),                                     # a flush line closes the nesting only
    ("python", ["try:", "    y = 1", "except E:", "    z = 1", "if q:"], 2, 1),        # except leaves a level: 1 + 1
    ("javascript", ["if (a) {", "}", "if (b) {", "}"], 2, 1),
    ("javascript", ["if (a) {", "while (b) {", "for (c) {", "}", "}", "}"], 6, 3),
    ("javascript", ["}", "}", "}", "if (a) {"], 1, 1),                                 # nothing is open: closers do not count
    ("javascript", ["x = 1", "y = 2"], 0, 0),
    ("java", ["if (a)", "    b();"], 0, 0),                                            # no block opens on this line
]


def test_folds_on_worked_examples(spark):
    files = {i: (lang, "\n".join(lines)) for i, (lang, lines, _, _) in enumerate(FOLDS)}
    got = {r.file_id: (r.cognitive, r.max_nesting) for r in M.fold_metrics(lines_df(spark, files), ["file_id"]).collect()}
    assert got == {i: (c, n) for i, (_, _, c, n) in enumerate(FOLDS)}


def test_folds_on_towers(spark):
    """n blocks opened inside each other score 1 + 2 + ... + n (up to the cap) and nest n deep; a closed copy in front adds its own."""
    opened = {n: ("javascript", "\n".join(["if (a) {"] * n)) for n in (1, 5, 12, 40)}
    closed = {100 + n: ("javascript", "\n".join(["if (a) {"] * n + ["}"] * n + ["if (a) {"] * n)) for n in (1, 5, 8)}
    got = {r.file_id: (r.cognitive, r.max_nesting) for r in M.fold_metrics(lines_df(spark, opened | closed), ["file_id"]).collect()}
    tri = lambda n: n * (n + 1) // 2
    assert got == {n: (min(100, tri(n)), n) for n in opened} | {100 + n: (min(100, 2 * tri(n)), n) for n in (1, 5, 8)}


def test_clamped_scan_across_blocks(spark):
    rng = random.Random(3)
    rows = []
    for key in range(5):
        for pos in range(rng.randint(1, 40)):
            rows.append((key, pos, rng.choice([-1, -1, 0, 1, 1, 1])))
    df = spark.createDataFrame(rows, "k LONG, pos LONG, d INT")
    out = clamped_scan(df, ["k"], "pos", {"d": "x"}, block_size=4).collect()
    got = {(r.k, r.pos): r.x_sum - min(r.x_floor, r.x_sum) for r in out}
    for key in range(5):
        n = 0
        for (k, pos, d) in sorted(x for x in rows if x[0] == key):
            n = max(0, n + d)
            assert got[(k, pos)] == n


def test_ordinal_next_marker_top_k(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 500), rng.random()) for k in range(3) for _ in range(80)]
    df = spark.createDataFrame(rows, "k LONG, t LONG, v DOUBLE")
    o = ordinal(df, ["k"], ["t", "v"], F.shiftright(F.col("t"), 3), out="o").collect()
    for key in range(3):
        want = sorted((t, v) for k, t, v in rows if k == key)
        got = sorted((r.o, (r.t, r.v)) for r in o if r.k == key)
        assert [x[1] for x in got] == want and [x[0] for x in got] == list(range(len(want)))
    pos = spark.createDataFrame([(0, p) for p in [3, 9, 10, 40, 41, 99]], "k LONG, pos LONG")
    nm = {r.pos: r.next_pos for r in next_marker(pos, ["k"], "pos", block_size=8).collect()}
    assert nm == {3: 9, 9: 10, 10: 40, 40: 41, 41: 99, 99: None}
    top = top_k(df, ["k"], ["t", "v"], 4).collect()
    for key in range(3):
        want = sorted((t, v) for k, t, v in rows if k == key)[:4]
        assert sorted((r.t, r.v) for r in top if r.k == key) == want
    assert top_k(df, ["k"], ["v"], None).count() == 240


def _pairs(spark, files, limit, block_size):
    rows = M.duplicate_blocks(lines_df(spark, files), ["file_id"], limit=limit, block_size=block_size).collect()
    return {f: [(r.first_line, r.second_line) for r in sorted(rows, key=lambda r: r.dup_rank) if r.file_id == f] for f in files}


def test_duplicates_in_equal_lines(spark):
    """In n equal lines every block equals every other: pair (i, j) for each j >= i + 3, in order; any limit, any block size."""
    files = {n: ("python", "\n".join(["same"] * n)) for n in (3, 5, 6, 30, 200)}
    for limit in (1, 5, 12):
        want = {n: [(i, j) for i in range(1, n - 4) for j in range(i + 3, n - 1)][:limit] for n in files}
        assert _pairs(spark, files, limit, 8) == want
    few = {n: files[n] for n in (5, 6, 30)}
    assert _pairs(spark, few, None, 8) == {n: [(i, j) for i in range(1, n - 4) for j in range(i + 3, n - 1)] for n in few}


def test_duplicates_in_periodic_and_plain_files(spark):
    files = {
        1: ("python", "\n".join("abcd" * 6)),                     # blocks repeat every 4 lines
        2: ("python", "\n".join(f"line {i}" for i in range(40))),  # none repeats
        3: ("python", "a\n\n  b\nc\n\nz\na\nb\n\nc"),          # blank lines and indent do not count
    }
    got = _pairs(spark, files, 5, 4)
    assert got == {1: [(1, 5), (1, 9), (1, 13), (1, 17), (1, 21)], 2: [], 3: [(1, 5)]}
    every = _pairs(spark, {1: files[1]}, None, 4)[1]
    assert every == sorted((i, j) for i in range(1, 23) for j in range(i + 4, 23, 4))


def test_long_functions_worked(spark):
    body = lambda n: ["    x = 1"] * n
    files = {
        1: ("python", "\n".join(["def a(x):", *body(50), "def b():", *body(49), "def c():", *body(90)])),  # the last has no next
        2: ("javascript", "\n".join(["async function go(y) {", *body(60), "function (z) {", *body(70), "function end() {"])),
        3: ("java", "\n".join(["function f() {", *body(80), "function g() {"])),
    }
    for size in (16, 4096):
        got = M.long_functions(lines_df(spark, files), ["file_id"], block_size=size).collect()
        assert sorted((r.file_id, r.label) for r in got) == [(1, "a (51 lines)"), (2, "go (61 lines)")]


def test_quality_issues_and_mi_text(spark):
    text = "\n".join(["if a and b or c:"] * 30 + ["x"] * 5)
    lines = lines_df(spark, {7: ("python", text)})
    lf, dups = M.long_functions(lines, ["file_id"]), M.duplicate_blocks(lines, ["file_id"])
    m = M.file_metrics(lines, ["file_id"], lf, dups)
    iss = M.quality_issues(m, lf, dups, ["file_id"]).orderBy("kind", "seq").collect()
    mi = m.first().maintainability_index
    kinds = [r.kind for r in iss]
    assert kinds[0] == 0 and kinds[1] == 1 and 3 in kinds
    assert iss[-1].message == f"Low maintainability index: {mi:.1f}"
