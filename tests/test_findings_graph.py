import json

from codegauge.operators import extract as E
from codegauge.operators import findings as FD
from codegauge.operators import graph as G


def test_eslint_bandit_pyflakes_ingest(spark):
    eslint = json.dumps([{"messages": [
        {"ruleId": "no-eval", "severity": 2, "line": 3, "column": 4, "message": "eval", "fix": {"range": [0, 1]}},
        {"ruleId": None, "severity": 1, "message": "x"}]}])
    reps = spark.createDataFrame([("a.js", eslint), ("b.js", "{not json")], "path STRING, report STRING")
    rows = sorted(FD.ingest_eslint(reps, ["path"]).collect(), key=lambda r: r.mi)
    assert len(rows) == 2
    assert (rows[0].severity, rows[0].category, rows[0].auto_fixable, rows[0].line) == ("error", "security", True, 3)
    assert (rows[1].severity, rows[1].category, rows[1].rule_id, rows[1].line, rows[1].col) == ("warning", "general", None, 1, 1)

    # cut off, followed by something, another type, no rule at all
    broken = {"cut.js": eslint[:-1], "tail.js": eslint + " x", "two.js": eslint + eslint, "obj.js": '{"messages": []}', "num.js": "3", "empty.js": ""}
    assert FD.ingest_eslint(spark.createDataFrame(list(broken.items()), "path STRING, report STRING"), ["path"]).count() == 0
    bare = FD.ingest_eslint(spark.createDataFrame([("c.js", '[{"messages": [{"message": "m"}, {"ruleId": null}]}]')], "path STRING, report STRING"), ["path"])
    assert [r.rule_id for r in bare.orderBy("mi").collect()] == ["unknown", None]

    bandit = json.dumps({"results": [
        {"issue_severity": "HIGH", "issue_confidence": "HIGH", "test_id": "B602", "line_number": 5, "issue_text": "t"},
        {"issue_severity": "HIGH", "issue_confidence": "MEDIUM", "test_id": "B101", "issue_text": "u"},
        {"issue_severity": "LOW", "issue_confidence": "HIGH", "test_id": "B103"}]})
    b = FD.ingest_bandit(spark.createDataFrame([("a.py", bandit)], "path STRING, report STRING"), ["path"])
    assert [r.severity for r in b.orderBy("mi").collect()] == ["error", "info", "warning"]
    broken = {"cut.py": bandit[:-1], "tail.py": bandit + "]", "list.py": "[" + bandit + "]", "word.py": "null"}
    assert FD.ingest_bandit(spark.createDataFrame(list(broken.items()), "path STRING, report STRING"), ["path"]).count() == 0

    pf = "a.py:1: 'os' imported but unused\na.py:x: bad line\na.py:7: redefinition of unused 'y'\n\nnonsense"
    p = FD.ingest_pyflakes(spark.createDataFrame([("a.py", pf)], "path STRING, report STRING"), ["path"])
    got = [(r.line, r.severity, r.category) for r in p.orderBy("mi").collect()]
    assert got == [(1, "warning", "style"), (7, "warning", "general")]


def test_python_and_js_extraction(spark):
    py = ('import os, sys\nfrom . import z\nfrom .pkg import y\n\nclass A:\n    """Doc."""\n'
          '    def m(self):\n        pass\n\nasync def g():\n    pass\n\ndef f():\n    def inner():\n        pass\n')
    js = "import a from './util'\nconst k = require('lib')\nfunction foo(x) {\n}\nclass Bar {}\nconst q = (y) => y\n"
    files = spark.createDataFrame([(1, "m.py", "python", py), (1, "w.js", "javascript", js),
                                   (1, "bad.py", "python", "def (:\n"), (1, "x.java", "java", "class J {}")],
                                  "project_id LONG, path STRING, lang STRING, content STRING")
    ext = E.analyze_files(files).collect()
    py_ents = [(r.name, r.entity_type, r.line_number) for r in sorted(ext, key=lambda r: r.seq)
               if r.path == "m.py" and r.kind == "entity"]
    assert py_ents == [("A", "class", 5), ("f", "function", 13), ("m", "function", 7), ("inner", "function", 14)]
    assert [r.docstring for r in ext if r.path == "m.py" and r.name == "A"] == ["Doc."]
    py_imps = [r.name for r in sorted(ext, key=lambda r: r.seq) if r.path == "m.py" and r.kind == "import"]
    assert py_imps == ["os", "sys", "pkg"]
    js_ents = {(r.name, r.line_number) for r in ext if r.path == "w.js" and r.kind == "entity"}
    assert js_ents == {("foo", 3), ("Bar", 5), ("q", 6)}  # "(y) =>" has no word before "=>"
    assert [r.name for r in sorted(ext, key=lambda r: r.seq) if r.path == "w.js" and r.kind == "import"] == ["./util", "lib"]
    assert not [r for r in ext if r.path in ("bad.py", "x.java")]


def test_resolve_imports_rules(spark):
    listing = spark.createDataFrame([(1, p) for p in ["src/x.js", "src/x.ts", "src/a.ts", "b/y.py", "src/n/q.py"]],
                                    "project_id LONG, path STRING")
    imps = spark.createDataFrame([(1, "src/m.js", 0, s) for s in ["./x", "./a.service", "../b/y", "lodash", ".n/q"]],
                                 "project_id LONG, path STRING, seq LONG, specifier STRING")
    got = {r.specifier: r.target for r in G.resolve_imports(imps, listing).collect()}
    assert got == {"./x": "src/x.js", "./a.service": "src/a.ts", ".n/q": "src/n/q.py"}
    norm = {r.specifier: r.target for r in G.resolve_imports(imps, listing, normalize=True).collect()}
    assert norm["../b/y"] == "b/y.py"


def test_dot_segments_without_a_pass_count(spark):
    deep = "/".join("abcdefghi")
    listing = spark.createDataFrame([(1, p) for p in ["top.ts", "x/y.ts", f"{deep}/z.ts", "b/y.py"]], "project_id LONG, path STRING")
    imps = spark.createDataFrame([
        (1, f"{deep}/m.js", 0, "../" * 9 + "top"), (1, f"{deep}/m.js", 1, "../" * 10 + "top"), (1, "x/m.js", 2, "./" * 7 + "y"),
        (1, "m.js", 3, "../../b/y"), (1, "x/m.js", 4, "./q/../y"), (1, "x/m.js", 5, ".//y")], "project_id LONG, path STRING, seq LONG, specifier STRING")
    got = {r.seq: r.target for r in G.resolve_imports(imps, listing, normalize=True).collect()}
    assert got == {0: "top.ts", 2: "x/y.ts", 4: "x/y.ts", 5: "x/y.ts"}  # what leaves the tree matches nothing
    assert {r.seq for r in G.resolve_imports(imps, listing).collect()} == {2, 5}  # ".." stays as written


def test_change_impact_cycle_counts_twice(spark):
    files = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "project_id LONG, path STRING")
    edges = spark.createDataFrame([(1, "a", "b", "imports"), (1, "b", "a", "imports"), (1, "c", "a", "imports"), (1, "a", "a:f", "contains")],
                                  "project_id LONG, src STRING, dst STRING, relation_type STRING")
    got = {r.target: (r.direct_impact, r.indirect_impact, r.risk_level) for r in G.change_impact(files, edges).collect()}
    # a <- {b, c}; indirect = preds(b) ∪ preds(c) = {a}; b <- {a}; indirect = preds(a) = {b, c}
    assert got == {"a": (2, 1, "low"), "b": (1, 2, "low"), "c": (0, 0, "low")}


def test_risk_buckets(spark):
    nodes = spark.createDataFrame([(1, "big", 20000, 600), (1, "small", 10, 3)],
                                  "project_id LONG, path STRING, size_bytes LONG, line_count LONG")
    ents = spark.createDataFrame([(1, "big", f"e{i}") for i in range(21)], "project_id LONG, path STRING, name STRING")
    imps = spark.createDataFrame([(1, "big", "m")] * 16, "project_id LONG, path STRING, specifier STRING")
    got = {r.path: (r.risk_score, r.complexity_level) for r in G.risk_scores(nodes, ents, imps).collect()}
    assert got == {"big": (1.0, "extreme"), "small": (0.0, "low")}
