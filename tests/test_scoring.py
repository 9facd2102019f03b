from pyspark.sql import functions as F

from codegauge.operators import findings as FD
from codegauge.operators import scoring as SC

METRIC_SCHEMA = ("path STRING, language STRING, lines_of_code LONG, cyclomatic LONG, cognitive LONG, "
                 "function_count LONG, class_count LONG, max_nesting LONG, n_long LONG, n_dup LONG, "
                 "maintainability_index DOUBLE, technical_debt_minutes LONG")
FINDING_SCHEMA = ("path STRING, tool_name STRING, line LONG, col LONG, severity STRING, rule_id STRING, "
                  "message STRING, category STRING, suggestion STRING, auto_fixable BOOLEAN, ordinal LONG")
ISSUE_SCHEMA = "path STRING, line LONG, col LONG, severity STRING, category STRING, message STRING, kind LONG, seq LONG"

BASE = ("sample.py", "python", 42, 6, 8, 3, 1, 2, 0, 0, 92.0, 15)
BAD = ("sample.py", "python", 42, 28, 40, 3, 1, 6, 1, 1, 45.0, 540)
FINDINGS = [("sample.py", "Bandit", 12, 1, "error", "B101", "Use of assert detected", "security", "Avoid assert", False, 0),
            ("sample.py", "ESLint", 7, 1, "warning", "prefer-const", "Use const", "style", None, True, 1)]
ISSUES = [("sample.py", 30, 1, "error", "complexity", "Function too complex", 0, 0)]


def _score(spark, metrics, findings, issues):
    m = spark.createDataFrame([metrics], METRIC_SCHEMA)
    f = spark.createDataFrame(findings, FINDING_SCHEMA)
    i = spark.createDataFrame(issues, ISSUE_SCHEMA)
    s = SC.score_files(m, FD.finding_counts(f, ["path"]), SC.issue_penalty(i, ["path"]), ["path"]).first()
    pr = [r.label for r in SC.priority_issues(f, i, ["path"]).orderBy("priority_rank").collect()]
    return s, pr


def test_good_file_scores_high(spark):
    s, pr = _score(spark, BASE, [], [])
    assert s.grade in {"A+", "A", "B"}
    assert "Well-sized functions" in s.strengths
    assert pr == []
    # by hand: complexity 97.6, weighted 97.88, +5 +2 bonuses, clamped to 100
    assert abs(s.complexity - 97.6) < 1e-9
    assert s.total_score == 100.0 and s.grade == "A+"


def test_bad_file_scores_low_with_priorities(spark):
    s, pr = _score(spark, BAD, FINDINGS, ISSUES)
    assert s.total_score < 80
    assert any("Security" in p for p in pr)
    assert any("Complexity" in p for p in pr)
    assert any("security" in r.lower() for r in s.recommendations)
    assert pr[0].startswith("\U0001F6A8 Security: ")


def test_threshold_curve(spark):
    df = spark.createDataFrame([(v,) for v in [0, 5, 7, 10, 12, 15, 20, 30, 45, 100]], "v LONG")
    got = [r.s for r in df.select(SC.score_by_threshold(F.col("v"), 5, 10, 15).alias("s")).collect()]
    want = []
    for v in [0, 5, 7, 10, 12, 15, 20, 30, 45, 100]:
        if v <= 5:
            want.append(1.0)
        elif v <= 10:
            want.append(1.0 - ((v - 5) / 5) * 0.3)
        elif v <= 15:
            want.append(0.7 - ((v - 10) / 5) * 0.5)
        else:
            want.append(max(0.0, 0.2 - min(2.0, (v - 15) / 15) * 0.2))
    assert got == want


def test_project_score_zero_fill(spark):
    m = spark.createDataFrame([BASE], METRIC_SCHEMA).withColumn("project_id", F.lit(1))
    s = SC.score_files(m, FD.finding_counts(spark.createDataFrame([], FINDING_SCHEMA), ["path"]),
                       SC.derived_issue_penalty(m, ["path"]), ["path"])
    skipped = spark.createDataFrame([(2, "x.h")], "project_id INT, path STRING")
    out = {r.project_id: r for r in SC.project_score(s, ["project_id"], skipped).collect()}
    assert out[1].files_evaluated == 1 and out[1].files_skipped == 0
    assert out[2].files_evaluated == 0 and out[2].average_score == 0.0 and out[2].files_skipped == 1
