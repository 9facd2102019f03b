"""Scoring queries (P18-P30, J4, A2, A10, W5) and the flagship project score."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.functions.text import filled
from codegauge.operators import findings as FD
from codegauge.operators import metrics as M
from codegauge.operators.graph import metric_language
from codegauge.operators import scoring as SC
from codegauge.plans import q_findings, q_metrics  # noqa: F401  (their views are used here)
from codegauge.plans.oracle_fixtures import register, with_views
from codegauge.plans.registry import query
from codegauge.session import materialize
from codegauge.plans.sqlgen import sql_filled
from codegauge.sources import fixtures as FX
from codegauge.sources.tables import table

W = R.ScoringWeights()


def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _clamp(x: str) -> str:
    return f"greatest({_d(0)}, least({_d(100)}, {x}))"


def _sbt(v: str, g, a, b) -> str:
    v = _d(v)
    return (f"(CASE WHEN {v} <= {g} THEN {_d(1)} "
            f"WHEN {v} <= {a} THEN {_d(1)} - (({v} - {g}) / {_d(a - g)}) * {_d(0.3)} "
            f"WHEN {v} <= {b} THEN {_d(0.7)} - (({v} - {a}) / {_d(b - a)}) * {_d(0.5)} "
            f"ELSE greatest({_d(0)}, {_d(0.2)} - least({_d(2)}, ({v} - {b}) / {_d(b)}) * {_d(0.2)}) END)")


def score_sql(src: str) -> str:
    """Category scores, total and grade over a view with metric columns, counts and issue_penalty."""
    t = R.THRESHOLDS
    denom = W.cyclomatic_complexity_weight + W.cognitive_complexity_weight + W.nesting_depth_weight
    maint = _clamp(f"{_clamp('maintainability_index')} - ((CASE WHEN cyclomatic > 10 THEN (cyclomatic - 10) * 2 ELSE 0 END) "
                   f"+ (CASE WHEN cognitive > 20 THEN (cognitive - 20) * {_d(1.5)} ELSE {_d(0)} END)) "
                   f"- n_long * 5 - n_dup * 8 - n_style_warning * 3")
    rel = _clamp(f"{_d(100)} - n_error * {_d(W.error_penalty)} - n_warning * {_d(W.warning_penalty)} - issue_penalty "
                 f"- (CASE WHEN cyclomatic > 20 THEN (cyclomatic - 20) * {_d(1.5)} ELSE {_d(0)} END)")
    sec = _clamp(f"{_d(100)} - (n_security_error * 25 + n_security_warning * 10 "
                 f"+ (n_security - n_security_error - n_security_warning) * 3 + n_high_risk_rule * 15)")
    perf = _clamp(f"{_d(100)} - n_performance * 5 - greatest(0, cyclomatic - 15) * 2 - greatest(0, max_nesting - 4) * 3 "
                  f"- n_long * 2")
    sty = _clamp(f"{_d(100)} - (n_style_error * 8 + n_style_warning * 3 + (n_style - n_style_error - n_style_warning))")
    cplx = _clamp(f"(({_sbt('cyclomatic', *t['cyclomatic_complexity'])} * {_d(W.cyclomatic_complexity_weight)} "
                  f"+ {_sbt('cognitive', *t['cognitive_complexity'])} * {_d(W.cognitive_complexity_weight)}) "
                  f"+ {_sbt('max_nesting', *t['nesting_depth'])} * {_d(W.nesting_depth_weight)}) / {_d(repr(denom))} * 100")
    total = (f"(((((({_d(0)} + maintainability * {_d(W.maintainability)}) + reliability * {_d(W.reliability)}) "
             f"+ security * {_d(W.security)}) + performance * {_d(W.performance)}) + style * {_d(W.style)}) "
             f"+ complexity * {_d(W.complexity)})")
    adj = (f"{total} + (CASE WHEN cyclomatic <= 10 AND max_nesting <= 3 AND n_long = 0 THEN {_d(5)} ELSE {_d(0)} END) "
           f"+ (CASE WHEN language IN ('typescript', 'java', 'rust', 'go') OR (language = 'python' AND has_type_message) "
           f"THEN {_d(3)} ELSE {_d(0)} END) "
           f"+ (CASE WHEN function_count = 0 OR n_long = 0 OR function_count > 5 THEN {_d(2)} ELSE {_d(0)} END)")
    grade = ("CASE WHEN total_score >= 95 THEN 'A+' WHEN total_score >= 90 THEN 'A' WHEN total_score >= 80 THEN 'B' "
             "WHEN total_score >= 70 THEN 'C' WHEN total_score >= 60 THEN 'D' ELSE 'F' END")
    recs = "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {sql_filled(text, value)} END" for cond, text, value in (
        ("cyclomatic > 15", R.RECOMMEND_CYCLOMATIC, "cyclomatic"), ("cognitive > 25", R.RECOMMEND_COGNITIVE, "cognitive"),
        ("n_long > 0", R.RECOMMEND_LONG, "n_long"), ("n_dup > 0", R.RECOMMEND_DUPLICATES, None),
        ("n_security > 0", R.RECOMMEND_SECURITY, "n_security"))) + "], lambda x: x IS NOT NULL)"
    cats = ["maintainability", "reliability", "security", "performance", "style", "complexity"]
    strs = "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {sql_filled(text)} END" for cond, text in (
        *[(f"{c} >= 85", R.STRENGTH_CATEGORY.format(c)) for c in cats], ("cyclomatic <= 5", R.STRENGTH_COMPLEXITY),
        ("max_nesting <= 2", R.STRENGTH_NESTING), ("n_long = 0", R.STRENGTH_FUNCTIONS), ("n_dup = 0", R.STRENGTH_DUPLICATES))) + "], lambda x: x IS NOT NULL)"
    return f"""SELECT *, {grade} AS grade, technical_debt_minutes / {_d(60)} AS technical_debt_hours,
        {recs} AS recommendations, {strs} AS strengths
      FROM (SELECT *, {_clamp(adj)} AS total_score
            FROM (SELECT *, {maint} AS maintainability, {rel} AS reliability, {sec} AS security,
                         {perf} AS performance, {sty} AS style, {cplx} AS complexity FROM {src}) a) b"""


_CNT = ["n_findings", "n_error", "n_warning", "n_security", "n_security_error", "n_security_warning",
        "n_high_risk_rule", "n_performance", "n_style", "n_style_error", "n_style_warning"]
_GRID_IN = f"""SELECT g.*, {', '.join(f'CAST(coalesce(c.{x}, 0) AS BIGINT) AS {x}' for x in _CNT)},
      coalesce(c.has_type_message, false) AS has_type_message,
      CAST((CASE WHEN cyclomatic > 15 THEN 8 ELSE 0 END) + (CASE WHEN cognitive > 25 THEN 8 ELSE 0 END)
        + n_long * 3 + n_dup * 8 + (CASE WHEN maintainability_index < 30 THEN 15 ELSE 0 END) AS BIGINT) AS issue_penalty
    FROM (SELECT *, least(CAST(100 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(100 AS DOUBLE) - (CAST(0.23 AS DOUBLE) * lines_of_code
            + CAST(3.2 AS DOUBLE) * cyclomatic + CAST(2.5 AS DOUBLE) * cognitive + n_long * 5 + n_dup * 10))) AS maintainability_index,
            CAST(greatest(0, cyclomatic - 10) * 15 + n_long * 30 + n_dup * 45 + greatest(0, max_nesting - 4) * 20 AS BIGINT)
              AS technical_debt_minutes
          FROM metrics_grid) g
    LEFT JOIN finding_counts c USING (path)"""
register("grid_in", _GRID_IN, ["metrics_grid", "finding_counts"])
register("grid_scores", score_sql("grid_in"), ["grid_in"])


def grid_metrics(spark, sf, key_filter=None):
    g = FX.metrics_grid(spark, sf, key_filter)
    c = F.col
    return (g.withColumn("maintainability_index",
                         M.maintainability_index(c("lines_of_code"), c("cyclomatic"), c("cognitive"), c("n_long"), c("n_dup")))
             .withColumn("technical_debt_minutes",
                         M.technical_debt(c("cyclomatic"), c("n_long"), c("n_dup"), c("max_nesting")).cast("long")))


def grid_scores(spark, sf):
    m = grid_metrics(spark, sf)
    counts = FD.finding_counts(FX.findings(spark, sf), ["path"])
    return SC.score_files(m, counts, SC.derived_issue_penalty(m, ["path"]), ["path"])


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


_CATS = SC.CATEGORIES


@query("category_scores", with_views(
    "SELECT path, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CATS) + " FROM grid_scores", ["grid_scores"]))
def category_scores(spark, sf):
    return grid_scores(spark, sf).select("path", *[_r6(c) for c in _CATS])


@query("file_scores", with_views(
    "SELECT path, round(total_score, 6) AS total_score, grade, round(technical_debt_hours, 6) AS technical_debt_hours, "
    "array_to_string(recommendations, ' | ') AS recommendations, array_to_string(strengths, ' | ') AS strengths "
    "FROM grid_scores", ["grid_scores"]))
def file_scores(spark, sf):
    s = grid_scores(spark, sf)
    return s.select("path", _r6("total_score"), "grade", _r6("technical_debt_hours"),
                    F.array_join("recommendations", " | ").alias("recommendations"),
                    F.array_join("strengths", " | ").alias("strengths"))


@query("recommendations", with_views(
    "SELECT path, CAST(i AS BIGINT) AS rec_rank, recommendations[i] AS recommendation "
    "FROM (SELECT path, recommendations, unnest(range(1, len(recommendations) + 1)) AS i FROM grid_scores) t",
    ["grid_scores"]))
def recommendations(spark, sf):
    s = grid_scores(spark, sf)
    return s.select("path", F.posexplode("recommendations").alias("i", "recommendation")).select(
        "path", (F.col("i") + 1).cast("long").alias("rec_rank"), "recommendation")


@query("strengths", with_views(
    "SELECT path, CAST(i AS BIGINT) AS strength_rank, strengths[i] AS strength "
    "FROM (SELECT path, strengths, unnest(range(1, len(strengths) + 1)) AS i FROM grid_scores) t",
    ["grid_scores"]))
def strengths(spark, sf):
    s = grid_scores(spark, sf)
    return s.select("path", F.posexplode("strengths").alias("i", "strength")).select(
        "path", (F.col("i") + 1).cast("long").alias("strength_rank"), "strength")


_PRIORITY_SQL = """SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY cls, r) AS BIGINT) AS priority_rank, label
  FROM (SELECT path, 0 AS cls, r, '🚨 Security: ' || message AS label
        FROM (SELECT path, message, row_number() OVER (PARTITION BY path ORDER BY ordinal) AS r
              FROM findings WHERE category = 'security' AND severity = 'error') a WHERE r <= 3
        UNION ALL
        SELECT path, 2 AS cls, r, '⚠️  Reliability: ' || message
        FROM (SELECT path, message, row_number() OVER (PARTITION BY path ORDER BY ordinal) AS r
              FROM findings WHERE severity = 'error') b WHERE r <= 2) t"""


@query("priority_issues", with_views(_PRIORITY_SQL, ["findings"]))
def priority_issues(spark, sf):
    # issues of the grid come from the metric rules, which never emit complexity errors
    m = grid_metrics(spark, sf)
    iss = M.quality_issues(m, None, None, ["path"])
    return SC.priority_issues(FX.findings(spark, sf), iss, ["path"])


_PRIORITY_CPX_SQL = _PRIORITY_SQL.replace("        UNION ALL\n        SELECT path, 2 AS cls", """        UNION ALL
        SELECT path, 1, 1, '⚡ Complexity: ' || """ + sql_filled(R.ISSUE_CYCLOMATIC, "cyclomatic") + """
        FROM metrics_grid WHERE cyclomatic > 40
        UNION ALL
        SELECT path, 2 AS cls""", 1)


@query("priority_issues_complexity", with_views(_PRIORITY_CPX_SQL, ["findings", "metrics_grid"]))
def priority_issues_complexity(spark, sf):
    """W5 with issues of another analyser, which rates a complexity above 40 as an error."""
    g = FX.metrics_grid(spark, sf).filter(F.col("cyclomatic") > 40)
    iss = g.select("path", F.lit(0).cast("long").alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit("error").alias("severity"), F.lit("complexity").alias("category"),
                   filled(R.ISSUE_CYCLOMATIC, F.col("cyclomatic")).alias("message"))
    return SC.priority_issues(FX.findings(spark, sf), iss, ["path"])


# ---------------------------------------------------------------- flagship: project score end to end
_FLAG_IN = f"""SELECT fm.*, 'f' || CAST(fm.file_id AS STRING) AS path, fm.file_id % 5 AS project_id, fm.lang AS language,
      {', '.join(f'CAST(coalesce(c.{x}, 0) AS BIGINT) AS {x}' for x in _CNT)},
      coalesce(c.has_type_message, false) AS has_type_message,
      CAST(coalesce(ip.issue_penalty, 0) AS BIGINT) AS issue_penalty
    FROM code_lines_fm fm
    LEFT JOIN finding_counts c ON c.path = 'f' || CAST(fm.file_id AS STRING)
    LEFT JOIN (SELECT file_id, sum(CASE severity WHEN 'error' THEN 15 WHEN 'warning' THEN 8 ELSE 3 END) AS issue_penalty
               FROM code_lines_issues GROUP BY file_id) ip USING (file_id)"""
register("flag_in", _FLAG_IN, ["code_lines_fm", "finding_counts", "code_lines_issues"])
register("flag_scores", score_sql("flag_in"), ["flag_in"])

_PROJECT_SQL = ("SELECT project_id, CAST(count(*) AS BIGINT) AS files_evaluated, round(avg(total_score), 6) AS average_score, "
                + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in _CATS) + ", "
                + ", ".join(f"CAST(count(*) FILTER (WHERE grade = '{g}') AS BIGINT) AS n_grade_{g.replace('+', 'p')}"
                            for g in ["A+", "A", "B", "C", "D", "F"])
                + ", coalesce(max(k.n), 0) AS files_skipped FROM flag_scores LEFT JOIN (SELECT project_id, CAST(count(*) AS BIGINT) AS n"
                  " FROM skipped_files GROUP BY 1) k USING (project_id) GROUP BY project_id")
register("skipped_files", """SELECT p_partkey % 5 AS project_id, 'inc/p' || CAST(p_partkey AS STRING) || CASE p_partkey % 9 WHEN 0 THEN '.h' WHEN 1 THEN '.hpp' ELSE '.c' END AS path,
    CASE WHEN p_partkey % 9 > 1 THEN 'no text' ELSE 'no metric language' END AS reason FROM part""", [])

_PROJECT_NUMBERS = ["files_evaluated", *[f"n_grade_{g}" for g in ["Ap", "A", "B", "C", "D", "F"]], "files_skipped"]
_PROJECT_MEANS = ["average_score", *[f"avg_{c}" for c in _CATS]]
_PROJECT = ["project_id", "kind", "path", "total_score", "grade", "reason", "files_evaluated", *_PROJECT_MEANS, *_PROJECT_NUMBERS[1:]]


def _project_rows(kind: str, src: str, *have: str) -> str:
    """Rows of one kind of the project score, null in the columns of the others."""
    none = {c: "BIGINT" for c in _PROJECT_NUMBERS} | {c: "DOUBLE" for c in ["total_score", *_PROJECT_MEANS]}
    cols = {"kind": f"'{kind}'", "total_score": "round(total_score, 6)"}
    return "SELECT " + ", ".join(f"{cols.get(c, c) if c in ('project_id', 'kind', *have) else f'CAST(NULL AS {none.get(c, 'VARCHAR')})'} AS {c}" for c in _PROJECT) + f" FROM {src}"


def listed_sources(spark, sf):
    """C sources that are listed in the projects (project_id, path); no table holds their text."""
    k = F.col("p_partkey")
    ext = F.when(k % 9 == 0, ".h").when(k % 9 == 1, ".hpp").otherwise(".c")
    return table(spark, sf, "part").select((k % 5).alias("project_id"), F.concat(F.lit("inc/p"), k.cast("string"), ext).alias("path"))


def project_scores_frame(spark, sf):
    lines = FX.code_lines(spark, sf)
    lf = materialize(M.long_functions(lines, ["file_id"]), "long_functions")
    dups = materialize(M.duplicate_blocks(lines, ["file_id"]), "duplicate_blocks")
    # one row per file, read by several branches below
    m = materialize(M.file_metrics(lines, ["file_id"], lf, dups), "file_metrics")
    issues = M.quality_issues(m, lf, dups, ["file_id"])
    pen = SC.issue_penalty(issues, ["file_id"])
    m = (m.withColumn("path", F.concat(F.lit("f"), F.col("file_id").cast("string")))
          .withColumn("project_id", F.col("file_id") % 5).withColumnRenamed("lang", "language"))
    counts = FD.finding_counts(FX.findings(spark, sf), ["path"])
    pen = pen.withColumn("path", F.concat(F.lit("f"), F.col("file_id").cast("string"))).drop("file_id")
    return SC.score_files(m, counts, pen, ["path"])


@query("project_score", with_views(
    _project_rows("project", f"({_PROJECT_SQL}) p", *_PROJECT_NUMBERS, *_PROJECT_MEANS)
    + " UNION ALL " + _project_rows("file", "flag_scores", "path", "total_score", "grade")
    + " UNION ALL " + _project_rows("skipped", "skipped_files", "path", "reason"), ["flag_scores", "skipped_files"]))
def project_score(spark, sf):
    """A10: a row for each project, and its lists: every evaluated file with total and grade, every listed file that could not be scored.

    A file is skipped if its suffix has no metric language (.h, .hpp) or if nothing of it can be read."""
    s = materialize(project_scores_frame(spark, sf).select("project_id", "path", "total_score", "grade", *_CATS), "scores")
    reason = F.when(metric_language("path").isNull(), "no metric language").otherwise("no text")
    skipped = listed_sources(spark, sf).join(s.select("project_id", "path"), ["project_id", "path"], "left_anti").withColumn("reason", reason)
    out = SC.project_score(s, ["project_id"], skipped).withColumn("kind", F.lit("project"))
    out = out.unionByName(SC.project_files(s, ["project_id"], skipped), allowMissingColumns=True)
    return out.select(*[_r6(c) if c in ("total_score", *_PROJECT_MEANS) else c for c in _PROJECT])
