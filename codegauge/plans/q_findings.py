"""Linter-report queries (S4-S7, A1) over the generated findings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.operators import findings as FD
from codegauge.plans.oracle_fixtures import register, with_views
from codegauge.plans.registry import query
from codegauge.plans.sqlgen import (bandit_severity, eslint_category, in_list, map_case, pyflakes_category,
                                    pyflakes_severity, pyflakes_suggestion, strip)
from codegauge.sources import fixtures as FX

_COUNTS_SQL = f"""SELECT path,
    CAST(count(*) AS BIGINT) AS n_findings,
    CAST(count(*) FILTER (WHERE severity = 'error') AS BIGINT) AS n_error,
    CAST(count(*) FILTER (WHERE severity = 'warning') AS BIGINT) AS n_warning,
    CAST(count(*) FILTER (WHERE category = 'security') AS BIGINT) AS n_security,
    CAST(count(*) FILTER (WHERE category = 'security' AND severity = 'error') AS BIGINT) AS n_security_error,
    CAST(count(*) FILTER (WHERE category = 'security' AND severity = 'warning') AS BIGINT) AS n_security_warning,
    CAST(count(*) FILTER (WHERE category = 'security' AND {in_list('rule_id', R.HIGH_RISK_RULES)}) AS BIGINT) AS n_high_risk_rule,
    CAST(count(*) FILTER (WHERE category = 'performance') AS BIGINT) AS n_performance,
    CAST(count(*) FILTER (WHERE category = 'style') AS BIGINT) AS n_style,
    CAST(count(*) FILTER (WHERE category = 'style' AND severity = 'error') AS BIGINT) AS n_style_error,
    CAST(count(*) FILTER (WHERE category = 'style' AND severity = 'warning') AS BIGINT) AS n_style_warning,
    bool_or(strpos(lower(message), 'type') > 0) AS has_type_message
  FROM findings GROUP BY path"""
register("finding_counts", _COUNTS_SQL, ["findings"])

_OUT = ["tool_name", "line", "col", "severity", "rule_id", "message", "category", "suggestion", "auto_fixable"]
_OUT_SQL = ", ".join(_OUT)

_ESLINT_SQL = f"""SELECT path, chunk, 'ESLint' AS tool_name, CAST(coalesce(m.line, 1) AS BIGINT) AS line,
    CAST(coalesce(m."column", 1) AS BIGINT) AS col,
    CASE WHEN coalesce(m.severity, 1) = 2 THEN 'error' ELSE 'warning' END AS severity,
    m.ruleId AS rule_id, coalesce(m.message, '') AS message, {eslint_category('m.ruleId')} AS category,
    {map_case('m.ruleId', R.ESLINT_SUGGESTIONS)} AS suggestion, m.fix IS NOT NULL AS auto_fixable
  FROM (SELECT path, chunk, unnest(f.messages) AS m
        FROM (SELECT path, chunk, unnest(from_json(report,
                '[{{"messages":[{{"ruleId":"VARCHAR","severity":"BIGINT","line":"BIGINT","column":"BIGINT","message":"VARCHAR","fix":"JSON"}}]}}]')) AS f
              FROM tool_reports WHERE tool = 'ESLint' AND json_valid(report)) a) b"""
register("eslint_rows", _ESLINT_SQL, ["tool_reports"])

_BANDIT_SQL = f"""SELECT path, chunk, 'Bandit' AS tool_name, CAST(coalesce(r.line_number, 1) AS BIGINT) AS line,
    CAST(coalesce(r.col_offset, 1) AS BIGINT) AS col,
    {bandit_severity("coalesce(r.issue_severity, 'LOW')", "coalesce(r.issue_confidence, 'LOW')")} AS severity,
    coalesce(r.test_id, 'unknown') AS rule_id, coalesce(r.issue_text, '') AS message, 'security' AS category,
    {map_case("coalesce(r.test_id, 'unknown')", R.BANDIT_SUGGESTIONS)} AS suggestion, false AS auto_fixable
  FROM (SELECT path, chunk, unnest(j.results) AS r
        FROM (SELECT path, chunk, from_json(report,
                '{{"results":[{{"issue_severity":"VARCHAR","issue_confidence":"VARCHAR","line_number":"BIGINT","col_offset":"BIGINT","test_id":"VARCHAR","issue_text":"VARCHAR"}}]}}') AS j
              FROM tool_reports WHERE tool = 'Bandit' AND json_valid(report)) a) b"""
register("bandit_rows", _BANDIT_SQL, ["tool_reports"])

_PYFLAKES_SQL = f"""SELECT path, chunk, 'PyFlakes' AS tool_name, line, CAST(1 AS BIGINT) AS col,
    {pyflakes_severity('message')} AS severity, 'pyflakes' AS rule_id, message,
    {pyflakes_category('message')} AS category, {pyflakes_suggestion('message')} AS suggestion, false AS auto_fixable
  FROM (SELECT path, chunk, TRY_CAST({strip("regexp_extract(l, '^([^:]*):([^:]*):(.*)$', 2)")} AS BIGINT) AS line,
               {strip("regexp_extract(l, '^([^:]*):([^:]*):(.*)$', 3)")} AS message
        FROM (SELECT path, chunk, unnest(string_split({strip('report')}, chr(10))) AS l
              FROM tool_reports WHERE tool = 'PyFlakes') a
        WHERE l <> '' AND regexp_matches(l, '^[^:]*:[^:]*:')) b
  WHERE line IS NOT NULL"""
register("pyflakes_rows", _PYFLAKES_SQL, ["tool_reports"])

# routed extension per report (so routing by file type is exercised)
_ROUTE_EXT = ("CASE tool WHEN 'ESLint' THEN CASE chunk % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.tsx' ELSE '.py' END "
              "WHEN 'Bandit' THEN CASE chunk % 2 WHEN 0 THEN '.py' ELSE '.rb' END ELSE '.PY' END")


@query("finding_counts", with_views("SELECT * FROM finding_counts", ["finding_counts"]))
def finding_counts(spark, sf):
    return FD.finding_counts(FX.findings(spark, sf), ["path"])


@query("ingest_eslint", with_views(f"SELECT path, chunk, {_OUT_SQL} FROM eslint_rows", ["eslint_rows"]))
def ingest_eslint(spark, sf):
    r = FX.tool_reports(spark, sf).filter(F.col("tool") == "ESLint")
    return FD.ingest_eslint(r, ["path", "chunk"]).select("path", "chunk", *_OUT)


@query("ingest_bandit", with_views(f"SELECT path, chunk, {_OUT_SQL} FROM bandit_rows", ["bandit_rows"]))
def ingest_bandit(spark, sf):
    r = FX.tool_reports(spark, sf).filter(F.col("tool") == "Bandit")
    return FD.ingest_bandit(r, ["path", "chunk"]).select("path", "chunk", *_OUT)


@query("ingest_pyflakes", with_views(f"SELECT path, chunk, {_OUT_SQL} FROM pyflakes_rows", ["pyflakes_rows"]))
def ingest_pyflakes(spark, sf):
    r = FX.tool_reports(spark, sf).filter(F.col("tool") == "PyFlakes")
    return FD.ingest_pyflakes(r, ["path", "chunk"]).select("path", "chunk", *_OUT)


_UNION_SQL = f"""SELECT path || {_ROUTE_EXT} AS path, chunk, tool_name, CAST(0 AS BIGINT) AS tool_rank, line, severity, rule_id, message, category
    FROM eslint_rows e JOIN (SELECT DISTINCT path, chunk, tool FROM tool_reports) r USING (path, chunk)
    WHERE r.tool = 'ESLint' AND ({_ROUTE_EXT}) IN ('.js', '.tsx')
  UNION ALL
  SELECT path || {_ROUTE_EXT}, chunk, tool_name, CAST(1 AS BIGINT), line, severity, rule_id, message, category
    FROM bandit_rows b JOIN (SELECT DISTINCT path, chunk, tool FROM tool_reports) r USING (path, chunk)
    WHERE r.tool = 'Bandit' AND ({_ROUTE_EXT}) = '.py'
  UNION ALL
  SELECT path || '.PY', chunk, tool_name, CAST(2 AS BIGINT), line, severity, rule_id, message, category
    FROM pyflakes_rows"""


@query("union_findings", with_views(_UNION_SQL, ["eslint_rows", "bandit_rows", "pyflakes_rows"]))
def union_findings(spark, sf):
    r = FX.tool_reports(spark, sf).withColumn("path", F.concat("path", F.expr(_ROUTE_EXT)))
    u = FD.union_findings(r, ["path", "chunk"])
    return u.select("path", "chunk", "tool_name", F.col("tool_rank").cast("long"), "line", "severity",
                    "rule_id", "message", "category")
