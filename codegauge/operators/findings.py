"""Linter findings: report ingestion, rule lookups, per-file finding counts.

Reports arrive as text rows (one report per file and tool); they are parsed with ``from_json``
(malformed text, or more than one JSON value, gives no rows) or with ``split`` + ``regexp_extract`` for
line-based output. Lookup tables are literal maps inside the expression, so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.functions.text import py_strip


def _lookup(table: dict, key: Column) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, key)


def eslint_category(rule: Column) -> Column:
    out = None
    for cat, rs in R.ESLINT_RULE_CATEGORIES.items():
        cond = rule.isin(*rs)
        out = F.when(cond, cat) if out is None else out.when(cond, cat)
    return F.coalesce(out.otherwise(F.lit("general")), F.lit("general"))


def eslint_suggestion(rule: Column) -> Column:
    return _lookup(R.ESLINT_SUGGESTIONS, rule)


def bandit_severity(sev: Column, conf: Column) -> Column:
    return (F.when((sev == "HIGH") & (conf == "HIGH"), "error")
             .when((sev == "MEDIUM") | (conf == "HIGH"), "warning").otherwise("info"))


def bandit_suggestion(rule: Column) -> Column:
    return _lookup(R.BANDIT_SUGGESTIONS, rule)


def pyflakes_severity(msg: Column) -> Column:
    return (F.when(msg.contains("undefined name") | msg.contains("imported but unused"), "warning")
             .when(msg.contains("redefined"), "info").otherwise("warning"))


def pyflakes_category(msg: Column) -> Column:
    return F.when(msg.contains("imported but unused") | msg.contains("undefined name"), "style").otherwise("general")


def pyflakes_suggestion(msg: Column) -> Column:
    out = None
    for frag, text in R.PYFLAKES_SUGGESTIONS:
        out = F.when(msg.contains(frag), text) if out is None else out.when(msg.contains(frag), text)
    return out


FINDING_COLUMNS = ["tool_name", "line", "col", "severity", "rule_id", "message", "category",
                   "suggestion", "auto_fixable"]

_ESLINT_SCHEMA = "ARRAY<STRUCT<messages: ARRAY<STRING>>>"
_ESLINT_MESSAGE = "STRUCT<ruleId: STRING, severity: BIGINT, line: BIGINT, column: BIGINT, message: STRING, fix: STRING>"
_BANDIT_SCHEMA = ("STRUCT<results: ARRAY<STRUCT<issue_severity: STRING, issue_confidence: STRING, "
                  "line_number: BIGINT, col_offset: BIGINT, test_id: STRING, issue_text: STRING>>>")


def whole_json(report: Column, opening: str) -> Column:
    """The report if it is exactly one JSON value of the expected type (``[`` or ``{``), else null: text that is cut
    off, has something after its end or is another type gives no findings."""
    # with a second element behind it the array has two only if the report neither ends early nor closes the array
    one = F.json_array_length(F.concat(F.lit("["), report, F.lit(",0]"))) == 2
    return F.when(one & F.startswith(py_strip(report), F.lit(opening)), report)


def ingest_eslint(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """ESLint JSON → findings. The file path comes from the row, not from the report.

    A message without a ``ruleId`` has the rule ``unknown`` (and the category of no rule); one whose ``ruleId`` is null keeps null."""
    parsed = reports.select(*keys, F.from_json(whole_json(F.col(report), "["), _ESLINT_SCHEMA, {"mode": "PERMISSIVE"}).alias("j"))
    files = parsed.select(*keys, F.posexplode("j").alias("fi", "f"))
    msgs = files.select(*keys, "fi", F.posexplode("f.messages").alias("mi", "__text"))
    msgs = msgs.withColumn("m", F.from_json("__text", _ESLINT_MESSAGE))
    m = lambda c: F.col(f"m.{c}")
    rule = F.when(F.array_contains(F.json_object_keys("__text"), "ruleId"), m("ruleId")).otherwise(F.lit("unknown"))
    return msgs.select(
        *keys, "fi", "mi", F.lit("ESLint").alias("tool_name"),
        F.coalesce(m("line"), F.lit(1)).alias("line"), F.coalesce(m("column"), F.lit(1)).alias("col"),
        F.when(F.coalesce(m("severity"), F.lit(1)) == 2, "error").otherwise("warning").alias("severity"),
        rule.alias("rule_id"),
        F.coalesce(m("message"), F.lit("")).alias("message"),
        eslint_category(rule).alias("category"),
        eslint_suggestion(rule).alias("suggestion"),
        m("fix").isNotNull().alias("auto_fixable"))


def ingest_bandit(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """Bandit JSON → findings; category is always security."""
    parsed = reports.select(*keys, F.from_json(whole_json(F.col(report), "{"), _BANDIT_SCHEMA, {"mode": "PERMISSIVE"}).alias("j"))
    res = parsed.select(*keys, F.posexplode("j.results").alias("mi", "r"))
    r = lambda c: F.col(f"r.{c}")
    sev = F.coalesce(r("issue_severity"), F.lit("LOW"))
    conf = F.coalesce(r("issue_confidence"), F.lit("LOW"))
    rule = F.coalesce(r("test_id"), F.lit("unknown"))
    return res.select(
        *keys, "mi", F.lit("Bandit").alias("tool_name"),
        F.coalesce(r("line_number"), F.lit(1)).alias("line"), F.coalesce(r("col_offset"), F.lit(1)).alias("col"),
        bandit_severity(sev, conf).alias("severity"), rule.alias("rule_id"),
        F.coalesce(r("issue_text"), F.lit("")).alias("message"), F.lit("security").alias("category"),
        bandit_suggestion(rule).alias("suggestion"), F.lit(False).alias("auto_fixable"))


def ingest_pyflakes(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """``file:line: message`` lines → findings; lines whose number is not an integer are dropped."""
    lines = reports.select(*keys, F.posexplode(F.split(py_strip(report), "\n")).alias("mi", "l"))
    lines = lines.filter(F.col("l") != "")
    parts = F.split(F.col("l"), ":", 3)
    d = lines.filter(F.size(parts) >= 3).select(
        *keys, "mi", py_strip(parts[1]).try_cast("long").alias("line"),
        py_strip(parts[2]).alias("message"))
    d = d.filter(F.col("line").isNotNull())
    msg = F.col("message")
    return d.select(
        *keys, "mi", F.lit("PyFlakes").alias("tool_name"), "line", F.lit(1).cast("long").alias("col"),
        pyflakes_severity(msg).alias("severity"), F.lit("pyflakes").alias("rule_id"), "message",
        pyflakes_category(msg).alias("category"), pyflakes_suggestion(msg).alias("suggestion"),
        F.lit(False).alias("auto_fixable"))


def union_findings(reports: DataFrame, keys: list[str], path: str = "path", tool: str = "tool") -> DataFrame:
    """Route each report by its file's extension to the tools of that language, concatenate.

    JavaScript/TypeScript files take ESLint reports; Python files take Bandit, then PyFlakes.
    ``tool_rank`` keeps that order for downstream ordered lists.
    """
    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]*)$", 1))
    lang = _lookup(R.LINTER_LANGUAGES, ext)
    r = reports.withColumn("__lang", lang)
    es = ingest_eslint(r.filter(F.col("__lang").isin("javascript", "typescript") & (F.col(tool) == "ESLint")),
                       keys).withColumn("tool_rank", F.lit(0))
    bd = ingest_bandit(r.filter((F.col("__lang") == "python") & (F.col(tool) == "Bandit")),
                       keys).withColumn("tool_rank", F.lit(1))
    pf = ingest_pyflakes(r.filter((F.col("__lang") == "python") & (F.col(tool) == "PyFlakes")),
                         keys).withColumn("tool_rank", F.lit(2))
    return es.drop("fi").unionByName(bd).unionByName(pf)


def finding_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A1: one row per file with every count the score needs (one hash aggregate)."""
    sev, cat = F.col("severity"), F.col("category")
    sec = cat == "security"
    sty = cat == "style"
    c = lambda cond: F.count_if(cond).cast("long")
    return findings.groupBy(*keys).agg(
        c(F.lit(True)).alias("n_findings"),
        c(sev == "error").alias("n_error"),
        c(sev == "warning").alias("n_warning"),
        c(sec).alias("n_security"),
        c(sec & (sev == "error")).alias("n_security_error"),
        c(sec & (sev == "warning")).alias("n_security_warning"),
        c(sec & F.col("rule_id").isin(*R.HIGH_RISK_RULES)).alias("n_high_risk_rule"),
        c(cat == "performance").alias("n_performance"),
        c(sty).alias("n_style"),
        c(sty & (sev == "error")).alias("n_style_error"),
        c(sty & (sev == "warning")).alias("n_style_warning"),
        F.bool_or(F.lower(F.col("message")).contains("type")).alias("has_type_message"),
    )
