"""Metric queries (P3-P9, W1-W4, P14-P17) over the generated source-line views."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.operators import metrics as M
from codegauge.plans.oracle_fixtures import register, with_views
from codegauge.plans.registry import query
from codegauge.plans.sqlgen import by_lang, cnt_any, contains_any, ends_any, in_list, lstrip, q, strip, sql_filled
from codegauge.session import materialize
from codegauge.sources import fixtures as FX

K = ["file_id"]


# ---------------------------------------------------------------- DuckDB twins (plain window form)
def _feats(src: str) -> str:
    s = "s"
    ends = ends_any(s, R.BLOCK_ENDINGS)
    cog_open = f"({contains_any(s, R.COGNITIVE_OPENERS)} AND {ends})"
    cog_close = f"({in_list(s, R.COGNITIVE_CLOSERS)} OR prefix(s, 'except'))"
    nest = (f"CASE WHEN {contains_any(s, R.NESTING_OPENERS)} THEN (CASE WHEN {ends} THEN 1 ELSE 0 END) "
            f"WHEN {in_list(s, R.NESTING_CLOSERS)} OR (lang = 'python' AND length(line) - length({lstrip('line')}) < 4) "
            f"THEN -1 ELSE 0 END")
    return (f"SELECT *, {cog_open} AS cog_open, CAST({cog_open} AS INTEGER) - CAST({cog_close} AS INTEGER) AS cog_step, "
            f"{nest} AS nest_step FROM (SELECT *, {strip('line')} AS s FROM {src}) t")


def _counts(src: str) -> str:
    cc = by_lang(R.CYCLOMATIC_KEYWORDS, lambda kws: cnt_any("line", kws))
    fn = by_lang(R.FUNCTION_PATTERNS, lambda kws: cnt_any("line", kws))
    cl = by_lang(R.CLASS_PATTERNS, lambda kws: cnt_any("line", kws))
    return (f"SELECT file_id, lang, CAST(count(*) FILTER (WHERE s <> '') AS BIGINT) AS line_count, "
            f"CAST(count(*) FILTER (WHERE s <> '' AND NOT prefix(s, '#')) AS BIGINT) AS lines_of_code, "
            f"CAST(least({R.CYCLOMATIC_CAP}, 1 + sum({cc})) AS BIGINT) AS cyclomatic, "
            f"CAST(sum({fn}) AS BIGINT) AS function_count, CAST(sum({cl}) AS BIGINT) AS class_count "
            f"FROM {src} GROUP BY file_id, lang")


def _folds(src: str) -> str:
    w = "PARTITION BY file_id ORDER BY pos"
    return f"""SELECT file_id,
        CAST(least({R.COGNITIVE_CAP}, coalesce(sum(CASE WHEN cog_open THEN cs - cog_step + 1 - cf END), 0)) AS BIGINT) AS cognitive,
        CAST(greatest(0, max(ns - least(nf, ns))) AS BIGINT) AS max_nesting
      FROM (SELECT *, least(0, coalesce(min(cs) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cf,
                      least(0, coalesce(min(ns) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS nf
            FROM (SELECT *, sum(cog_step) OVER ({w} ROWS UNBOUNDED PRECEDING) AS cs,
                            sum(nest_step) OVER ({w} ROWS UNBOUNDED PRECEDING) AS ns FROM {src}) a) b
      GROUP BY file_id"""


def _long(src: str) -> str:
    js_name = strip("split_part(split_part(s, 'function ', 2), '(', 1)")
    name = f"CASE WHEN lang = 'python' THEN replace(split_part(s, '(', 1), 'def ', '') ELSE {js_name} END"
    return f"""SELECT file_id, lang, CAST(pos AS BIGINT) AS start_pos, name, CAST(next_pos - pos AS BIGINT) AS n_lines,
        name || ' (' || CAST(next_pos - pos AS STRING) || ' lines)' AS label
      FROM (SELECT file_id, lang, pos, {name} AS name, lead(pos) OVER (PARTITION BY file_id ORDER BY pos) AS next_pos
            FROM {src} WHERE (lang = 'python' AND prefix(s, 'def '))
                          OR (lang IN ('javascript', 'typescript') AND strpos(s, 'function ') > 0)) t
      WHERE next_pos IS NOT NULL AND name <> '' AND next_pos - pos > {R.LONG_FUNCTION_LINES}"""


def _dups(src: str) -> str:
    return f"""SELECT file_id, CAST(dup_rank AS BIGINT) AS dup_rank, CAST(r AS BIGINT) AS first_line,
        CAST(rj AS BIGINT) AS second_line,
        'Lines ' || CAST(r AS STRING) || '-' || CAST(r + 2 AS STRING) || ' duplicated at '
          || CAST(rj AS STRING) || '-' || CAST(rj + 2 AS STRING) AS label
      FROM (SELECT a.file_id, a.r, b.r AS rj, row_number() OVER (PARTITION BY a.file_id ORDER BY a.r, b.r) AS dup_rank
            FROM (SELECT file_id, r, s, lead(s, 1) OVER w AS s2, lead(s, 2) OVER w AS s3
                  FROM (SELECT file_id, s, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS r
                        FROM {src} WHERE s <> '') n
                  WINDOW w AS (PARTITION BY file_id ORDER BY r)) a
            JOIN (SELECT file_id, r, s, lead(s, 1) OVER w AS s2, lead(s, 2) OVER w AS s3
                  FROM (SELECT file_id, s, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS r
                        FROM {src} WHERE s <> '') n
                  WINDOW w AS (PARTITION BY file_id ORDER BY r)) b
              ON a.file_id = b.file_id AND a.s = b.s AND a.s2 = b.s2 AND a.s3 = b.s3 AND b.r >= a.r + 3
            WHERE a.s3 IS NOT NULL AND b.s3 IS NOT NULL) t
      WHERE dup_rank <= {R.DUPLICATE_LIMIT}"""


def _fm(v: str) -> str:
    mi = ("least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0::DOUBLE - (0.23::DOUBLE * lines_of_code "
          "+ 3.2::DOUBLE * cyclomatic + 2.5::DOUBLE * cognitive + n_long * 5 + n_dup * 10)))")
    debt = ("greatest(0, cyclomatic - 10) * 15 + n_long * 30 + n_dup * 45 + greatest(0, max_nesting - 4) * 20")
    return f"""SELECT *, {mi} AS maintainability_index, CAST({debt} AS BIGINT) AS technical_debt_minutes
      FROM (SELECT c.*, f.cognitive, f.max_nesting,
              CAST(coalesce(l.n_long, 0) AS BIGINT) AS n_long, CAST(coalesce(d.n_dup, 0) AS BIGINT) AS n_dup
            FROM {v}_counts c LEFT JOIN {v}_folds f USING (file_id)
            LEFT JOIN (SELECT file_id, count(*) AS n_long FROM {v}_lf GROUP BY file_id) l USING (file_id)
            LEFT JOIN (SELECT file_id, count(*) AS n_dup FROM {v}_dups GROUP BY file_id) d USING (file_id)) t"""


def _issues(v: str) -> str:
    return f"""SELECT file_id, CAST(0 AS BIGINT) AS kind, CAST(0 AS BIGINT) AS seq, 'warning' AS severity, 'complexity' AS category,
        {sql_filled(R.ISSUE_CYCLOMATIC, "cyclomatic")} AS message FROM {v}_fm WHERE cyclomatic > 15
      UNION ALL SELECT file_id, 1, 0, 'warning', 'complexity', {sql_filled(R.ISSUE_COGNITIVE, "cognitive")} FROM {v}_fm WHERE cognitive > 25
      UNION ALL SELECT file_id, 2, start_pos, 'info', 'style', {sql_filled(R.ISSUE_LONG, "label")} FROM {v}_lf
      UNION ALL SELECT file_id, 3, dup_rank, 'warning', 'style', {sql_filled(R.ISSUE_DUPLICATE, "label")} FROM {v}_dups
      UNION ALL SELECT file_id, 4, 0, 'error', 'maintainability',
        {sql_filled(R.ISSUE_INDEX, "format('{:.1f}', maintainability_index)")} FROM {v}_fm WHERE maintainability_index < 30"""


for _v in ["code_lines", "code_lines_long"]:
    register(f"{_v}_feats", _feats(_v), [_v])
    register(f"{_v}_counts", _counts(f"{_v}_feats"), [f"{_v}_feats"])
    register(f"{_v}_folds", _folds(f"{_v}_feats"), [f"{_v}_feats"])
    register(f"{_v}_lf", _long(f"{_v}_feats"), [f"{_v}_feats"])
    register(f"{_v}_dups", _dups(f"{_v}_feats"), [f"{_v}_feats"])
    register(f"{_v}_fm", _fm(_v), [f"{_v}_counts", f"{_v}_folds", f"{_v}_lf", f"{_v}_dups"])
    register(f"{_v}_issues", _issues(_v), [f"{_v}_fm", f"{_v}_lf", f"{_v}_dups"])


# ---------------------------------------------------------------- Spark queries
@query("cyclomatic_complexity", with_views(
    "SELECT file_id, lang, cyclomatic FROM code_lines_counts", ["code_lines_counts"]))
def cyclomatic_complexity(spark, sf):
    return M.size_and_counts(FX.code_lines(spark, sf), K).select("file_id", "lang", "cyclomatic")


@query("cognitive_complexity", with_views(
    "SELECT file_id, cognitive FROM code_lines_folds", ["code_lines_folds"]))
def cognitive_complexity(spark, sf):
    return M.fold_metrics(FX.code_lines(spark, sf), K).select("file_id", "cognitive")


@query("max_nesting_depth", with_views(
    "SELECT file_id, max_nesting FROM code_lines_folds", ["code_lines_folds"]))
def max_nesting_depth(spark, sf):
    return M.fold_metrics(FX.code_lines(spark, sf), K).select("file_id", "max_nesting")


@query("loc_and_line_count", with_views(
    "SELECT file_id, line_count, lines_of_code FROM code_lines_counts", ["code_lines_counts"]))
def loc_and_line_count(spark, sf):
    return M.size_and_counts(FX.code_lines(spark, sf), K).select("file_id", "line_count", "lines_of_code")


@query("function_class_count", with_views(
    "SELECT file_id, function_count, class_count FROM code_lines_counts", ["code_lines_counts"]))
def function_class_count(spark, sf):
    return M.size_and_counts(FX.code_lines(spark, sf), K).select("file_id", "function_count", "class_count")


@query("long_functions", with_views(
    "SELECT file_id, start_pos, name, n_lines, label FROM code_lines_long_lf", ["code_lines_long_lf"]))
def long_functions(spark, sf):
    return M.long_functions(FX.code_lines_long(spark, sf), K).select("file_id", "start_pos", "name", "n_lines", "label")


@query("duplicate_blocks", with_views(
    "SELECT file_id, dup_rank, first_line, second_line, label FROM code_lines_long_dups", ["code_lines_long_dups"]))
def duplicate_blocks(spark, sf):
    return M.duplicate_blocks(FX.code_lines_long(spark, sf), K)


_MD_COLS = ["file_id", "lines_of_code", "cyclomatic", "cognitive", "max_nesting", "n_long", "n_dup"]


@query("maintainability_and_debt", with_views(
    f"SELECT {', '.join(_MD_COLS)}, round(maintainability_index, 6) AS maintainability_index, "
    f"technical_debt_minutes FROM code_lines_long_fm", ["code_lines_long_fm"]))
def maintainability_and_debt(spark, sf):
    m = M.file_metrics(FX.code_lines_long(spark, sf), K)
    return m.select(*_MD_COLS, F.round("maintainability_index", 6).alias("maintainability_index"),
                    "technical_debt_minutes")


@query("quality_issues", with_views(
    "SELECT file_id, kind, seq, severity, category, message FROM code_lines_long_issues",
    ["code_lines_long_issues"]))
def quality_issues(spark, sf):
    lines = FX.code_lines_long(spark, sf)
    # both results feed the metrics and the issue rows: write them once (they are small)
    lf = materialize(M.long_functions(lines, K), "long_functions")
    dups = materialize(M.duplicate_blocks(lines, K), "duplicate_blocks")
    # one row per file, read by several branches below
    m = materialize(M.file_metrics(lines, K, lf, dups), "file_metrics")
    iss = M.quality_issues(m, lf, dups, K)
    return iss.select("file_id", "kind", "seq", "severity", "category", "message")
