"""DuckDB twins of the fixture views (FIXTURES.md), as named CTEs with dependencies.

``with_views(body, names)`` prefixes ``body`` with the CTEs it needs, in dependency order.
"""

from __future__ import annotations

from codegauge.plans import shared_sql as S
from codegauge.plans.sqlgen import (bandit_severity, eslint_category, map_case, pyflakes_category,
                                    pyflakes_severity, pyflakes_suggestion)
from codegauge.functions import rules as R

_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate, l_quantity, l_extendedprice"


def _rows(key: str) -> str:
    return f"""SELECT {key} AS file_id, {S.LANG_OF_KEY.format(key=key)} AS lang, l_orderkey AS n,
      {S.KIND_OF_ROW.format(key=key)} AS k,
      row_number() OVER (PARTITION BY {key} ORDER BY {_ORDER}) - 1 AS pos
    FROM lineitem"""


def _file_lines(rows: str, prefix: str) -> str:
    return f"""SELECT file_id % 5 AS project_id, '{prefix}' || CAST(file_id AS STRING) || {S.EXT_OF_LANG} AS path,
      lang, pos, CASE WHEN lang = 'python' THEN {S.RENDER_PY_FILE_LINE} ELSE {S.RENDER_LINE} END AS line
    FROM {rows}"""


_EVENTS_K = """SELECT event_id, user_id, event_type, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
      'f' || CAST(user_id * 10 + event_id % 10 AS STRING) AS path
    FROM events"""

_FINDING_BASE = f"""SELECT *, {S.BANDIT_MESSAGE} AS b_msg FROM (
    SELECT event_id, event_type, k, path, {S.FINDING_TOOL} AS tool, {S.ESLINT_RULE} AS e_rule,
      {S.BANDIT_RULE} AS b_rule, {S.BANDIT_SEVERITY} AS b_sev, {S.BANDIT_CONFIDENCE} AS b_conf,
      {S.PYFLAKES_MESSAGE} AS p_msg, {S.ESLINT_MESSAGE} AS e_msg,
      CAST(floor(event_id / 8) AS BIGINT) AS chunk, 1 + event_id % 300 AS line
    FROM events_k) t"""

_FINDINGS = f"""SELECT path, tool AS tool_name, line,
      CASE tool WHEN 'ESLint' THEN 1 + k % 40 WHEN 'Bandit' THEN k % 40 ELSE 1 END AS col,
      CASE tool WHEN 'ESLint' THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END
                WHEN 'Bandit' THEN {bandit_severity('b_sev', 'b_conf')} ELSE {pyflakes_severity('p_msg')} END AS severity,
      CASE tool WHEN 'ESLint' THEN e_rule WHEN 'Bandit' THEN b_rule ELSE 'pyflakes' END AS rule_id,
      CASE tool WHEN 'ESLint' THEN e_msg WHEN 'Bandit' THEN b_msg ELSE p_msg END AS message,
      CASE tool WHEN 'ESLint' THEN {eslint_category('e_rule')} WHEN 'Bandit' THEN 'security'
                ELSE {pyflakes_category('p_msg')} END AS category,
      CASE tool WHEN 'ESLint' THEN {map_case('e_rule', R.ESLINT_SUGGESTIONS)}
                WHEN 'Bandit' THEN {map_case('b_rule', R.BANDIT_SUGGESTIONS)}
                ELSE {pyflakes_suggestion('p_msg')} END AS suggestion,
      (tool = 'ESLint' AND k % 2 = 0) AS auto_fixable,
      event_id AS ordinal
    FROM finding_base"""

_REPORT_ITEMS = """SELECT path, tool, chunk, event_id,
      CASE tool
        WHEN 'ESLint' THEN '{"ruleId":' || CASE WHEN e_rule IS NULL THEN 'null' ELSE '"' || e_rule || '"' END
             || ',"severity":' || CASE WHEN event_type = 'error' THEN '2' ELSE '1' END
             || ',"line":' || CAST(line AS STRING) || ',"column":' || CAST(1 + k % 40 AS STRING)
             || ',"message":"' || e_msg || '"'
             || CASE WHEN k % 2 = 0 THEN ',"fix":{"range":[0,1],"text":""}' ELSE '' END || '}'
        WHEN 'Bandit' THEN '{"test_id":"' || b_rule || '","issue_severity":"' || b_sev
             || '","issue_confidence":"' || b_conf || '","line_number":' || CAST(line AS STRING)
             || ',"col_offset":' || CAST(k % 40 AS STRING) || ',"issue_text":"' || b_msg || '"}'
        ELSE path || ':' || CAST(line AS STRING) || ': ' || p_msg END AS item
    FROM finding_base"""

_REPORTS = """SELECT path, tool, chunk,
      CASE tool
        WHEN 'ESLint' THEN CASE WHEN chunk % 37 = 0 THEN 'not json [' || items
                                ELSE '[{"filePath":"' || path || '","messages":[' || items || ']}]' END
        WHEN 'Bandit' THEN '{"results":[' || items || ']}'
        ELSE items END AS report
    FROM (SELECT path, tool, chunk,
            CASE WHEN tool = 'PyFlakes' THEN string_agg(item, chr(10) ORDER BY event_id)
                 ELSE string_agg(item, ',' ORDER BY event_id) END AS items
          FROM report_items GROUP BY path, tool, chunk) t"""

_GRID = """SELECT 'f' || CAST(o_orderkey AS STRING) AS path,
      CASE o_orderkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript'
        WHEN 3 THEN 'java' WHEN 4 THEN 'go' ELSE 'rust' END AS language,
      o_orderkey % 400 AS lines_of_code, o_orderkey % 53 AS cyclomatic, o_custkey % 101 AS cognitive,
      o_orderkey % 9 AS max_nesting, o_custkey % 4 AS n_long, o_orderkey % 6 AS n_dup,
      o_custkey % 8 AS function_count
    FROM orders"""

VIEWS = {
    "rows_p": (_rows("l_partkey"), []),
    "rows_s": (_rows("l_suppkey"), []),
    "code_lines": (f"SELECT file_id, lang, pos, {S.RENDER_LINE} AS line FROM rows_p", ["rows_p"]),
    "code_lines_long": (f"SELECT file_id, lang, pos, {S.RENDER_LINE} AS line FROM rows_s", ["rows_s"]),
    "source_lines": (_file_lines("rows_p", "src/p") + " UNION ALL " + _file_lines("rows_s", "lib/s"),
                     ["rows_p", "rows_s"]),
    "code_files": ("""SELECT project_id, path, lang, content, CAST(strlen(content) AS BIGINT) AS size_bytes
        FROM (SELECT project_id, path, lang, string_agg(line, chr(10) ORDER BY pos) AS content
              FROM source_lines GROUP BY project_id, path, lang) t""", ["source_lines"]),
    "events_k": (_EVENTS_K, []),
    "finding_base": (_FINDING_BASE, ["events_k"]),
    "findings": (_FINDINGS, ["finding_base"]),
    "report_items": (_REPORT_ITEMS, ["finding_base"]),
    "tool_reports": (_REPORTS, ["report_items"]),
    "metrics_grid": (_GRID, []),
}


def register(name: str, sql: str, deps: list[str]):
    VIEWS[name] = (sql, deps)


def with_views(body: str, names: list[str]) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in VIEWS[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n  {VIEWS[n][0]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"
