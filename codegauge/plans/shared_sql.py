"""SQL expression text that both Spark SQL and DuckDB parse identically.

Only plain CASE / arithmetic / ``||`` / CAST forms are used here (no regex literals, whose
backslash handling differs between the two dialects). Spark evaluates them with ``F.expr``;
the DuckDB oracle embeds the same text.
"""

# Language of a generated file from its key (FIXTURES F1).
LANG_OF_KEY = ("CASE {key} % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' "
               "WHEN 2 THEN 'typescript' ELSE 'java' END")

# Line kind of a lineitem row (FIXTURES F1).
KIND_OF_ROW = ("(l_orderkey * 7 + l_linenumber * 3 + l_suppkey + l_partkey) "
               "% (12 + 16 * (({key} % 16) % 5))")


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


# Text of a code line for the line views (FIXTURES F1); columns lang, n, k.
RENDER_LINE = f"""CASE
  WHEN k = 0 THEN CASE lang WHEN 'python' THEN 'def f' || {_s('n % 50')} || '(a):'
                            WHEN 'java' THEN 'public int f' || {_s('n % 50')} || '(a) {{'
                            ELSE 'function f' || {_s('n % 50')} || '(a) {{' END
  WHEN k = 1 THEN CASE WHEN lang = 'python' THEN '    if a > 1:' ELSE '    if (a > 1) {{' END
  WHEN k = 2 THEN CASE WHEN lang = 'python' THEN '    for i in a:' ELSE '    for (i of a) {{' END
  WHEN k = 3 THEN CASE WHEN lang = 'python' THEN 'except E:' ELSE '}}' END
  WHEN k = 4 THEN CASE WHEN lang = 'python' THEN '    try:' ELSE '}}' END
  WHEN k = 5 THEN ''
  WHEN k = 6 THEN CASE WHEN lang = 'python' THEN '# note' ELSE '// note' END
  WHEN k = 7 THEN CASE WHEN lang = 'python' THEN 'class C' || {_s('n % 9')} || ':'
                       ELSE 'class C' || {_s('n % 9')} || ' {{' END
  WHEN k = 8 THEN CASE WHEN lang = 'python' THEN 'import m' || {_s('n % 40')}
                       ELSE 'import x from "./p' || {_s('n % 200')} || '"' END
  WHEN k = 9 THEN CASE WHEN lang = 'python' THEN '        y = a and b or c' ELSE '        y = a && b || c' END
  WHEN k = 10 THEN CASE WHEN lang = 'python' THEN 'end' ELSE '}}' END
  WHEN k = 11 THEN '    return a'
  ELSE 'x = ' || {_s('n % 3')}
END"""

# Python files of the file view (FIXTURES F2) are rendered as valid top-level statements,
# except k = 3 in files whose id is a multiple of 11, which makes the file a syntax error.
RENDER_PY_FILE_LINE = f"""CASE
  WHEN k = 0 THEN 'def f' || {_s('n % 50')} || '(a): return a'
  WHEN k = 1 THEN 'from m' || {_s('n % 40')} || ' import y'
  WHEN k = 2 THEN 'from . import z'
  WHEN k = 3 THEN CASE WHEN file_id % 11 = 0 THEN 'def (:' ELSE 'async def g' || {_s('n % 50')} || '(a): return a' END
  WHEN k = 4 THEN 'if a: x = 1'
  WHEN k = 5 THEN ''
  WHEN k = 6 THEN '# note'
  WHEN k = 7 THEN 'class C' || {_s('n % 9')} || ': pass'
  WHEN k = 8 THEN 'import m' || {_s('n % 40')}
  WHEN k = 9 THEN 'y = a and b or c'
  WHEN k = 10 THEN 'end'
  WHEN k = 11 THEN 'import os.path'
  ELSE 'x = ' || {_s('n % 3')}
END"""

EXT_OF_LANG = ("CASE lang WHEN 'python' THEN '.py' WHEN 'javascript' THEN '.js' "
               "WHEN 'typescript' THEN '.ts' ELSE '.java' END")

# Findings generated from events (FIXTURES F4); columns event_id, user_id, event_type, k.
FINDING_TOOL = ("CASE event_type WHEN 'error' THEN 'ESLint' WHEN 'click' THEN 'ESLint' "
                "WHEN 'purchase' THEN 'PyFlakes' ELSE 'Bandit' END")
ESLINT_RULE = ("CASE WHEN k % 17 = 0 THEN NULL ELSE CASE k % 10 WHEN 0 THEN 'no-eval' "
               "WHEN 1 THEN 'prefer-spread' WHEN 2 THEN 'indent' WHEN 3 THEN 'complexity' "
               "WHEN 4 THEN 'no-unused-vars' WHEN 5 THEN 'no-console' WHEN 6 THEN 'quotes' "
               "WHEN 7 THEN 'max-depth' WHEN 8 THEN 'no-implied-eval' ELSE 'semi' END END")
ESLINT_MESSAGE = f"CASE WHEN k % 9 = 0 THEN 'Unexpected type coercion' ELSE 'Rule violation ' || {_s('k')} END"
BANDIT_LEVELS = "CASE {x} WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END"
BANDIT_SEVERITY = BANDIT_LEVELS.format(x="k % 3")
BANDIT_CONFIDENCE = BANDIT_LEVELS.format(x="CAST((k - k % 3) / 3 AS BIGINT) % 3")
BANDIT_RULE = ("CASE k % 7 WHEN 0 THEN 'B101' WHEN 1 THEN 'B102' WHEN 2 THEN 'B103' WHEN 3 THEN 'B108' "
               "WHEN 4 THEN 'B301' WHEN 5 THEN 'B601' ELSE 'B602' END")
BANDIT_MESSAGE = "'Issue ' || b_rule || CASE WHEN k % 11 = 0 THEN ' needs a type check' ELSE '' END"
PYFLAKES_MESSAGE = (f"CASE k % 4 WHEN 0 THEN 'm' || {_s('k')} || ' imported but unused' "
                    f"WHEN 1 THEN 'undefined name x' || {_s('k')} "
                    f"WHEN 2 THEN 'redefined unused f' || {_s('k')} || ' from line 3' "
                    f"ELSE 'local variable z' || {_s('k')} || ' is assigned to but never used' END")

# Branch of a generated commit (FIXTURES F10).
COMMIT_BRANCH = ("CASE o_orderkey % 6 WHEN 0 THEN 'main' WHEN 1 THEN 'develop' WHEN 2 THEN 'feature/x' "
                 "WHEN 3 THEN 'hotfix/y' WHEN 4 THEN 'release/1' ELSE 'other' END")

CHANGE_TYPE = ("CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'modified' "
               "WHEN 'click' THEN 'modified' WHEN 'error' THEN 'deleted' ELSE 'moved' END")

# Directory of a change event's path (FIXTURES F11): some land in ignored directories.
CHANGE_DIR = "CASE event_id % 17 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'build/x/' ELSE 'src/' END"

# Listing of project trees (FIXTURES F7): marker files, top-level directories and source files.
LISTING_KIND = "(p_partkey * 7 + p_size) % 211"
MARKER_NAME = ("CASE kind WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements.txt' WHEN 2 THEN 'pyproject.toml' "
               "WHEN 3 THEN 'pom.xml' WHEN 4 THEN 'go.mod' WHEN 5 THEN 'webpack.config.js' WHEN 6 THEN 'vite.config.ts' "
               "WHEN 7 THEN 'build.gradle' WHEN 8 THEN 'Makefile' WHEN 9 THEN 'yarn.lock' WHEN 10 THEN 'package-lock.json' "
               "WHEN 11 THEN 'pnpm-lock.yaml' WHEN 12 THEN 'Pipfile' WHEN 13 THEN 'vite.config.js' END")
TOP_DIR = ("CASE kind WHEN 14 THEN 'packages' WHEN 15 THEN 'apps' WHEN 16 THEN 'src' WHEN 17 THEN 'components' "
           "WHEN 18 THEN 'views' WHEN 19 THEN 'controllers' WHEN 20 THEN 'models' WHEN 21 THEN 'services' "
           "ELSE 'repositories' END")
PACKAGE_DEP = ("CASE p_size % 7 WHEN 0 THEN 'next' WHEN 1 THEN 'react' WHEN 2 THEN 'vue' WHEN 3 THEN '@angular/core' "
               "WHEN 4 THEN 'express' WHEN 5 THEN 'lodash' ELSE '@vue/core' END")
SOURCE_EXT = "CASE p_size % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.go' ELSE '.md' END"
# One row per part; the first part of a (project, marker kind) puts its marker at the root,
# later ones nest it under their own folder. Columns used: p_partkey, p_size, kind, first_of_kind.
LISTING_PATH = f"""CASE WHEN kind < 14 THEN CASE WHEN first_of_kind THEN {MARKER_NAME}
                                  ELSE 'sub' || CAST(p_partkey AS STRING) || '/' || {MARKER_NAME} END
         WHEN kind < 23 THEN CASE WHEN p_size % 2 = 0 THEN upper({TOP_DIR}) ELSE {TOP_DIR} END
                             || '/f' || CAST(p_partkey AS STRING) || '.js'
         ELSE 'src/p' || CAST(p_partkey AS STRING) || {SOURCE_EXT} END"""
LISTING_CONTENT = f"""CASE WHEN kind = 0 THEN CASE WHEN p_size % 11 = 0 THEN '{{"dependencies": '
           ELSE '{{"name":"p","version":"1.' || CAST(p_size AS STRING) || '.0","dependencies":{{"' || {PACKAGE_DEP}
                || '":"^1.0.0"}},"devDependencies":{{"jest":"1"}}}}' END
         WHEN kind = 2 THEN '[project]' || chr(10) || 'name = "x"' || chr(10) || 'version = "0.' || CAST(p_size AS STRING) || '"'
         ELSE '' END"""

# Changes of the file view (FIXTURES F13): condition, kind, hours after the start, event number, path, destination, text.
_MORE = ("content || chr(10) || CASE WHEN lang = 'python' THEN 'import m' || CAST(id % 40 AS STRING) WHEN lang = 'java' THEN '// x' "
         "ELSE 'import x from \"./p' || CAST((id * 7) % 200 AS STRING) || '\"' END")
TREE_CHANGES = [
    ("TRUE", "created", "id % 7", 0),
    ("src AND id % 3 = 0", "modified", "10 + id % 5", 1, "path", "CAST(NULL AS STRING)", _MORE),
    ("src AND id % 7 = 3", "deleted", "20 + id % 3", 2, "path", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"),
    ("src AND id % 11 = 5", "moved", "15", 3, "path", "'src/p' || CAST(id AS STRING) || '.jsx'"),
    ("src AND id % 4 = 2 AND id % 3 = 1", "created", "12", 4, "'src/p' || CAST(id AS STRING) || '.py'", "CAST(NULL AS STRING)", "'import os'"),
    ("id % 13 = 2", "modified", "id % 7 - 1", 5, "path", "CAST(NULL AS STRING)", "'stale'"),
]
