"""Knowledge-graph queries (E1-E5, J1-J3, J7-J9, P12, P13, A3-A5, K1, F2, F3) over the file view."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.operators import extract as E
from codegauge.operators import graph as G
from codegauge.operators import snapshots as SN
from codegauge.plans import q_metrics  # noqa: F401  (shared views)
from codegauge.plans.oracle_fixtures import register, with_views
from codegauge.plans.registry import query
from codegauge.plans.sqlgen import q, strip
from codegauge.session import materialize
from codegauge.sources import fixtures as FX

P = ["project_id"]


class Graph:
    """The graph tables of the file view, each built when first read. The extraction output and the edges are written
    once and shared, as several branches of a query read them."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    def __getitem__(self, name):
        return getattr(self, name)

    @cached_property
    def files(self):
        return FX.code_files(self.spark, self.sf).withColumn("lang", G.graph_language("path"))

    @cached_property
    def extracted(self):
        return materialize(E.analyze_files(self.files), "extract")

    @cached_property
    def entities(self):
        return E.entities(self.extracted)

    @cached_property
    def imports(self):
        return E.imports(self.extracted)

    @cached_property
    def nodes(self):
        return G.file_nodes(self.files)

    @cached_property
    def risk(self):
        """One row per file, read by several branches of a report: written once."""
        return materialize(G.risk_scores(self.nodes, self.entities, self.imports), "risk")

    @cached_property
    def resolved(self):
        return G.resolve_imports(self.imports, self.files.select(*P, "path"))

    @cached_property
    def import_edges(self):
        return materialize(G.import_edges(self.resolved, self.nodes), "import_edges")

    @cached_property
    def edges(self):
        return materialize(G.all_edges(self.import_edges, G.contains_edges(self.entities)), "edges")


def build_graph(spark, sf):
    return Graph(spark, sf)


# ---------------------------------------------------------------- DuckDB twins
_JS = "lang IN ('javascript', 'typescript')"
_ENT_SQL = f"""
  SELECT project_id, path, name, 'function' AS entity_type, CAST(pos + 1 AS BIGINT) AS line_number,
         'def ' || name || '(...)' AS signature
  FROM (SELECT project_id, path, pos, regexp_extract(line, '^def (\\w+)\\(', 1) AS name FROM source_lines
        WHERE lang = 'python' AND regexp_matches(line, '^def \\w+\\(')) a
  WHERE (project_id, path) IN (SELECT project_id, path FROM py_ok)
  UNION ALL
  SELECT project_id, path, name, 'class', CAST(pos + 1 AS BIGINT), 'class ' || name || '(...)'
  FROM (SELECT project_id, path, pos, regexp_extract(line, '^class (\\w+)', 1) AS name FROM source_lines
        WHERE lang = 'python' AND regexp_matches(line, '^class \\w+')) b
  WHERE (project_id, path) IN (SELECT project_id, path FROM py_ok)
""" + "".join(f"""  UNION ALL
  SELECT project_id, path, name, '{t}', CAST(pos + 1 AS BIGINT), sig
  FROM (SELECT project_id, path, pos, unnest(regexp_extract_all(line, {q(p)}, 1)) AS name,
               unnest(regexp_extract_all(line, {q(p)}, 0)) AS sig
        FROM source_lines WHERE {_JS}) j{i}
""" for i, (p, t) in enumerate([(x, "function") for x in E.JS_FUNCTION_PATTERNS] + [(E.JS_CLASS_PATTERN, "class")]))

_IMP_SQL = f"""
  SELECT project_id, path, regexp_extract(line, '^import (.+)$', 1) AS specifier FROM source_lines
  WHERE lang = 'python' AND prefix(line, 'import ') AND (project_id, path) IN (SELECT project_id, path FROM py_ok)
  UNION ALL
  SELECT project_id, path, regexp_extract(line, '^from ([^ ]+) import', 1) FROM source_lines
  WHERE lang = 'python' AND prefix(line, 'from ') AND NOT prefix(line, 'from . ')
    AND (project_id, path) IN (SELECT project_id, path FROM py_ok)
""" + "".join(f"""  UNION ALL
  SELECT project_id, path, unnest(regexp_extract_all(line, {q(p)}, 1)) FROM source_lines WHERE {_JS}
""" for p in E.JS_IMPORT_PATTERNS)

_EXTS = ", ".join(f"({i}, {q(e)})" for i, e in enumerate(R.GRAPH_LANGUAGES))
_RESOLVE_SQL = f"""SELECT r.project_id, r.path, r.specifier, arg_min(f.path, e.rank) AS target
  FROM (SELECT DISTINCT project_id, path, specifier,
          regexp_replace(
            array_to_string(list_filter(string_split(dir || '/' || rest, '/'), lambda x: x <> '' AND x <> '.'), '/'),
            '([^/])\\.[^./]*$', '\\1') AS stem
        FROM (SELECT *, CASE WHEN prefix(specifier, './') THEN substr(specifier, 3)
                             WHEN prefix(specifier, '../') THEN specifier ELSE substr(specifier, 2) END AS rest,
                        CASE WHEN strpos(path, '/') > 0 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir
              FROM imports_all WHERE prefix(specifier, '.')) a) r
  CROSS JOIN (VALUES {_EXTS}) e(rank, ext)
  JOIN code_files f ON f.project_id = r.project_id AND f.path = r.stem || e.ext
  GROUP BY r.project_id, r.path, r.specifier"""

register("py_ok", "SELECT project_id, path FROM source_lines WHERE lang = 'python' GROUP BY project_id, path "
                  "HAVING bool_and(line <> 'def (:')", ["source_lines"])
register("entities_all", _ENT_SQL, ["source_lines", "py_ok"])
register("imports_all", _IMP_SQL, ["source_lines", "py_ok"])
register("resolved", _RESOLVE_SQL, ["imports_all", "code_files"])
register("import_edges", """SELECT i.project_id, i.path AS src, r.target AS dst, CAST(count(*) AS BIGINT) AS occurrences
  FROM imports_all i JOIN resolved r USING (project_id, path, specifier)
  GROUP BY i.project_id, i.path, r.target""", ["imports_all", "resolved"])
register("edges_all", """SELECT project_id, src, dst FROM import_edges
  UNION SELECT DISTINCT project_id, path, path || ':' || name FROM entities_all""", ["import_edges", "entities_all"])
register("nodes", f"""SELECT f.project_id, f.path, f.size_bytes,
    CAST((SELECT count(*) FROM source_lines s WHERE s.project_id = f.project_id AND s.path = f.path
          AND {strip('s.line')} <> '') AS BIGINT) AS line_count
  FROM code_files f""", ["code_files", "source_lines"])
register("risk", """SELECT *, risk_tenths / 10.0 AS risk_score,
    CASE WHEN risk_tenths < 3 THEN 'low' WHEN risk_tenths < 6 THEN 'medium' WHEN risk_tenths < 8 THEN 'high'
         ELSE 'extreme' END AS complexity_level
  FROM (SELECT n.*, CAST(coalesce(e.c, 0) AS BIGINT) AS n_entities, CAST(coalesce(i.c, 0) AS BIGINT) AS n_imports,
          CAST(least(10, (CASE WHEN size_bytes > 10000 THEN 3 ELSE 0 END) + (CASE WHEN line_count > 500 THEN 4 ELSE 0 END)
            + (CASE WHEN coalesce(e.c, 0) > 20 THEN 3 ELSE 0 END) + (CASE WHEN coalesce(i.c, 0) > 15 THEN 2 ELSE 0 END)) AS BIGINT)
            AS risk_tenths
        FROM nodes n
        LEFT JOIN (SELECT project_id, path, count(*) AS c FROM entities_all GROUP BY 1, 2) e USING (project_id, path)
        LEFT JOIN (SELECT project_id, path, count(*) AS c FROM imports_all GROUP BY 1, 2) i USING (project_id, path)) t""",
         ["nodes", "entities_all", "imports_all"])


# ---------------------------------------------------------------- queries
@query("extract_entities", with_views(
    "SELECT project_id, path, name, entity_type, line_number, signature FROM entities_all", ["entities_all"]))
def extract_entities(spark, sf):
    g = build_graph(spark, sf)
    return g["entities"].select(*P, "path", "name", "entity_type", "line_number", "signature")


@query("extract_imports", with_views(
    "SELECT project_id, path, specifier, CAST(count(*) AS BIGINT) AS n FROM imports_all GROUP BY 1, 2, 3",
    ["imports_all"]))
def extract_imports(spark, sf):
    g = build_graph(spark, sf)
    return g["imports"].groupBy(*P, "path", "specifier").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("resolve_imports", with_views(
    """SELECT i.project_id, i.path, i.specifier, r.target, CAST(count(*) AS BIGINT) AS n
       FROM imports_all i JOIN resolved r USING (project_id, path, specifier) GROUP BY 1, 2, 3, 4""",
    ["imports_all", "resolved"]))
def resolve_imports(spark, sf):
    g = build_graph(spark, sf)
    return g["resolved"].groupBy(*P, "path", "specifier", "target").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("import_edges", with_views("SELECT * FROM import_edges", ["import_edges"]))
def import_edges(spark, sf):
    return build_graph(spark, sf)["import_edges"].select(*P, "src", "dst", "occurrences")


@query("dependents", with_views("SELECT project_id, dst AS node, src AS dependent FROM edges_all", ["edges_all"]))
def dependents(spark, sf):
    return G.dependents(build_graph(spark, sf)["edges"])


@query("dependencies", with_views("SELECT project_id, src AS node, dst AS dependency FROM edges_all", ["edges_all"]))
def dependencies(spark, sf):
    return G.dependencies(build_graph(spark, sf)["edges"])


@query("change_impact", with_views("""SELECT project_id, target, direct_impact, indirect_impact,
      direct_impact + indirect_impact AS total_impact_files,
      CASE WHEN direct_impact + indirect_impact > 20 THEN 'extreme' WHEN direct_impact + indirect_impact > 10 THEN 'high'
           WHEN direct_impact + indirect_impact > 5 THEN 'medium' ELSE 'low' END AS risk_level
    FROM (SELECT f.project_id, f.path AS target,
            CAST((SELECT count(*) FROM edges_all e WHERE e.project_id = f.project_id AND e.dst = f.path) AS BIGINT) AS direct_impact,
            CAST((SELECT count(DISTINCT e2.src) FROM edges_all e1 JOIN edges_all e2
                    ON e2.project_id = e1.project_id AND e2.dst = e1.src
                  WHERE e1.project_id = f.project_id AND e1.dst = f.path) AS BIGINT) AS indirect_impact
          FROM code_files f) t""", ["edges_all", "code_files"]))
def change_impact(spark, sf):
    g = build_graph(spark, sf)
    return G.change_impact(g["files"], g["import_edges"])


def _risk(spark, sf):
    g = build_graph(spark, sf)
    return g, G.risk_scores(g["nodes"], g["entities"], g["imports"])


@query("risk_scores", with_views(
    "SELECT project_id, path, size_bytes, line_count, n_entities, n_imports, risk_score, complexity_level FROM risk",
    ["risk"]))
def risk_scores(spark, sf):
    _, r = _risk(spark, sf)
    return r.select(*P, "path", "size_bytes", "line_count", "n_entities", "n_imports", "risk_score",
                    "complexity_level")


@query("complexity_distribution", with_views(
    "SELECT project_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE complexity_level = '{b}') AS BIGINT) AS {b}"
                                      for b in ["low", "medium", "high", "extreme"])
    + " FROM risk GROUP BY project_id", ["risk"]))
def complexity_distribution(spark, sf):
    _, r = _risk(spark, sf)
    return G.complexity_distribution(r)


@query("project_statistics", with_views("""SELECT project_id, CAST(count(*) AS BIGINT) AS total_files,
      CAST(sum(line_count) AS BIGINT) AS total_lines,
      CAST(count(*) FILTER (WHERE risk_tenths > 7) AS BIGINT) AS high_risk_files,
      CAST(coalesce(max(e.c), 0) AS BIGINT) AS total_entities, CAST(coalesce(max(g.c), 0) AS BIGINT) AS dependency_relationships,
      CAST(coalesce(max(o.c), 0) AS BIGINT) AS import_occurrences
    FROM risk
    LEFT JOIN (SELECT project_id, count(*) AS c FROM (SELECT DISTINCT project_id, path, name FROM entities_all) x
               GROUP BY 1) e USING (project_id)
    LEFT JOIN (SELECT project_id, count(*) AS c FROM edges_all GROUP BY 1) g USING (project_id)
    LEFT JOIN (SELECT project_id, sum(occurrences) AS c FROM import_edges GROUP BY 1) o USING (project_id)
    GROUP BY project_id""", ["risk", "entities_all", "edges_all", "import_edges"]))
def project_statistics(spark, sf):
    g, r = _risk(spark, sf)
    return G.project_statistics(r, g["entities"], g["edges"], g["import_edges"])


@query("most_complex_files", with_views("""SELECT project_id, CAST(rank AS BIGINT) AS rank, path, risk_score, line_count
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY risk_tenths DESC, path) AS rank FROM risk) t
    WHERE rank <= 10""", ["risk"]))
def most_complex_files(spark, sf):
    _, r = _risk(spark, sf)
    return G.most_complex_files(r)


@query("high_risk_files", with_views("""SELECT project_id, CAST(rank AS BIGINT) AS rank, path, risk_score
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path) AS rank FROM risk WHERE risk_tenths > 7) t
    WHERE rank <= 10""", ["risk"]))
def high_risk_files(spark, sf):
    _, r = _risk(spark, sf)
    return G.high_risk_files(r)


SEARCH = "f1"


@query("search_entities", with_views(f"""SELECT project_id, CAST(rank AS BIGINT) AS rank, path, name, entity_type,
      line_number, total_found
    FROM (SELECT *, count(*) OVER (PARTITION BY project_id) AS total_found,
                 row_number() OVER (PARTITION BY project_id ORDER BY path, name) AS rank
          FROM (SELECT project_id, path, name, arg_max(entity_type, line_number) AS entity_type, max(line_number) AS line_number
                FROM entities_all WHERE strpos(name, '{SEARCH}') > 0 GROUP BY 1, 2, 3) a) t
    WHERE rank <= 10""", ["entities_all"]))
def search_entities(spark, sf):
    g = build_graph(spark, sf)
    last = G.last_entities(g["entities"])
    out = G.search_entities(last, SEARCH, limit=10)
    return out.select(*P, F.col("rank").cast("long"), "path", "name", "entity_type", "line_number", "total_found")


@query("main_language", with_views("""SELECT project_id, language AS main_language, CAST(n AS BIGINT) AS n_files
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, language) AS r
          FROM (SELECT project_id, CASE WHEN suffix(path, '.py') THEN 'python' WHEN suffix(path, '.js') THEN 'javascript'
                       WHEN suffix(path, '.ts') THEN 'typescript' ELSE 'java' END AS language, count(*) AS n
                FROM code_files GROUP BY 1, 2) t) u WHERE r = 1""", ["code_files"]))
def main_language(spark, sf):
    from codegauge.operators import project as PR
    files = FX.file_paths(spark, sf)
    return PR.main_language(files)


register("last_commits", """SELECT l_partkey % 5 AS project_id, 'src/p' || CAST(l_partkey - l_partkey % 5 AS STRING) || '.ts' AS path, max(o_orderdate) AS last_commit
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""", [])

_CONTEXT_NUMBERS = ["size_bytes", "line_count", "n_entities", "n_dependencies", "n_dependents", "n_imports"]
_CONTEXT = ["project_id", "path", "kind", "language", *_CONTEXT_NUMBERS, "risk_score", "last_modified", "item", "item_type", "line_number", "signature", "docstring", "n"]


def _context_rows(kind: str, src: str, path: str = "path", **have: str) -> str:
    """Rows of one kind of the file context, null in the columns of the others."""
    none = {c: "BIGINT" for c in [*_CONTEXT_NUMBERS, "line_number", "n"]} | {"risk_score": "DOUBLE"}
    cols = {"project_id": "project_id", "path": path, "kind": f"'{kind}'", **have}
    return "SELECT " + ", ".join(f"{cols[c] if c in cols else f'CAST(NULL AS {none.get(c, 'VARCHAR')})'} AS {c}" for c in _CONTEXT) + f" FROM {src}"


@query("file_context", with_views(_context_rows("file", """(SELECT r.project_id, r.path,
      CASE WHEN suffix(r.path, '.py') THEN 'python' WHEN suffix(r.path, '.js') THEN 'javascript'
           WHEN suffix(r.path, '.ts') THEN 'typescript' ELSE 'java' END AS language, r.size_bytes, r.line_count,
      CAST(coalesce(e.c, 0) AS BIGINT) AS n_entities, CAST(coalesce(s.c, 0) AS BIGINT) AS n_dependencies,
      CAST(coalesce(d.c, 0) AS BIGINT) AS n_dependents, r.n_imports, r.risk_score, strftime(t.last_commit, '%Y-%m-%dT%H:%M:%S') AS last_modified
    FROM risk r
    LEFT JOIN (SELECT project_id, path, count(*) AS c
               FROM (SELECT DISTINCT project_id, path, name FROM entities_all) x GROUP BY 1, 2) e USING (project_id, path)
    LEFT JOIN (SELECT project_id, src AS path, count(*) AS c FROM edges_all GROUP BY 1, 2) s USING (project_id, path)
    LEFT JOIN (SELECT project_id, dst AS path, count(*) AS c FROM edges_all GROUP BY 1, 2) d USING (project_id, path)
    LEFT JOIN last_commits t USING (project_id, path)) f""", **{c: c for c in ["language", *_CONTEXT_NUMBERS, "risk_score", "last_modified"]})
    + " UNION ALL " + _context_rows("entity", "entities_all", item="name", item_type="entity_type", line_number="line_number", signature="signature")
    + " UNION ALL " + _context_rows("dependency", "import_edges", "src", item="dst", item_type="'imports'")
    + " UNION ALL " + _context_rows("dependency", "(SELECT DISTINCT project_id, path, name FROM entities_all) x", item="path || ':' || name", item_type="'contains'")
    + " UNION ALL " + _context_rows("dependent", "import_edges", "dst", item="src", item_type="'imports'")
    + " UNION ALL " + _context_rows("import", "(SELECT project_id, path, specifier, count(*) AS c FROM imports_all GROUP BY 1, 2, 3) x", item="specifier", n="CAST(c AS BIGINT)"),
    ["risk", "entities_all", "imports_all", "import_edges", "edges_all", "last_commits"]))
def file_context(spark, sf):
    """Every file with its counts and the time of its last commit (J15), and its entities, dependencies, dependents and imports as rows."""
    g = build_graph(spark, sf)
    times = (FX.numstat(spark, sf).select(*P, "path", "commit_seq")
               .join(FX.commits(spark, sf).select(F.col("seq").alias("commit_seq"), "commit_time"), "commit_seq"))
    r = SN.attach_commit_time(g["risk"].withColumn("last_modified", F.lit(None).cast("timestamp_ntz")), times)
    r = r.withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss"))
    return G.file_context(r, g["entities"], g["edges"], g["imports"]).select(*_CONTEXT)
