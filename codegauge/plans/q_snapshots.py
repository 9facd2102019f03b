"""Snapshot, branch and refresh queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.operators import snapshots as SN
from codegauge.plans import shared_sql as S
from codegauge.plans import q_graph  # noqa: F401  (graph views)
from codegauge.plans.oracle_fixtures import register, with_views
from codegauge.plans.registry import query
from codegauge.session import scratch_dir
from codegauge.sources import fixtures as FX

_PART = "'src/p' || CAST(p_partkey - p_partkey % 5 AS STRING) || '.ts'"  # the five projects share their paths
register("snap_a", f"""SELECT p_partkey % 5 AS project_id, {_PART} AS path, md5(p_name) AS file_hash,
    p_size / 50.0 AS risk, 1700000000 + p_partkey AS mtime FROM part WHERE p_partkey % 7 <> 0""", [])
register("snap_b", f"""SELECT p_partkey % 5 AS project_id, {_PART} AS path,
    CASE WHEN p_size > 25 THEN md5(p_name || '#2') ELSE md5(p_name) END AS file_hash,
    p_size % 17 / 16.0 AS risk, 1700000000 + p_partkey + CASE WHEN p_size > 25 THEN 60 ELSE 0 END AS mtime
  FROM part WHERE p_partkey % 5 <> 0""", [])
register("ent_a", f"""SELECT p_partkey % 5 AS project_id, {_PART} AS path, 'f' || CAST(p_size % 10 AS STRING) AS name
    FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT p_partkey % 5, {_PART}, 'c' || CAST(p_partkey % 3 AS STRING) FROM part WHERE p_partkey % 7 <> 0""", [])
register("ent_b", f"""SELECT p_partkey % 5 AS project_id, {_PART} AS path, 'f' || CAST(p_size % 7 AS STRING) AS name
    FROM part WHERE p_partkey % 5 <> 0
  UNION ALL SELECT p_partkey % 5, {_PART}, 'c' || CAST((p_partkey + 1) % 3 AS STRING) FROM part WHERE p_partkey % 5 <> 0""", [])
register("commits", f"""SELECT o_custkey % 20 AS project_id, {S.COMMIT_BRANCH} AS branch,
    md5(CAST(o_orderkey AS STRING)) AS commit_hash, o_orderdate AS commit_time,
    'a' || CAST(o_custkey % 7 AS STRING) AS author, o_orderkey AS seq FROM orders""", [])
register("heads", """SELECT project_id, branch, commit_hash, commit_time, author, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id, branch ORDER BY commit_time DESC, seq DESC) AS r FROM commits) t
  WHERE r = 1""", ["commits"])
# stored snapshots: taken before the commits whose key is a multiple of 4; none for 'other' or projects % 3 = 0
register("stored_versions", """SELECT project_id, branch, branch || '#' || substr(commit_hash, 1, 8) AS version FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id, branch ORDER BY commit_time DESC, seq DESC) AS r
    FROM commits WHERE seq % 4 <> 0 AND branch <> 'other' AND project_id % 3 <> 0) t WHERE r = 1""", ["commits"])
register("numstat", """SELECT l_partkey % 5 AS project_id, 'src/p' || CAST(l_partkey - l_partkey % 5 AS STRING) || '.ts' AS path, l_orderkey AS commit_seq,
    CAST(l_linenumber AS BIGINT) AS line_no,
    CASE WHEN l_returnflag = 'R' THEN '-' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS added,
    CASE WHEN l_returnflag = 'R' THEN '-' ELSE CAST(l_linenumber AS STRING) END AS deleted FROM lineitem""", [])

_BTYPE = ("CASE WHEN branch IN ('main', 'master') THEN 'main' WHEN branch IN ('develop', 'dev') THEN 'develop' "
          "WHEN prefix(branch, 'feature/') THEN 'feature' WHEN prefix(branch, 'hotfix/') THEN 'hotfix' "
          "WHEN prefix(branch, 'release/') THEN 'release' ELSE 'other' END")
CUTOFF = "2001-07-02 00:00:00"


def _stored(spark, sf):
    c = FX.commits(spark, sf).filter((F.col("seq") % 4 != 0) & (F.col("branch") != "other")
                                     & (F.col("project_id") % 3 != 0))
    h = SN.branch_heads(c)
    return h.select("project_id", "branch", SN.version_stamp(F.col("branch"), F.col("commit_hash")).alias("version"))


@query("compare_snapshots", with_views("""SELECT project_id, path,
      CASE WHEN a.file_hash IS NULL THEN 'added' WHEN b.file_hash IS NULL THEN 'removed' ELSE 'common' END AS status,
      (a.file_hash IS NOT NULL AND b.file_hash IS NOT NULL AND a.file_hash <> b.file_hash) AS modified
    FROM snap_a a FULL OUTER JOIN snap_b b USING (project_id, path)""", ["snap_a", "snap_b"]))
def compare_snapshots(spark, sf):
    a, b, _, _ = FX.snapshots(spark, sf)
    return SN.compare_snapshots(a, b)


@query("snapshot_summary", with_views("""SELECT project_id,
      CAST(count(*) FILTER (WHERE a.path IS NULL) AS BIGINT) AS added,
      CAST(count(*) FILTER (WHERE b.path IS NULL) AS BIGINT) AS removed,
      CAST(count(*) FILTER (WHERE a.path IS NOT NULL AND b.path IS NOT NULL) AS BIGINT) AS common,
      CAST(count(*) FILTER (WHERE a.file_hash <> b.file_hash) AS BIGINT) AS modified,
      CAST(count(a.path) AS BIGINT) AS total_a, CAST(count(b.path) AS BIGINT) AS total_b
    FROM snap_a a FULL OUTER JOIN snap_b b USING (project_id, path) GROUP BY project_id""", ["snap_a", "snap_b"]))
def snapshot_summary(spark, sf):
    a, b, _, _ = FX.snapshots(spark, sf)
    return SN.snapshot_summary(SN.compare_snapshots(a, b))


_LEVELS = ["low", "medium", "high", "extreme"]


def _side_sql(s: str) -> str:
    level = "CASE WHEN risk < 0.3 THEN 'low' WHEN risk < 0.6 THEN 'medium' WHEN risk < 0.8 THEN 'high' ELSE 'extreme' END"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE {level} = '{x}') AS BIGINT) AS {x}_{s}" for x in _LEVELS)
    return f"""(SELECT * FROM (SELECT project_id, {counts} FROM snap_{s} GROUP BY 1) f FULL JOIN
      (SELECT project_id, CAST(count(*) AS BIGINT) AS entities_{s} FROM (SELECT DISTINCT project_id, path, name FROM ent_{s}) t GROUP BY 1) e
      USING (project_id)) {s}"""


@query("snapshot_distributions", with_views(
    "SELECT project_id, " + ", ".join(f"coalesce({x}_{s}, 0) AS {x}_{s}" for s in "ab" for x in [*_LEVELS, "entities"])
    + f" FROM {_side_sql('a')} FULL JOIN {_side_sql('b')} USING (project_id)", ["snap_a", "snap_b", "ent_a", "ent_b"]))
def snapshot_distributions(spark, sf):
    return SN.snapshot_distributions(*FX.snapshots(spark, sf))


@query("entity_diff", with_views("""SELECT project_id, path || ':' || name AS entity_key,
      CASE WHEN a.in_a IS NULL THEN 'added' ELSE 'removed' END AS change
    FROM (SELECT DISTINCT project_id, path, name, true AS in_a FROM ent_a) a
    FULL OUTER JOIN (SELECT DISTINCT project_id, path, name, true AS in_b FROM ent_b) b USING (project_id, path, name)
    WHERE a.in_a IS NULL OR b.in_b IS NULL""", ["ent_a", "ent_b"]))
def entity_diff(spark, sf):
    _, _, ea, eb = FX.snapshots(spark, sf)
    return SN.entity_diff(ea, eb)


@query("detect_changes", with_views("""SELECT project_id, path,
      CASE WHEN a.mtime IS NULL THEN 'new' WHEN b.mtime IS NULL THEN 'deleted' WHEN b.mtime > a.mtime THEN 'modified'
           ELSE 'unchanged' END AS change
    FROM snap_a a FULL OUTER JOIN snap_b b USING (project_id, path)""", ["snap_a", "snap_b"]))
def detect_changes(spark, sf):
    a, b, _, _ = FX.snapshots(spark, sf)
    return SN.detect_changes(a, b)


@query("list_branches", with_views(f"""SELECT h.project_id, h.branch, {_BTYPE} AS branch_type,
      substr(h.commit_hash, 1, 8) AS last_commit, h.commit_time AS last_commit_time, h.author,
      (h.branch = c.current_branch) AS is_current,
      CAST(row_number() OVER (PARTITION BY h.project_id ORDER BY h.commit_time DESC, h.branch) AS BIGINT) AS rank
    FROM heads h JOIN (SELECT project_id, branch AS current_branch FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY commit_time DESC, seq DESC) AS r FROM heads) t
        WHERE r = 1) c USING (project_id)""", ["heads"]))
def list_branches(spark, sf):
    return SN.list_branches(FX.commits(spark, sf))


@query("branch_types", with_views(f"""SELECT project_id, branch, {_BTYPE} AS branch_type,
      CASE {_BTYPE} WHEN 'feature' THEN 'develop' WHEN 'hotfix' THEN 'main' ELSE NULL END AS parent_branch,
      md5(CAST(project_id AS STRING) || '#' || branch) AS branch_id,
      branch || '#' || substr(commit_hash, 1, 8) AS version_stamp
    FROM heads""", ["heads"]))
def branch_types(spark, sf):
    h = SN.branch_heads(FX.commits(spark, sf))
    bt = SN.branch_type(F.col("branch"))
    return h.select("project_id", "branch", bt.alias("branch_type"), SN.parent_branch(bt).alias("parent_branch"),
                    SN.branch_id_of(F.col("project_id").cast("string"), F.col("branch")).alias("branch_id"),
                    SN.version_stamp(F.col("branch"), F.col("commit_hash")).alias("version_stamp"))


@query("refresh_plan", with_views("""SELECT h.project_id, h.branch, h.branch || '#' || substr(h.commit_hash, 1, 8) AS head_version,
      s.version AS stored_version,
      CASE WHEN s.version IS NULL THEN 'full' WHEN s.version = h.branch || '#' || substr(h.commit_hash, 1, 8)
           THEN 'up_to_date' ELSE 'incremental' END AS plan
    FROM heads h LEFT JOIN stored_versions s USING (project_id, branch)""", ["heads", "stored_versions"]))
def refresh_plan(spark, sf):
    heads = SN.branch_heads(FX.commits(spark, sf))
    return SN.refresh_plan(heads, _stored(spark, sf))


@query("upsert_branch_contexts", with_views(f"""SELECT project_id, branch, version FROM stored_versions
      WHERE branch NOT IN ('main', 'develop')
    UNION ALL SELECT project_id, branch, branch || '#' || substr(commit_hash, 1, 8) FROM heads
      WHERE branch IN ('main', 'develop')""", ["stored_versions", "heads"]))
def upsert_branch_contexts(spark, sf):
    heads = SN.branch_heads(FX.commits(spark, sf)).filter(F.col("branch").isin("main", "develop"))
    new = heads.select("project_id", "branch", SN.version_stamp(F.col("branch"), F.col("commit_hash")).alias("version"))
    return SN.upsert_branch_contexts(_stored(spark, sf), new)


def _last_access(spark, sf):
    return FX.commits(spark, sf).groupBy("project_id").agg(F.max("commit_time").alias("last_accessed"))


@query("expire_projects", with_views(f"""SELECT project_id, max(commit_time) AS last_accessed,
      max(commit_time) >= TIMESTAMP '{CUTOFF}' AS is_active FROM commits GROUP BY project_id""", ["commits"]))
def expire_projects(spark, sf):
    return SN.expire_projects(_last_access(spark, sf), F.lit(CUTOFF).cast("timestamp_ntz"))


@query("storage_stats", with_views(f"""
    SELECT 'active_projects' AS metric, CAST(count(*) FILTER (WHERE t >= TIMESTAMP '{CUTOFF}') AS BIGINT) AS value
      FROM (SELECT project_id, max(commit_time) AS t FROM commits GROUP BY 1) p
    UNION ALL SELECT 'total_projects', CAST(count(DISTINCT project_id) AS BIGINT) FROM commits
    UNION ALL SELECT 'total_files', CAST(count(*) AS BIGINT) FROM code_files
    UNION ALL SELECT 'total_entities', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT project_id, path, name FROM entities_all) e
    UNION ALL SELECT 'total_dependencies', CAST(count(*) AS BIGINT) FROM edges_all""",
    ["commits", "code_files", "entities_all", "edges_all"]))
def storage_stats(spark, sf):
    from codegauge.operators import graph as G
    from codegauge.plans.q_graph import build_graph
    g = build_graph(spark, sf)
    projects = SN.expire_projects(_last_access(spark, sf), F.lit(CUTOFF).cast("timestamp_ntz"))
    ents = G.last_entities(g["entities"])
    return SN.storage_stats(projects, g["files"], ents, g["edges"])


@query("change_summary", with_views("""SELECT project_id, path, a.file_hash <> b.file_hash AS content_changed,
      CASE WHEN a.file_hash <> b.file_hash THEN CAST(coalesce(n.lines, 0) AS BIGINT) END AS lines_changed,
      CASE WHEN a.file_hash <> b.file_hash THEN CASE WHEN coalesce(n.lines, 0) > 100 THEN 'high'
           WHEN coalesce(n.lines, 0) > 20 THEN 'medium' ELSE 'low' END END AS risk_level
    FROM snap_a a JOIN snap_b b USING (project_id, path)
    LEFT JOIN (SELECT project_id, path, (CASE WHEN added = '-' THEN 0 ELSE CAST(added AS BIGINT) END)
                           + (CASE WHEN deleted = '-' THEN 0 ELSE CAST(deleted AS BIGINT) END) AS lines
               FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY commit_seq DESC, line_no DESC) AS r
                     FROM numstat) t WHERE r = 1) n USING (project_id, path)""", ["snap_a", "snap_b", "numstat"]))
def change_summary(spark, sf):
    a, b, _, _ = FX.snapshots(spark, sf)
    return SN.change_summary(a, b, FX.numstat(spark, sf))


@query("snapshot_roundtrip", with_views("""
    SELECT project_id, 'main' AS branch, path, file_hash FROM snap_a WHERE project_id <> 1
    UNION ALL SELECT project_id, 'main', path, file_hash FROM snap_b WHERE project_id = 1
    UNION ALL SELECT project_id, 'dev', path, file_hash FROM snap_b""", ["snap_a", "snap_b"]))
def snapshot_roundtrip(spark, sf):
    """Write two branches, then replace one (project, branch) partition, read back."""
    a, b, _, _ = FX.snapshots(spark, sf)
    path = scratch_dir(spark, "snapshots")
    cols = ["path", "file_hash", "project_id", "branch"]
    SN.write_snapshot(a.withColumn("branch", F.lit("main")).select(*cols)
                      .unionByName(b.withColumn("branch", F.lit("dev")).select(*cols)), path)
    SN.write_snapshot(b.filter(F.col("project_id") == 1).withColumn("branch", F.lit("main")).select(*cols), path)
    return SN.read_snapshot(spark, path).select(F.col("project_id").cast("long"), "branch", "path", "file_hash")


@query("rebuild_edges", with_views("""SELECT project_id, src, dst,
      CASE WHEN occurrences % 2 = 0 THEN 'unknown' ELSE 'imports' END AS relation_type,
      CASE WHEN occurrences % 3 = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS strength FROM import_edges""", ["import_edges"]))
def rebuild_edges(spark, sf):
    """J6 over stored edges some of which lack their relation (even occurrences) or strength (multiples of 3)."""
    from codegauge.plans.q_graph import build_graph
    g = build_graph(spark, sf)
    n = F.col("occurrences")
    e = (g["edges"].withColumn("relation_type", F.when(n % 2 != 0, F.col("relation_type")))
                   .withColumn("strength", F.when(n % 3 != 0, F.col("strength"))))
    return SN.rebuild_edges(e, g["files"]).select("project_id", "src", "dst", "relation_type", "strength")


# ------------------------------------------------------------------ S10/S11: whole snapshots
PROJECT_ROOT = "/work/proj"
register("full_files", """SELECT f.project_id, f.path, r.size_bytes, r.line_count, md5(f.content) AS file_hash, r.risk_score, r.complexity_level
    FROM code_files f JOIN risk r USING (project_id, path) WHERE f.project_id <> 2 AND (f.project_id <> 1 OR prefix(f.path, 'lib/'))""", ["code_files", "risk"])
_CTX_COLS = ["framework", "main_language", "architecture", "build_system", "package_manager", "version"]


def _full_sql() -> str:
    from codegauge.plans.q_project import _CTX
    context = " || '|' || ".join([f"'{PROJECT_ROOT}/' || CAST(c.project_id AS STRING)", f"md5('{PROJECT_ROOT}/' || CAST(c.project_id AS STRING))",
                                  f"md5('{PROJECT_ROOT}/' || CAST(c.project_id AS STRING) || '#main')", *[f"c.{x}" for x in _CTX_COLS],
                                  *[f"CAST(coalesce(t.{x}, 0) AS STRING)" for x in ("n", "l", *_LEVELS)]])
    levels = ", ".join(f"count(*) FILTER (WHERE complexity_level = '{x}') AS {x}" for x in _LEVELS)
    return f"""SELECT c.project_id, 'context' AS kind, '' AS item, {context} AS detail FROM ({_CTX}) c
        LEFT JOIN (SELECT project_id, count(*) AS n, CAST(sum(line_count) AS BIGINT) AS l, {levels} FROM full_files GROUP BY 1) t USING (project_id)
      UNION ALL SELECT project_id, 'file', path, CAST(size_bytes AS STRING) || '|' || CAST(line_count AS STRING) || '|' || file_hash || '|' || CAST(CAST(round(risk_score * 10) AS BIGINT) AS STRING) FROM full_files
      UNION ALL SELECT project_id, 'entity', path || ':' || name, CAST(n AS STRING) FROM (SELECT project_id, path, name, max(line_number) AS n FROM entities_all GROUP BY 1, 2, 3) e
        WHERE (project_id, path) IN (SELECT project_id, path FROM full_files)
      UNION ALL SELECT project_id, 'edge', src || '>' || dst, CASE WHEN occurrences % 2 = 0 THEN 'unknown' ELSE 'imports' END || '|' || CASE WHEN occurrences % 3 = 0 THEN '10' ELSE '8' END FROM import_edges
        WHERE (project_id, src) IN (SELECT project_id, path FROM full_files) AND (project_id, dst) IN (SELECT project_id, path FROM full_files)"""


@query("snapshot_full", with_views(_full_sql(), ["listing", "full_files", "entities_all", "import_edges"]))
def snapshot_full(spark, sf):
    """S10/S11 (J5, J6, P33): context, files, entities and edges of all projects saved as one table, then project 1 saved again with only its
    ``lib`` files (but all entities and edges) and project 2 without any file, then everything loaded. Some edges are stored without
    their relation (even occurrences) or strength (multiples of 3)."""
    from codegauge.operators import graph as G
    from codegauge.operators import project as PR
    from codegauge.operators import snapshot_store as ST
    from codegauge.plans.q_graph import build_graph
    g = build_graph(spark, sf)
    branch = F.lit("main").alias("branch")
    risk = G.risk_scores(g["nodes"], g["entities"], g["imports"]).withColumn("branch", branch)
    entities = G.last_entities(g["entities"]).withColumn("branch", branch)
    n = F.col("occurrences")
    edges = (g["import_edges"].withColumn("relation_type", F.when(n % 2 != 0, F.col("relation_type")))
                              .withColumn("strength", F.when(n % 3 != 0, F.col("strength"))).withColumn("branch", branch))
    about = PR.project_context(FX.listing(spark, sf)).withColumn("branch", branch)
    root = F.concat(F.lit(PROJECT_ROOT + "/"), F.col("project_id").cast("string"))
    path = scratch_dir(spark, "snapshots")
    for part, files in ((about, risk), (about.filter("project_id IN (1, 2)"), risk.filter("project_id = 1 AND path LIKE 'lib/%'"))):
        ST.save(path, ST.context_rows(part, files, root), files, entities, edges)
    s = ST.load(spark, path, branch="main")
    text = lambda *cols: F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    ten = lambda c: F.round(F.col(c) * 10).cast("long")
    row = lambda kind, item, detail: s[kind].select("project_id", F.lit(kind).alias("kind"), item.alias("item"), detail.alias("detail"))
    out = row("context", F.lit(""), text(*["project_root", "project_key", "branch_key", *_CTX_COLS, "total_files", "total_lines", *_LEVELS]))
    out = out.unionByName(row("file", F.col("path"), text("size_bytes", "line_count", "file_hash", ten("risk_score"))))
    out = out.unionByName(row("entity", F.concat_ws(":", "path", "name"), F.col("line_number").cast("string")))
    return out.unionByName(row("edge", F.concat_ws(">", "src", "dst"), text("relation_type", ten("strength"))))
