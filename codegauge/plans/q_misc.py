"""Remaining operators of the inventory: tool-output ingestion, lookups, roll-ups, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.operators import findings as FD
from codegauge.operators import graph as G
from codegauge.operators import metrics as M
from codegauge.operators import scoring as SC
from codegauge.operators import snapshots as SN
from codegauge.operators.ordered import global_rank, top_k
from codegauge.plans import q_changes, q_graph, q_project, q_scoring, q_snapshots  # noqa: F401  (shared views)
from codegauge.plans.oracle_fixtures import register, with_views
from codegauge.plans.registry import query
from codegauge.plans.sqlgen import q, sql_filled
from codegauge.session import materialize, scratch_dir
from codegauge.sources import fixtures as FX
from codegauge.sources.tables import table
from codegauge.streaming import changes as CH

P = ["project_id"]

# ------------------------------------------------------------------ S8: exported `git log` lines
_GITLOG_LINE = ("CASE WHEN o_orderkey % 50 = 0 THEN md5(CAST(o_orderkey AS STRING)) || '|' || 'x' || '|a' "
                "WHEN o_orderkey % 50 = 1 THEN md5(CAST(o_orderkey AS STRING)) || '|' || CAST({epoch} AS STRING) "
                "ELSE md5(CAST(o_orderkey AS STRING)) || '|' || CAST({epoch} AS STRING) || '|a' "
                "|| CAST(o_custkey % 7 AS STRING) END")


def git_log_lines(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    epoch = "unix_seconds(CAST(o_orderdate AS TIMESTAMP))"
    return o.select((F.col("o_custkey") % 20).alias("project_id"), F.col("o_orderkey").alias("seq"),
                    F.expr(_GITLOG_LINE.format(epoch=epoch)).alias("line"))


register("git_log", f"""SELECT o_custkey % 20 AS project_id, o_orderkey AS seq,
    {_GITLOG_LINE.format(epoch="CAST(epoch(o_orderdate) AS BIGINT)")} AS line FROM orders""", [])


@query("ingest_git_log", with_views("""SELECT project_id, seq, split_part(line, '|', 1) AS commit_hash,
      make_timestamp(CAST(split_part(line, '|', 2) AS BIGINT) * 1000000) AS commit_time, split_part(line, '|', 3) AS author
    FROM git_log WHERE len(string_split(line, '|')) = 3 AND TRY_CAST(split_part(line, '|', 2) AS BIGINT) IS NOT NULL""",
    ["git_log"]))
def ingest_git_log(spark, sf):
    return SN.ingest_git_log(git_log_lines(spark, sf)).select(*P, "seq", "commit_hash", "commit_time", "author")


# ------------------------------------------------------------------ S9 + P36: `--numstat` lines
_NUMSTAT_LINE = "added || chr(9) || deleted || chr(9) || path"


@query("ingest_numstat", with_views(f"""SELECT path, commit_seq, line_no,
      CAST(CASE WHEN added = '-' THEN 0 ELSE CAST(added AS BIGINT) END
         + CASE WHEN deleted = '-' THEN 0 ELSE CAST(deleted AS BIGINT) END AS BIGINT) AS lines_changed,
      CASE WHEN (CASE WHEN added = '-' THEN 0 ELSE CAST(added AS BIGINT) END
               + CASE WHEN deleted = '-' THEN 0 ELSE CAST(deleted AS BIGINT) END) > 100 THEN 'high'
           WHEN (CASE WHEN added = '-' THEN 0 ELSE CAST(added AS BIGINT) END
               + CASE WHEN deleted = '-' THEN 0 ELSE CAST(deleted AS BIGINT) END) > 20 THEN 'medium'
           ELSE 'low' END AS risk_level
    FROM numstat""", ["numstat"]))
def ingest_numstat(spark, sf):
    n = FX.numstat(spark, sf).select("path", "commit_seq", "line_no", F.expr(_NUMSTAT_LINE).alias("line"))
    return SN.ingest_numstat(n).select("path", "commit_seq", "line_no", "lines_changed", "risk_level")


# ------------------------------------------------------------------ S14: JSON report
@query("json_report", with_views("""SELECT path, round(total_score, 6) AS total_score, grade,
      round(technical_debt_hours, 6) AS technical_debt_hours,
      array_to_string(recommendations, ' | ') AS recommendations, array_to_string(strengths, ' | ') AS strengths
    FROM grid_scores""", ["grid_scores"]))
def json_report(spark, sf):
    """File scores written as JSON lines to the shared folder, read back with an explicit
    schema (a round trip of the sink: the text itself differs between JSON writers)."""
    s = q_scoring.grid_scores(spark, sf)
    cols = ["path", "total_score", "grade", "technical_debt_hours", "recommendations", "strengths",
            *SC.CATEGORIES]
    out = scratch_dir(spark, "reports")
    s.select(F.to_json(F.struct(*cols)).alias("value")).write.text(out)
    schema = ("path STRING, total_score DOUBLE, grade STRING, technical_debt_hours DOUBLE, "
              "recommendations ARRAY<STRING>, strengths ARRAY<STRING>")
    back = spark.read.schema(schema).json(out)
    return back.select("path", F.round("total_score", 6).alias("total_score"), "grade",
                       F.round("technical_debt_hours", 6).alias("technical_debt_hours"),
                       F.array_join("recommendations", " | ").alias("recommendations"),
                       F.array_join("strengths", " | ").alias("strengths"))


# ------------------------------------------------------------------ F4, F5, F6: lookups
@query("core_entities", with_views("""SELECT project_id, CAST(rank AS BIGINT) AS rank, path, name, usage_count FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path, name) AS rank FROM (
        SELECT project_id, path, name, max(line_number) % 9 AS usage_count FROM entities_all GROUP BY 1, 2, 3) a
      WHERE usage_count > 5) t WHERE rank <= 20""", ["entities_all"]))
def core_entities(spark, sf, limit: int | None = 20):
    """entities used more than 5 times, first ``limit`` per project (None: all). The usage count is an input
    column; the fixture gives it as line_number % 9 of the last definition."""
    g = q_graph.build_graph(spark, sf)
    e = G.last_entities(g["entities"]).withColumn("usage_count", F.col("line_number") % 9)
    top = top_k(e.filter(F.col("usage_count") > 5), P, ["path", "name"], limit, out="rank")
    return top.select(*P, F.col("rank").cast("long"), "path", "name", "usage_count")


@query("active_projects", with_views(f"""SELECT project_id, last_accessed,
      CAST(row_number() OVER (ORDER BY last_accessed DESC, project_id) AS BIGINT) AS recency_rank
    FROM (SELECT project_id, max(commit_time) AS last_accessed FROM commits GROUP BY 1) t
    WHERE last_accessed >= TIMESTAMP '{q_snapshots.CUTOFF}'""", ["commits"]))
def active_projects(spark, sf):
    """active projects, newest access first."""
    act = SN.expire_projects(q_snapshots._last_access(spark, sf), F.lit(q_snapshots.CUTOFF).cast("timestamp_ntz"))
    act = act.filter("is_active")
    ranked = global_rank(act, [F.col("last_accessed").desc(), F.col("project_id")], out="recency_rank")
    return ranked.select(*P, "last_accessed", "recency_rank")


SCORE_FILE = "f42"


@query("score_file", with_views(f"""SELECT path, round(total_score, 6) AS total_score, grade,
      {', '.join(f'round({c}, 6) AS {c}' for c in SC.CATEGORIES)}, cyclomatic, cognitive, max_nesting,
      n_findings, CAST((CASE WHEN cyclomatic > 15 THEN 1 ELSE 0 END) + (CASE WHEN cognitive > 25 THEN 1 ELSE 0 END)
        + n_long + n_dup + (CASE WHEN maintainability_index < 30 THEN 1 ELSE 0 END) AS BIGINT) AS n_issues
    FROM grid_scores WHERE path = '{SCORE_FILE}'""", ["grid_scores"]))
def score_file(spark, sf):
    """one file's full diagnostics (scores, metrics, finding and issue counts).

    The fixture path is derived ('f' || key), so the lookup is stated on the source keys; the
    equality then reaches the Parquet scans as pushed filters instead of a full scan.
    """
    key = int(SCORE_FILE[1:])
    grid = q_scoring.grid_metrics(spark, sf, key_filter=F.col("o_orderkey") == key)
    finds = FX.findings(spark, sf, key_filter=(F.col("user_id") == key // 10) & (F.col("event_id") % 10 == key % 10))
    s = SC.score_files(grid, FD.finding_counts(finds, ["path"]), SC.derived_issue_penalty(grid, ["path"]), ["path"])
    iss = M.quality_issues(grid, None, None, ["path"])
    n_iss = iss.groupBy("path").agg(F.count(F.lit(1)).alias("__n"))
    s = s.join(n_iss, "path", "left").withColumn(
        "n_issues", (F.coalesce(F.col("__n"), F.lit(0)) + F.col("n_long") + F.col("n_dup")).cast("long"))
    return s.select("path", F.round("total_score", 6).alias("total_score"), "grade",
                    *[F.round(c, 6).alias(c) for c in SC.CATEGORIES], "cyclomatic", "cognitive", "max_nesting",
                    "n_findings", "n_issues")


@query("score_file_findings", with_views(f"""SELECT path, tool_name, line, col, severity, rule_id, message, category, suggestion, auto_fixable
    FROM findings WHERE path = '{SCORE_FILE}'""", ["findings"]))
def score_file_findings(spark, sf):
    """the finding rows of that file."""
    key = int(SCORE_FILE[1:])
    finds = FX.findings(spark, sf, key_filter=(F.col("user_id") == key // 10) & (F.col("event_id") % 10 == key % 10))
    return finds.select("path", *FD.FINDING_COLUMNS)


@query("score_file_issues", with_views(f"""SELECT path, kind, severity, message FROM (
      SELECT path, CAST(0 AS BIGINT) AS kind, 'warning' AS severity, {sql_filled(R.ISSUE_CYCLOMATIC, 'cyclomatic')} AS message
        FROM grid_scores WHERE cyclomatic > 15
      UNION ALL SELECT path, 1, 'warning', {sql_filled(R.ISSUE_COGNITIVE, 'cognitive')} FROM grid_scores WHERE cognitive > 25
      UNION ALL SELECT path, 4, 'error', {sql_filled(R.ISSUE_INDEX, "printf('%.1f', maintainability_index)")} FROM grid_scores WHERE maintainability_index < 30) t
    WHERE path = '{SCORE_FILE}'""", ["grid_scores"]))
def score_file_issues(spark, sf):
    """the issue rows of that file that its metrics give."""
    grid = q_scoring.grid_metrics(spark, sf, key_filter=F.col("o_orderkey") == int(SCORE_FILE[1:]))
    return M.quality_issues(grid, None, None, ["path"]).select("path", "kind", "severity", "message")


# ------------------------------------------------------------------ J5, J13, J15
@query("attach_entities", with_views("""SELECT project_id, path, name FROM ent_b e
    WHERE EXISTS (SELECT 1 FROM snap_a a WHERE a.project_id = e.project_id AND a.path = e.path)""", ["ent_b", "snap_a"]))
def attach_entities(spark, sf):
    a, _, _, eb = FX.snapshots(spark, sf)
    return SN.attach_entities(eb, a).select(*P, "path", "name")


@query("apply_deletes", with_views("""SELECT project_id, path FROM code_files f WHERE NOT EXISTS (
      SELECT 1 FROM latest_change l WHERE l.project_id = f.project_id AND l.path = f.path AND l.change_type = 'deleted')""",
    ["code_files", "latest_change"]))
def apply_deletes(spark, sf):
    latest = CH.latest_change_per_path(CH.monitored(CH.expand_moves(FX.file_changes(spark, sf))))
    files = FX.file_paths(spark, sf)
    return SN.apply_deletes(files, latest.filter(F.col("change_type") == "deleted"))


@query("attach_commit_time", with_views("""SELECT b.project_id, b.path,
      coalesce(t.last_commit, make_timestamp(b.mtime * 1000000)) AS last_modified
    FROM snap_b b LEFT JOIN (SELECT n.project_id, n.path, max(c.commit_time) AS last_commit FROM numstat n
                             JOIN commits c ON c.seq = n.commit_seq GROUP BY n.project_id, n.path) t USING (project_id, path)""",
    ["snap_b", "numstat", "commits"]))
def attach_commit_time(spark, sf):
    """last_modified := time of the file's last commit (numstat rows joined to commits)."""
    _, b, _, _ = FX.snapshots(spark, sf)
    files = b.select(*P, "path", F.timestamp_seconds("mtime").cast("timestamp_ntz").alias("last_modified"))
    fc = (FX.numstat(spark, sf).select(*P, "path", "commit_seq")
            .join(FX.commits(spark, sf).select(F.col("seq").alias("commit_seq"), "commit_time"), "commit_seq"))
    return SN.attach_commit_time(files, fc).select(*P, "path", "last_modified")


# ------------------------------------------------------------------ A13, A15, T4, T6
@query("affected_entities", with_views("""SELECT DISTINCT e.project_id, e.name FROM entities_all e
    JOIN latest_change l ON l.project_id = e.project_id AND l.path = e.path""", ["entities_all", "latest_change"]))
def affected_entities(spark, sf):
    """Distinct entity names defined in the files touched by the latest changes."""
    g = q_graph.build_graph(spark, sf)
    latest = CH.latest_change_per_path(CH.monitored(CH.expand_moves(FX.file_changes(spark, sf))))
    return (g["entities"].join(latest.select(*P, "path"), [*P, "path"], "left_semi")
                         .select(*P, "name").distinct())


@query("check_rollup", with_views(f"""SELECT project_id,
      CASE WHEN bool_or(status = 'failed') THEN 'error' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'healthy' END AS overall,
      CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS n_failed,
      CAST(count(*) FILTER (WHERE status = 'warning') AS BIGINT) AS n_warning
    FROM (SELECT p.project_id, 'snapshot' AS check_name,
                 CASE WHEN EXISTS (SELECT 1 FROM code_files f WHERE f.project_id = p.project_id) THEN 'ok' ELSE 'failed' END AS status
          FROM (SELECT DISTINCT project_id FROM commits) p
          UNION ALL
          SELECT project_id, 'freshness', CASE WHEN max(commit_time) >= TIMESTAMP '{q_snapshots.CUTOFF}' THEN 'ok' ELSE 'warning' END
          FROM commits GROUP BY project_id
          UNION ALL
          SELECT project_id, 'refresh', CASE WHEN bool_and(plan = 'up_to_date') THEN 'ok' ELSE 'warning' END
          FROM (SELECT h.project_id, CASE WHEN s.version = h.branch || '#' || substr(h.commit_hash, 1, 8) THEN 'up_to_date'
                                          ELSE 'stale' END AS plan
                FROM heads h LEFT JOIN stored_versions s USING (project_id, branch)) r GROUP BY project_id) c
    GROUP BY project_id""", ["code_files", "commits", "heads", "stored_versions"]))
def check_rollup(spark, sf):
    """A15 re-aimed at tables: snapshot present (failed if not), head time fresh, snapshots current."""
    commits = FX.commits(spark, sf)
    projects = commits.select(*P).distinct()
    have = FX.file_paths(spark, sf).select(*P).distinct().withColumn("__has", F.lit(True))
    snap = (projects.join(have, P, "left")
                    .select(*P, F.lit("snapshot").alias("check_name"),
                            F.when(F.col("__has"), "ok").otherwise("failed").alias("status")))
    fresh = (SN.expire_projects(q_snapshots._last_access(spark, sf), F.lit(q_snapshots.CUTOFF).cast("timestamp_ntz"))
               .select(*P, F.lit("freshness").alias("check_name"),
                       F.when(F.col("is_active"), "ok").otherwise("warning").alias("status")))
    plan = SN.refresh_plan(SN.branch_heads(commits), q_snapshots._stored(spark, sf))
    refresh = (plan.groupBy(*P).agg(F.bool_and(F.col("plan") == "up_to_date").alias("__ok"))
                   .select(*P, F.lit("refresh").alias("check_name"),
                           F.when(F.col("__ok"), "ok").otherwise("warning").alias("status")))
    return SN.check_rollup(snap.unionByName(fresh).unionByName(refresh))


# What a touched file holds now (a derived text: an import, one to three functions, a class).
_NOW = "'import m' || CAST(event_id % 40 AS STRING) || chr(10) || repeat('def g(a): return a' || chr(10), CAST(event_id % 3 + 1 AS INT)) || 'class K: pass'"


@query("rescore_changed", with_views("""SELECT project_id, CAST(count(*) AS BIGINT) AS files_after,
      CAST(count(*) FILTER (WHERE state = 'reanalysed') AS BIGINT) AS reanalysed, CAST(sum(lines) AS BIGINT) AS lines_after,
      CAST(sum(CASE WHEN state = 'reanalysed' THEN lines ELSE 0 END) AS BIGINT) AS lines_reanalysed,
      CAST(sum(entities) AS BIGINT) AS entities_after, CAST(sum(imports) AS BIGINT) AS imports_after, CAST(sum(bytes) AS BIGINT) AS bytes_after,
      CAST(count(*) FILTER (WHERE tenths > 7) AS BIGINT) AS high_risk_after
    FROM (SELECT project_id, 'kept' AS state, line_count AS lines, n_entities AS entities, n_imports AS imports, size_bytes AS bytes, risk_tenths AS tenths FROM risk r
            WHERE NOT EXISTS (SELECT 1 FROM latest_change l WHERE l.project_id = r.project_id AND l.path = r.path)
          UNION ALL SELECT project_id, 'reanalysed', event_id % 3 + 3, event_id % 3 + 2, 1, strlen(""" + _NOW + """), 0
            FROM latest_change WHERE change_type IN ('created', 'modified')) a
    GROUP BY project_id""", ["latest_change", "risk"]))
def rescore_changed(spark, sf):
    """T3 + T4: statistics after the changes. Kept files keep their row; touched ones are extracted and rated from their new text."""
    g = q_graph.build_graph(spark, sf)
    risk = G.risk_scores(g["nodes"], g["entities"], g["imports"])
    latest = CH.latest_change_per_path(CH.monitored(CH.expand_moves(FX.file_changes(spark, sf))))
    current = latest.select(*P, "path", F.expr(_NOW).alias("content"))
    d = CH.reanalyse(risk, latest, current)
    new = F.col("state") == "reanalysed"
    return d.groupBy(*P).agg(
        F.count(F.lit(1)).cast("long").alias("files_after"), F.count_if(new).cast("long").alias("reanalysed"),
        F.sum("line_count").cast("long").alias("lines_after"), F.sum(F.when(new, F.col("line_count")).otherwise(0)).cast("long").alias("lines_reanalysed"),
        F.sum("n_entities").cast("long").alias("entities_after"), F.sum("n_imports").cast("long").alias("imports_after"),
        F.sum("size_bytes").cast("long").alias("bytes_after"), F.count_if(F.col("risk_tenths") > 7).cast("long").alias("high_risk_after"))


@query("update_status", with_views("""SELECT c.project_id, c.last_change, c.n_changes, c.n_paths,
      CAST(coalesce(f.n, 0) AS BIGINT) AS n_files, c.n_changes > 0 AS monitoring
    FROM (SELECT project_id, max(ts) AS last_change, CAST(count(*) AS BIGINT) AS n_changes,
                 CAST(count(DISTINCT path) AS BIGINT) AS n_paths FROM monitored GROUP BY 1) c
    LEFT JOIN (SELECT project_id, count(*) AS n FROM code_files GROUP BY 1) f USING (project_id)""",
    ["monitored", "code_files"]))
def update_status(spark, sf):
    """Monitoring status per project: last change, changes seen, distinct paths, files."""
    ch = CH.monitored(CH.expand_moves(FX.file_changes(spark, sf)))
    st = ch.groupBy(*P).agg(F.max("ts").alias("last_change"), F.count(F.lit(1)).cast("long").alias("n_changes"),
                            F.countDistinct("path").cast("long").alias("n_paths"))
    nf = FX.file_paths(spark, sf).groupBy(*P).agg(F.count(F.lit(1)).alias("__n"))
    return (st.join(nf, P, "left").select(*P, "last_change", "n_changes", "n_paths",
                                          F.coalesce("__n", F.lit(0)).cast("long").alias("n_files"),
                                          (F.col("n_changes") > 0).alias("monitoring")))


# ------------------------------------------------------------------ K3, P16, W7, E6, P38, P35
@query("limit_files", with_views("""SELECT project_id, CAST(rank AS BIGINT) AS rank, path FROM (
      SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY path) AS rank FROM code_files) t
    WHERE rank <= 50""", ["code_files"]))
def limit_files(spark, sf, limit: int | None = 50):
    """K3: the first ``limit`` files of every project in pinned path order (the scoring cap; None: all)."""
    top = top_k(FX.file_paths(spark, sf), P, ["path"], limit, out="rank")
    return top.select(*P, F.col("rank").cast("long"), "path")


@query("estimate_maintainability", with_views("""SELECT path, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE,
      100 - cyclomatic * 2 - cognitive * 1.5::DOUBLE - greatest(0.0::DOUBLE, (lines_of_code - 100) * 0.1::DOUBLE)
      - (n_long * 5 + n_dup * 8))), 6) AS estimated_index FROM metrics_grid""", ["metrics_grid"]))
def estimate_maintainability(spark, sf):
    """The fallback index used when the analyser's index is absent."""
    g = FX.metrics_grid(spark, sf)
    c = F.col
    est = SC.estimate_maintainability(c("lines_of_code"), c("cyclomatic"), c("cognitive"), c("n_long"), c("n_dup"))
    return g.select("path", F.round(est, 6).alias("estimated_index"))


@query("last_entities", with_views("""SELECT project_id, path || ':' || name AS entity_key,
      arg_max(entity_type, line_number) AS entity_type, max(line_number) AS line_number
    FROM entities_all GROUP BY project_id, path, name""", ["entities_all"]))
def last_entities(spark, sf):
    """One row per ``path:name``; the last definition in extraction order wins."""
    g = q_graph.build_graph(spark, sf)
    return G.last_entities(g["entities"]).select(*P, "entity_key", "entity_type", "line_number")


_DIST = ", ".join(f"CAST(count(*) FILTER (WHERE complexity_level = '{b}') AS BIGINT) AS {b}"
                  for b in ["low", "medium", "high", "extreme"])


@query("summarize_project", with_views(f"""SELECT s.project_id, s.total_files, s.total_lines,
      CAST(coalesce(x.c, 0) AS BIGINT) AS total_entities, CAST(coalesce(y.c, 0) AS BIGINT) AS dependency_relationships,
      s.high_risk_files, s.low, s.medium, s.high, s.extreme, t.top_files
    FROM (SELECT project_id, CAST(count(*) AS BIGINT) AS total_files, CAST(sum(line_count) AS BIGINT) AS total_lines,
                 CAST(count(*) FILTER (WHERE risk_tenths > 7) AS BIGINT) AS high_risk_files, {{_DIST}}
          FROM risk GROUP BY 1) s
    LEFT JOIN (SELECT project_id, count(*) AS c FROM (SELECT DISTINCT project_id, path, name FROM entities_all) e
               GROUP BY 1) x USING (project_id)
    LEFT JOIN (SELECT project_id, count(*) AS c FROM edges_all GROUP BY 1) y USING (project_id)
    JOIN (SELECT project_id, string_agg(path, ',' ORDER BY rank) AS top_files FROM (
            SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY risk_tenths DESC, path) AS rank
            FROM risk) q WHERE rank <= 10 GROUP BY 1) t USING (project_id)""".replace("{_DIST}", _DIST),
    ["risk", "entities_all", "edges_all"]))
def summarize_project(spark, sf):
    """Statistics, complexity histogram and the ten riskiest files (a bounded list) per project."""
    g = q_graph.build_graph(spark, sf)
    return _summary(g, g["risk"])


def _summary(g, risk):
    stats = G.project_statistics(risk, g["entities"], g["edges"], g["import_edges"])
    dist = G.complexity_distribution(risk)
    top = G.most_complex_files(risk)
    top_list = top.groupBy(*P).agg(  # at most 10 rows per project
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]), ",")
         .alias("top_files"))
    return (stats.join(dist, P).join(top_list, P)
                 .select(*P, "total_files", "total_lines", "total_entities", "dependency_relationships",
                         "high_risk_files", "low", "medium", "high", "extreme", "top_files"))


@query("project_overview", with_views("""SELECT p.project_id, p.total_files, m.main_language, b.n_branches, b.current_branch,
      coalesce(c.n_changes, 0) AS n_changes, c.last_change, h.high_files, k.core_entities
    FROM (SELECT project_id, CAST(count(*) AS BIGINT) AS total_files FROM risk GROUP BY 1) p
    LEFT JOIN (SELECT project_id, language AS main_language FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, language) AS r
               FROM (SELECT project_id, CASE WHEN suffix(path, '.py') THEN 'python' WHEN suffix(path, '.js') THEN 'javascript'
                       WHEN suffix(path, '.ts') THEN 'typescript' ELSE 'java' END AS language, count(*) AS n FROM code_files GROUP BY 1, 2) t) u WHERE r = 1) m USING (project_id)
    LEFT JOIN (SELECT project_id, CAST(count(*) AS BIGINT) AS n_branches, arg_max(branch, (commit_time, seq)) AS current_branch FROM heads GROUP BY 1) b USING (project_id)
    LEFT JOIN (SELECT project_id, CAST(count(*) AS BIGINT) AS n_changes, max(ts) AS last_change FROM monitored GROUP BY 1) c USING (project_id)
    LEFT JOIN (SELECT project_id, string_agg(path, ',' ORDER BY path) AS high_files FROM (
               SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY path) AS r FROM risk WHERE risk_tenths > 7) t WHERE r <= 10 GROUP BY 1) h USING (project_id)
    LEFT JOIN (SELECT project_id, string_agg(path || ':' || name, ',' ORDER BY path, name) AS core_entities FROM (
               SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path, name) AS r FROM (
                 SELECT project_id, path, name, max(line_number) % 9 AS usage_count FROM entities_all GROUP BY 1, 2, 3) a WHERE usage_count > 5) t WHERE r <= 20 GROUP BY 1) k USING (project_id)""",
    ["risk", "code_files", "heads", "monitored", "entities_all"]))
def project_overview(spark, sf):
    """E6 beside the statistics: main language, branches, update status, high-risk files (F3) and core entities (F4) per project.
    The lists hold at most 10 and 20 items."""
    g = q_graph.build_graph(spark, sf)
    return _overview(spark, sf, g, g["risk"])


def _overview(spark, sf, g, risk):
    from codegauge.operators import project as PR
    count = F.count(F.lit(1)).cast("long")

    def listed(rows, item, out):
        ordered = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))
        return rows.groupBy(*P).agg(F.array_join(F.transform(ordered, lambda x: x["item"]), ",").alias(out))

    heads = SN.branch_heads(FX.commits(spark, sf))
    branches = heads.groupBy(*P).agg(count.alias("n_branches"), F.max_by("branch", F.struct("commit_time", "seq")).alias("current_branch"))
    seen = CH.monitored(CH.expand_moves(FX.file_changes(spark, sf))).groupBy(*P).agg(count.alias("n_changes"), F.max("ts").alias("last_change"))
    used = G.last_entities(g["entities"]).filter(F.col("line_number") % 9 > 5)
    core = listed(top_k(used, P, ["path", "name"], 20), F.concat_ws(":", "path", "name"), "core_entities")
    high = listed(G.high_risk_files(risk), F.col("path"), "high_files")
    out = risk.groupBy(*P).agg(count.alias("total_files"))
    for d in (PR.main_language(g["files"].select(*P, "path")).select(*P, "main_language"), branches, seen, high, core):
        out = out.join(d, P, "left")
    return out.select(*P, "total_files", "main_language", "n_branches", "current_branch", F.coalesce("n_changes", F.lit(0)).cast("long").alias("n_changes"),
                      "last_change", "high_files", "core_entities")


ROOT = "/work/proj"


@query("absolutise_path", with_views(f"""SELECT event_id, CASE WHEN prefix(p, '/') THEN p
      ELSE '{ROOT}' || CAST(project_id AS STRING) || '/' || p END AS abs_path
    FROM (SELECT event_id, project_id, CASE WHEN event_id % 3 = 0 THEN '/' || path ELSE path END AS p FROM file_changes) t""",
    ["file_changes"]))
def absolutise_path(spark, sf):
    """Join the project root to relative paths; absolute paths stay."""
    c = FX.file_changes(spark, sf).withColumn(
        "p", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/"), "path")).otherwise(F.col("path")))
    root = F.concat(F.lit(ROOT), F.col("project_id").cast("string"))
    return c.select("event_id", F.when(F.col("p").startswith("/"), F.col("p"))
                                 .otherwise(F.concat_ws("/", root, F.col("p"))).alias("abs_path"))


# Our own advice text per impact level.
IMPACT_ADVICE = {
    "extreme": ["Split the change into stages", "Run the full test suite", "Ship behind a feature flag"],
    "high": ["Add integration tests for the dependents", "Tell the owners of the dependent files"],
    "medium": ["Run regression tests on the dependents"],
    "low": ["Small blast radius"],
}


@query("impact_advice", with_views("""SELECT project_id, target, risk_level,
      CASE risk_level WHEN 'extreme' THEN '""" + " | ".join(IMPACT_ADVICE["extreme"]) + """'
                      WHEN 'high' THEN '""" + " | ".join(IMPACT_ADVICE["high"]) + """'
                      WHEN 'medium' THEN '""" + " | ".join(IMPACT_ADVICE["medium"]) + """'
                      ELSE '""" + " | ".join(IMPACT_ADVICE["low"]) + """' END AS advice
    FROM (SELECT f.project_id, f.path AS target,
            CASE WHEN n > 20 THEN 'extreme' WHEN n > 10 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END AS risk_level
          FROM code_files f JOIN (
            SELECT f2.project_id, f2.path,
              (SELECT count(*) FROM edges_all e WHERE e.project_id = f2.project_id AND e.dst = f2.path)
              + (SELECT count(DISTINCT e2.src) FROM edges_all e1 JOIN edges_all e2 ON e2.project_id = e1.project_id AND e2.dst = e1.src
                 WHERE e1.project_id = f2.project_id AND e1.dst = f2.path) AS n
            FROM code_files f2) c ON c.project_id = f.project_id AND c.path = f.path) t""",
    ["code_files", "edges_all"]))
def impact_advice(spark, sf):
    """Advice strings for each file's impact level (one literal list per level)."""
    g = q_graph.build_graph(spark, sf)
    ci = G.change_impact(g["files"], g["import_edges"])
    lvl = F.col("risk_level")
    advice = (F.when(lvl == "extreme", " | ".join(IMPACT_ADVICE["extreme"]))
               .when(lvl == "high", " | ".join(IMPACT_ADVICE["high"]))
               .when(lvl == "medium", " | ".join(IMPACT_ADVICE["medium"])).otherwise(" | ".join(IMPACT_ADVICE["low"])))
    return ci.select(*P, "target", "risk_level", advice.alias("advice"))


# ------------------------------------------------------------------ P1, P2, P3, P10 as their own queries
def _lang_case(table: dict, x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " ELSE NULL END"


_SFX = "regexp_extract(path, '[^/]([.][^./]*)$', 1)"


@query("language_maps", with_views(f"""SELECT project_id, path, {_lang_case(R.GRAPH_LANGUAGES, _SFX)} AS graph_language,
      {_lang_case(R.METRIC_LANGUAGES, 'lower(' + _SFX + ')')} AS metric_language
    FROM listing""", ["listing"]))
def language_maps(spark, sf):
    """The graph map (case-sensitive suffix, has .h/.hpp) and the metric map (lower-cased,
    has .cc/.cxx) over every listed path; null when unsupported."""
    lst = FX.listing(spark, sf)
    return lst.select(*P, "path", G.graph_language("path").alias("graph_language"),
                      G.metric_language("path").alias("metric_language"))


@query("file_nodes", with_views("""SELECT f.project_id, f.path, f.size_bytes, n.line_count, md5(f.content) AS file_hash
    FROM code_files f JOIN nodes n USING (project_id, path)""", ["code_files", "nodes"]))
def file_nodes(spark, sf):
    """File rows: size, non-blank line count (P3) and md5 of the decoded text (P10)."""
    return G.file_nodes(FX.code_files(spark, sf)).select(*P, "path", "size_bytes", "line_count", "file_hash")


# ------------------------------------------------------------------ J9 as rows, E6 in one report row
@query("file_context_rows", with_views("""SELECT r.project_id, r.path, 'file' AS kind, '' AS item,
      CASE WHEN suffix(r.path, '.py') THEN 'python' WHEN suffix(r.path, '.js') THEN 'javascript' WHEN suffix(r.path, '.ts') THEN 'typescript' ELSE 'java' END
        || '|' || CAST(r.size_bytes AS STRING) || '|' || CAST(r.line_count AS STRING) || '|' || CAST(CAST(round(r.risk_score * 10) AS BIGINT) AS STRING) || '|'
        || coalesce(strftime(t.last_commit, '%Y-%m-%d %H:%M:%S'), '') AS detail
    FROM risk r LEFT JOIN (SELECT n.project_id, n.path, max(c.commit_time) AS last_commit FROM numstat n JOIN commits c ON c.seq = n.commit_seq GROUP BY 1, 2) t USING (project_id, path)
    UNION ALL SELECT project_id, path, 'entity', name, arg_max(entity_type, line_number) || '|' || CAST(max(line_number) AS STRING) FROM entities_all GROUP BY project_id, path, name
    UNION ALL SELECT project_id, src, 'dependency', dst, 'imports' FROM import_edges
    UNION ALL SELECT project_id, dst, 'dependent', src, 'imports' FROM import_edges
    UNION ALL SELECT project_id, path, 'import', specifier, CAST(count(*) AS STRING) FROM imports_all GROUP BY project_id, path, specifier""",
    ["risk", "numstat", "commits", "entities_all", "import_edges", "imports_all"]))
def file_context_rows(spark, sf):
    """The context of every file as rows: the file itself (with the time of its last commit, J15), its entities, dependencies, dependents and imports,
    read from tables bucketed by file without a shuffle."""
    from codegauge.operators.context_store import ContextStore
    g = q_graph.build_graph(spark, sf)
    risk = G.risk_scores(g["nodes"], g["entities"], g["imports"]).withColumn("last_modified", F.lit(None).cast("timestamp_ntz"))
    times = (FX.numstat(spark, sf).select(*P, "path", "commit_seq")
               .join(FX.commits(spark, sf).select(F.col("seq").alias("commit_seq"), "commit_time"), "commit_seq"))
    files = SN.attach_commit_time(risk, times)
    return ContextStore(spark).save(files, G.last_entities(g["entities"]), g["import_edges"], g["imports"]).rows()


def _report_sql() -> str:
    from codegauge.plans.registry import ORACLE
    return f"""SELECT a.*, b.n_branches, b.current_branch, b.n_changes, b.last_change, b.high_files, b.core_entities,
      c.framework, c.architecture, c.build_system, c.package_manager, c.version
    FROM ({ORACLE['summarize_project']}) a JOIN ({ORACLE['project_overview']}) b USING (project_id) LEFT JOIN ({ORACLE['project_context']}) c USING (project_id)"""


@query("project_report", _report_sql())
def project_report(spark, sf):
    """E6 in one row per project: statistics, histogram and riskiest files, branches, update status, high-risk files and core entities, and the context."""
    from codegauge.plans.q_project import project_context
    about = project_context(spark, sf).drop("main_language")
    g = q_graph.build_graph(spark, sf)  # extracted and rated once for both halves
    return _summary(g, g["risk"]).join(_overview(spark, sf, g, g["risk"]).drop("total_files", "main_language"), P).join(about, P, "left")
