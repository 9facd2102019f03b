"""Snapshots, branches and refresh planning.

Snapshots are tables partitioned by (project_id, branch); comparing two of them is a full
outer join on the file key, and a refresh plan is a left join of branch heads to stored
versions. Latest-per-key rules use ``max_by`` (hash aggregate with a partial step) rather
than a window over the key, so a key with very many rows is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.functions.text import py_strip


# ------------------------------------------------------------------ branch naming
def branch_type(b: Column) -> Column:
    out = F.when(b.isin(*R.MAIN_BRANCHES), "main").when(b.isin(*R.DEVELOP_BRANCHES), "develop")
    for prefix, kind in R.BRANCH_PREFIXES:
        out = out.when(b.startswith(prefix), kind)
    return out.otherwise("other")


def parent_branch(kind: Column) -> Column:
    return F.when(kind == "feature", "develop").when(kind == "hotfix", "main")


def project_id_of(root: Column) -> Column:
    """md5 of the project root."""
    return F.md5(root)


def branch_id_of(root: Column, branch: Column) -> Column:
    """md5 of ``root#branch``."""
    return F.md5(F.concat(root, F.lit("#"), branch))


def version_stamp(branch: Column, commit_hash: Column) -> Column:
    """``branch#hash8``."""
    return F.concat(branch, F.lit("#"), F.substring(commit_hash, 1, 8))


# ------------------------------------------------------------------ heads and plans
def branch_heads(commits: DataFrame, keys=("project_id", "branch")) -> DataFrame:
    """Latest commit per (project, branch), by (commit_time, seq)."""
    k = list(keys)
    last = commits.groupBy(*k).agg(
        F.max_by(F.struct("commit_hash", "commit_time", "author", "seq"), F.struct("commit_time", "seq")).alias("h"))
    return last.select(*k, "h.*")


def list_branches(commits: DataFrame) -> DataFrame:
    """K2: branches with type, short hash, last commit time, author and the current-branch flag, ranked.

    The current branch of a project is the branch of its latest commit overall. ``rank`` lists a project's branches by the
    time of their last commit, newest first (ties by name).
    """
    heads = branch_heads(commits)
    cur = heads.groupBy("project_id").agg(
        F.max_by("branch", F.struct("commit_time", "seq")).alias("current_branch"))
    newest = Window.partitionBy("project_id").orderBy(F.desc("last_commit_time"), "branch")
    return (heads.join(cur, "project_id")
                 .select("project_id", "branch", branch_type(F.col("branch")).alias("branch_type"),
                         F.substring("commit_hash", 1, 8).alias("last_commit"),
                         F.col("commit_time").alias("last_commit_time"), "author",
                         (F.col("branch") == F.col("current_branch")).alias("is_current"))
                 .withColumn("rank", F.row_number().over(newest).cast("long")))


def refresh_plan(heads: DataFrame, stored: DataFrame) -> DataFrame:
    """``up_to_date`` when the stored version is the head's stamp, ``incremental`` when a
    stale snapshot exists, ``full`` when none does."""
    h = heads.select("project_id", "branch", version_stamp(F.col("branch"), F.col("commit_hash")).alias("head_version"))
    d = h.join(stored.select("project_id", "branch", F.col("version").alias("stored_version")),
               ["project_id", "branch"], "left")
    plan = (F.when(F.col("stored_version").isNull(), "full")
             .when(F.col("stored_version") == F.col("head_version"), "up_to_date").otherwise("incremental"))
    return d.withColumn("plan", plan)


def upsert_branch_contexts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the (project, branch) entries present in ``new``, keep the others.

    Of several new rows of one key the one with the greatest values (column by column) wins, so the result is fixed."""
    o = old.withColumn("__v", F.lit(0))
    n = new.withColumn("__v", F.lit(1))
    cols = [c for c in old.columns if c not in ("project_id", "branch")]
    u = o.unionByName(n)
    last = u.groupBy("project_id", "branch").agg(F.max_by(F.struct(*cols), F.struct("__v", *cols)).alias("c"))
    return last.select("project_id", "branch", "c.*")


def expire_projects(last_access: DataFrame, cutoff: Column) -> DataFrame:
    """A project is active when it was accessed at or after the cutoff."""
    return last_access.withColumn("is_active", F.col("last_accessed") >= cutoff)


# ------------------------------------------------------------------ snapshot comparison
def compare_snapshots(a: DataFrame, b: DataFrame, keys=("project_id", "path")) -> DataFrame:
    """One row per file of either snapshot: added / removed / common, plus ``modified``
    (common and the hash differs) — the count of common files alone is what a plain diff reports."""
    k = list(keys)
    d = a.select(*k, F.col("file_hash").alias("hash_a")).join(
        b.select(*k, F.col("file_hash").alias("hash_b")), k, "full_outer")
    status = (F.when(F.col("hash_a").isNull(), "added").when(F.col("hash_b").isNull(), "removed").otherwise("common"))
    return d.select(*k, status.alias("status"),
                    (F.col("hash_a").isNotNull() & F.col("hash_b").isNotNull()
                     & ~F.col("hash_a").eqNullSafe(F.col("hash_b"))).alias("modified"))


def snapshot_summary(cmp: DataFrame, keys=("project_id",)) -> DataFrame:
    s = F.col("status")
    return cmp.groupBy(*keys).agg(
        F.count_if(s == "added").cast("long").alias("added"),
        F.count_if(s == "removed").cast("long").alias("removed"),
        F.count_if(s == "common").cast("long").alias("common"),
        F.count_if(F.col("modified")).cast("long").alias("modified"),
        F.count_if(s != "added").cast("long").alias("total_a"),
        F.count_if(s != "removed").cast("long").alias("total_b"))


def snapshot_distributions(a: DataFrame, b: DataFrame, ea: DataFrame, eb: DataFrame, keys=("project_id",)) -> DataFrame:
    """Files by complexity (of ``risk``), and distinct entities, of both snapshots side by side."""
    risk, levels = F.col("risk"), ("low", "medium", "high", "extreme")
    level = F.when(risk < 0.3, "low").when(risk < 0.6, "medium").when(risk < 0.8, "high").otherwise("extreme")

    def one(files, entities, s):
        d = files.withColumn("__l", level).groupBy(*keys).agg(*[F.count_if(F.col("__l") == x).cast("long").alias(f"{x}_{s}") for x in levels])
        n = entities.select(*keys, "path", "name").distinct().groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias(f"entities_{s}"))
        return d.join(n, list(keys), "full_outer")
    out = one(a, ea, "a").join(one(b, eb, "b"), list(keys), "full_outer")
    return out.fillna(0, [c for c in out.columns if c not in keys])


def entity_diff(ea: DataFrame, eb: DataFrame, keys=("project_id",)) -> DataFrame:
    """Entity keys ``path:name`` added in B / removed from A."""
    k = [*keys, "path", "name"]
    a = ea.select(*k).distinct().withColumn("in_a", F.lit(True))
    b = eb.select(*k).distinct().withColumn("in_b", F.lit(True))
    d = a.join(b, k, "full_outer").filter(F.col("in_a").isNull() | F.col("in_b").isNull())
    return d.select(*keys, F.concat_ws(":", "path", "name").alias("entity_key"),
                    F.when(F.col("in_a").isNull(), "added").otherwise("removed").alias("change"))


def detect_changes(stored: DataFrame, current: DataFrame, keys=("project_id", "path")) -> DataFrame:
    """J12 extended: new, deleted, modified (current mtime after the stored one), unchanged."""
    k = list(keys)
    d = stored.select(*k, F.col("mtime").alias("stored_mtime")).join(
        current.select(*k, F.col("mtime").alias("current_mtime")), k, "full_outer")
    change = (F.when(F.col("stored_mtime").isNull(), "new").when(F.col("current_mtime").isNull(), "deleted")
               .when(F.col("current_mtime") > F.col("stored_mtime"), "modified").otherwise("unchanged"))
    return d.select(*k, change.alias("change"))


def change_summary(old: DataFrame, new: DataFrame, numstat: DataFrame, keys=("project_id", "path")) -> DataFrame:
    """Per file present in both: content changed?, lines changed (latest numstat row) and risk.

    ``numstat`` has text columns added/deleted ('-' counts as 0) and an order (commit_seq, line_no);
    the latest row per file (``keys``: a path alone would mix projects) is picked with ``max_by``.
    """
    k = list(keys)
    n = numstat.groupBy(*k).agg(
        F.max_by(F.struct("added", "deleted"), F.struct("commit_seq", "line_no")).alias("ns"))
    to_int = lambda c: F.when(c == "-", F.lit(0)).otherwise(c.try_cast("long"))
    n = n.select(*k, (to_int(F.col("ns.added")) + to_int(F.col("ns.deleted"))).alias("numstat_lines"))
    d = (old.select(*k, F.col("file_hash").alias("old_hash"))
            .join(new.select(*k, F.col("file_hash").alias("new_hash")), k)
            .join(n, k, "left"))
    changed = ~F.col("old_hash").eqNullSafe(F.col("new_hash"))
    lines = F.when(changed, F.coalesce(F.col("numstat_lines"), F.lit(0)))
    risk = F.when(changed, F.when(lines > 100, "high").when(lines > 20, "medium").otherwise("low"))
    return d.select(*k, changed.alias("content_changed"), lines.cast("long").alias("lines_changed"),
                    risk.alias("risk_level"))


def attach_commit_time(files: DataFrame, file_commits: DataFrame, keys=("project_id", "path")) -> DataFrame:
    """last_modified := time of the file's last commit when one is known."""
    last = file_commits.groupBy(*keys).agg(F.max("commit_time").alias("__t"))
    return (files.join(last, list(keys), "left")
                 .withColumn("last_modified", F.coalesce(F.col("__t"), F.col("last_modified"))).drop("__t"))


# ------------------------------------------------------------------ persistence
def write_snapshot(df: DataFrame, path: str, partition_cols=("project_id", "branch"), replaced: list[tuple] = ()) -> None:
    """Replace only the partitions present in ``df`` (dynamic partition overwrite).

    ``replaced`` names the partitions that this snapshot stands for (values of ``partition_cols``); one of them without
    rows in ``df``, as a project whose last file is gone, is emptied too (found by one anti join, before anything is written).
    """
    spark = df.sparkSession
    gone = []
    if replaced:
        named = spark.createDataFrame([tuple(v) for v in replaced], df.select(*partition_cols).schema)
        gone = named.join(df.select(*partition_cols).distinct(), list(partition_cols), "left_anti").collect()  # some of the names given
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols).parquet(path))
    for values in gone:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([path, *[f"{c}={values[c]}" for c in partition_cols]]))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_snapshot(spark, path: str, project_id=None, branch=None) -> DataFrame:
    """Read a snapshot table; project/branch filters prune partitions at the scan."""
    df = spark.read.parquet(path)
    if project_id is not None:
        df = df.filter(F.col("project_id") == project_id)
    if branch is not None:
        df = df.filter(F.col("branch") == branch)
    return df


def attach_entities(entities: DataFrame, files: DataFrame, keys=("project_id", "path")) -> DataFrame:
    """An entity is kept only when its file row exists."""
    return entities.join(files.select(*keys).distinct(), list(keys), "left_semi")


def rebuild_edges(edges: DataFrame, files: DataFrame, project="project_id") -> DataFrame:
    """Keep edges whose two endpoints are files; default relation 'unknown', strength 1.0."""
    f = files.select(project, "path")
    e = (edges.join(f.withColumnRenamed("path", "src"), [project, "src"], "left_semi")
              .join(f.withColumnRenamed("path", "dst"), [project, "dst"], "left_semi"))
    return (e.withColumn("relation_type", F.coalesce(F.col("relation_type"), F.lit("unknown")))
             .withColumn("strength", F.coalesce(F.col("strength"), F.lit(1.0))))


def apply_deletes(files: DataFrame, deleted: DataFrame, keys=("project_id", "path")) -> DataFrame:
    """Drop deleted files (the same anti join removes their entities and edges)."""
    return files.join(deleted.select(*keys), list(keys), "left_anti")


def storage_stats(projects: DataFrame, files: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts as (metric, value) rows — one small aggregate per table, no cross join."""
    def one(df, name, cond=None):
        c = F.count(F.lit(1)) if cond is None else F.count_if(cond)
        return df.agg(c.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [one(projects, "active_projects", F.col("is_active")), one(projects, "total_projects"),
             one(files, "total_files"), one(entities, "total_entities"), one(edges, "total_dependencies")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ exported tool output
def ingest_git_log(lines: DataFrame, text: str = "line") -> DataFrame:
    """``hash|epoch|author`` lines → commit columns; any other shape, or a non-integer time,
    gives no row. Time is UTC."""
    parts = F.split(py_strip(text), r"\|")
    epoch = parts[1].try_cast("long")
    ok = (F.size(parts) == 3) & epoch.isNotNull()
    return (lines.filter(ok)
                 .withColumn("commit_hash", parts[0])
                 .withColumn("commit_time", F.timestamp_seconds(epoch).cast("timestamp_ntz"))
                 .withColumn("author", parts[2]))


def ingest_numstat(lines: DataFrame, text: str = "line") -> DataFrame:
    """S9 + P36: ``added\\tdeleted\\tpath``; '-' counts as 0; lines_changed = added + deleted.

    A count that is not an integer leaves lines_changed at 0 and the risk at low.
    """
    parts = F.split(F.col(text), "\t")
    val = lambda c: F.when(c == "-", F.lit(0)).otherwise(c.try_cast("long"))
    added, deleted = val(parts[0]), val(parts[1])
    lines_changed = F.when((F.size(parts) >= 2) & added.isNotNull() & deleted.isNotNull(), added + deleted) \
                     .otherwise(F.lit(0))
    return (lines.withColumn("lines_changed", lines_changed.cast("long"))
                 .withColumn("risk_level", change_risk_level(F.col("lines_changed"))))


def change_risk_level(n: Column) -> Column:
    """>100 high, >20 medium, else low."""
    return F.when(n > 100, "high").when(n > 20, "medium").otherwise("low")


def check_rollup(checks: DataFrame, keys=("project_id",)) -> DataFrame:
    """Per project, any failed check → error; else any warning → warning; else healthy.

    (A check whose status is 'error' is not counted, as in the rule being reproduced.)
    """
    st = F.col("status")
    return checks.groupBy(*keys).agg(
        F.when(F.bool_or(st == "failed"), "error").when(F.bool_or(st == "warning"), "warning")
         .otherwise("healthy").alias("overall"),
        F.count_if(st == "failed").cast("long").alias("n_failed"),
        F.count_if(st == "warning").cast("long").alias("n_warning"))
