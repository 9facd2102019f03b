"""S10/S11 for whole snapshots: context, files, entities and edges of a project and branch in one table.

Rows of all four kinds lie in one Parquet table (project_id, branch, kind, body) whose ``body`` is a ``VARIANT``: each kind keeps its own columns and
may gain some without a new table. The table is partitioned by (project_id, branch) and every snapshot has exactly one context row, so
that one dynamic partition overwrite replaces everything that the snapshot stands for, also where a project has no file, entity or edge left.
Inside a partition rows are sorted by kind: a reader of one kind skips the row groups of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.operators.snapshots import attach_entities, branch_id_of, project_id_of, rebuild_edges

KEYS = ["project_id", "branch"]
TABLE = "kind STRING, body VARIANT, project_id LONG, branch STRING"

# columns of the kinds, with the types they come back with
KINDS = {
    "context": {"project_root": "string", "project_key": "string", "branch_key": "string", "framework": "string", "main_language": "string", "architecture": "string",
                "build_system": "string", "package_manager": "string", "version": "string", "total_files": "bigint", "total_lines": "bigint",
                "low": "bigint", "medium": "bigint", "high": "bigint", "extreme": "bigint"},
    "file": {"path": "string", "language": "string", "size_bytes": "bigint", "line_count": "bigint", "file_hash": "string", "risk_score": "double", "last_modified": "timestamp_ntz"},
    "entity": {"path": "string", "name": "string", "entity_type": "string", "signature": "string", "docstring": "string", "line_number": "bigint"},
    "edge": {"src": "string", "dst": "string", "relation_type": "string", "strength": "double"},
}


def context_rows(contexts: DataFrame, risk: DataFrame, root: Column) -> DataFrame:
    """The context of every project of ``contexts`` (project_id, branch, A14 columns) with the totals and the complexity histogram (A4) of its file rows
    ``risk`` (project_id, branch, line_count, complexity_level), and its keys (P33) from the project's ``root``. A project without files has zeros."""
    level = F.col("complexity_level")
    totals = risk.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total_files"), F.sum("line_count").alias("total_lines"),
                                     *[F.count_if(level == b).alias(b) for b in ("low", "medium", "high", "extreme")])
    out = contexts.join(totals, KEYS, "left").fillna(0, ["total_files", "total_lines", "low", "medium", "high", "extreme"])
    return (out.withColumn("project_root", root).withColumn("project_key", project_id_of(root))
               .withColumn("branch_key", branch_id_of(root, F.col("branch"))))


def _rows(df: DataFrame, kind: str) -> DataFrame:
    body = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in KINDS[kind].items()]
    return df.select(F.lit(kind).alias("kind"), F.to_variant_object(F.struct(*body)).alias("body"), F.col("project_id").cast("long").alias("project_id"), "branch")


def save(path: str, context: DataFrame, files: DataFrame, entities: DataFrame, edges: DataFrame) -> None:
    """Replace the snapshots of all (project_id, branch) of ``context`` by the rows given for them.

    All frames have project_id and branch; columns that a kind does not know are left out, missing ones are null. Rows of other projects or branches
    than those of ``context`` are not written. An entity is stored only with its file (J5), an edge only between files (J6).
    """
    named = context.select(*KEYS)
    mine = lambda df: df.join(named, KEYS, "left_semi")
    held = files.select(*KEYS, "path").distinct()
    linked = edges.join(held.withColumnRenamed("path", "src"), [*KEYS, "src"], "left_semi").join(held.withColumnRenamed("path", "dst"), [*KEYS, "dst"], "left_semi")
    rows = _rows(context, "context").unionByName(_rows(mine(files), "file"))
    rows = rows.unionByName(_rows(mine(attach_entities(entities, held, (*KEYS, "path"))), "entity")).unionByName(_rows(mine(linked), "edge"))
    # a project with very many rows is written by several tasks: the hint lets AQE cut its partition
    (rows.hint("rebalance", *KEYS).sortWithinPartitions(*KEYS, "kind").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*KEYS).parquet(path))


def load(spark: SparkSession, path: str, project_id: int | None = None, branch: str | None = None) -> dict[str, DataFrame]:
    """The snapshot's four tables by kind. Filters on project and branch prune partitions.

    Entities come with their file rows only (J5), edges between file rows only, with the defaults of J6 where relation or strength is missing."""
    rows = spark.read.schema(TABLE).parquet(path)
    if project_id is not None:
        rows = rows.filter(F.col("project_id") == project_id)
    if branch is not None:
        rows = rows.filter(F.col("branch") == branch)

    def of(kind):
        cols = [F.variant_get("body", f"$.{c}", t).alias(c) for c, t in KINDS[kind].items()]
        return rows.filter(F.col("kind") == kind).select(*KEYS, *cols)
    files = of("file")
    key = F.struct(*KEYS).alias("snapshot")
    edges = rebuild_edges(of("edge").withColumn("snapshot", key), files.withColumn("snapshot", key), project="snapshot").drop("snapshot")
    return {"context": of("context"), "file": files, "entity": attach_entities(of("entity"), files, (*KEYS, "path")), "edge": edges}
