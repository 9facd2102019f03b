"""J9 as rows: the context of a file read from co-bucketed tables.

Files, entities, dependencies and imports are stored once, bucketed and sorted by (project_id, path): a file's rows there are bounded by its own text. A
context is then a union of joins on that key which Spark runs bucket by bucket without a shuffle, for one file, for many or for all. Only the
dependents are no such table: a file that a third of all files import would fill one bucket. They are sorted but not bucketed, and their join is
an ordinary one, which AQE cuts where it is skewed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.session import scratch_dir

KEY = ["project_id", "path"]
KINDS = ("files", "entities", "dependencies", "dependents", "imports")


class ContextStore:
    """Bucketed tables of one graph. ``files`` has KEY, language, size_bytes, line_count, risk_score and last_modified; ``entities`` KEY, name, entity_type and
    line_number; ``edges`` project_id, src, dst and relation_type; ``imports`` KEY and specifier."""

    def __init__(self, spark: SparkSession, buckets: int = 32):
        self.spark, self.buckets = spark, buckets
        self.name = f"context_{uuid.uuid4().hex}"

    def save(self, files: DataFrame, entities: DataFrame, edges: DataFrame, imports: DataFrame) -> ContextStore:
        way = lambda a, b: edges.select("project_id", F.col(a).alias("path"), F.col(b).alias("other"), "relation_type")
        tables = {"files": files.select(*KEY, "language", "size_bytes", "line_count", "risk_score", "last_modified"),
                  "entities": entities.select(*KEY, "name", "entity_type", "line_number"), "dependencies": way("src", "dst"), "dependents": way("dst", "src"),
                  "imports": imports.groupBy(*KEY, "specifier").agg(F.count(F.lit(1)).cast("long").alias("n"))}
        for kind, rows in tables.items():
            if kind == "dependents":
                w = rows.sortWithinPartitions(*KEY).write
            else:  # one task writes one bucket as one sorted file
                w = rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            w.option("path", scratch_dir(self.spark, f"context-{kind}")).format("parquet").saveAsTable(f"{self.name}_{kind}")
        return self

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def drop(self) -> None:
        for kind in KINDS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")

    def rows(self, files: DataFrame | None = None) -> DataFrame:
        """(project_id, path, kind, item, detail) of all files, or of the rows of ``files`` (KEY): one ``file`` row each, then its entities (last definition of a
        name), dependencies, dependents and import specifiers with their number."""
        mine = self.table("files") if files is None else self.table("files").join(files.select(*KEY).distinct(), KEY, "left_semi")
        of = lambda kind: self.table(kind).join(mine.select(*KEY), KEY, "left_semi")
        text = lambda *cols: F.concat_ws("|", *[c.cast("string") for c in cols])
        c = F.col
        about = text(F.coalesce(c("language"), F.lit("")), c("size_bytes"), c("line_count"), F.round(c("risk_score") * 10).cast("long"),
                     F.coalesce(F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss"), F.lit("")))
        parts = [("file", mine, F.lit(""), about), ("entity", of("entities"), c("name"), text(c("entity_type"), c("line_number"))),
                 ("dependency", of("dependencies"), c("other"), c("relation_type")), ("dependent", of("dependents"), c("other"), c("relation_type")),
                 ("import", of("imports"), c("specifier"), c("n").cast("string"))]
        out = None
        for kind, rows, item, detail in parts:
            part = rows.select(*KEY, F.lit(kind).alias("kind"), item.alias("item"), detail.alias("detail"))
            out = part if out is None else out.unionByName(part)
        return out
