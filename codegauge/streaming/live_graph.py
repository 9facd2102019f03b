"""T3/T4 as a stream: the graph of live projects, kept up to date file by file.

A change row carries the text of the file it created or modified. Every micro-batch analyses only the files it touches, and
re-resolves only the imports whose outcome can have moved: a file that comes or goes may change the target of files that nobody touched, because an
import names a path without its suffix (a *stem*) and means the best suffix that exists.

State. Four Parquet tables partitioned by ``bucket``, a hash of (project, stem):

==========  =========================================================  ==========================
table       rows                                                       bucket of
==========  =========================================================  ==========================
files       last change of every path, its sizes, counts and risk      the file's own stem
entities    entities of live files                                     the file's own stem
imports     imports of live files, with the stem they mean if any      the file's own stem
refs        importer, stem, occurrences and target (null: no file)     the stem that is imported
==========  =========================================================  ==========================

All files that can answer an import lie in one bucket with the imports that ask for them. A batch rewrites only the buckets that it
touches, by dynamic partition overwrite; at most ``buckets`` integers reach the driver. ``refs`` are written first and ``files`` last, and a
change counts if it is not older than the stored one, so a batch that ran halfway gives the same result when it runs again. Hot buckets (a
stem that a third of all files import) are cut by Spark's rebalancing when written and by skew joins when read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.operators.extract import analyze_files, entities, imports
from codegauge.operators.graph import best_targets, file_nodes, graph_language, import_stems, path_stem, risk_scores
from codegauge.session import materialize
from codegauge.streaming.changes import CHANGE_SCHEMA, expand_moves, monitored

LIVE_SCHEMA = CHANGE_SCHEMA + ", content STRING"
KEY = ["project_id", "path"]
STEM = ["project_id", "stem"]
ORDER = ["ts", "event_id", "sub"]
BUCKETS = 64

TABLES = {
    "files": "project_id LONG, path STRING, change_type STRING, ts TIMESTAMP_NTZ, event_id LONG, sub INT, language STRING, size_bytes LONG, line_count LONG, "
             "file_hash STRING, n_entities LONG, n_imports LONG, risk_tenths LONG, risk_score DOUBLE, complexity_level STRING, bucket INT",
    "entities": "project_id LONG, path STRING, seq LONG, name STRING, entity_type STRING, line_number LONG, signature STRING, docstring STRING, bucket INT",
    "imports": "project_id LONG, path STRING, seq LONG, specifier STRING, stem STRING, bucket INT",
    "refs": "project_id LONG, path STRING, stem STRING, occurrences LONG, target STRING, bucket INT",
}


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].split(", ")]


def _read(spark: SparkSession, state: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{state}/{name}").filter("path IS NOT NULL")


def _bucket(stem, buckets: int):
    return F.pmod(F.xxhash64("project_id", stem), F.lit(buckets)).cast("int").alias("bucket")


def _numbers(rows: DataFrame) -> list[int]:
    """The distinct bucket numbers of ``rows`` (no more than there are buckets)."""
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())


def _replace(rows: DataFrame, state: str, name: str, buckets: list[int]) -> None:
    """Put ``rows`` in the place of the named buckets. Each gets a row without path as well, so that an emptied one is replaced too."""
    if buckets:
        marks = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket INT")
        rows = rows.select(*_columns(name)).unionByName(marks, allowMissingColumns=True)
        (rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("bucket").parquet(f"{state}/{name}"))


def _live(files: DataFrame) -> DataFrame:
    return files.filter("change_type <> 'deleted'")


def apply_batch(batch: DataFrame, state: str, buckets: int = BUCKETS) -> None:
    """Merge one micro-batch of change rows (:data:`LIVE_SCHEMA`) into the state.

    Of several changes of a path the last by (ts, event id, sub) counts; one that is older than the stored change has no effect, nor has a
    creation or modification without text, nor one of a path that is not watched or has no graph language.
    """
    spark = batch.sparkSession
    own = path_stem(F.col("path"))
    d = monitored(expand_moves(batch)).filter(graph_language("path").isNotNull() & (F.col("content").isNotNull() | (F.col("change_type") == "deleted")))
    last = d.groupBy(*KEY).agg(F.max_by(F.struct("change_type", *ORDER, "content"), F.struct(*ORDER)).alias("c")).select(*KEY, "c.*")
    new = materialize(last.withColumn("stem", own).withColumn("bucket", _bucket("stem", buckets)), "changes")
    near = _numbers(new)
    old_files = _read(spark, state, "files").filter(F.col("bucket").isin(near))
    stored = old_files.select(*KEY, F.struct(*ORDER).alias("stored"))
    newer = F.col("stored").isNull() | (F.struct(*ORDER) >= F.col("stored"))
    eff = materialize(new.join(stored, KEY, "left").filter(newer).drop("stored"), "effective")
    keys = eff.select(*KEY)

    # the touched files, analysed
    texts = eff.filter("change_type <> 'deleted'").select(*KEY, "content", graph_language("path").alias("lang"), F.octet_length("content").cast("long").alias("size_bytes"))
    extracted = materialize(analyze_files(texts), "extract")
    rated = risk_scores(file_nodes(texts), entities(extracted), imports(extracted))
    files = (old_files.join(keys, KEY, "left_anti")
             .unionByName(eff.select(*KEY, "change_type", *ORDER, "bucket").join(rated, KEY, "left"), allowMissingColumns=True))
    at = eff.select(*KEY, "bucket")
    found = imports(extracted)
    stems = import_stems(found).select(*KEY, "seq", "stem")
    new_imports = found.join(stems, [*KEY, "seq"], "left").join(at, KEY)
    old_imports = _read(spark, state, "imports").filter(F.col("bucket").isin(near))
    old_entities = _read(spark, state, "entities").filter(F.col("bucket").isin(near))

    # stems whose best file is another one now
    touched = eff.select(*STEM).distinct()
    best = lambda rows: best_targets(_live(rows).withColumn("stem", own).join(touched, STEM, "left_semi"))
    was, now = best(old_files).withColumnRenamed("target", "was"), best(files).withColumnRenamed("target", "now")
    moved = was.join(now, STEM, "full_outer").filter(~F.col("was").eqNullSafe(F.col("now"))).select(*STEM, "now", F.lit(True).alias("moved"))
    moved = materialize(moved, "moved")

    # imports that lose, gain or change their target
    asked = stems.groupBy(*KEY, "stem").agg(F.count(F.lit(1)).cast("long").alias("occurrences"))
    gone = old_imports.join(keys, KEY, "left_semi").filter("stem IS NOT NULL")
    spread = lambda rows: rows.select(_bucket("stem", buckets))
    far = _numbers(spread(moved).union(spread(gone)).union(spread(asked)))
    kept = _read(spark, state, "refs").filter(F.col("bucket").isin(far)).join(keys, KEY, "left_anti").join(moved, STEM, "left")
    kept = kept.withColumn("target", F.when(F.col("moved"), F.col("now")).otherwise(F.col("target"))).drop("now", "moved")
    others = _read(spark, state, "files").filter(F.col("bucket").isin([b for b in far if b not in set(near)]))
    listing = _live(files.select(*KEY, "change_type", "bucket").unionByName(others.select(*KEY, "change_type", "bucket")))
    targets = best_targets(listing.withColumn("stem", own).join(asked.select(*STEM).distinct(), STEM, "left_semi"))
    fresh = asked.join(targets, STEM, "left").withColumn("bucket", _bucket("stem", buckets))

    _replace(kept.unionByName(fresh), state, "refs", far)
    _replace(old_imports.join(keys, KEY, "left_anti").unionByName(new_imports), state, "imports", near)
    _replace(old_entities.join(keys, KEY, "left_anti").unionByName(entities(extracted).join(at, KEY)), state, "entities", near)
    _replace(files, state, "files", near)


def read_live_stream(spark: SparkSession, source: str, max_files: int | None = None) -> DataFrame:
    """Change rows with texts as a stream over an append-only Parquet table."""
    r = spark.readStream.format("parquet").schema(LIVE_SCHEMA)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).load(source)


def create_state(spark: SparkSession, state: str) -> None:
    """Empty tables, where there are none."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket").parquet(f"{state}/{name}")


def run_graph_stream(spark: SparkSession, source: str, state: str, checkpoint: str, buckets: int = BUCKETS, max_files: int | None = None, name: str | None = None):
    """Apply all change rows that wait in ``source`` and end; the next run goes on from the checkpoint. Returns the finished query."""
    create_state(spark, state)
    w = read_live_stream(spark, source, max_files).writeStream.foreachBatch(lambda batch, _: apply_batch(batch, state, buckets))
    w = w.queryName(name) if name else w
    q = w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_graph(spark: SparkSession, state: str) -> dict[str, DataFrame]:
    """The tables of the live graph: files (with risk), entities, imports, and import edges (src, dst, occurrences)."""
    refs = _read(spark, state, "refs").filter("target IS NOT NULL")
    edges = (refs.groupBy("project_id", F.col("path").alias("src"), F.col("target").alias("dst")).agg(F.sum("occurrences").alias("occurrences"))
                 .withColumn("relation_type", F.lit("imports")).withColumn("strength", F.lit(0.8)))
    return {"files": _live(_read(spark, state, "files")), "entities": _read(spark, state, "entities"), "imports": _read(spark, state, "imports"), "edges": edges}
