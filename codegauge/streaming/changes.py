"""File-change events: filtering, move expansion, debouncing and applying them to snapshots.

Batch forms (used by the registered queries) and Structured Streaming forms (``readStream`` →
watermark → session windows → ``foreachBatch`` upsert into a snapshot table) share the same
column builders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.operators.extract import analyze_files, entities, imports
from codegauge.operators.graph import file_nodes, graph_language, risk_scores, suffix
from codegauge.operators.ordered import sessionize
from codegauge.session import materialize

CHANGE_SCHEMA = ("project_id LONG, path STRING, dest_path STRING, change_type STRING, ts TIMESTAMP_NTZ, "
                 "event_id LONG")


def should_monitor(path: Column) -> Column:
    """not under an ignored directory part, not a log/temp name, and a watched extension."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    ignored = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in R.MONITOR_IGNORED_PARTS]))
    temp = F.lit(False)
    for sfx in R.MONITOR_IGNORED_SUFFIXES:
        temp = temp | name.endswith(sfx)
    watched = F.lower(suffix(path)).isin(*R.MONITOR_EXTENSIONS)
    return ~ignored & ~temp & watched


def expand_moves(changes: DataFrame) -> DataFrame:
    """A move becomes a deletion of the source then a creation of the destination.

    ``sub`` orders the two halves of one event (deletion first). Further columns of the change go along with both.
    """
    more = [c for c in changes.columns if c not in ("project_id", "path", "dest_path", "change_type", "ts", "event_id")]
    moved = F.col("change_type") == "moved"
    items = F.when(moved, F.array(
        F.struct(F.col("path").alias("p"), F.lit("deleted").alias("t"), F.lit(0).alias("sub")),
        F.struct(F.col("dest_path").alias("p"), F.lit("created").alias("t"), F.lit(1).alias("sub")),
    )).otherwise(F.array(F.struct(F.col("path").alias("p"), F.col("change_type").alias("t"), F.lit(0).alias("sub"))))
    d = changes.select("project_id", "ts", "event_id", *more, F.explode(items).alias("x"))
    return d.select("project_id", F.col("x.p").alias("path"), F.col("x.t").alias("change_type"), "ts",
                    "event_id", F.col("x.sub").alias("sub"), *more)


EVENT_SCHEMA = CHANGE_SCHEMA + ", is_directory BOOLEAN"


def file_events(events: DataFrame) -> DataFrame:
    """The changes of files among ``events`` (:data:`EVENT_SCHEMA`): directory events are ignored; an unknown flag means a file."""
    return events.filter(~F.coalesce("is_directory", F.lit(False))).drop("is_directory")


def folder_moves(events: DataFrame, files: DataFrame) -> DataFrame:
    """The optional other reading of a moved folder: a move of every file below it, at the folder's time and event id.

    ``files`` (project_id, path) are those that exist before. A file meets the moves of its own folders only: its ancestors are exploded (as many as
    its path is deep) and joined by equality, so no file is compared with folders elsewhere."""
    moves = events.filter(F.coalesce("is_directory", F.lit(False)) & (F.col("change_type") == "moved") & F.col("dest_path").isNotNull())
    moves = moves.select("project_id", F.rtrim(F.col("path"), F.lit("/")).alias("folder"), F.rtrim(F.col("dest_path"), F.lit("/")).alias("to"), "ts", "event_id")
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    up = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    below = files.select("project_id", "path", F.explode(up).alias("folder"))
    d = moves.join(below, ["project_id", "folder"])
    dest = F.concat("to", F.substring(F.col("path"), F.length("folder") + 1, F.length("path")))
    return d.select("project_id", "path", dest.alias("dest_path"), F.lit("moved").alias("change_type"), "ts", "event_id")


def monitored(expanded: DataFrame) -> DataFrame:
    """Keep the expanded changes whose path passes the monitor filter (both halves of a move)."""
    return expanded.filter(should_monitor(F.col("path")))


def _last(expanded: DataFrame, *extra: str) -> DataFrame:
    """The row of every path that comes last by (ts, event id, sub order), with ``extra`` order columns."""
    cols = ["change_type", "ts", "event_id", *extra]
    return (expanded.groupBy("project_id", "path")
                    .agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id", "sub")).alias("c"))
                    .select("project_id", "path", "c.*"))


def latest_change_per_path(expanded: DataFrame) -> DataFrame:
    """The last queued change of every path wins (ts, event id, sub order), via ``max_by``."""
    return _last(expanded)


def debounce_sessions(changes: DataFrame, gap_seconds: int, tiebreak: list[str] = ("event_id",)) -> DataFrame:
    """T2 (batch): project-wide sessions closed by ``gap`` seconds without an event.

    The session belongs to the project, not to the path. Returns one row per session with its
    first/last event time, end (last + gap), event and path counts.
    """
    s = sessionize(changes, ["project_id"], "ts", gap_seconds, list(tiebreak))
    return s.groupBy("project_id", "session_no").agg(
        F.min("ts").alias("session_start"),
        (F.max("ts") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("session_end"),
        F.count(F.lit(1)).cast("long").alias("n_events"),
        F.countDistinct("path").cast("long").alias("n_paths"))


def debounced_changes(changes: DataFrame, gap_seconds: int) -> DataFrame:
    """T2 + W6: inside each project session, the last change of every path."""
    s = sessionize(monitored(expand_moves(changes)), ["project_id"], "ts", gap_seconds, ["event_id", "sub"])
    return (s.groupBy("project_id", "session_no", "path")
             .agg(F.max_by(F.struct("change_type", "ts", "event_id"), F.struct("ts", "event_id", "sub")).alias("c"))
             .select("project_id", "session_no", "path", "c.*"))


def apply_changes(files: DataFrame, latest: DataFrame) -> DataFrame:
    """Deleted paths leave the snapshot; created/modified paths are (re)analysed.

    Returns the new file set with ``state``: 'kept' (untouched) or 'reanalysed'.
    """
    touched = latest.select("project_id", "path", "change_type")
    kept = files.select("project_id", "path").join(touched, ["project_id", "path"], "left_anti") \
                .withColumn("state", F.lit("kept"))
    re = (touched.filter(F.col("change_type").isin("created", "modified"))
                 .select("project_id", "path", F.lit("reanalysed").alias("state")))
    return kept.unionByName(re)


def reanalyse(risk: DataFrame, latest: DataFrame, current: DataFrame) -> DataFrame:
    """File rows after the changes: ``risk`` rows of untouched files stay, deleted ones go, and created or modified
    files are extracted and rated again from their ``current`` text (project_id, path, content). Only touched files are parsed.

    Returns project_id, path, state, size_bytes, line_count, n_entities, n_imports, risk_tenths, risk_score, complexity_level.
    """
    cols = ["size_bytes", "line_count", "n_entities", "n_imports", "risk_tenths", "risk_score", "complexity_level"]
    keys = ["project_id", "path"]
    kept = risk.join(latest.select(*keys), keys, "left_anti").select(*keys, F.lit("kept").alias("state"), *cols)
    live = latest.filter(F.col("change_type").isin("created", "modified")).select(*keys)
    touched = current.join(live, keys, "left_semi").select(*keys, "content", F.octet_length("content").cast("long").alias("size_bytes"),
                                                           graph_language("path").alias("lang"))
    extracted = materialize(analyze_files(touched), "extract")
    new = risk_scores(file_nodes(touched), entities(extracted), imports(extracted))
    return kept.unionByName(new.select(*keys, F.lit("reanalysed").alias("state"), *cols))


# ------------------------------------------------------------------ Structured Streaming
def read_change_stream(spark: SparkSession, source: str, fmt: str = "parquet", max_files: int | None = None, directories: bool = False) -> DataFrame:
    """Append-only change rows as a stream (explicit schema; rewritten files are not re-read). Sources with ``directories`` carry
    the flag ``is_directory``; their directory events are ignored."""
    r = spark.readStream.format(fmt).schema(EVENT_SCHEMA if directories else CHANGE_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return file_events(r.load(source)) if directories else r.load(source)


def stream_sessions(changes: DataFrame, gap: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """T1 + F1 + T2 + T5 as a stream: moves expanded, monitor filter, watermark on event time,
    session windows per project (append mode: a session is emitted once the watermark, the
    latest event time minus the delay, has passed its end).

    Event time is cast from TIMESTAMP_NTZ (how the tables load) to TIMESTAMP for the watermark,
    and the window bounds are cast back.
    """
    d = monitored(expand_moves(changes)).withColumn("ets", F.col("ts").cast("timestamp"))
    return (d.withWatermark("ets", watermark)
             .groupBy("project_id", F.session_window("ets", gap).alias("w"))
             .agg(F.count(F.lit(1)).cast("long").alias("n_events"),
                  F.min("event_id").alias("first_event"))
             .select("project_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n_events", "first_event"))


def run_session_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                       gap: str = "10 minutes", watermark: str = "10 minutes", max_files: int | None = None):
    """Run T2 over all available input once (``availableNow``) into a Parquet sink; returns when done."""
    q = (stream_sessions(read_change_stream(spark, source, max_files=max_files), gap, watermark)
         .writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


STATE_SCHEMA = "project_id LONG, path STRING, change_type STRING, ts TIMESTAMP_NTZ, event_id LONG, sub INT, batch LONG"


def run_apply_stream(spark: SparkSession, source: str, snapshot: str, checkpoint: str, max_files: int | None = None):
    """T3 as a stream: every micro-batch adds its last change per path to an append-only table.

    A batch is one partition of that table, so a batch that runs again replaces its own rows. The state is the last change of
    every path by (ts, event id, sub) over the table (:func:`read_state`); deletions stay as rows, so a late batch never overrides
    a newer change, however the stream is split.
    """
    def apply(batch: DataFrame, batch_id: int):
        new = _last(monitored(expand_moves(batch)), "sub").withColumn("batch", F.lit(batch_id).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(snapshot)

    q = (read_change_stream(spark, source, max_files=max_files).writeStream.foreachBatch(apply)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_state(spark: SparkSession, snapshot: str) -> DataFrame:
    """The last change of every path (deletions too) over all batches."""
    return _last(spark.read.schema(STATE_SCHEMA).parquet(snapshot), "sub")


def read_snapshot_files(spark: SparkSession, snapshot: str) -> DataFrame:
    """Paths whose last change created or modified them."""
    return read_state(spark, snapshot).filter(F.col("change_type") != "deleted").select("project_id", "path")
