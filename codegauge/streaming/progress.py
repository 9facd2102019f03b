"""What a stream has done, as rows: batches, rows, late rows dropped, watermark, and whether it still runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRESS = ("name STRING, run_id STRING, batch_id LONG, started TIMESTAMP, input_rows LONG, max_event_time TIMESTAMP, watermark TIMESTAMP, dropped_rows LONG, "
            "state_rows LONG, duration_ms LONG, monitoring BOOLEAN")


def _row(name: str, p: dict, active: bool) -> tuple:
    import datetime as dt

    def time(x):
        return dt.datetime.fromisoformat(x.replace("Z", "+00:00")) if x and not x.startswith("1970-01-01") else None
    event = p.get("eventTime") or {}
    ops = p.get("stateOperators") or []
    return (name, p["runId"], p["batchId"], time(p["timestamp"]), p["numInputRows"], time(event.get("max")), time(event.get("watermark")),
            sum(o.get("numRowsDroppedByWatermark", 0) for o in ops), sum(o.get("numRowsTotal", 0) for o in ops), (p.get("durationMs") or {}).get("triggerExecution", 0), active)


def record_progress(spark: SparkSession, query, path: str, name: str | None = None) -> DataFrame:
    """Add the recent progress of ``query`` (a row per micro-batch, as many as Spark retains) to the table at ``path``; returns the rows."""
    rows = [_row(name or query.name or query.id, json.loads(p.json) if hasattr(p, "json") else p, query.isActive) for p in query.recentProgress]
    df = spark.createDataFrame(rows, PROGRESS)
    df.write.mode("append").parquet(path)
    return df


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and batch: of a batch recorded more than once the last."""
    d = spark.read.schema(PROGRESS).parquet(path)
    cols = [c for c in d.columns if c not in ("name", "batch_id")]
    return d.groupBy("name", "batch_id").agg(F.max_by(F.struct(*cols), "started").alias("p")).select("name", "batch_id", "p.*")


def stream_status(progress: DataFrame) -> DataFrame:
    """Per query the monitoring flag, batches, rows, dropped rows, last batch's time and rows, watermark, and ``lag_seconds``: how far the watermark is
    behind the latest event seen."""
    last = F.max_by(F.struct("started", "input_rows", "monitoring"), "batch_id").alias("l")
    d = progress.groupBy("name").agg(
        F.count(F.lit(1)).cast("long").alias("n_batches"), F.sum("input_rows").cast("long").alias("input_rows"), F.sum("dropped_rows").cast("long").alias("dropped_rows"),
        F.max("max_event_time").alias("max_event_time"), F.max("watermark").alias("watermark"), last)
    lag = F.unix_timestamp("max_event_time") - F.unix_timestamp("watermark")
    return d.select("name", F.col("l.monitoring").alias("monitoring"), "n_batches", "input_rows", "dropped_rows", F.col("l.started").alias("last_batch_time"),
                    F.col("l.input_rows").alias("last_batch_rows"), "max_event_time", "watermark", lag.alias("lag_seconds"))
