"""T2 + W6 as a stream: the debounced batches of a project with the last change of every path.

Two queries read the same changes. One finds where a project's sessions begin and end (``session_window``, merged inside each task
before the shuffle, so a hot project sends a few rows per task). The other keeps, per project and path, the *chains* of changes that lie less than the gap
apart: a chain is always inside one session, whatever other paths do. It is a ``transformWithState`` processor over (project, salt) keys, the
salt being a hash of the path, with a map state over groups of paths and one event-time timer per key; a chain leaves the state once the watermark has passed its
end. :func:`session_changes` then gives every closed session the last change of each of its paths, by one ordered pass.
"""

from __future__ import annotations

import json
import sys
from zlib import crc32

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from codegauge.operators.ordered import prefix_sum, range_blocks
from codegauge.streaming.changes import expand_moves, monitored, read_change_stream, run_session_stream

# the processor runs in Python workers: its code travels with it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SALTS, CELLS = 16, 64
CHAIN = "project_id LONG, path STRING, start_us LONG, last_us LONG, event_id LONG, sub INT, change_type STRING"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge_chains(chains: list, gap: int) -> list:
    """Chains [start, last, event id, sub, type] in order; those less than ``gap`` apart become one, of which the last change stays."""
    out: list = []
    for c in sorted(chains):
        if out and c[0] < out[-1][1] + gap:
            end = out[-1]
            out[-1] = [end[0], *max(end[1:], c[1:], key=lambda x: x[:3])]
        else:
            out.append(list(c))
    return out


class PathChains(StatefulProcessor):
    """State of one (project, salt): the open chains of each path, and when the earliest of them may end.

    The paths are dealt over ``CELLS`` entries of the map state by a hash; an entry holds the chains of all its paths. So a batch reads and writes
    an entry once for all its rows, and calls of the state store do not grow with rows or paths."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell INT", "chains STRING")
        self.next = handle.getValueState("next", "at_ms LONG")

    def _due_ms(self, chain) -> int:
        return -(-(chain[1] + self.gap) // 1000)

    def _wake(self, at_ms: int) -> None:
        if self.next.exists():
            old = self.next.get()[0]
            if old <= at_ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)
        self.next.update((at_ms,))

    def handleInputRows(self, key, rows, timerValues):
        new: dict = {}
        for r in rows:
            path, change_type, us, event_id, sub = r[2:7]
            new.setdefault(crc32(path.encode()) % CELLS, {}).setdefault(path, []).append([us, us, event_id, sub, change_type])
        wake = None
        for cell, paths in new.items():
            held = self.cells.getValue((cell,))
            open_ = json.loads(held[0]) if held else {}
            for path, chains in paths.items():
                merged = merge_chains(chains + open_.get(path, []), self.gap)
                open_[path] = merged
                due = min(map(self._due_ms, merged))
                wake = due if wake is None else min(wake, due)
            self.cells.updateValue((cell,), (json.dumps(open_),))
        if wake is not None:
            self._wake(wake)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, wake = timerValues.getCurrentWatermarkInMs(), None
        self.next.clear()
        changed = []
        for (cell,), (text,) in self.cells.iterator():
            open_, ended = json.loads(text), False
            for path, chains in list(open_.items()):
                left = [c for c in chains if self._due_ms(c) > now]
                if len(left) < len(chains):
                    ended = True
                    for c in chains:
                        if self._due_ms(c) <= now:
                            yield Row(project_id=key[0], path=path, start_us=c[0], last_us=c[1], event_id=c[2], sub=c[3], change_type=c[4])
                    if left:
                        open_[path] = left
                    else:
                        del open_[path]
                for c in left:
                    wake = self._due_ms(c) if wake is None else min(wake, self._due_ms(c))
            if ended:
                changed.append((cell, json.dumps(open_) if open_ else None))
        for cell, text in changed:
            if text:
                self.cells.updateValue((cell,), (text,))
            else:
                self.cells.removeKey((cell,))
        if wake is not None:
            self._wake(wake)

    def close(self) -> None:
        pass


def micros(ts):
    """Microseconds of a timestamp without zone since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def stream_chains(changes: DataFrame, gap_seconds: int, watermark: str, salts: int = SALTS) -> DataFrame:
    """T1 + F1 + W6 as a stream: :data:`CHAIN` rows of the monitored changes, as the watermark closes them. Later rows than the watermark are dropped."""
    d = monitored(expand_moves(changes)).withColumn("ets", F.col("ts").cast("timestamp")).withWatermark("ets", watermark)
    d = d.select("project_id", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int").alias("salt"), "path", "change_type", micros(F.col("ts")).alias("us"), "event_id", "sub", "ets")
    return d.groupBy("project_id", "salt").transformWithState(PathChains(gap_seconds * 1_000_000), CHAIN, "append", "EventTime")


def run_chain_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, gap_seconds: int, watermark: str = "10 minutes", salts: int = SALTS,
                     max_files: int | None = None):
    """Run :func:`stream_chains` over all waiting input once into a Parquet table; returns the finished query. The state lies in RocksDB,
    which ``transformWithState`` asks for; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        q = (stream_chains(read_change_stream(spark, source, max_files=max_files), gap_seconds, watermark, salts)
             .writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(name, old)
    return q


def session_changes(sessions: DataFrame, chains: DataFrame) -> DataFrame:
    """The last change of every path in every closed session: project_id, session_start, session_end, path, change_type, ts, event_id.

    ``sessions`` has project_id, session_start and session_end; ``chains`` are :data:`CHAIN` rows. Chains outside all sessions belong to one that is still
    open. Sessions and chains are put in one order by project and time, cut in ranges; a chain's session is the last one that begins not after it, found
    by a two-level count, so a hot project is no hot task.
    """
    marks = sessions.select("project_id", micros(F.col("session_start")).alias("us"), F.lit(0).alias("kind"), "session_start", "session_end")
    rows = chains.select("project_id", F.col("start_us").alias("us"), F.lit(1).alias("kind"), "path", "last_us", "event_id", "sub", "change_type")
    order = ["us", "kind"]
    d = range_blocks(marks.unionByName(rows, allowMissingColumns=True), ["project_id", *order, "path"], "__b")
    d = prefix_sum(d.withColumn("__m", F.when(F.col("kind") == 0, 1).otherwise(0)), ["project_id"], F.col("__b"), order, "__m", "no")
    mine = d.filter("kind = 0").select("project_id", "no", "session_start", "session_end")
    inside = d.filter("kind = 1").drop("session_start", "session_end").join(mine, ["project_id", "no"]).filter(F.col("us") < micros(F.col("session_end")))
    last = inside.groupBy("project_id", "session_start", "session_end", "path").agg(
        F.max_by(F.struct("change_type", "last_us", "event_id"), F.struct("last_us", "event_id", "sub")).alias("c"))
    ts = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("c.last_us") / F.lit(1_000_000)).cast("decimal(18,6)"))
    return last.select("project_id", "session_start", "session_end", "path", "c.change_type", ts.alias("ts"), "c.event_id")


def run_debounce_stream(spark: SparkSession, source: str, folder: str, gap_seconds: int, watermark: str = "10 minutes", max_files: int | None = None) -> DataFrame:
    """Both queries over all waiting input, each from its own checkpoint in ``folder``, and the closed sessions' changes so far."""
    run_session_stream(spark, source, f"{folder}/sessions", f"{folder}/_sessions", gap=f"{gap_seconds} seconds", watermark=watermark, max_files=max_files)
    run_chain_stream(spark, source, f"{folder}/chains", f"{folder}/_chains", gap_seconds, watermark, max_files=max_files)
    sessions = spark.read.schema("project_id LONG, session_start TIMESTAMP_NTZ, session_end TIMESTAMP_NTZ").parquet(f"{folder}/sessions")
    return session_changes(sessions, spark.read.schema(CHAIN).parquet(f"{folder}/chains"))
