"""Skew-safe ordered operators over (key, position) tables.

A file (or any group) may hold a third of all rows, so no operator here puts a whole group
into one window partition or one row. Every ordered computation is split in two levels:

* rows are cut into *blocks* of consecutive positions (``pos div block_size``); windows run
  over ``(key, block)`` partitions, whose size is bounded by the block size;
* one row per block carries the block's summary; the per-key window over those summaries has
  ``rows / block_size`` rows, and the result is joined back on ``(key, block)``.

The block join is an equi join on a unique key, so it is free of skew as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge.session import materialize

BLOCK = 1 << 12


def _w(keys, *more):
    return Window.partitionBy(*[F.col(k) for k in keys], *more)


def ordinal(df: DataFrame, keys: list[str], order_cols: list, bucket: Column, out: str = "ordinal",
            start: int = 0, total: str | None = None) -> DataFrame:
    """``row_number() - 1 + start`` per ``keys`` in ``order_cols`` order, without one task per key.

    ``bucket`` must be a coarse, non-decreasing function of the order (e.g. the first order column
    divided by a constant); it bounds the size of every window partition. With ``total`` the
    key's row count is added too (summed over its buckets, not counted in one task).
    """
    b = "__bucket"
    d = df.withColumn(b, bucket)
    local = d.withColumn("__rn", F.row_number().over(_w(keys, F.col(b)).orderBy(*order_cols)))
    sizes = local.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn(
        "__off",
        F.coalesce(F.sum("__n").over(_w(keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)),
    )
    if total:
        sizes = sizes.withColumn(total, F.sum("__n").over(_w(keys)).cast("long"))
    sizes = sizes.drop("__n")
    return (local.join(sizes, [*keys, b])
            .withColumn(out, (F.col("__off") + F.col("__rn") - 1 + start).cast("long"))
            .drop("__off", "__rn", b))


def split_blocks(df: DataFrame, keys: list[str], pos: str, block_size: int):
    """(rows of keys that lie in block 0 alone, the others or None): a short key is one window partition and needs no block summaries.

    ``pos >= block_size`` reaches the scan of a stored table, so finding the long keys reads little. Rows without key or position
    belong to no file and are left out, as the joins on (key, block) leave them out."""
    df = df.dropna(subset=[*keys, pos])
    beyond = df.filter((F.col(pos) >= block_size) | (F.col(pos) < 0)).select(*keys).distinct()
    long = materialize(beyond, "long_keys")
    if long.isEmpty():
        return df, None
    return df.join(long, keys, "left_anti"), df.join(long, keys, "left_semi")


def clamped_scan(df: DataFrame, keys: list[str], pos: str, steps: dict[str, str],
                 block_size: int = BLOCK) -> DataFrame:
    """Prefix sums of step columns in ``pos`` order, with their running minimum, per key.

    ``steps`` maps a step column to an output prefix ``p``. Adds ``{p}_sum`` (inclusive prefix
    sum), ``{p}_prev`` (sum before this row) and ``{p}_floor`` (``min(0, prefix sums before this
    row)``). A counter ``n = max(0, n + step)`` after this row is ``{p}_sum - least({p}_floor,
    {p}_sum)``: the walk reflected at zero. All step columns share one pass. Keys inside the first block need one window only.
    """
    short, long = split_blocks(df, keys, pos, block_size)
    short = _scan_whole(short, keys, pos, steps)
    return short if long is None else short.unionByName(_scan_blocks(long, keys, pos, steps, block_size))


def _scan_whole(d: DataFrame, keys: list[str], pos: str, steps: dict[str, str]) -> DataFrame:
    w = _w(keys).orderBy(pos)
    for step, p in steps.items():
        d = d.withColumn(f"{p}_sum", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    for step, p in steps.items():
        least = F.min(f"{p}_sum").over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = (d.withColumn(f"{p}_prev", (F.col(f"{p}_sum") - F.col(step)).cast("long"))
              .withColumn(f"{p}_floor", F.least(F.lit(0), F.coalesce(least, F.lit(0))).cast("long")))
    return d


def _scan_blocks(df: DataFrame, keys: list[str], pos: str, steps: dict[str, str], block_size: int) -> DataFrame:
    b = "__blk"
    d = df.withColumn(b, F.floor(F.col(pos) / block_size))
    wl = _w(keys, F.col(b)).orderBy(pos)
    aggs, cols = [], []
    for step, p in steps.items():
        d = (d.withColumn(f"__lp_{p}", F.sum(step).over(wl.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn(f"__lm_{p}", F.min(f"__lp_{p}").over(wl.rowsBetween(Window.unboundedPreceding, -1))))
        aggs += [F.sum(step).alias(f"__bs_{p}"), F.min(f"__lp_{p}").alias(f"__bm_{p}")]
    blocks = d.groupBy(*keys, b).agg(*aggs)
    wb = _w(keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    for step, p in steps.items():
        blocks = (blocks.withColumn(f"__off_{p}", F.coalesce(F.sum(f"__bs_{p}").over(wb), F.lit(0)))
                        .withColumn(f"__gm_{p}", F.min(F.col(f"__off_{p}") + F.col(f"__bm_{p}")).over(wb)))
        cols += [f"__off_{p}", f"__gm_{p}"]
    d = d.join(blocks.select(*keys, b, *cols), [*keys, b])
    drop = [b]
    for step, p in steps.items():
        off, lp, lm, gm = (F.col(f"__off_{p}"), F.col(f"__lp_{p}"), F.col(f"__lm_{p}"), F.col(f"__gm_{p}"))
        s = off + lp
        floor = F.least(F.lit(0), F.coalesce(gm, F.lit(0)), F.coalesce(off + lm, F.lit(0)))
        d = (d.withColumn(f"{p}_sum", s.cast("long"))
              .withColumn(f"{p}_prev", (s - F.col(step)).cast("long"))
              .withColumn(f"{p}_floor", floor.cast("long")))
        drop += [f"__off_{p}", f"__lp_{p}", f"__lm_{p}", f"__gm_{p}"]
    return d.drop(*drop)


def next_marker(df: DataFrame, keys: list[str], pos: str, out: str = "next_pos",
                block_size: int = BLOCK) -> DataFrame:
    """For every row, the smallest ``pos`` of a later row of the same key (null if none). Keys inside the first block need one window only."""
    short, long = split_blocks(df, keys, pos, block_size)
    short = short.withColumn(out, F.min(pos).over(_w(keys).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)))
    return short if long is None else short.unionByName(_next_in_blocks(long, keys, pos, out, block_size))


def _next_in_blocks(df: DataFrame, keys: list[str], pos: str, out: str, block_size: int) -> DataFrame:
    b = "__blk"
    d = df.withColumn(b, F.floor(F.col(pos) / block_size))
    d = d.withColumn("__in", F.min(pos).over(
        _w(keys, F.col(b)).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)))
    firsts = d.groupBy(*keys, b).agg(F.min(pos).alias("__first"))
    firsts = firsts.withColumn("__after", F.min("__first").over(
        _w(keys).orderBy(b).rowsBetween(1, Window.unboundedFollowing))).select(*keys, b, "__after")
    return (d.join(firsts, [*keys, b])
             .withColumn(out, F.coalesce(F.col("__in"), F.col("__after")))
             .drop(b, "__in", "__after"))


def top_k(df: DataFrame, keys: list[str], order_cols: list, k: int | None, out: str = "rank") -> DataFrame:
    """The first ``k`` rows per key in ``order_cols`` order, numbered from 1 (None: all rows).

    The filter on the rank becomes a group limit below the exchange, so each map task sends at most
    ``k`` rows of a key and a hot key is no hot task.
    """
    d = df.withColumn(out, F.row_number().over(_w(keys).orderBy(*order_cols)))
    return d if k is None else d.filter(F.col(out) <= k)


def prefix_sum(df: DataFrame, keys: list[str], bucket: Column, order_cols: list, col: str, out: str) -> DataFrame:
    """Inclusive running sum of ``col`` per key in ``order_cols`` order, two-level like ``ordinal``.

    ``bucket`` is a coarse non-decreasing function of the order that bounds each window partition.
    """
    b = "__pb"
    d = df.withColumn(b, bucket)
    d = d.withColumn("__ls", F.sum(col).over(_w(keys, F.col(b)).orderBy(*order_cols)
                                            .rowsBetween(Window.unboundedPreceding, 0)))
    blocks = d.groupBy(*keys, b).agg(F.sum(col).alias("__bs"))
    blocks = blocks.withColumn("__off", F.coalesce(F.sum("__bs").over(
        _w(keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__bs")
    return (d.join(blocks, [*keys, b]).withColumn(out, (F.col("__off") + F.col("__ls")).cast("long"))
             .drop(b, "__ls", "__off"))


def range_blocks(df: DataFrame, order_cols: list, out: str = "__blk") -> DataFrame:
    """Rows with the number of their range partition in ``order_cols`` order, written once.

    Spark samples the order to cut even ranges, so a key (or a single time) with a third of all rows is spread over
    many blocks. Written, because the numbers must not change between two reads."""
    return materialize(df.repartitionByRange(*order_cols).withColumn(out, F.spark_partition_id()), "ranges")


def global_rank(df: DataFrame, order_cols: list, out: str = "rank", start: int = 1) -> DataFrame:
    """``row_number() - 1 + start`` over all rows: numbered inside even ranges, plus the rows of the ranges before."""
    d = range_blocks(df, order_cols)
    d = d.withColumn("__rn", F.row_number().over(Window.partitionBy("__blk").orderBy(*order_cols)))
    sizes = d.groupBy("__blk").agg(F.count(F.lit(1)).alias("__n"))  # one row per range
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__blk", F.coalesce(before, F.lit(0)).alias("__off"))
    return (d.join(sizes, "__blk").withColumn(out, (F.col("__off") + F.col("__rn") - 1 + start).cast("long"))
             .drop("__blk", "__rn", "__off"))


def sessionize(df: DataFrame, keys: list[str], ts: str, gap_seconds: int, tiebreak: list[str],
               out: str = "session_no") -> DataFrame:
    """Gap sessions per key: a row opens a new session when its time is at least ``gap`` after the
    previous row's (in (ts, tiebreak) order). Adds ``out`` (1-based session number per key).

    Unlike a session-window aggregate (which clusters a whole key in one task), rows are range-partitioned by
    (key, time): the previous row is found inside the range, or is the last one of the key in the ranges
    before, and the session number is a two-level prefix sum. A project with a third of all events, even in
    one minute, is spread over many tasks.
    """
    # microseconds since the epoch of the naive timestamp: no session time zone, no DST gaps
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                          F.col(ts).cast("timestamp_ntz"))
    order = [F.col("__us"), *[F.col(c) for c in tiebreak]]
    d = range_blocks(df.withColumn("__us", us), [*[F.col(k) for k in keys], *order], "__b")
    d = d.withColumn("__prev", F.lag("__us").over(_w(keys, F.col("__b")).orderBy(*order)))
    bl = d.groupBy(*keys, "__b").agg(F.max("__us").alias("__bmax"))
    bl = bl.withColumn("__pmax", F.lag("__bmax").over(_w(keys).orderBy("__b"))).drop("__bmax")
    d = d.join(bl, [*keys, "__b"])
    prev = F.coalesce(F.col("__prev"), F.col("__pmax"))
    d = d.withColumn("__start", F.when(prev.isNull() | (F.col("__us") >= prev + F.lit(gap_seconds * 1_000_000)), 1)
                                 .otherwise(0))
    d = prefix_sum(d, keys, F.col("__b"), order, "__start", out)
    return d.drop("__us", "__b", "__prev", "__pmax", "__start")
