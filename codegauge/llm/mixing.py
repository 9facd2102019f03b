"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

BUCKET_DIGITS = 3


def word_count(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_weights(sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Weight of each source: ``cycle`` repeats over the sources by code point, null last. One row per source."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((rank - 1) % len(cycle) + 1).cast("int")))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``target`` of each source (source_size, weight): shares of ``total`` by weight, clamped at
    ``max_epochs * source_size``, the excess reshared by weight until none is above its clamp.

    Each round is one aggregate over the sources and brings three numbers to the driver. A source
    stays clamped once its share passes its clamp, so the rounds end after at most one per source.
    If all clamps together fall short of ``total``, every source ends at its clamp. No words at all
    give targets of 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    rest, weight, clamped = None, None, -1
    over = F.lit(False)
    while True:
        n, used, free = sources.agg(F.sum(F.when(over, 1).otherwise(0)), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not n and used is None or n == clamped:
            break
        clamped, rest, weight = n, total - used, free
        if not weight:
            break
        over = F.lit(rest) * F.col("weight") > cap * F.lit(weight)
    share = F.lit(rest) * F.col("weight") / F.lit(weight) if weight else cap
    return sources.withColumn("target", F.when(over, cap).otherwise(share) if weight else cap)


def mix_sources(docs: DataFrame, size: F.Column | None = None, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                max_epochs: float = 2.0, seed: int = 7, keep: list[str] = ()) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, weight, target, copies, taken (and ``keep``).

    ``size`` defaults to the words of ``text``. A source with ``target`` = r * source_size takes
    floor(r) whole repetitions of each document and one more of the documents that come first in a
    seeded hash order, up to the point nearest to the target (within half a document); so no document
    is taken more than ceil(max_epochs) times. Documents without words get copies like the others but
    add nothing. The order (source, hash, size, text and ``keep`` columns) is cut into even ranges by Spark, and
    running sums are two-level: over the ranges of a source, then inside a range. So neither a source nor an
    id (null, say) with a third of all rows is one group, and the groups grow in number, not in size.

    Null sources are one source, the last; null texts have size 0; a null doc_id is hashed as
    'null'. Rows that share an id follow by size and text, so reruns agree whatever the order of the input. Repeated rows are
    rows of their own. An empty table gives no rows.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    kept = [F.col(c) for c in keep]
    tie = F.xxhash64("text", *kept) if "text" in docs.columns else F.xxhash64(F.lit(0), *kept)
    rows = docs.select("doc_id", "source", size.alias("size"), key.alias("at"), tie.alias("tie"), F.monotonically_increasing_id().alias("row"), *kept)
    order = ["at", "size", "tie", "row"]  # only equal rows are told apart by their number in the input
    rows = written(rows.repartitionByRange("source", *order).withColumn("part", F.spark_partition_id()), "mix")
    sources = written(source_weights(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycle), "sources")
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    filled = water_fill(sources, total, max_epochs)
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    plan = sums.alias("s").join(filled.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source"))).select("s.source", "part", "before", "source_size", "weight", "target")
    d = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part")))
    inside = F.sum("size").over(W.partitionBy("d.source", "d.part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    d = d.select("doc_id", "d.source", "size", "source_size", "weight", "target", whole.alias("whole"), (F.col("before") + F.coalesce(inside, F.lit(0))).alias("start"), *[F.col(f"d.{c}") for c in keep])
    more = (2 * F.col("start") + F.col("size")).cast("double") <= 2.0 * (F.col("target") - F.col("whole") * F.col("source_size"))
    copies = F.least(F.col("whole") + F.when(more & (F.col("target") > F.col("whole") * F.col("source_size")), 1).otherwise(0), F.lit(math.ceil(max_epochs))).cast("int")
    return d.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "weight", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *keep)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS at FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k,
             1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
c AS (SELECT k AS ck, rest AS crest, free AS cfree FROM o WHERE rest * weight <= 2.0::DOUBLE * source_size * free ORDER BY k LIMIT 1),
f AS (SELECT source, source_size, CASE WHEN ck IS NULL OR k < ck THEN 2.0::DOUBLE * source_size ELSE crest * weight / cfree END AS target FROM o LEFT JOIN c ON true),
r AS (SELECT d.doc_id, d.size, f.source_size, f.target, CASE WHEN f.source_size > 0 THEN floor(f.target / f.source_size)::BIGINT ELSE 0 END AS whole,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       (least(whole + CASE WHEN target > whole * source_size AND (2 * start + size)::DOUBLE <= 2.0::DOUBLE * (target - whole * source_size) THEN 1 ELSE 0 END, 2) * size)::BIGINT AS taken
FROM r
"""
