"""Exact top-k search by inner product: columnar branch-and-bound over dimension blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship_code, written

DIM_BLOCK = 8
CHUNK = 2048
EXACT = 2.0 ** 52


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a non-null, non-empty vector without null, NaN or infinite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)


def scan_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floors: list | None = None) -> tuple[list, list, list]:
    """Best ``k`` candidates of one block for each query row: (query ids, candidate ids, scores). With ``floors`` (None: unknown), scores that k
    candidates elsewhere reach, candidates below are left out.

    The candidates lie in vertical layout (dimension by row). For a query the dimensions are visited
    by falling size of its components, a block at a time. After each block a candidate survives only
    if its score so far plus the largest possible rest, |rest of query| * |rest of candidate|, reaches the
    k-th best full score known; survivors are compacted before the next block.
    """
    out_q: list = []
    out_c: list = []
    out_s: list = []
    exact_float = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < EXACT
    kind = np.float64 if exact_float else object
    cols = np.ascontiguousarray(c.T.astype(kind))
    square = np.ascontiguousarray(c.T.astype(np.float64)) ** 2
    total = square.sum(axis=0)
    dims = q.shape[1]
    for row in range(len(q)):
        v = q[row].astype(kind)
        order = np.argsort(-np.abs(q[row]), kind="stable")
        left = np.sqrt(np.cumsum((q[row][order].astype(np.float64) ** 2)[::-1])[::-1])
        best_s = np.zeros(0, kind)
        best_c = np.zeros(0, np.int64)
        for lo in range(0, len(c), CHUNK):
            alive = lo + np.flatnonzero(c_ids[lo:lo + CHUNK] != q_ids[row])
            score = np.zeros(len(alive), kind)
            mass = total[alive].copy()
            known = [x for x in (best_s.min() if len(best_s) >= k else None, floors[row] if floors else None) if x is not None]
            floor = max(known) if known else None
            for d in range(0, dims, DIM_BLOCK):
                part = order[d:d + DIM_BLOCK]
                score = score + v[part] @ cols[np.ix_(part, alive)]
                if floor is None or d + DIM_BLOCK >= dims:
                    continue
                mass -= square[np.ix_(part, alive)].sum(axis=0)
                bound = score.astype(np.float64) + left[d + DIM_BLOCK] * np.sqrt(np.maximum(mass, 0)) * (1 + 1e-9) + 1e-3 * (1 + 1e-9 * np.abs(score.astype(np.float64)))
                stay = bound >= float(floor)
                alive, score, mass = alive[stay], score[stay], mass[stay]
                if not len(alive):
                    break
            if floor is not None:
                stay = score >= floor
                alive, score = alive[stay], score[stay]
            best_s = np.concatenate([best_s, score])
            best_c = np.concatenate([best_c, c_ids[alive]])
            if len(best_s) > k:
                top = np.lexsort((best_c, -best_s))[:k]
                best_s, best_c = best_s[top], best_c[top]
        out_q += [q_ids[row]] * len(best_s)
        out_c += best_c.tolist()
        out_s += [int(x) for x in best_s]
    return out_q, out_c, out_s


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 2048, candidate_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of each query, ties to the smaller vec_id.

    Both inputs have (vec_id, v array<long>). The query set meets the rows in a grid of blocks:
    a query block and a candidate block form one task with bounded memory, returning at most ``k`` rows a
    query; a window for each query merges them. The first candidate block, a hash sample, is searched before the others: the k-th
    best score found there goes along with the query as the floor under which the other blocks prune from their first dimensions on.
    A query never meets its own vec_id; vectors of different
    lengths do not meet. Repeated vec_ids are separate candidates; a repeated query id stands once, with its
    smallest vector. No query or no candidates give no rows. Scores are exact 64-bit integers (sums beyond
    2**52 are added as Python integers).
    """
    ship_code(vectors.sparkSession)
    queries = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "top-queries")
    n_c, n_q = vectors.count(), queries.count()
    cb, qb = max(1, -(-n_c // candidate_block)), max(1, -(-n_q // query_block))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    right = vectors.select("vec_id", "v", F.size("v").alias("dim"), spread(cb).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    grid = ["dim", "qb", "cb"]

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        floors = [None if pd.isna(x) else int(x) for x in a["floor"].astype("object")]
        got = scan_block(a["vec_id"].to_numpy(np.int64), np.stack(a["v"].to_numpy()), b["vec_id"].to_numpy(np.int64), np.stack(b["v"].to_numpy()), k, floors)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got)))

    def search(asked: DataFrame, first: int, last: int) -> DataFrame:
        """The queries, with their floors as text (a double would round them), in candidate blocks ``first`` to ``last``."""
        left = asked.select("vec_id", "v", F.col("floor").cast("string").alias("floor"), F.size("v").alias("dim"), spread(qb).alias("qb"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("cb"))
        mine = right.where(F.col("cb").between(first, last))
        return left.groupBy(*grid).cogroup(mine.groupBy(*grid)).applyInPandas(cell, "query_id long, vec_id long, score long")

    best = search(queries.withColumn("floor", F.lit(None).cast("long")), 0, 0)
    if cb > 1:
        best = written(best, "top-first")
        floors = best.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "floor")
        best = best.union(search(queries.join(floors, "vec_id", "left"), 1, cb - 1))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v = floor(scale * x) of the usable vectors, x as double."""
    return usable(vectors).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


ORACLE_SQL = """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM u q JOIN u c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 10
"""
