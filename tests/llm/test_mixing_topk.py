from collections import defaultdict

import duckdb
import numpy as np
import pytest
from llm_cases import SF, none, odd  # noqa: F401
from pyspark.sql import functions as F

from codegauge.llm import mixing, topk
from codegauge.llm import queries as Q


def test_targets_and_sums(spark):
    rows = mixing.mix_sources(Q.documents(spark, SF)).collect()
    per, largest, target, size = defaultdict(int), defaultdict(int), {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        per[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        target[r.source], size[r.source] = r.target, r.source_size
    weight = dict(zip(sorted(size), [5, 2, 1] * 10))
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    free = {target[s] / weight[s] for s in size if target[s] < 2 * size[s] - 1e-6}
    assert max(free) - min(free) < 1e-6 * max(free)
    assert all(2 * size[s] / weight[s] <= max(free) + 1e-6 for s in size if target[s] >= 2 * size[s] - 1e-6)
    assert all(abs(per[s] - target[s]) <= largest[s] / 2 + 1 for s in size)


def test_odd_rows_and_reruns(odd, none):
    one = sorted(map(str, mixing.mix_sources(odd).collect()))
    assert one == sorted(map(str, mixing.mix_sources(odd).collect())) and len(one) == odd.count()
    assert mixing.mix_sources(none).collect() == []
    assert mixing.mix_sources(odd.where("doc_id in (3, 4)")).agg(F.sum("taken")).first()[0] == 0


def test_all_clamped(odd):
    rows = mixing.mix_sources(odd, share=5.0).collect()
    assert all(r.copies == 2 for r in rows if r.source_size)


VECTORS = [(0, [1.0, 0.5]), (100, [1.0, 0.5]), (200, [0.0, 0.0]), (300, None), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [0.5]), (400, [0.25]),
           (4, []), (None, [1.0, 1.0]), (5, [1.0, 0.5]), (6, [1.0, 0.5]), (6, [1.0, 0.5]), (7, [-1.0, float("inf")]), (500, [-3.0, 1e6])]


def brute(rows, k):
    ok = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in ok if i % 100 == 0}.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def found(df, k, **kw):
    v = topk.quantised(df)
    return sorted(map(tuple, topk.top_k(v, v.where("vec_id % 100 = 0"), k, **kw).collect()))


def test_topk_odd(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("v", F.lit(0))
    assert found(df, 3) == brute(VECTORS, 3)
    assert found(df.where("false"), 3) == []


def test_topk_blocks(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(spark.read.parquet(f"{SF}/embeddings.parquet"), 7, query_block=2, candidate_block=50) == brute(rows, 7)


def test_bounds_prune_without_loss():
    r = np.random.default_rng(1)
    c = r.integers(-900, 900, (9000, 40))
    q = c[:3] + r.integers(-5, 5, (3, 40))
    got = topk.scan_block(np.arange(-3, 0), q, np.arange(9000), c, 10)
    want = q @ c.T
    for i in range(3):
        assert got[2][i * 10:i * 10 + 10] == sorted(want[i], reverse=True)[:10]


def test_floors_keep_ties_and_drop_the_rest():
    c = np.array([[1, 0], [2, 0], [2, 0], [3, 0], [0, 5]])
    q = np.array([[10, 0]])
    got = topk.scan_block(np.array([-1]), q, np.arange(5), c, 2, [20])
    assert sorted(zip(got[1], got[2])) == [(1, 20), (3, 30)]
    assert topk.scan_block(np.array([-1]), q, np.arange(5), c, 2, [31])[1] == []
    big = 2 ** 60
    far = topk.scan_block(np.array([-1]), np.array([[1, 1]]), np.arange(2), np.array([[big, 1], [big, 0]]), 1, [big + 1])
    assert far[1:] == ([0], [big + 1])


@pytest.mark.parametrize("name", ["op7_mixing", "op8_topk"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a = Q.QUERIES[name](spark, SF)
    assert sorted(map(tuple, a.collect())) == sorted(c.sql(f"select {', '.join(a.columns)} from ({Q.ORACLE[name]})").fetchall())
