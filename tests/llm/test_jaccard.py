import re

import numpy as np
import pytest
from llm_cases import SF, none, odd  # noqa: F401
from pyspark.sql import functions as F

from codegauge.llm import jaccard as J
from codegauge.llm import queries as Q
from codegauge.llm.common import documents


def sets_of(rows, k):
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append((d, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def brute(rows, k=3, num=90, den=100):
    sets = sets_of(rows, k)
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def run(docs, *a):
    return sorted(map(tuple, J.jaccard_components(docs, *a).collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_whole_table(spark):
    docs = documents(spark, SF)
    assert run(docs) == brute(rows_of(docs))


def test_odd_rows(odd, none):
    assert run(odd) == brute(rows_of(odd))
    assert run(none) == []


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (2, 80, 100), (5, 80, 100)])
def test_near_copies_at_the_threshold(spark, monkeypatch, k, num, den):
    """Groups whose members differ in a few words each, so that links, misses and chains all occur; tiny chunks."""
    monkeypatch.setattr(J, "CHUNK", 5)
    r = np.random.default_rng(4)
    rows, i = [], 0
    for size in (3, 8, 20, 40, 90, 200):
        base = [f"w{x}" for x in r.integers(0, 5000, size)]
        for _ in range(25):
            w = list(base)
            for p in r.choice(size, r.integers(0, max(2, size // 18)), replace=False):
                w[p] = f"x{r.integers(0, 4)}"
            rows.append((i, " ".join(w)))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert run(docs, k, num, den) == brute(rows, k, num, den)


def test_tiles_and_bounds_lose_nothing():
    bands = J.Bands(90, 100)
    r = np.random.default_rng(2)
    for n in (1, 5, 19, 60, 300):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(30):
            b = a.copy()
            b[r.choice(len(a), r.integers(0, 1 + len(a) // 12), replace=False)] = r.integers(0, 2**63, 1).astype(np.uint64)[0]
            b = np.unique(np.r_[b, r.integers(0, 2**63, r.integers(0, 1 + n // 25)).astype(np.uint64)])
            o = len(np.intersect1d(a, b))
            for wa, wb in ((64, 64), (256, 64), (64, 1024)):
                x, y = (np.frombuffer(J.bitmap(v, w), np.uint64)[None] for v, w in ((a, wa), (b, wb)))
                assert J.bitmap_bound(len(a), *J.folded(x, y), len(b))[0] >= o
            if J.reaches(o, len(a), len(b), 90, 100):
                assert len(np.intersect1d(J.tiles(a, bands), J.tiles(b, bands)))


def test_sql(spark):
    import duckdb
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = duckdb.sql(f"select doc_id, n_shingles, component_id from ({Q.ORACLE['op9_jaccard']})").fetchall()
    assert sorted(map(tuple, Q.QUERIES["op9_jaccard"](spark, SF).collect())) == sorted(want)


def test_short_texts_with_a_common_half_share_no_tile():
    """Sets that can only be equal, and sets of which one part of three is the same."""
    bands = J.Bands(90, 100)
    words = lambda n, i: " ".join([f"c{x}" for x in range(n // 2)] + [f"d{x}-{i}" for x in range(n - n // 2)])
    for n in (4, 8, 14):
        texts = [words(n, i).encode() for i in range(400)]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
        keys = np.concatenate([np.unique(J.tiles(s, bands)) for s in J.ngram_sets(data, offsets, 3)])
        assert np.unique(keys, return_counts=True)[1].max() <= 40  # pairs of parts agree by chance only


def test_many_short_texts_with_a_common_half(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("zeta yota x d"), (F.col("id") % 15000).cast("string")).alias("text"))
    got = J.jaccard_components(docs)
    assert got.where("component_id <> doc_id % 15000").count() == 0
