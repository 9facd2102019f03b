"""J8 by pairs and by bitmaps: the same counts, and no pairs at a hub."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codegauge.operators import graph as G

EDGE = "project_id LONG, src STRING, dst STRING, relation_type STRING"


def brute(edges, files):
    pred = defaultdict(set)
    for p, a, b in edges:
        pred[p, b].add(a)
    out = {}
    for p, f in files:
        d = pred[p, f]
        two = set().union(*[pred[p, m] for m in d]) if d else set()
        out[p, f] = (len(d), len(two), len(d) + len(two))
    return out


@pytest.mark.parametrize("hub_pairs", [0, 6, 40, 1 << 16])
def test_bitmaps_and_pairs_agree(spark, hub_pairs):
    r = random.Random(3)
    edges = {(r.choice([1, 2]), f"n{int(r.paretovariate(0.6)) % 40}", f"n{int(r.paretovariate(0.6)) % 40}") for _ in range(400)}
    edges |= {(1, "n1", "n1"), (1, "n1", "n2"), (1, "n2", "n1")}  # cycles
    files = [(p, f"n{i}") for p in (1, 2) for i in range(42)]
    df = spark.createDataFrame([(*e, "imports") for e in edges] + [(1, "n1", "n1:x", "contains")], EDGE)
    rows = G.change_impact(spark.createDataFrame(files, "project_id LONG, path STRING"), df, hub_pairs).collect()
    assert {(x.project_id, x.target): (x.direct_impact, x.indirect_impact, x.total_impact_files) for x in rows} == brute(edges, files)
    assert len(rows) == len(files)


def test_hub_makes_no_pairs(spark):
    """10,000 files import a hub that imports 10,000 files: 10**8 pairs, but 10,000 targets with one bitmap each."""
    n = 10_000
    i = spark.range(n).select(F.col("id").cast("string").alias("i"))
    to = i.select(F.lit(1).cast("long").alias("project_id"), F.concat(F.lit("a"), "i").alias("src"), F.lit("hub").alias("dst"), F.lit("imports").alias("relation_type"))
    off = i.select(F.lit(1).cast("long").alias("project_id"), F.lit("hub").alias("src"), F.concat(F.lit("b"), "i").alias("dst"), F.lit("imports").alias("relation_type"))
    files = off.select("project_id", F.col("dst").alias("path"))
    start = time.time()
    got = G.change_impact(files, to.unionByName(off)).groupBy("direct_impact", "indirect_impact").count().collect()
    assert [tuple(r) for r in got] == [(1, n, n)]
    assert time.time() - start < 60
