import numpy as np
from llm_cases import SF  # noqa: F401
from pyspark.sql import functions as F

from codegauge.llm import lattice as L


def brute(rows, threshold=0.9):
    ok = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: set() for i in range(len(rows))}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, i in enumerate(ok):
        x = np.array(rows[i][1], np.float32).astype(float)
        for j in ok[:a]:
            y = np.array(rows[j][1], np.float32).astype(float)
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[i].add(j)
                links[j].add(i)
                p, q = find(rows[i][0]), find(rows[j][0])
                root[max(p, q)] = min(p, q)
    return sorted(((d, len(links[i]), None if d is None else find(d), d is not None and find(d) == d) for i, (d, _) in enumerate(rows)), key=str)


def run(df, **kw):
    return sorted(map(tuple, L.near_duplicates(df, **kw).collect()), key=str)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert run(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def groups(n_groups, size, cos, seed, dim=48):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n_groups):
        x = r.normal(size=dim)
        x /= np.linalg.norm(x)
        for _ in range(size):
            n = r.normal(size=dim)
            n -= (n @ x) * x
            n /= np.linalg.norm(n)
            out.append((cos * x + np.sqrt(1 - cos * cos) * n) * r.uniform(0.1, 50))
    return [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(out)]


def test_tight_groups_are_exact_over_chunks(spark):
    rows = groups(6, 25, 0.995, 1) + groups(200, 1, 1.0, 2)
    rows = [(i, v) for i, (_, v) in enumerate(rows)] + [(900, rows[0][1]), (901, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    assert run(df) == want
    assert run(df, chunk=7) == want


def test_recall_near_the_threshold(spark):
    rows = groups(400, 2, 0.975, 3)  # pairs of cosine about 0.95, of which some fall near 0.9
    r = np.random.default_rng(4)
    pairs = []
    for i in range(500):
        c = r.uniform(0.9, 0.92)
        x, n = r.normal(size=(2, 48))
        x /= np.linalg.norm(x)
        n -= (n @ x) * x
        n /= np.linalg.norm(n)
        pairs += [(2000 + 2 * i, x.tolist()), (2001 + 2 * i, (c * x + np.sqrt(1 - c * c) * n).tolist())]
    df = spark.createDataFrame(rows + pairs, "vec_id long, embedding array<float>")
    got, want = run(df), brute([(i, [float(np.float32(y)) for y in v]) for i, v in rows + pairs])
    have, all_ = sum(g[1] for g in got), sum(w[1] for w in want)
    assert have <= all_ and have >= 0.97 * all_


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [inf, 0.0]), (None, [1.0, 0.0]), (9, [1.0]), (10, [1e-30, 1e-32]), (11, [1e30, 1e28]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    got = run(df)
    assert got == brute(rows) and len(got) == len(rows)
    assert run(df.where("false")) == []


def test_decode_is_nearest():
    r = np.random.default_rng(7)
    y = r.uniform(-2, 2, (300, 8))
    p, roots = L.decode(y), L.roots()
    assert len(np.unique(roots, axis=0)) == 240 and np.allclose((roots ** 2).sum(axis=1), 2)
    near = ((y[:, None] - p[:, None] - roots[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((y - p) ** 2).sum(axis=1) <= near + 1e-12).all() and (((y - p) ** 2).sum(axis=1) <= 1 + 1e-9).all()
    assert (np.rint(p.sum(axis=1)).astype(int) % 2 == 0).all()
