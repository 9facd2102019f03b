import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from llm_cases import SF, none, odd  # noqa: F401
from pyspark.sql import functions as F

from codegauge.llm import merkle
from codegauge.llm import queries as Q


def h(*x):
    return sha256("".join(x).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Root and proofs [(place, others)] of a list of digests, level by level."""
    proofs, where, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, w in enumerate(where):
            run = level[w // 8 * 8:w // 8 * 8 + 8]
            proofs[i].append((w % 8, run[:w % 8] + run[w % 8 + 1:]))
        level = [h(*level[k:k + 8]) for k in range(0, len(level), 8)]
        where = [w // 8 for w in where]
    return (level[0] if level else None), proofs


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        v = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]]
        low = None if r["text"] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        by[r["lang"]].append((r["doc_id"], leaf(v), leaf([*v[:4], low]) if hit else leaf(v)))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for n in names:
        by[n].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = [tree([x[1] for x in by[n]]) for n in names]
    root, above = tree([b[0] for b in built])
    out = []
    for n, (sub, proofs), up in zip(names, built, above):
        for (i, was, now), p in zip(by[n], proofs):
            whole = [*p, *up]
            d = now
            for at, others in whole:
                d = h(*others[:at], d, *others[at:])
            out.append((i, was, sub, root, h(*[x for _, o in whole for x in o]), d, d == root))
    return Counter(out)


def test_equals_brute_force(spark):
    rows = Q.documents(spark, SF).collect()
    got = Q.QUERIES["op11_merkle"](spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == brute(rows)
    assert 0 < got.where("verified").count() < len(rows)


def test_odd_rows(odd, none):
    rows = odd.withColumn("n_chars", F.length("text"))
    want = brute([r.asDict() for r in rows.collect()])
    assert Counter(map(tuple, merkle.audit(merkle.manifest(merkle.tampered(rows), keep=("now",))).collect())) == want
    assert merkle.audit(merkle.manifest(merkle.tampered(none.withColumn("n_chars", F.lit(1))), keep=("now",))).collect() == []
    one = rows.where("doc_id = 6")
    r = merkle.manifest(merkle.tampered(one), keep=("now",)).first()
    assert r.leaf == r.subroot == r.root and r.proof == []


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_many_rounds_and_blocks(spark, levels):
    """Blocks of 8, 64 and 4,096 leaves; one tree holds most rows, some trees a single one, and many rows are equal."""
    rows = spark.range(1500).select((F.col("id") % 700).alias("doc_id"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"), F.lit("Same").alias("text"),
                                    F.when(F.col("id") % 700 > 20, "en").when(F.col("id") > 10, F.concat(F.lit("é"), (F.col("id") % 13).cast("string"))).alias("lang"))
    got = merkle.audit(merkle.manifest(merkle.tampered(rows), keep=("now",), levels=levels))
    assert Counter(map(tuple, got.collect())) == brute([r.asDict() for r in rows.collect()])


def test_proof_detects_any_change(spark):
    rows = merkle.manifest(merkle.tampered(Q.documents(spark, SF)), keep=("now",))
    bad = rows.withColumn("x", merkle.fold(F.sha2("leaf", 256), F.col("proof"))).where("x = root")
    assert bad.count() == 0
    assert rows.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_heights():
    assert [merkle.height(n) for n in (0, 1, 2, 8, 9, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]


def test_sql(spark):
    import duckdb
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert Counter(c.sql(Q.ORACLE["op11_merkle"]).fetchall()) == brute(Q.documents(spark, SF).collect())
