import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm_cases import SF, none, odd  # noqa: F401
from pyspark.sql import functions as F

from codegauge.llm import collocations as C
from codegauge.llm import queries as Q

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, top=2000, absorb=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= absorb * often[p[i:j]]}
        rated = []
        for p, a in often.items():
            if p not in gone:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rated.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return Counter(out)


def found(df):
    return Counter(map(tuple, df.collect()))


def texts(df):
    return [(r.lang, r.text) for r in df.select("lang", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return Q.documents(spark, SF)


@pytest.mark.parametrize("kw", [{}, {"tile": 4, "dense": 3, "block_bytes": 9000}, {"tile": 64, "dense": 0, "block_bytes": 40000}])
def test_equals_brute_force(docs, kw, monkeypatch):
    """Small tiles and blocks: dense and sparse tiles, several rounds of sums, cuts inside long texts."""
    if kw:
        monkeypatch.setattr(C, "FAN", 4)
        monkeypatch.setattr(C, "FAN_SPARSE", 16)
        monkeypatch.setattr(C, "SLICE", 700)
    want = brute(texts(docs), 12)
    assert len(want) > 60 and max(len(r[2].split()) for r in want) > 2
    assert found(C.collocations(docs, least=12, **kw)) == want


def test_odd_rows(odd, none):
    for absorb in (100, 60):
        assert found(C.collocations(odd, least=2, absorb=absorb)) == brute(texts(odd), 2, absorb=absorb)
    assert found(C.collocations(odd, least=2, longest=2, top=1)) == brute(texts(odd), 2, longest=2, top=1)
    assert not found(C.collocations(none, least=1)) and not found(C.collocations(odd, least=10**6))


def test_separators_and_case(spark):
    rows = [("en", "A b\x0bA b\x0cA B\x85x y A\tb;a b"), (None, "A b"), ("und", "a B."), ("en", "É é A  b  :"), ("", "a b"), ("en", "\x1cA b\x1f a\x1eb")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(C.collocations(df, least=1)) == brute(rows, 1)


def test_products_beyond_64_bits(spark, monkeypatch):
    """Scores with counts of 10**9 and more, put in for those of a small text."""
    df = spark.createDataFrame([("en", "p q r. p q. s s")], "lang string, text string")
    every, totals = C.phrases(df, 1)
    big = every.withColumn("count", F.col("count") * 7_000_000_019).withColumn("before", F.transform("before", lambda x: x * 7_000_000_019))
    monkeypatch.setattr(C, "phrases", lambda *a, **k: (big, totals.withColumn("n", F.col("n") * 90_000_000_000_007)))
    got = {r.phrase: r for r in C.collocations(df, least=1).collect()}
    n = 7 * 90_000_000_000_007
    assert got["p q"].n == n and got["p q"].score == 1000 * 2 * 7_000_000_019 * n // (2 * 7_000_000_019) ** 2
    assert got["s s"].score == 1000 * 7_000_000_019 * n // (2 * 7_000_000_019) ** 2


def test_tiles_count_alike():
    r = np.random.default_rng(5)
    left, right = r.zipf(1.3, 50000) % 300, r.zipf(1.3, 50000) % 300
    key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
    for tile, dense in ((16, 4), (256, 2), (1024, 4), (8, 0)):
        got = Counter()
        for part, keys, counts in C.cells(key, tile, dense, 7):
            assert (np.diff(keys.astype(np.int64)) > 0).all()
            got.update(dict(zip(keys.tolist(), counts.tolist())))
        assert got == Counter(key.tolist())


def test_sql(spark):
    c = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = Q.QUERIES["op13_collocations"](spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found(got) == Counter(c.sql(Q.ORACLE["op13_collocations"]).fetchall())
