import math
from collections import Counter, defaultdict

import pytest
from llm_cases import SF, none, odd  # noqa: F401
from pyspark.sql import functions as F

from codegauge.llm import quality as K
from codegauge.llm import queries as Q
from codegauge.llm.common import documents


def grams(text, n=K.ORDER):
    b = b"\n" * (n - 1) + text.encode()
    return [b[i:i + n] for i in range(len(b) - n + 1)]


class Brute:
    """Interpolated modified Kneser-Ney, straight from its definition."""

    def __init__(self, texts):
        self.a = {K.ORDER: Counter(g for t in texts for g in grams(t))}
        for n in range(K.ORDER - 1, 0, -1):
            self.a[n] = Counter(g[1:] for g in self.a[n + 1])
        self.d, self.ctx = {}, {}
        for n, a in self.a.items():
            t = [sum(c == k for c in a.values()) for k in range(6)]
            y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else None
            self.d[n] = [0.0] + [min(max(k - (k + 1) * y * t[k + 1] / t[k], 0.1), k - 0.05) if y is not None and t[k] else min(max(0.5 * k, 0.1), k - 0.05) for k in (1, 2, 3)]
            self.ctx[n] = defaultdict(list)
            for g, c in a.items():
                self.ctx[n][g[:-1]].append(c)

    def p(self, g):
        if not g:
            return 1 / 256
        n, below = len(g), self.p(g[1:])
        seen = self.ctx[n].get(g[:-1])
        if not seen:
            return below
        c, d = self.a[n][g], self.d[n]
        return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in seen) * below) / sum(seen)


def test_perplexities_equal_brute_force(spark, odd):
    docs = documents(spark, SF).select("doc_id", "text", "lang").limit(60).union(odd.select(F.col("doc_id") + 10_000, "text", "lang"))
    train = docs.where("doc_id % 3 = 0 and text is not null")
    texts = defaultdict(list)
    for r in train.collect():
        texts[r.lang].append(r.text)
    models = {lang: Brute(t) for lang, t in texts.items() if lang in ("en", "fr")}
    pool = Brute([t for x in texts.values() for t in x])
    model = K.KneserNey(K.count_grams(train.select("text", "lang")))
    rows = K.log_likelihood(docs, model, [K.lang_code("en"), K.lang_code("fr")], ["doc_id", "lang", "text"]).collect()
    assert len(rows) == docs.count()
    memo = {}
    for r in rows:
        m = models.get(r.lang, pool)
        want = 0.0
        for g in grams(r.text or ""):
            if (id(m), g) not in memo:
                memo[id(m), g] = -math.log2(m.p(g))
            want += memo[id(m), g]
        assert r.n_bytes == len((r.text or "").encode()) and r.bits == pytest.approx(want, rel=1e-6)


def test_each_context_sums_to_one(spark):
    m = Brute([r.text for r in documents(spark, SF).limit(20).collect()])
    for ctx in (b"\n\n\n\n", b" the", b"zzzz"):
        assert sum(m.p(ctx + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_separates_junk(spark):
    d = "/root/testdata/sf0.01"
    got = Q.QUERIES["op4_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rate = {r.quality: r.r for r in got.groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("r")).collect()}
    assert rate[1] > 0.985 and rate[0] < 0.5


def test_few_bad_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    rows = Q.QUERIES["op4_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").join(documents(spark, d).select("doc_id", "text"), "doc_id").collect()
    rate = lambda some: sum(r.accepted for r in some) / len(some)
    bad = [r for r in rows if r.quality == 0]
    thrice = lambda w: any(a == b == c for a, b, c in zip(w, w[1:], w[2:]))
    repeated = [r for r in bad if thrice((r.text or "").split())]
    assert len(repeated) > 5 and rate(bad) < 0.05 and rate(repeated) < 0.2
    assert rate([r for r in rows if r.quality == 1 and not r.toxic]) > 0.985


def test_cuts_see_all_trusted_documents(spark):
    """A rare language keeps its own model and cut when the training sample is bounded, and the cuts see all that were not trained on."""
    docs = documents(spark, SF).where("text is not null and length(text) between 20 and 2000").select("doc_id", "text").limit(150).withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "b").otherwise("a"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    texts = docs.collect()
    hashes = {r.doc_id: (r.h, r.u) for r in docs.select("doc_id", F.expr("pmod(xxhash64(doc_id), 5)").alias("h"), F.expr("pmod(xxhash64(doc_id, 1), 1 << 30)").alias("u")).collect()}
    n = Counter(r.lang for r in texts if hashes[r.doc_id][0])
    sizes = K.sample_sizes({K.lang_code(c): x for c, x in n.items()}, 24, 5)
    assert 5 <= n["b"] < 24 < n["a"] and sizes[K.lang_code("b")] == min(n["b"], 12)
    trained = {r.doc_id for r in texts if hashes[r.doc_id][0] and hashes[r.doc_id][1] < sizes[K.lang_code(r.lang)] / n[r.lang] * (1 << 30)}
    got = K.quality(docs, labels, keep=["doc_id", "lang"], max_trusted=24, min_docs=5).collect()
    for lang in "ab":
        m = Brute([r.text for r in texts if r.lang == lang and r.doc_id in trained])
        bits = {r.doc_id: sum(-math.log2(m.p(g)) for g in grams(r.text)) for r in texts if r.lang == lang}
        size = {r.doc_id: len(r.text.encode()) for r in texts}
        x = sorted(bits[d] / size[d] for d in bits if d not in trained)
        mid, high = (x[math.ceil(q * len(x)) - 1] for q in (0.5, 0.9))
        cut = mid + 3.5 * (high - mid)
        for r in got:
            if r.lang == lang:
                assert r.threshold == pytest.approx(2 ** cut, rel=1e-6)
                assert r.perplexity == pytest.approx(2 ** (bits[r.doc_id] / size[r.doc_id]), rel=1e-6)
                assert r.accepted == ((bits[r.doc_id] + 50 * mid) / (size[r.doc_id] + 50) <= cut)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 1, 0), (8, 1, 1), (9, None, 0), (None, 1, 0), (10, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int").withColumn("code", F.lit("x"))
    for lab in (labels, labels.where("false")):
        got = K.quality(odd, lab, keep=["doc_id", "lang"], hold_out=2).collect()
        assert len(got) == odd.count()
        assert all(r.accepted and r.perplexity is None for r in got if not r.n_bytes)
    assert all(r.accepted for r in got)
    assert K.quality(none, labels).collect() == []
