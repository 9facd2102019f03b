import math
import re
import zlib
from collections import Counter

import numpy as np
from llm_cases import SF, none, odd  # noqa: F401

from codegauge.llm import lm_score as L
from codegauge.llm.common import documents, mix64


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [""]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def brute(rows, order=2):
    """Exact base columns, and the score with counts quantised but no filter in between."""
    train = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    ones, twos = (sum(c == k for c in train.values()) for k in (1, 2))
    disc = ones / (ones + 2 * twos) if ones else 0.5
    grams = Counter()
    for d, t in rows:
        if not held(d):
            w = [""] * (order - 1) + tokens(t)
            for o in range(2, order + 1):
                grams.update(tuple(w[i - o + 1:i + 1]) for i in range(order - 1, len(w)))
    quant = {g: float(L.count_of(L.level(np.array([c])))[0]) for g, c in grams.items()}
    out = []
    for d, t in rows:
        w, total = [""] * (order - 1) + tokens(t), 0.0
        last = {}
        for i in range(order - 1, len(w)):
            c = train[w[i]]
            p = (c - disc if c else disc * v) / n if n else 1.0
            h, now = train[w[i - 1]], {}
            for o in range(2, order + 1):
                seen = now[o] = min(quant.get(tuple(w[i - o + 1:i + 1]), 0), h, c)
                if h:
                    p = (1 - L.WEIGHT) * p + L.WEIGHT * seen / h
                h = last.get(o, 0)
            last = now
            total += math.log10(p)
        w = w[order - 1:]
        out.append((d, held(d), len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), total))
    return out


def check(docs, share, order=2):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, L.lm_scores(docs, order=order).collect()), key=key), sorted(brute(rows, order), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    a, b = np.array([g[6] for g in got]), np.array([w[6] for w in want])
    assert len(a) == 0 or (np.abs(a - b) <= 0.01 * np.abs(b) + 1e-9).mean() >= share  # the filter errs now and then,
    assert order > 2 or (a >= b - 1e-6).all()  # and never to the low side
    return got


def test_whole_table(spark):
    got = check(documents(spark, SF), 0.9)
    out = [g for g in got if g[1]]
    assert sum(g[6] for g in out) > sum(g[5] for g in out)  # better than the base on texts it has not seen


def test_odd_rows(odd, none):
    check(odd, 0.6)
    check(odd, 0.6, order=3)
    assert L.lm_scores(none).collect() == []
    only = odd.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert all(math.isfinite(r.score) and r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in L.lm_scores(only).collect()) and only.count()


def test_filter_never_reads_low():
    r = np.random.default_rng(3)
    keys = np.unique(mix64(r.integers(0, 2**62, 20000).astype(np.uint64)))
    counts = np.maximum(1, (10 ** r.uniform(0, 6, len(keys))).astype(np.int64))
    f = L.Filter(keys, counts)
    read = f.read(keys)
    assert (read >= L.level(counts)).all() and (read == L.level(counts)).mean() > 0.95
    other = np.setdiff1d(mix64(r.integers(0, 2**62, 20000).astype(np.uint64)), keys)
    assert (f.read(other) > 0).mean() < 0.04


def test_probabilities_after_a_history_sum_to_at_most_one():
    """Over all known words and the unknown one, for every history of a small text, with the quantised counts of an error-free filter."""
    text = [w for t in ("a b a b a c a b d", "b a b a a a a a c", "c c c a b", "a") for w in tokens(t)]
    n, counts = len(text), Counter(text)
    v, ones, twos = len(counts), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    disc = ones / (ones + 2 * twos) if ones else 0.5
    pairs = Counter(zip(["", *text], text))
    read = {k: float(L.count_of(L.level(np.array([c])))[0]) for k, c in pairs.items()}
    assert all(read[k] <= c < L.BASE * read[k] for k, c in pairs.items())
    first = {w: (c - disc) / n for w, c in counts.items()} | {"?": disc * v / n}
    assert abs(sum(first.values()) - 1) < 1e-12
    for h, c in counts.items():
        total = sum((1 - L.WEIGHT) * p + L.WEIGHT * min(read.get((h, w), 0), c) / c for w, p in first.items())
        assert 1 - L.WEIGHT - 1e-9 <= total <= 1 + 1e-9


def test_levels_are_read_at_their_lower_end():
    c = np.array([0, 1, 2, 3, 4, 7, 8, 1000, 1 << 40])
    assert L.count_of(L.level(c)).tolist() == [0, 1, 2, 2, 4, 4, 8, 512, 1 << 40]
