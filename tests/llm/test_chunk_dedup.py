import hashlib

import numpy as np
from llm_cases import SF, none, odd  # noqa: F401

from codegauge.llm import chunk_dedup as C
from codegauge.llm.common import documents


def slow_cuts(b, least=C.LEAST, average=C.AVERAGE, most=C.MOST):
    """Byte by byte, with a true rolling hash."""
    gear = [int(x) for x in C._GEAR]
    ends, at, h = [], 0, 0
    cont = lambda i: i < len(b) and b[i] & 0xC0 == 0x80
    for i, x in enumerate(b):
        h = (h * 2 + gear[x]) % 2**32
        if i + 1 - at > most:
            e = at + most
            while cont(e):
                e -= 1
            ends.append(e)
            at = e
        if h < 2**32 // average and i + 1 - at >= least and not cont(i + 1):
            ends.append(i + 1)
            at = i + 1
    if at < len(b):
        return ends[:-1] + [len(b)] if ends and len(b) - at < least else ends + [len(b)]
    return ends


def brute(rows):
    least, chunks = {}, []
    for d, t in rows:
        b, at, own = (t or "").encode(), 0, []
        for e in slow_cuts(b):
            own.append(b[at:e])
            at = e
        chunks.append(own)
        if d is not None:
            for c in own:
                least[c] = min(d, least.get(c, d))
    out = []
    for (d, t), own in zip(rows, chunks):
        gone = [d is not None and (least[c] < d or c in own[:i]) for i, c in enumerate(own)]
        kept = b"".join(c for c, g in zip(own, gone) if not g)
        out.append((d, len((t or "").encode()), len(own), sum(len(c) for c, g in zip(own, gone) if g), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    return sorted(map(tuple, C.digests(C.repeated_chunks(docs)).collect()), key=str)


def test_whole_table(spark):
    docs = documents(spark, SF)
    assert run(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(odd, none):
    assert run(odd) == brute([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert run(none) == []


def test_cuts_come_back_after_an_insertion():
    r = np.random.default_rng(5)
    base = r.integers(97, 123, 20_000).astype(np.uint8)
    cut = lambda x: C.cuts(x, np.array([0, len(x)]))[0]
    a = cut(base)
    b = cut(np.r_[base[:5000], np.frombuffer(b"inserted", np.uint8), base[5000:]])
    moved = {e - 8 for e in b if e > 5008}
    late = [e for e in a if e > 5000]
    assert len(moved & set(late)) >= len(late) - 12


def test_repeated_passage_is_caught(spark):
    r = np.random.default_rng(9)
    words = lambda n: " ".join("".join(r.choice(list("abcdefgh"), r.integers(2, 9))) for _ in range(n))
    passage = words(60)
    rows = [(i, f"{words(40)} {passage} {words(30)}") for i in range(20)] + [(100 + i, words(100)) for i in range(20)]
    got = {x.doc_id: x for x in C.repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_removed >= 32 for i in range(1, 20)) and all(got[i].n_removed == 0 for i in [0, *range(100, 120)])


def test_short_ending_belongs_to_the_chunk_before():
    r = np.random.default_rng(4)
    for _ in range(300):
        b = bytes(r.integers(97, 123, int(r.integers(1, 900))).astype(np.uint8))
        ends = C.cuts(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
        assert ends == slow_cuts(b) and ends[-1] == len(b)
        assert all(z - a >= C.LEAST for a, z in zip([0, *ends], ends)) or len(ends) == 1


def test_shared_ending_alone_is_kept(spark):
    body = lambda seed: "".join(chr(97 + x) for x in np.random.default_rng(seed).integers(0, 26, 700))
    docs = spark.createDataFrame([(i, body(i) + " the end") for i in range(40)], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in C.repeated_chunks(docs).collect())
