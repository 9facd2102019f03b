import hashlib

import numpy as np
import pytest
from llm_cases import SF, none, odd  # noqa: F401

from codegauge.llm import queries as Q
from codegauge.llm import suffix_dedup as S
from codegauge.llm.common import documents
from codegauge.llm.suffix_sort import Suffixes


def brute(rows, length=50):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i:i + length]
                least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - length + 1):
                if least[b[i:i + length]] < d:
                    gone[i:i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, **kw):
    return sorted(map(tuple, S.digests(S.repeated_spans(docs, **kw)).collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_whole_table(spark):
    docs = documents(spark, SF)
    assert run(docs) == brute(rows_of(docs))


def test_odd_rows(odd, none):
    assert run(odd) == brute(rows_of(odd))
    assert run(none) == []


@pytest.mark.parametrize("hot", [4096, 1])
def test_shared_passages(spark, monkeypatch, hot):
    """Passages of 20 to 200 bytes in varied surroundings, over several blocks; both ways of sorting edges."""
    import codegauge.llm.suffix_dedup as m
    monkeypatch.setattr(m, "n_blocks", lambda *a, **k: 7)
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abé"), r.integers(1, 4)))
    passages = [" ".join(word() for _ in range(n)) for n in (6, 12, 16, 17, 18, 20, 40, 60)] + ["ab" * 40, "x" * 70]
    rows = []
    for i in r.permutation(160).tolist():
        parts = []
        for _ in range(r.integers(0, 6)):
            p = passages[r.integers(len(passages))]
            parts += [" ".join(word() for _ in range(r.integers(0, 12))), p[r.integers(0, 9):] if r.random() < .4 else p]
        rows.append((i, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(docs, hot=hot) == brute(rows)


def test_many_blocks_have_fewer_shards(spark, monkeypatch):
    """A shard of many blocks sorts its suffixes part by part; the pairs of blocks and shards grow a quarter as fast as the blocks' square."""
    import codegauge.llm.suffix_dedup as m
    assert [m.n_shards(n) for n in (1, 20, 64, 1200)] == [1, 20, 32, 300]
    monkeypatch.setattr(m, "n_blocks", lambda *a, **k: 90)
    monkeypatch.setattr(m, "n_shards", lambda blocks: 2)
    r = np.random.default_rng(4)
    passages = ["".join(r.choice(list("abc "), 70)) for _ in range(60)]
    rows = [(i, "".join(r.choice(list("abc "), r.integers(0, 30)).tolist() + [passages[j][r.integers(0, 12):] for j in r.integers(0, 60, 3)])) for i in range(150)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_characters_cut_in_half(spark):
    rows = [(1, "q" * 49 + "é"), (2, "q" * 49 + "ã")]  # equal up to the first byte of the last character
    got = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.spans, bytes(r.kept), r.kept_text) for r in got][1] == ([(0, 50)], b"\xa3", "ã") and got[0].kept_text == rows[0][1]


def test_runs_end_with_their_text(spark, monkeypatch):
    """All texts of a block are cut at once: runs that touch across texts, empty texts and characters of four bytes stay apart."""
    import codegauge.llm.suffix_dedup as m
    monkeypatch.setattr(m, "n_blocks", lambda *a, **k: 1)
    p = "".join("\U0001F600éa€"[i * i % 4] for i in range(40))
    rows = [(1, p), (2, p), (3, ""), (4, None), (5, "z" + p), (6, p[1:] + "y"), (7, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.repeated_spans(docs).collect()}
    n = len(p.encode())
    assert {d: [tuple(x) for x in r.spans] for d, r in got.items()} == {1: [], 2: [(0, n)], 3: [], 4: [], 5: [(1, n + 1)], 6: [(0, n - 4)], 7: []}
    assert {d: r.kept_text for d, r in got.items()} == {1: p, 2: "", 3: "", 4: "", 5: "z", 6: "y", 7: "short"}
    assert run(docs) == brute(rows)


def test_long_document_in_pieces(spark, monkeypatch):
    import codegauge.llm.suffix_dedup as m
    r = np.random.default_rng(3)
    base = "".join(r.choice(list("abcd "), 2000))
    rows = [(1, base), (2, "zz" + base[300:1700] + "q" * 60), (3, base[::-1]), (4, base[900:1100])]
    b = m.Block
    import pyarrow as pa
    t = pa.table({"block": pa.array([0] * 4, pa.int32()), "doc_id": [x[0] for x in rows], "text": [x[1] for x in rows]})
    whole = b(t, 50, 24)
    monkeypatch.setattr(m, "PIECE", 97)
    pieces = b(t, 50, 24)
    def windows(x):
        return {(i, g) for lo, hi, g in zip(x.lo, x.hi, x.gram) for i in range(lo, hi + 1)}
    assert windows(whole) == windows(pieces)


def test_suffix_sort_equals_sorted():
    r = np.random.default_rng(6)
    data = r.choice(np.frombuffer(b"ab", np.uint8), 5000)
    starts = r.choice(4900, 3000, replace=False)
    segment = np.sort(r.integers(0, 40, 3000))
    s = Suffixes(data, starts, 30)
    order = s.sort(segment)
    head = lambda x: data[starts[x]:starts[x] + 30].tobytes()
    want = sorted(range(3000), key=lambda x: (segment[x], head(x), x))
    assert order.tolist() == want
    run = s.equal_runs(order, segment)
    assert all((run[i] == run[i + 1]) == (segment[order[i]] == segment[order[i + 1]] and head(order[i]) == head(order[i + 1])) for i in range(2999))


def test_equal_suffixes_are_sorted_once(monkeypatch):
    """A passage that 2,000 documents share costs the comparisons of one suffix."""
    compared = []
    before = Suffixes.before
    monkeypatch.setattr(Suffixes, "before", lambda self, a, b, or_equal: compared.append(len(a)) or before(self, a, b, or_equal))
    data = np.frombuffer(b"the same words again " * 2000 + b"other words " * 4, np.uint8)
    starts = np.r_[np.arange(2000) * 21, 42000, 42012]
    s = Suffixes(data, starts, 20)
    order = s.sort(np.zeros(2002, int))
    assert order.tolist() == [2000, 2001, *range(2000)] and sum(compared) < 10
    assert s.equal_runs(order, np.zeros(2002, int)).tolist() == [0, 0] + [1] * 2000


def test_collisions_are_verified(monkeypatch):
    """With a useless hash every comparison says equal; the byte check must still part them."""
    data = np.frombuffer(b"abcdefgh" * 3 + b"abcdxfgh", np.uint8)
    s = Suffixes(data, np.array([0, 8, 24, 16]), 8)
    s.hashes = lambda at, size: np.zeros(len(at), np.uint64)
    order = np.arange(4)
    run = s.equal_runs(order, np.zeros(4, int))
    assert [run[order.tolist().index(i)] for i in (0, 1, 3)] == [run[order.tolist().index(0)]] * 3
    assert run[order.tolist().index(2)] != run[order.tolist().index(0)]


def test_query(spark):
    assert Q.QUERIES["op1_suffix_dedup"](spark, SF).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
