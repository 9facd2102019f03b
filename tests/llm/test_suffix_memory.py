"""What a block of the suffix-array dedup takes, and texts longer than a piece of it."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from codegauge.llm import suffix_dedup as SD


def block(texts):
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "block": pa.array([0] * len(texts), pa.int32())})


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_blocks_are_small():
    r = random.Random(4)
    texts = ["".join(r.choices("abcdefgh ", k=4000)) for _ in range(500)]
    t = block(texts)
    grams, most = peak(lambda: np.unique(np.concatenate([g[2] for g in SD.Block(t, 50, 24, group=False)._pieces(24)])))
    assert most < 17e6  # 23 MB when pieces of 256 KB were looked at
    b, most = peak(lambda: SD.Block(t, 50, 24))
    assert (b.grams == grams).all() and most < 14e6  # 17 MB with places of 8 bytes
    regions, most = peak(lambda: b.regions(np.arange(len(b.lo))))
    assert len(regions) == len(b.lo) and most < 14e6  # 23 MB when all digests were Python objects at once


def test_texts_longer_than_a_piece(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choices("abcdefgh é", k=n))
    shared = text(3000)
    long = text(SD.PIECE - 1500) + shared + text(2 * SD.PIECE)
    texts = [long, text(700) + shared[:2000] + text(100), text(SD.PIECE - 10) + shared + text(50), text(5) + long]
    seen, want = {}, {}
    for i, t in enumerate(texts):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - SD.LENGTH + 1):
            if seen.setdefault(raw[k:k + SD.LENGTH], i) < i:
                gone[k:k + SD.LENGTH] = True
        want[i] = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: bytes(x.kept) for x in SD.repeated_spans(docs).select("doc_id", "kept").collect()} == want
