"""What a Python worker keeps from one operator to the next, and what a block's lookup takes."""

import tracemalloc
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_cases import ODD

from codegauge.llm import common, pieces
from codegauge.llm import queries as Q
from codegauge.llm import sentencepiece_codec as SC
from codegauge.llm import token_counts as TC
from codegauge.llm.common import Blocks, Lookup, by_splitmix, distinct

PATH = public_tokenizers.path(Q.PIECES)


def test_blocks_let_go_of_tokenizers(spark):
    docs = spark.createDataFrame([r[:3] for r in ODD] * 4, "doc_id long, text string, lang string").repartition(8)
    blocks = Blocks(docs, 8, ["doc_id", "text"])

    def count(t):
        """The tokenizers that the worker holds; it can't import this file."""
        import gc
        n = sum(type(x).__name__ in ("Codec", "Counter") and type(x).__module__.startswith("codegauge.llm") for x in gc.get_objects())
        return pa.table({"n": pa.array([n], pa.int64())})

    for fill in (lambda: SC.encode_decode(docs, PATH), lambda: TC.token_counts(docs, PATH)):
        fill().collect()
        assert [r.n for r in blocks.each(count, "n long").collect() if r.n] == []


@pytest.mark.parametrize("kind", [SC.Codec, TC.Counter])
def test_one_tokenizer_until_let_go(kind):
    model = pieces.model_bytes(PATH)
    one = common.per_worker(kind, model)
    assert common.per_worker(kind, model) is one
    kept = weakref.ref(one)
    del one
    assert kept() is not None
    common.let_go()
    assert kept() is None


def test_lookup_is_small():
    """600,000 n-grams, as a block of 12 MB has: the table over their leading bits stays a few times as large as they are."""
    keys = distinct(by_splitmix(600_000, 3))
    tracemalloc.start()
    try:
        found = Lookup(keys)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 20e6 and peak < 60e6
    at = found.find(keys[::-7])
    assert at.dtype == np.int64 and (keys[at] == keys[::-7]).all()
    assert Lookup(keys[:0]).find(keys[:0]).tolist() == [] and Lookup(keys[:1]).find(keys[:1]).tolist() == [0]
