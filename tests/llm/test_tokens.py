import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from llm_cases import ODD, SF, none, odd  # noqa: F401

from codegauge.llm import queries as Q
from codegauge.llm import sentencepiece_codec as SC
from codegauge.llm import token_counts as TC
from codegauge.llm.pieces import model_bytes

PATH = public_tokenizers.path(Q.PIECES)


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(n=400):
    r = random.Random(5)
    words = ["the", "tokenization", "naïve", "𝄞", "\n", "\t", "▁", "  ", "    " * 9, "<0x0A>", "<unk>", "Straße", "日本語", "aaaaaaaaaaaaaaa", "!!!", "###", "x" * 90, "\x00", "�"]
    for _ in range(n):
        yield r.choice(["", " "]).join(r.choice(words) + r.choice(["", " ", "", "\n"]) for _ in range(r.randrange(12)))
    for _ in range(n):
        yield "".join(r.choice(" ▁aeinotrs\nTé") for _ in range(r.randrange(60)))


def test_codec_and_counter_equal_the_library(lib):
    codec, counter = SC.Codec(model_bytes(PATH)), TC.Counter(model_bytes(PATH))
    for t in [*random_texts(), *(x[1] or "" for x in ODD)]:
        ids = lib.encode(t)
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == lib.decode(ids), t
        assert counter.count(t) == len(ids), t


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_queries_equal_the_library(spark, odd, lib, where):
    docs = odd if where == "odd" else Q.documents(spark, SF)
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    ids = [lib.encode(t) for _, t in texts]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(map(tuple, SC.digests(SC.encode_decode(docs, PATH)).collect()), key=key)
    assert got == sorted(((d, len(i), sha(",".join(map(str, i))), sha(lib.decode(i))) for (d, _), i in zip(texts, ids)), key=key)
    got = sorted(map(tuple, TC.token_counts(docs, PATH).collect()), key=key)
    assert got == sorted(((d, len(t.encode()), len(i), len(i) > 4096) for (d, t), i in zip(texts, ids)), key=key)


def test_empty_tables(none):
    assert SC.digests(SC.encode_decode(none, PATH)).collect() == []
    assert TC.token_counts(none, PATH).collect() == []
