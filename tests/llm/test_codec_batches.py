"""Batches of the SentencePiece codec: ids kept as bytes, lists of ids and their texts at once."""

import random

import public_tokenizers
import pyarrow as pa
import sentencepiece

from codegauge.llm import queries as Q
from codegauge.llm import sentencepiece_codec as SC
from codegauge.llm.pieces import model_bytes, plain_units, units

PATH = public_tokenizers.path(Q.PIECES)
TEXTS = [None, "", " ", "▁", "\n", "one  two▁three\nfour", "naïve ☃𝄞 x\x00y", "word" * 300, " lead", "▁▁a b", "日本語 <unk> <0x0A>"]


def test_units_are_the_escaped_ones():
    for t in TEXTS:
        assert [u.replace(" ", "▁") for u in plain_units(t)] == units(t)


def test_batches_equal_the_library():
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), SC.Codec(model_bytes(PATH))
    ids = codec.encode_all(TEXTS)
    assert ids.type == pa.list_(pa.int32()) and ids.to_pylist() == [lib.encode(t or "") for t in TEXTS]
    assert codec.decode_all(ids).to_pylist() == [lib.decode(lib.encode(t or "")) for t in TEXTS]
    assert all(type(x) is bytes and len(x) % 4 == 0 for x in codec.units.values())
    assert codec.encode_all([]).to_pylist() == [] and codec.decode_all(codec.encode_all([])).to_pylist() == []


def test_ids_that_no_text_has():
    codec, r = SC.Codec(model_bytes(PATH)), random.Random(2)
    ids = [[r.randrange(len(codec.v.pieces)) for _ in range(r.randrange(9))] for _ in range(300)] + [[3 + 0xE6, 3 + 0x41]]
    assert codec.decode_all(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == [codec.decode(x) for x in ids]
