"""SentencePiece BPE models: vocabulary, text units, and a cache of encoded units."""

from __future__ import annotations

import re

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def model_bytes(path: str) -> bytes:
    """The model file (about 0.5 MB), read once on the driver and sent with the task code."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Pieces of a BPE model with identity normalisation, dummy prefix and byte fallback.

    ``order`` ranks a piece by its score (merges with the higher score come first; equal scores go by
    place in the text); ``ids`` holds the pieces that merging may form; ``byte_id`` the fallback of each byte.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        m.ParseFromString(model)
        norm = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or norm.name != "identity" or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type in (USER, UNUSED) for p in m.pieces):
            raise ValueError("only BPE models with byte fallback, identity normalisation, dummy prefix and no user-defined pieces")
        self.pieces = [p.piece for p in m.pieces]
        self.types = [p.type for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character; units cannot be cut at spaces")
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}

    def fallback(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]


#: Spaces lead a unit, and no piece holds a line feed: merges never pass the ends of a unit.
UNIT = re.compile("▁*[^▁\n]+|▁+|\n")


def units(text: str) -> list[str]:
    """The parts of a text that merge on their own; their concatenation is the escaped text."""
    return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


#: The same with spaces for themselves: most texts are then strings of a byte a character, which are cut, hashed and kept at less cost.
PLAIN = re.compile(" *[^ \n]+| +|\n")


def plain_units(text: str) -> list[str]:
    """:func:`units` with a space for each escaped one."""
    return PLAIN.findall(" " + text.replace(SPACE, " ")) if text else []


class UnitCache(dict):
    """unit -> result of ``make(unit)``, bounded by two generations: when the young one is full it becomes the old one, from which
    units still in use come back. Long units are not kept."""

    MOST, LONG = 150_000, 64

    def __init__(self, make, most: int = MOST):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, unit):
        out = self.old.get(unit)
        if out is None:
            out = self.make(unit)
        if len(unit) <= self.LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[unit] = out
        return out
