"""SentencePiece encoding by a prefix table of last tokens, and decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_worker, ship_code
from .pieces import BYTE, CONTROL, SPACE, UNKNOWN, UnitCache, Vocabulary, model_bytes, plain_units


class Codec:
    """``encode(text) -> ids`` and ``decode(ids) -> text`` of one model.

    Every prefix of a unit has exactly one BPE result, and the result's last token fixes the rest: cutting
    it off leaves the result of the shorter prefix. So the table keeps one last token for each prefix.
    An automaton over the vocabulary lists the pieces that end at a place; the right one is the piece whose
    neighbour, the last token of the prefix before it, merges with it into just these two tokens again. That
    pair test is worked out once by merging the pair's text, and kept. The ids are then read backwards.
    """

    PAIRS, UNITS = 400_000, 250_000

    def __init__(self, model: bytes):
        import ahocorasick
        self.v = Vocabulary(model)
        self.machine = ahocorasick.Automaton()
        self.whole = {}
        self.raw = [i.to_bytes(4, "little") for i in range(len(self.v.pieces))]
        for piece, i in self.v.ids.items():
            if " " not in piece and self.merged(piece) == [piece]:  # a space in a text is never that of a piece
                plain = piece.replace(SPACE, " ")
                self.machine.add_word(plain, (i, len(piece)))
                self.whole[plain] = self.raw[i]
        self.machine.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.units = UnitCache(self.encode_unit, self.UNITS)
        self.bytes_of = [b"" if t in (CONTROL,) else b" \xe2\x81\x87 " if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, t in zip(self.v.pieces, self.v.types)]
        first = [x[p.startswith(SPACE):] for x, p in zip(self.bytes_of, self.v.pieces)]  # a text's first space is not its own
        self.spelled = pa.array(self.bytes_of + first, pa.binary())

    def merged(self, text: str) -> list[str]:
        """Tokens of a short text by the merge rule itself: the best-scored pair first, the leftmost of equals."""
        part, score = list(text), self.v.score
        while len(part) > 1:
            found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in score]
            if not found:
                break
            i = min(found)[1]
            part[i:i + 2] = [part[i] + part[i + 1]]
        return part

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of two tokens merges into just these two."""
        if len(self.pairs) >= self.PAIRS:
            self.pairs.clear()
        a, b = self.v.pieces[left], self.v.pieces[right]
        known = self.pairs[left << 20 | right] = self.merged(a + b) == [a, b]
        return known

    def encode_unit(self, unit: str) -> bytes:
        """The ids of a unit, 4 bytes each, least first."""
        if unit in self.whole:
            return self.whole[unit]
        n, known, pairs = len(unit), self.whole, self.pairs
        last = [-1] * (n + 1)  # last token of each prefix; -1 after a character outside the vocabulary
        for end, (piece, size) in self.machine.iter(unit):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before >= 0:
                    fits = pairs.get(before << 20 | piece)
                    if fits is None:
                        fits = self.compatible(before, piece)
                    if not fits:
                        continue
                elif unit[start - 1] in known:
                    continue
            last[end] = piece
        out: list[bytes] = []
        at = n
        while at:
            piece = last[at]
            if piece < 0:  # a character outside the vocabulary stands alone, as bytes
                out += [self.raw[i] for i in reversed(self.v.fallback(unit[at - 1]))]
                at -= 1
            else:
                out.append(self.raw[piece])
                at -= len(self.v.pieces[piece])
        out.reverse()
        return b"".join(out)

    def encode_raw(self, text: str | None) -> bytes:
        return b"".join(map(self.units.__getitem__, plain_units(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_raw(text), "<i4").tolist()

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        raw = [self.encode_raw(t) for t in texts]
        ends = np.cumsum([0, *map(len, raw)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """:meth:`decode` of every list."""
        flat, ends = ids.values.to_numpy().copy(), ids.offsets.to_numpy()
        flat[ends[:-1][np.diff(ends) > 0]] += len(self.bytes_of)
        raw = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.spelled.take(pa.array(flat))), b"")
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        if len(ids) and self.v.pieces[ids[0]].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ids array<int> and decoded string of every row.

    Null and empty texts have no ids and decode to ''. Texts are processed whole and each on its own;
    repeated rows come out repeated, an empty table gives no rows.
    """
    ship_code(docs.sparkSession)
    model = model_bytes(model_path)
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches):
        codec = per_worker(Codec, model)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                ids = codec.encode_all(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, codec.decode_all(ids)], [*keep, "ids", "decoded"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def digests(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 of :func:`encode_decode` rows."""
    return encoded.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
