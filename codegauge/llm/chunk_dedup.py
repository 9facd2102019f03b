"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut after a byte where the gear hash of the last 32 bytes falls under a bound, so the cuts depend on what
stands around them and come back after an insertion. Chunks are told apart by a 128-bit digest; each block asks the digest's
shard for the smallest document that holds the chunk, and later holders drop it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Blocks, answered, answers, ask, asked, buffers, by_splitmix, least_of_digests, n_blocks, owner, packed, slices

SPAN = 32
LEAST, MOST = 32, 512
AVERAGE = 64
SLICE = 1 << 20
_GEAR = by_splitmix(256, 101).astype(np.uint32)
TOP = np.iinfo(np.int64).max


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over the last 32 bytes of table[byte] << age, mod 2**32: the rolling hash, by doubling the span."""
    h, span = _GEAR[data], 1
    while span < SPAN:
        older = np.zeros_like(h)
        older[span:] = h[:-span] << np.uint32(span)
        h = h + older
        span *= 2
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> list[list[int]]:
    """End places of the chunks of each text. A chunk has ``least`` to ``most`` bytes and ends between characters; a forced end at ``most`` moves
    back to one. A rest of fewer than ``least`` bytes belongs to the chunk before it (a text of fewer is one chunk), as so short an ending is shared by chance."""
    h = gear(data)
    last = np.ones(len(data), bool)
    last[:-1] = (data[1:] & 0xC0) != 0x80
    marks = np.flatnonzero((h < np.uint32((1 << 32) // average)) & last) + 1
    lo = np.searchsorted(marks, offsets[:-1], side="right")
    hi = np.searchsorted(marks, offsets[1:], side="left")
    out = []
    for a, z, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lo.tolist(), hi.tolist()):
        ends, at = [], a
        for c in [*marks[i:j].tolist(), z]:
            while c - at > most:
                at += most
                while not last[at - 1]:
                    at -= 1
                ends.append(at)
            if c - at >= least or c == z and c > at and not ends:
                ends.append(c)
                at = c
        if at < z:
            ends[-1] = z
        out.append(ends)
    return out


class _Chunks:
    """Chunks of a block's texts: document, place, and both halves of their digests."""

    def __init__(self, t: pa.Table, spec: tuple):
        self.data, self.offsets = buffers(t["text"])
        self.ids = pc.fill_null(t["doc_id"], 0).to_numpy().astype(np.int64)
        self.has_id = ~np.asarray(t["doc_id"].is_null())
        row, lo, hi = [], [], []
        for i, j in slices(self.offsets, SLICE):
            base = self.offsets[i]
            for d, ends in enumerate(cuts(self.data[base:self.offsets[j]], self.offsets[i:j + 1] - base, *spec), i):
                if ends:
                    row.append(np.full(len(ends), d))
                    hi.append(np.array(ends) + base)
                    lo.append(np.r_[self.offsets[d], hi[-1][:-1]])
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.row, self.lo, self.hi = cat(row), cat(lo), cat(hi)
        view = memoryview(np.ascontiguousarray(self.data)).cast("B") if len(self.data) else b""
        raw = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(self.lo.tolist(), self.hi.tolist()))
        both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        self.key, self.check = both[:, 0].copy(), both[:, 1].copy()
        self.doc = np.where(self.has_id[self.row], self.ids[self.row], TOP) if len(self.row) else self.row
        order = np.lexsort((self.check, self.key))
        new = np.r_[True, (self.key[order][1:] != self.key[order][:-1]) | (self.check[order][1:] != self.check[order][:-1])] if len(order) else np.zeros(0, bool)
        self.lead = order[new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.least = np.full(len(self.lead), TOP)
        np.minimum.at(self.least, self.of, self.doc)


def repeated_chunks(docs: DataFrame, least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed (bytes), n_spans (maximal removed runs), kept_text of every row.

    A chunk that a document with a smaller doc_id also holds is removed, as is its second and later place in one document.
    Short texts are one chunk. Null texts are empty and have no chunks. A null doc_id stands after all others and among
    themselves unordered: such rows keep their chunks and take none from others. Rows sharing a doc_id do not take from each other. No
    rows give no rows.
    """
    spec = (least, average, most)
    blocks = n_blocks(docs)
    shards = blocks
    grouped = Blocks(docs, blocks, ["doc_id", "text"])

    def request(t: pa.Table) -> pa.Table:
        c = _Chunks(t, spec)
        keys = c.key[c.lead]
        return ask(keys, owner(keys, shards), t["block"][0].as_py(), c.check[c.lead], c.least)

    def shard(t: pa.Table) -> pa.Table:
        return pa.table({"kind": t["kind"], "shard": t["shard"], "block": t["block"], "a0": packed(least_of_digests(t, np.uint64))})

    def cut_out(t: pa.Table, reply: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        c = _Chunks(t, spec)
        first = answers(reply, [np.int64])[0]
        again = np.zeros(len(c.row), bool)
        if len(c.row):
            order = np.lexsort((c.lo, c.row, c.of))
            again[order] = np.r_[False, (c.of[order][1:] == c.of[order][:-1]) & (c.row[order][1:] == c.row[order][:-1])]
        gone = ((first[c.of] < c.doc) | again) & c.has_id[c.row]
        at = np.searchsorted(c.row, np.arange(t.num_rows + 1))
        for d in range(t.num_rows):
            i, j = at[d], at[d + 1]
            g, size = gone[i:j], (c.hi - c.lo)[i:j]
            cols[0].append(int(c.offsets[d + 1] - c.offsets[d]))
            cols[1].append(int(j - i))
            cols[2].append(int(size[g].sum()))
            cols[3].append(int((g & ~np.r_[False, g[:-1]]).sum()))
            cols[4].append(b"".join(c.data[a:b].tobytes() for a, b in zip(c.lo[i:j][~g].tolist(), c.hi[i:j][~g].tolist())).decode())
        names = ("n_bytes", "n_chunks", "n_removed", "n_spans")
        return pa.table({"doc_id": t["doc_id"], **{n: pa.array(x, pa.int64()) for n, x in zip(names, cols)}, "kept_text": pa.array(cols[4], pa.string())})

    replies = grouped.each(request, asked(2)).groupBy("shard").applyInArrow(shard, answered(1))
    schema = docs.select("doc_id").schema
    for n in ("n_bytes", "n_chunks", "n_removed", "n_spans"):
        schema = schema.add(n, "long")
    return grouped.meet(replies, cut_out, schema.add("kept_text", "string"))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed, n_spans, kept_sha256 of :func:`repeated_chunks` rows."""
    return rows.select("doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
