"""Suffix-array dedup: remove every byte of a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

A suffix array of the whole corpus is sorted where it matters only. Every window of ``LENGTH`` bytes picks an anchor, its
``ANCHOR``-byte gram with the smallest hash, so equal windows pick equal grams. Runs of windows with one anchor form a group;
its region is the bytes of all its windows.

1. Blocks ask the shards which of their grams also occur in another block (4 bytes a gram); grams in one document only end here.
2. Equal regions (by a 96-bit digest of their bytes) are equal groups: shards answer the smallest doc_id of each region and gram. A group whose region starts in a
   smaller document goes as a whole. The rest is the edges of repeated passages: groups first of their region whose gram
   has several regions.
3. The regions of those groups, once each, go to the gram's shard. Their suffixes (one for each window) are sorted by
   hash comparisons (:mod:`.suffix_sort`); a run of suffixes equal in ``LENGTH`` bytes is one repeated string, and every window
   in it but those of the smallest document is removed. A gram with more than ``HOT`` regions (the edge of a passage that many
   documents share) sends its windows one by one to the shard of their own hash instead, where equal ones meet: exact as well,
   and no shard gathers the group.
4. Each block cuts the windows found out of its texts.

The documents are shuffled into blocks once; each step's requests and answers are far smaller than the texts.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOW, Blocks, Shard, answers, ask, buffers, distinct, least_of_digests, mix64, n_blocks, owner, packed, short, spare_memory, squeeze, unpacked, unsqueeze
from .suffix_sort import Suffixes, powers, prefix_hashes

LENGTH = 50
ANCHOR = 24
HOT = 4096
PIECE = 1 << 16
DIGESTS = 1 << 15
GRAMS, REGIONS, ANCHORS, SUFFIXES, MEMO = range(5)
WANT = "kind int, shard int, block int, keys binary, v0 binary, v1 binary, v2 binary"
GOT = "kind int, shard int, block int, a0 binary, a1 binary"
BITS = 16 + 2


def _groups_of(x: np.ndarray, edges: np.ndarray, length: int, anchor: int):
    """(lo, hi, gram, anchor place) of the window groups of a piece; ``edges`` are text starts inside it."""
    windows = len(x) - length + 1
    if windows <= 0:
        return None
    sums, down = prefix_hashes(x), powers(len(x) + 1)[1]
    with np.errstate(over="ignore"):
        gram = sums[anchor:] - sums[:-anchor]
        gram *= down[:len(gram)]
        gram = mix64(gram)
        least = gram >> np.uint64(BITS) << np.uint64(BITS)
        least |= np.arange(len(gram), dtype=np.uint64)
        width, size = length - anchor + 1, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if width > size:
            least = np.minimum(least[:windows], least[width - size:width - size + windows])
        valid = np.ones(windows, bool)
        for e in edges:
            valid[max(0, e - length + 1):e] = False
        at = np.flatnonzero(valid)
        if not len(at):
            return None
        place = (least[at] & np.uint64((1 << BITS) - 1)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (np.diff(at) > 1)])
        lo, hi, place = at[new], at[np.r_[new[1:], len(at)] - 1], place[new]
    # anchors have small hashes by choice: mix once more, so that they spread over the shards
    return lo, hi, mix64(gram[place] ^ np.uint64(0x7F4A7C15F39CC060)), place


class Block:
    """The texts of a block in a fixed order (doc_id, then text), and the window groups of those that have an id."""

    def __init__(self, table: pa.Table, length: int, anchor: int, group: bool = True):
        ids = table["doc_id"]
        order = np.array(pc.sort_indices(pa.table({"d": ids, "t": pc.fill_null(table["text"], "")}), sort_keys=[("d", "ascending"), ("t", "ascending")]))
        self.table = table.take(pa.array(order))
        self.number = table["block"][0].as_py()
        self.data, self.offsets = buffers(self.table["text"])
        self.has_id = ~np.asarray(self.table["doc_id"].is_null())
        self.ids = pc.fill_null(self.table["doc_id"], 0).to_numpy().astype(np.int64)
        self.length = length
        if not group:
            return
        found = [[], [], [], []]
        for g in self._pieces(anchor):  # places in a block fit 4 bytes, as Arrow's own offsets do
            for held, x, t in zip(found, g, (np.int32, np.int32, np.uint64, np.int32)):
                held.append(x.astype(t, copy=False))
        cat = lambda t: np.concatenate([np.zeros(0, t), *found.pop(0)])
        self.lo, self.hi, self.gram, self.place = (cat(t) for t in (np.int32, np.int32, np.uint64, np.int32))
        self.doc = np.repeat(self.ids, np.diff(np.searchsorted(self.lo, self.offsets)))  # groups ascend, and none crosses a text
        self.grams, self.of_gram = ranked(self.gram)

    def _pieces(self, anchor: int):
        n, off = int(self.has_id.sum()), self.offsets  # null ids sort last and take no part
        i = 0
        while i < n:
            j = max(i + 1, min(n, int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1))
            for start in range(off[i], max(off[i] + 1, off[j] - self.length + 1), PIECE) if j == i + 1 else [off[i]]:
                end = min(off[j], start + PIECE + self.length - 1) if j == i + 1 else off[j]
                got = _groups_of(self.data[start:end], off[i + 1:j] - start, self.length, anchor)
                if got is not None:
                    yield got[0] + start, got[1] + start, got[2], got[3] + start
            i = j

    def regions(self, groups: np.ndarray) -> np.ndarray:
        """Digests of the regions of some groups: (key, check) as two uint64, 96 bits in all."""
        if not len(groups):
            return np.zeros((0, 2), np.uint64)
        view = memoryview(np.ascontiguousarray(self.data)).cast("B")
        out = np.empty((len(groups), 2), np.uint64)
        for i in range(0, len(groups), DIGESTS):
            part = groups[i:i + DIGESTS]
            raw = b"".join([blake2b(view[a:z], digest_size=16).digest() for a, z in zip(self.lo[part].tolist(), (self.hi[part] + self.length).tolist())])
            out[i:i + DIGESTS] = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        out[:, 1] &= LOW
        return out

    def open(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups of the grams marked, and the place of each one's gram among these."""
        g = np.flatnonzero(grams[self.of_gram])
        return g, (np.cumsum(grams) - 1)[self.of_gram[g]]

    def shared(self) -> np.ndarray:
        """Grams that occur in several documents of this block."""
        low = np.full(len(self.grams), np.iinfo(np.int64).max)
        high = np.full(len(self.grams), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of_gram, self.doc)
        np.maximum.at(high, self.of_gram, self.doc)
        return low < high


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each element among them."""
    order = np.argsort(x)
    new = np.r_[True, x[order][1:] != x[order][:-1]] if len(x) else np.zeros(0, bool)
    of = np.empty(len(x), np.int32)
    of[order] = np.cumsum(new) - 1
    return x[order[new]], of


def ranked_pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`ranked` for rows of two values, and the first element of each."""
    order = np.argsort(x[:, 0])
    key, low = x[order, 0], x[order, 1]
    same = key[1:] == key[:-1]
    if (low[1:][same] < low[:-1][same]).any():  # equal keys with several checks: hardly ever
        order = np.lexsort((x[:, 1], x[:, 0]))
        key, low = x[order, 0], x[order, 1]
        same = key[1:] == key[:-1]
    at = np.flatnonzero(np.r_[True, ~(same & (low[1:] == low[:-1]))]) if len(x) else np.zeros(0, np.int64)
    of = np.empty(len(x), np.int32)
    of[order] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(x)]))
    return np.stack([key[at], low[at]], axis=1), order[at], of


def _want(table: pa.Table) -> pa.Table:
    """Fill up the value columns that a request does not use."""
    for k in range(3):
        if f"v{k}" not in table.schema.names:
            table = table.append_column(f"v{k}", pa.array([b""] * table.num_rows, pa.binary()))
    return table.select(["kind", "shard", "block", "keys", "v0", "v1", "v2"])


def _memo(block: int, *arrays: np.ndarray) -> pa.Table:
    """What a block tells its own next step, sent along with its requests."""
    one = lambda x, t: pa.array([x], t)
    cols = [a.tobytes() for a in arrays] + [b""] * (3 - len(arrays))
    return pa.table({"kind": one(MEMO, pa.int32()), "shard": one(block, pa.int32()), "block": one(block, pa.int32()), "keys": one(cols[0], pa.binary()), "v0": one(cols[1], pa.binary()), "v1": one(cols[2], pa.binary()), "v2": one(b"", pa.binary())})


def _pass(table: pa.Table) -> pa.Table:
    return pa.table({"kind": table["kind"], "shard": table["shard"], "block": table["block"], "a0": table["keys"], "a1": table["v0"]})


def _memo_of(reply: pa.Table, types: list) -> list[np.ndarray]:
    at = int(np.flatnonzero(reply["kind"].to_numpy() == MEMO)[0])
    return [np.frombuffer(reply[f"a{k}"][at].as_buffer(), t) for k, t in enumerate(types)]


def n_shards(blocks: int) -> int:
    """How many shards answer ``blocks`` blocks: every pair of the two costs some messages, whatever is in them, so many blocks have fewer shards."""
    return max(min(blocks, 32), blocks // 4)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, keep: list[str] = ()) -> DataFrame:
    """doc_id (and ``keep``), n_bytes, spans (start, end of the maximal removed runs, in bytes), kept (remaining bytes), kept_text of every row.

    A null text is empty. Strings that repeat inside one document only, or among rows of one doc_id, stay. A row with a null
    doc_id has no place in the order: it loses nothing and takes nothing from others. ``kept_text`` is the text without the
    characters all of whose bytes were removed. Texts shorter than ``length`` are untouched; no rows give no rows.
    """
    blocks = n_blocks(docs)
    few = n_shards(blocks)
    grouped = Blocks(docs, blocks, ["doc_id", "text", *keep])

    def ask_grams(t: pa.Table) -> pa.Table:
        b = Block(t, length, anchor, group=False)  # where the grams stand isn't asked yet
        keys = distinct(np.concatenate([np.zeros(0, np.uint64), *(distinct(short(g[2], few)) for g in b._pieces(anchor))]))
        return pa.concat_tables([_want(ask((keys & LOW).astype(np.uint32), (keys >> np.uint64(32)).astype(np.int32), b.number, kind=GRAMS)), _memo(b.number, np.zeros(0))])

    def answer_grams(t: pa.Table) -> pa.Table:
        if t["kind"][0].as_py() == MEMO:
            return _pass(t)
        s = Shard(t, key=np.uint32)
        return s.reply((np.bincount(s.inverse, minlength=len(s.keys)) > 1).astype(np.uint8), np.zeros(len(s.keys), np.uint8))

    def ask_regions(t: pa.Table, reply: pa.Table) -> pa.Table:
        b = Block(t, length, anchor)
        at = ranked(short(b.grams, few))[1]
        open_ = b.shared() | (answers(reply, [np.uint8], GRAMS)[0][at] > 0)
        g, of = b.open(open_)
        region = b.regions(g)
        regions, first, of_region = ranked_pairs(region)
        least = np.full(len(regions), np.iinfo(np.int64).max)
        np.minimum.at(least, of_region, b.doc[g])
        grams = b.grams[open_]
        low = np.full(len(grams), np.iinfo(np.int64).max)
        np.minimum.at(low, of, b.doc[g])
        some = np.full(len(grams), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(some, of, region[:, 0])
        several = np.bincount(of[first], minlength=len(grams)).astype(np.uint32)
        return pa.concat_tables([_want(ask(regions[:, 0], owner(regions[:, 0], few), b.number, regions[:, 1].astype(np.uint32), least, kind=REGIONS)),
                                 _want(ask(grams, owner(grams, few), b.number, low, some, several, kind=ANCHORS)),
                                 _memo(b.number, np.packbits(open_), np.frombuffer(squeeze(of_region), np.uint8))])

    def answer_regions(t: pa.Table) -> pa.Table:
        kind = t["kind"][0].as_py()
        if kind == MEMO:
            return _pass(t)
        if kind == REGIONS:
            return pa.table({"kind": t["kind"], "shard": t["shard"], "block": t["block"], "a0": packed(least_of_digests(t, np.uint32)), "a1": pa.array([b""] * t.num_rows, pa.binary())})
        s = Shard(t, [np.int64, np.uint64, np.uint32])
        least = s.per_key(np.minimum, s.vals[0], np.iinfo(np.int64).max)
        low, high = s.per_key(np.minimum, s.vals[1], np.iinfo(np.uint64).max), s.per_key(np.maximum, s.vals[1], 0)
        many = s.per_key(np.add, s.vals[2].astype(np.int64), 0)
        most = s.per_key(np.maximum, s.vals[2], 0)
        return s.reply(least, np.where((low != high) | (most > 1), np.where(many > hot, 2, 1), 0).astype(np.uint8))

    def ask_suffixes(t: pa.Table, reply: pa.Table) -> pa.Table:
        b = Block(t, length, anchor)
        open_, of_region = _memo_of(reply, [np.uint8, np.uint8])
        open_, of_region = np.unpackbits(open_, count=len(b.grams)).astype(bool), unsqueeze(of_region, np.int32)
        g, of_gram = b.open(open_)
        least = answers(reply, [np.int64], REGIONS)[0][of_region]
        state = answers(reply, [np.int64, np.uint8], ANCHORS)[1][of_gram]
        doc = b.doc[g]
        gone = g[least < doc]
        edge = (least == doc) & (state > 0)
        cold, hot_ = g[edge & (state == 1)], g[edge & (state == 2)]
        cold_region = of_region[edge & (state == 1)]
        # one record for each region, and for each distinct window of a hot gram
        _, first, rec = np.unique(cold_region, return_index=True, return_inverse=True)
        one = cold[first]
        lo, hi = b.lo[one], b.hi[one]
        keys, docs_, shift = b.gram[one], b.doc[one], (b.place - b.lo)[one]
        sums = b.hi[hot_] - b.lo[hot_] + 1
        wlo = np.repeat(b.lo[hot_], sums) + np.arange(sums.sum()) - np.repeat(np.cumsum(sums) - sums, sums)
        wdoc = np.repeat(b.doc[hot_], sums)
        whash = _window_hashes(b.data, wlo, length)
        by = np.lexsort((wdoc, whash))
        lead = np.flatnonzero(np.r_[True, whash[by][1:] != whash[by][:-1]]) if len(by) else np.zeros(0, np.int64)
        wrec = np.zeros(len(by), np.int64)
        wrec[by] = np.repeat(np.arange(len(lead)), np.diff(np.r_[lead, len(by)]))
        lead = by[lead]
        late = wlo[wdoc > wdoc[lead][wrec]]  # the same window stands in a smaller document of this block
        lo, hi = np.r_[lo, wlo[lead]], np.r_[hi, wlo[lead]]
        keys, docs_, shift = np.r_[keys, whash[lead]], np.r_[docs_, wdoc[lead]], np.r_[shift, np.full(len(lead), 255)]
        own = owner(keys, few)
        order = np.lexsort((keys, own))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        lo, hi, keys, docs_, shift, own = (x[order] for x in (lo, hi, keys, docs_, shift, own))
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        to = np.r_[at[1:], len(own)].astype(np.int64) if len(at) else at
        size = hi - lo + length
        full = lambda x: pa.array(np.full(len(at), x), pa.int32())
        shape = np.stack([size, shift], axis=1).astype(np.uint8) if len(size) else np.zeros((0, 2), np.uint8)
        text = [b"".join(b.data[x:x + n].tobytes() for x, n in zip(lo[i:j].tolist(), size[i:j].tolist())) for i, j in zip(at, to)]
        wants = pa.table({"kind": full(SUFFIXES), "shard": pa.array(own[at], pa.int32()), "block": full(b.number), "keys": packed([keys[i:j] for i, j in zip(at, to)], True),
                          "v0": packed([docs_[i:j] for i, j in zip(at, to)]), "v1": packed([shape[i:j].view(np.uint16).reshape(-1) for i, j in zip(at, to)]), "v2": pa.array(text, pa.binary())})
        cut = np.concatenate([np.stack([b.lo[gone], b.hi[gone]], axis=1), np.stack([late, late], axis=1)]).astype(np.int64)
        look = np.concatenate([np.stack([b.lo[cold], b.hi[cold], back[rec]], axis=1), np.stack([wlo, wlo, back[len(one) + wrec]], axis=1)]).astype(np.int64)
        return pa.concat_tables([wants, _memo(b.number, cut, look)])

    def answer_suffixes(t: pa.Table) -> pa.Table:
        if t["kind"][0].as_py() == MEMO:
            return _pass(t)
        parts = unpacked(t["keys"], np.uint64, True)
        keys, doc = np.concatenate(parts), np.concatenate(unpacked(t["v0"], np.int64))
        shape = np.concatenate(unpacked(t["v1"], np.uint16)).view(np.uint8).reshape(-1, 2)
        data = np.frombuffer(b"".join(x.as_py() for x in t["v2"]), np.uint8)
        size, masks = shape[:, 0].astype(np.int64), np.zeros(len(keys), np.uint64)
        text = np.r_[0, np.cumsum(size)]
        # a part of the keys at a time, as suffixes take far more room than their texts; keys ascend in each request
        part = owner(keys, blocks)
        run = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (keys[1:] < keys[:-1])])
        to = np.r_[run[1:], len(keys)]
        for p in distinct(part):
            runs = [(i, j) for i, j in zip(run[part[run] == p].tolist(), to[part[run] == p].tolist())]
            at = np.concatenate([np.arange(i, j) for i, j in runs])
            mine = np.concatenate([data[text[i]:text[j]] for i, j in runs])
            masks[at] = repeated_windows(keys[at], doc[at], size[at], shape[at, 1].astype(np.int64), mine, length)
        del doc, shape, data
        spare_memory()
        cuts = np.cumsum([len(x) for x in parts])[:-1]
        return pa.table({"kind": t["kind"], "shard": t["shard"], "block": t["block"], "a0": packed(np.split(masks, cuts)), "a1": pa.array([b""] * t.num_rows, pa.binary())})

    def cut_out(t: pa.Table, reply: pa.Table) -> pa.Table:
        b = Block(t, length, anchor, group=False)
        cut, look = (x.reshape(-1, w) for x, w in zip(_memo_of(reply, [np.int64, np.int64]), (2, 3)))
        masks = answers(reply, [np.uint64], SUFFIXES)[0]
        depth = np.zeros(len(b.data) + 1, np.int32)
        np.add.at(depth, cut[:, 0], 1)
        np.add.at(depth, cut[:, 1] + length, -1)
        if len(look):
            for j in range(length - anchor + 1):
                hit = look[(masks[look[:, 2]] >> np.uint64(j) & np.uint64(1)).astype(bool), 0] + j
                np.add.at(depth, hit, 1)
                np.add.at(depth, hit + length, -1)
        np.cumsum(depth, out=depth)
        removed = depth[:-1] > 0
        del depth
        # all texts at once; a run ends with its text
        held = np.diff(b.offsets) > 0
        first = np.zeros(len(removed) + 1, bool)
        first[b.offsets] = True
        start = np.flatnonzero(removed & (first[:-1] | ~np.r_[False, removed[:-1]]))
        end = np.flatnonzero(removed & (first[1:] | ~np.r_[removed[1:], False])) + 1
        runs = np.searchsorted(start, b.offsets)
        shift = np.repeat(b.offsets[:-1], np.diff(runs))
        spans = pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.StructArray.from_arrays([pa.array(start - shift, pa.int64()), pa.array(end - shift, pa.int64())], ["start", "end"]))

        def texts(stay: np.ndarray, kind) -> pa.Array:
            size = np.zeros(len(b.offsets), np.int64)
            if held.any():
                size[1:][held] = np.add.reduceat(stay, b.offsets[:-1][held], dtype=np.int64)
            return pa.Array.from_buffers(kind, len(held), [None, pa.py_buffer(np.cumsum(size)), pa.py_buffer(b.data[stay])])

        stay = ~removed
        kept = texts(stay, pa.large_binary()).cast(pa.binary())
        inside = ((b.data & 0xC0) == 0x80) & ~first[:-1]  # not the first byte of a character, which has four at most
        if inside.any():
            for _ in range(3):
                stay[1:] |= stay[:-1] & inside[1:]
            for _ in range(3):
                stay[:-1] |= stay[1:] & inside[1:]
        return pa.table({**{c: b.table[c] for c in ("doc_id", *keep)}, "n_bytes": pa.array(np.diff(b.offsets), pa.int64()), "spans": spans.cast(SPANS), "kept": kept, "kept_text": texts(stay, pa.large_string()).cast(pa.string())})

    step = grouped.each(ask_grams, WANT).groupBy("kind", "shard").applyInArrow(answer_grams, GOT)
    step = grouped.meet(step, ask_regions, WANT).groupBy("kind", "shard").applyInArrow(answer_regions, GOT)
    step = grouped.meet(step, ask_suffixes, WANT).groupBy("kind", "shard").applyInArrow(answer_suffixes, GOT)
    span = T.StructType().add("start", "long").add("end", "long")
    schema = docs.select("doc_id", *keep).schema.add("n_bytes", "long").add("spans", T.ArrayType(span)).add("kept", "binary").add("kept_text", "string")
    return grouped.meet(step, cut_out, schema)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at ascending runs of places (a chunk of places at a time)."""
    out = np.zeros(len(at), np.uint64)
    if not len(at):
        return out
    order = np.argsort(at, kind="stable")
    i = 0
    while i < len(at):
        base = at[order[i]]
        j = int(np.searchsorted(at[order], base + PIECE, side="left"))
        part = order[i:j]
        s = Suffixes(data[base:at[order[j - 1]] + length], at[part] - base, length)
        out[part] = mix64(s.hashes(s.starts, length) ^ np.uint64(0x5DEECE66D1234567))
        i = j
    return out


def repeated_windows(keys: np.ndarray, doc: np.ndarray, size: np.ndarray, shift: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Bit j of each record: its j-th window of ``length`` bytes also lies in a record of the same key and a smaller doc.

    Equal windows of one gram hold it at the same place, so suffixes are sorted by (key, place of the gram) segments."""
    count = size - length + 1
    rec = np.repeat(np.arange(len(keys)), count)
    j = np.arange(len(rec)) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(np.cumsum(size) - size, count) + j
    place = np.where(shift[rec] == 255, 255, shift[rec] - j)
    by = np.lexsort((place, keys[rec]))
    rec, j, starts, place = rec[by], j[by], starts[by], place[by]
    masks = np.zeros(len(keys), np.uint64)
    if not len(rec):
        return masks
    segment = np.cumsum(np.r_[False, (keys[rec][1:] != keys[rec][:-1]) | (place[1:] != place[:-1])])
    s = Suffixes(data, starts, length)
    order = s.sort(segment)
    run = s.equal_runs(order, segment)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    least = np.minimum.reduceat(doc[rec[order]], first)[run]
    hit = order[least < doc[rec[order]]]
    np.bitwise_or.at(masks, rec[hit], np.uint64(1) << j[hit].astype(np.uint64))
    return masks


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of :func:`repeated_spans` rows."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
