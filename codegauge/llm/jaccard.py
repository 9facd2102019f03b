"""Exact Jaccard join on word n-grams: size-banded tiles, bitmap bounds, sorted-array intersection.

1. *Tiles.* Sets are banded by size. Two sets that reach the threshold differ in at most d elements, d
   fixed by the band; their elements are dealt into d + 1 parts (and a tenth more) by hash, so at least one part is equal. A tile is
   (band, part, content of the part): linked sets always share one. A set near the top of its band
   also enters the tiles of the next.
2. *Only shared tiles matter.* Each block of documents asks the tiles' shards which of its tiles hold two
   different sets; only documents in such tiles go on, with their bitmap, once each.
3. *Stars first.* Every member of a tile is compared with the tile's smallest document, and the links give
   first components. Then, in tiles that still span several components, members of different components meet in
   chunks: the bitmaps' bit counts bound the overlap from above, and only survivors form their sorted arrays and are intersected. Pairs already
   connected are never formed, so a group of thousands of near copies costs a star, not all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOW, Blocks, Shard, answered, answers, ask, asked, buffers, by_splitmix, mix64, n_blocks, short, slices, word_hashes, written
from .components import components

RATIO = 1.5
MOST_BITS = 8192
CHUNK = 1024
SLICE = 1 << 19
PAIRED = 4


def ngram_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; fewer words give one shingle, none gives none."""
    words, at = word_hashes(data, offsets)
    seeds = by_splitmix(k + 1, 3) | np.uint64(1)
    n = len(words)
    out = []
    with np.errstate(over="ignore"):
        m = max(0, n - k + 1)
        s = np.full(m, seeds[k], np.uint64)
        for j in range(k):
            s += words[j:j + m] * seeds[j]
        s = mix64(s)
        for i, j in zip(at[:-1], at[1:]):
            if j - i >= k:
                out.append(np.unique(s[i:j - k + 1]))
            elif j > i:
                out.append(mix64(np.array([np.uint64(j - i) + (words[i:j] * seeds[:j - i]).sum(dtype=np.uint64)], np.uint64)))
            else:
                out.append(s[:0])
    return out


class Bands:
    """Size bands, their part counts and bitmap widths for links of Jaccard >= num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def edge(self, band: int) -> int:
        """Smallest size of a band."""
        e = 1
        for _ in range(band):
            e = max(e + 1, int(e * RATIO), -(-e * self.den // max(1, self.num)))
        return e

    def of(self, size: int) -> int:
        band, e = 0, 1
        while True:
            e2 = max(e + 1, int(e * RATIO), -(-e * self.den // max(1, self.num)))
            if size < e2:
                return band
            band, e = band + 1, e2

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, spare): linked sets of the band agree in ``spare`` + 1 parts or more. Where linked sets can only be equal
        there is one part, the whole set: its tile holds equal sets alone."""
        least = 2 * (self.edge(band + 1) - 1) * (self.den - self.num) // (self.den + self.num) + 1
        if least == 1:
            return 1, 0
        spare = -(-least // 10)
        return least + spare, spare

    def enters(self, size: int) -> list[int]:
        band = self.of(size)
        return [band] + [band + 1] * (size * self.den >= self.num * self.edge(band + 1))

    def bits(self, size: int) -> int:
        return min(MOST_BITS, max(64, 1 << (4 * self.edge(self.of(size) + 1) - 1).bit_length()))


_PARTS: dict = {}


def tiles(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Tile keys of one set: its parts that are not empty. Linked sets agree in more than ``spare`` parts, so unless both
    have more than ``spare`` empty parts they agree in one that is not; only sets with so many enter the tiles of empty parts too.
    Where there are few parts (at most ``PAIRED``) a tile is a pair of parts, as linked sets agree in two at least: half a short text, which many may
    share, does not make a tile."""
    key = (bands.num, bands.den, len(s))
    if key not in _PARTS:
        if len(_PARTS) > 100_000:
            _PARTS.clear()
        _PARTS[key] = [(b, *bands.parts(b)) for b in bands.enters(len(s))]
    out = []
    with np.errstate(over="ignore"):
        spread = mix64(s + np.uint64(0x51ED27))
        for band, parts, spare in _PARTS[key]:
            content = np.zeros(parts, np.uint64)
            part = ((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            np.add.at(content, part, spread)
            keys = mix64(mix64(content) + mix64(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)))
            full = np.bincount(part, minlength=parts) > 0
            all_ = parts - full.sum() > spare
            if 1 < parts <= PAIRED:
                i, j = np.triu_indices(parts, 1)
                keys, full = mix64(keys[i] + mix64(keys[j] ^ np.uint64(0x2545F491))), full[i] | full[j]
            out.append(keys if all_ else keys[full])
    return np.concatenate(out)


def bitmap(s: np.ndarray, width: int) -> bytes:
    flags = np.zeros(width, np.uint8)
    flags[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def folded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap rows of one width: the wider ones are folded (a bit's place is the low bits of the hash)."""
    w = min(a.shape[1], b.shape[1])
    fold = lambda x: x if x.shape[1] == w else np.bitwise_or.reduce(x.reshape(len(x), -1, w), axis=1)
    return fold(a), fold(b)


def bitmap_bound(na, a: np.ndarray, b: np.ndarray, nb) -> np.ndarray:
    """Upper bound of the overlap of sets with the bitmap rows ``a`` and ``b`` (64-bit words): each bit set on one
    side only stands for at least one element that the other lacks."""
    only_a = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
    only_b = np.bitwise_count(~a & b).sum(axis=1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def reaches(overlap, na, nb, num: int, den: int):
    return den * overlap >= num * (na + nb - overlap)


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are in the ascending array."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix64(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).astype(np.int64)), int(mix64(s + np.uint64(0x1234567)).sum(dtype=np.uint64).astype(np.int64))


def _sets(table: pa.Table, k: int):
    """(row, set) of the documents of a block."""
    data, offsets = buffers(table["text"])
    for i, j in slices(offsets, SLICE):
        yield from enumerate(ngram_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], k), i)


def _members(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """Per document (tile null): doc_id, n, d1, d2, and bits if it shares a tile with another set; per shared tile: tile, doc_id, d1."""
    blocks = n_blocks(docs)
    shards = blocks
    grouped = Blocks(docs, blocks, ["doc_id", "text"])

    def tiles_of(table: pa.Table):
        """Distinct tiles of a block, a mark of the one set in each, and whether it holds more than one.

        A tile travels as its shard and 32 bits; the mark is 32 bits of the set's digest mixed with the tile, so two sets that
        agree by chance in one tile differ in the others that they share."""
        keys, first = [], []
        for _, s in _sets(table, k):
            if len(s):
                t = tiles(s, bands)
                keys.append(t)
                first.append(mix64(t ^ np.int64(_digest(s)[0]).astype(np.uint64)).astype(np.uint32))
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        keys, first = short(np.concatenate(keys), shards), np.concatenate(first)
        order = np.lexsort((first, keys))
        keys, first = keys[order], first[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[at], first[at], (first[at] != first[np.r_[at[1:], len(keys)] - 1]).astype(np.uint8)

    def request(table: pa.Table) -> pa.Table:
        keys, mark, two = tiles_of(table)
        return ask((keys & LOW).astype(np.uint32), (keys >> np.uint64(32)).astype(np.int32), table["block"][0].as_py(), mark, two)

    def shard(table: pa.Table) -> pa.Table:
        s = Shard(table, [np.uint32, np.uint8], np.uint32)
        low = s.per_key(np.minimum, s.vals[0], np.iinfo(np.uint32).max)
        high = s.per_key(np.maximum, s.vals[0], 0)
        two = s.per_key(np.maximum, s.vals[1], 0)
        return s.reply(((low != high) | (two > 0)).astype(np.uint8))

    def emit(table: pa.Table, reply: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(6)]
        keys, _, _ = tiles_of(table)
        shared = keys[answers(reply, [np.uint8])[0] > 0]
        ids = table["doc_id"].to_pylist()
        for i, s in _sets(table, k):
            d1, d2 = _digest(s)
            mine = tiles(s, bands) if len(s) and ids[i] is not None else shared[:0]
            mine = mine[_among(short(mine, shards), shared)]
            for c, v in zip(cols, (None, ids[i], len(s), d1, d2, bitmap(s, bands.bits(len(s))) if len(mine) else None)):
                c.append(v)
            for t in mine.astype(np.int64).tolist():
                for c, v in zip(cols, (t, ids[i], len(s), d1, d2, None)):
                    c.append(v)
        types = [pa.int64()] * 5 + [pa.binary()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("tile", "doc_id", "n", "d1", "d2", "bits"), cols, types)})

    wants = grouped.each(request, asked(2))
    replies = wants.groupBy("shard").applyInArrow(shard, answered(1))
    return written(grouped.meet(replies, emit, "tile long, doc_id long, n long, d1 long, d2 long, bits binary"), "jaccard")


def _sides(pairs: DataFrame, sets: DataFrame, col: str) -> DataFrame:
    """Pairs (a, b) with size and ``col`` of both sets."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col(col).alias(f"{col}{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", f"{col}a", f"{col}b")


def _kept(pairs: DataFrame, test) -> DataFrame:
    """The pairs of :func:`_sides` that ``test(na, nb, words a, words b)`` accepts."""
    def check(batches):
        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            x, y = batch.column(4), batch.column(5)
            keep = [i for i in range(batch.num_rows) if test(na[i], nb[i], np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64))]
            take = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])
    return pairs.mapInArrow(check, "a long, b long")


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes and bitmaps allow a link. Written: only their documents' sets are formed."""
    def test(na, nb, a, b):
        if not reaches(min(na, nb), na, nb, num, den):
            return False
        return reaches(bitmap_bound(na, *folded(a[None], b[None]), nb)[0], na, nb, num, den)
    return written(_kept(_sides(pairs, sets, "bits"), test), "possible")


def _arrays(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, items (sorted array) of the documents in ``pairs``, formed again from their texts: few documents reach a
    possible pair, and all others' sets need not be kept. Spark broadcasts the ids only if their table is small."""
    ids = written(pairs.select(F.col("a").alias("__id")).union(pairs.select("b")).distinct(), "ids")

    def scan(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for lo in range(0, t.num_rows, 256):
                part = t.slice(lo, 256)
                sets = [s for _, s in _sets(part, k)]
                yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "items"])

    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left_semi").mapInArrow(scan, "doc_id long, n long, items array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs whose sets reach the threshold, by the exact intersection of their sorted arrays. Spark intersects
    them itself, so no batch of large sets stands in a Python worker."""
    both = _sides(pairs, _arrays(docs, pairs, k), "items")
    overlap = F.size(F.array_intersect("itemsa", "itemsb"))
    return both.where(reaches(overlap, F.col("na"), F.col("nb"), num, den)).select("a", "b")


def _close_pairs(cell: np.ndarray, ids, comp, n, chunk, cross, bits: list, num: int, den: int):
    """Pairs of rows of one cell (rows lie by cell) in different components whose sizes and bitmaps allow a link; in a
    cell of two chunks only pairs across them. Rows are compared at distance 1, 2, ... for all cells at once."""
    width = np.array([len(x) for x in bits])
    at_of = np.cumsum(width) - width
    words = np.frombuffer(b"".join(bits), np.uint64)
    end = np.searchsorted(cell, cell, side="right")
    out_a, out_b = [], []
    rows, d = np.arange(len(cell)), 1
    while True:
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        i, j = rows, rows + d
        ok = (comp[i] != comp[j]) & (ids[i] != ids[j]) & reaches(np.minimum(n[i], n[j]), n[i], n[j], num, den) & (~cross[i] | (chunk[i] != chunk[j]))
        i, j = i[ok], j[ok]
        keep = np.ones(len(i), bool)
        for wi, wj in set(zip(width[i].tolist(), width[j].tolist())):
            at = np.flatnonzero((width[i] == wi) & (width[j] == wj))
            for lo in range(0, len(at), 4096):
                part = at[lo:lo + 4096]
                x, y = words[at_of[i[part], None] // 8 + np.arange(wi // 8)], words[at_of[j[part], None] // 8 + np.arange(wj // 8)]
                keep[part] = reaches(bitmap_bound(n[i[part]], *folded(x, y), n[j[part]]), n[i[part]], n[j[part]], num, den)
        out_a.append(np.minimum(ids[i[keep]], ids[j[keep]]))
        out_b.append(np.maximum(ids[i[keep]], ids[j[keep]]))
        d += 1
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([cat(out_a), cat(out_b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _cross_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members of one tile in different components whose bitmaps allow a link.

    members: tile, doc_id, component, n, bits, chunks (of its tile). Chunks of a large tile meet two by two (a cell each), so no
    task must hold more than two of them together."""
    chunk = F.pmod(F.xxhash64("doc_id"), "chunks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cells = members.withColumn("chunk", chunk).withColumn("other", other).select("tile", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "doc_id", "component", "n", "bits", "chunk")

    def scan(batches):
        def pairs(t: pa.Table):
            tile, lo, hi, ids, comp, n, _, chunk = (t.column(i) for i in range(8))
            tile, lo, hi, ids, comp, n, chunk = (c.to_numpy() for c in (tile, lo, hi, ids, comp, n, chunk))
            cell = np.cumsum(np.r_[False, (tile[1:] != tile[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            a, b = _close_pairs(cell, ids, comp, n, chunk, lo != hi, t.column(6).to_pylist(), num, den)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        waiting = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if waiting is None else pa.concat_tables([waiting, t]).combine_chunks()
            key = [t.column(i).to_numpy() for i in range(3)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            full = int(change[-1]) if len(change) else 0  # the last cell may go on in the next batch
            if full:
                yield pairs(t.slice(0, full))
            waiting = t.slice(full)
        if waiting is not None and waiting.num_rows:
            yield pairs(waiting)

    return cells.repartition("tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi").mapInArrow(scan, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of the links with den * |A & B| >= num * |A | B|.

    A-Z are lower-cased; words are runs outside space and U+0009-U+000D; a set holds the distinct k-word
    shingles, or the whole sequence where there are fewer words. Texts without words (null, empty, blank)
    have an empty set and link with nothing. Equal sets form one class first and enter as its smallest doc_id. Every
    link found is exact; none is lost but for equal 64-bit hashes. Rows that share a doc_id are one node; a null
    doc_id links with nothing and has a null component. No rows give no rows.
    """
    bands = Bands(num, den)
    table = _members(docs, k, bands)
    rows = table.where("tile is null")
    members = written(table.where("tile is not null").groupBy("tile", "d1").agg(F.min("doc_id").alias("doc_id")).select("tile", "doc_id"), "tiles")
    sets = rows.where("bits is not null").select("doc_id", "n", "bits")
    centre = members.groupBy("tile").agg(F.min("doc_id").alias("b"))
    stars = members.join(centre, "tile").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    links = written(_verified(docs, _possible(stars, sets, num, den), k, num, den), "links")
    first = components(links)
    labelled = members.join(first, F.col("doc_id") == F.col("node"), "left").select("tile", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("tile", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    crossing = labelled.join(mixed, "tile").join(sets, "doc_id")
    more = _verified(docs, written(_cross_pairs(crossing, num, den), "possible"), k, num, den)
    final = components(links.union(more))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("least"))
    named = classes.join(final, F.col("least") == F.col("node"), "left").select("n", "d1", "d2", F.coalesce("component", "least").alias("class"))
    out = rows.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT doc_id, CASE WHEN x IS NULL OR len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(x) - 1), lambda i: array_to_string(x[i:i + 2], ' '))) END AS g FROM w),
c AS (SELECT g, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
e AS (SELECT rep, len(g) AS n, unnest(g) AS h FROM c),
i AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS o FROM e a JOIN e b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * o >= 90 * (na + nb - o)),
z AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS reach FROM c UNION SELECT r.node, z.b FROM r JOIN z ON z.a = r.reach),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.g = list_sort(s.g) LEFT JOIN m ON m.node = c.rep
"""
