"""Phrase collocations by direct-address tiling.

Words that are frequent enough are numbered by falling frequency. A pair of neighbours is a cell of the matrix of (left, right) numbers, which is cut into
tiles of ``TILE`` x ``TILE`` cells. The tiles of the most frequent numbers are dense: their cells are the addresses of a count array
(``numpy.bincount``). All other tiles are sparse: sorted coordinates with counts (COO), dealt to shards by their tile. Pairs that are frequent are numbered
in turn by falling frequency, and a phrase of k words is the pair of its first k - 1 words and its last word, and so on up to the longest phrase.

Texts stay where the scan reads them: each task cuts its documents into blocks of some MB and writes them as sequences of numbers of the block's own
words, which is all that later steps read. A block counts its own cells first and sends each tile once; sums of tiles run over ``FAN`` blocks at a
time, as a tree, so the most frequent tile is no hot task however many blocks there are. The numbers of frequent words and pairs return to the blocks
by the same shards and tiles. A word or pair below the threshold gets no number, and no phrase holds it.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, Stages, mix64, packed, placed, ship_code, spare_memory, squeeze, summed, unpacked, unsqueeze, written

TILE, DENSE = 1024, 4
FAN, FAN_SPARSE = 64, 4096
SLICE = 1 << 20
SEPARATORS = b".,;:!?\x0A\x0B\x0C\x0D"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + SEPARATORS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(SEPARATORS))

TEXTS = "lang string, block long, words binary, counts binary, tokens binary, total long"
WORDS = "lang string, shard int, block long, words binary, counts binary, places binary"
ASKED = "lang string, part int, block long, keys binary, counts binary"
STATE = "lang string, block long, words binary, prev binary"


# ------------------------------------------------------------------ inside a block
def tokens(texts: list[bytes]):
    """Lists of words in order, ``.`` between pieces and texts, of about ``SLICE`` bytes each."""
    raw = b".".join(texts).translate(_TABLE)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].replace(b".", b" . ").split()  # white space left in the bytes: space and tab
        at = end


def _pack_words(words: list[bytes]) -> bytes:
    return zlib.compress(b"\n".join(words), 3)


def _unpack_words(raw) -> list[bytes]:
    return zlib.decompress(raw).split(b"\n")


def neighbours(prev: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Places p where a phrase of k words may start: its first k - 1 words and (beyond pairs) its last k - 1 are frequent phrases, its last is a frequent word."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    ok = (prev[:m] >= 0) & (words[k - 1:k - 1 + m] >= 0)
    if k > 2:
        ok &= prev[1:m + 1] >= 0
    return np.flatnonzero(ok)


def _key(prev: np.ndarray, words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return prev[at].astype(np.uint64) << np.uint64(32) | words[at + k - 1].astype(np.uint64)


def _cell(key: np.ndarray, tile: int) -> np.ndarray:
    t = np.uint64(tile)
    return ((key >> np.uint64(32)) % t * t + (key & np.uint64(0xFFFFFFFF)) % t).astype(np.int64)


def count_tile(keys: np.ndarray, counts: np.ndarray | None, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of one tile, ascending, and their sums: by direct address where a sixteenth of the cells may be hit, else sorted."""
    if len(keys) * 16 >= tile * tile:
        cell = _cell(keys, tile)
        n = np.bincount(cell, counts, tile * tile)  # sums as doubles are exact below 2**53
        hit = np.flatnonzero(n)
        base = (keys[0] >> np.uint64(32)) // np.uint64(tile) * np.uint64(tile), (keys[0] & np.uint64(0xFFFFFFFF)) // np.uint64(tile) * np.uint64(tile)
        left, right = np.divmod(hit.astype(np.uint64), np.uint64(tile))
        return (base[0] + left) << np.uint64(32) | (base[1] + right), n[hit].astype(np.int64)
    return summed(keys, np.ones(len(keys), np.int64) if counts is None else counts)


def cells(key: np.ndarray, tile: int, dense: int, shards: int):
    """(part, keys, counts) of the dense tiles and of the shards of sparse tiles that ``key`` reaches."""
    t = np.uint64(tile)
    row, col = (key >> np.uint64(32)) // t, (key & np.uint64(0xFFFFFFFF)) // t
    near = (row < dense) & (col < dense)
    of = (row[near] * np.uint64(dense) + col[near]).astype(np.uint16)
    order = np.argsort(of, kind="stable")
    mine, of = key[near][order], of[order]
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
    for i, j in zip(at, [*at[1:], len(of)]):
        yield int(of[i]), *count_tile(mine[i:j], None, tile)
    far, counts = summed(key[~near], np.ones(int((~near).sum()), np.int64))
    if len(far):
        shard = (mix64((far >> np.uint64(32)) // t << np.uint64(32) | (far & np.uint64(0xFFFFFFFF)) // t) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        for i, j in zip(at, [*at[1:], len(shard)]):
            yield dense * dense + int(shard[i]), far[order[i:j]], counts[order[i:j]]


# ------------------------------------------------------------------ steps
def _texts(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of the scan's tasks, a row for each language: its distinct words with counts, and its texts as numbers of these words (-1 between pieces)."""
    ship_code(docs.sparkSession)
    spare = spare_memory

    def encode(batches):
        held: dict[str, list[bytes]] = {}
        size = chunk = 0

        def out():
            nonlocal chunk
            for lang, texts in held.items():
                seen, ids, parts = Counter(), {b".": -1}, []
                for part in tokens(texts):
                    for word in part:
                        if word not in ids:
                            ids[word] = len(ids) - 1
                    seen.update(part)
                    parts.append(np.fromiter(map(ids.__getitem__, part), np.int32, len(part)))
                seen.pop(b".", None)
                del ids[b"."]
                if ids:
                    counts = np.fromiter(map(seen.__getitem__, ids), np.int64, len(ids))
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "block": [part_id * (1 << 32) + chunk], "words": [_pack_words(list(ids))], "counts": [squeeze(counts)],
                                                      "tokens": [squeeze(np.concatenate(parts))], "total": [int(counts.sum())]}, schema)
            held.clear()
            chunk += 1

        schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("total", pa.int64())])
        part_id = 0
        for b in batches:
            for k in range(0, b.num_rows, 500):
                few = b.slice(k, 500)
                part_id = few["part"][0].as_py()
                for lang, text in zip(few["lang"].to_pylist(), pc.fill_null(few["text"].cast(pa.large_binary()), b"").to_pylist()):
                    held.setdefault(lang, []).append(text)
                    size += len(text)
                    if size > block_bytes:
                        yield from out()
                        size = 0
        yield from out()
        spare()
    rows = docs.select(F.spark_partition_id().alias("part"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text"))
    return rows.mapInArrow(encode, TEXTS)


def _words(texts: DataFrame, shards: int) -> DataFrame:
    """Each block's words by shard, with their counts and their numbers in the block."""
    def deal(batches):
        for b in batches:
            for lang, block, words, counts in zip(b["lang"].to_pylist(), b["block"].to_pylist(), b["words"], b["counts"]):
                words, counts = _unpack_words(words.as_buffer()), unsqueeze(counts.as_buffer(), np.int64)
                of = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % shards
                order = np.argsort(of, kind="stable").astype(np.int32)
                of = of[order]
                at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                rows = [order[i:j] for i, j in zip(at, [*at[1:], len(of)])]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array(of[at].astype(np.int32)), pa.array([block] * n, pa.int64()), pa.array([_pack_words([words[i] for i in r]) for r in rows], pa.binary()),
                     packed([counts[r] for r in rows]), packed(rows, True)], ["lang", "shard", "block", "words", "counts", "places"])
    return texts.select("lang", "block", "words", "counts").mapInArrow(deal, WORDS)


def _frequent_words(words: DataFrame, least: int) -> DataFrame:
    """lang, shard, word, count of the words with at least ``least`` occurrences."""
    def add(t: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for some, counts in zip(t["words"], unpacked(t["counts"], np.int64)):
            for w, n in zip(_unpack_words(some.as_buffer()), counts.tolist()):
                total[w] = total.get(w, 0) + n
        total = {w: n for w, n in total.items() if n >= least}
        return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(total), pa.string()), "shard": pa.array([t["shard"][0].as_py()] * len(total), pa.int32()),
                         "word": pa.array(list(total), pa.binary()).cast(pa.string()), "count": pa.array(list(total.values()), pa.int64())})
    return words.drop("places").groupBy("lang", "shard").applyInArrow(add, "lang string, shard int, word string, count long")


def _encoded(texts: DataFrame, words: DataFrame, level: DataFrame) -> DataFrame:
    """The blocks' texts as numbers of frequent words; -1 for other words and between pieces."""
    def reply(ask: pa.Table, known: pa.Table) -> pa.Table:
        ids = dict(zip(known["word"].cast(pa.binary()).to_pylist(), known["id"].to_pylist()))
        out: list[list] = [[], [], [], []]
        for lang, block, some, places in zip(ask["lang"].to_pylist(), ask["block"].to_pylist(), ask["words"], unpacked(ask["places"], np.int32, True)) if ids else ():
            mine = np.array([ids.get(w, -1) for w in _unpack_words(some.as_buffer())], np.int32)
            hit = mine >= 0
            if hit.any():
                for c, v in zip(out, (lang, block, places[hit], mine[hit])):
                    c.append(v)
        return pa.table({"lang": pa.array(out[0], pa.string()), "block": pa.array(out[1], pa.int64()), "places": packed(out[2], True), "ids": packed(out[3])})

    def encode(t: pa.Table, replies: pa.Table) -> pa.Table:
        known: dict[str, list] = {}
        for lang, places, ids in zip(replies["lang"].to_pylist(), unpacked(replies["places"], np.int32, True), unpacked(replies["ids"], np.int32)):
            known.setdefault(lang, []).append((places, ids))
        langs, out = [], []
        for lang, text in zip(t["lang"].to_pylist(), unpacked(t["tokens"], np.int32)):
            if lang in known:
                number = np.full(int(text.max()) + 2, -1, np.int32)  # the last entry is what -1 finds
                for places, ids in known[lang]:
                    number[places] = ids
                langs.append(lang)
                out.append(squeeze(number[text]))
        n = len(langs)
        return pa.table({"lang": pa.array(langs, pa.string()), "block": pa.array([t["block"][0].as_py()] * n if n else [], pa.int64()), "words": pa.array(out, pa.binary()), "prev": pa.array([b""] * n, pa.binary())})

    replies = words.drop("counts").groupBy("lang", "shard").cogroup(level.select("lang", "shard", "word", "id").groupBy("lang", "shard")).applyInArrow(reply, "lang string, block long, places binary, ids binary")
    return texts.select("lang", "block", "tokens").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(encode, STATE)


def _state(words, prev) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's words, and of the phrases that begin with them (nothing stored: of the words themselves)."""
    words, prev = unsqueeze(words.as_buffer(), np.int32), prev.as_buffer()
    return words, unsqueeze(prev, np.int32) if len(prev) else words


def _asked(state: DataFrame, k: int, tile: int, dense: int, shards: int) -> DataFrame:
    """Each block's cells of level k with their counts, a row for each tile or shard."""
    def ask(batches):
        for b in batches:
            for lang, block, words, prev in zip(b["lang"].to_pylist(), b["block"].to_pylist(), b["words"], b["prev"]):
                words, prev = _state(words, prev)
                parts = list(cells(_key(prev, words, neighbours(prev, words, k), k), tile, dense, shards))
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([p[0] for p in parts], pa.int32()), pa.array([block] * n, pa.int64()), packed([p[1] for p in parts], True), packed([p[2] for p in parts])],
                    ["lang", "part", "block", "keys", "counts"])
    return state.mapInArrow(ask, ASKED)


def _frequent(asked: DataFrame, blocks: int, tile: int, dense: int, least: int) -> DataFrame:
    """lang, part, left, right, n of the cells with at least ``least`` over all blocks: sums over ``FAN`` blocks (sparse: ``FAN_SPARSE``) at a time."""
    def add(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(unpacked(t["keys"], np.uint64, True)), np.concatenate(unpacked(t["counts"], np.int64))
        return count_tile(keys, counts, tile) if t["part"][0].as_py() < dense * dense else summed(keys, counts)

    def some(t: pa.Table) -> pa.Table:
        keys, counts = add(t)
        return pa.table({"lang": t["lang"][:1], "part": t["part"][:1], "block": t["fold"][:1], "keys": packed([keys], True), "counts": packed([counts])})

    def last(t: pa.Table) -> pa.Table:
        keys, counts = add(t)
        keep = counts >= least
        keys, n = keys[keep], int(keep.sum())
        return pa.table({"lang": pa.array([t["lang"][0].as_py()] * n, pa.string()), "part": pa.array([t["part"][0].as_py()] * n, pa.int32()),
                         "left": pa.array((keys >> np.uint64(32)).astype(np.int64)), "right": pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), "count": pa.array(counts[keep])})

    while blocks > FAN:
        blocks = -(-blocks // FAN)
        asked = asked.withColumn("fold", _fold(blocks, dense)).groupBy("lang", "part", "fold").applyInArrow(some, ASKED)
    return asked.groupBy("lang", "part").applyInArrow(last, "lang string, part int, left long, right long, count long")


def _folds(blocks: int, dense: int):
    """How many folds ``blocks`` groups of ``FAN`` blocks make: one each for dense tiles, one for ``FAN_SPARSE // FAN`` of them for sparse ones."""
    return F.when(F.col("part") < dense * dense, blocks).otherwise(-(-blocks // max(1, FAN_SPARSE // FAN)))


def _fold(blocks: int, dense: int):
    return F.pmod(F.xxhash64("block"), _folds(blocks, dense)).cast("long")


def _numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with ``id``: their number in their language by falling count."""
    return written(placed(rows.withColumn("__neg", -F.col("count")), "lang", ["__neg", *by], f"{name}-ranges").withColumnRenamed("at", "id").drop("n", "__neg"), name)


def _next(state: DataFrame, asked: DataFrame, level: DataFrame, blocks: int, k: int, dense: int) -> DataFrame:
    """The state with the numbers of the frequent phrases of k words at their first words; words outside all of them lose theirs."""
    def reply(ask: pa.Table, known: pa.Table) -> pa.Table:
        keys = known["left"].to_numpy().astype(np.uint64) << np.uint64(32) | known["right"].to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        keys, ids = keys[order], known["id"].to_numpy()[order].astype(np.int32)
        out: list[list] = [[], [], [], []]
        for lang, block, mine in zip(ask["lang"].to_pylist(), ask["block"].to_pylist(), unpacked(ask["keys"], np.uint64, True)) if len(keys) else ():
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[at] == mine
            if hit.any():
                for c, v in zip(out, (lang, block, mine[hit], ids[at[hit]])):
                    c.append(v)
        return pa.table({"lang": pa.array(out[0], pa.string()), "block": pa.array(out[1], pa.int64()), "keys": packed(out[2], True), "ids": packed(out[3])})

    def step(old: pa.Table, replies: pa.Table) -> pa.Table:
        found: dict[str, list] = {}
        for lang, keys, ids in zip(replies["lang"].to_pylist(), unpacked(replies["keys"], np.uint64, True), unpacked(replies["ids"], np.int32)):
            found.setdefault(lang, []).append((keys, ids))
        out: list[list] = [[], [], []]
        for lang, words, prev in zip(old["lang"].to_pylist(), old["words"], old["prev"]):
            if lang not in found:
                continue
            words, prev = _state(words, prev)
            keys, ids = (np.concatenate(x) for x in zip(*found[lang]))
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            at = neighbours(prev, words, k)
            mine = _key(prev, words, at, k)
            place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[place] == mine
            new, inside = np.full(len(words), -1, np.int32), np.zeros(len(words), bool)
            new[at[hit]] = ids[place[hit]]
            for j in range(k):
                inside[at[hit] + j] = True
            for c, v in zip(out, (lang, squeeze(np.where(inside, words, np.int32(-1))), squeeze(new))):
                c.append(v)
        n = len(out[0])
        return pa.table({"lang": pa.array(out[0], pa.string()), "block": pa.array([old["block"][0].as_py()] * n if n else [], pa.int64()), "words": pa.array(out[1], pa.binary()), "prev": pa.array(out[2], pa.binary())})

    groups = -(-blocks // FAN)
    known = level.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), _folds(groups, dense).cast("long") - 1))).select("lang", "part", "fold", "left", "right", "id")
    group = ["lang", "part", "fold"]
    replies = asked.drop("counts").withColumn("fold", _fold(groups, dense)).groupBy(*group).cogroup(known.groupBy(*group)).applyInArrow(reply, "lang string, block long, keys binary, ids binary")
    return state.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(step, STATE)


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, tile: int = TILE, dense: int = DENSE, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase, words, count and ``before`` of every phrase of 1 to ``longest`` words with at least ``least`` occurrences, and lang, n.

    ``before`` lists the counts of the phrase's first 1, 2, ... words; ``n`` counts all words of a language. Words are case-folded over A-Z and split at
    space and tab inside pieces, which end at ``.,;:!?`` and line breaks. A null language is ``und``, a null text empty. Counts are over whole texts;
    repeated rows count each time; ids play no part. No rows, or no word, give no rows.
    """
    held = Stages(docs.sparkSession)
    texts = held.write(_texts(docs, block_bytes), "phrases-texts")
    n = max(1, texts.select("block").distinct().count())
    shards = -(-n // 4)
    totals = written(texts.groupBy("lang").agg(F.sum("total").alias("n")), "phrases-totals")
    words = _words(texts, shards)
    level = _numbered(_frequent_words(words, least), ["word"], "phrases-1")
    one = level.select("lang", "id", F.col("word").alias("phrase"), F.lit(1).alias("words"), "count", F.array().cast("array<bigint>").alias("before"))
    found, of = [one], one
    state = held.write(_encoded(texts, words, level), "phrases-state-1")
    held.drop("phrases-texts")
    for k in range(2, longest + 1):
        asked = held.write(_asked(state, k, tile, dense, n), f"phrases-cells-{k}")
        level = _numbered(_frequent(asked, n, tile, dense, least), ["left", "right"], f"phrases-{k}")
        if level.isEmpty():
            break
        prefix = of.select("lang", F.col("id").alias("left"), F.col("phrase").alias("__p"), F.array_append("before", F.col("count")).alias("before"))
        last = one.select("lang", F.col("id").alias("right"), F.col("phrase").alias("__w"))
        of = level.join(prefix, ["lang", "left"]).join(last, ["lang", "right"])
        of = written(of.select("lang", "id", F.concat_ws(" ", "__p", "__w").alias("phrase"), F.lit(k).alias("words"), "count", "before"), f"phrases-found-{k}")
        found.append(of)
        if k < longest:
            state = held.write(_next(state, asked, level, n, k, dense), f"phrases-state-{k}")
            held.drop(f"phrases-state-{k - 1}", f"phrases-cells-{k}")
    held.drop(*held.paths)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.drop("id"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, absorb: int = 100, top: int | None = 2000, **kw) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases (None: all) by score and count, both falling, then by the phrase's bytes.

    A candidate has 2 to ``longest`` words and a >= ``least`` occurrences. Cut after its first k words it gives l and r, the occurrences of both parts, and
    floor(1000 * a * n / (l * r)); the lowest score counts, of equal ones that with the smallest k. A candidate inside a longer one goes if the
    longer one has at least ``absorb`` percent of its occurrences: one word longer is enough to look at, as what is between has as many at least.
    """
    every, totals = phrases(docs, least, longest, **kw)
    many = every.where("words > 1")
    cut = many.select("lang", "phrase", "words", F.col("count").alias("a"), "before", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = F.split("phrase", " ")
    cut = cut.select("lang", "phrase", "words", "a", "k", F.element_at("before", F.col("k")).alias("l"),
                     F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " ").alias("rest"))
    cut = cut.join(every.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products have up to 38 digits; more would raise
    cut = cut.withColumn("top", F.lit(1000).cast("decimal(4,0)") * wide("a")).withColumn("low", wide("l") * wide("r"))
    cut = written(cut.withColumn("score", F.expr("cast(cast(top as decimal(19,0)) * cast(n as decimal(19,0)) as decimal(38,0)) div cast(low as decimal(38,0))")), "phrases-cuts")
    scored = cut.groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("c"))
    share = F.col("a") * 100
    inner = (cut.where((F.col("k") == F.col("words") - 1) & (F.col("words") > 2) & (share >= F.col("l") * absorb)).select("lang", F.col("first").alias("phrase"))
             .union(cut.where((F.col("k") == 1) & (F.col("words") > 2) & (share >= F.col("r") * absorb)).select("lang", F.col("rest").alias("phrase"))).distinct())
    left = scored.join(inner, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)  # Spark cuts every task to the first rows of a language before the shuffle
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


ORACLE_SQL = """WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
  ), lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
  ), counts AS (
    SELECT lang, k, phrase, count(*) AS c FROM (
      SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM lists CROSS JOIN (VALUES (1), (2), (3), (4), (5)) s(k) WHERE len(w) >= k) g GROUP BY lang, k, phrase
  ), totals AS (SELECT lang, sum(c) AS n FROM counts WHERE k = 1 GROUP BY lang
  ), often AS (SELECT * FROM counts WHERE c >= 100
  ), cuts AS (
    SELECT t.lang, t.phrase, t.k, t.c AS a, j, l.c AS l, r.c AS r, n, 1000 * CAST(t.c AS HUGEINT) * n // (CAST(l.c AS HUGEINT) * r.c) AS score, l.phrase AS first, r.phrase AS rest
    FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM often WHERE k > 1) t
    JOIN often l ON l.lang = t.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN often r ON r.lang = t.lang AND r.phrase = array_to_string(w[j + 1:], ' ')
    JOIN totals s ON s.lang = t.lang
  ), inside AS (SELECT lang, first AS phrase FROM cuts WHERE j = k - 1 AND a >= l UNION SELECT lang, rest FROM cuts WHERE j = 1 AND a >= r
  ), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS q FROM cuts) x WHERE q = 1
  ), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best b
    WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase)
  )
  SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
  FROM ranked WHERE rank <= 2000"""
