"""Language-model scoring with a log-frequency Bloom filter of word n-gram counts.

Counts of n-grams are quantised to powers of ``BASE`` and held in a log-frequency Bloom filter: an n-gram of level q
is entered as (n-gram, 1) ... (n-gram, q); a level is read back by probing upwards until one is missing, so the filter's
errors only ever read too high; a level counts as its lowest count. A filter of all n-grams grows with the corpus, so it is not broadcast whole: it is
cut by n-gram hash into shards of bounded size, and each shard goes to the one worker that answers for it. Blocks of
documents send every distinct n-gram once to its shard, with its training count; the shard adds the counts, enters
them into its part of the filter, forgets them, and answers by membership probes.

The model mixes orders with fixed weights: p_n(w | h) = (1 - WEIGHT) p_(n-1)(w | h') + WEIGHT c(hw) / c(h) where c(h) > 0,
else p_(n-1). Order 1 is absolutely discounted, p_1(w) = (c(w) - D) / N, and an unseen token takes the discounted mass
D V / N as one unknown token, D = n1 / (n1 + 2 n2) from the numbers of tokens seen once and twice. Without errors of the filter the
probabilities after a history sum to at most 1: order 1 sums to 1, and what rounding a count down takes is given to no word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOW, Blocks, Lookup, Shard, Sums, answered, answers, ask, asked, buffers, by_splitmix, mix64, n_blocks, owner, ship_code, short, slices, summed, word_hashes

ORDER = 2
WEIGHT = 0.3
BASE = 2.0
PROBES = 3
BITS_PER_ENTRY = 12
LINE = 512
SLICE = 1 << 19
END = np.uint64(0x0E0E0E0E0E0E0E0E)


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised log count from 1; 0 for no count."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """Lower end of the counts of a level; level 0 is 0. Counts read never exceed the true ones, so the shares of a history never sum to more than 1."""
    return np.where(levels > 0, np.ceil(BASE ** (np.maximum(levels, 1).astype(np.float64) - 1) - 1e-9), 0.0)


class Filter:
    """A log-frequency Bloom filter; all probes of a key fall into one line of ``LINE`` bits."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        q = level(counts)
        self.lines = max(1, -(-int(q.sum()) * BITS_PER_ENTRY // LINE))
        flags = np.zeros(self.lines * LINE, bool)
        for lev in range(1, int(q.max(initial=0)) + 1):
            k = keys[q >= lev]
            for at in self._places(k, lev):
                flags[at] = True
        self.bits = np.packbits(flags, bitorder="little")

    def _places(self, keys: np.ndarray, lev: int):
        line = owner(mix64(keys), self.lines).astype(np.int64) * LINE
        for p in range(PROBES):
            yield line + (mix64(keys ^ mix64(np.full(1, lev * 64 + p, np.uint64))) & np.uint64(LINE - 1)).astype(np.int64)

    def read(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key by repeated membership probes."""
        out = np.zeros(len(keys), np.uint8)
        alive, lev = np.arange(len(keys)), 1
        while len(alive) and lev < 64:
            hit = np.ones(len(alive), bool)
            for at in self._places(keys[alive], lev):
                hit &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            alive = alive[hit]
            out[alive] = lev
            lev += 1
        return out


class Tokens:
    """Token hashes of a run of texts (words, then one end each), and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        h, at = word_hashes(data, offsets)
        n, words = len(offsets) - 1, np.diff(at)
        self.counts = words + 1
        self.keys = np.full(len(h) + n, END, np.uint64)
        self.keys[np.arange(len(h)) + np.repeat(np.arange(n), words)] = h
        self.ends = np.cumsum(self.counts) - 1
        self.depth = np.arange(len(self.keys)) - np.repeat(np.r_[0, self.ends[:-1] + 1], self.counts)

    def before(self, k: int) -> np.ndarray:
        """The token ``k`` places earlier; before the start of a text stands its end token."""
        out = np.full(len(self.keys), END, np.uint64)
        out[k:] = self.keys[:len(self.keys) - k]
        out[self.depth < k] = END
        return out

    def grams(self, order: int) -> np.ndarray:
        """Hashes of the n-grams that end at each token."""
        seeds = by_splitmix(order, 17 * order) | np.uint64(1)
        with np.errstate(over="ignore"):
            return mix64(sum((self.before(k) * seeds[k] for k in range(order)), np.uint64(0)))


def word_statistics(train: DataFrame, shards: int) -> tuple[int, int, int, int]:
    """(N, V, n1, n2) of the training tokens: all, distinct, seen once, seen twice. Four numbers reach the driver."""
    ship_code(train.sparkSession)

    def scan(batches):
        sums = Sums()
        for b in batches:
            data, offsets = buffers(b.column(0))
            for i, j in slices(offsets, SLICE):
                t = Tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                sums.add(*summed(t.keys, np.ones(len(t.keys), np.int64)))
                if sums.full:
                    keys, vals = sums.flush()
                    yield from ask(keys, owner(keys, shards), 0, vals.astype(np.int64)).to_batches()
        keys, vals = sums.flush()
        yield from ask(keys, owner(keys, shards), 0, vals.astype(np.int64)).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        s = Shard(table, [np.int64])
        c = s.per_key(np.add, s.vals[0], 0)
        return pa.table({k: pa.array([int(x)], pa.int64()) for k, x in (("n", c.sum()), ("v", len(c)), ("n1", (c == 1).sum()), ("n2", (c == 2).sum()))})

    got = train.select("text").mapInArrow(scan, asked(1)).groupBy("shard").applyInArrow(merge, "n long, v long, n1 long, n2 long")
    return tuple(int(x or 0) for x in got.agg(*[F.sum(c) for c in ("n", "v", "n1", "n2")]).first())


def lm_scores(docs: DataFrame, held_out=None, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``held_out`` is a boolean column (default: crc32 of doc_id as text, mod 7, is 2; a null doc_id is not held out);
    the model learns from all other rows. Tokens are the words with A-Z lower-cased (runs outside space and
    U+0009-U+000D), then one end; a null or empty text is its end alone. ``base_score`` is the sum of
    log10((c + 1) / (N + V + 1)); ``score`` the model's. Token counts are exact but for equal 64-bit hashes. Repeated
    rows count and score each time; with no training rows every token has probability 1 (the unknown token is all there
    is); no rows give no rows.
    """
    if held_out is None:
        held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    blocks = n_blocks(docs)
    shards = blocks
    n, v, n1, n2 = word_statistics(docs.where(~held_out), shards)
    discount = n1 / (n1 + 2 * n2) if n1 else 0.5
    grouped = Blocks(docs.withColumn("__held", held_out), blocks, ["doc_id", "text", "__held"])

    def runs(t: pa.Table):
        data, offsets = buffers(t["text"])
        held = t["__held"].to_numpy()
        for i, j in slices(offsets, SLICE):
            yield Tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]), ~held[i:j]

    def keys_of(t: pa.Table):
        """Distinct tokens and, for each order from 2, distinct short n-grams of a block, with their training counts."""
        sums = [Sums() for _ in range(order)]
        for tokens, train in runs(t):
            once = np.repeat(train, tokens.counts).astype(np.int64)
            for o in range(order):
                sums[o].add(*summed(short(tokens.grams(o + 1), shards) if o else tokens.keys, once))
        return [s.flush() for s in sums]

    def request(t: pa.Table) -> pa.Table:
        block, parts = t["block"][0].as_py(), []
        for o, (keys, counts) in enumerate(keys_of(t)):
            if o:
                parts.append(ask((keys & LOW).astype(np.uint32), (keys >> np.uint64(32)).astype(np.int32), block, counts.astype(np.uint32), kind=o))
            else:
                parts.append(ask(keys, owner(keys, shards), block, counts.astype(np.uint32)))
        return pa.concat_tables(parts)

    def shard(t: pa.Table) -> pa.Table:
        kind = t["kind"][0].as_py()
        s = Shard(t, [np.uint32], np.uint32 if kind else np.uint64)
        counts = s.per_key(np.add, s.vals[0].astype(np.int64), 0)
        if not kind:
            return s.reply(counts)
        keys = s.keys.astype(np.uint64) | np.uint64(s.shard) << np.uint64(32)
        return s.reply(Filter(keys[counts > 0], counts[counts > 0]).read(keys))

    def score(t: pa.Table, reply: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], []]
        asked_for = [Lookup(k) for k, _ in keys_of(t)]
        known = [answers(reply, [np.int64])[0].astype(np.float64)] + [count_of(answers(reply, [np.uint8], o)[0].astype(np.int64)) for o in range(1, order)]
        for tokens, _ in runs(t):
            find = lambda o, k: known[o][asked_for[o].find(k)]
            c = find(0, tokens.keys)
            p = np.where(c > 0, c - discount, discount * v) / n if n else np.ones(len(c))
            history, seen = find(0, tokens.before(1)), None
            for o in range(1, order):
                seen = np.minimum(np.minimum(find(o, short(tokens.grams(o + 1), shards)), history), c)
                p = np.where(history > 0, (1 - WEIGHT) * p + WEIGHT * seen / np.maximum(history, 1), p)
                history = np.r_[0.0, seen[:-1]] * (tokens.depth >= 1)
            at = tokens.ends - tokens.counts + 1
            cols[0].append(tokens.counts)
            cols[1].append(np.add.reduceat((c > 0).astype(np.int64), at))
            cols[2].append(np.add.reduceat(np.log10((c + 1) / (n + (v + 1))), at))
            cols[3].append(np.add.reduceat(np.log10(p), at))
        counts, hits, base, model = (np.concatenate(x) if x else np.zeros(0) for x in cols)
        return pa.table({"doc_id": t["doc_id"], "held_out": t["__held"], "n_tokens": pa.array(counts, pa.int64()), "n_known": pa.array(hits, pa.int64()), "train_tokens": pa.array(np.full(len(counts), n), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(model, pa.float64())})

    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    replies = grouped.each(request, asked(1)).groupBy("kind", "shard").applyInArrow(shard, answered(1))
    return grouped.meet(replies, score, schema)
