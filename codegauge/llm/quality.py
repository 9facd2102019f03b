"""Quality classifier: perplexity under an interpolated modified Kneser-Ney byte n-gram model of trusted text.

Everything is a sharded count table joined by n-gram. N-grams are longs: language code, then up to ``ORDER`` bytes.
The counts of trusted text give, for every order, the Kneser-Ney counts (raw at the top, numbers of left
continuations below), context totals with the numbers of continuations seen once, twice and more, and the three discounts.
Blocks of documents send their distinct n-grams to shards; the distinct n-grams of the corpus are joined with these
tables order by order into probabilities, and each block gets back those of its own n-grams and adds them up for
each document. The cut of each language comes from quantiles over trusted documents left out of the training.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Blocks, Lookup, Shard, Sums, answered, answers, ask, asked, buffers, distinct, let_go, mix64, n_blocks, owner, ship_code, slices, unmix64, written

ORDER = 5
MAX_TRUSTED = 200_000
SLICE = 1 << 19
POOL = 0
SHIFT = 40


def lang_code(lang: str | None) -> int:
    """24-bit code of a language name, never that of the pooled model."""
    return zlib.crc32((lang or "").encode()) % ((1 << 24) - 1) + 1


def _code(lang: F.Column) -> F.Column:
    return F.crc32(F.coalesce(lang, F.lit("")).cast("binary")) % ((1 << 24) - 1) + 1


def _used(code: F.Column, trained: list[int]) -> F.Column:
    """The code of the model that judges a language."""
    return (F.when(code.isin(trained), code).otherwise(POOL) if trained else F.lit(POOL)).cast("long")


def byte_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ``ORDER`` bytes up to each byte of all texts; line feeds stand before a text."""
    out = data.astype(np.uint64)
    starts = offsets[:-1][np.diff(offsets) > 0]
    for k in range(1, ORDER):
        past = np.full(len(data), 10, np.uint64)
        past[k:] = data[:len(data) - k]
        for j in range(k):
            at = starts + j
            past[at[at < len(data)]] = 10  # reaches over the start; texts shorter than j are set again by their successor
        out |= past << np.uint64(8 * k)
    return out


def _keys(t: pa.Table | pa.RecordBatch, codes: np.ndarray):
    """(rows i..j, their byte counts, mixed key of each byte) over runs of texts."""
    data, offsets = buffers(t.column(t.schema.get_field_index("text")))
    for i, j in slices(offsets, SLICE):
        part = offsets[i:j + 1] - offsets[i]
        size = np.diff(part)
        yield i, j, size, mix64(byte_grams(data[offsets[i]:offsets[j]], part) | np.repeat(codes[i:j].astype(np.uint64) << np.uint64(SHIFT), size))


def count_grams(trusted: DataFrame) -> DataFrame:
    """(key, c): n-gram counts of the trusted texts by language, and pooled over all of them."""
    ship_code(trusted.sparkSession)

    def scan(batches):
        sums = Sums()
        let_go()

        def out():
            keys, vals = sums.flush()
            return pa.RecordBatch.from_arrays([pa.array(unmix64(keys).astype(np.int64)), pa.array(vals.astype(np.int64))], ["key", "c"])

        for b in batches:
            codes = b.column(b.schema.get_field_index("code")).to_numpy()
            for _, _, _, keys in _keys(b, codes):
                sums.add(*np.unique(keys, return_counts=True))
                if sums.full:
                    yield out()
        yield out()

    own = trusted.select("text", _code(F.col("lang")).cast("long").alias("code")).mapInArrow(scan, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    own = written(own, "grams")
    pooled = own.groupBy(F.col("key").bitwiseAND((1 << SHIFT) - 1).alias("key")).agg(F.sum("c").alias("c"))
    return own.union(pooled)


def _low(key: F.Column, order: int) -> F.Column:
    """Language and last ``order`` bytes."""
    return F.shiftleft(F.shiftright(key, SHIFT), SHIFT).bitwiseOR(key.bitwiseAND((1 << 8 * order) - 1))


def _context(key: F.Column, order: int) -> F.Column:
    """Language and the first ``order - 1`` of ``order`` bytes."""
    return F.shiftleft(F.shiftright(key, SHIFT), SHIFT).bitwiseOR(F.shiftright(key.bitwiseAND((1 << 8 * order) - 1), 8))


class KneserNey:
    """Count tables of all orders, written to the shared folder: grams (n, key, a), contexts (n, ctx, total, gap), with gap
    the mass that the discounts of a context free."""

    def __init__(self, counts: DataFrame):
        top = counts.select(F.lit(ORDER).alias("n"), "key", F.col("c").alias("a"))
        grams = written(top, "kn")
        tables = [grams]
        for n in range(ORDER - 1, 0, -1):
            grams = written(grams.groupBy(_low(F.col("key"), n).alias("key")).agg(F.count("*").alias("a")).select(F.lit(n).alias("n"), "key", "a"), "kn")
            tables.append(grams)
        self.grams = {ORDER - i: t for i, t in enumerate(tables)}
        self.discounts, self.contexts = {}, {}
        for n, t in self.grams.items():
            of = [F.sum(F.when(F.col("a") == k, 1.0).otherwise(0.0)).alias(f"t{k}") for k in (1, 2, 3, 4)]
            y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
            # where a count class is empty its discount falls back to a fixed share, so that small tables stay proper
            d = [F.least(F.greatest(F.coalesce(F.lit(float(k)) - (k + 1) * y * F.col(f"t{k + 1}") / F.nullif(F.col(f"t{k}"), F.lit(0.0)), F.lit(0.5 * k)), F.lit(0.1)), F.lit(float(k) - 0.05)).alias(f"d{k}") for k in (1, 2, 3)]
            self.discounts[n] = written(t.groupBy(F.shiftright("key", SHIFT).alias("code")).agg(*of).select("code", *d), "kn-discounts")
            seen = [F.sum(F.when(F.col("a") == k if k < 3 else F.col("a") >= 3, 1.0).otherwise(0.0)).alias(f"s{k}") for k in (1, 2, 3)]
            ctx = t.groupBy(_context(F.col("key"), n).alias("ctx")).agg(F.sum("a").alias("total"), *seen)
            self.contexts[n] = written(ctx.join(self.discounts[n], F.shiftright("ctx", SHIFT) == F.col("code")).select("ctx", "total", (F.col("s1") * F.col("d1") + F.col("s2") * F.col("d2") + F.col("s3") * F.col("d3")).alias("gap"), "d1", "d2", "d3"), "kn-contexts")

    def probabilities(self, wanted: DataFrame, n: int = ORDER) -> DataFrame:
        """``wanted`` (key and other columns, keys distinct) with p: interpolated with the next lower order, down to 1/256."""
        carried = wanted.columns
        if n > 1:
            lower = self.probabilities(wanted.select(_low(F.col("key"), n - 1).alias("key")).distinct(), n - 1)
            q = wanted.withColumn("low", _low(F.col("key"), n - 1)).join(lower.select(F.col("key").alias("low"), F.col("p").alias("below")), "low")
        else:
            q = wanted.withColumn("below", F.lit(1 / 256))
        q = q.join(self.grams[n].select("key", "a"), "key", "left").withColumn("ctx", _context(F.col("key"), n)).join(self.contexts[n], "ctx", "left")
        cut = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).when(F.col("a") >= 3, F.col("d3")).otherwise(0.0)
        return q.select(*carried, F.when(F.col("total").isNull(), F.col("below")).otherwise((F.coalesce("a", F.lit(0)) - cut + F.col("gap") * F.col("below")) / F.col("total")).alias("p"))


def log_likelihood(docs: DataFrame, model: KneserNey, trained: list[int], keep: list[str]) -> DataFrame:
    """``keep`` columns, code (of the model used), n_bytes and bits (minus log2 probability of the text) of every row."""
    blocks = n_blocks(docs, block_bytes=12 << 20)
    shards = n_blocks(docs)
    grouped = Blocks(docs.withColumn("__code", _used(_code(F.col("lang")), trained)), blocks, ["doc_id", "text", "__code", *keep], level=6)

    def grams_of(t: pa.Table) -> np.ndarray:
        """The block's distinct n-grams, mixed: in the order of their shards."""
        found, size = [], 0
        for _, _, _, keys in _keys(t, t["__code"].to_numpy()):
            found.append(distinct(keys))
            size += len(found[-1])
            if size > 2_000_000:
                found = [distinct(np.concatenate(found))]
                size = len(found[0])
        return distinct(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def request(t: pa.Table) -> pa.Table:
        keys, own = by_shard(grams_of(t))
        return ask(keys, own, t["block"][0].as_py())

    def by_shard(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams behind mixed keys, in ascending order of each shard, and their shards: the differences of plain n-grams pack well."""
        own, raw = owner(keys, shards), unmix64(keys)
        at = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)]
        for i, j in zip(at[:-1], at[1:]):
            raw[i:j].sort()
        return raw, own

    def once(t: pa.Table) -> pa.Table:
        let_go()
        s = Shard(t)
        return pa.table({"shard": pa.array(np.full(len(s.keys), s.shard), pa.int32()), "key": pa.array(s.keys.astype(np.int64))})

    def lookup(want: pa.Table, have: pa.Table) -> pa.Table:
        let_go()
        s = Shard(want)
        keys = have["key"].to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        bits = -np.log2(have["p"].to_numpy())[order][np.searchsorted(keys, s.keys, sorter=order)] if len(s.keys) else np.zeros(0)
        return s.reply(bits.astype(np.float32))  # bits keep their precision where p is next to 1

    def add_up(t: pa.Table, reply: pa.Table) -> pa.Table:
        out, sizes = [], []
        mixed = grams_of(t)
        keys = Lookup(mixed)
        bits = np.empty(len(mixed))
        bits[keys.find(mix64(by_shard(mixed)[0]))] = answers(reply, [np.float32])[0]  # in the order of the mixed keys
        for _, _, size, k in _keys(t, t["__code"].to_numpy()):
            total = np.r_[0.0, np.cumsum(bits[keys.find(k)])] if len(k) else np.zeros(1)
            ends = np.cumsum(size)
            out.append(total[ends] - total[ends - size])
            sizes.append(size)
        flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pa.table({**{c: t[c] for c in keep}, "code": t["__code"], "n_bytes": pa.array(flat(sizes, np.int64)), "bits": pa.array(flat(out, np.float64))})

    wants = grouped.each(request, asked(0))
    wanted = wants.groupBy("shard").applyInArrow(once, "shard int, key long")
    found = model.probabilities(wanted)
    replies = wants.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(lookup, answered(1))
    schema = docs.select(*keep).schema.add("code", "long").add("n_bytes", "long").add("bits", "double")
    return grouped.meet(replies, add_up, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct doc_id of the trusted documents (quality 1, not toxic)."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def sample_sizes(counts: dict[int, int], most: int, least: int) -> dict[int, int]:
    """How many documents of each group to train on: all of the small groups, equal shares of the rest of ``most`` for the
    large ones, and no fewer than ``least`` of any group that has them."""
    sizes, left = {}, most
    for i, (group, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        sizes[group] = min(n, max(least, left // (len(counts) - i)))
        left = max(0, left - sizes[group])
    return sizes


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] = ["doc_id"], max_trusted: int = MAX_TRUSTED, min_docs: int = 50,
            middle: float = 0.5, high: float = 0.9, stretch: float = 3.5, prior_bytes: int = 50, hold_out: int = 5) -> DataFrame:
    """``keep`` columns, n_bytes, perplexity (per byte), threshold, accepted of every row.

    Trained on the trusted labelled documents (see :func:`trusted_ids`) less one in ``hold_out``; a language with at least
    ``min_docs`` of them has a model and a cut of its own, others (null too) use the pooled ones. Of more than about
    ``max_trusted`` a sample is trained on, drawn by a hash in each language (see :func:`sample_sizes`), whose ids are
    broadcast (8 bytes each); who has a model and the cuts depend on all trusted documents.
    A document's bits per byte are drawn to the language's ``middle`` quantile by ``prior_bytes`` bytes, so that a
    few odd words do not reject a short text. It is rejected beyond
    q(middle) + stretch * (q(high) - q(middle)), quantiles over all trusted documents outside the training sample.
    Null and empty texts have a null perplexity and are accepted, as nothing speaks against them; without trusted
    documents all are accepted. Repeated rows are judged each time; no rows give no rows.
    """
    ids = trusted_ids(labels)
    out_of = F.pmod(F.xxhash64("doc_id"), F.lit(hold_out)) == 0
    mine = written(docs.where("text is not null").select("doc_id", _code(F.col("lang")).cast("long").alias("code")).join(ids, "doc_id", "left_semi"), "trusted")
    per = mine.where(~out_of).groupBy("code").agg(F.count("*").alias("n")).groupBy(F.when(F.col("n") >= min_docs, F.col("code")).otherwise(POOL).alias("code")).agg(F.sum("n").alias("n"))
    counts = {r.code: r.n for r in per.collect()}
    trained = sorted(c for c in counts if c != POOL)
    share = {c: n / counts[c] for c, n in sample_sizes(counts, max_trusted, min_docs).items() if n < counts[c]}

    def picked(code: F.Column) -> F.Column:
        """Whether a trusted document is in the training sample; ``code`` is that of its model."""
        part = F.lit(1.0)
        for c, x in share.items():
            part = F.when(code == c, x).otherwise(part)
        return ~out_of & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < part * (1 << 30))

    chosen = written(mine.where(picked(_used(F.col("code"), trained))).select("doc_id").distinct(), "training")
    sample = docs.where("text is not null").where(picked(_used(_code(F.col("lang")), trained))).join(F.broadcast(chosen), "doc_id", "left_semi")
    model = KneserNey(count_grams(sample.select("text", "lang")))
    cols = [*dict.fromkeys(["doc_id", *keep])]
    rows = written(log_likelihood(docs, model, trained, cols), "bits")
    held = rows.where(~picked(F.col("code")) & (F.col("n_bytes") > 0)).select("doc_id", "code", (F.col("bits") / F.col("n_bytes")).alias("x")).join(ids, "doc_id", "left_semi")
    cuts = lambda g: g.agg(F.percentile_approx("x", [middle, high], 10000).alias("q"), F.count("*").alias("n"))
    both = cuts(held.groupBy("code")).where(F.col("n") >= min_docs // hold_out).select("code", "q")
    pooled = cuts(held.groupBy(F.lit(POOL).alias("__code"))).select(F.col("q").alias("pooled"))
    own = rows.join(F.broadcast(both), "code", "left").join(F.broadcast(pooled), F.lit(True), "left").withColumn("q", F.coalesce("q", "pooled"))
    drawn = (F.col("bits") + prior_bytes * F.col("q")[0]) / (F.col("n_bytes") + prior_bytes)
    cut = F.col("q")[0] + stretch * (F.col("q")[1] - F.col("q")[0])
    return own.select(*keep, "n_bytes", F.when(F.col("n_bytes") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes"))).alias("perplexity"),
                      F.pow(F.lit(2.0), cut).alias("threshold"), F.coalesce((F.col("n_bytes") == 0) | (drawn <= cut), F.lit(True)).alias("accepted"))
