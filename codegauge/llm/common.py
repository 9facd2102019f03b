"""Shared helpers: reading columns by name, byte buffers of Arrow texts, text blocks and block exchanges.

Every operator selects the columns that it names and ignores all others, so extra columns (with
whatever names) change nothing. A null text is an empty text unless an operator says otherwise.

*Blocks.* Operators that look at every position of every text group the documents into blocks of a
few MB by a hash of ``doc_id``. A block first reduces its own positions to distinct keys, sends
each key once to the shard that owns it, and gets the shard's answer back. A key that a third of
all documents share therefore reaches its shard once per block and not once per document, and no
task holds more than one block or one shard. Blocks and shards are counted from the bytes of the
input, so they grow in number and not in size.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codegauge.session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 8 << 20

MULT = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def n_blocks(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks hold the texts of ``docs`` at about ``block_bytes`` each (one number reaches the driver)."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long") + 64)).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


_SENT: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this subpackage to the Python workers of the application, once, as one small archive in the shared folder;
    executors then need no installed copy, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root, archive = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for f in [root / "__init__.py", root / "session.py", *sorted((root / "llm").glob("*.py"))]:
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = sc._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark, "code") + "/codegauge_tasks.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(archive.getvalue()))
    out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    _SENT.add(sc.applicationId)


def spare_memory() -> None:
    """Give unused memory back to the system, Arrow's and the C heap's, as a worker lives on after a block."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


_WORKER: dict = {}


def per_worker(kind, model: bytes):
    """One ``kind(model)`` for each Python worker, kept from task to task until :func:`let_go`."""
    key = (kind.__name__, hashlib.md5(model).digest())
    if key not in _WORKER:
        let_go()
        _WORKER[key] = kind(model)
    return _WORKER[key]


def let_go() -> None:
    """As a task begins: drop what other operators kept in this worker (100 MB and more) and give back what they freed, as all
    operators of an application share the workers."""
    if _WORKER:
        _WORKER.clear()
        gc.collect()
    spare_memory()


class Blocks:
    """Documents shuffled into blocks once, as compressed Arrow pieces, for several steps over the same blocks.

    Each scan task sorts its rows by block and packs the rows of a block into one binary (at most ``PACK_BYTES`` of texts at a
    time are held), which takes well under the shuffle space of single rows. Equal ``doc_id`` share a block; null
    ids spread by their text; ``level`` sets how hard the packing works. A step gets its block as a table of ``cols`` and ``block``, in no fixed order of rows.
    """

    PACK_BYTES = 16 << 20

    def __init__(self, docs: DataFrame, blocks: int, cols: list[str], text: str = "text", level: int | None = None):
        ship_code(docs.sparkSession)
        cols = [*dict.fromkeys(cols)]
        most, begin, spare = self.PACK_BYTES, let_go, spare_memory
        key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col("doc_id")))

        def pack(batches):
            held: dict[int, list] = {}
            size = 0
            begin()

            def out():
                for block, parts in sorted(held.items()):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level) if level else "zstd")) as w:
                        w.write_table(pa.Table.from_batches(parts).combine_chunks())
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "packed"])
                held.clear()

            for b in batches:
                of = b.column(0).to_numpy()
                order = np.argsort(of, kind="stable")
                for lo in range(0, len(order), 1000):  # few rows at a time, so that long texts are not all copied at once
                    part = order[lo:lo + 1000]
                    t = b.select(cols).take(pa.array(part))
                    at = np.flatnonzero(np.r_[True, of[part][1:] != of[part][:-1]])
                    for i, j in zip(at, np.r_[at[1:], len(part)]):
                        held.setdefault(int(of[part[i]]), []).append(t.slice(i, j - i))
                    size += t.nbytes
                    if size > most:
                        yield from out()
                        size = 0
            yield from out()
            spare()

        rows = docs.select(F.pmod(key, F.lit(blocks)).cast("int").alias("block"), *[F.col(c) for c in cols])
        self.grouped = rows.mapInArrow(pack, "block int, packed binary")

    @staticmethod
    def _open(t: pa.Table) -> pa.Table:
        docs = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in t["packed"]]).combine_chunks()
        return docs.append_column("block", pa.array(np.full(docs.num_rows, t["block"][0].as_py()), pa.int32()))

    def each(self, f, schema) -> DataFrame:
        """``f(documents of a block)`` for every block."""
        open_, begin, spare = self._open, let_go, spare_memory

        def run(t):
            begin()
            out = f(open_(t))
            spare()
            return out
        return self.grouped.groupBy("block").applyInArrow(run, schema)

    def meet(self, replies: DataFrame, f, schema) -> DataFrame:
        """``f(documents of a block, its replies)`` for every block. Replies only go to blocks that asked."""
        open_, begin, spare = self._open, let_go, spare_memory

        def run(t, reply):
            begin()
            out = f(open_(t), reply)
            spare()
            return out
        return self.grouped.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole documents with at most ``most`` bytes each (one longer document stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BACK = [np.uint64(pow(c, -1, 1 << 64)) for c in (0xA0761D6478BD642F, 0xD6E8FEB86659FD93)]


def unmix64(x: np.ndarray) -> np.ndarray:
    """The values that :func:`mix64` took to ``x``."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _BACK[0]
        x = (x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))) * _BACK[1]
        return x ^ (x >> np.uint64(32))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a plain sort: several times faster than ``np.unique`` on hashes)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Lookup:
    """Places in an ascending array of evenly spread keys: a table over their leading bits, then a step or two. Several
    times faster than binary search, which misses the cache at each halving."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, int(len(keys)).bit_length() + 2)
        self.shift = np.uint64(max(0, (int(keys[-1]).bit_length() if len(keys) else 1) - bits))
        lead = (keys >> self.shift).astype(np.int64)
        at = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]]) if len(keys) else lead
        kind = np.int32 if len(keys) < 1 << 31 else np.int64  # there are several times as many leading bits as keys
        self.start = np.zeros(int(lead[-1]) + 2 if len(keys) else 1, kind)
        self.start[lead[at] + 1] = np.diff(np.r_[at, len(keys)])
        np.cumsum(self.start, dtype=kind, out=self.start)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of ``wanted``, all of which must be among the keys."""
        at = self.start[(wanted >> self.shift).astype(np.int64)].astype(np.int64)
        miss = np.flatnonzero(self.keys[at] != wanted)
        while len(miss):
            at[miss] += 1
            miss = miss[self.keys[at[miss]] != wanted[miss]]
        return at


def by_splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed random uint64 values from a seed."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * MULT)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = by_splitmix(256, 11)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the n + 1 word offsets of the texts."""
    return word_spans(data, offsets, lower)[:2]


def word_spans(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, word offsets of the texts, first byte, end byte) of the words.

    A word is a maximal run of bytes outside space and U+0009-U+000D inside one text; with ``lower``
    A-Z count as a-z. The hash is a polynomial in a random value for each byte, by prefix sums.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    first[cut] = word[cut]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        lens = (ends - starts).astype(np.uint64)
        power = np.full(n, MULT, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        val = _BYTE[LOWER[data] if lower else data]
        val *= power
        pre = np.zeros(n + 1, np.uint64)
        np.cumsum(val, out=pre[1:])
        h = pre[ends] - pre[starts]
        h *= _power(inverse(), starts, n)
        h = mix64(h ^ (lens * np.uint64(0xC2B2AE3D27D4EB4F)))
    return h, np.searchsorted(starts, offsets).astype(np.int64), starts, ends


_INV = pow(int(MULT), -1, 1 << 64)
_TABLE: dict[int, np.ndarray] = {}


def inverse() -> int:
    return _INV


def _power(base: int, at: np.ndarray, n: int) -> np.ndarray:
    """``base ** at`` mod 2**64 for positions below ``n``, by two small tables (low and high halves)."""
    lo_bits = 12
    with np.errstate(over="ignore"):
        if base not in _TABLE:
            t = np.full(1 << lo_bits, base & (2**64 - 1), np.uint64)
            t[0] = 1
            np.multiply.accumulate(t, out=t)
            _TABLE[base] = t
        low = _TABLE[base]
        high = np.full((n >> lo_bits) + 1, pow(base, 1 << lo_bits, 1 << 64), np.uint64)
        high[0] = 1
        np.multiply.accumulate(high, out=high)
        return low[at & ((1 << lo_bits) - 1)] * high[at >> lo_bits]


def owner(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key from its high 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


LOW = np.uint64(0xFFFFFFFF)


def short(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard in the high half, 32 bits of the key in the low: distinct keys of one shard rarely meet, and only the low half
    has to travel."""
    return owner(keys, shards).astype(np.uint64) << np.uint64(32) | (keys & LOW)


def squeeze(v: np.ndarray, ascending: bool = False) -> bytes:
    """An integer array for the shuffle: differences of ascending keys, byte plane by byte plane, by zstd."""
    if ascending and len(v):
        step = v.copy()
        np.subtract(v[1:], v[:-1], out=step[1:])
        v = step
    planes = np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()
    return len(v).to_bytes(4, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(v) else b"")


def unsqueeze(raw, kind, ascending: bool = False) -> np.ndarray:
    """What :func:`squeeze` took."""
    raw, kind = memoryview(raw), np.dtype(kind)
    n = int.from_bytes(raw[:4], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[4:], n * kind.itemsize, codec="zstd"), np.uint8)
    v = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n)
    return np.cumsum(v, dtype=kind) if ascending else v


def packed(values: list[np.ndarray], ascending: bool = False) -> pa.Array:
    return pa.array([squeeze(v, ascending) for v in values], pa.binary())


def unpacked(col, kind, ascending: bool = False) -> list[np.ndarray]:
    return [unsqueeze(x.as_buffer(), kind, ascending) for x in col]


def summed(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their values."""
    order = np.argsort(keys)
    keys, vals = keys[order], vals[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(vals, at) if len(at) else vals


class Sums:
    """Sums by key over a stream of arrays, in memory bounded by ``most`` entries; ``flush`` gives them out."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, vals: np.ndarray):
        self.parts.append((keys, vals))
        self.size += len(keys)
        if self.size > self.most:
            self.merge()

    def merge(self):
        if len(self.parts) > 1:
            self.parts = [summed(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))]
        self.size = len(self.parts[0][0]) if self.parts else 0

    @property
    def full(self) -> bool:
        return self.size > self.most * 2 // 3

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = summed(*self.parts[0]) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


def ask(keys: np.ndarray, own: np.ndarray, block: int, *vals: np.ndarray, kind: int = 0) -> pa.Table:
    """One row (kind, shard, block, keys, v0, ...) for each shard in ``own``; keys lie in ascending order of their shard."""
    at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    to = np.r_[at[1:], len(own)]
    full = lambda x: pa.array(np.full(len(at), x), pa.int32())
    cols = {"kind": full(kind), "shard": pa.array(own[at], pa.int32()), "block": full(block)}
    for name, v in zip(["keys"] + [f"v{k}" for k in range(len(vals))], (keys, *vals)):
        cols[name] = packed([v[i:j] for i, j in zip(at, to)], name == "keys")
    return pa.table(cols)


def asked(vals: int) -> str:
    return "kind int, shard int, block int, keys binary" + "".join(f", v{k} binary" for k in range(vals))


class Shard:
    """The requests of one shard: all keys, the distinct ones, and the way back to each request."""

    def __init__(self, table: pa.Table, types: list = (), key=np.uint64):
        self.blocks = table["block"].to_pylist()
        self.kind, self.shard = (table[c][0].as_py() if table.num_rows else 0 for c in ("kind", "shard"))
        parts = unpacked(table["keys"], key, True)
        self.sizes = [len(x) for x in parts]
        self.keys, self.inverse = np.unique(np.concatenate(parts) if parts else np.zeros(0, key), return_inverse=True)
        self.vals = [np.concatenate(unpacked(table[f"v{k}"], t)) for k, t in enumerate(types)]

    def per_key(self, ufunc, vals: np.ndarray, start) -> np.ndarray:
        out = np.full(len(self.keys), start, vals.dtype)
        ufunc.at(out, self.inverse, vals)
        return out

    def reply(self, *answers: np.ndarray) -> pa.Table:
        """One row (kind, shard, block, a0, a1, ...) per request, the answers in the order of its keys."""
        cuts = np.cumsum(self.sizes)[:-1]
        full = lambda x: pa.array(np.full(len(self.blocks), x), pa.int32())
        cols = {"kind": full(self.kind), "shard": full(self.shard), "block": pa.array(self.blocks, pa.int32())}
        for k, a in enumerate(answers):
            cols[f"a{k}"] = packed(np.split(a[self.inverse], cuts) if self.sizes else [])
        return pa.table(cols)


def least_of_digests(t: pa.Table, check) -> list[np.ndarray]:
    """For each request of a shard: the smallest ``v1`` (long) of all requests with the same digest (``keys`` and ``v0`` together)."""
    parts = unpacked(t["keys"], np.uint64, True)
    key, low, doc = np.concatenate(parts), np.concatenate(unpacked(t["v0"], check)), np.concatenate(unpacked(t["v1"], np.int64))
    order = np.lexsort((doc, low, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (low[order][1:] != low[order][:-1])]
    out = np.empty(len(order), np.int64)
    out[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return np.split(out, np.cumsum([len(x) for x in parts])[:-1])


def answered(vals: int) -> str:
    return "kind int, shard int, block int" + "".join(f", a{k} binary" for k in range(vals))


def answers(table: pa.Table, types: list, kind: int = 0) -> list[np.ndarray]:
    """A block's answers to its requests of one kind, in the order of its keys (shards ascend with them)."""
    shard, kinds = table["shard"].to_numpy(), table["kind"].to_numpy()
    order = np.flatnonzero(kinds == kind)
    order = order[np.argsort(shard[order], kind="stable")]
    out = []
    for k, t in enumerate(types):
        col = table[f"a{k}"]
        out.append(np.concatenate([unsqueeze(col[int(i)].as_buffer(), t) for i in order]) if len(order) else np.zeros(0, t))
    return out


class Stages:
    """Tables that a job of many steps writes for its next steps, deleted once the steps that read them are done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = path = scratch_dir(self.spark, f"llm-{name}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write once to the shared folder and read back."""
    path = scratch_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, group: str, keys: list[str], name: str) -> DataFrame:
    """``rows`` with their place ``at`` (from 0) in their group, ordered by ``keys``, and the group's size ``n``. The group is not null.

    Ranges of (group, keys) are cut by Spark's sampling, rows equal in all of these by their number in the input, so one group or one
    key may hold any share of the rows. Written once, as the ranges must not change between two reads."""
    cut = rows.withColumn("__row", F.monotonically_increasing_id())
    cut = written(cut.repartitionByRange(group, *keys, "__row").withColumn("__part", F.spark_partition_id()), name)
    order = W.partitionBy(group, "__part").orderBy(*keys, "__row")
    sizes = cut.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))  # one row per range and group
    whole = W.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(group, "__part", F.coalesce(before, F.lit(0)).alias("__off"), F.sum("__n").over(whole).alias("n"))
    out = cut.withColumn("__rn", F.row_number().over(order)).join(sizes, [group, "__part"])
    return out.withColumn("at", (F.col("__off") + F.col("__rn") - 1).cast("long")).withColumn("n", F.col("n").cast("long")).drop("__row", "__part", "__off", "__rn")
