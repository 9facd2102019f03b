"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are formed."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, ship_code
from .pieces import UnitCache, Vocabulary, model_bytes, units


class Counter:
    """``count(text)``: initial symbols of the text minus the merges done.

    A unit's characters form a linked list (``after``/``before`` by position). The heap holds the pairs that may
    merge as (rank, position, length at push time); the lowest is popped, skipped if either side has changed
    since, else merged, and its two new neighbour pairs are pushed. Characters outside the vocabulary
    never merge and count as their UTF-8 bytes.
    """

    def __init__(self, model: bytes):
        v = Vocabulary(model)
        self.rank = {p: -s for p, s in v.score.items()}
        self.units = UnitCache(self.count_unit)

    def count_unit(self, unit: str) -> int:
        rank, n = self.rank, len(unit)
        symbols = sum(1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in unit)
        heap = [(rank[unit[i:i + 2]], i, i + 2) for i in range(n - 1) if unit[i:i + 2] in rank]
        if not heap:
            return symbols
        heapify(heap)
        after = list(range(1, n + 1))   # end of the symbol that starts here; 0 once it was merged into its left
        before = list(range(-1, n - 1))  # start of the symbol to the left
        merges = 0
        while heap:
            _, i, end = heappop(heap)
            mid = after[i]
            if not mid or mid >= end or after[mid] != end:
                continue
            after[i], after[mid] = end, 0
            merges += 1
            if end < n:
                before[end] = i
                key = rank.get(unit[i:after[end]])
                if key is not None:
                    heappush(heap, (key, i, after[end]))
            left = before[i]
            if left >= 0:
                key = rank.get(unit[left:end])
                if key is not None:
                    heappush(heap, (key, left, end))
        return symbols - merges

    def count(self, text: str | None) -> int:
        return sum(map(self.units.__getitem__, units(text))) if text else 0


def token_counts(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay rows of their own; no rows
    give no rows.
    """
    ship_code(docs.sparkSession)
    model = model_bytes(model_path)

    def run(batches):
        counter = per_worker(Counter, model)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [counter.count(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.int64()), pa.array([x > limit for x in got], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    cols = docs.select("doc_id", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("__text"))
    return cols.mapInArrow(run, cols.select("doc_id", "n_bytes").schema.add("n_tokens", "long").add("over_limit", "boolean"))
