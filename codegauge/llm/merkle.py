"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf. Leaves of one tree (a language, say) ascend by id; each run of ``arity`` neighbours becomes the hash of
their digests, until one node, the subroot, remains. The subroots, in the order of their trees, are the leaves of one more tree whose top
is the root.

A node's label is its level and its place, so labels ascend from children to parents. The first sweep visits nodes by ascending label:
a priority queue delivers the digests of the children to their parent when its turn comes. The second sweep is reversed: it starts with the top and
delivers to each child its siblings followed by what its parent got, so that a leaf ends with its whole proof.

The queue is external: ``levels`` levels over ``arity ** levels`` neighbours are a *block*, which one task sweeps with a heap, and what
goes from block to block is a table of messages, dealt by Spark to the label of the receiving block. A tree of n leaves takes
``log(n) / (levels * log(arity))`` rounds; no task holds more than a block, however large a tree is.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import placed, ship_code, written

ARITY, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
PROOF = "array<struct<at: int, siblings: string>>"


def leaf_digest(*values: Column) -> Column:
    """H of the values in order: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    parts = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    def up(h, p):
        cut = p["at"] * HEX
        return F.sha2(F.concat(F.substring(p["siblings"], F.lit(1), cut), h, F.substring(p["siblings"], cut + 1, F.length(p["siblings"]))).cast("binary"), 256)
    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof, from the leaf's run to the root's."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: p["siblings"]), "").cast("binary"), 256)


def height(n: int, arity: int = ARITY) -> int:
    """Levels of hashes over ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // arity), h + 1
    return h


def _hash(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def sweep_up(leaves: list[str], levels: int, arity: int = ARITY) -> dict[tuple[int, int], list[str]]:
    """The runs of digests that the nodes above ``leaves`` hash, by label, in the order of time; the top's run comes last."""
    queue, runs = [], {}
    if levels:
        queue = [((1, i // arity), i, d) for i, d in enumerate(leaves)]  # ascends, so it is a heap already
    while queue:
        label, run = queue[0][0], []
        while queue and queue[0][0] == label:
            run.append(heappop(queue)[2])
        runs[label] = run
        if label[0] < levels:
            heappush(queue, ((label[0] + 1, label[1] // arity), label[1], _hash(run)))
    return runs


def sweep_down(runs: dict[tuple[int, int], list[str]], levels: int, n: int, top: list[tuple[int, str]], arity: int = ARITY) -> list[list[tuple[int, str]]]:
    """The proof of each of ``n`` leaves: pairs of the place in a run and the run's other digests. ``top`` is what the top node got."""
    proofs: list = [None] * n
    queue = [(-levels, 0, top)]
    while queue:
        level, at, proof = heappop(queue)
        if not level:
            proofs[at] = proof
            continue
        run = runs[-level, at]
        for k in range(len(run)):
            heappush(queue, (level + 1, at * arity + k, [(k, "".join(run[:k] + run[k + 1:])), *proof]))
    return proofs


def _ordered(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.argsort(t["at"].to_numpy(), kind="stable")))


def _up_round(nodes: DataFrame, level: int, arity: int, levels: int) -> DataFrame:
    def run(t):
        t = _ordered(t)
        n = t["n"][0].as_py()
        more = max(0, min(levels, height(n, arity) - level))
        runs = sweep_up(t["digest"].to_pylist(), more, arity)
        top = _hash(runs[more, 0]) if more else t["digest"][0].as_py()
        return pa.table({"tree": t["tree"][:1], "at": pa.array([t["block"][0].as_py()], pa.int64()), "digest": pa.array([top], pa.string()), "n": t["n"][:1]})
    return _blocks(nodes, arity, levels).groupBy("tree", "block").applyInArrow(run, "tree string, at long, digest string, n long")


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at div {arity ** levels}"))


def _down_round(nodes: DataFrame, messages: DataFrame, level: int, keep: list[str], arity: int, levels: int) -> DataFrame:
    """What the nodes of a round get, from what their block's top got."""
    def run(t, message):
        t = _ordered(t)
        more = max(0, min(levels, height(t["n"][0].as_py(), arity) - level))
        leaves = t["digest"].to_pylist()
        above = [(x["at"], x["siblings"]) for x in message["proof"][0].as_py()]
        proofs = sweep_down(sweep_up(leaves, more, arity), more, len(leaves), above, arity)
        flat = [x for p in proofs for x in p]
        offsets = np.r_[0, np.cumsum([len(p) for p in proofs])].astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.string())], ["at", "siblings"])
        cols = {c: t[c] for c in ["tree", "at", *keep]}
        for c in ("subroot", "root"):
            cols[c] = pa.array([message[c][0].as_py()] * len(leaves), pa.string())
        return pa.table({**cols, "proof": pa.ListArray.from_arrays(pa.array(offsets), pairs)})

    schema = nodes.select("tree", "at", *keep).schema
    schema = schema.add("subroot", "string").add("root", "string").add("proof", DataType.fromDDL(PROOF))
    up = messages.select("tree", F.col("at").alias("block"), "subroot", "root", "proof")
    return _blocks(nodes, arity, levels).groupBy("tree", "block").cogroup(up.groupBy("tree", "block")).applyInArrow(run, schema)


def _grow(nodes: DataFrame, arity: int, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round, and the tops of all trees (tree, digest)."""
    tallest = nodes.agg(F.max("n")).first()[0] or 0  # one number: how many rounds there are
    rounds = [nodes]
    for k in range(-(-height(tallest, arity) // levels)):
        rounds.append(written(_up_round(rounds[-1], k * levels, arity, levels), f"{name}-{k}"))
    return rounds[:-1] or [nodes], rounds[-1].select("tree", "digest")


def manifest(leaves: DataFrame, order: str = "doc_id", tree: str = "lang", leaf: str = "leaf", keep: tuple = (), arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``order``, ``leaf``, ``keep``, subroot, root and proof of every row of ``leaves``.

    ``proof`` lists, from the leaf's run to the root's, the place in the run and the other digests of the run as one string; :func:`fold` gives
    the root back from it. Trees ascend by the bytes of their name, null first; leaves by ``order`` (null first), then by digest: rows equal in both are
    interchangeable. A lone leaf is its tree's subroot, a lone subroot the root, with an empty proof. No rows give no rows.
    """
    ship_code(leaves.sparkSession)
    name = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))  # sorts as the trees do
    cols = [*dict.fromkeys([order, leaf, *keep])]
    rows = leaves.select(name.alias("tree"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)], F.col(leaf).alias("digest"))
    held = [f"k{i}" for i in range(len(cols))]
    base = written(placed(rows, "tree", ["k0", "digest"], "merkle-leaves"), "merkle-placed")
    rounds, tops = _grow(base, arity, levels, "merkle-tree")
    subs = written(placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"], "merkle-tops"), "merkle-subroots")
    over, root = _grow(subs, arity, levels, "merkle-root")

    got = root.select("tree", F.lit(0).cast("long").alias("at"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.expr(f"cast(array() as {PROOF})").alias("proof"))
    for k in reversed(range(len(over))):
        got = _down_round(over[k], got, k * levels, [] if k else ["name", "digest"], arity, levels)
    got = written(got.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), F.col("digest").alias("subroot"), "root", "proof"), "merkle-trees")
    for k in reversed(range(len(rounds))):
        got = _down_round(rounds[k], got, k * levels, held if not k else [], arity, levels)
    return got.select(*[F.col(h).alias(c) for h, c in zip(held, cols)], "subroot", "root", "proof")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and ``now``: the leaf of the row as tampering leaves it. Where 3 divides the CRC-32 of doc_id, the A-Z of
    the text turn into a-z. Null ids and null texts stay."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    values = [F.col(c) for c in FIELDS]
    changed = [F.when(hit, F.translate(v, UPPER, LOWER)).otherwise(v) if c == "text" else v for c, v in zip(FIELDS, values)]
    return docs.select("doc_id", "lang", leaf_digest(*values).alias("leaf"), leaf_digest(*changed).alias("now"))


def audit(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of :func:`manifest` rows that keep ``now``."""
    d = rows.withColumn("folded_root", fold(F.col("now"), F.col("proof")))
    return d.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"


def _up_sql(name: str, leaves: str) -> str:
    """All nodes (tree, level, pos, digest) over ``leaves``, and the runs of a level as one string."""
    return f"""{name} AS (
    SELECT tree, 0 AS level, pos, digest FROM {leaves}
    UNION ALL
    SELECT tree, level + 1, pos // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}) t WHERE c > 1 GROUP BY tree, level, pos // {ARITY}
  ), {name}_runs AS (SELECT tree, level, pos // {ARITY} AS run, string_agg(digest, '' ORDER BY pos) AS s, count(*) AS c FROM {name} GROUP BY ALL
  ), {name}_top AS (SELECT tree, arg_max(digest, level) AS digest, max(level) AS height FROM {name} GROUP BY tree
  )"""


def _fold_sql(name: str, start: str, up: str) -> str:
    return f"""{name} AS (
    SELECT id, tree, 0 AS level, pos, digest, sibs FROM {start}
    UNION ALL
    SELECT f.id, f.tree, f.level + 1, f.pos // {ARITY},
      sha256(substr(s, 1, {HEX} * (f.pos % {ARITY})) || f.digest || substr(s, {HEX} * (f.pos % {ARITY}) + {HEX + 1})),
      f.sibs || substr(s, 1, {HEX} * (f.pos % {ARITY})) || substr(s, {HEX} * (f.pos % {ARITY}) + {HEX + 1})
    FROM {name} f JOIN {up}_top p ON p.tree = f.tree AND f.level < p.height
    JOIN {up}_runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.pos // {ARITY}
  )"""


#: CRC-32 of a decimal number, bit by bit over its digits.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))),
      lambda crc, bit: CASE WHEN xor(crc, bit) & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295)"""

ORACLE_SQL = f"""WITH RECURSIVE rows_ AS (
    SELECT *, CASE WHEN {_CRC_SQL} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS now_text FROM documents
  ), hashed AS (
    SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree,
      sha256({" || ".join(map(_field_sql, FIELDS))}) AS digest,
      sha256({" || ".join(_field_sql("now_text" if c == "text" else c) for c in FIELDS)}) AS now
    FROM rows_
  ), leaves AS (
    SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM hashed
  ), {_up_sql("up", "leaves")}, subs AS (
    SELECT '#' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up_top
  ), {_up_sql("over_", "subs")}, first AS (SELECT id, tree, pos, now AS digest, '' AS sibs FROM leaves
  ), {_fold_sql("low", "first", "up")}, second AS (
    SELECT l.id, s.tree, s.pos, arg_max(l.digest, l.level) AS digest, arg_max(l.sibs, l.level) AS sibs
    FROM low l JOIN subs s ON s.name = l.tree GROUP BY l.id, s.tree, s.pos
  ), {_fold_sql("high", "second", "over_")}, folded AS (
    SELECT id, arg_max(digest, level) AS folded_root, sha256(arg_max(sibs, level)) AS proof_sha256 FROM high GROUP BY id
  )
  SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root, f.proof_sha256, f.folded_root, f.folded_root = r.digest AS verified
  FROM leaves l JOIN folded f USING (id) JOIN subs s ON s.name = l.tree CROSS JOIN over__top r"""
