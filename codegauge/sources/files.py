"""Source trees as tables (S1-S3, P10, P11): scan, decode, split into lines.

Folders are listed by tasks, and files are read by tasks in portions of some MB (:mod:`codegauge.sources.trees`). The suffix and
ignored-directory rules work on the listing, so the bytes of other files are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.functions.text import normalise_newlines
from codegauge.operators.graph import suffix
from codegauge.session import materialize
from codegauge.sources.trees import list_tree, read_files


def source_listing(spark: SparkSession, root: str, scoring: bool = False) -> DataFrame:
    """(path, uri, size_bytes, mtime) of the source files below ``root``; no file is opened."""
    if scoring:
        files = list_tree(spark, root)
        return files.filter(F.lower(suffix(F.col("path"))).isin(*R.SCORING_EXTENSIONS))
    files = list_tree(spark, root, tuple(R.IGNORED_DIRS))
    ignored = F.element_at(F.split("path", "/"), -1).isin(*R.IGNORED_DIRS)  # a file may have such a name as well
    return files.filter(suffix(F.col("path")).isin(*R.GRAPH_LANGUAGES) & ~ignored)


def scan_source_files(spark: SparkSession, root: str, project_id=None, scoring: bool = False,
                      max_files: int | None = None) -> DataFrame:
    """S1 (graph scan) / S2 (scoring scan): (project_id, path, raw, size_bytes, mtime).

    The graph scan keeps the 12 graph extensions (case-sensitive) and drops paths with an
    ignored directory part (tested on the path relative to ``root``). The scoring scan uses the
    lower-cased suffix and ignores no directory. ``max_files`` is the documented cap of the analysis, off by default: the first files by
    path (pinned order) that decode as UTF-8 (:func:`first_decodable`).
    """
    root = root.rstrip("/")
    listing = source_listing(spark, root, scoring)
    df = read_files(listing) if max_files is None else first_decodable(listing, max_files)
    pid = F.lit(project_id) if project_id is not None else F.md5(F.lit(root))
    return df.select(pid.alias("project_id"), "path", "raw", "size_bytes", "mtime")


def first_decodable(listing: DataFrame, max_files: int) -> DataFrame:
    """K3: the first ``max_files`` files by path that decode; files that do not decode use up nothing.

    Ranked files are read a few at a time, as many as are still missing, until enough have decoded or none is left; no other file is opened.
    What was read is kept as a table."""
    out, found, after = None, 0, None
    while found < max_files:
        more = listing if after is None else listing.filter(F.col("path") > after)
        ranked = materialize(more.orderBy("path").limit(max_files - found), "ranked")
        last = ranked.agg(F.max("path")).first()[0]
        if last is None:
            break
        good = materialize(read_files(ranked).filter(F.is_valid_utf8(F.col("raw").cast("string"))), "decoded")
        out = good if out is None else out.unionByName(good)
        found, after = found + good.count(), last
    return read_files(listing.filter(F.lit(False))) if out is None else out


def decode_source(files: DataFrame) -> DataFrame:
    """S3 + P10 + P11: strict UTF-8 text with universal newlines; undecodable files are dropped.

    ``raw_hash`` is the md5 of the bytes, ``content_hash`` the md5 of the decoded, newline-
    normalised text (they differ for CRLF files; compare only like with like).
    """
    text = F.col("raw").cast("string")
    d = files.withColumn("raw_hash", F.md5("raw")).filter(F.is_valid_utf8(text))
    d = d.withColumn("content", normalise_newlines(text)).drop("raw")
    return d.withColumn("content_hash", F.md5("content"))


def file_lines(files: DataFrame, keys: list[str], lang: str = "lang") -> DataFrame:
    """Split file text into (keys, lang, pos, line) rows (``str.split('\\n')`` keeps empty tails)."""
    return files.select(*keys, lang, F.posexplode(F.split(F.col("content"), "\n", -1)).alias("pos", "line"))
