"""Source trees (S1-S3, P11, K3): the file view laid out as files, then scanned, decoded and hashed."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.plans import q_graph  # noqa: F401  (code_files view)
from codegauge.plans.oracle_fixtures import register, with_views
from codegauge.plans.registry import query
from codegauge.plans.sqlgen import q
from codegauge.session import stored_folder
from codegauge.sources import files as SF
from codegauge.sources import fixtures as FX
from codegauge.sources.trees import write_tree

# Where a file of the view lies in its tree, and its bytes: some below ignored folders, some with an upper-case suffix, some with CRLF or CR line ends, some not UTF-8.
_PLACE = ("CASE WHEN id % 6 = 1 THEN 'node_modules/' WHEN id % 8 = 4 THEN '_private/' WHEN id % 17 = 2 THEN 'a/build/' ELSE '' END || path "
          "|| CASE WHEN id % 9 = 4 THEN '.PY' WHEN id % 9 = 5 THEN '.md' ELSE '' END")
_BREAK = "CASE WHEN id % 5 = 1 THEN chr(13) || chr(10) WHEN id % 5 = 2 THEN chr(13) ELSE chr(10) END"
BAD = "id % 7 = 3"

register("tree_files", f"""SELECT *, CASE WHEN bad THEN '' ELSE replace(text, chr(13), '') END AS x FROM (
    SELECT CAST(project_id AS STRING) || '/' || {_PLACE} AS path, replace(content, chr(10), {_BREAK}) AS text, content, {BAD} AS bad
    FROM (SELECT project_id, path, content, CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) AS id FROM code_files) f) t""", ["code_files"])
_SFX = "regexp_extract(path, '[^/]([.][^./]*)$', 1)"
_GRAPH = (f"{_SFX} IN ({', '.join(map(q, R.GRAPH_LANGUAGES))}) AND NOT list_has_any(string_split(path, '/'), [{', '.join(map(q, R.IGNORED_DIRS))}])")
_SCORING = f"lower({_SFX}) IN ({', '.join(map(q, sorted(R.SCORING_EXTENSIONS)))})"
# a bad file's bytes: 0xFF, then the text
_SIZE = "CAST(strlen(text) + CASE WHEN bad THEN 1 ELSE 0 END AS BIGINT)"


def tree(spark, sf) -> str:
    """The stand-in tree below the shared folder (written once per state of the input)."""
    def build(root):
        f = FX.code_files(spark, sf).select("project_id", "path", "content", F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("id"))
        text = F.encode(F.replace(F.col("content"), F.lit("\n"), F.expr(_BREAK)), "UTF-8")
        raw = F.when(F.expr(BAD), F.concat(F.unhex(F.lit("FF")), text)).otherwise(text)
        write_tree(f.select(F.concat(F.col("project_id").cast("string"), F.lit("/"), F.expr(_PLACE)).alias("path"), raw.alias("content")), root)
    return stored_folder(spark, [f"{sf.rstrip('/')}/lineitem.parquet"], "source tree", build)


@query("scan_source_files", with_views(f"SELECT path, {_SIZE} AS size_bytes FROM tree_files WHERE {_GRAPH}", ["tree_files"]))
def scan_source_files(spark, sf):
    """The files of the graph scan, from a listing (their bytes are not read)."""
    return SF.source_listing(spark, tree(spark, sf)).select("path", "size_bytes")


@query("scan_scoring_files", with_views(f"SELECT path, {_SIZE} AS size_bytes FROM tree_files WHERE {_SCORING}", ["tree_files"]))
def scan_scoring_files(spark, sf):
    """The files of the scoring scan: lower-cased suffix, no ignored folders."""
    return SF.source_listing(spark, tree(spark, sf), scoring=True).select("path", "size_bytes")


@query("decode_source", with_views(f"""SELECT path, strlen(content) AS size_decoded, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS line_breaks,
      md5(text) AS raw_hash, md5(content) AS content_hash FROM tree_files WHERE {_GRAPH} AND NOT bad""", ["tree_files"]))
def decode_source(spark, sf):
    """Files of the graph scan decoded (universal newlines; what is not UTF-8 is dropped), with the hash of the bytes and of the text."""
    d = SF.decode_source(SF.scan_source_files(spark, tree(spark, sf)))
    breaks = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit("")))
    return d.select("path", F.octet_length("content").cast("long").alias("size_decoded"), breaks.cast("long").alias("line_breaks"), "raw_hash", "content_hash")


CAP = 50


@query("scan_first_files", with_views(f"""SELECT path, md5(text) AS raw_hash FROM (SELECT *, row_number() OVER (ORDER BY path) AS r FROM tree_files WHERE {_SCORING} AND NOT bad) t
    WHERE r <= {CAP}""", ["tree_files"]))
def scan_first_files(spark, sf):
    """S2 + K3: the cap of the scoring scan: the first 50 files by path that decode; the others' bytes are not read."""
    return SF.scan_source_files(spark, tree(spark, sf), scoring=True, max_files=CAP).select("path", F.md5("raw").alias("raw_hash"))
