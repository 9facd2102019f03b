"""Views of FIXTURES.md over the driver tables, built with the DataFrame API.

They turn the TPC-H-like tables into source lines, files, linter findings and reports,
snapshots, commits, change events and diff statistics, so that every operator runs over data
that grows with the input. The DuckDB twin of each view is in :mod:`codegauge.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegauge.operators.ordered import ordinal
from codegauge.session import materialize, setting, stored_table
from codegauge.plans import shared_sql as S
from codegauge.sources.tables import table

# Rows of a file above this number are numbered in buckets of order keys; a shorter file is one window partition.
LONG_FILE = 1 << 16


def _stored(spark: SparkSession, sf_dir: str, view: str, build) -> DataFrame:
    """A view over lineitem that many queries read, written once per state of the table."""
    return stored_table(spark, [f"{sf_dir.rstrip('/')}/lineitem.parquet"], view, build)


def _keyed_rows(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The columns that decide a generated line and its place: (file_id, n, l_linenumber, other). ``other`` is the part or supplier key that is
    not the file's. Rows equal in all of them give equal lines, so no further column orders them. Rows without a file belong to none."""
    other = "l_suppkey" if key == "l_partkey" else "l_partkey"
    li = table(spark, sf_dir, "lineitem").filter(F.col(key).isNotNull())
    return li.select(F.col(key).alias("file_id"), F.col("l_orderkey").alias("n"), "l_linenumber", F.col(other).alias("other"))


_ROW_ORDER = ["n", "l_linenumber", "other"]


def _lang_and_kind(key: str) -> list:
    """lang and k of :func:`_keyed_rows`, which carry the key's own column as ``file_id``."""
    names = {"l_orderkey": "n", key: "file_id", "l_suppkey" if key == "l_partkey" else "l_partkey": "other"}
    kind = S.KIND_OF_ROW.format(key=key)
    for old, new in names.items():
        kind = kind.replace(old, new)
    return [F.expr(S.LANG_OF_KEY.format(key="file_id")).alias("lang"), F.expr(kind).alias("k")]


def code_rows(spark: SparkSession, sf_dir: str, key: str, long_file: int = LONG_FILE) -> DataFrame:
    """(file_id, lang, pos, n, k) for one generated line per lineitem row, grouped by ``key``.

    pos is row_number - 1 per file. A file is one window partition; only those longer than ``long_file`` rows are numbered in
    buckets of 2^14 order keys (:func:`ordinal`).
    """
    d = _keyed_rows(spark, sf_dir, key)
    long = materialize(d.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > long_file).select("file_id"), "long_files")
    whole = long.isEmpty()
    w = Window.partitionBy("file_id").orderBy(*_ROW_ORDER)
    rows = (d if whole else d.join(long, "file_id", "left_anti")).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    if not whole:
        rows = rows.unionByName(ordinal(d.join(long, "file_id", "left_semi"), ["file_id"], _ROW_ORDER, F.shiftright(F.col("n"), 14), out="pos"))
    lang, kind = _lang_and_kind(key)
    return rows.select("file_id", lang, "pos", "n", kind)


def code_lines(spark: SparkSession, sf_dir: str, key: str = "l_partkey") -> DataFrame:
    """(file_id, lang, pos, line); ``key='l_suppkey'`` gives the long-file view.

    Every metric branch reads these rows, so they are written once per input directory (a
    table in the shared folder) instead of re-planning the ordered numbering in each branch.
    """
    def build():
        return code_rows(spark, sf_dir, key).select("file_id", "lang", "pos", F.expr(S.RENDER_LINE).alias("line"))
    return _stored(spark, sf_dir, f"code_lines {key}", build)


def code_lines_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_lines(spark, sf_dir, "l_suppkey")


def _path_columns(prefix: str) -> list:
    return [(F.col("file_id") % 5).alias("project_id"), F.concat(F.lit(prefix), F.col("file_id").cast("string"), F.expr(S.EXT_OF_LANG)).alias("path")]


_FILE_KEYS = (("l_partkey", "src/p"), ("l_suppkey", "lib/s"))  # the short and the long files


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path) of the files of F2, for queries that read no text: the distinct keys, without building the texts."""
    def build():
        out = None
        for key, prefix in _FILE_KEYS:
            d = _keyed_rows(spark, sf_dir, key).select("file_id").distinct().withColumn("lang", F.expr(S.LANG_OF_KEY.format(key="file_id")))
            part = d.select(*_path_columns(prefix))
            out = part if out is None else out.unionByName(part)
        return out
    return _stored(spark, sf_dir, "file_paths", build)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per file with its text (lines joined by newline in pos order).

    A file is one row, as a ``binaryFile`` scan gives it; the size of one row is the size of one
    source file. Written once per input directory. The rows are dealt by file before they are rendered, so that only their keys are shuffled, sorted by
    file and place, and collected file by file: a sort aggregate holds one file at a time, where the hash aggregate of lists spills.
    """
    def build():
        line = F.when(F.col("lang") == "python", F.expr(S.RENDER_PY_FILE_LINE)).otherwise(F.expr(S.RENDER_LINE))
        out = None
        for key, prefix in _FILE_KEYS:
            lang, kind = _lang_and_kind(key)
            d = _keyed_rows(spark, sf_dir, key).repartition("file_id").sortWithinPartitions("file_id", *_ROW_ORDER)
            d = d.select("file_id", *_ROW_ORDER, lang, kind).withColumn("line", line)
            lines = F.sort_array(F.collect_list(F.struct(*_ROW_ORDER, "line")))
            files = d.groupBy("file_id").agg(F.first("lang").alias("lang"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("content"))
            part = files.select(*_path_columns(prefix), "lang", "content")
            out = part if out is None else out.unionByName(part)
        return out.withColumn("size_bytes", F.octet_length("content").cast("long"))
    with setting(spark, spark__sql__execution__useObjectHashAggregateExec="false"):
        return _stored(spark, sf_dir, "code_files", build)


def metrics_grid(spark: SparkSession, sf_dir: str, key_filter=None) -> DataFrame:
    """synthetic per-file metrics covering every threshold branch of the score.

    ``key_filter`` (on o_orderkey / o_custkey) is applied before the derivation so it reaches the scan.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if key_filter is not None:
        o = o.filter(key_filter)
    lang = F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' "
                  "WHEN 3 THEN 'java' WHEN 4 THEN 'go' ELSE 'rust' END")
    return o.select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"),
        lang.alias("language"),
        (F.col("o_orderkey") % 400).alias("lines_of_code"),
        (F.col("o_orderkey") % 53).alias("cyclomatic"),
        (F.col("o_custkey") % 101).alias("cognitive"),
        (F.col("o_orderkey") % 9).alias("max_nesting"),
        (F.col("o_custkey") % 4).alias("n_long"),
        (F.col("o_orderkey") % 6).alias("n_dup"),
        (F.col("o_custkey") % 8).alias("function_count"),
    )


def _events_k(spark: SparkSession, sf_dir: str, key_filter=None) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", "ts")
    if key_filter is not None:
        ev = ev.filter(key_filter)
    return ev.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))


def findings(spark: SparkSession, sf_dir: str, key_filter=None) -> DataFrame:
    """linter findings, one per event (tool, severity, rule, category by the event's number)."""
    from codegauge.functions import rules as R
    from codegauge.operators.findings import eslint_category, eslint_suggestion, bandit_severity, \
        bandit_suggestion, pyflakes_severity, pyflakes_category, pyflakes_suggestion
    ev = _events_k(spark, sf_dir, key_filter)
    d = ev.select(
        "event_id", "event_type", "k",
        F.concat(F.lit("f"), (F.col("user_id") * 10 + F.col("event_id") % 10).cast("string")).alias("path"),
        F.expr(S.FINDING_TOOL).alias("tool_name"),
        F.expr(S.ESLINT_RULE).alias("e_rule"), F.expr(S.BANDIT_RULE).alias("b_rule"),
        F.expr(S.BANDIT_SEVERITY).alias("b_sev"), F.expr(S.BANDIT_CONFIDENCE).alias("b_conf"),
        F.expr(S.PYFLAKES_MESSAGE).alias("p_msg"), F.expr(S.ESLINT_MESSAGE).alias("e_msg"))
    d = d.withColumn("b_msg", F.expr(S.BANDIT_MESSAGE))
    tool = F.col("tool_name")
    es, bd = tool == "ESLint", tool == "Bandit"
    return d.select(
        "path", "tool_name",
        (1 + F.col("event_id") % 300).alias("line"),
        F.when(es, 1 + F.col("k") % 40).when(bd, F.col("k") % 40).otherwise(1).alias("col"),
        F.when(es, F.when(F.col("event_type") == "error", "error").otherwise("warning"))
         .when(bd, bandit_severity(F.col("b_sev"), F.col("b_conf")))
         .otherwise(pyflakes_severity(F.col("p_msg"))).alias("severity"),
        F.when(es, F.col("e_rule")).when(bd, F.col("b_rule")).otherwise(F.lit("pyflakes")).alias("rule_id"),
        F.when(es, F.col("e_msg")).when(bd, F.col("b_msg")).otherwise(F.col("p_msg")).alias("message"),
        F.when(es, eslint_category(F.col("e_rule"))).when(bd, F.lit("security"))
         .otherwise(pyflakes_category(F.col("p_msg"))).alias("category"),
        F.when(es, eslint_suggestion(F.col("e_rule"))).when(bd, bandit_suggestion(F.col("b_rule")))
         .otherwise(pyflakes_suggestion(F.col("p_msg"))).alias("suggestion"),
        (es & (F.col("k") % 2 == 0)).alias("auto_fixable"),
        F.col("event_id").alias("ordinal"),
    )


def tool_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw linter output, one report per (path, tool, chunk of 8 event ids).

    ESLint and Bandit reports are JSON text, PyFlakes reports are ``file:line: message`` lines.
    ESLint chunks that are multiples of 37 are malformed JSON.
    """
    ev = _events_k(spark, sf_dir)
    d = ev.select(
        "event_id", "event_type", "k",
        F.concat(F.lit("f"), (F.col("user_id") * 10 + F.col("event_id") % 10).cast("string")).alias("path"),
        F.expr(S.FINDING_TOOL).alias("tool"),
        F.expr(S.ESLINT_RULE).alias("e_rule"), F.expr(S.BANDIT_RULE).alias("b_rule"),
        F.expr(S.BANDIT_SEVERITY).alias("b_sev"), F.expr(S.BANDIT_CONFIDENCE).alias("b_conf"),
        F.expr(S.PYFLAKES_MESSAGE).alias("p_msg"), F.expr(S.ESLINT_MESSAGE).alias("e_msg"),
        F.floor(F.col("event_id") / 8).alias("chunk"),
        (1 + F.col("event_id") % 300).alias("line"))
    d = d.withColumn("b_msg", F.expr(S.BANDIT_MESSAGE))
    s = lambda c: F.col(c).cast("string")
    eslint_msg = F.concat(
        F.lit('{"ruleId":'), F.when(F.col("e_rule").isNull(), F.lit("null"))
                             .otherwise(F.concat(F.lit('"'), F.col("e_rule"), F.lit('"'))),
        F.lit(',"severity":'), F.when(F.col("event_type") == "error", "2").otherwise("1"),
        F.lit(',"line":'), s("line"), F.lit(',"column":'), (1 + F.col("k") % 40).cast("string"),
        F.lit(',"message":"'), F.col("e_msg"), F.lit('"'),
        F.when(F.col("k") % 2 == 0, F.lit(',"fix":{"range":[0,1],"text":""}')).otherwise(F.lit("")),
        F.lit("}"))
    bandit_msg = F.concat(
        F.lit('{"test_id":"'), F.col("b_rule"), F.lit('","issue_severity":"'), F.col("b_sev"),
        F.lit('","issue_confidence":"'), F.col("b_conf"), F.lit('","line_number":'), s("line"),
        F.lit(',"col_offset":'), (F.col("k") % 40).cast("string"),
        F.lit(',"issue_text":"'), F.col("b_msg"), F.lit('"}'))
    pyflakes_msg = F.concat(F.col("path"), F.lit(":"), s("line"), F.lit(": "), F.col("p_msg"))
    d = d.withColumn("item", F.when(F.col("tool") == "ESLint", eslint_msg)
                              .when(F.col("tool") == "Bandit", bandit_msg).otherwise(pyflakes_msg))
    # a chunk holds at most 8 events, so each report is a bounded group
    g = d.groupBy("path", "tool", "chunk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"]).alias("arr"))
    items = F.when(F.col("tool") == "PyFlakes", F.array_join("arr", "\n")).otherwise(F.array_join("arr", ","))
    report = (F.when(F.col("tool") == "ESLint",
                     F.when(F.col("chunk") % 37 == 0, F.concat(F.lit("not json ["), items))
                      .otherwise(F.concat(F.lit('[{"filePath":"'), F.col("path"), F.lit('","messages":['),
                                          items, F.lit("]}]"))))
              .when(F.col("tool") == "Bandit", F.concat(F.lit('{"results":['), items, F.lit("]}")))
              .otherwise(items))
    return g.select("path", "tool", "chunk", report.alias("report"))


def snapshots(spark: SparkSession, sf_dir: str):
    """F9 (five projects share their paths): two snapshots of file rows (project_id, path, file_hash, risk, mtime) and their entities.

    A keeps parts whose key is not a multiple of 7, B those not a multiple of 5; in B the hash
    and mtime change when p_size > 25. Each file has two entities per snapshot.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    path = F.concat(F.lit("src/p"), (F.col("p_partkey") - F.col("p_partkey") % 5).cast("string"), F.lit(".ts"))
    proj = (F.col("p_partkey") % 5).alias("project_id")
    big = F.col("p_size") > 25
    pa = p.filter(F.col("p_partkey") % 7 != 0)
    pb = p.filter(F.col("p_partkey") % 5 != 0)
    a = pa.select(proj, path.alias("path"), F.md5("p_name").alias("file_hash"),
                  (F.col("p_size") / 50.0).alias("risk"), (F.lit(1700000000) + F.col("p_partkey")).alias("mtime"))
    b = pb.select(proj, path.alias("path"),
                  F.when(big, F.md5(F.concat("p_name", F.lit("#2")))).otherwise(F.md5("p_name")).alias("file_hash"),
                  (F.col("p_size") % 17 / 16.0).alias("risk"),
                  (F.lit(1700000000) + F.col("p_partkey") + F.when(big, 60).otherwise(0)).alias("mtime"))
    ent = lambda d, n1, n2: d.select(proj, path.alias("path"), F.explode(F.array(n1, n2)).alias("name"))
    ent_a = ent(pa, F.concat(F.lit("f"), (F.col("p_size") % 10).cast("string")),
                F.concat(F.lit("c"), (F.col("p_partkey") % 3).cast("string")))
    ent_b = ent(pb, F.concat(F.lit("f"), (F.col("p_size") % 7).cast("string")),
                F.concat(F.lit("c"), ((F.col("p_partkey") + 1) % 3).cast("string")))
    return a, b, ent_a, ent_b


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commits (project_id, branch, commit_hash, commit_time, author, seq)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.select(
        (F.col("o_custkey") % 20).alias("project_id"),
        F.expr(S.COMMIT_BRANCH).alias("branch"),
        F.md5(F.col("o_orderkey").cast("string")).alias("commit_hash"),
        F.col("o_orderdate").alias("commit_time"),
        F.concat(F.lit("a"), (F.col("o_custkey") % 7).cast("string")).alias("author"),
        F.col("o_orderkey").alias("seq"))


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file change events (project_id, path, dest_path, change_type, ts, event_id)."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    path = F.concat(F.expr(S.CHANGE_DIR), F.lit("p"), F.col("user_id").cast("string"),
                    F.when(F.col("event_id") % 13 == 0, F.lit(".log")).otherwise(F.lit(".py")))
    return ev.select(
        (F.col("user_id") % 5).alias("project_id"), path.alias("path"),
        F.when(F.col("event_type") == "purchase",
               F.concat(F.lit("src/p"), (F.col("user_id") + 1).cast("string"), F.lit(".py"))).alias("dest_path"),
        F.expr(S.CHANGE_TYPE).alias("change_type"), "ts", "event_id")


def numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``git diff --numstat`` rows as text (project_id, path, added, deleted); '-' marks binary."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                                                 "l_returnflag")
    binary = F.col("l_returnflag") == "R"
    return li.select(
        (F.col("l_partkey") % 5).alias("project_id"),
        F.concat(F.lit("src/p"), (F.col("l_partkey") - F.col("l_partkey") % 5).cast("string"), F.lit(".ts")).alias("path"),
        F.col("l_orderkey").alias("commit_seq"),
        F.col("l_linenumber").cast("long").alias("line_no"),
        F.when(binary, "-").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("added"),
        F.when(binary, "-").otherwise(F.col("l_linenumber").cast("string")).alias("deleted"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project trees (project_id, path, content) with marker files and top-level folders.

    The first part of each (project, marker kind) holds the root marker; the min over that group
    is a hash aggregate joined back (no window over a whole group).
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    d = p.withColumn("project_id", F.col("p_partkey") % 20).withColumn("kind", F.expr(S.LISTING_KIND))
    firsts = d.groupBy("project_id", "kind").agg(F.min("p_partkey").alias("__first"))
    d = d.join(firsts, ["project_id", "kind"]).withColumn("first_of_kind", F.col("p_partkey") == F.col("__first"))
    return d.select("project_id", F.expr(S.LISTING_PATH).alias("path"), F.expr(S.LISTING_CONTENT).alias("content"))


TREE_T0 = "2024-05-01 00:00:00"


def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change rows with texts over the file view (project_id, path, dest_path, change_type, ts, event_id, content).

    Every file is created; then, by its number, some are modified with one more import, deleted, moved to another suffix, joined by a file
    of the same stem with a better suffix, or named by an older change that comes late.
    """
    f = code_files(spark, sf_dir).select("project_id", "path", "lang", "content", F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("id"),
                                         F.col("path").startswith("src/").alias("src"))
    own = F.when(F.col("src"), 0).otherwise(8)

    def change(when, kind, hours, k, path="path", dest="CAST(NULL AS STRING)", content="content"):
        ts = F.lit(TREE_T0).cast("timestamp_ntz") + F.make_dt_interval(hours=F.expr(hours).cast("int"))
        return f.where(when).select("project_id", F.expr(path).alias("path"), F.expr(dest).alias("dest_path"), F.lit(kind).alias("change_type"), ts.alias("ts"),
                                    (F.col("id") * 16 + own + k).alias("event_id"), F.expr(content).alias("content"))
    out = None
    for row in S.TREE_CHANGES:
        part = change(*row)
        out = part if out is None else out.unionByName(part)
    return out
