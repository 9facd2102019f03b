"""Text-based code metrics over a table of source lines.

Input: ``lines`` with the file key columns, ``lang`` and ``pos`` (0-based line index in the
file, after newline normalisation) and ``line`` (raw text without the newline).

Per-file sums (sizes, substring counts) are hash aggregates with map-side partial aggregation.
Line-order rules (cognitive complexity, nesting, function spans, duplicate blocks) use the
block-decomposed operators of :mod:`codegauge.operators.ordered`, so a huge file is spread over
many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.functions.text import (by_language, contains_any, count_any, ends_with_any,
                                      filled, leading_ws, py_strip)
from codegauge.operators.ordered import BLOCK, clamped_scan, next_marker, ordinal, split_blocks, top_k
from codegauge.session import materialize


def with_line_features(lines: DataFrame) -> DataFrame:
    """Per-line columns every metric needs; all JVM expressions."""
    s = F.col("stripped")
    d = lines.withColumn("stripped", py_strip("line"))
    ends_block = ends_with_any(s, R.BLOCK_ENDINGS)
    cog_open = contains_any(s, R.COGNITIVE_OPENERS) & ends_block
    cog_close = s.isin(*R.COGNITIVE_CLOSERS) | s.startswith("except")
    nest_kw = contains_any(s, R.NESTING_OPENERS)
    nest_step = (F.when(nest_kw, F.when(ends_block, 1).otherwise(0))
                  .when(s.isin(*R.NESTING_CLOSERS)
                        | ((F.col("lang") == "python") & (leading_ws("line") < 4)), -1)
                  .otherwise(0))
    return (d.withColumn("cog_open", cog_open)
             .withColumn("cog_step", cog_open.cast("int") - cog_close.cast("int"))
             .withColumn("nest_step", nest_step.cast("int")))


def _count_terms(lines: DataFrame) -> DataFrame:
    """Per-line parts of the per-file sums (non-blank, code line, keyword and pattern counts)."""
    line, s = F.col("line"), py_strip("line")
    cc_terms = by_language("lang", R.CYCLOMATIC_KEYWORDS, lambda kws: count_any(line, kws), F.lit(0))
    fn_terms = by_language("lang", R.FUNCTION_PATTERNS, lambda kws: count_any(line, kws), F.lit(0))
    cls_terms = by_language("lang", R.CLASS_PATTERNS, lambda kws: count_any(line, kws), F.lit(0))
    return (lines.withColumn("__nb", (s != "").cast("int"))
                 .withColumn("__loc", ((s != "") & ~s.startswith("#")).cast("int"))
                 .withColumn("__cc", cc_terms.cast("long"))
                 .withColumn("__fn", fn_terms.cast("long"))
                 .withColumn("__cls", cls_terms.cast("long")))


def _count_aggs():
    return [
        F.sum("__nb").cast("long").alias("line_count"),
        F.sum("__loc").cast("long").alias("lines_of_code"),
        F.least(F.lit(R.CYCLOMATIC_CAP), F.lit(1) + F.sum("__cc")).cast("long").alias("cyclomatic"),
        F.sum("__fn").cast("long").alias("function_count"),
        F.sum("__cls").cast("long").alias("class_count"),
    ]


def size_and_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """line_count, lines_of_code, cyclomatic, function and class counts per file."""
    return _count_terms(lines).groupBy(*keys, "lang").agg(*_count_aggs())


def _fold_aggs():
    cog_level = F.col("cog_prev") + 1 - F.col("cog_floor")
    nest_level = F.col("nest_sum") - F.least(F.col("nest_floor"), F.col("nest_sum"))
    return [
        F.least(F.lit(R.COGNITIVE_CAP),
                F.coalesce(F.sum(F.when(F.col("cog_open"), cog_level)), F.lit(0))).cast("long").alias("cognitive"),
        F.greatest(F.lit(0), F.max(nest_level)).cast("long").alias("max_nesting"),
    ]


def fold_metrics(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Cognitive complexity and maximum nesting depth per file (line-order folds)."""
    d = with_line_features(lines).select(*keys, "pos", "cog_open", "cog_step", "nest_step")
    d = clamped_scan(d, keys, "pos", {"cog_step": "cog", "nest_step": "nest"})
    return d.groupBy(*keys).agg(*_fold_aggs())


def line_metrics(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes, counts and both folds in one pass: the count terms ride through the ordered scan
    and are summed in the same per-file aggregate as the folds (one scan, one aggregate)."""
    d = _count_terms(with_line_features(lines)).select(
        *keys, "lang", "pos", "cog_open", "cog_step", "nest_step", "__nb", "__loc", "__cc", "__fn", "__cls")
    d = clamped_scan(d, keys, "pos", {"cog_step": "cog", "nest_step": "nest"})
    return d.groupBy(*keys, "lang").agg(*_count_aggs(), *_fold_aggs())


def long_functions(lines: DataFrame, keys: list[str], block_size: int = BLOCK) -> DataFrame:
    """One row per function longer than the limit: distance to the next function start.

    Python starts are lines whose stripped text starts with ``def ``; JavaScript/TypeScript
    starts contain ``function ``. The last start of a file has no successor and is never reported;
    a start with an empty name is not reported either.
    """
    s = py_strip("line")
    is_py = F.col("lang") == "python"
    is_js = F.col("lang").isin("javascript", "typescript")
    starts = lines.withColumn("stripped", s).filter(
        (is_py & F.col("stripped").startswith("def ")) | (is_js & F.col("stripped").contains("function ")))
    st = F.col("stripped")
    py_name = F.replace(F.substring_index(st, "(", 1), F.lit("def "), F.lit(""))
    after = F.substring(st, F.instr(st, "function ") + 9, 1 << 30)
    js_name = py_strip(F.substring_index(F.substring_index(after, "function ", 1), "(", 1))
    starts = starts.select(*keys, "lang", "pos", F.when(is_py, py_name).otherwise(js_name).alias("name"))
    nxt = next_marker(starts, keys, "pos", block_size=block_size)
    gap = F.col("next_pos") - F.col("pos")
    return (nxt.filter(F.col("next_pos").isNotNull() & (F.col("name") != "")
                       & (gap > R.LONG_FUNCTION_LINES))
               .select(*keys, "lang", F.col("pos").cast("long").alias("start_pos"), "name",
                       gap.cast("long").alias("n_lines"),
                       F.concat(F.col("name"), F.lit(" ("), gap.cast("string"), F.lit(" lines)"))
                        .alias("label")))


def duplicate_blocks(lines: DataFrame, keys: list[str], limit: int | None = R.DUPLICATE_LIMIT,
                     block_size: int = BLOCK) -> DataFrame:
    """First ``limit`` pairs of equal 3-line blocks per file, in (i, j) order, j >= i + 3 (None: all pairs).

    Lines are the stripped non-blank lines renumbered from 1, as 128-bit digests; a block is the digest of
    its three. Only blocks that occur twice in a file are ranked. Instead of pairing every two
    occurrences of a block (quadratic in a file of equal lines), each is joined to the next
    ``limit + 2`` of its block: at most two of those can be closer than three lines, so the first
    ``limit`` partners of every occurrence are among them. Files inside the first block of positions are dealt by file once and every
    step is a window there (:func:`_duplicates_in_place`); longer ones, and all pairs (no limit), go block by block.
    """
    if limit is None:
        return _duplicates_by_block(lines, keys, limit, block_size)
    short, long = split_blocks(lines.select(*keys, "pos", "line"), keys, "pos", block_size)
    out = _duplicates_in_place(short, keys, limit)
    return out if long is None else out.unionByName(_duplicates_by_block(long, keys, limit, block_size))


def _duplicates_in_place(lines: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """:func:`duplicate_blocks` of files that one task holds: the windows over (file) and (file, block) follow one exchange by file."""
    d = lines.select(*keys, "pos", py_strip("line").alias("s")).filter(F.col("s") != "")
    d = d.select(*keys, "pos", F.unhex(F.md5(F.col("s").cast("binary"))).alias("s")).repartition(*keys)
    w = Window.partitionBy(*keys).orderBy("pos")
    d = d.select(*keys, F.row_number().over(w).alias("r"), "s", F.lead("s", 1).over(w).alias("s2"), F.lead("s", 2).over(w).alias("s3"))
    d = d.filter(F.col("s3").isNotNull()).select(*keys, "r", F.unhex(F.md5(F.concat("s", "s2", "s3"))).alias("h"))
    wh = Window.partitionBy(*keys, "h").orderBy("r")
    d = d.withColumn("later", F.collect_list("r").over(wh.rowsBetween(1, limit + 2)))
    near = F.filter("later", lambda x: x >= F.col("r") + 3)
    pairs = d.filter(F.size("later") > 0).select(*keys, "r", F.explode(near).alias("rj"))
    return _duplicate_rows(top_k(pairs, keys, ["r", "rj"], limit, out="dup_rank"), keys)


def _duplicates_by_block(lines: DataFrame, keys: list[str], limit: int | None, block_size: int) -> DataFrame:
    nb = lines.select(*keys, "pos", py_strip("line").alias("s")).filter(F.col("s") != "")
    nb = nb.select(*keys, "pos", F.unhex(F.md5(F.col("s").cast("binary"))).alias("s"))
    nb = ordinal(nb, keys, ["pos"], F.floor(F.col("pos") / block_size), out="r", start=1).drop("pos")
    # shingle = lines r, r+1, r+2: a lead window inside blocks of r, and for the last two rows
    # of a block the first two rows of the next block (a join on 2/block_size of the rows)
    nb = materialize(nb.withColumn("b", F.floor((F.col("r") - 1) / block_size)))
    wb = Window.partitionBy(*keys, "b").orderBy("r")
    sh = nb.withColumn("s2", F.lead("s", 1).over(wb)).withColumn("s3", F.lead("s", 2).over(wb))
    off = (F.col("r") - 1) % block_size
    heads = nb.filter(off < 2).select(*keys, "r", "s")
    fix = (sh.filter(off >= block_size - 2).select(*keys, "r", "s", "s2")
             .join(heads.select(*keys, (F.col("r") - 1).alias("r"), F.col("s").alias("n1")), [*keys, "r"], "left")
             .join(heads.select(*keys, (F.col("r") - 2).alias("r"), F.col("s").alias("n2")), [*keys, "r"], "left")
             .select(*keys, "r", "s", F.coalesce("s2", "n1").alias("s2"), F.col("n2").alias("s3")))
    sh = (sh.filter(off < block_size - 2).select(*keys, "r", "s", "s2", "s3").unionByName(fix)
            .filter(F.col("s3").isNotNull()))
    sh = materialize(sh.select(*keys, "r", F.unhex(F.md5(F.concat("s", "s2", "s3"))).alias("h")))
    twice = sh.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n_occ")).filter(F.col("n_occ") > 1)
    sh = ordinal(sh.join(twice, [*keys, "h"]), [*keys, "h"], ["r"], F.floor(F.col("r") / block_size), out="g")
    last = F.col("n_occ") - 1
    upto = last if limit is None else F.least(F.col("g") + limit + 2, last)
    # only ranks that exist: an occurrence with no later occurrence yields no candidate
    left = sh.filter(F.col("g") < last).select(*keys, "h", "r", F.explode(F.sequence(F.col("g") + 1, upto)).alias("g"))
    right = sh.filter(F.col("g") > 0).select(*keys, "h", "g", F.col("r").alias("rj"))
    pairs = left.join(right, [*keys, "h", "g"]).filter(F.col("rj") >= F.col("r") + 3).select(*keys, "r", "rj")
    return _duplicate_rows(top_k(pairs, keys, ["r", "rj"], limit, out="dup_rank"), keys)


def _duplicate_rows(top: DataFrame, keys: list[str]) -> DataFrame:
    label = F.concat(F.lit("Lines "), F.col("r").cast("string"), F.lit("-"), (F.col("r") + 2).cast("string"),
                     F.lit(" duplicated at "), F.col("rj").cast("string"), F.lit("-"),
                     (F.col("rj") + 2).cast("string"))
    return top.select(*keys, F.col("dup_rank").cast("long").alias("dup_rank"),
                      F.col("r").cast("long").alias("first_line"), F.col("rj").cast("long").alias("second_line"),
                      label.alias("label"))


def maintainability_index(loc, cc, cog, n_long, n_dup):
    penalty = (F.lit(0.23) * loc + F.lit(3.2) * cc + F.lit(2.5) * cog + n_long * 5 + n_dup * 10)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(100.0) - penalty))


def technical_debt(cc, n_long, n_dup, nest):
    return (F.greatest(F.lit(0), cc - 10) * 15 + n_long * 30 + n_dup * 45
            + F.greatest(F.lit(0), nest - 4) * 20)


def file_metrics(lines: DataFrame, keys: list[str], long_fns: DataFrame | None = None,
                 dups: DataFrame | None = None) -> DataFrame:
    """All per-file metrics in one row per file (the analyser's ``CodeMetrics``).

    ``long_fns`` / ``dups`` may be passed when the caller also needs those rows, so they are
    planned once.
    """
    base = line_metrics(lines, keys)
    long_fns = long_functions(lines, keys) if long_fns is None else long_fns
    dups = duplicate_blocks(lines, keys) if dups is None else dups
    lf = long_fns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_long"))
    dup = dups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dup"))
    m = (base.join(lf, keys, "left").join(dup, keys, "left")
               .withColumn("n_long", F.coalesce("n_long", F.lit(0)).cast("long"))
               .withColumn("n_dup", F.coalesce("n_dup", F.lit(0)).cast("long")))
    mi = maintainability_index(F.col("lines_of_code"), F.col("cyclomatic"), F.col("cognitive"),
                               F.col("n_long"), F.col("n_dup"))
    debt = technical_debt(F.col("cyclomatic"), F.col("n_long"), F.col("n_dup"), F.col("max_nesting"))
    return (m.withColumn("maintainability_index", mi)
             .withColumn("technical_debt_minutes", debt.cast("long")))


def quality_issues(metrics: DataFrame, long_fns: DataFrame | None, dups: DataFrame | None,
                   keys: list[str]) -> DataFrame:
    """Issues derived from metrics: one row each, ordinal gives the analyser's order.

    Order: cyclomatic (0), cognitive (1), each long function (2, by start), each duplicate
    (3, by rank), maintainability (4). All issues sit at line 1, column 1.
    """
    base = metrics.select(*keys, "cyclomatic", "cognitive", "maintainability_index")
    cc = (base.filter(F.col("cyclomatic") > 15)
              .select(*keys, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"),
                      F.lit("warning").alias("severity"), F.lit("complexity").alias("category"),
                      filled(R.ISSUE_CYCLOMATIC, F.col("cyclomatic")).alias("message"), F.lit(R.ADVICE_CYCLOMATIC).alias("suggestion")))
    cg = (base.filter(F.col("cognitive") > 25)
              .select(*keys, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"),
                      F.lit("warning").alias("severity"), F.lit("complexity").alias("category"),
                      filled(R.ISSUE_COGNITIVE, F.col("cognitive")).alias("message"), F.lit(R.ADVICE_COGNITIVE).alias("suggestion")))
    parts = [cc, cg]
    if long_fns is not None:
        parts.append(long_fns.select(*keys, F.lit(2).alias("kind"), F.col("start_pos").alias("seq"),
                         F.lit("info").alias("severity"), F.lit("style").alias("category"),
                         filled(R.ISSUE_LONG, F.col("label")).alias("message"), F.lit(R.ADVICE_LONG).alias("suggestion")))
    if dups is not None:
        parts.append(dups.select(*keys, F.lit(3).alias("kind"), F.col("dup_rank").alias("seq"),
                     F.lit("warning").alias("severity"), F.lit("style").alias("category"),
                     filled(R.ISSUE_DUPLICATE, F.col("label")).alias("message"), F.lit(R.ADVICE_DUPLICATE).alias("suggestion")))
    # one decimal, rounded half-even on the exact binary value (DecimalFormat), as printf in C/Python
    mi_text = F.format_number(F.col("maintainability_index"), 1)
    mi = (base.filter(F.col("maintainability_index") < 30)
              .select(*keys, F.lit(4).alias("kind"), F.lit(0).cast("long").alias("seq"),
                      F.lit("error").alias("severity"), F.lit("maintainability").alias("category"),
                      filled(R.ISSUE_INDEX, mi_text).alias("message"), F.lit(R.ADVICE_INDEX).alias("suggestion")))
    parts.append(mi)
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out.select(*keys, F.col("kind").cast("long").alias("kind"), "seq",
                      F.lit(1).cast("long").alias("line"), F.lit(1).cast("long").alias("col"),
                      "severity", "category", "message", "suggestion",
                      F.lit(False).alias("auto_fixable"))
