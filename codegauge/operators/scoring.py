"""The 0-100 quality score: six category scores, weighted total, bonuses, grade and lists.

Everything is a column expression over one row per file (metrics ⟕ finding counts ⟕ issue
penalties), so the score itself never shuffles; only the per-file joins (J4) and the project
aggregate (A10) do. Float operations keep the order of the rule so results are bit-identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.functions.text import filled
from codegauge.operators.ordered import top_k

CATEGORIES = ["maintainability", "reliability", "security", "performance", "style", "complexity"]


def clamp(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def score_by_threshold(v: Column, good: float, acceptable: float, bad: float) -> Column:
    """Piecewise-linear 0..1 score of one metric."""
    v = v.cast("double")
    return (F.when(v <= good, F.lit(1.0))
             .when(v <= acceptable, F.lit(1.0) - ((v - good) / F.lit(float(acceptable - good))) * 0.3)
             .when(v <= bad, F.lit(0.7) - ((v - acceptable) / F.lit(float(bad - acceptable))) * 0.5)
             .otherwise(F.greatest(F.lit(0.0), F.lit(0.2) - F.least(F.lit(2.0), (v - bad) / F.lit(float(bad))) * 0.2)))


def estimate_maintainability(loc, cc, cog, n_long, n_dup) -> Column:
    """Fallback index used only when the analyser's index is absent."""
    s = (F.lit(100) - cc * 2 - cog * F.lit(1.5) - F.greatest(F.lit(0.0), (loc - 100) * F.lit(0.1))
         - (n_long * 5 + n_dup * 8))
    return clamp(s)


def _pos(c: Column, t) -> Column:
    return F.when(c > t, c - t).otherwise(F.lit(0))


def category_scores(df: DataFrame, w: R.ScoringWeights = R.ScoringWeights()) -> DataFrame:
    """P19-P24 from metric columns, A1 counts (``n_*``) and ``issue_penalty`` (A2)."""
    col = F.col
    cc, cog, nest = col("cyclomatic"), col("cognitive"), col("max_nesting")
    n_long, n_dup = col("n_long"), col("n_dup")
    mi = F.coalesce(col("maintainability_index").cast("double"),
                    estimate_maintainability(col("lines_of_code"), cc, cog, n_long, n_dup))
    cplx_pen = _pos(cc, 10) * 2 + F.when(cog > 20, (cog - 20) * F.lit(1.5)).otherwise(F.lit(0.0))
    maint = clamp(clamp(mi) - cplx_pen - n_long * 5 - n_dup * 8 - col("n_style_warning") * 3)
    rel = clamp(F.lit(100.0) - col("n_error") * F.lit(w.error_penalty) - col("n_warning") * F.lit(w.warning_penalty)
                - col("issue_penalty") - F.when(cc > 20, (cc - 20) * F.lit(1.5)).otherwise(F.lit(0.0)))
    sec_pen = (col("n_security_error") * 25 + col("n_security_warning") * 10
               + (col("n_security") - col("n_security_error") - col("n_security_warning")) * 3
               + col("n_high_risk_rule") * 15)
    sec = clamp(F.lit(100.0) - sec_pen)
    perf = clamp(F.lit(100.0) - col("n_performance") * 5 - _pos(cc, 15) * 2 - _pos(nest, 4) * 3 - n_long * 2)
    sty_pen = (col("n_style_error") * 8 + col("n_style_warning") * 3
               + (col("n_style") - col("n_style_error") - col("n_style_warning")))
    sty = clamp(F.lit(100.0) - sty_pen)
    t = R.THRESHOLDS
    denom = w.cyclomatic_complexity_weight + w.cognitive_complexity_weight + w.nesting_depth_weight
    weighted = ((score_by_threshold(cc, *t["cyclomatic_complexity"]) * F.lit(w.cyclomatic_complexity_weight)
                 + score_by_threshold(cog, *t["cognitive_complexity"]) * F.lit(w.cognitive_complexity_weight))
                + score_by_threshold(nest, *t["nesting_depth"]) * F.lit(w.nesting_depth_weight)) / F.lit(denom)
    cplx = clamp(weighted * 100)
    return (df.withColumn("maintainability", maint.cast("double"))
              .withColumn("reliability", rel.cast("double"))
              .withColumn("security", sec.cast("double"))
              .withColumn("performance", perf.cast("double"))
              .withColumn("style", sty.cast("double"))
              .withColumn("complexity", cplx.cast("double")))


def total_and_grade(df: DataFrame, w: R.ScoringWeights = R.ScoringWeights()) -> DataFrame:
    """Weighted total (rule order of additions), bonuses, clamp, grade, debt hours."""
    col = F.col
    total = F.lit(0.0)
    for cat in CATEGORIES:
        total = total + col(cat) * F.lit(getattr(w, cat))
    good = (col("cyclomatic") <= 10) & (col("max_nesting") <= 3) & (col("n_long") == 0)
    typed = (col("language").isin(*R.TYPED_LANGUAGES)
             | ((col("language") == "python") & F.coalesce(col("has_type_message"), F.lit(False))))
    documented = (col("function_count") == 0) | (col("n_long") == 0) | (col("function_count") > 5)
    adjusted = (total + F.when(good, F.lit(w.good_practices_bonus)).otherwise(F.lit(0.0))
                + F.when(typed, F.lit(3.0)).otherwise(F.lit(0.0))
                + F.when(documented, F.lit(2.0)).otherwise(F.lit(0.0)))
    total_score = clamp(adjusted)
    grade = (F.when(col("total_score") >= 95, "A+").when(col("total_score") >= 90, "A")
              .when(col("total_score") >= 80, "B").when(col("total_score") >= 70, "C")
              .when(col("total_score") >= 60, "D").otherwise("F"))
    return (df.withColumn("total_score", total_score.cast("double"))
              .withColumn("grade", grade)
              .withColumn("technical_debt_hours", col("technical_debt_minutes") / 60.0))


def recommendations(df: DataFrame) -> Column:
    """Ordered advice (at most five) as an array column."""
    col = F.col
    items = F.array(
        F.when(col("cyclomatic") > 15, filled(R.RECOMMEND_CYCLOMATIC, col("cyclomatic"))),
        F.when(col("cognitive") > 25, filled(R.RECOMMEND_COGNITIVE, col("cognitive"))),
        F.when(col("n_long") > 0, filled(R.RECOMMEND_LONG, col("n_long"))),
        F.when(col("n_dup") > 0, filled(R.RECOMMEND_DUPLICATES)),
        F.when(col("n_security") > 0, filled(R.RECOMMEND_SECURITY, col("n_security"))),
    )
    return F.slice(F.array_compact(items), 1, 5)


def strengths(df: DataFrame) -> Column:
    """Categories scoring at least 85, then the structural strengths."""
    col = F.col
    items = [F.when(col(c) >= 85, filled(R.STRENGTH_CATEGORY, F.lit(c))) for c in CATEGORIES]
    items += [F.when(col("cyclomatic") <= 5, filled(R.STRENGTH_COMPLEXITY)),
              F.when(col("max_nesting") <= 2, filled(R.STRENGTH_NESTING)),
              F.when(col("n_long") == 0, filled(R.STRENGTH_FUNCTIONS)),
              F.when(col("n_dup") == 0, filled(R.STRENGTH_DUPLICATES))]
    return F.array_compact(F.array(*items))


COUNT_COLUMNS = ["n_findings", "n_error", "n_warning", "n_security", "n_security_error", "n_security_warning",
                 "n_high_risk_rule", "n_performance", "n_style", "n_style_error", "n_style_warning"]


def join_inputs(metrics: DataFrame, counts: DataFrame, issue_pen: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics ⟕ finding counts ⟕ issue penalties, zero-filled."""
    d = metrics.join(counts, keys, "left").join(issue_pen, keys, "left")
    for c in COUNT_COLUMNS + ["issue_penalty"]:
        d = d.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return d.withColumn("has_type_message", F.coalesce(F.col("has_type_message"), F.lit(False)))


def issue_penalty(issues: DataFrame, keys: list[str]) -> DataFrame:
    """A2: Σ 15 / 8 / 3 per error / warning / other issue, plus complexity-error count."""
    sev = F.col("severity")
    return issues.groupBy(*keys).agg(
        F.sum(F.when(sev == "error", 15).when(sev == "warning", 8).otherwise(3)).cast("long").alias("issue_penalty"))


def derived_issue_penalty(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """A2 when the issues are exactly those derived from the metrics (P17), without issue rows."""
    col = F.col
    pen = (F.when(col("cyclomatic") > 15, 8).otherwise(0) + F.when(col("cognitive") > 25, 8).otherwise(0)
           + col("n_long") * 3 + col("n_dup") * 8 + F.when(col("maintainability_index") < 30, 15).otherwise(0))
    return metrics.select(*keys, pen.cast("long").alias("issue_penalty"))


def score_files(metrics: DataFrame, counts: DataFrame, issue_pen: DataFrame, keys: list[str],
                w: R.ScoringWeights = R.ScoringWeights()) -> DataFrame:
    d = join_inputs(metrics, counts, issue_pen, keys)
    d = total_and_grade(category_scores(d, w), w)
    return d.withColumn("recommendations", recommendations(d)).withColumn("strengths", strengths(d))


def priority_issues(findings: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """First 3 security errors, first 2 complexity errors (issues), first 2 errors (findings).

    Rows (keys, priority_rank, label). Each class keeps its first rows with the bounded
    hierarchical top-k, so a file with millions of findings is never one window partition.
    ``findings`` must have ``ordinal`` (its report order); ``issues`` must have ``kind`` and ``seq``.
    """
    err = findings.filter(F.col("severity") == "error").select(*keys, "ordinal", "message", "category")
    sec = top_k(err.filter(F.col("category") == "security"), keys, ["ordinal"], 3, out="r")
    rel = top_k(err, keys, ["ordinal"], 2, out="r")
    iss = issues.filter((F.col("category") == "complexity") & (F.col("severity") == "error")) \
                .withColumn("ordinal", F.col("kind") * F.lit(1 << 40) + F.col("seq"))
    cpx = top_k(iss.select(*keys, "ordinal", "message"), keys, ["ordinal"], 2, out="r")
    parts = [sec.select(*keys, F.lit(0).alias("cls"), "r", F.concat(F.lit("\U0001F6A8 Security: "), "message").alias("label")),
             cpx.select(*keys, F.lit(1).alias("cls"), "r", F.concat(F.lit("⚡ Complexity: "), "message").alias("label")),
             rel.select(*keys, F.lit(2).alias("cls"), "r",
                        F.concat(F.lit("⚠️  Reliability: "), "message").alias("label"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # rank inside the file: 0-2 security, then the complexity ones, then reliability (<= 7 rows per file)
    from pyspark.sql import Window
    wdw = Window.partitionBy(*keys).orderBy("cls", "r")
    return u.select(*keys, F.row_number().over(wdw).cast("long").alias("priority_rank"), "label")


def project_files(scores: DataFrame, project: list[str], skipped: DataFrame) -> DataFrame:
    """A10, its lists: a row for each evaluated file (``kind = 'file'``, path, total_score, grade) and each skipped one (``'skipped'``, path, reason).

    Rows and not arrays of the project's row, which would hold all files of a project."""
    done = scores.select(*project, F.lit("file").alias("kind"), "path", "total_score", "grade")
    return done.unionByName(skipped.select(*project, F.lit("skipped").alias("kind"), "path", "reason"), allowMissingColumns=True)


def project_score(scores: DataFrame, project: list[str], skipped: DataFrame | None = None) -> DataFrame:
    """A10: files evaluated, mean total and mean per category (0 when no file), skipped count. The files themselves: :func:`project_files`."""
    aggs = [F.count(F.lit(1)).cast("long").alias("files_evaluated"),
            F.avg("total_score").alias("average_score")]
    aggs += [F.avg(c).alias(f"avg_{c}") for c in CATEGORIES]
    aggs += [F.count_if(F.col("grade") == g).cast("long").alias(f"n_grade_{g.replace('+', 'p')}")
             for g in ["A+", "A", "B", "C", "D", "F"]]
    out = scores.groupBy(*project).agg(*aggs)
    if skipped is not None:
        sk = skipped.groupBy(*project).agg(F.count(F.lit(1)).cast("long").alias("files_skipped"))
        out = out.join(sk, project, "full_outer")
    else:
        out = out.withColumn("files_skipped", F.lit(0).cast("long"))
    for c in ["files_evaluated", "files_skipped"] + [f"n_grade_{g}" for g in ["Ap", "A", "B", "C", "D", "F"]]:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    for c in ["average_score"] + [f"avg_{c}" for c in CATEGORIES]:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return out
