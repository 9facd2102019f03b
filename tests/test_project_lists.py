"""A10: the project score lists the files it evaluated and those it skipped."""

from pyspark.sql import functions as F

from codegauge.operators import scoring as SC
from codegauge.plans import q_scoring
from conftest import SF001


def test_project_files_are_listed(spark):
    scores = spark.createDataFrame([(1, "a.py", 91.0, "A"), (2, "b.py", 10.0, "F")], "project_id LONG, path STRING, total_score DOUBLE, grade STRING")
    skipped = spark.createDataFrame([(1, "x.h", "no metric language"), (3, "y.c", "no text")], "project_id LONG, path STRING, reason STRING")
    got = sorted((r.project_id, r.kind, r.path, r.total_score, r.grade, r.reason) for r in SC.project_files(scores, ["project_id"], skipped).collect())
    assert got == [(1, "file", "a.py", 91.0, "A", None), (1, "skipped", "x.h", None, None, "no metric language"), (2, "file", "b.py", 10.0, "F", None), (3, "skipped", "y.c", None, None, "no text")]


def test_project_score_leaves_no_listed_file_out(spark):
    d = q_scoring.project_score(spark, SF001).cache()
    totals = d.where("kind = 'project'").agg(F.sum("files_evaluated").alias("done"), F.sum("files_skipped").alias("left"), *[F.sum(f"n_grade_{g}").alias(g) for g in ("Ap", "A", "B", "C", "D", "F")]).first()
    assert totals.done == d.where("kind = 'file'").count() > 0
    assert totals.left == d.where("kind = 'skipped'").count() == spark.read.parquet(f"{SF001}/part.parquet").count()
    grades = {r.grade: r["count"] for r in d.where("kind = 'file'").groupBy("grade").count().collect()}
    assert {g: totals[g.replace("+", "p")] for g in grades} == grades
    reasons = {(r.path.rsplit(".", 1)[1], r.reason) for r in d.where("kind = 'skipped'").collect()}
    assert reasons == {("h", "no metric language"), ("hpp", "no metric language"), ("c", "no text")}
    d.unpersist()
