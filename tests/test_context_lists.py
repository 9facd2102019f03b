"""The file context gives its lists, not only counts."""

import datetime as dt

from pyspark.sql import functions as F

from codegauge.operators import graph as G
from codegauge.plans import q_graph
from conftest import SF001


def test_file_context_has_its_lists(spark):
    risk = spark.createDataFrame([(1, "a.py", 10, 2, 1, 0.3, "2024-01-01T00:00:00"), (1, "b.js", 5, 1, 2, 0.0, None)],
                                 "project_id LONG, path STRING, size_bytes LONG, line_count LONG, n_imports LONG, risk_score DOUBLE, last_modified STRING")
    ents = spark.createDataFrame([(1, "a.py", "f", "function", 1, "def f(...)", "Doc."), (1, "a.py", "f", "function", 9, "def f(...)", None), (1, "gone.py", "x", "class", 1, "class x(...)", None)],
                                 "project_id LONG, path STRING, name STRING, entity_type STRING, line_number LONG, signature STRING, docstring STRING")
    edges = spark.createDataFrame([(1, "b.js", "a.py", "imports"), (1, "a.py", "a.py:f", "contains"), (2, "b.js", "a.py", "imports")],
                                  "project_id LONG, src STRING, dst STRING, relation_type STRING")
    imps = spark.createDataFrame([(1, "b.js", "./a"), (1, "b.js", "./a"), (1, "a.py", "os")], "project_id LONG, path STRING, specifier STRING")
    got = G.file_context(risk, ents, edges, imps).collect()
    files = {r.path: (r.language, r.n_entities, r.n_dependencies, r.n_dependents, r.n_imports, r.last_modified) for r in got if r.kind == "file"}
    assert files == {"a.py": ("python", 1, 1, 1, 1, "2024-01-01T00:00:00"), "b.js": ("javascript", 0, 1, 0, 2, None)}
    lists = sorted((r.path, r.kind, r.item, r.item_type or "", r.line_number or 0, r.signature or "", r.docstring or "", r.n or 0) for r in got if r.kind != "file")
    assert lists == [("a.py", "dependency", "a.py:f", "contains", 0, "", "", 0), ("a.py", "dependent", "b.js", "imports", 0, "", "", 0),
                     ("a.py", "entity", "f", "function", 1, "def f(...)", "Doc.", 0), ("a.py", "entity", "f", "function", 9, "def f(...)", "", 0), ("a.py", "import", "os", "", 0, "", "", 1),
                     ("b.js", "dependency", "a.py", "imports", 0, "", "", 0), ("b.js", "import", "./a", "", 0, "", "", 2)]


def test_file_context_query_names_what_it_counts(spark):
    d = q_graph.file_context(spark, SF001).cache()
    one = d.where("kind = 'file'")
    rows = {r.kind: r for r in d.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n").alias("m")).collect()}
    counted = one.agg(*[F.sum(c).alias(c) for c in ("n_entities", "n_dependencies", "n_dependents", "n_imports")], F.count("last_modified").alias("timed")).first()
    assert one.groupBy("project_id", "path").count().where("count > 1").isEmpty()
    assert counted.n_dependencies == rows["dependency"].n > 0 and counted.n_dependents == rows["dependent"].n > 0 and counted.n_imports == rows["import"].m > 0
    assert counted.n_entities == d.where("kind = 'entity'").select("project_id", "path", "item").distinct().count() > 0 and counted.timed > 0
    assert dt.datetime.fromisoformat(one.agg(F.max("last_modified")).first()[0]).year > 1990
    d.unpersist()
