"""Entity and import extraction from file text.

Python needs a real parser (stdlib ``ast``): a ``mapInPandas`` pass in which each task parses its own
batch of files. JavaScript/TypeScript are regular expressions, evaluated by Spark itself. The result is
one row per entity or import; other languages yield nothing (their file row stays).
"""

from __future__ import annotations

import sys
from functools import reduce
from operator import and_

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The batch function runs in Python workers; ship this module's code with it (by value) so that
# executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The JavaScript/TypeScript patterns, in the order they are applied.
JS_FUNCTION_PATTERNS = [
    r'function\s+(\w+)\s*\(',
    r'const\s+(\w+)\s*=\s*\(',
    r'(\w+)\s*:\s*function\s*\(',
    r'(\w+)\s*=>\s*',
]
JS_CLASS_PATTERN = r'class\s+(\w+)'
# Texts without one of these parts cannot match the pattern, so it need not run over them.
JS_PARTS = {
    r'function\s+(\w+)\s*\(': ["function"],
    r'const\s+(\w+)\s*=\s*\(': ["const"],
    r'(\w+)\s*:\s*function\s*\(': [":", "function"],
    r'(\w+)\s*=>\s*': ["=>"],
    r'class\s+(\w+)': ["class"],
    r'import\s+.*\s+from\s+["\']([^"\']+)["\']': ["import", "from"],
    r'import\s+["\']([^"\']+)["\']': ["import"],
    r'require\(["\']([^"\']+)["\']\)': ["require("],
}
JS_IMPORT_PATTERNS = [
    r'import\s+.*\s+from\s+["\']([^"\']+)["\']',
    r'import\s+["\']([^"\']+)["\']',
    r'require\(["\']([^"\']+)["\']\)',
]

def _python_rows(content: str):
    import ast
    try:
        tree = ast.parse(content)
    except Exception:  # syntax error (or null bytes): no entities, no imports; the file row stays
        return
    for node in ast.walk(tree):  # breadth-first
        if isinstance(node, ast.FunctionDef):
            yield ("entity", node.name, "function", node.lineno, f"def {node.name}(...)", ast.get_docstring(node))
        elif isinstance(node, ast.ClassDef):
            yield ("entity", node.name, "class", node.lineno, f"class {node.name}(...)", ast.get_docstring(node))
        elif isinstance(node, ast.Import):
            for alias in node.names:
                yield ("import", alias.name, None, None, None, None)
        elif isinstance(node, ast.ImportFrom):
            if node.module:
                yield ("import", node.module, None, None, None, None)


def _extract_batches(batches):
    import pandas as pd
    cols = ["project_id", "path", "kind", "seq", "name", "entity_type", "line_number", "signature", "docstring"]
    for pdf in batches:
        out = []
        for pid, path, content in zip(pdf["project_id"], pdf["path"], pdf["content"]):
            for seq, row in enumerate(_python_rows(content)):
                kind, name, etype, line, sig, doc = row
                out.append((pid, path, kind, seq, name, etype, line, sig, doc))
        yield pd.DataFrame(out, columns=cols)


def _newlines(text) -> F.Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def javascript_rows(files: DataFrame) -> DataFrame:
    """One row per match of the patterns, without Python.

    ``(?dU)`` gives the patterns the meaning that they have in Python's ``re`` ("." stops at a line feed only, word and space
    classes are Unicode). The text between matches comes from ``split`` with the same pattern; running sums over the line
    feeds in these gaps and in the matches give the line of each match in one pass over a file's matches. ``seq``
    orders by pattern, then by place.
    """
    found = []
    patterns = [*[("entity", "function", p) for p in JS_FUNCTION_PATTERNS], ("entity", "class", JS_CLASS_PATTERN),
                *[("import", None, p) for p in JS_IMPORT_PATTERNS]]
    for rank, (kind, etype, pattern) in enumerate(patterns):
        rx = F.lit("(?dU)" + pattern)
        gaps = F.transform(F.split(F.col("content"), "(?dU)" + pattern, -1), _newlines)
        may = reduce(and_, [F.col("content").contains(x) for x in JS_PARTS[pattern]])
        found.append(F.when(may, F.struct(
            F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(etype).cast("string").alias("entity_type"),
            F.regexp_extract_all("content", rx, F.lit(1)).alias("names"), F.regexp_extract_all("content", rx, F.lit(0)).alias("texts"),
            gaps.alias("gaps"))))
    d = files.select("project_id", "path", F.explode(F.array(*found)).alias("f")).filter(F.col("f").isNotNull() & (F.size("f.names") > 0))
    d = d.select("project_id", "path", "f.rank", "f.kind", "f.entity_type",
                 F.posexplode(F.arrays_zip("f.names", "f.texts", "f.gaps")).alias("place", "h"))
    d = d.select("project_id", "path", "rank", "kind", "entity_type", "place", F.col("h")["names"].alias("name"),
                 F.col("h")["texts"].alias("text"), F.col("h")["gaps"].alias("gap"))
    w = Window.partitionBy("project_id", "path", "rank").orderBy("place")
    before = F.sum(_newlines(F.col("text"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("line", (1 + F.sum("gap").over(w) + F.coalesce(before, F.lit(0))).cast("long"))
    d = d.filter(F.col("name").isNotNull())  # the gap after the last match has none
    entity = F.col("kind") == "entity"
    return d.select("project_id", "path", "kind", (F.shiftleft(F.col("rank").cast("long"), 40) + F.col("place")).alias("seq"),
                    "name", "entity_type", F.when(entity, F.col("line")).alias("line_number"),
                    F.when(entity, F.col("text")).alias("signature"), F.lit(None).cast("string").alias("docstring"))


def analyze_files(files: DataFrame) -> DataFrame:
    """E5: one row per entity (``kind='entity'``) or import (``kind='import'``) of every file.

    ``files`` has project_id (any type), path, lang (graph language) and content. ``seq`` is the extraction
    order inside the file (entities and imports share it), which decides "last definition wins". Files without
    text give no rows.
    """
    src = files.select("project_id", "path", "lang", "content").filter(F.col("content").isNotNull())
    schema = src.select("project_id", "path").schema
    for name, kind in (("kind", "string"), ("seq", "long"), ("name", "string"), ("entity_type", "string"),
                       ("line_number", "long"), ("signature", "string"), ("docstring", "string")):
        schema = schema.add(name, kind)
    py = src.filter(F.col("lang") == "python").mapInPandas(_extract_batches, schema)
    return py.unionByName(javascript_rows(src.filter(F.col("lang").isin("javascript", "typescript"))))


def entities(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.col("kind") == "entity").drop("kind")


def imports(extracted: DataFrame) -> DataFrame:
    return (extracted.filter(F.col("kind") == "import")
                     .select("project_id", "path", "seq", F.col("name").alias("specifier")))
