"""Source trees: the sink that lays them out, and the capped scan."""

import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from codegauge.session import checkpoint_dir
from codegauge.sources import files as SF
from codegauge.sources.trees import write_tree

FILES = {"src/a.py": b"x = 1\r\ny = 2\r", "src/b.PY": b"z", "src/[c]*{d}.js": b"const c = 1\n", "src/\xe9t\xe9 1.ts": "é\n".encode(), "node_modules/m.js": b"m",
         "src/bad1.py": b"\xff\xfe", "src/bad2.py": b"ok\xc3(", "src/z.md": b"#", "src/empty.py": b"", "top.java": b"class T {}", "_p/__init__.py": b"", "_p/_q.py": b"q", ".h/x.py": b"h"}


def lay(spark, files):
    root = f"{checkpoint_dir(spark)}/test-tree-{uuid.uuid4().hex}"
    write_tree(spark.createDataFrame(list(files.items()), "path STRING, content BINARY").repartition(3), root)
    return root


def test_bytes_round_trip(spark):
    root = lay(spark, FILES)
    for path, raw in FILES.items():
        assert open(f"{root}/{path}", "rb").read() == raw
    assert sum(len(names) for _, _, names in os.walk(root)) == len(FILES)  # nothing else is left
    write_tree(spark.createDataFrame([("src/a.py", bytearray(b"new")), ("n/null.py", None)], "path STRING, content BINARY"), root)  # a second attempt or a new text
    assert open(f"{root}/src/a.py", "rb").read() == b"new" and open(f"{root}/n/null.py", "rb").read() == b""


@pytest.mark.parametrize("path", ["../x.py", "/x.py", "a//b.py", "a/./b.py"])
def test_paths_stay_below_the_root(spark, path):
    with pytest.raises(Exception, match="not a relative path"):
        lay(spark, {path: b""})


def test_scans_and_hashes(spark):
    root = lay(spark, FILES)
    graph = {r.path: r for r in SF.decode_source(SF.scan_source_files(spark, root)).collect()}
    assert set(graph) == {"src/a.py", "src/[c]*{d}.js", "src/\xe9t\xe9 1.ts", "src/empty.py", "top.java", "_p/__init__.py", "_p/_q.py", ".h/x.py"}
    a = graph["src/a.py"]
    assert a.content == "x = 1\ny = 2\n" and a.raw_hash == hashlib.md5(FILES["src/a.py"]).hexdigest() and a.content_hash == hashlib.md5(b"x = 1\ny = 2\n").hexdigest()
    scoring = {r.path for r in SF.scan_source_files(spark, root, scoring=True).select("path").collect()}
    assert scoring == set(FILES) - {"src/z.md"}


def test_listing_opens_no_file(spark, monkeypatch):
    from codegauge.sources import trees
    root = lay(spark, FILES)
    monkeypatch.setattr(SF, "read_files", lambda *a: pytest.fail("opened"))
    assert SF.source_listing(spark, root).count() == 10 and trees.list_tree(spark, root).count() == len(FILES)


@pytest.mark.parametrize("cap", [1, 2, 3, 4, 6, 7, 50])
def test_cap_counts_decoded_files(spark, cap):
    root = lay(spark, FILES)
    good = sorted(p for p, raw in FILES.items() if p != "src/z.md" and b"\xff" not in raw and b"\xc3(" not in raw)
    got = SF.scan_source_files(spark, root, scoring=True, max_files=cap)
    assert sorted(r.path for r in got.select("path").collect()) == good[:cap]
    assert got.filter(~F.is_valid_utf8(F.col("raw").cast("string"))).count() == 0


def test_cap_without_any_good_file(spark):
    root = lay(spark, {"a.py": b"\xff", "b.py": b"\xff"})
    assert SF.scan_source_files(spark, root, max_files=5).count() == 0
