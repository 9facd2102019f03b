"""The live graph after every batch equals a full rebuild over the last text of every path."""

import datetime as dt
import random
import uuid

import pytest

from codegauge.operators import extract as E
from codegauge.operators import graph as G
from codegauge.session import checkpoint_dir
from codegauge.streaming import live_graph as LG

COLS = "project_id LONG, path STRING, lang STRING, content STRING, size_bytes LONG"
LANGS = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "java": "java"}


def t(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def place(spark):
    state = f"{checkpoint_dir(spark)}/test-live-{uuid.uuid4().hex}"
    LG.create_state(spark, state)
    return state


def apply(spark, state, rows, buckets=4):
    LG.apply_batch(spark.createDataFrame(rows, LG.LIVE_SCHEMA), state, buckets)


def edges(spark, state):
    return sorted((r.project_id, r.src, r.dst, r.occurrences) for r in LG.read_graph(spark, state)["edges"].collect())


def graph(spark, state):
    g = LG.read_graph(spark, state)
    files = sorted((r.project_id, r.path, r.size_bytes, r.line_count, r.file_hash, r.n_entities, r.n_imports, r.risk_tenths) for r in g["files"].collect())
    ents = sorted((r.project_id, r.path, r.seq, r.name, r.line_number) for r in g["entities"].collect())
    imps = sorted((r.project_id, r.path, r.seq, r.specifier) for r in g["imports"].collect())
    return files, ents, imps, edges(spark, state)


def rebuilt(spark, texts):
    rows = [(p, path, LANGS[path.rsplit(".", 1)[1]], c, len(c.encode())) for (p, path), c in texts.items()]
    f = spark.createDataFrame(rows, COLS)
    ext = E.analyze_files(f).cache()
    nodes = G.file_nodes(f)
    risk = G.risk_scores(nodes, E.entities(ext), E.imports(ext))
    e = G.import_edges(G.resolve_imports(E.imports(ext), f), nodes)
    return (sorted((r.project_id, r.path, r.size_bytes, r.line_count, r.file_hash, r.n_entities, r.n_imports, r.risk_tenths) for r in risk.collect()),
            sorted((r.project_id, r.path, r.seq, r.name, r.line_number) for r in E.entities(ext).collect()),
            sorted((r.project_id, r.path, r.seq, r.specifier) for r in E.imports(ext).collect()),
            sorted((r.project_id, r.src, r.dst, r.occurrences) for r in e.collect()))


def test_untouched_importers_follow(spark):
    state = place(spark)
    imp = 'import u from "./u"\nimport v from "./u.css"\n'
    apply(spark, state, [(1, "src/a.js", None, "created", t(0), 1, imp), (1, "src/u.ts", None, "created", t(0), 2, ""), (2, "src/a.js", None, "created", t(0), 3, imp)])
    assert edges(spark, state) == [(1, "src/a.js", "src/u.ts", 2)]
    apply(spark, state, [(1, "src/u.py", None, "created", t(1), 4, "x = 1"), (2, "src/u.java", None, "created", t(1), 5, "")])
    assert edges(spark, state) == [(1, "src/a.js", "src/u.py", 2), (2, "src/a.js", "src/u.java", 2)]
    apply(spark, state, [(1, "src/u.py", None, "deleted", t(2), 6, None)])
    assert edges(spark, state) == [(1, "src/a.js", "src/u.ts", 2), (2, "src/a.js", "src/u.java", 2)]
    apply(spark, state, [(1, "src/u.ts", "src/w.ts", "moved", t(3), 7, "")])
    assert edges(spark, state) == [(2, "src/a.js", "src/u.java", 2)]
    apply(spark, state, [(1, "src/a.js", None, "modified", t(4), 8, 'import w from "./w"'), (2, "src/a.js", None, "deleted", t(4), 9, None)])
    assert edges(spark, state) == [(1, "src/a.js", "src/w.ts", 1)]
    apply(spark, state, [(1, "src/u.ts", None, "created", t(1), 10, "late"), (1, "src/a.js", None, "modified", t(5), 11, None), (1, "src/a.log", None, "created", t(5), 12, "x")])
    assert edges(spark, state) == [(1, "src/a.js", "src/w.ts", 1)]  # u.ts was moved away later; no text, not watched: no effect


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_equal_rebuild(spark, seed):
    r = random.Random(seed)
    state, texts, order = place(spark), {}, {}
    names = [f"src/{n}.{e}" for n in "abc" for e in ("js", "ts", "py")]
    n = 0
    for _ in range(4):
        rows = []
        for _ in range(9):
            n += 1
            kind, path, p, when = r.choice(["created", "modified", "deleted", "moved"]), r.choice(names), r.choice([1, 2]), t(r.randrange(60))
            dest = r.choice(names) if kind == "moved" else None
            text = None if kind == "deleted" else "".join(f'import {x} from "./{x}"\n' for x in r.sample("abcd", 2)) if not (dest or path).endswith("py") else f"import m{n}\n"
            rows.append((p, path, dest, kind, when, n, text))
            for sub, q, gone in ([(0, path, True), (1, dest, False)] if dest else [(0, path, kind == "deleted")]):
                if (when, n, sub) >= order.get((p, q), (t(-1), 0, 0)):
                    order[p, q] = (when, n, sub)
                    texts.pop((p, q), None)
                    if not gone:
                        texts[p, q] = text
        apply(spark, state, rows)
    assert graph(spark, state) == rebuilt(spark, texts)


def test_batch_that_ran_halfway(spark, monkeypatch):
    """A batch that fails before any of its four writes gives the same state when it runs again."""
    first = [(1, "src/a.js", None, "created", t(0), 1, 'import u from "./u"'), (1, "src/u.ts", None, "created", t(0), 2, ""), (1, "src/b.js", None, "created", t(0), 3, 'import u from "./u"')]
    second = [(1, "src/u.py", None, "created", t(1), 4, "import os"), (1, "src/a.js", None, "modified", t(1), 5, 'import x from "./b"'), (1, "src/u.ts", None, "deleted", t(1), 6, None)]
    real = LG._replace
    for broken in ("imports", "files"):
        state = place(spark)
        apply(spark, state, first)

        def fails(rows, state, name, buckets, broken=broken):
            if name == broken:
                raise OSError("lost")
            real(rows, state, name, buckets)
        monkeypatch.setattr(LG, "_replace", fails)
        with pytest.raises(OSError):
            apply(spark, state, second)
        monkeypatch.setattr(LG, "_replace", real)
        apply(spark, state, second)
        once = graph(spark, state)
        assert once == rebuilt(spark, {(1, "src/a.js"): 'import x from "./b"', (1, "src/b.js"): 'import u from "./u"', (1, "src/u.py"): "import os"})
        apply(spark, state, second)
        assert graph(spark, state) == once


def test_only_touched_buckets_are_written(spark):
    state = place(spark)
    apply(spark, state, [(1, f"src/f{i}.py", None, "created", t(0), i, "x = 1") for i in range(40)], buckets=16)
    files = lambda: {f for r in spark.read.parquet(f"{state}/files").inputFiles() for f in [r]}
    before = files()
    apply(spark, state, [(1, "src/f7.py", None, "modified", t(1), 100, "y = 2")], buckets=16)
    assert len(before - files()) < len(before) / 2


def test_stream_in_two_runs(spark):
    base = f"{checkpoint_dir(spark)}/test-live-{uuid.uuid4().hex}"
    for k, rows in enumerate([[(1, "src/a.js", None, "created", t(0), 1, 'import u from "./u"')], [(1, "src/u.ts", None, "created", t(1), 2, "")]]):
        spark.createDataFrame(rows, LG.LIVE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/src")
        LG.run_graph_stream(spark, f"{base}/src", f"{base}/state", f"{base}/ck", buckets=4)
        assert edges(spark, f"{base}/state") == [(1, "src/a.js", "src/u.ts", 1)] * k
