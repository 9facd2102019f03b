"""Source trees as tables: a sink that lays files out, a distributed listing, and a reader.

``df.write.format("source_tree").option("root", uri).mode("append").save()`` writes every row's bytes to ``root/path``, each file under a name of
its own attempt first and then moved to its place, so that a second attempt of a task leaves the same tree.

:func:`list_tree` and :func:`read_files` see every file. Spark's own file listing leaves out empty files and names that begin with ``_`` or ``.``, which in
source trees are packages (``__init__.py``) and private modules. All three work through ``pyarrow.fs`` in tasks (local, HDFS, S3 and GCS paths).
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from codegauge.session import materialize

# the writer runs in Python workers: its code travels with it
cloudpickle.register_pickle_by_value(sys.modules[__name__])


LISTED = "path STRING, uri STRING, size_bytes LONG, mtime TIMESTAMP, folder BOOLEAN"
READ_BYTES, READ_FILES = 64 << 20, 2000


def storage(uri: str):
    """File system and path of a folder's URI."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator):
        import uuid
        where, base = storage(self.root)
        made, files, size = set(), 0, 0
        for row in iterator:
            parts = row.path.split("/")
            if not all(parts) or any(p in (".", "..") for p in parts):
                raise ValueError(f"not a relative path below the root: {row.path!r}")
            folder = "/".join([base, *parts[:-1]])
            if folder not in made:
                where.create_dir(folder, recursive=True)
                made.add(folder)
            own = f"{folder}/.{parts[-1]}.{uuid.uuid4().hex}"
            with where.open_output_stream(own, compression=None) as out:
                out.write(bytes(row.content or b""))
            where.move(own, f"{folder}/{parts[-1]}")
            files, size = files + 1, size + len(row.content or b"")
        return Written(files, size)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass  # files of ended tasks stay; a new run writes them again


class TreeSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path STRING, content BINARY"

    def writer(self, schema, overwrite: bool):
        return TreeWriter(self.options["root"])


def write_tree(files: DataFrame, root: str) -> None:
    """Lay ``files`` (path relative to ``root``, content as binary; null: empty) out as a tree. Paths are distinct."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(TreeSink)
    files.select("path", files["content"].cast("binary").alias("content")).write.format("source_tree").option("root", root).mode("append").save()


def _list_batches(root: str):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        where, base = storage(root)
        schema = pa.schema([("path", pa.string()), ("uri", pa.string()), ("size_bytes", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("folder", pa.bool_())])
        for b in batches:
            for rel in b.column(0).to_pylist():
                found = [f for f in where.get_file_info(fs.FileSelector(f"{base}/{rel}" if rel else base)) if f.type in (fs.FileType.File, fs.FileType.Directory)]
                names = [f"{rel}/{f.base_name}" if rel else f.base_name for f in found]
                yield pa.record_batch([pa.array(names, pa.string()), pa.array([f"{root}/{n}" for n in names], pa.string()), pa.array([f.size or 0 for f in found], pa.int64()),
                                       pa.array([f.mtime for f in found], pa.timestamp("us", "UTC")), pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_())], schema=schema)
    return run


def list_tree(spark: SparkSession, root: str, skip: tuple = ()) -> DataFrame:
    """(path, uri, size_bytes, mtime) of every file below ``root``, hidden and empty ones too, without folders named in ``skip``.

    Level by level: the folders of a level are listed by as many tasks as there are shuffle partitions, so no folder but a single one is bound to one task."""
    root = root.rstrip("/")
    folders, files = spark.createDataFrame([("",)], "path STRING"), None
    while True:
        level = materialize(folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_list_batches(root), LISTED), "listing")
        here = level.filter("NOT folder").drop("folder")
        files = here if files is None else files.unionByName(here)
        folders = level.filter("folder").select("path")
        if skip:
            folders = folders.filter(~F.element_at(F.split("path", "/"), -1).isin(*skip))
        if folders.isEmpty():
            return files


def read_files(listing: DataFrame) -> DataFrame:
    """``listing`` with ``raw``, the bytes of every file, read in tasks of about ``READ_BYTES`` bytes or ``READ_FILES`` files."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            at, uris, sizes = 0, b.column("uri").to_pylist(), b.column("size_bytes").to_pylist()
            while at < b.num_rows:
                end, size = at, 0
                while end < b.num_rows and (end == at or size + sizes[end] <= 16 << 20):
                    size += sizes[end]
                    end += 1
                raw = []
                for uri in uris[at:end]:
                    where, path = storage(uri)
                    with where.open_input_file(path) as f:
                        raw.append(f.readall())
                yield pa.RecordBatch.from_arrays([*b.slice(at, end - at).columns, pa.array(raw, pa.binary())], names=[*b.schema.names, "raw"])
                at = end
    total = listing.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size")).first()
    parts = max(1, -(-total["size"] // READ_BYTES), -(-total["n"] // READ_FILES))
    return listing.repartition(parts, "uri").mapInArrow(run, listing.schema.add("raw", "binary"))
