"""Session construction and cluster-shared locations."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults that matter at scale; every one can be overridden by the cluster's own conf.
# Runtime SQL settings every query relies on (also applied to a session the caller built):
# broadcast only what AQE has measured to be small, never on a planner estimate.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
}

_DEFAULTS = {
    **RUNTIME_CONF,
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # long sessions run many jobs: let the cleaner drop old shuffle data regularly
    "spark.cleaner.periodicGC.interval": "2min",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "codegauge") -> SparkSession:
    """Return the active session or build one (local mode only when a master is given)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("CODEGAUGE_DRIVER_MEM", "16g"))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Fill in :data:`RUNTIME_CONF` where the caller set nothing (idempotent, cheap)."""
    for k, v in RUNTIME_CONF.items():
        if not spark.conf._jconf.contains(k):
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may leave it unset
    (tests, a laptop): a scratch folder of one machine would lose rows on a real cluster, so
    any other master without the setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {master}")
        d = tempfile.mkdtemp(prefix="codegauge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, in one folder per application that is deleted when the
    application's file system closes."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/codegauge-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "stage"):
    """Cut the lineage of a frame that several branches read: write it once as a table.

    The table goes under the cluster's shared ``spark.checkpoint.dir`` (never a machine-local
    temp dir on a cluster), so it survives the loss of any executor, and is read back as
    Parquet: one job, columnar, splittable, with statistics for the planner.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def input_stamp(spark: SparkSession, path: str) -> str:
    """Digest of the input's files (path, length, modification time): another one once the input has changed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


_STORED: dict[tuple, str] = {}


@contextmanager
def setting(spark: SparkSession, **conf):
    """Session settings (``a__b`` for ``a.b``) while the block runs."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored_table(spark: SparkSession, inputs: list[str], key: str, build):
    """A derived table that several queries of this application read, written once per state of its inputs.

    The key holds the application and the files of ``inputs`` with their lengths and times, so nothing is reused from another
    run, from other code, or after the input has changed.
    """
    full = (spark.sparkContext.applicationId, key, *[input_stamp(spark, i) for i in inputs])
    if full not in _STORED:
        path = scratch_dir(spark, "stored")
        build().write.parquet(path)
        _STORED[full] = path
    return spark.read.parquet(_STORED[full])


def stored_folder(spark: SparkSession, inputs: list[str], key: str, build) -> str:
    """A folder that several queries of this application read, made once per state of its inputs by ``build(folder)``."""
    full = (spark.sparkContext.applicationId, key, *[input_stamp(spark, i) for i in inputs])
    if full not in _STORED:
        path = scratch_dir(spark, "folder")
        build(path)
        _STORED[full] = path
    return _STORED[full]
