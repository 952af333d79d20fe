"""Session helpers.

The library never owns the cluster configuration: every operator takes the
caller's ``SparkSession``.  ``get_session`` exists for tests, the bench and
local runs; ``checkpoint_dir`` reads the shared checkpoint folder the cluster
names and only invents a local one when none is configured (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that the operators rely on or that make local runs comparable with
# the DuckDB oracle.  On a cluster these come from the deployment instead.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # GBK input (SRC2) needs the legacy charset list in Spark 4.
    "spark.sql.legacy.javaCharsets": "true",
    # LLM and embedding maps have side effects: never race duplicate tasks.
    "spark.speculation": "false",
    # Capturing the Python call site of every Column call costs several JVM
    # round trips per call while a plan is built; it only decorates errors.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "promptframe", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(LOCAL_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder; executors can be lost at any time and a checkpoint there survives.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store): lineage cuts "
                               "and intermediate tables must survive the loss of an executor")
        # Local runs and tests only: there is no other machine to share with.
        configured = tempfile.mkdtemp(prefix="promptframe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder.

    Used for data Spark writes between steps (CSV / xlsx round trips, vector
    table versions, streaming state).  Never a machine-local folder on a
    cluster, because the checkpoint folder is the shared one.
    """
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def fs_path(path: str) -> str:
    """Strip a ``file:`` scheme for Python-side file access inside tasks."""
    return path[5:] if path.startswith("file:") else path


def table(spark: SparkSession, sf_dir: str, name: str):
    """Read one of the input tables (one parquet file each)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``promptframe`` importable in Python workers (``--py-files`` at run time).

    Operators that run Python in tasks (LLM, embedding, file codecs) call
    this once per application; the package is zipped on the driver and added
    with ``addPyFile`` so executors fetch it from the driver.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    # Zipped on the driver; addPyFile has the driver serve it to the executors, so no shared folder
    # is needed and a remote checkpoint folder (hdfs://, s3a://) makes no difference.
    out = os.path.join(tempfile.mkdtemp(prefix="promptframe-py-"), "promptframe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def spread(df, min_partitions: int | None = None):
    """Repartition only when the input has fewer partitions than the cluster has cores.

    Python-heavy maps (model calls, embedding) run one task per input
    partition.  A single-file input may arrive as one partition; at scale the
    scan already has thousands and this is a no-op (no extra shuffle).
    """
    if df.isStreaming:
        return df
    sc = df.sparkSession.sparkContext
    want = min_partitions or sc.defaultParallelism
    # Decided from the plan's file list first (no job): reading at least one
    # file per core means enough splits, the usual case on a cluster.  Only a
    # small input is asked for its partition count, which under adaptive
    # execution runs any shuffle below it once more.
    if len(df.inputFiles()) >= want:
        return df
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
