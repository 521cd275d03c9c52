"""Session defaults for tests and local runs, and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python line of every expression triples the cost of building them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, app: str = "triagelens", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of the rows that a Python worker is sent at once, about, and Spark's own limit.
BATCH_BYTES, DEFAULT_BATCH_BYTES = 2_000_000, 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in small batches, unless the session has a limit of its own.
    A scored ticket passes several workers, and each task holds some batches for every one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in (str(DEFAULT_BATCH_BYTES), f"{DEFAULT_BATCH_BYTES}b"):
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    It lies under the folder the cluster names in ``spark.checkpoint.dir``.  Where that
    is unset a temporary folder is used, which is only right when everything runs in
    one machine; elsewhere the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "triagelens-scratch")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop_table(spark: SparkSession, path: str) -> None:
    """Drops a scratch table that a run has made and needs no more."""
    files, where = file_system(spark, path)
    files.delete(where, True)
