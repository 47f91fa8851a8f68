"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a folder made here; a cluster's can't."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ordkv-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, or the folder be gone
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def removed_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(remove, spark, path)
