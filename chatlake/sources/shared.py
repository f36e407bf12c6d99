"""New folders that every executor can read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that isn't set, in a temporary folder of a local master.

    A cluster without the setting is an error, as no folder of one machine would do there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, if the session is still there to do it."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone already; the folder's owner cleans up
        pass


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A shared folder that is deleted when the driver's Python ends."""
    path = shared_folder(spark, name)
    atexit.register(drop, spark, path)
    return path
