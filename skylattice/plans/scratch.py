"""Files that queries write before they read them: in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

#: Used only where the session names no checkpoint folder, as in tests on one machine.
LOCAL = "/tmp/checkpoints/skylattice"


def base_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where all run on it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a file, removed when the driver's Python ends."""
    path = f"{base_dir(spark)}/fits-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path.rpartition("/")[0])
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """One folder for this application, by name, removed when the driver's Python ends."""
    path = f"{base_dir(spark)}/fits-{spark.sparkContext.applicationId}-{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: the folder stays for the cluster's own cleaning
        pass
