"""Small derived tables that several parts of a plan read, written once.

A plan that reads one derived table in many places is planned, and often run, as
many times.  ``settled`` writes the table as Parquet below the session's shared
folder and reads it back: what follows is a columnar scan with pruned columns,
pushed filters and a known size; a lost executor reads it again from there.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs in one JVM, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"


_folders: set[str] = set()  #: folders that this process wrote, which no other process reads


def _remove() -> None:
    jvm = SparkContext._jvm
    for folder in list(_folders) if jvm is not None else ():
        with contextlib.suppress(Exception):  # the JVM may have gone first
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


atexit.register(_remove)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local default stands in only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or (spark.sparkContext.getCheckpointDir() or "").rpartition("/")[0]
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{LOCAL_DEFAULT}/settled-{os.getpid()}"


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, for files that are written and scanned again; it goes with the process."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.add(folder)
    return folder


def settled(table: DataFrame) -> DataFrame:
    """``table`` written to the shared folder and read back; the files go with the process."""
    folder = scratch(table.sparkSession, "settled")
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)
