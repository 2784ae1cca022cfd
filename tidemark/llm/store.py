"""Tables written to the folder that all executors share, to cut lineage.

A lost executor costs only the tasks it was running: what earlier steps wrote
is read again from the shared folder, never recomputed from the input.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs in one JVM, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"
_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset a local default, which only a local master may use."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rsplit("/", 1)[0]
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"{LOCAL_DEFAULT}/{os.getpid()}"
    if not os.path.isdir(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


_left: set[str] = set()  #: folders of this process, removed when it ends


def _remove_left() -> None:
    """A query's last tables are read when its result is, so they can only go with the process."""
    from pyspark import SparkContext

    jvm = SparkContext._jvm
    for root in list(_left) if jvm is not None else ():
        with contextlib.suppress(Exception):  # the JVM may have gone first
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


atexit.register(_remove_left)


class Workspace:
    """One operator run's own folder below the shared one; it is removed when the process ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._serial = 0
        _left.add(self.root)

    def path(self, name: str) -> str:
        self._serial += 1
        return f"{self.root}/{self._serial:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread: the result's plan is a plain scan with a known schema."""
        path = self.path(name)
        # shuffle files go with the write, not with the driver's next garbage collection
        before = self.spark.conf.get(_FREES, "false")
        self.spark.conf.set(_FREES, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_FREES, before)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._workspace_path = path  # for drop(); plain attribute of this Python object
        return saved

    def clear(self, *keep: DataFrame) -> None:
        """Delete all tables of this workspace but those to keep."""
        kept = {getattr(table, "_workspace_path", None) for table in keep}
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return
        for status in files.listStatus(root):
            if not any(path and path.endswith(f"/{status.getPath().getName()}") for path in kept):
                files.delete(status.getPath(), True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            path = getattr(table, "_workspace_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def local_path(uri: str) -> str:
    """A folder that Python on every executor can open (a shared mount); only file: URIs qualify."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    if "://" in uri:
        raise ValueError(f"this operator memory-maps its files and needs a mounted shared folder, not {uri}")
    return uri


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` bears, in any case."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name += "_"
    return name


def merging(side: DataFrame) -> DataFrame:
    """A join's side that grows with the corpus: sort-merge at every size.

    Left to itself Spark broadcasts it, through the driver, until its size
    estimate passes a limit, and then changes the plan.
    """
    return side.hint("merge")


def prepare(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch hands to Python, and let Python workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
