"""Shared working storage: where intermediate tables go, so that every executor can read them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
#: Folders of sessions that name none, by application.
_own: dict[str, str] = {}
#: Applications that have this package's archive.
_shipped: set[str] = set()

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset and Spark runs in
    this process alone. On a cluster it has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not _one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="siftlake-")
        _own[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def _one_process(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: from where the driver has it if they run beside it, else from an archive that
    Spark sends to each executor. They get small Arrow batches, unless the application was started with a size of its own:
    texts take several times their size in a worker."""
    context = spark.sparkContext
    if not context.getConf().contains(BATCH_BYTES[0]):
        spark.conf.set(*BATCH_BYTES)
    if _one_process(spark):
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if PACKAGE_ROOT not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])
    elif context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = os.path.dirname(os.path.abspath(__file__))
        name = f"siftlake-{uuid.uuid4().hex}.zip"
        target = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        files = target.getFileSystem(context._jsc.hadoopConfiguration())
        with tempfile.TemporaryDirectory(prefix="siftlake-") as folder:
            archive = os.path.join(folder, name)
            with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
                for at, _, names in os.walk(package):
                    for file in names:
                        if file.endswith(".py"):
                            path = os.path.join(at, file)
                            out.write(path, os.path.relpath(path, os.path.dirname(package)))
            files.copyFromLocalFile(context._jvm.org.apache.hadoop.fs.Path(f"file://{archive}"), target)
        files.deleteOnExit(target)
        context.addPyFile(target.toString())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a dataset folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """A folder of intermediate Parquet tables in the shared storage.

    A table that is written and read again cuts the lineage: a lost executor costs the tasks of one step at most.
    The folder goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        ship_package(spark)
        files, path = self._files(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read from the files."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def names(self) -> list[str]:
        """The tables that there are."""
        files, path = self._files(self.root)
        return [f.getPath().getName() for f in files.listStatus(path)]

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            files, path = self._files(self.path(name))
            files.delete(path, True)


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", max_rows: int = 20_000) -> DataFrame:
    """Join a dimension: broadcast it if a count shows that it has at most max_rows rows, else an ordinary join.

    The ordinary join leaves skewed keys to AQE's split of skewed sort-merge partitions.
    """
    small = right.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(right) if small else right, on, how)
