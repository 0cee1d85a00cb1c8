"""Session helpers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, wherever they run; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="spark-")
        copy = shutil.copytree(root, Path(folder, "src", root.name), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(Path(folder, root.name)), "zip", copy.parent))
        _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        if (held := sc._jsc.sc().getCheckpointDir()).isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def files_of(spark: SparkSession, path: str) -> tuple:
    """(name, bytes, time of change) of a table's files: what is kept of a table holds as long as they are the same."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(files))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_TRACKED: list[list[str]] = []


@contextmanager
def tracked() -> Iterator[list[str]]:
    """The paths of tables that are written meanwhile, for one who knows when they are spent."""
    paths: list[str] = []
    _TRACKED.append(paths)
    try:
        yield paths
    finally:
        _TRACKED.remove(paths)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later steps and retries start from that table."""
    path = new_path(df.sparkSession, name)
    for paths in _TRACKED:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_few(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Up to `most` rows, by their count in a written table, are sent to every task; more are shuffled."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


#: Rows of a batch with whole texts. Both the executor and its Python worker hold a batch and copies of it.
TEXT_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs that run meanwhile send no more than so many rows to a Python worker at once; all rows go, in more batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, str(min(int(held), rows) if int(held) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


class Scratch:
    """Tables written on the way to a result, deleted when nothing reads them any more."""

    def __init__(self) -> None:
        self.spark: SparkSession | None = None
        self.paths: list[str] = []

    def _path(self, df: DataFrame, name: str) -> str:
        self.spark = df.sparkSession
        self.paths.append(new_path(self.spark, name))
        return self.paths[-1]

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = self._path(df, name)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """One row for each key, bucketed and sorted: joins on the key don't shuffle it."""
        spark, held = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        one = df.repartition(n, key).dropDuplicates([key])
        one.write.bucketBy(n, key).sortBy(key).option("path", self._path(df, name)).saveAsTable(held)
        found = spark.table(held)
        spark.sql(f"DROP TABLE {held}")  # the entry only: an external table's files stay
        return found

    def clear(self) -> None:
        delete(self.spark, self.paths) if self.paths else None
        self.paths = []
