"""The folder for intermediate files that driver and executors share, and what calls keep there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all runs on one machine, as in tests, a new local one is set."""
    there = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="tidelog-shared-")
        spark.conf.set(SETTING, there)
    return there.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder; what is there when the driver ends is deleted."""
    folder = f"{shared_dir(spark)}/tidelog/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{folder}/{name}"


class Scope:
    """What one call stores, always in the shared folder. Operators take one; whoever gave it releases it, alone, when the results are written.

    ``with Scope(spark) as scope`` releases it at the end. What no one releases is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: list[tuple[DataFrame | None, str, str | None]] = []

    @classmethod
    def of(cls, scope: Scope | None, df: DataFrame) -> Scope:
        return scope or cls(df.sparkSession)

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def stored(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """Write ``df`` to a new place in the shared folder and read it back: its lineage ends there.

        With ``free``, the shuffle files of the write are deleted as it ends, not when the driver next collects garbage.
        """
        path, before = new_path(self.spark, name), self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true" if free else before)
        self._held.append((None, path, None))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        found = self.spark.read.schema(df.schema).parquet(path)
        self._held[-1] = (found, path, None)
        return found

    def place(self, name: str) -> str:
        """A new place in the shared folder for what others write."""
        path = new_path(self.spark, name)
        self._held.append((None, path, None))
        return path

    def bucketed(self, df: DataFrame, buckets: int, column: str, name: str) -> DataFrame:
        """Write ``df`` to a new place in the shared folder, as a table that is bucketed by ``column``, and read it back."""
        path, table = new_path(self.spark, name), f"tidelog_{name}_{uuid.uuid4().hex}"
        self._held.append((None, path, table))
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(table)
        found = self.spark.table(table)
        self._held[-1] = (found, path, table)
        return found

    def _delete(self, path: str, table: str | None) -> None:
        if table:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.delete(place, True)
        files.cancelDeleteOnExit(place)

    def drop(self, *dfs: DataFrame) -> None:
        """Delete what was stored as ``dfs``, which this scope has returned; others are left alone."""
        for held in [x for x in self._held if any(x[0] is df for df in dfs)]:
            self._delete(*held[1:])
            self._held = [x for x in self._held if x is not held]

    def release(self) -> None:
        """Delete all that this scope has stored. DataFrames that still read it fail: call it when their results are written."""
        while self._held:
            self._delete(*self._held.pop()[1:])
