"""The file system that a path is on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def files_at(spark: SparkSession, path: str):
    """The file system, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place
