"""Files of request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def request_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(request_id, body)``, one request a line, numbered by place in the input."""
    lines = spark.read.text(path)
    return lines.select(F.format_string("%020d", F.monotonically_increasing_id()).alias("request_id"), F.col("value").alias("body"))


def request_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(request_id, body)``, one request a file, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("request_id"), F.col("value").alias("body"))
