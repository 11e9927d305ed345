"""Tables that the operators read, and where they store what they need in between (:class:`tidelog.scratch.Scope`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.scratch import Scope

__all__ = ["Scope", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
