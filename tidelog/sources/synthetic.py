"""Synthetic logs: each row is a pure function of its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.times import parse_instant

# Fixed values.
SERVICES = ("checkout", "auth", "api", "search", "notifications")
MESSAGES = ("payment declined for customer", "request completed successfully", "slow request detected", "user login successful", "database operation completed")
LEVELS = ("debug", "info", "warn", "error")


def _turn(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def synthetic_logs(numbers: DataFrame, base: str, run_id: str) -> DataFrame:
    """The rows of ``numbers(id)``, counted from 0; an instant is up to an hour before ``base``. Ids count from 1."""
    i = F.col("id")
    even = F.pmod(i, F.lit(2)) == 0
    ts = F.timestamp_micros(F.lit(parse_instant(base, "base").micros) - F.pmod(i, F.lit(3600)) * F.lit(1_000_000))
    attributes = F.struct(F.lit(run_id).alias("run_id"), F.when(even, "eu-west").otherwise("us-east").alias("region"), F.pmod(i, F.lit(5)).alias("retries"), even.alias("premium"))
    return numbers.select(
        (i + 1).alias("id"),
        ts.alias("timestamp"),
        _turn(LEVELS, i).alias("level"),
        _turn(SERVICES, i).alias("service"),
        _turn(MESSAGES, i).alias("message"),
        F.to_json(attributes).alias("attributes"),
    )


def synthetic(spark: SparkSession, rows: int, base: str, run_id: str = "run") -> DataFrame:
    return synthetic_logs(spark.range(rows), base, run_id)
