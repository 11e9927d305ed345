"""Summaries of measurements and of ingest reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = (50, 95, 99)
#: A percentile's guess is off by at most the share 1/GUESS of all ranks; the range that is looked at closely reaches twice as far.
GUESS = 2000


def latency_summary(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``samples, p50, p95, p99, average`` of the values that are not null, at two decimals; null where there are none.

    A percentile is the ``ceil(percent / 100 * n)``-th smallest value, exactly. A first pass guesses each from a small summary, and so
    bounds it; a second counts what is below the bounds, and the values between them one by one. These alone, a few thousandths of all, are sorted.
    """
    keys = [f"g{i}" for i in range(len(by))]

    def joined(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
        """By the keys, null with null."""
        right = right.withColumnsRenamed({k: f"r{k}" for k in keys})
        return left.join(right, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys], F.lit(True)), how).drop(*[f"r{k}" for k in keys])

    shares = [min(1.0, max(0.0, p / 100 + side * 2 / GUESS)) for side in (-1, 1) for p in PERCENTS]
    named = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("v"))
    guessed = named.groupBy(*keys).agg(F.count("v").alias("samples"), F.round(F.avg("v"), 2).alias("average"), F.percentile_approx("v", shares, GUESS).alias("bounds"))

    def place(i: int) -> Column:
        """Where a value is for a percentile: as it is between the bounds, null below them, nowhere above."""
        low, high = F.col("bounds")[i], F.col("bounds")[i + len(PERCENTS)]
        return F.when(F.col("v") <= high, F.struct(F.lit(PERCENTS[i]).alias("percent"), F.when(F.col("v") >= low, F.col("v")).alias("v")))

    known = joined(named.where("v IS NOT NULL"), guessed.select(*keys, "bounds", "samples"))
    near = known.select(*keys, "samples", F.explode(F.array(*[place(i) for i in range(len(PERCENTS))])).alias("x")).where("x IS NOT NULL")
    counts = near.groupBy(*keys, "samples", "x.percent", "x.v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "percent").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.ceil(F.col("samples") * F.col("percent") / 100)
    hit = (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    # A rank that is below its bounds would be a guess that was further off than it can be.
    found = F.when(F.col("v").isNotNull(), F.round("v", 2)).otherwise(F.raise_error(F.lit("a percentile is outside its bounds")).cast("double"))
    picked = counts.withColumn("upto", upto).where(hit).groupBy(*keys).agg(*[F.max(F.when(F.col("percent") == p, found)).alias(f"p{p}") for p in PERCENTS])
    return joined(guessed, picked).select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "samples", *[f"p{p}" for p in PERCENTS], "average")


def status_tally(reports: DataFrame) -> DataFrame:
    """Requests by status."""
    return reports.groupBy("status").agg(F.count("*").alias("requests"))


def ingest_summary(reports: DataFrame, elapsed_seconds: float) -> DataFrame:
    """One row: accepted and rejected entries, failed requests, and accepted entries per second at two decimals (null for no time)."""
    sums = reports.agg(
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"),
        F.count_if(F.col("status") != "ok").alias("failed_requests"),
    )
    return sums.withColumn("logs_per_second", F.round(F.col("accepted") / F.nullif(F.lit(float(elapsed_seconds)), F.lit(0.0)), 2))
