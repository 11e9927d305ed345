"""Counts of logs in buckets of time."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.times import BUCKETS, DAY_MICROS, EPOCH, ArgumentError, Instant, bucket_start, seconds_text
from tidelog.operators.filters import LogFilters, instant, look_back, where
from tidelog.sources import batches
from tidelog.sources.logs import MINUTE, list_days, read_counts, read_logs

#: The largest count that a reader of JSON numbers gets exactly.
MOST = (1 << 53) - 1


@dataclass(frozen=True)
class BucketSpec:
    """Width of the buckets, and whether they are split by service or level."""

    bucket: str | None
    group_by: str | None = None

    def __post_init__(self) -> None:
        if self.bucket is None:
            raise ArgumentError("bucket is required")
        if self.bucket not in BUCKETS:
            raise ArgumentError(f"invalid bucket: '{self.bucket}'")
        if self.group_by not in (None, "service", "level"):
            raise ArgumentError(f"invalid group_by: '{self.group_by}'")


def exact(count: Column) -> Column:
    """A count, or an error if it is too large to be exact."""
    return F.when(count <= MOST, count).otherwise(F.raise_error(F.lit("count exceeds 9007199254740991")).cast("long"))


def _counted(found: DataFrame, spec: BucketSpec) -> DataFrame:
    group = [F.col(spec.group_by).alias("group")] if spec.group_by else []
    return _shown(found.groupBy(bucket_start(F.col("timestamp"), spec.bucket).alias("at"), *group).agg(F.count("*").alias("n")), group)


def _shown(counts: DataFrame, group: list[Column]) -> DataFrame:
    shown = F.col("group") if group else F.lit(None).cast("string").alias("group")
    out = counts.orderBy("at", *([F.asc_nulls_first("group")] if group else []))
    return out.select(seconds_text(F.timestamp_micros("at")).alias("start"), shown, exact(F.col("n")).alias("count"))


def bucket_counts(logs: DataFrame, filters: LogFilters, spec: BucketSpec) -> DataFrame:
    """``(start, group, count)`` of the filtered logs, by start and group; empty buckets are left out. ``since`` and ``until`` are required."""
    for name in ("since", "until"):
        if getattr(filters, name) is None:
            raise ArgumentError(f"{name} is required")
    return _counted(where(logs, filters), spec)


def stored_bucket_counts(spark: SparkSession, path: str, filters: LogFilters, spec: BucketSpec) -> DataFrame:
    """:func:`bucket_counts` of the table at ``path``, from its counts by minute; only what sticks out of whole minutes at either end is counted from logs.

    Filters on attributes or messages need the logs themselves.
    """
    for name in ("since", "until"):
        if getattr(filters, name) is None:
            raise ArgumentError(f"{name} is required")
    since, until = filters.since_at.micros, filters.until_at.micros
    noted = batches.noted(spark, path)
    between = lambda a, b: [d for d in list_days(spark, path) if a // DAY_MICROS <= (d - EPOCH.date()).days <= (b - 1) // DAY_MICROS] if a < b else []
    if filters.attributes or filters.q is not None:
        return bucket_counts(read_logs(spark, path, between(since, until), noted), filters, spec)
    first, last = -(-since // MINUTE) * MINUTE, until // MINUTE * MINUTE
    group = [F.col(spec.group_by).alias("group")] if spec.group_by else []
    same = lambda rows: where(rows, replace(filters, since=None, until=None))
    at = lambda ts: bucket_start(ts, spec.bucket).alias("at")
    minutes = same(read_counts(spark, path, between(first, last), noted)).where((F.col("minute") >= first) & (F.col("minute") < last))
    counts = minutes.groupBy(at(F.timestamp_micros("minute")), *group).agg(F.sum("n").alias("n"))
    for a, b in {(since, min(first, until)), (max(last, since), until)}:
        if a < b:
            ends = read_logs(spark, path, between(a, b), noted)
            kind = ends.schema["timestamp"].dataType
            ends = same(ends).where((F.col("timestamp") >= instant(Instant(a), kind)) & (F.col("timestamp") < instant(Instant(b), kind)))
            counts = counts.union(ends.groupBy(at(F.col("timestamp")), *group).agg(F.count("*").alias("n")))
    return _shown(counts.groupBy("at", *(["group"] if group else [])).agg(F.sum("n").alias("n")), group)


def recent_bucket_counts(logs: DataFrame, now: str, hours: int = 2, spec: BucketSpec = BucketSpec("5m", "service")) -> DataFrame:
    """The same over a look-back range without an upper bound."""
    return _counted(look_back(logs, now, hours), spec)


def row_count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("count"))
