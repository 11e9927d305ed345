"""Counts by minute beside the table stay what its logs say: late batches, batches written again, trims, drops, unpublished ones."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions.times import ArgumentError
from tidelog.operators import buckets, retention
from tidelog.operators.buckets import BucketSpec
from tidelog.operators.filters import LogFilters
from tidelog.operators.retention import Retention
from tidelog.schema import LOGS
from tidelog.sources import batches, logs
from tidelog.sources.batches import Batch
from tidelog.sources.logs import append_logs, read_logs

CASES = [
    (LogFilters(since="2026-08-07T00:00:00Z", until="2026-08-11T00:00:00Z"), BucketSpec("1h")),
    (LogFilters(since="2026-08-08T03:10:20.5Z", until="2026-08-09T13:33:00.000001Z"), BucketSpec("5m", "service")),
    (LogFilters(service="a", since="2026-08-08T03:10:20Z", until="2026-08-08T03:10:40Z"), BucketSpec("1m", "level")),
    (LogFilters(level="warn", since="2026-08-08T03:10:20Z", until="2026-08-08T03:12:00Z"), BucketSpec("1d")),
    (LogFilters(since="2026-08-08T03:10:20Z", until="2026-08-08T03:10:20Z"), BucketSpec("1m")),
    (LogFilters(q="X", attributes={"k": "3"}, since="2026-08-08T00:00:00Z", until="2026-08-10T00:00:00Z"), BucketSpec("1h", "level")),
]


def rows(spark, first, n, step=977):
    """One row every ``step`` seconds from 2026-08-07 on."""
    i = F.col("id")
    made = spark.range(first, first + n).select(
        i, F.timestamp_seconds(F.lit(1786060800) + i * step).alias("timestamp"), F.element_at(F.array(F.lit("info"), F.lit("warn")), (i % 2 + 1).cast("int")).alias("level"),
        F.concat(F.lit("a"), F.when(i % 3 == 0, "b").otherwise("")).alias("service"), F.lit("mx").alias("message"), F.lit("{}").alias("attributes"), F.create_map(F.lit("k"), (i % 5).cast("string")).alias("attributes_normalized"),
    )
    return made.withColumn("day", F.to_date("timestamp")).select(*LOGS.fieldNames())


def check(spark, path):
    for wanted, spec in CASES:
        want = [tuple(r) for r in buckets.bucket_counts(read_logs(spark, path), wanted, spec).collect()]
        assert [tuple(r) for r in buckets.stored_bucket_counts(spark, path, wanted, spec).collect()] == want


def test_counts_follow_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    append_logs(rows(spark, 0, 300), path, "run", 0)
    check(spark, path)
    append_logs(rows(spark, 0, 400, 431), path, "late", 0)
    check(spark, path)
    append_logs(rows(spark, 50, 20), path, "run", 0)
    check(spark, path)
    report = retention.maintain(spark, path, "2026-08-10T03:10:30Z", Retention(2, 1)).first()
    assert report["deletedCutoffRows"] > 0 and report["droppedPartitions"] == ["logs_2026_08_07"]
    check(spark, path)
    waits = batches.begin(spark, path, Batch("waits"))
    logs.write_logs(rows(spark, 100, 30), path, "waits", 0)
    check(spark, path)
    batches.publish(spark, path, waits)
    check(spark, path)
    retention.backfill_normalized(spark, path, str(tmp_path / "u"))
    check(spark, str(tmp_path / "u"))


def test_whole_minutes_need_no_logs(spark, tmp_path):
    path = str(tmp_path / "t")
    append_logs(rows(spark, 0, 300), path, "run", 0)
    whole = buckets.stored_bucket_counts(spark, path, LogFilters(since="2026-08-08T00:00:00Z", until="2026-08-09T00:00:00Z"), BucketSpec("1h"))
    assert whole.inputFiles() and all("/_counts/day=2026-08-08/" in f for f in whole.inputFiles())
    with pytest.raises(ArgumentError, match="until is required"):
        buckets.stored_bucket_counts(spark, path, LogFilters(since="2026-08-08T00:00:00Z"), BucketSpec("1h"))


def test_an_empty_table_has_no_buckets(spark, tmp_path):
    append_logs(rows(spark, 0, 0), str(tmp_path / "t"), "run", 0)
    assert buckets.stored_bucket_counts(spark, str(tmp_path / "t"), *CASES[1]).count() == 0
