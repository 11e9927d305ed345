"""Attributes with a column of their own: the same rows, from less of the files."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import filters, paging, retention
from tidelog.operators.filters import LogFilters
from tidelog.operators.retention import Retention
from tidelog.schema import LOGS
from tidelog.sources.logs import append_logs, promote, read_logs

KEYS = ["user id", "a,b={c}", "missing"]


def rows(spark, first, n):
    i = F.col("id")
    text = F.to_json(F.struct(i.cast("string").alias(KEYS[0]), (i % 3).cast("string").alias(KEYS[1]), F.lit("z").alias("other")))
    made = spark.range(first, first + n, numPartitions=2).select(i, F.timestamp_seconds(1786060800 + i * 60).alias("timestamp"), F.lit("info").alias("level"), F.lit("api").alias("service"), F.lit("m").alias("message"), text.alias("attributes"))
    made = made.withColumn("attributes_normalized", F.from_json("attributes", "map<string,string>"))
    return made.withColumn("day", F.to_date("timestamp")).select(*LOGS.fieldNames())


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "t")
    promote(spark, path, KEYS)
    for b in range(3):
        append_logs(rows(spark, b * 500, 500), path, "run", b)
    return path


def scanned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_filters_read_the_column_alone(spark, path):
    logs = read_logs(spark, path)
    for wanted in ({KEYS[0]: "700"}, {KEYS[1]: "2", "other": "z"}, {KEYS[2]: "1"}, {KEYS[0]: "700", KEYS[1]: "1"}):
        plain = logs
        for key, value in wanted.items():
            plain = plain.where(F.col("attributes_normalized")[F.lit(key)] == value)
        found = filters.where(logs, LogFilters(attributes=wanted))
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in plain.collect())
        assert [r["id"] for r in paging.stored_page(spark, path, LogFilters(attributes=wanted)).collect()] == [r["id"] for r in paging.page(plain).collect()]
    one = filters.where(logs, LogFilters(attributes={KEYS[0]: "700"})).select("id")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(attribute_0,700)" in plan and "ReadSchema: struct<id:bigint,attribute_0:string>" in plan
    # Two of three batches can't have it, and are not read.
    assert scanned(one) <= 500 and [r["id"] for r in one.collect()] == [700]


def test_trims_and_backfills_keep_columns(spark, path, tmp_path):
    assert retention.trim_cutoff_day(spark, path, retention.cutoff("2026-08-09T05:00:30Z", Retention(2, 1))) == 301
    again = str(tmp_path / "u")
    retention.backfill_normalized(spark, path, again, keys=("other", KEYS[0]))
    for place in (path, again):
        found = filters.where(read_logs(spark, place), LogFilters(attributes={KEYS[0]: "302"}))
        assert [r["id"] for r in found.collect()] == [302] and "attribute_" in found._jdf.queryExecution().optimizedPlan().toString()
        assert filters.where(read_logs(spark, place), LogFilters(attributes={"other": "z"})).count() == 1199
    with pytest.raises(ValueError):
        promote(spark, path, ["x"])
