"""Columns of stored logs and of what ingest reports."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = ("debug", "info", "warn", "error")

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("attributes_normalized", T.MapType(T.StringType(), T.StringType())),
        T.StructField("day", T.DateType()),
    ]
)
#: Logs as the table source returns them: with the partitions that make a replayed batch replace itself.
STORED = T.StructType([*LOGS.fields, T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType())])
REJECTED = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("reason", T.StringType()), T.StructField("raw", T.StringType())])
