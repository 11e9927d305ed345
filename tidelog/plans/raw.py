"""Request bodies made from the event table, some of their entries broken by rule, for the ingest queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.times import micros_text
from tidelog.sources.logs import from_events

#: Entries of a request, and every how many an entry is written in one of the ways below.
PER_REQUEST, EVERY = 100, 20
NOW = "2024-06-01T00:00:00Z"


def _object(ts: str = "ts", level: str = "lv", service: str = "sv", message: str = "ms", attributes: str | None = "at") -> str:
    parts = [f"'\"{k}\":'" + f" || {v}" for k, v in (("timestamp", ts), ("level", level), ("service", service), ("message", message), ("attributes", attributes)) if v]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


#: The text of entry number k of EVERY, as SQL over JSON texts ts, lv, sv, ms and at; others are as they are.
WRITTEN = {
    0: "'\"text\"'",
    1: _object(ts="'null'"),
    2: _object(ts="'\"2024-01-01 00:00:00\"'"),
    3: _object(ts="'\"2024-13-01T00:00:00Z\"'"),
    4: _object(ts="'\"2023-02-29T00:00:00Z\"'"),
    5: _object(ts="'\"2024-01-01T24:00:00Z\"'"),
    6: _object(ts="'\"2024-01-01T00:00:00+24:00\"'"),
    7: _object(ts="'\"2999-01-01T00:00:00Z\"'"),
    8: _object(level="'\"critical\"'"),
    9: _object(level="'3'"),
    10: _object(service="'\"  \"'"),
    11: _object(message="'null'"),
    12: _object(attributes="'[1]'"),
    13: _object(attributes="'{\"z\":1,\"a\":{\"b\":1},\"c\":null}'"),
    14: _object(attributes=None),
    # The same instant, written with an offset.
    15: _object(ts="east"),
    16: _object(ts="west"),
    17: _object(ts="far"),
}
OFFSETS = {"east": "+03:00", "west": "-11:30", "far": "+23:59"}
REASONS = {
    0: "log entry must be an object",
    1: "timestamp is required and must be a string",
    2: "timestamp must be a valid ISO 8601 date-time with timezone",
    3: "timestamp contains an invalid month",
    4: "timestamp contains an invalid day",
    5: "timestamp contains an invalid hour",
    6: "timestamp contains an invalid timezone offset",
    7: "timestamp cannot be more than 5 minutes in the future",
    8: "invalid level: 'critical'",
    9: "level must be debug, info, warn, or error",
    10: "service must be a non-empty string",
    11: "message must be a non-empty string",
    12: "attributes must be a flat object",
    13: "invalid attribute 'a': values must be strings, numbers, or booleans",
}


def bodies(events: DataFrame) -> DataFrame:
    """``(request_id, body)`` of the events by id, PER_REQUEST to a request."""
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))

    def local(offset: str) -> Column:
        minutes = (int(offset[1:3]) * 60 + int(offset[4:])) * (1 if offset[0] == "+" else -1)
        there = F.col("timestamp") + F.expr(f"INTERVAL '{minutes}' MINUTE")
        return quote(F.concat(F.substring(micros_text(there), 1, 26), F.lit(offset)))

    logs = from_events(events).select(
        (F.col("id") - 1).alias("n"),
        quote(micros_text(F.col("timestamp"))).alias("ts"),
        *[local(offset).alias(name) for name, offset in OFFSETS.items()],
        quote(F.col("level")).alias("lv"),
        quote(F.col("service")).alias("sv"),
        quote(F.col("message")).alias("ms"),
        F.col("attributes").alias("at"),
    )
    cases = " ".join(f"WHEN {k} THEN {text}" for k, text in WRITTEN.items())
    entry = F.expr(f"CASE n % {EVERY} {cases} ELSE {_object()} END")
    number = F.format_string("%012d", F.floor(F.col("n") / PER_REQUEST))
    # A request has PER_REQUEST entries at most, so its list is bounded.
    lists = logs.select(number.alias("request_id"), F.struct("n", entry.alias("e")).alias("x")).groupBy("request_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return lists.select("request_id", F.concat(F.lit('{"logs":['), F.array_join("xs.e", ","), F.lit("]}")).alias("body"))
