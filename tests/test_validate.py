import json

import pytest

from tidelog.functions.times import parse_instant
from tidelog.operators import validate

NOW = "2026-08-09T12:00:00Z"
GOOD = {"timestamp": "2026-08-09T11:00:00Z", "level": "info", "service": "api", "message": "ok"}
TS = "timestamp "


def entry(**changes):
    return json.dumps({**GOOD, **changes})


CASES = [
    (json.dumps(GOOD), None),
    ('"text"', "log entry must be an object"),
    ("[1]", "log entry must be an object"),
    ("null", "log entry must be an object"),
    ('{"level":"info"}', TS + "is required and must be a string"),
    (entry(timestamp=None), TS + "is required and must be a string"),
    (entry(timestamp=5), TS + "is required and must be a string"),
    (entry(timestamp="2026-08-09"), TS + "must be a valid ISO 8601 date-time with timezone"),
    (entry(timestamp="2026-08-09T11:00:00"), TS + "must be a valid ISO 8601 date-time with timezone"),
    (entry(timestamp="2026-08-09T11:00:00.1234567Z"), TS + "must be a valid ISO 8601 date-time with timezone"),
    (entry(timestamp="2026-08-09T11:00:00Z\n"), TS + "must be a valid ISO 8601 date-time with timezone"),
    (entry(timestamp="2026-13-09T11:00:00Z"), TS + "contains an invalid month"),
    (entry(timestamp="2026-02-29T11:00:00Z"), TS + "contains an invalid day"),
    (entry(timestamp="2024-02-29T11:00:00Z"), None),
    (entry(timestamp="0000-02-29T11:00:00Z"), None),
    (entry(timestamp="2026-08-00T11:00:00Z"), TS + "contains an invalid day"),
    (entry(timestamp="2026-08-09T24:00:00Z"), TS + "contains an invalid hour"),
    (entry(timestamp="2026-08-09T11:60:00Z"), TS + "contains an invalid minute"),
    (entry(timestamp="2026-08-09T11:00:60Z"), TS + "contains an invalid second"),
    (entry(timestamp="2026-08-09T11:00:00+24:00"), TS + "contains an invalid timezone offset"),
    (entry(timestamp="2026-08-09T11:00:00-01:60"), TS + "contains an invalid timezone offset"),
    (entry(timestamp="2026-08-10T11:58:59.1234+23:59"), None),
    *[(entry(timestamp=f"2026-08-08T11:00:00.5{x}"), None) for x in ("+00:00", "+01:00", "-03:00", "-11:30", "+14:00", "-23:59")],
    (entry(timestamp="2026-08-09T11:06:00-01:00"), TS + "cannot be more than 5 minutes in the future"),
    (entry(timestamp="2026-08-09T12:05:00.000999Z"), None),
    (entry(timestamp="2026-08-09T12:05:00.001Z"), TS + "cannot be more than 5 minutes in the future"),
    (entry(level="critical"), "invalid level: 'critical'"),
    (entry(level=3), "level must be debug, info, warn, or error"),
    (entry(service="  ﻿ "), "service must be a non-empty string"),
    (entry(service=1), "service must be a non-empty string"),
    (entry(message=""), "message must be a non-empty string"),
    (entry(attributes=None), "attributes must be a flat object"),
    (entry(attributes=[1]), "attributes must be a flat object"),
    (entry(attributes={}), None),
    (entry(attributes={"a": "x", "b": 1.5, "c": True, "d": 3}), None),
    (entry(attributes={"user": {"id": 42}}), "invalid attribute 'user': values must be strings, numbers, or booleans"),
    (entry(attributes={"z": [1], "a": None}), "invalid attribute 'z': values must be strings, numbers, or booleans"),
    (entry(attributes={"z": [1], "7": None}), "invalid attribute '7': values must be strings, numbers, or booleans"),
    (entry()[:-1] + ',"attributes":{"n":1e999}}', "invalid attribute 'n': values must be strings, numbers, or booleans"),
    (entry()[:-1] + ',"attributes":{"n":null,"n":1}}', None),
]


@pytest.fixture(scope="module")
def checked(spark):
    body = '{"logs":[' + ",".join(x for x, _ in CASES) + "]}"
    parsed = validate.requests(spark.createDataFrame([("r", body)], "request_id string, body string"))
    return validate.validated(validate.with_reasons(validate.entries(parsed), NOW)).cache()


def test_first_failing_rule_is_the_reason(checked):
    found = {r["index"]: r["reason"] for r in checked.select("index", "reason").collect()}
    assert [found[i] for i in range(len(CASES))] == [reason for _, reason in CASES]


def test_instants_of_all_years_and_offsets(checked):
    found = {r["index"]: r["t"] for r in validate.accepted(checked).selectExpr("index", "unix_micros(timestamp) AS t").collect()}
    for i, (text, reason) in enumerate(CASES):
        if reason is None:
            assert found[i] == parse_instant(json.loads(text)["timestamp"], "x").micros


def test_every_entry_is_accepted_or_rejected(checked):
    accepted = {r["index"] for r in validate.accepted(checked).select("index").collect()}
    rejected = [r["index"] for r in validate.rejected(checked).collect()]
    assert accepted | set(rejected) == set(range(len(CASES))) and not accepted & set(rejected)
    assert rejected == sorted(rejected)


def test_requests_are_refused_as_a_whole(spark):
    bodies = [("a", '{"logs": ['), ("b", "[]"), ("c", '{"logs":"x"}'), ("d", '{"logs":[]}'), ("e", "{}"), ("f", '{"logs":[1]}'), ("g", None)]
    parsed = validate.requests(spark.createDataFrame(bodies, "request_id string, body string"))
    found = {r["request_id"]: r["refused"] for r in parsed.select("request_id", "refused").collect()}
    assert found == {
        "a": "request body must be valid JSON",
        "b": "request body must be an object",
        "c": "logs must be an array",
        "d": "logs must contain at least one entry",
        "e": "logs must be an array",
        "f": None,
        "g": "request body must be valid JSON",
    }
    report = {r["request_id"]: (r["status"], r["accepted"], r["rejected"]) for r in validate.reports(validate.with_reasons(validate.entries(parsed, refused=True), NOW)).collect()}
    assert report["f"] == ("all_invalid", 0, 1) and report["a"] == ("bad_request", 0, 0) and len(report) == 7


def test_values_keep_microseconds_text_and_types(spark):
    text = "مرحبا \U0001f600"
    body = json.dumps({"logs": [{**GOOD, "timestamp": "2026-08-09T12:34:56.123456+03:00", "message": text, "attributes": {"retries": 3, "premium": True, "__proto__": "x"}}]}, ensure_ascii=False)
    parsed = validate.requests(spark.createDataFrame([("r", body)], "request_id string, body string"))
    row = validate.accepted(validate.validated(validate.with_reasons(validate.entries(parsed), NOW))).selectExpr("unix_micros(timestamp) AS t", "*").first()
    assert row["t"] == 1786268096123456 and row["message"] == text and str(row["day"]) == "2026-08-09"
    assert json.loads(row["attributes"]) == {"retries": 3, "premium": True, "__proto__": "x"}
    assert row["attributes_normalized"] == {"retries": "3", "premium": "true", "__proto__": "x"}


@pytest.mark.parametrize(
    ("number", "text"),
    [("3", "3"), ("3.0", "3"), ("1.50", "1.5"), ("-0.0", "0"), ("1e3", "1000"), ("1e21", "1e+21"), ("1.5e22", "1.5e+22"), ("1e-6", "0.000001"), ("1.5e-7", "1.5e-7"), ("123456789012345678", "123456789012345678"), ("1.25e20", "125000000000000000000")],
)
def test_numbers_as_text(spark, number, text):
    from pyspark.sql import functions as F

    from tidelog.functions.attributes import normalized

    assert spark.range(1).select(normalized(F.lit(f'{{"n":{number}}}')).alias("m")).first()["m"] == {"n": text}


def test_normalized_is_null_for_no_object(spark):
    from pyspark.sql import functions as F

    from tidelog.functions.attributes import normalized

    row = spark.range(1).select(normalized(F.lit("[1]")).alias("a"), normalized(F.lit("{")).alias("b"), normalized(F.lit("{}")).alias("c"), normalized(F.lit(None).cast("string")).alias("d")).first()
    assert tuple(row) == (None, None, {}, None)
