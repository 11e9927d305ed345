import base64
import json
from datetime import datetime, timezone

import pytest

from tidelog.functions.times import ArgumentError, parse_instant
from tidelog.operators import buckets, filters, paging, summary
from tidelog.operators.buckets import BucketSpec
from tidelog.operators.filters import LogFilters
from tidelog.operators.paging import PageSpec
from tidelog.schema import LOGS
from tidelog.sources.synthetic import synthetic


def log(i, ts, level="info", service="api", message="m", **attributes):
    at = datetime.fromisoformat(ts).replace(tzinfo=timezone.utc)
    text = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in attributes.items()}
    return i, at, level, service, message, json.dumps(attributes), text, at.date()


@pytest.fixture(scope="module")
def logs(spark):
    rows = [
        log(1, "2026-08-09T12:00:00", "error", "checkout", "Payment DECLINED now", region="eu-west", retries=3, premium=True),
        log(2, "2026-08-09T12:02:00", "error", "checkout", "payment declined", region="us-east", retries=3),
        log(3, "2026-08-09T12:01:00.123456", "info", "api", r"literal 100%_\match value"),
        log(4, "2026-08-09T12:01:00.123456", "info", "api", "literal 100XYZmatch value"),
        log(5, "2026-08-10T00:00:00", "warn", "auth", "next day", region="eu-west"),
    ]
    return spark.createDataFrame(rows, LOGS)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("wanted", "found"),
    [
        (LogFilters(), [1, 2, 3, 4, 5]),
        (LogFilters(service="checkout"), [1, 2]),
        (LogFilters(service="Checkout"), []),
        (LogFilters(level="info"), [3, 4]),
        (LogFilters(since="2026-08-09T12:02:00Z"), [2, 5]),
        (LogFilters(until="2026-08-09T12:01:00.123456Z"), [1]),
        (LogFilters(since="2026-08-09T15:00:00+03:00", until="2026-08-09T12:01:00.123457Z"), [1, 3, 4]),
        (LogFilters(since="2026-08-09T12:00:00Z", until="2026-08-09T12:00:00Z"), []),
        (LogFilters(q="payment declined"), [1, 2]),
        (LogFilters(q=r"100%_\MATCH"), [3]),
        (LogFilters(attributes={"retries": "3"}), [1, 2]),
        (LogFilters(attributes={"retries": "3", "premium": "true"}), [1]),
        (LogFilters(attributes={"missing": "1"}), []),
        (LogFilters("checkout", "error", "2026-08-09T00:00:00Z", "2026-08-10T00:00:00Z", {"region": "eu-west"}, "DECLINED"), [1]),
        (LogFilters(service="x' OR '1'='1"), []),
    ],
)
def test_filters(logs, wanted, found):
    assert ids(filters.where(logs, wanted)) == found


def test_bounds_prune_days_and_reach_the_scan(spark, logs, tmp_path):
    from tidelog.sources.logs import append_logs, read_logs

    append_logs(logs, str(tmp_path / "t"), "run")
    found = filters.where(read_logs(spark, str(tmp_path / "t")), LogFilters(service="auth", since="2026-08-10T00:00:00Z"))
    plan = found._jdf.queryExecution().toString()
    assert ids(found) == [5]
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(service,auth)" in plan and "GreaterThanOrEqual(timestamp" in plan


@pytest.mark.parametrize(
    ("make", "reason"),
    [
        (lambda: LogFilters(service=" "), "service must be a non-empty string"),
        (lambda: LogFilters(level="INFO"), "invalid level: 'INFO'"),
        (lambda: LogFilters(q="\t"), "q must be a non-empty string"),
        (lambda: LogFilters(since="2026-02-31T00:00:00Z"), "since contains an invalid day"),
        (lambda: LogFilters(until="soon"), "until must be a valid ISO 8601 date-time with timezone"),
        (lambda: LogFilters(since="2026-08-09T12:00:00.001Z", until="2026-08-09T12:00:00Z"), "since must not be after until"),
        (lambda: LogFilters(attributes=(("a", "1"), ("a", "2"))), "duplicate attribute filter: 'a'"),
        (lambda: LogFilters(attributes=((" ", "1"),)), "attribute filter key must not be empty"),
        (lambda: PageSpec(0), "limit must be an integer between 1 and 1000"),
        (lambda: PageSpec(1001), "limit must be an integer between 1 and 1000"),
        (lambda: PageSpec(2.5), "limit must be an integer between 1 and 1000"),
        (lambda: BucketSpec("2m"), "invalid bucket: '2m'"),
        (lambda: BucketSpec(None), "bucket is required"),
        (lambda: BucketSpec("1m", "message"), "invalid group_by: 'message'"),
    ],
)
def test_refused_arguments(make, reason):
    with pytest.raises(ArgumentError, match="^" + __import__("re").escape(reason) + "$"):
        make()


def test_times_within_a_millisecond_are_not_after_each_other():
    LogFilters(since="2026-08-09T12:00:00.000999Z", until="2026-08-09T12:00:00.000001Z")
    assert parse_instant("0000-02-29T00:00:00Z", "x").micros == -62162121600000000


def test_pages_are_a_partition_of_the_sorted_rows(spark):
    rows = spark.createDataFrame([log(i, "2026-08-09T12:00:00.123456") for i in range(1, 6)] + [log(6, "2026-08-09T11:00:00")], LOGS)
    seen, after = [], None
    while True:
        page, after = paging.read_page(rows, LogFilters(), PageSpec(2, after))
        seen.append([r["id"] for r in page])
        if after is None:
            break
    assert seen == [[5, 4], [3, 2], [1, 6]]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Thirty days: rows of ``rare`` on the oldest alone, many at one instant, in two batches."""
    from tidelog.sources.logs import append_logs

    path = str(tmp_path_factory.mktemp("pages") / "t")
    rows = [log(30 * i + d, f"2026-07-{d:02d}T{i % 24:02d}:00:00", service="rare" if d == 1 and i < 3 else "api") for d in range(1, 31) for i in range(40)]
    for batch in (0, 1):
        append_logs(spark.createDataFrame([r for r in rows if r[0] % 2 == batch], LOGS), path, "run", batch)
    return path


@pytest.fixture
def read(monkeypatch):
    """The days that pages read, for each look."""
    seen, stored = [], paging.read_logs
    monkeypatch.setattr(paging, "read_logs", lambda spark, path, days=None, at=None: (seen.append(list(days)) if days else None, stored(spark, path, days, at))[1])
    return seen


@pytest.mark.parametrize(
    ("wanted", "spec", "days"),
    [
        (LogFilters(), PageSpec(30), 1),
        (LogFilters(), PageSpec(41), 3),
        (LogFilters(service="api"), PageSpec(100, ("2026-07-20T03:00:00Z", 10_000)), 7),
        (LogFilters(until="2026-07-10T00:00:00Z"), PageSpec(5), 3),
        (LogFilters(since="2026-07-29T00:00:00Z"), PageSpec(1000), 2),
        (LogFilters(service="rare"), PageSpec(2), 30),
        (LogFilters(service="none"), PageSpec(2), 30),
        (LogFilters(), PageSpec(1000), 30),
        (LogFilters(since="2026-08-01T00:00:00Z"), PageSpec(10), 0),
    ],
)
@pytest.mark.parametrize("slice_bytes", [1 << 30, 4000])
def test_stored_pages_stop_early(spark, table, read, monkeypatch, wanted, spec, days, slice_bytes):
    from tidelog.sources.logs import read_logs

    monkeypatch.setattr(paging, "SLICE_BYTES", slice_bytes)
    found = [tuple(r) for r in paging.stored_page(spark, table, wanted, spec).collect()]
    assert found == [tuple(r) for r in paging.page(read_logs(spark, table), wanted, spec).collect()]
    assert len({d for own in read for d in own}) <= days
    assert paging.read_stored_page(spark, table, wanted, spec) == paging.read_page(read_logs(spark, table), wanted, spec)


def test_a_page_reads_the_files_of_its_day_alone(spark, table):
    from datetime import date

    from tidelog.sources.logs import read_logs

    files = read_logs(spark, table, [date(2026, 7, 30)]).inputFiles()
    assert files and all("day=2026-07-30" in f for f in files)


def test_days_are_looked_through_in_growing_runs():
    from datetime import date

    days = [date(2026, 7, d) for d in range(1, 31)]
    runs = list(paging.spans(days))
    assert [len(own) for own, _ in runs] == [1, 2, 4, 8, 15] and [d for own, _ in runs for d in own] == days[::-1]
    first = list(paging.spans(days[:1], 20))
    assert [(since is None, len(own)) for own, since in first] == [(False, 1), (False, 1), (False, 1), (True, 1)] and first[0][1] > first[1][1] > first[2][1]
    assert list(paging.spans([])) == []


def test_page_rows_and_tokens(logs):
    rows = paging.page(logs, LogFilters(service="checkout")).collect()
    assert [r["id"] for r in rows] == [2, 1] and rows[1]["timestamp"] == "2026-08-09T12:00:00.000000Z"
    token = rows[0]["cursor"]
    assert json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))) == {"v": 1, "t": "2026-08-09T12:02:00.000000Z", "i": "2"}
    assert "=" not in token and "attributes_normalized" not in rows[0].asDict()


@pytest.mark.parametrize(("bucket", "start"), [("1m", "09:07:00"), ("5m", "09:05:00"), ("1h", "09:00:00"), ("1d", "00:00:00")])
def test_bucket_widths(spark, bucket, start):
    rows = spark.createDataFrame([log(1, "2026-08-09T09:07:42")], LOGS)
    found = buckets.bucket_counts(rows, LogFilters(since="2026-08-09T00:00:00Z", until="2026-08-10T00:00:00Z"), BucketSpec(bucket)).collect()
    assert [tuple(r) for r in found] == [(f"2026-08-09T{start}Z", None, 1)]


def test_buckets_by_group_add_up(logs):
    wanted = LogFilters(since="2026-08-09T00:00:00Z", until="2026-08-11T00:00:00Z")
    found = [tuple(r) for r in buckets.bucket_counts(logs, wanted, BucketSpec("1d", "service")).collect()]
    assert found == [("2026-08-09T00:00:00Z", "api", 2), ("2026-08-09T00:00:00Z", "checkout", 2), ("2026-08-10T00:00:00Z", "auth", 1)]
    with pytest.raises(ArgumentError, match="since is required"):
        buckets.bucket_counts(logs, LogFilters(), BucketSpec("1d"))


def test_buckets_before_1970(spark):
    rows = spark.createDataFrame([log(1, "1969-12-31T23:59:59.999999")], LOGS)
    found = buckets.bucket_counts(rows, LogFilters(since="1969-01-01T00:00:00Z", until="1971-01-01T00:00:00Z"), BucketSpec("5m")).collect()
    assert found[0]["start"] == "1969-12-31T23:55:00Z"


def test_summaries(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)] + [(None,)], "x double")
    assert tuple(summary.latency_summary(df, "x").first()) == (100, 50.0, 95.0, 99.0, 50.5)
    assert tuple(summary.latency_summary(df.where("x < 0"), "x").first()) == (0, None, None, None, None)
    assert tuple(summary.latency_summary(df.limit(0), "x").first()) == (0, None, None, None, None)
    reports = spark.createDataFrame([("a", "ok", 3, 1), ("b", "all_invalid", 0, 2)], "request_id string, status string, accepted long, rejected long")
    assert tuple(summary.ingest_summary(reports, 2.0).first()) == (3, 3, 1, 1.5)
    assert summary.ingest_summary(reports, 0.0).first()["logs_per_second"] is None


def test_synthetic_rows_are_functions_of_their_number(spark):
    rows = synthetic(spark, 3601, "2026-08-09T12:00:00Z").orderBy("id").collect()
    assert rows[0]["timestamp"] == rows[3600]["timestamp"] and rows[1]["service"] == "auth" and rows[3]["level"] == "error"
    assert json.loads(rows[1]["attributes"]) == {"run_id": "run", "region": "us-east", "retries": 1, "premium": False}


@pytest.mark.parametrize("seed", range(4))
def test_percentiles_are_exact(spark, seed):
    import math
    import random

    rng = random.Random(seed)
    draw = [lambda: rng.random(), lambda: float(rng.randint(0, 3)), lambda: rng.expovariate(1), lambda: 7.0][seed]
    rows = [(rng.choice(["a", "a", "a", None, "b"]), draw() if rng.random() < 0.9 else None) for _ in range(rng.choice([50, 3000]))] + [("empty", None)]
    found = {r["g"]: r for r in summary.latency_summary(spark.createDataFrame(rows, "g string, x double").repartition(3), "x", ("g",)).collect()}
    assert set(found) == {g for g, _ in rows}
    for g in found:
        values = sorted(x for k, x in rows if k == g and x is not None)
        assert found[g]["samples"] == len(values)
        for p in (50, 95, 99):
            want = round(values[math.ceil(p * len(values) / 100) - 1], 2) if values else None
            assert found[g][f"p{p}"] == pytest.approx(want) if values else found[g][f"p{p}"] is None
