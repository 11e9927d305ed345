"""Queries over the driver's event table and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.attributes import normalized
from tidelog.functions.cursor import page_token
from tidelog.functions.times import BUCKETS, ArgumentError, day_label, day_of_label, micros_text
from tidelog.operators import admission, buckets, filters, paging, retention, summary, validate
from tidelog.operators.filters import LogFilters
from tidelog.operators.ids import assign_ids
from tidelog.plans import raw
from tidelog.scratch import new_path
from tidelog.session import configure
from tidelog.sources.logs import append_logs, from_events, promote, read_logs
from tidelog.sources.requests import request_documents, request_lines
from tidelog.sources.synthetic import LEVELS, MESSAGES, SERVICES, synthetic_logs
from tidelog.streaming.ingest import OVERLOADED, Places, committed, ingest_batch, ingest_stream, limited, publish_batch, read_reports, stage_batch, waiting

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SINCE, UNTIL = "2024-01-05T00:00:00Z", "2024-01-20T12:30:00Z"
NOW = "2024-01-30T23:00:00Z"
LOGS_SQL = """
WITH logs AS (
  SELECT event_id + 1 AS id, ts AS timestamp,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'info' WHEN 'click' THEN 'info' ELSE 'debug' END AS level,
    'svc-' || CAST(user_id % 5 AS VARCHAR) AS service,
    event_type || ' by user ' || CAST(user_id AS VARCHAR) AS message,
    props AS attributes
  FROM events
)
"""
MICROS = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ')"
RANGE = "timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-20 12:30:00'"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(events(spark, sf_dir))


def with_map(rows: DataFrame) -> DataFrame:
    return rows.withColumn("attributes_normalized", normalized(F.col("attributes")))


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


def _buckets() -> None:
    widths = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}
    for bucket in BUCKETS:
        for group in (None, "service", "level"):
            sql = f"""{LOGS_SQL} SELECT strftime(time_bucket(INTERVAL '{widths[bucket]}', timestamp, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS start,
              {group or "CAST(NULL AS VARCHAR)"} AS "group", count(*) AS count FROM logs WHERE {RANGE} GROUP BY ALL"""

            def query(spark: SparkSession, sf_dir: str, bucket: str = bucket, group: str | None = group) -> DataFrame:
                return buckets.bucket_counts(logs(spark, sf_dir), LogFilters(since=SINCE, until=UNTIL), buckets.BucketSpec(bucket, group))

            register(f"bucket_{bucket}" + (f"_{group}" if group else ""), sql)(query)


_buckets()


@register(
    "bucket_filtered",
    f"""{LOGS_SQL} SELECT strftime(time_bucket(INTERVAL '1 hour', timestamp, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS start, level AS "group", count(*) AS count
    FROM logs WHERE {RANGE} AND service <> 'svc-2' AND contains(lower(message), lower('BY user')) AND json_extract_string(attributes, '$.k') = '42' GROUP BY ALL""",
)
def bucket_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = LogFilters(since=SINCE, until=UNTIL, attributes={"k": "42"}, q="BY user")
    others = logs(spark, sf_dir).where("service != 'svc-2'")
    return buckets.bucket_counts(with_map(others), wanted, buckets.BucketSpec("1h", "level"))


@register("bucket_recent", f"""{LOGS_SQL} SELECT strftime(time_bucket(INTERVAL '5 minutes', timestamp, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS start, service AS "group", count(*) AS count
    FROM logs WHERE timestamp >= TIMESTAMP '2024-01-30 21:00:00' GROUP BY ALL""")
def bucket_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.recent_bucket_counts(logs(spark, sf_dir), NOW)


def _filters() -> None:
    cases: dict[str, tuple[LogFilters, str]] = {
        "service_eq": (LogFilters(service="svc-3"), "service = 'svc-3'"),
        "level_eq": (LogFilters(level="warn"), "level = 'warn'"),
        "time_range": (LogFilters(since=SINCE, until=UNTIL), RANGE),
        "time_range_empty": (LogFilters(since=SINCE, until=SINCE), "false"),
        "search_literal": (LogFilters(q="ERROR BY"), "contains(lower(message), lower('ERROR BY'))"),
        "search_no_wildcards": (LogFilters(q="er_or%"), "contains(lower(message), 'er_or%')"),
        "attr_equals": (LogFilters(attributes={"k": "42"}), "json_extract_string(attributes, '$.k') = '42'"),
        "filters_combined": (LogFilters("svc-1", "info", SINCE, UNTIL, {"k": "7"}, "CLICK"), f"{RANGE} AND service = 'svc-1' AND level = 'info' AND json_extract_string(attributes, '$.k') = '7' AND contains(lower(message), 'click')"),
    }
    for name, (wanted, condition) in cases.items():

        def query(spark: SparkSession, sf_dir: str, wanted: LogFilters = wanted) -> DataFrame:
            rows = logs(spark, sf_dir)
            found = filters.where(with_map(rows) if wanted.attributes else rows, wanted)
            return found.select("id", micros_text(F.col("timestamp")).alias("timestamp"), "level", "service", "message", "attributes")

        register(name, f"{LOGS_SQL} SELECT id, {MICROS} AS timestamp, level, service, message, attributes FROM logs WHERE {condition}")(query)


_filters()


@register("attr_several", "SELECT event_id + 1 AS id, event_id % 5 AS retries FROM events WHERE event_id % 2 = 0 AND event_id % 5 = 3")
def attr_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synthetic_logs(events(spark, sf_dir).select(F.col("event_id").alias("id")), "2026-08-09T12:00:00Z", "r")
    wanted = LogFilters(attributes={"region": "eu-west", "retries": "3", "premium": "true"})
    return filters.where(with_map(made), wanted).select("id", F.col("attributes_normalized")["retries"].cast("long").alias("retries"))


@register("lookback", f"{LOGS_SQL} SELECT id, service FROM logs WHERE timestamp >= TIMESTAMP '2024-01-30 21:00:00'")
def lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.look_back(logs(spark, sf_dir), NOW, 2).select("id", "service")


_CURSOR = """rtrim(translate(to_base64(encode('{"v":1,"t":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') || '","i":"' || id || '"}')), '+/', '-_'), '=')"""
_PAGE = f"SELECT id, {MICROS} AS timestamp, level, service, message, attributes, {_CURSOR} AS cursor"


@register("page_first", f"{LOGS_SQL} {_PAGE} FROM logs WHERE service = 'svc-1' ORDER BY logs.timestamp DESC, id DESC LIMIT 100")
def page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page(logs(spark, sf_dir), LogFilters(service="svc-1"))


@register("page_next", f"{LOGS_SQL} {_PAGE} FROM logs WHERE (timestamp, id) < (TIMESTAMP '2024-01-15 12:00:00.123456', 5000) ORDER BY logs.timestamp DESC, id DESC LIMIT 25")
def page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page(logs(spark, sf_dir), LogFilters(), paging.PageSpec(25, ("2024-01-15T12:00:00.123456Z", 5000)))


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> str:
    """The place of the events as a log table, which is written once for a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stored:
        path, rows = new_path(spark, "table"), with_map(logs(spark, sf_dir))
        promote(spark, path, ["k"])
        append_logs(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("day", F.to_date("timestamp")), path, "run")
        _stored[key] = path
    configure(spark)
    return _stored[key]


@register("stored_page_first", f"{LOGS_SQL} {_PAGE} FROM logs WHERE service = 'svc-1' ORDER BY logs.timestamp DESC, id DESC LIMIT 100")
def stored_page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.stored_page(spark, stored(spark, sf_dir), LogFilters(service="svc-1"))


@register("stored_page_next", f"{LOGS_SQL} {_PAGE} FROM logs WHERE (timestamp, id) < (TIMESTAMP '2024-01-15 12:00:00.123456', 5000) ORDER BY logs.timestamp DESC, id DESC LIMIT 25")
def stored_page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.stored_page(spark, stored(spark, sf_dir), LogFilters(), paging.PageSpec(25, ("2024-01-15T12:00:00.123456Z", 5000)))


@register("stored_page_rare", f"{LOGS_SQL} {_PAGE} FROM logs WHERE level = 'warn' AND contains(lower(message), 'by user 7') AND json_extract_string(attributes, '$.k') = '42' ORDER BY logs.timestamp DESC, id DESC LIMIT 1000")
def stored_page_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page whose rows are spread thinly over all days."""
    return paging.stored_page(spark, stored(spark, sf_dir), LogFilters(level="warn", q="BY USER 7", attributes={"k": "42"}), paging.PageSpec(1000))


@register("stored_attr_equals", f"{LOGS_SQL} SELECT id, {MICROS} AS timestamp, service FROM logs WHERE json_extract_string(attributes, '$.k') = '42' AND level = 'warn'")
def stored_attr_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute that the table has a column for; its map isn't read."""
    found = filters.where(read_logs(spark, stored(spark, sf_dir)), LogFilters(level="warn", attributes={"k": "42"}))
    return found.select("id", micros_text(F.col("timestamp")).alias("timestamp"), "service")


def _stored_buckets() -> None:
    since, until = "2024-01-05T07:12:30.250000Z", "2024-01-20T12:30:59.999999Z"
    sql_range = "timestamp >= TIMESTAMP '2024-01-05 07:12:30.25' AND timestamp < TIMESTAMP '2024-01-20 12:30:59.999999'"
    for bucket, width, group in (("1m", "1 minute", None), ("5m", "5 minutes", "service"), ("1h", "1 hour", "level"), ("1d", "1 day", "service")):
        sql = f"""{LOGS_SQL} SELECT strftime(time_bucket(INTERVAL '{width}', timestamp, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS start,
          {group or "CAST(NULL AS VARCHAR)"} AS "group", count(*) AS count FROM logs WHERE {sql_range} AND level <> 'debug' GROUP BY ALL"""

        def query(spark: SparkSession, sf_dir: str, bucket: str = bucket, group: str | None = group) -> DataFrame:
            """Whole minutes from the counts of the table, the ends from its logs; a level at a time, as filters have no more."""
            found = [buckets.stored_bucket_counts(spark, stored(spark, sf_dir), LogFilters(level=level, since=since, until=until), buckets.BucketSpec(bucket, group)) for level in ("info", "warn", "error")]
            return found[0].union(found[1]).union(found[2]).groupBy("start", "group").agg(F.sum("count").alias("count"))

        register(f"stored_bucket_{bucket}" + (f"_{group}" if group else ""), sql)(query)


_stored_buckets()


@register("stored_bucket_all", f"""{LOGS_SQL} SELECT strftime(time_bucket(INTERVAL '5 minutes', timestamp, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS start, service AS "group", count(*) AS count FROM logs WHERE {RANGE} GROUP BY ALL""")
def stored_bucket_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bucket_5m_service``, from counts by minute alone."""
    return buckets.stored_bucket_counts(spark, stored(spark, sf_dir), LogFilters(since=SINCE, until=UNTIL), buckets.BucketSpec("5m", "service"))


@register("newest_first", f"{LOGS_SQL} SELECT id, {MICROS} AS timestamp, row_number() OVER (ORDER BY logs.timestamp DESC, id DESC) AS place FROM logs")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paging.newest(logs(spark, sf_dir)).select(F.col("id").alias("log_id"), "timestamp")
    placed = assign_ids(rows.withColumns({"down": -F.unix_micros(F.col("timestamp").cast("timestamp")), "below": -F.col("log_id")}), ("down", "below"))
    return placed.select(F.col("log_id").alias("id"), micros_text(F.col("timestamp")).alias("timestamp"), F.col("id").alias("place"))


@register("cursor_tokens", f"{LOGS_SQL} SELECT id, {_CURSOR} AS cursor FROM logs")
def cursor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("id", page_token(F.col("timestamp"), F.col("id")).alias("cursor"))


@register("timestamp_render", f"{LOGS_SQL} SELECT id, {MICROS} AS micros, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS seconds FROM logs")
def timestamp_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.functions.times import seconds_text

    return logs(spark, sf_dir).select("id", micros_text(F.col("timestamp")).alias("micros"), seconds_text(F.col("timestamp")).alias("seconds"))


@register("newest_of_service", f"{LOGS_SQL} SELECT id, {MICROS} AS timestamp, level, service, message, attributes FROM logs WHERE service = 'svc-2' AND logs.timestamp >= TIMESTAMP '2024-01-30 21:00:00' ORDER BY logs.timestamp DESC, id DESC LIMIT 100")
def newest_of_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.newest_of_service(logs(spark, sf_dir), "svc-2", NOW)


@register("newest_with_attribute", f"{LOGS_SQL} SELECT id, {MICROS} AS timestamp, service FROM logs WHERE json_extract_string(attributes, '$.k') = '42' AND logs.timestamp >= TIMESTAMP '2024-01-29 23:00:00' ORDER BY logs.timestamp DESC, id DESC LIMIT 100")
def newest_with_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.newest_with_attribute(with_map(logs(spark, sf_dir)), "k", "42", NOW, 24)


@register("row_count", "SELECT count(*) AS count FROM events")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.row_count(logs(spark, sf_dir))


@register("exact_counts", "SELECT user_id % 5 AS service, count(*) AS count FROM events GROUP BY 1")
def exact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a reader of JSON numbers gets exactly, or an error."""
    counts = events(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("service")).agg(F.count("*").alias("n"))
    return counts.select("service", buckets.exact(F.col("n")).alias("count"))


_RANKS = ", ".join(f"round(quantile_disc(value, {p / 100}), 2) AS p{p}" for p in (50, 95, 99))


@register("latency_summary", f"SELECT count(value) AS samples, {_RANKS}, round(avg(value), 2) AS average FROM events")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.latency_summary(events(spark, sf_dir), "value")


@register("latency_by_type", f"SELECT event_type, count(value) AS samples, {_RANKS}, round(avg(value), 2) AS average FROM events GROUP BY event_type")
def latency_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.latency_summary(events(spark, sf_dir), "value", ("event_type",))


_CUT = datetime(2024, 1, 16, 12)


@register("retention_kept", f"{LOGS_SQL} SELECT id, {MICROS} AS timestamp FROM logs WHERE timestamp >= TIMESTAMP '2024-01-16 12:00:00'")
def retention_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).withColumn("day", F.to_date("timestamp"))
    return retention.kept(rows, _CUT).select("id", micros_text(F.col("timestamp")).alias("timestamp"))


@register("day_inventory", "SELECT strftime(ts, 'logs_%Y_%m_%d') AS label, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, (CAST(ts AS DATE) + INTERVAL 1 DAY) <= TIMESTAMP '2024-01-16 12:00:00' AS expired FROM events GROUP BY ALL")
def day_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = logs(spark, sf_dir).groupBy(F.to_date("timestamp").alias("d")).agg(F.count("*").alias("rows")).withColumn("label", day_label(F.col("d")))
    expired = F.date_add("d", 1).cast("timestamp_ntz") <= F.lit(_CUT).cast("timestamp_ntz")
    return days.select("label", day_of_label(F.col("label")).cast("string").alias("day"), "rows", expired.alias("expired"))


@register("normalize_attributes", f"{LOGS_SQL} SELECT id, json_extract_string(attributes, '$.k') AS k, len(json_keys(attributes)) AS keys FROM logs")
def normalize_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_map(logs(spark, sf_dir)).select("id", F.col("attributes_normalized")["k"].alias("k"), F.size("attributes_normalized").cast("long").alias("keys"))


@register("assign_ids", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def ids_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_ids(events(spark, sf_dir).select("ts", "event_id"), ("ts", "event_id")).select("event_id", "id")


def _turn(values: tuple[str, ...]) -> str:
    return f"({list(values)})[(event_id % {len(values)}) + 1]"


@register(
    "synthetic_logs",
    f"""SELECT event_id + 1 AS id, strftime(TIMESTAMP '2026-08-09 12:00:00' - to_seconds(event_id % 3600), '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, {_turn(LEVELS)} AS level, {_turn(SERVICES)} AS service, {_turn(MESSAGES)} AS message,
    '{{"run_id":"r","region":"' || CASE WHEN event_id % 2 = 0 THEN 'eu-west' ELSE 'us-east' END || '","retries":' || (event_id % 5) || ',"premium":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}' AS attributes FROM events""",
)
def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synthetic_logs(events(spark, sf_dir).select(F.col("event_id").alias("id")), "2026-08-09T12:00:00Z", "r")
    return made.withColumn("timestamp", micros_text(F.col("timestamp")))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.with_reasons(validate.entries(validate.requests(raw.bodies(events(spark, sf_dir))), refused=True), raw.NOW)


_REASON = "CASE event_id % 20 " + " ".join(f"WHEN {k} THEN '" + r.replace("'", "''") + "'" for k, r in raw.REASONS.items()) + " END"
_VALID = f"""{LOGS_SQL} SELECT {MICROS} AS timestamp, level, service, message, CASE WHEN (id - 1) % 20 = 14 THEN '{{}}' ELSE replace(attributes, ' ', '') END AS attributes,
    CASE WHEN (id - 1) % 20 = 14 THEN NULL ELSE json_extract_string(attributes, '$.k') END AS k FROM logs WHERE (id - 1) % 20 >= 14"""
_LOG_COLUMNS = ("level", "service", "message", "attributes")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(micros_text(F.col("timestamp")).alias("timestamp"), *_LOG_COLUMNS, F.col("attributes_normalized")["k"].alias("k"))


@register("validate_accepted", _VALID)
def validate_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(validate.accepted(validate.validated(_checked(spark, sf_dir))))


@register("validate_rejected", f"""SELECT lpad(CAST(event_id // 100 AS VARCHAR), 12, '0') AS request_id, CAST(row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS INTEGER) AS index, {_REASON} AS reason FROM events QUALIFY reason IS NOT NULL""")
def validate_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rejected(_checked(spark, sf_dir)).select("request_id", "index", "reason")


_REPORTS = f"SELECT lpad(CAST(event_id // 100 AS VARCHAR), 12, '0') AS request_id, count(*) FILTER (({_REASON}) IS NULL) AS accepted, count(*) FILTER (({_REASON}) IS NOT NULL) AS rejected FROM events GROUP BY 1"


@register("ingest_reports", f"SELECT request_id, CASE WHEN accepted > 0 THEN 'ok' ELSE 'all_invalid' END AS status, CAST(NULL AS VARCHAR) AS error, accepted, rejected FROM ({_REPORTS})")
def ingest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reports(_checked(spark, sf_dir))


@register("status_tally", f"SELECT CASE WHEN accepted > 0 THEN 'ok' ELSE 'all_invalid' END AS status, count(*) AS requests FROM ({_REPORTS}) GROUP BY 1")
def status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.status_tally(validate.reports(_checked(spark, sf_dir)))


@register("ingest_summary", f"SELECT CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(rejected) AS BIGINT) AS rejected, count(*) FILTER (accepted = 0) AS failed_requests, round(sum(accepted) / 8.0::DOUBLE, 2) AS logs_per_second FROM ({_REPORTS})")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.ingest_summary(validate.reports(_checked(spark, sf_dir)), 8.0)


def _places(spark: SparkSession) -> Places:
    return Places(*(new_path(spark, x) for x in ("logs", "rejected", "reports")))


_WHOLE = f"""{LOGS_SQL} SELECT row_number() OVER (ORDER BY id) AS id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, {MICROS} AS timestamp, level, service, message, CASE WHEN (id - 1) % 20 = 14 THEN '{{}}' ELSE replace(attributes, ' ', '') END AS attributes FROM logs WHERE (id - 1) % 20 >= 14"""


@register("ingest_batch", _WHOLE)
def batch_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies to table and back, written twice: the second time replaces the first."""
    source, places = new_path(spark, "bodies"), _places(spark)
    raw.bodies(events(spark, sf_dir)).write.parquet(source)
    for _ in range(2):
        # Files are read by size: the order of arrival is that of the rows given, not of those once written.
        ingest_batch(spark.read.parquet(source).orderBy("request_id"), places, raw.NOW, "run", 0)
    return read_logs(spark, places.logs).select("id", F.col("day").cast("string").alias("day"), micros_text(F.col("timestamp")).alias("timestamp"), *_LOG_COLUMNS)


@register("ingest_stream", _VALID)
def stream_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, places = new_path(spark, "bodies"), _places(spark)
    raw.bodies(events(spark, sf_dir)).select("body").write.text(source)
    stream = ingest_stream(spark, source, places, new_path(spark, "checkpoint"), lambda: raw.NOW, "run", files_per_batch=4)
    stream.awaitTermination()
    return _shown(committed(spark, places))


_POLICY = retention.Retention(137, 1)
#: The first day that is open under the policy.
_OPEN = "DATE '2024-01-16'"


@register("ingest_late", f"""SELECT CASE WHEN CAST(timestamp AS DATE) < {_OPEN} THEN 'timestamp is outside the days that are kept' ELSE 'accepted' END AS outcome, count(*) AS entries FROM (
    {LOGS_SQL} SELECT * FROM logs WHERE (id - 1) % 20 >= 14) GROUP BY 1""")
def late_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of days that aren't open are refused by themselves; what is refused for other reasons is left out."""
    places = _places(spark)
    ingest_batch(raw.bodies(events(spark, sf_dir)), places, raw.NOW, "run", 0, _POLICY, early_days="reject")
    late = spark.read.parquet(places.rejected).where("reason LIKE '%days that are kept'").groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("entries"))
    return late.union(committed(spark, places).groupBy(F.lit("accepted").alias("outcome")).agg(F.count("*").alias("entries")))


@register("ingest_all_or_nothing", f"SELECT 'no partition of logs' AS error, count(*) AS entries FROM ({LOGS_SQL} SELECT * FROM logs WHERE (id - 1) % 20 >= 14)")
def all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with a row of a day that isn't open fails as a whole; the batch before it, of the same rows, stays as it is."""
    bodies, places = raw.bodies(events(spark, sf_dir)), _places(spark)
    ingest_batch(bodies, places, raw.NOW, "run", 0)
    try:
        ingest_batch(bodies, places, raw.NOW, "run", 1, _POLICY)
        error = ""
    except ArgumentError as e:
        error = str(e)[:20]
    return committed(spark, places).agg(F.count("*").alias("entries")).select(F.lit(error).alias("error"), "entries")


@register("ingest_limited", "SELECT CASE WHEN error IS NULL THEN 'taken' ELSE error END AS outcome, count(*) AS requests FROM (SELECT event_id // 100 AS r, CASE WHEN max(event_id) >= 550 THEN 'too many logs are waiting' END AS error FROM events GROUP BY 1) GROUP BY 1")
def limited_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of requests of 100 entries, those that end beyond 550 are refused."""
    parsed = limited(validate.requests(raw.bodies(events(spark, sf_dir))), 550)
    return parsed.groupBy(F.coalesce("refused", F.lit("taken")).alias("outcome")).agg(F.count("*").alias("requests"))


_HOURS = "SELECT epoch(date_trunc('hour', ts))::BIGINT // 3600 AS seq, count(*) AS n FROM events GROUP BY 1"
#: Entries of a micro-batch, and of all that may wait, for requests that are the events of an hour.
_TOGETHER, _ROOM = 40, 200


def _by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.unix_seconds(F.date_trunc("hour", "ts").cast("timestamp")) / 3600
    return events(spark, sf_dir).groupBy(hour.cast("long").alias("seq")).agg(F.count("*").alias("n"))


@register("request_microbatches", f"""WITH RECURSIVE sizes AS (SELECT seq, n, row_number() OVER (ORDER BY seq) AS i FROM ({_HOURS})),
    cut AS (SELECT seq, i, 1::BIGINT AS microbatch, n AS fill FROM sizes WHERE i = 1 UNION ALL
      SELECT s.seq, s.i, CASE WHEN fill + n > {_TOGETHER} THEN microbatch + 1 ELSE microbatch END, CASE WHEN fill + n > {_TOGETHER} THEN n ELSE fill + n END FROM cut JOIN sizes s ON s.i = cut.i + 1)
    SELECT seq, microbatch FROM cut""")
def request_microbatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole requests in groups of a bounded number of entries, larger ones alone; the partitions of the order are days here."""
    sizes = _by_hour(spark, sf_dir)
    shifted = (F.floor(F.col("seq") / 24) * (1 << admission.WITHIN) + F.col("seq") % 24).cast("long")
    cut = admission.microbatches(sizes.withColumn("seq", shifted), _TOGETHER)
    back = F.shiftright("seq", admission.WITHIN) * 24 + F.col("seq").bitwiseAND((1 << admission.WITHIN) - 1)
    return cut.select(back.alias("seq"), "microbatch")


@register("request_admission", f"""WITH RECURSIVE sizes AS (SELECT seq, n, row_number() OVER (ORDER BY seq) AS i FROM ({_HOURS})),
    gone AS (SELECT seq, i, n > {_ROOM} AS over, CASE WHEN n > {_ROOM} THEN 0 ELSE n END AS used FROM sizes WHERE i = 1 UNION ALL
      SELECT s.seq, s.i, used + n > {_ROOM}, CASE WHEN used + n > {_ROOM} THEN used ELSE used + n END FROM gone JOIN sizes s ON s.i = gone.i + 1)
    SELECT seq FROM gone WHERE over""")
def request_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that don't fit into what may wait; later ones that are small enough do."""
    sizes = _by_hour(spark, sf_dir)
    shifted = (F.floor(F.col("seq") / 24) * (1 << admission.WITHIN) + F.col("seq") % 24).cast("long")
    back = F.shiftright("seq", admission.WITHIN) * 24 + F.col("seq").bitwiseAND((1 << admission.WITHIN) - 1)
    return admission.beyond(sizes.withColumn("seq", shifted), _ROOM).select(back.alias("seq"))


_GOOD = f"SELECT event_id // 100 AS r, count(*) AS n FROM events WHERE event_id % {raw.EVERY} >= 14 GROUP BY 1"


@register("ingest_waiting", f"""WITH good AS ({_GOOD}), more AS (SELECT n, sum(n) OVER (ORDER BY r) AS upto, (SELECT sum(n) FROM good) AS whole FROM good)
    SELECT 'while one batch waits' AS at, count(*) AS requests, CAST((SELECT sum(n) FROM good) AS BIGINT) AS readable FROM more WHERE upto + whole > whole + 100
    UNION ALL SELECT 'when it is published', 0, CAST(2 * (SELECT sum(n) FROM good) + sum(n) FILTER (upto <= 100) AS BIGINT) FROM more""")
def ingest_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that isn't published takes room from the next, and none of it can be read; published, it takes none."""
    bodies, places = raw.bodies(events(spark, sf_dir)).orderBy("request_id"), _places(spark)
    ingest_batch(bodies, places, raw.NOW, "run", 0)
    pending = stage_batch(bodies, places, raw.NOW, "run", 1)
    readable = read_logs(spark, places.logs).count()
    room = waiting(spark, places) + 100
    ingest_batch(bodies, places, raw.NOW, "run", 2, most_logs=room)
    publish_batch(spark, places, pending)
    refused = F.count_if(F.col("error") == OVERLOADED).alias("requests")
    second = spark.read.parquet(places.reports).where("batch_id = 2").agg(refused).select(F.lit("while one batch waits").alias("at"), "requests", F.lit(readable).cast("long").alias("readable"))
    after = read_logs(spark, places.logs).agg(F.count("*").alias("readable")).select(F.lit("when it is published").alias("at"), F.lit(waiting(spark, places)).cast("long").alias("requests"), "readable")
    return second.union(after)


@register("ingest_microbatches", f"""WITH RECURSIVE good AS (SELECT event_id // 100 AS r, count(*) AS n, bool_or(CAST(ts AS DATE) < {_OPEN}) AS shut FROM events WHERE event_id % {raw.EVERY} >= 14 GROUP BY 1),
    sizes AS (SELECT *, row_number() OVER (ORDER BY r) AS i FROM good),
    cut AS (SELECT r, i, n, shut, 1 AS m, n AS fill FROM sizes WHERE i = 1 UNION ALL SELECT s.r, s.i, s.n, s.shut, CASE WHEN fill + s.n > 70 THEN m + 1 ELSE m END, CASE WHEN fill + s.n > 70 THEN s.n ELSE fill + s.n END FROM cut JOIN sizes s ON s.i = cut.i + 1),
    failed AS (SELECT m, bool_or(shut) AS f FROM cut GROUP BY m)
    SELECT CASE WHEN f THEN 'failed' ELSE 'ok' END AS status, count(*) AS requests, CAST(sum(CASE WHEN f THEN 0 ELSE n END) AS BIGINT) AS accepted FROM cut JOIN failed USING (m) GROUP BY 1""")
def ingest_microbatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of a day that isn't open fails the requests of its micro-batch, and those alone."""
    bodies, places = raw.bodies(events(spark, sf_dir)).orderBy("request_id"), _places(spark)
    ingest_batch(bodies, places, raw.NOW, "run", 0, _POLICY, early_days="microbatch", logs_per_batch=70)
    reports = read_reports(spark, places).where("accepted > 0 OR status = 'failed'")
    return reports.groupBy("status").agg(F.count("*").alias("requests"), F.sum("accepted").alias("accepted"))


@register("day_admission", "SELECT strftime(CAST(ts AS DATE), 'logs_%Y_%m_%d') AS label, CAST(ts AS DATE) BETWEEN DATE '2024-01-16' AND DATE '2024-02-01' AS open, count(*) AS rows FROM events GROUP BY ALL")
def day_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the rows, and whether the day window is open to them."""
    rows = logs(spark, sf_dir).select(F.to_date("timestamp").alias("day"))
    shut = retention.outside_window(rows, "2024-01-31T12:00:00Z", retention.Retention(15, 1)).select("day").distinct().withColumn("shut", F.lit(True))
    days = rows.groupBy("day").agg(F.count("*").alias("rows")).join(shut, "day", "left")
    return days.select(day_label(F.col("day")).alias("label"), F.col("shut").isNull().alias("open"), "rows")


@register("request_lines", f"SELECT count(DISTINCT event_id // 100) AS requests, count(*) AS entries FROM events")
def request_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lines")
    raw.bodies(events(spark, sf_dir)).select("body").write.text(path)
    found = validate.entries(validate.requests(request_lines(spark, path)))
    return found.agg(F.count_distinct("request_id").alias("requests"), F.count("*").alias("entries"))


@register("request_documents", "SELECT count(DISTINCT event_id // 100) AS requests, count(*) AS entries FROM events")
def document_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a file, in a folder for each request, so that files stay apart."""
    path = new_path(spark, "documents")
    raw.bodies(events(spark, sf_dir)).write.partitionBy("request_id").text(path)
    found = validate.entries(validate.requests(request_documents(spark, path)))
    return found.agg(F.count_distinct("request_id").alias("requests"), F.count("*").alias("entries"))


@register(
    "maintenance",
    """SELECT '2024-01-16T12:00:00.000000Z' AS cutoff, (SELECT string_agg(strftime(d, 'logs_%Y_%m_%d'), ',' ORDER BY d) FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-16', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)) AS created,
    (SELECT string_agg(strftime(d, 'logs_%Y_%m_%d'), ',' ORDER BY d) FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE ts < TIMESTAMP '2024-01-16')) AS dropped, count(*) AS deleted FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-16 12:00:00'""",
)
def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "table")
    rows = with_map(logs(spark, sf_dir)).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("day", F.to_date("timestamp"))
    append_logs(rows, path, "run")
    report = retention.maintain(spark, path, "2024-01-31T12:00:00Z", retention.Retention(15, 1))
    labels = [F.array_join(f"{c}Partitions", ",").alias(c) for c in ("created", "dropped")]
    return report.select(micros_text(F.col("cutoff")).alias("cutoff"), *labels, F.col("deletedCutoffRows").alias("deleted"))


@register("backfill_normalized", f"{LOGS_SQL} SELECT id, json_extract_string(attributes, '$.k') AS k FROM logs")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, target = new_path(spark, "table"), new_path(spark, "backfilled")
    nothing = F.lit(None).cast("map<string,string>")
    rows = logs(spark, sf_dir).withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "attributes_normalized": nothing, "day": F.to_date("timestamp")})
    append_logs(rows, path, "run")
    retention.backfill_normalized(spark, path, target)
    return read_logs(spark, target).select("id", F.col("attributes_normalized")["k"].alias("k"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["bucket_5m_service"](spark, sf_dir)
