"""Validation of request bodies and their entries, as one column of reasons: the first rule that fails wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.attributes import texts
from tidelog.functions.times import INSTANT_REASONS, ISO, parse_instant
from tidelog.operators.filters import blank
from tidelog.schema import LEVELS

FUTURE_MS = 5 * 60 * 1000
#: How the error of a request begins that has a row whose day isn't open, or that goes with one.
UNWRITABLE = "no partition of logs for "


def _kind(v: Column) -> Column:
    """The type of a scalar variant; empty where there is none, ``VOID`` for a JSON null."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _object(v: Column) -> Column:
    """The fields of an object; null for anything else. Walked once: reading fields by path walks the document for each."""
    return v.try_cast("map<string,variant>")


def requests(bodies: DataFrame, in_order: bool = False) -> DataFrame:
    """``bodies(request_id, body)`` with its ``logs`` and ``refused``, the reason that the whole request is refused for, or null.

    With ``in_order``, ``seq`` rises with the rows of ``bodies``, of which each has its own.
    """
    seq = [F.monotonically_increasing_id().alias("seq")] * in_order
    parsed = bodies.select("request_id", "body", *seq, F.try_parse_json("body").alias("v")).withColumn("top", _object(F.col("v")))
    parsed = parsed.withColumn("logs", F.col("top")["logs"].try_cast("array<variant>"))
    refused = (
        F.when(F.col("v").isNull(), "request body must be valid JSON")
        .when(F.col("top").isNull(), "request body must be an object")
        .when(F.col("logs").isNull(), "logs must be an array")
        .when(F.size("logs") == 0, "logs must contain at least one entry")
    )
    return parsed.select("request_id", "body", *["seq"] * in_order, "logs", refused.alias("refused"))


def entries(parsed: DataFrame, refused: bool = False) -> DataFrame:
    """``(request_id, index, v, raw)`` of the entries of requests that aren't refused, in order; ``raw`` is an entry's text.

    With ``refused``, a column of that name is kept, and each refused request has one row without an index. A column ``seq`` is kept where there is one.
    """
    # The variant keeps types, the text keeps the order of keys.
    both = F.arrays_zip(F.col("logs").alias("v"), F.from_json("body", "logs array<string>")["logs"].alias("raw"))
    rows = parsed if refused else parsed.where("refused IS NULL")
    kept = ["request_id", *["refused"] * refused, *(c for c in ("seq",) if c in parsed.columns)]
    found = rows.select(*kept, F.posexplode_outer(F.when(F.col("refused").isNull(), both)).alias("index", "e"))
    return found.select(*kept, "index", F.col("e.v").alias("v"), F.col("e.raw").alias("raw"))


def _part(text: Column, at: int, n: int) -> Column:
    return F.substring(text, at, n).try_cast("int")


def _offset(text: Column) -> tuple[Column, Column, Column]:
    """Sign, hours and minutes of the zone at the end of an instant's text."""
    zulu = F.endswith(text, F.lit("Z"))
    tail = F.right(text, F.lit(6))
    sign = F.when(zulu, 0).when(F.startswith(tail, F.lit("-")), -1).otherwise(1)
    return sign, F.when(zulu, 0).otherwise(_part(tail, 2, 2)), F.when(zulu, 0).otherwise(_part(tail, 5, 2))


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 of an instant's text that obeys the rules: the local part read as UTC, less the offset."""
    sign, hours, minutes = _offset(text)
    seconds = F.unix_micros(F.concat(F.substring(text, 1, 19), F.lit("Z")).try_cast("timestamp"))
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 6, "0").try_cast("long")
    return seconds + F.coalesce(fraction, F.lit(0)) - sign * (hours * 60 + minutes).cast("long") * F.lit(60_000_000)


def timestamp_reason(kind: Column, text: Column, micros: Column, now: str, name: str = "timestamp") -> Column:
    """The first rule of instants that a value breaks, or null; ``micros`` is :func:`instant_micros` of the text."""
    year, month, day = _part(text, 1, 4), _part(text, 6, 2), _part(text, 9, 2)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    _, hours, minutes = _offset(text)
    limit = parse_instant(now, "now").milliseconds + FUTURE_MS
    broken = (
        ("type", kind != "STRING"),
        ("form", ~text.rlike(f"^{ISO}\\z")),
        ("month", ~month.between(1, 12)),
        ("day", (day < 1) | (day > days)),
        ("hour", _part(text, 12, 2) > 23),
        ("minute", _part(text, 15, 2) > 59),
        ("second", _part(text, 18, 2) > 59),
        ("offset", (hours > 23) | (minutes > 59)),
        ("future", F.floor(micros / 1000) > limit),
    )
    return F.coalesce(*[F.when(condition, f"{name} {INSTANT_REASONS[rule]}") for rule, condition in broken])


def _good(v: Column) -> Column:
    """Whether an attribute's value is a string, a finite number or a boolean."""
    kind = _kind(v)
    whole = kind.isin("STRING", "BOOLEAN", "BIGINT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")
    return F.coalesce(whole | (kind.isin("DOUBLE", "FLOAT") & (F.abs(F.when(kind.isin("DOUBLE", "FLOAT"), v).try_cast("double")) < F.lit(float("inf")))), F.lit(False))


def _first_bad_key(values: Column, raw: Column) -> Column:
    """The first key of a value that isn't :func:`_good`: whole-number keys by size, and then the others in document order."""
    keys = F.array_distinct(F.coalesce(F.json_object_keys(F.from_json(raw, "attributes string")["attributes"]), F.array().cast("array<string>")))
    number = r"^(0|[1-9]\d{0,8})\z"
    ordered = F.concat(
        F.transform(F.array_sort(F.transform(F.filter(keys, lambda k: k.rlike(number)), lambda k: k.cast("long"))), lambda k: k.cast("string")),
        F.filter(keys, lambda k: ~k.rlike(number)),
    )
    return F.get(F.filter(ordered, lambda k: ~_good(values[k])), 0)


def with_reasons(found: DataFrame, now: str) -> DataFrame:
    """Entries as plain columns with ``reason``, null for those that are accepted. ``now`` is an ISO text.

    Each entry is walked once; the rules read what that has found.
    """
    names = ("timestamp", "level", "service", "message")
    fields, more = found.withColumn("fields", _object(F.col("v"))), [c for c in found.columns if c not in ("index", "v", "raw")]
    each = fields.select(
        *more,
        F.col("index").cast("int").alias("index"),
        "raw",
        F.col("fields").isNotNull().alias("whole"),
        *[_kind(F.col("fields")[c]).alias(f"{c}_kind") for c in names],
        *[F.col("fields")[c].try_cast("string").alias(c) for c in names],
        F.col("fields")["attributes"].alias("attributes"),
    )
    each = each.withColumns({"values": _object(F.col("attributes")), "micros": F.when(F.col("timestamp").rlike(f"^{ISO}\\z"), instant_micros(F.col("timestamp")))})
    level, service, message = (F.col(c) for c in names[1:])
    reason = F.coalesce(
        F.when(~F.col("whole"), "log entry must be an object"),
        timestamp_reason(F.col("timestamp_kind"), F.col("timestamp"), F.col("micros"), now),
        F.when(F.col("level_kind") != "STRING", "level must be debug, info, warn, or error").when(~level.isin(*LEVELS), F.concat(F.lit("invalid level: '"), level, F.lit("'"))),
        F.when((F.col("service_kind") != "STRING") | blank(service), "service must be a non-empty string"),
        F.when((F.col("message_kind") != "STRING") | blank(message), "message must be a non-empty string"),
        F.when(F.col("attributes").isNotNull() & F.col("values").isNull(), "attributes must be a flat object").when(
            F.exists(F.map_values("values"), lambda v: ~_good(v)),
            F.concat(F.lit("invalid attribute '"), _first_bad_key(F.col("values"), F.col("raw")), F.lit("': values must be strings, numbers, or booleans")),
        ),
    )
    return each.select(*more, "index", "raw", "micros", *names[1:], "attributes", "values", reason.alias("reason"))


def validated(checked: DataFrame) -> DataFrame:
    """Checked entries with the types of stored logs, which can be written once and read by all that follows; values of refused entries are null."""
    good = lambda c: F.when(F.col("reason").isNull(), c)
    rows = checked.select(
        *[c for c in ("request_id", "refused", "seq") if c in checked.columns],
        "index",
        "reason",
        "raw",
        good(F.timestamp_micros("micros")).alias("timestamp"),
        *[good(F.col(c)).alias(c) for c in ("level", "service", "message")],
        good(F.coalesce(F.to_json("attributes"), F.lit("{}"))).alias("attributes"),
        good(F.coalesce(texts(F.col("values")), F.create_map().cast("map<string,string>"))).alias("attributes_normalized"),
    )
    return rows.withColumn("day", F.to_date("timestamp"))


def accepted(rows: DataFrame) -> DataFrame:
    """The logs of accepted entries of :func:`validated`, still without ids, with their place in the input."""
    return rows.where("reason IS NULL").drop("reason", "raw", "refused")


def refusals(rows: DataFrame) -> DataFrame:
    """``(request_id, index, reason, raw)`` of refused entries."""
    return rows.where("reason IS NOT NULL AND index IS NOT NULL").select("request_id", F.col("index").cast("int").alias("index"), "reason", "raw")


def rejected(rows: DataFrame) -> DataFrame:
    """:func:`refusals` in input order."""
    return refusals(rows).orderBy("request_id", "index")


def reports(rows: DataFrame) -> DataFrame:
    """One row for each request of checked entries that were made with ``refused``: ``request_id, status, error, accepted, rejected``.

    The status is ``ok``, ``all_invalid`` (nothing is written for it), or ``bad_request`` or ``failed`` with its error.
    """
    entry = F.col("index").isNotNull()
    counts = rows.groupBy("request_id").agg(F.max("refused").alias("error"), F.count_if(entry & F.col("reason").isNull()).alias("accepted"), F.count_if(entry & F.col("reason").isNotNull()).alias("rejected"))
    return outcomes(counts.withColumnRenamed("accepted", "n"))


def outcomes(requests: DataFrame) -> DataFrame:
    """Reports of requests with their ``error``, and ``n`` accepted and ``rejected`` entries; ``failed`` is one whose logs could not be written."""
    status = F.when(F.startswith("error", F.lit(UNWRITABLE)), "failed").when(F.col("error").isNotNull(), "bad_request").when(F.col("n") > 0, "ok").otherwise("all_invalid")
    return requests.select("request_id", status.alias("status"), "error", F.col("n").alias("accepted"), "rejected")
