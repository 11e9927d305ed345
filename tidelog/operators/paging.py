"""Newest-first pages, resumed by position."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.cursor import page_token
from tidelog.functions.times import DAY_MICROS, EPOCH, ArgumentError, Instant, micros_text, parse_instant
from tidelog.operators.filters import LogFilters, before_position, instant, look_back, where
from tidelog.sources import batches
from tidelog.sources.logs import day_bytes, list_days, read_logs

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
COLUMNS = ("id", "timestamp", "level", "service", "message", "attributes")
SHOWN = T.StructType([T.StructField(c, T.LongType() if c == "id" else T.StringType()) for c in (*COLUMNS, "cursor")])
#: What a page reads of a day at first, about.
SLICE_BYTES = 512 << 20


@dataclass(frozen=True)
class PageSpec:
    """How many rows, and the position (ISO text, id) that the page comes after."""

    limit: int = DEFAULT_LIMIT
    after: tuple[str, int] | None = None

    def __post_init__(self) -> None:
        if isinstance(self.limit, bool) or not isinstance(self.limit, int) or not 1 <= self.limit <= MAX_LIMIT:
            raise ArgumentError("limit must be an integer between 1 and 1000")


def newest(logs: DataFrame) -> DataFrame:
    """All rows, newest first; equal instants by falling id."""
    return logs.orderBy(F.desc("timestamp"), F.desc("id"))


def page(logs: DataFrame, filters: LogFilters = LogFilters(), spec: PageSpec = PageSpec(), extra: int = 0) -> DataFrame:
    """One page: the query columns, instants as text, and each row's position as ``cursor``. ``extra`` rows may look ahead."""
    found = where(logs, filters)
    if spec.after:
        found = before_position(found, parse_instant(spec.after[0], "cursor"), spec.after[1])
    top = newest(found).limit(spec.limit + extra)
    return top.select("id", micros_text(F.col("timestamp")).alias("timestamp"), *COLUMNS[2:], page_token(F.col("timestamp"), F.col("id")).alias("cursor"))


def read_page(logs: DataFrame, filters: LogFilters = LogFilters(), spec: PageSpec = PageSpec()) -> tuple[list[Row], tuple[str, int] | None]:
    """The rows of a page and the position for the next one, None on the last. At most ``limit + 1`` rows reach the driver."""
    return _cut(page(logs, filters, spec, extra=1).collect(), spec)


def _cut(rows: list[Row], spec: PageSpec) -> tuple[list[Row], tuple[str, int] | None]:
    rows.sort(key=lambda r: (r["timestamp"], r["id"]), reverse=True)
    kept = rows[: spec.limit]
    return kept, (kept[-1]["timestamp"], kept[-1]["id"]) if len(rows) > spec.limit else None


def spans(days: list[date], slices: int = 1) -> Iterator[tuple[list[date], int | None]]:
    """(days, first microsecond) in which a page is looked for: the newest day from its end back, in ``slices`` of which ever more are taken, then runs of 2, 4, 8 days ..."""
    days = sorted(days, reverse=True)
    if not days:
        return
    midnight, taken = (days[0] - EPOCH.date()).days * DAY_MICROS, 1
    while taken < slices:
        yield days[:1], midnight + DAY_MICROS * (slices - taken) // slices
        taken *= 4
    yield days[:1], None
    at, n = 1, 2
    while at < len(days):
        yield days[at : at + n], None
        at, n = at + n, 2 * n


def _stored_rows(spark: SparkSession, path: str, filters: LogFilters, spec: PageSpec, extra: int) -> list[Row]:
    """The first rows of a page over a stored table, with its snapshot taken once."""
    noted, after = batches.noted(spark, path), parse_instant(spec.after[0], "cursor") if spec.after else None
    day = lambda at: date.fromordinal(EPOCH.toordinal() + at.micros // DAY_MICROS)
    low, high = filters.since_at, min((x for x in (filters.until_at, after) if x), default=None, key=lambda x: x.micros)
    days = [d for d in list_days(spark, path) if (not low or d >= day(low)) and (not high or d <= day(high))]
    slices = -(-day_bytes(spark, path, max(days)) // SLICE_BYTES) if days else 1
    rows: list[Row] = []
    wanted, edge = spec.limit + extra, None
    for own, since in spans(days, slices):
        found = read_logs(spark, path, own, noted)
        for bound, keep in ((since, lambda ts, x: ts >= x), (edge, lambda ts, x: ts < x)):
            if bound is not None:
                found = found.where(keep(F.col("timestamp"), instant(Instant(bound), found.schema["timestamp"].dataType)))
        # What the newer spans have given is left out of what this one may.
        rows += page(found, filters, spec, extra - len(rows)).collect()
        if len(rows) >= wanted:
            break
        edge = since
    return rows


def stored_page(spark: SparkSession, path: str, filters: LogFilters = LogFilters(), spec: PageSpec = PageSpec(), extra: int = 0) -> DataFrame:
    """The same rows as :func:`page` over the table at ``path``, of which no more days are read than it takes, from the newest on.

    Days that bounds or position shut out aren't looked at. A large newest day is read from its end back. At most ``limit + extra`` rows reach the driver.
    """
    return spark.createDataFrame(_stored_rows(spark, path, filters, spec, extra), SHOWN)


def read_stored_page(spark: SparkSession, path: str, filters: LogFilters = LogFilters(), spec: PageSpec = PageSpec()) -> tuple[list[Row], tuple[str, int] | None]:
    """:func:`read_page` over the table at ``path``, read as by :func:`stored_page`."""
    return _cut(_stored_rows(spark, path, filters, spec, 1), spec)


def newest_of_service(logs: DataFrame, service: str, now: str, hours: int = 2, limit: int = 100) -> DataFrame:
    """The newest rows of a service in a look-back range."""
    return page(look_back(logs, now, hours), LogFilters(service=service), PageSpec(limit)).drop("cursor")


def newest_with_attribute(logs: DataFrame, key: str, value: str, now: str, hours: int = 2, limit: int = 100) -> DataFrame:
    """``id, timestamp, service`` of the newest rows with an attribute in a look-back range."""
    found = where(look_back(logs, now, hours), LogFilters(attributes=((key, value),)))
    return newest(found).limit(limit).select("id", micros_text(F.col("timestamp")).alias("timestamp"), "service")
