"""Filters of logs: all optional, joined by AND, with values as data and never as query text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.times import ArgumentError, Instant, parse_instant
from tidelog.schema import LEVELS

# What counts as white space in a blank text.
BLANK = "\\s\\u00a0\\ufeff\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u1680"
_BLANK = re.compile("[ \\t\\n\\r\\x0b\\x0c\\u00a0\\ufeff\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u1680]*")


def is_blank(text: str) -> bool:
    return _BLANK.fullmatch(text) is not None


def blank(text: Column) -> Column:
    return text.rlike(f"^[{BLANK}]*\\z")


@dataclass(frozen=True)
class LogFilters:
    """What a query asks for; construction refuses what the contract refuses, with its reason.

    ``since`` is inclusive, ``until`` exclusive, both ISO texts with a zone. ``attributes`` are pairs of key and text; numbers and booleans are
    matched by their text. ``q`` is searched literally in messages, whatever the case.
    """

    service: str | None = None
    level: str | None = None
    since: str | None = None
    until: str | None = None
    attributes: Sequence[tuple[str, str]] | Mapping[str, str] = ()
    q: str | None = None
    since_at: Instant | None = field(init=False, default=None)
    until_at: Instant | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        pairs = tuple(self.attributes.items()) if isinstance(self.attributes, Mapping) else tuple(tuple(x) for x in self.attributes)
        object.__setattr__(self, "attributes", pairs)
        seen: set[str] = set()
        for key, _ in pairs:
            if is_blank(key):
                raise ArgumentError("attribute filter key must not be empty")
            if key in seen:
                raise ArgumentError(f"duplicate attribute filter: '{key}'")
            seen.add(key)
        if self.service is not None and is_blank(self.service):
            raise ArgumentError("service must be a non-empty string")
        if self.level is not None and self.level not in LEVELS:
            raise ArgumentError(f"invalid level: '{self.level}'")
        for name in ("since", "until"):
            if getattr(self, name) is not None:
                object.__setattr__(self, f"{name}_at", parse_instant(getattr(self, name), name))
        if self.q is not None and is_blank(self.q):
            raise ArgumentError("q must be a non-empty string")
        if self.since_at and self.until_at and self.since_at.milliseconds > self.until_at.milliseconds:
            raise ArgumentError("since must not be after until")


def instant(at: Instant, kind: T.DataType) -> Column:
    """A literal of the same type as the column it is compared with, so that the comparison reaches the scan."""
    literal = F.timestamp_micros(F.lit(at.micros))
    return literal.cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else literal


def day_bound(at: Instant) -> Column:
    return F.to_date(F.timestamp_micros(F.lit(at.micros)))


def conditions(logs: DataFrame, filters: LogFilters) -> list[Column]:
    """The filters as conditions on ``logs``; bounds of time also bound the partition column ``day``, where there is one."""
    kind, by_day = logs.schema["timestamp"].dataType if filters.since_at or filters.until_at else None, "day" in logs.columns
    out = []
    if filters.service is not None:
        out.append(F.col("service") == F.lit(filters.service))
    if filters.level is not None:
        out.append(F.col("level") == F.lit(filters.level))
    if filters.since_at:
        out.append(F.col("timestamp") >= instant(filters.since_at, kind))
        out += [F.col("day") >= day_bound(filters.since_at)] * by_day
    if filters.until_at:
        out.append(F.col("timestamp") < instant(filters.until_at, kind))
        out += [F.col("day") <= day_bound(filters.until_at)] * by_day
    # A stored table may have columns for some attributes, which a scan can skip row groups by.
    own = {f.metadata["attribute"]: f.name for f in logs.schema if "attribute" in (f.metadata or {})} if filters.attributes else {}
    for key, value in filters.attributes:
        out.append((F.col(own[key]) if key in own else F.col("attributes_normalized")[F.lit(key)]) == F.lit(value))
    if filters.q is not None:
        out.append(F.contains(F.lower("message"), F.lower(F.lit(filters.q))))
    return out


def where(logs: DataFrame, filters: LogFilters) -> DataFrame:
    found = conditions(logs, filters)
    return logs.where(reduce(lambda a, b: a & b, found)) if found else logs


def before_position(logs: DataFrame, at: Instant, id_: int) -> DataFrame:
    """Rows that come after the position (instant, id) in newest-first order."""
    kind = logs.schema["timestamp"].dataType
    ts = F.col("timestamp")
    found = logs.where((ts <= instant(at, kind)) & ((ts < instant(at, kind)) | (F.col("id") < F.lit(id_))))
    return found.where(F.col("day") <= day_bound(at)) if "day" in logs.columns else found


def look_back(logs: DataFrame, now: str, hours: int = 2) -> DataFrame:
    """Rows of the ``hours`` before ``now`` (an ISO text), and later ones."""
    since = Instant(parse_instant(now, "now").micros - hours * 3_600_000_000)
    found = logs.where(F.col("timestamp") >= instant(since, logs.schema["timestamp"].dataType))
    return found.where(F.col("day") >= day_bound(since)) if "day" in logs.columns else found
