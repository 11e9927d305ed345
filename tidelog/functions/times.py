"""Instants, their text, buckets and UTC days."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths in seconds of the buckets that counts may ask for.
BUCKETS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86_400}
ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})"
_ISO = re.compile(ISO, re.ASCII)
# What follows an instant's name when it breaks a rule, in the order of the rules.
INSTANT_REASONS = {
    "type": "is required and must be a string",
    "form": "must be a valid ISO 8601 date-time with timezone",
    "month": "contains an invalid month",
    "day": "contains an invalid day",
    "hour": "contains an invalid hour",
    "minute": "contains an invalid minute",
    "second": "contains an invalid second",
    "offset": "contains an invalid timezone offset",
    "future": "cannot be more than 5 minutes in the future",
}
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
DAY_MICROS = 86_400_000_000


class ArgumentError(ValueError):
    """An argument that a query refuses; its text is the reason."""


def micros_text(ts: Column) -> Column:
    """UTC text with six digits after the second. The session's zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def seconds_text(ts: Column) -> Column:
    """UTC text to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bucket_start(ts: Column, bucket: str) -> Column:
    """Microseconds since 1970, UTC, at the start of the bucket that holds ``ts``; buckets are aligned to 1970."""
    micros, width = F.unix_micros(ts.cast("timestamp")), F.lit(BUCKETS[bucket] * 1_000_000)
    return micros - F.pmod(micros, width)


def start_of_day(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def add_days(day: Column, days: int) -> Column:
    if isinstance(days, bool) or not isinstance(days, int):
        raise ArgumentError("UTC day offset must be an integer")
    return F.date_add(day, days)


def day_label(day: Column) -> Column:
    """``logs_YYYY_MM_DD``"""
    return F.concat(F.lit("logs_"), F.date_format(day, "yyyy_MM_dd"))


def day_of_label(label: Column) -> Column:
    """The inverse of :func:`day_label`; null for other names and impossible dates."""
    return F.when(label.rlike(r"^logs_\d{4}_\d{2}_\d{2}\z"), F.to_date(F.try_to_timestamp(F.substring(label, 6, 10), F.lit("yyyy_MM_dd"))))


def day_of(name: str) -> date | None:
    """The day of a label; None for other names and impossible dates."""
    if not re.fullmatch(r"logs_\d{4}_\d{2}_\d{2}", name, re.ASCII):
        return None
    try:
        return date(int(name[5:9]), int(name[10:12]), int(name[13:15]))
    except ValueError:
        return None


@dataclass(frozen=True)
class Instant:
    """Microseconds since 1970, exact also for years that ``datetime`` has not."""

    micros: int

    @property
    def milliseconds(self) -> int:
        return self.micros // 1000


def parse_instant(text: object, name: str) -> Instant:
    """An argument's ISO 8601 instant with zone; :class:`ArgumentError` gives the first rule that it breaks."""

    def refuse(rule: str, broken: bool) -> None:
        if broken:
            raise ArgumentError(f"{name} {INSTANT_REASONS[rule]}")

    refuse("type", not isinstance(text, str))
    refuse("form", not _ISO.fullmatch(text))
    year, month, day, hour, minute, second = (int(text[i:j]) for i, j in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19)))
    refuse("month", not 1 <= month <= 12)
    leap = calendar.isleap(year)
    refuse("day", not 1 <= day <= (29 if month == 2 and leap else 28 if month == 2 else 30 if month in (4, 6, 9, 11) else 31))
    for value, most, unit in ((hour, 23, "hour"), (minute, 59, "minute"), (second, 59, "second")):
        refuse(unit, value > most)
    offset = 0
    if not text.endswith("Z"):
        hours, minutes = int(text[-5:-3]), int(text[-2:])
        refuse("offset", hours > 23 or minutes > 59)
        offset = (hours * 60 + minutes) * (1 if text[-6] == "+" else -1)
    zone = 1 if text.endswith("Z") else 6
    fraction = text[20:-zone] if text[19] == "." else ""
    # 400 years have a whole number of days, so year 0 is counted as year 400.
    local = datetime(year or 400, month, day, hour, minute, second, tzinfo=timezone.utc) - EPOCH
    micros = (local // timedelta(seconds=1) - (0 if year else 146_097 * 86_400) - offset * 60) * 1_000_000 + int(fraction.ljust(6, "0") or 0)
    return Instant(micros)
