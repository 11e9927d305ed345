"""Days of the log table: what is kept, dropped, trimmed and admitted."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.times import EPOCH, ArgumentError, day_of, parse_instant
from tidelog.schema import LOGS
from tidelog.sources import notes
from tidelog.sources.files import files_at
from tidelog.sources.logs import COUNTS, STAGING, key_columns, list_days, promote, read_logs, read_stored, write_counts, write_rows

DAY = timedelta(days=1)
#: Beside the days of a table; readers skip names that begin so.
PLAN = "_plan"


@dataclass(frozen=True)
class Retention:
    """Days to keep (1 to 3650) and to open ahead (1 to 31)."""

    keep_days: int = 30
    ahead_days: int = 7

    def __post_init__(self) -> None:
        for name, most in (("keep_days", 3650), ("ahead_days", 31)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
                raise ArgumentError(f"{name} must be an integer between 1 and {most}")


def _moment(now: str) -> datetime:
    return EPOCH + timedelta(microseconds=parse_instant(now, "now").micros)


def cutoff(now: str, policy: Retention) -> datetime:
    """Whole days of 24 hours before ``now``."""
    return _moment(now) - policy.keep_days * DAY


def day_window(now: str, policy: Retention) -> tuple[date, date]:
    """First and last day that rows may have: from the cutoff's day through today and the days ahead."""
    return cutoff(now, policy).date(), (_moment(now) + policy.ahead_days * DAY).date()


def label(day: date) -> str:
    return f"logs_{day:%Y_%m_%d}"


def kept(logs: DataFrame, at: datetime) -> DataFrame:
    """Rows that a cutoff keeps; the row at the cutoff itself is kept."""
    return logs.where((F.col("timestamp") >= F.lit(at)) & (F.col("day") >= F.lit(at.date())))


def expired_days(spark: SparkSession, path: str, at: datetime) -> list[date]:
    """Days of the table that end at or before the cutoff, ascending."""
    return [d for d in list_days(spark, path) if datetime(d.year, d.month, d.day, tzinfo=timezone.utc) + DAY <= at]


def drop_expired_days(spark: SparkSession, path: str, at: datetime) -> list[str]:
    """Delete the folders of days that end at or before the cutoff; no rows are read. Labels in order."""
    files, _ = files_at(spark, path)
    gone = expired_days(spark, path, at)
    for d in gone:
        for top in (path, f"{path}/{COUNTS}"):
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{top}/day={d:%Y-%m-%d}"), True)
    return [label(d) for d in gone]


def _move(files, place, source: str, target: str) -> None:
    """Move a file to a place whose folder may not be there yet; if it has been moved before, that is all right."""
    if not files.exists(place(source)) and files.exists(place(target)):
        return
    files.mkdirs(place(target).getParent())
    if not files.rename(place(source), place(target)):
        raise OSError(f"{source} could not be moved to {target}")


def _files_below(files, place, folder: str) -> list[str]:
    """The data files below a folder, named from there."""
    out, found = [], files.listFiles(place(folder), True) if files.exists(place(folder)) else None
    top = files.makeQualified(place(folder)).toUri().getPath()
    while found is not None and found.hasNext():
        name = found.next().getPath().toUri().getPath().removeprefix(f"{top}/")
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            out.append(name)
    return sorted(out)


def _swap(spark: SparkSession, path: str, name: str) -> int:
    """Finish the trim of a day that has been decided: the files that it replaces go out, those that replace them come in. The rows that this deletes."""
    files, _ = files_at(spark, path)
    hadoop = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    staging = f"{path}/{STAGING}/{name}"
    decided = notes.read(spark, f"{staging}/decided")
    for kind, folder in (("new", f"{path}/{name}"), ("counts", f"{path}/{COUNTS}/{name}")):
        for f in decided["replaced"][kind]:
            source, target = f"{folder}/{f}", f"{staging}/old/{kind}/{f}"
            # One that is nowhere was of a batch that has been written again since, which has deleted what was to replace it.
            if files.exists(hadoop(source)) or files.exists(hadoop(target)):
                _move(files, hadoop, source, target)
        for f in _files_below(files, hadoop, f"{staging}/{kind}/{name}"):
            _move(files, hadoop, f"{staging}/{kind}/{name}/{f}", f"{folder}/{f}")
        if not _files_below(files, hadoop, folder):
            files.delete(hadoop(folder), True)
    return decided["deleted"]


def recover(spark: SparkSession, path: str) -> dict[str, int]:
    """Finish trims that were cut off; the rows that each of these days has lost by it. They are forgotten with :func:`forget`.

    A trim writes what survives of the files that it replaces beside the table, decides with a note that names them, and moves files. Before the note
    the day is as it was, and what is beside the table goes; after it, moving goes on where it stopped.
    """
    files, place = files_at(spark, f"{path}/{STAGING}")
    found = {}
    for day in files.listStatus(place) if files.exists(place) else []:
        name = day.getPath().getName()
        if notes.read(spark, f"{path}/{STAGING}/{name}/decided") is None:
            forget(spark, path, name)
        else:
            found[name] = _swap(spark, path, name)
    return found


def forget(spark: SparkSession, path: str, name: str) -> None:
    """Delete what the trim of a day has left beside the table."""
    files, place = files_at(spark, f"{path}/{STAGING}/{name}")
    files.delete(place, True)


def _decide(spark: SparkSession, path: str, at: datetime) -> str | None:
    """Ready the trim of the cutoff's day, up to its note; the day's folder, or None if nothing in it is old.

    A file's statistics say whether it holds anything old, so files that begin at the cutoff or later aren't read, and stay where they are.
    """
    day = at.date()
    if day not in list_days(spark, path):
        return None
    name = f"day={day:%Y-%m-%d}"
    rows = read_stored(spark, path, [day])
    old = rows.where(F.col("timestamp") < F.lit(at)).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
    if not old:
        return None
    files, _ = files_at(spark, path)
    staging, folder = f"{path}/{STAGING}/{name}", spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    top = files.makeQualified(folder).toUri().getPath()
    whole = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["f"])) for r in old]
    replaced = [p.toUri().getPath().removeprefix(f"{top}/") for p in whole]
    among = rows.where(F.col("_metadata.file_path").isin([r["f"] for r in old]) & (F.col("timestamp") >= F.lit(at)))
    keys = [f.metadata["attribute"] for f in key_columns(spark, path)]
    if keys:
        promote(spark, f"{staging}/new", keys)
    write_rows(among, f"{staging}/new")
    # The day is counted anew, from four columns of it.
    write_counts(rows.where(F.col("timestamp") >= F.lit(at)), f"{staging}/counts")
    counted = _files_below(files, lambda p: spark._jvm.org.apache.hadoop.fs.Path(p), f"{path}/{COUNTS}/{name}")
    notes.write(spark, f"{staging}/decided", {"replaced": {"new": replaced, "counts": counted}, "deleted": sum(r["count"] for r in old)})
    return name


def trim_cutoff_day(spark: SparkSession, path: str, at: datetime) -> int:
    """Delete the rows of the cutoff's day that are before it; the number deleted.

    Only files that hold such rows are written anew, in their batches' folders. A trim that is cut off at any point loses nothing once :func:`recover` has run,
    which this does first. Not while something else writes those files.
    """
    for name in recover(spark, path):
        forget(spark, path, name)
    name = _decide(spark, path, at)
    if not name:
        return 0
    deleted = _swap(spark, path, name)
    forget(spark, path, name)
    return deleted


def outside_window(logs: DataFrame, now: str, policy: Retention) -> DataFrame:
    """Rows whose day isn't open."""
    first, last = day_window(now, policy)
    return logs.where(~F.col("day").between(F.lit(first), F.lit(last)))


def admit(logs: DataFrame, now: str, policy: Retention) -> DataFrame:
    """``logs`` if the day of every row is open; :class:`ArgumentError` names the first that isn't."""
    bad = outside_window(logs, now, policy).select("day").limit(1).collect()
    if bad:
        raise ArgumentError(f"no partition of logs for {label(bad[0]['day'])}")
    return logs


def maintain(spark: SparkSession, path: str, now: str, policy: Retention, known: list[date] | None = None) -> DataFrame:
    """One run: open days, drop expired ones, trim the cutoff's day; its report as one row.

    What a run means to do is noted before it does anything, and each step as it is done. A run that is cut off is finished by the next, whose
    report has all that both did: days that either dropped, and rows that either deleted.
    Days need no folder to be open; those reported as created are the window's days beyond ``known`` (by default the days that have rows).
    """
    folder, at = f"{path}/{PLAN}", cutoff(now, policy)
    first, last = day_window(now, policy)
    have = set(list_days(spark, path) if known is None else known)
    before = notes.read(spark, folder) or {"created": [], "dropped": [], "deleted": 0, "trimmed": []}
    plan = {
        "created": sorted({*before["created"], *(label(d) for d in (first + i * DAY for i in range((last - first).days + 1)) if d not in have)}),
        "dropped": sorted({*before["dropped"], *map(label, expired_days(spark, path, at))}),
        "deleted": before["deleted"],
        # Trims that are counted already; what they left may be there still.
        "trimmed": before["trimmed"],
    }
    notes.write(spark, folder, plan)

    def count(name: str, deleted: int) -> None:
        if name not in plan["trimmed"]:
            plan["deleted"] += deleted
            plan["trimmed"] = [*plan["trimmed"], name]
            notes.write(spark, folder, plan)
        forget(spark, path, name)
        plan["trimmed"] = [x for x in plan["trimmed"] if x != name]

    for name, deleted in recover(spark, path).items():
        count(name, deleted)
    if before["trimmed"]:  # all that was left is gone now
        plan["trimmed"] = []
        notes.write(spark, folder, plan)
    drop_expired_days(spark, path, at)
    name = _decide(spark, path, at)
    if name:
        count(name, _swap(spark, path, name))
    notes.clear(spark, folder)
    schema = "cutoff timestamp, createdPartitions array<string>, droppedPartitions array<string>, deletedCutoffRows long"
    return spark.createDataFrame([(at, plan["created"], plan["dropped"], plan["deleted"])], schema)


def backfill_normalized(spark: SparkSession, path: str, target: str, days_at_once: int = 16, keys: tuple[str, ...] = ()) -> None:
    """Rewrite a table to ``target`` with normalized attributes made anew; an empty object gives an empty map. ``keys`` get columns there (:func:`logs.promote`).

    Days are rewritten in runs, which are noted in ``target`` as they are done: a backfill that was cut off goes on with the first that isn't.
    """
    from tidelog.functions.attributes import normalized

    folder, days = f"{target}/{PLAN}", list_days(spark, path)
    done = notes.read(spark, folder) or []
    left = [d for d in days if d.isoformat() not in done]
    if keys and not list_days(spark, target):
        promote(spark, target, keys)
    empty = F.create_map().cast(LOGS["attributes_normalized"].dataType)
    for run in (left[i : i + days_at_once] for i in range(0, len(left), days_at_once)):
        for d in run:
            for top in (target, f"{target}/{COUNTS}"):
                files, place = files_at(spark, f"{top}/day={d:%Y-%m-%d}")
                files.delete(place, True)
        rows = read_logs(spark, path, run).withColumn("attributes_normalized", F.coalesce(normalized(F.col("attributes")), empty))
        write_rows(rows, target)
        write_counts(rows, f"{target}/{COUNTS}")
        done = [*done, *(d.isoformat() for d in run)]
        notes.write(spark, folder, done)
