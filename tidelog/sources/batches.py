"""Which batches of a log table may be read: a file for each, beside the table's days, whose name says all that there is to say.

A batch is ``pending`` from before its first file is written until all its days are there; then its file is renamed, which makes all of it appear at
once. Readers leave out what is pending. Of published batches the newest files stay, as they say which ids are taken; older ones go, so what a
reader lists doesn't grow.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession

#: Beside the days of a table; readers skip names that begin so.
FOLDER = "_batches"
#: Published batches whose files stay.
KEPT = 64


@dataclass(frozen=True)
class Batch:
    """A batch, the ids that it has taken (``rows`` from ``base + 1`` on), the clock that it goes by, and how many logs it writes."""

    run_id: str
    batch_id: int = 0
    base: int = 0
    rows: int = 0
    now: str = ""
    logs: int = 0
    published: bool = False

    @property
    def last(self) -> int:
        return self.base + self.rows

    @property
    def own(self) -> tuple[str, int]:
        return self.run_id, self.batch_id

    @property
    def name(self) -> str:
        return ",".join((f"{self.last:020d}", str(self.base), str(self.rows), str(self.logs), str(self.batch_id), quote(self.now, safe=""), quote(self.run_id, safe=""))) + (".published" if self.published else ".pending")

    @classmethod
    def of(cls, name: str) -> Batch | None:
        head, _, state = name.rpartition(".")
        parts = head.split(",")
        if state not in ("published", "pending") or len(parts) != 7:
            return None
        _, base, rows, logs, batch_id, now, run_id = parts
        return cls(unquote(run_id), int(batch_id), int(base), int(rows), unquote(now), int(logs), state == "published")


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path, FOLDER)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def noted(spark: SparkSession, path: str) -> list[Batch]:
    """The batches that there are files for: all that are pending, and the newest that are published."""
    files, place = _folder(spark, path)
    names = [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
    found = [b for b in map(Batch.of, names) if b]
    waiting = {b.own for b in found if not b.published}
    # Where renaming is a copy, a batch that is still pending may be there twice.
    return [b for b in found if not b.published or b.own not in waiting]


def find(batches: list[Batch], run_id: str, batch_id: int) -> Batch | None:
    return next((b for b in batches if b.own == (run_id, batch_id)), None)


def _file(spark: SparkSession, path: str, batch: Batch):
    return spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{FOLDER}/{batch.name}")


def begin(spark: SparkSession, path: str, batch: Batch) -> Batch:
    """Note that ``batch`` is pending, with what it has taken; what was noted of it before goes."""
    files, _ = _folder(spark, path)
    pending = replace(batch, published=False)
    if pending not in (before := [b for b in noted(spark, path) if b.own == batch.own]):
        files.create(_file(spark, path, pending), True).close()
    for old in before:
        if old != pending:
            files.delete(_file(spark, path, old), False)
    return pending


def publish(spark: SparkSession, path: str, batch: Batch) -> Batch:
    """Let readers see a pending batch."""
    files, _ = _folder(spark, path)
    done = replace(batch, published=True)
    pending = _file(spark, path, batch)
    if not files.exists(pending) or not files.rename(pending, _file(spark, path, done)):
        raise OSError(f"batch {batch.batch_id} of {batch.run_id} is not pending")
    old = sorted((b for b in noted(spark, path) if b.published), key=lambda b: b.last)[:-KEPT]
    for b in old:
        files.delete(_file(spark, path, b), False)
    return done


def last_id(batches: list[Batch]) -> int:
    return max((b.last for b in batches), default=0)
