"""The log table: Parquet in folders by day, and by the run and batch that wrote them; beside it, in folders of the same kind, its counts by minute."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.times import day_of
from tidelog.schema import LOGS, STORED
from tidelog.sources import batches, notes
from tidelog.sources.batches import Batch
from tidelog.sources.files import files_at

#: A batch that is written again replaces its own folders and nothing else.
LAYOUT = ("day", "run_id", "batch_id")
#: Beside the days of a table; readers of logs skip names that begin so.
COUNTS = "_counts"
COUNTED = T.StructType([T.StructField("minute", T.LongType()), T.StructField("service", T.StringType()), T.StructField("level", T.StringType()), T.StructField("n", T.LongType()), *(STORED[c] for c in LAYOUT)])
MINUTE = 60_000_000
#: Beside the days: what a trim is about to move into a day, in folders by kind and then as in the table.
STAGING = "_trim"
#: Beside the days: attributes that have a column of their own.
KEYS = "_keys"


def key_columns(spark: SparkSession, path: str) -> list[T.StructField]:
    """The columns of attributes that have one; each says in its metadata which attribute it is."""
    return [T.StructField(f"attribute_{i}", T.StringType(), metadata={"attribute": key}) for i, key in enumerate(notes.read(spark, f"{path}/{KEYS}") or ())]


def promote(spark: SparkSession, path: str, keys: Iterable[str]) -> None:
    """Give attributes a column of their own in a table that has no rows yet (:func:`retention.backfill_normalized` moves rows to such a table).

    Filters on them then read that column alone, and skip row groups that can't have the value.
    """
    if list_days(spark, path):
        raise ValueError("a table that has rows can't be given columns")
    notes.write(spark, f"{path}/{KEYS}", list(dict.fromkeys(keys)))


def read_stored(spark: SparkSession, path: str, days: Iterable[date] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """All rows, those of pending batches too; with ``days``, only the folders of these are listed, and one that isn't there has no rows."""
    schema = schema or T.StructType([*LOGS.fields[:-1], *key_columns(spark, path), *STORED.fields[len(LOGS.fields) - 1 :]])
    reader = spark.read.schema(schema)
    if days is None:
        return reader.parquet(path)
    folders = [f for f in (f"{path}/day={d:%Y-%m-%d}" for d in days) if is_there(spark, f)]
    return reader.option("basePath", path).parquet(*folders) if folders else spark.createDataFrame([], schema)


def without(rows: DataFrame, hidden: Iterable[tuple[str, int]]) -> DataFrame:
    """``rows`` of a table in folders by run and batch without those of the named batches, whose folders aren't read."""
    for run_id, batch_id in sorted(hidden):
        rows = rows.where(~((F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)))
    return rows


def list_days(spark: SparkSession, path: str) -> list[date]:
    """Days that the table has folders for, ascending; other names are ignored."""
    files, place = files_at(spark, path)
    names = [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
    found = (day_of("logs_" + n[4:].replace("-", "_")) for n in names if n.startswith("day="))
    return sorted(d for d in found if d)


def is_there(spark: SparkSession, path: str) -> bool:
    files, place = files_at(spark, path)
    return files.exists(place)


def day_bytes(spark: SparkSession, path: str, day: date) -> int:
    """The size of a day's files."""
    files, place = files_at(spark, f"{path}/day={day:%Y-%m-%d}")
    return files.getContentSummary(place).getLength()


def _published(spark: SparkSession, path: str, read: Callable[[], DataFrame], at: list[Batch] | None) -> DataFrame:
    """What ``read`` lists of published batches.

    Batches are looked up before and after the files: one that began or was published in between may have been listed in part, and is left out.
    """
    before = batches.noted(spark, path) if at is None else at
    rows = read()
    after = batches.noted(spark, path)
    seen = {b.own for b in before if b.published}
    return without(rows, {b.own for b in (*before, *after) if not b.published} | {b.own for b in after if b.own not in seen})


def read_logs(spark: SparkSession, path: str, days: Iterable[date] | None = None, at: list[Batch] | None = None) -> DataFrame:
    """The rows of published batches; with ``at``, of those that had been published when :func:`batches.noted` gave that."""
    return _published(spark, path, lambda: read_stored(spark, path, days), at)


def read_counts(spark: SparkSession, path: str, days: Iterable[date], at: list[Batch] | None = None) -> DataFrame:
    """``(minute, service, level, n, ...)``: the logs of published batches by minute, in microseconds since 1970, as each batch has counted them."""
    return _published(spark, path, lambda: read_stored(spark, f"{path}/{COUNTS}", days, COUNTED), at)


def minute_of(ts: Column) -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    return micros - F.pmod(micros, F.lit(MINUTE))


def write_counts(rows: DataFrame, path: str) -> None:
    """Write the counts of rows of the table to their batches' folders."""
    counts = rows.groupBy(*LAYOUT, minute_of(F.col("timestamp")).alias("minute"), "service", "level").agg(F.count("*").alias("n"))
    counts.select(*COUNTED.fieldNames()).hint("rebalance", "day").write.mode("append").partitionBy(*LAYOUT).parquet(path)


def write_logs(logs: DataFrame, path: str, run_id: str, batch_id: int = 0) -> None:
    """Write the rows of a batch to its folders, and their counts. No rows are no change.

    Rows are rebalanced by day, which splits a day that holds most of them, and sorted so that row groups can be skipped by service and time.
    """
    rows = logs.select(*LOGS.fieldNames()).withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id).cast("long")})
    laid_out = rows.hint("rebalance", "day").sortWithinPartitions(*LAYOUT, "service", "timestamp")
    at_once(lambda: write_rows(laid_out, path), lambda: write_counts(rows, f"{path}/{COUNTS}"))


def write_rows(rows: DataFrame, path: str) -> None:
    """Append rows that have all columns of the layout, with the columns of attributes that the table has."""
    keys = key_columns(rows.sparkSession, path)
    shown = [*LOGS.fieldNames()[:-1], *LAYOUT]
    writer = rows.select(*shown, *[F.col("attributes_normalized")[F.lit(f.metadata["attribute"])].alias(f.name) for f in keys]).write.mode("append").partitionBy(*LAYOUT)
    for f in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{f.name}", "true")
    writer.parquet(path)


def at_once(*jobs: Callable[[], None]) -> None:
    """Run jobs that don't need each other side by side; when all have ended, the first failure is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def append_logs(logs: DataFrame, path: str, run_id: str, batch_id: int = 0) -> None:
    """Write a batch and publish it: all its days appear at once, in place of what it wrote before, if it did. Its largest id is noted, so that ingest goes on from there."""
    spark = logs.sparkSession
    batches.begin(spark, path, batches.find(batches.noted(spark, path), run_id, batch_id) or Batch(run_id, batch_id))
    drop_batch(spark, path, run_id, batch_id)
    write_logs(logs, path, run_id, batch_id)
    own = read_stored(spark, path).where((F.col("run_id") == run_id) & (F.col("batch_id") == batch_id))
    last, n = own.agg(F.max("id"), F.count("*")).first()
    batches.publish(spark, path, batches.begin(spark, path, Batch(run_id, batch_id, 0, max(last or 0, 0), "", n)))


def drop_batch(spark: SparkSession, path: str, run_id: str, batch_id: int) -> None:
    """Delete what a batch has written to a table in folders by run and batch, or by day and these: an overwrite leaves folders for which it has no rows.

    What a trim that was cut off has kept of it goes too.
    """
    jvm = spark._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    top = jvm.org.apache.hadoop.fs.Path(path)
    files, own = top.getFileSystem(spark._jsc.hadoopConfiguration()), f"run_id={escape(run_id)}/batch_id={batch_id}"
    days = [x.getPath() for x in files.listStatus(top) if x.getPath().getName().startswith("day=")] if files.exists(top) else []
    for folder in (top, *days):
        files.delete(jvm.org.apache.hadoop.fs.Path(folder, own), True)
    trims = jvm.org.apache.hadoop.fs.Path(top, STAGING)
    more = [jvm.org.apache.hadoop.fs.Path(x.getPath(), kind) for x in (files.listStatus(trims) if files.exists(trims) else []) for kind in ("new", "counts")]
    for place in (jvm.org.apache.hadoop.fs.Path(top, COUNTS), *more):
        if files.exists(place):
            drop_batch(spark, place.toString(), run_id, batch_id)


def from_events(events: DataFrame) -> DataFrame:
    """The event table as logs; instants stay as they are, without a zone."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "signup", "warn").when(kind.isin("purchase", "click"), "info").otherwise("debug")
    return events.select(
        (F.col("event_id") + 1).alias("id"),
        F.col("ts").alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
        F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        F.col("props").alias("attributes"),
    )
