"""Ingest of request files, as one batch or as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.times import ArgumentError, day_label
from tidelog.operators import validate
from tidelog.operators.admission import beyond, microbatches
from tidelog.operators.ids import numbered_as_stored, running_sums
from tidelog.operators.retention import Retention, day_window
from tidelog.schema import LOGS
from tidelog.scratch import Scope
from tidelog.sources import batches
from tidelog.sources.batches import Batch
from tidelog.sources.logs import at_once, drop_batch, read_logs, without, write_logs

OVERLOADED = "too many logs are waiting"
SHUT = "timestamp is outside the days that are kept"
#: What becomes of rows whose day isn't open: they fail the whole batch, or their micro-batch, or are refused by themselves.
EARLY = ("fail", "microbatch", "reject")


@dataclass(frozen=True)
class Places:
    """Where ingest writes: logs, refused entries, and reports of requests."""

    logs: str
    rejected: str
    reports: str


def _write(df: DataFrame, path: str, run_id: str, batch_id: int) -> None:
    rows = df.withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id).cast("long")})
    rows.write.mode("append").partitionBy("run_id", "batch_id").parquet(path)


def committed(spark: SparkSession, places: Places) -> DataFrame:
    """The logs of batches that have been written to the end, across days; :func:`read_logs` returns no others."""
    return read_logs(spark, places.logs)


def read_reports(spark: SparkSession, places: Places) -> DataFrame:
    """The reports of published batches: a request is told what became of it when its logs can be read."""
    before = {b.own for b in batches.noted(spark, places.logs) if not b.published}
    return without(spark.read.parquet(places.reports), before)


def waiting(spark: SparkSession, places: Places, but: tuple[str, int] | None = None) -> int:
    """How many logs are accepted and not published yet, other than those of the named batch."""
    return sum(b.logs for b in batches.noted(spark, places.logs) if not b.published and b.own != but)


def limited(parsed: DataFrame, most_logs: int) -> DataFrame:
    """Requests of :func:`validate.requests`, first come first served: those that end beyond ``most_logs`` entries are refused, none is taken in part."""
    size = F.when(F.col("refused").isNull(), F.size("logs")).otherwise(0)
    before = running_sums(parsed.select("request_id", size.cast("long").alias("entries")), ("request_id",), {"before": "entries"})
    over = before.where((F.col("before") + F.col("entries") > most_logs) & (F.col("entries") > 0)).select("request_id", F.lit(OVERLOADED).alias("over"))
    return parsed.join(over, "request_id", "left").withColumn("refused", F.coalesce("refused", "over")).drop("over")


def _open(now: str, policy: Retention) -> Column:
    first, last = day_window(now, policy)
    return F.col("day").between(F.lit(first), F.lit(last))


def _sizes(staged: DataFrame) -> DataFrame:
    """A row for each request: what it is refused for as a whole, and how many of its entries are accepted and rejected."""
    entry = F.col("index").isNotNull()
    return staged.groupBy("seq", "request_id").agg(F.max("refused").alias("error"), F.count_if("taken").alias("n"), F.count_if(entry & ~F.col("taken")).alias("rejected"))


def _failing(staged: DataFrame, requests: DataFrame, numbers: DataFrame, shut: Column, scope: Scope) -> DataFrame:
    """``(seq, failure)`` of the requests of micro-batches that have a row whose day isn't open, named by the first such row."""
    bad = staged.where(F.col("taken") & shut).groupBy("seq").agg(F.min_by("day", "index").alias("day"))
    numbers = scope.stored(numbers, "microbatches")
    first = bad.join(numbers, "seq").groupBy("microbatch").agg(F.min_by("day", "seq").alias("day"))
    return numbers.join(first, "microbatch").select("seq", F.concat(F.lit(validate.UNWRITABLE), day_label(F.col("day"))).alias("failure"))


def stage_batch(bodies: DataFrame, places: Places, now: str, run_id: str, batch_id: int = 0, policy: Retention | None = None, early_days: str = "fail", most_logs: int | None = None, logs_per_batch: int | None = None) -> Batch:
    """All of :func:`ingest_batch` but the end: logs, refused entries and reports are written, and no reader sees them before :func:`publish_batch`.

    Until then its logs count as waiting for other batches' ``most_logs``.
    """
    if early_days not in EARLY or (early_days == "microbatch" and not logs_per_batch):
        raise ValueError(f"early_days must be one of {', '.join(EARLY)}, and micro-batches need logs_per_batch")
    spark = bodies.sparkSession
    seen = batches.noted(spark, places.logs)
    own = batches.find(seen, run_id, batch_id)
    now = own.now if own and own.now else now
    with Scope(spark) as scope:
        # Parsed, checked and written once, in the order of arrival, accepted entries apart from the rest.
        checked = validate.validated(validate.with_reasons(validate.entries(validate.requests(bodies, in_order=True), refused=True), now))
        shut = ~_open(now, policy) if policy else F.lit(False)
        reason = F.when(F.col("reason").isNull() & shut, SHUT).otherwise(F.col("reason")) if early_days == "reject" else F.col("reason")
        checked = checked.withColumn("reason", reason).withColumn("taken", F.col("index").isNotNull() & F.col("reason").isNull())
        path = scope.place("entries")
        checked.sortWithinPartitions("taken", "seq", "index").write.partitionBy("taken").parquet(path)
        staged = spark.read.schema(checked.schema).parquet(path)
        early = staged.where(F.col("taken") & shut).select(day_label(F.col("day"))).limit(1).collect() if policy and early_days != "reject" else []
        if early and early_days == "fail":
            raise ArgumentError(f"{validate.UNWRITABLE}{early[0][0]}")

        (logs, count), refused = numbered_as_stored(staged.where("taken")), staged
        requests = _sizes(staged)
        room = count if most_logs is None else most_logs - waiting(spark, places, but=(run_id, batch_id))
        # Where all entries fit none is beyond, and without a shut day no micro-batch fails: then no request has to be looked at.
        lost = []
        if count > room or early:
            requests = scope.stored(requests, "requests")
        if count > room:
            over = scope.stored(beyond(requests, room), "beyond")
            lost.append(over.withColumn("failure", F.lit(OVERLOADED)))
        if early:
            fit = requests.join(lost[0], "seq", "left_anti") if lost else requests
            lost.append(_failing(staged, requests, microbatches(fit, logs_per_batch), shut, scope))
        if lost:
            failures = scope.stored(lost[0].unionByName(lost[1]) if len(lost) > 1 else lost[0], "failures")
            requests = requests.join(failures, "seq", "left").withColumns({"error": F.coalesce("error", "failure"), **{c: F.when(F.col("failure").isNull(), F.col(c)).otherwise(0) for c in ("n", "rejected")}}).drop("failure")
            requests = scope.stored(requests, "outcomes")
            logs, refused = logs.join(failures, "seq", "left_anti"), refused.join(failures, "seq", "left_anti")

        # Requests that are turned away leave their ids unused.
        written = requests.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if lost else count
        base = own.base if own and own.rows == count else batches.last_id(seen)
        pending = batches.begin(spark, places.logs, Batch(run_id, batch_id, base, count, now, written))
        for place in (places.reports, places.rejected, places.logs):
            drop_batch(spark, place, run_id, batch_id)
        at_once(
            lambda: write_logs(logs.withColumn("id", F.col("id") + F.lit(base)), places.logs, run_id, batch_id),
            lambda: _write(validate.refusals(refused), places.rejected, run_id, batch_id),
            lambda: _write(validate.outcomes(requests), places.reports, run_id, batch_id),
        )
    return pending


def publish_batch(spark: SparkSession, places: Places, pending: Batch) -> None:
    batches.publish(spark, places.logs, pending)


def ingest_batch(bodies: DataFrame, places: Places, now: str, run_id: str, batch_id: int = 0, policy: Retention | None = None, early_days: str = "fail", most_logs: int | None = None, logs_per_batch: int | None = None) -> None:
    """Validate ``bodies(request_id, body)`` and write logs, refused entries and reports; written again, a batch replaces itself.

    Requests arrive in the order of the rows of ``bodies``, and ids rise in it; what is read from several files has none (Spark reads larger files first) unless it is sorted. With a ``policy``, a row whose day isn't open makes the whole batch fail before anything is
    written; with ``early_days="microbatch"``, its micro-batch of at most ``logs_per_batch`` logs alone (:func:`admission.microbatches`), whose requests are reported as
    failed; with ``"reject"`` it is refused by itself. Requests that would make more than ``most_logs`` wait, those of batches that aren't published yet included, are
    refused whole (:func:`admission.beyond`).

    A batch notes its ids and ``now`` before it writes; run again, it goes by what it noted, and deletes what it wrote. Its logs can be read when all of them are there.
    Nothing else is left behind, however it ends. One writer at a time: ids go by what is noted.
    """
    pending = stage_batch(bodies, places, now, run_id, batch_id, policy, early_days, most_logs, logs_per_batch)
    publish_batch(bodies.sparkSession, places, pending)


def ingest_stream(spark: SparkSession, source: str, places: Places, checkpoint: str, now: Callable[[], str], run_id: str, policy: Retention | None = None, early_days: str = "fail", files_per_batch: int = 100, bytes_per_batch: int | None = None, most_logs: int | None = None, logs_per_batch: int | None = None, interval: str | None = None) -> StreamingQuery:
    """A stream over files with one request a line; a request is never split between batches.

    ``files_per_batch`` or, if given, ``bytes_per_batch`` says how much is admitted at once: what is beyond waits in the source, and
    a larger file goes alone. Within a batch requests arrive as Spark reads its files, larger ones first. Requests that would make more than ``most_logs`` logs wait are refused instead. A batch that fails stops the stream, and is run again
    from the checkpoint, whose name belongs to ``run_id``. Without ``interval`` the stream reads what is there and stops when that is written.
    """
    reader = spark.readStream.schema("value string")
    # Spark takes one limit or the other.
    reader = reader.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        bodies = batch.select(F.format_string(f"{run_id}-%06d-%020d", F.lit(batch_id), F.monotonically_increasing_id()).alias("request_id"), F.col("value").alias("body"))
        ingest_batch(bodies, places, now(), run_id, batch_id, policy, early_days, most_logs, logs_per_batch)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
