"""Batches appear at once or not at all, leave nothing behind, and take ids, room and micro-batches in the order of arrival."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import admission
from tidelog.operators.ids import numbered_as_stored
from tidelog.operators.retention import Retention
from tidelog.scratch import shared_dir
from tidelog.sources import batches
from tidelog.sources.batches import Batch
from tidelog.sources.logs import append_logs, read_logs, read_stored
from tidelog.streaming import ingest
from tidelog.streaming.ingest import OVERLOADED, Places, ingest_batch, publish_batch, read_reports, stage_batch, waiting

NOW = "2026-08-09T12:00:00Z"


def body(*times):
    return json.dumps({"logs": [{"timestamp": t, "level": "info", "service": "api", "message": "m"} for t in times]})


def bodies(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "request_id string, body string")


@pytest.fixture
def at(tmp_path):
    return Places(*(str(tmp_path / x) for x in ("logs", "rejected", "reports")))


def scratch(spark):
    place = f"{shared_dir(spark)}/tidelog"
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def some(spark, n=3):
    return bodies(spark, *[body("2026-08-08T10:00:00Z", "2026-08-09T09:00:00Z") for _ in range(n)])


def test_no_batch_leaves_anything_in_scratch(spark, at):
    before = scratch(spark)
    for i in range(10):
        ingest_batch(some(spark), at, NOW, "run", i, Retention(2, 1), early_days="microbatch", most_logs=100, logs_per_batch=4)
    with pytest.raises(ValueError, match="logs_2026_08_08"):
        ingest_batch(some(spark), at, "2026-08-10T12:00:00Z", "run", 10, Retention(1, 1))
    assert scratch(spark) == before
    assert read_logs(spark, at.logs).agg(F.count("*"), F.count_distinct("id"), F.max("id")).first()[:] == (60, 60, 60)


def test_a_batch_that_is_killed_between_days_is_not_seen(spark, at, monkeypatch):
    ingest_batch(some(spark), at, NOW, "run", 0)
    write = ingest.write_logs

    def dies(logs, *rest):
        write(logs.where("day = DATE '2026-08-08'"), *rest)
        raise OSError("lost")

    monkeypatch.setattr(ingest, "write_logs", dies)
    with pytest.raises(OSError):
        ingest_batch(some(spark), at, NOW, "run", 1)
    assert read_stored(spark, at.logs).count() == 9 and read_logs(spark, at.logs).count() == 6
    assert waiting(spark, at) == 6 and waiting(spark, at, but=("run", 1)) == 0
    monkeypatch.setattr(ingest, "write_logs", write)
    ingest_batch(some(spark), at, NOW, "run", 1)
    assert sorted(r["id"] for r in read_logs(spark, at.logs).collect()) == list(range(1, 13)) and waiting(spark, at) == 0


def test_a_batch_that_is_written_again_is_not_seen_meanwhile(spark, at, monkeypatch):
    ingest_batch(some(spark), at, NOW, "a,b/c .pending", 0)
    monkeypatch.setattr(ingest, "publish_batch", lambda *_: None)
    ingest_batch(some(spark), at, NOW, "a,b/c .pending", 0)
    assert read_logs(spark, at.logs).count() == 0 and read_reports(spark, at).count() == 0 and read_stored(spark, at.logs).count() == 6
    monkeypatch.undo()
    ingest_batch(some(spark, 2), at, NOW, "a,b/c .pending", 0)
    assert read_logs(spark, at.logs).count() == 4 and read_reports(spark, at).count() == 2


def test_a_reader_is_not_shown_what_is_published_while_it_lists(spark, at, monkeypatch):
    ingest_batch(some(spark), at, NOW, "run", 0)
    looks, noted = [], batches.noted

    def publishes(*args):
        looks.append(1)
        if len(looks) == 2:
            append_logs(read_stored(spark, at.logs), at.logs, "other")
        return noted(*args)

    monkeypatch.setattr(batches, "noted", lambda *args: publishes(*args) if len(looks) < 2 else noted(*args))
    assert read_logs(spark, at.logs).count() == 6
    monkeypatch.undo()
    assert read_logs(spark, at.logs).count() == 12


def test_ids_go_on_from_what_was_appended(spark, at):
    ingest_batch(some(spark), at, NOW, "run", 0)
    append_logs(read_stored(spark, at.logs).withColumn("id", F.col("id") + 1000), at.logs, "other")
    ingest_batch(some(spark, 1), at, NOW, "run", 1)
    assert sorted(r["id"] for r in read_logs(spark, at.logs).collect()) == [*range(1, 7), *range(1001, 1009)]


def test_names_of_batches_say_all(spark, tmp_path):
    path = str(tmp_path / "t")
    for b in (Batch("r,1/ä.published", 3, 5, 7, NOW, 6), Batch("", 0)):
        assert Batch.of(b.name) == b
        pending = batches.begin(spark, path, b)
        assert batches.begin(spark, path, b) == pending and batches.find(batches.noted(spark, path), *b.own) == b
        batches.publish(spark, path, pending)
    with pytest.raises(OSError):
        batches.publish(spark, path, Batch("x"))
    assert Batch.of("x") is None and batches.last_id(batches.noted(spark, path)) == 12 and batches.last_id([]) == 0


def test_files_of_old_batches_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "KEPT", 3)
    path = str(tmp_path / "t")
    waits = batches.begin(spark, path, Batch("waits"))
    for i in range(8):
        batches.publish(spark, path, batches.begin(spark, path, Batch("run", i, i, 1)))
    assert sorted(b.batch_id for b in batches.noted(spark, path) if b.published) == [5, 6, 7] and waits in batches.noted(spark, path)
    assert batches.last_id(batches.noted(spark, path)) == 8


def test_what_waits_takes_room(spark, at):
    pending, before = stage_batch(some(spark), at, NOW, "run", 0), scratch(spark)
    ingest_batch(some(spark), at, NOW, "run", 1, most_logs=8)
    assert scratch(spark) == before
    found = {(r["batch_id"], r["request_id"]): (r["status"], r["error"], r["accepted"]) for r in spark.read.parquet(at.reports).collect()}
    assert found[1, "0"] == ("ok", None, 2) and found[1, "1"] == found[1, "2"] == ("bad_request", OVERLOADED, 0)
    publish_batch(spark, at, pending)
    ingest_batch(some(spark), at, NOW, "run", 2, most_logs=8)
    assert read_reports(spark, at).where("batch_id = 2 AND status = 'ok'").count() == 3 and read_logs(spark, at.logs).count() == 14
    assert read_logs(spark, at.logs).agg(F.count_distinct("id")).first()[0] == 14


def test_a_shut_day_fails_its_micro_batch_alone(spark, at):
    good, late = body("2026-08-09T10:00:00Z", "2026-08-09T11:00:00Z"), body("2026-08-09T10:00:00Z", "2026-08-01T10:00:00Z")
    given, before = bodies(spark, good, late, "not json", good, good, body("x"), late), scratch(spark)
    ingest_batch(given, at, NOW, "run", 0, Retention(2, 1), early_days="microbatch", logs_per_batch=4)
    found = {r["request_id"]: (r["status"], r["error"], r["accepted"], r["rejected"]) for r in read_reports(spark, at).collect()}
    failed = ("failed", "no partition of logs for logs_2026_08_01", 0, 0)
    assert found == {"0": failed, "1": failed, "2": ("bad_request", "request body must be valid JSON", 0, 0), "3": ("ok", None, 2, 0), "4": ("ok", None, 2, 0), "5": ("all_invalid", None, 0, 1), "6": failed}
    assert read_logs(spark, at.logs).count() == 4 and spark.read.parquet(at.rejected).count() == 1 and scratch(spark) == before
    with pytest.raises(ValueError, match="logs_per_batch"):
        ingest_batch(given, at, NOW, "run", 1, Retention(2, 1), early_days="microbatch")


def test_ids_follow_the_order_of_arrival(spark, tmp_path):
    rows = spark.range(5000, numPartitions=7).withColumn("even", F.col("id") % 2 == 0)
    rows.write.partitionBy("even").option("maxRecordsPerFile", 100).parquet(str(tmp_path / "t"))
    found, n = numbered_as_stored(spark.read.parquet(str(tmp_path / "t")).where("even = 'true'"), "number")
    assert n == 2500 and found.where("id != 2 * (number - 1)").count() == 0 and found.count() == 2500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def next_fit(sizes, most):
    out, number, fill = {}, 0, 0
    for seq, n in sorted(sizes):
        if not n:
            continue
        if not number or fill + n > most:
            number, fill = number + 1, 0
        fill += n
        out[seq] = number
    return out


def refused(sizes, room):
    out, left = set(), room
    for seq, n in sorted(sizes):
        if n > left:
            out.add(seq)
        else:
            left -= n
    return out


@pytest.mark.parametrize("seed", range(8))
def test_requests_are_taken_and_grouped_one_after_another(spark, seed):
    rng = random.Random(seed)
    most = rng.choice([1, 5, 20, 100])
    sizes = [((part << admission.WITHIN) + i, rng.choice([0, 1, 1, rng.randint(1, 30), rng.randint(1, 2 * most)])) for part in rng.sample(range(40), rng.randint(1, 9)) for i in range(rng.choice([1, 3, 40]))]
    given = spark.createDataFrame(sizes, "seq long, n int").repartition(3)
    assert {r["seq"]: r["microbatch"] for r in admission.microbatches(given, most).collect()} == next_fit(sizes, most)
    for room in (0, most, sum(n for _, n in sizes) // 2, sum(n for _, n in sizes)):
        assert {r["seq"] for r in admission.beyond(given, room).collect()} == refused(sizes, room)


def test_no_requests(spark):
    none = spark.createDataFrame([(1, 0)], "seq long, n int")
    assert admission.microbatches(none, 5).count() == 0 and admission.beyond(none, 0).count() == 0
    with pytest.raises(ValueError):
        admission.microbatches(none, 0)
