import json
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidelog.functions.times import ArgumentError, add_days, day_label, day_of_label
from tidelog.names import unused
from tidelog.operators import retention
from tidelog.operators.ids import assign_ids, running_sums
from tidelog.operators.retention import Retention
from tidelog.sources.logs import append_logs, read_logs, read_stored
from tidelog.sources.requests import request_documents, request_lines
from tidelog.streaming.ingest import OVERLOADED, Places, committed, ingest_batch, ingest_stream

NOW = "2026-08-09T12:00:00Z"


def body(*times, **changes):
    return json.dumps({"logs": [{"timestamp": t, "level": "info", "service": "api", "message": "m", **changes} for t in times]})


def places(tmp_path):
    return Places(*(str(tmp_path / x) for x in ("logs", "rejected", "reports")))


def bodies(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "request_id string, body string")


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    at = places(tmp_path)
    for _ in range(2):
        ingest_batch(bodies(spark, body("2026-08-09T10:00:00Z", "2026-08-09T09:00:00Z"), body("2026-08-08T10:00:00Z", level="x")), at, NOW, "run", 0)
    ingest_batch(bodies(spark, body("2026-08-09T11:00:00Z")), at, NOW, "run", 1)
    rows = read_logs(spark, at.logs).orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3] and [r["timestamp"].hour for r in rows] == [10, 9, 11]
    assert [(r["request_id"], r["index"], r["reason"]) for r in spark.read.parquet(at.rejected).collect()] == [("1", 0, "invalid level: 'x'")]
    assert sorted((r["batch_id"], r["request_id"], r["status"]) for r in spark.read.parquet(at.reports).collect()) == [(0, "0", "ok"), (0, "1", "all_invalid"), (1, "0", "ok")]


def test_a_shut_day_fails_the_whole_batch(spark, tmp_path):
    at, policy = places(tmp_path), Retention(1, 1)
    both = bodies(spark, body("2026-08-09T10:00:00Z", "2026-08-07T10:00:00Z"))
    with pytest.raises(ArgumentError, match="logs_2026_08_07"):
        ingest_batch(both, at, NOW, "run", 0, policy)
    assert not (tmp_path / "logs").exists()
    ingest_batch(both, at, NOW, "run", 0, policy, early_days="reject")
    assert read_logs(spark, at.logs).count() == 1 and spark.read.parquet(at.rejected).count() == 1


def test_a_replay_after_midnight_goes_by_its_first_clock(spark, tmp_path):
    at, policy = places(tmp_path), Retention(1, 1)
    both = bodies(spark, body("2026-08-08T13:00:00Z", "2026-08-09T09:00:00Z"))
    for now in ("2026-08-09T12:00:00Z", "2026-08-10T12:00:00Z"):
        ingest_batch(both, at, now, "run", 0, policy, early_days="reject")
    assert sorted((r["id"], r["timestamp"].day) for r in read_logs(spark, at.logs).collect()) == [(1, 8), (2, 9)]
    assert spark.read.parquet(at.reports).count() == 1


def test_a_replay_leaves_nothing_of_what_it_replaces(spark, tmp_path):
    at = places(tmp_path)
    ingest_batch(bodies(spark, body("2026-08-08T10:00:00Z", "2026-08-09T09:00:00Z"), body("2026-08-08T10:00:00Z", level="x")), at, NOW, "a/b [c]", 0)
    ingest_batch(bodies(spark, body("2026-08-09T11:00:00Z")), at, NOW, "other", 0)
    ingest_batch(bodies(spark, body("2026-08-09T09:00:00Z")), at, NOW, "a/b [c]", 0)
    rows = read_logs(spark, at.logs).collect()
    assert len(rows) == len({r["id"] for r in rows}) == 2 and {r["timestamp"].hour for r in rows} == {9, 11}
    assert spark.read.schema("reason string").parquet(at.rejected).count() == 0
    assert committed(spark, at).count() == 2


def test_a_batch_without_reports_is_not_committed(spark, tmp_path, monkeypatch):
    from tidelog.streaming import ingest

    at, both = places(tmp_path), bodies(spark, body("2026-08-08T10:00:00Z", "2026-08-09T09:00:00Z"))
    ingest_batch(both, at, NOW, "run", 0)
    write = ingest._write

    def dies(df, path, *rest):
        if path == at.rejected:
            raise OSError("lost")
        write(df, path, *rest)

    monkeypatch.setattr(ingest, "_write", dies)
    with pytest.raises(OSError):
        ingest_batch(both, at, NOW, "run", 1)
    assert committed(spark, at).count() == read_logs(spark, at.logs).count() == 2 and read_stored(spark, at.logs).count() == 4
    monkeypatch.setattr(ingest, "_write", write)
    ingest_batch(both, at, NOW, "run", 1)
    assert sorted(r["id"] for r in committed(spark, at).collect()) == [1, 2, 3, 4]


def test_requests_beyond_the_limit_are_refused_whole(spark, tmp_path):
    at = places(tmp_path)
    ingest_batch(bodies(spark, body("2026-08-09T10:00:00Z"), "not json", body(*["2026-08-09T10:00:00Z"] * 2), body("2026-08-09T10:00:00Z")), at, NOW, "run", most_logs=3)
    found = {r["request_id"]: (r["status"], r["error"], r["accepted"]) for r in spark.read.parquet(at.reports).collect()}
    assert found == {"0": ("ok", None, 1), "1": ("bad_request", "request body must be valid JSON", 0), "2": ("ok", None, 2), "3": ("bad_request", OVERLOADED, 0)}


def test_a_stream_is_cut_by_bytes(spark, tmp_path):
    source, at = tmp_path / "in", places(tmp_path)
    source.mkdir()
    for i in range(4):
        (source / f"{i}.txt").write_text(body(*[f"2026-08-09T0{i}:00:00Z"] * (1 + 30 * (i == 2))) + "\n")
    ingest_stream(spark, str(source), at, str(tmp_path / "checkpoint"), lambda: NOW, "run", bytes_per_batch=250).awaitTermination()
    sizes = {r["batch_id"]: r["n"] for r in read_logs(spark, at.logs).groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 34 and len(sizes) >= 3 and 31 in sizes.values()


def test_stream_takes_all_requests_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    at = places(tmp_path)
    for i in range(3):
        (source / f"{i}.txt").write_text(body(f"2026-08-09T0{i}:00:00Z", f"2026-08-09T0{i}:30:00Z") + "\nnot json\n")
    for _ in range(2):
        ingest_stream(spark, str(source), at, str(tmp_path / "checkpoint"), lambda: NOW, "run", files_per_batch=2).awaitTermination()
    rows = read_logs(spark, at.logs)
    assert rows.count() == 6 and rows.agg(F.count_distinct("id"), F.max("id")).first()[:] == (6, 6)
    assert {r["status"]: r["count"] for r in spark.read.parquet(at.reports).groupBy("status").count().collect()} == {"ok": 3, "bad_request": 3}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"logs": []\n}')
    assert request_documents(spark, str(tmp_path)).first()["body"] == '{\n"logs": []\n}'
    assert request_lines(spark, str(tmp_path)).count() == 3


def test_ids_are_dense_and_in_order(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id")).drop("id").repartition(7)
    found = [tuple(r) for r in assign_ids(rows, ("k",), base=10).orderBy("k").select("id").collect()]
    assert found == [(i,) for i in range(11, 1011)]
    assert assign_ids(rows.limit(0), ("k",)).count() == 0


def test_sums_run_over_all_rows_before(spark):
    rows = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("n"), (F.col("id") / 4).alias("x"), F.lit("kept").alias("part"), F.lit(0).alias("place")).repartition(6)
    found = running_sums(rows, ("k",), {"before": "n", "share": "x"}).orderBy("k").collect()
    n = x = 0
    for r in found:
        assert (r["before"], r["share"], r["part"], r["place"]) == (n, x, "kept", 0)
        n, x = n + (r["n"] or 0), x + r["x"]
    assert len(found) == 500 and running_sums(rows.limit(0), ("k",), {"before": "n"}).count() == 0


def test_names_that_are_new():
    assert unused(["a", "_A", "b"], "A", "c", "a") == ["__A", "c", "___a"]


def table(spark, path, *times):
    rows = [(i, t, "info", "api", "m", "{}", {}) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id long, timestamp string, level string, service string, message string, attributes string, attributes_normalized map<string,string>")
    append_logs(df.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("day", F.to_date("timestamp")), path, "run")


def test_maintenance(spark, tmp_path):
    path, policy = str(tmp_path / "t"), Retention(2, 1)
    assert str(retention.cutoff("2026-08-09T12:00:00Z", policy)) == "2026-08-07 12:00:00+00:00"
    assert retention.day_window("2026-08-09T12:00:00Z", policy) == (date(2026, 8, 7), date(2026, 8, 10))
    table(spark, path, "2026-08-08T23:00:00Z", "2026-08-09T10:00:00Z", "2026-08-09T12:00:00Z", "2026-08-09T13:00:00Z")
    open_days = [date(2026, 8, d) for d in range(8, 12)]
    report = retention.maintain(spark, path, "2026-08-11T12:00:00Z", policy, open_days).first()
    assert (report["createdPartitions"], report["droppedPartitions"], report["deletedCutoffRows"]) == (["logs_2026_08_12"], ["logs_2026_08_08"], 1)
    assert sorted(r["id"] for r in read_logs(spark, path).collect()) == [2, 3]
    again = retention.maintain(spark, path, "2026-08-11T12:00:00Z", policy, [*open_days, date(2026, 8, 12)]).first()
    assert (again["createdPartitions"], again["droppedPartitions"], again["deletedCutoffRows"]) == ([], [], 0)


class Lost(Exception):
    pass


@pytest.mark.parametrize("at_step", range(5))
def test_a_trim_that_is_cut_off_loses_nothing(spark, tmp_path, monkeypatch, at_step):
    path, at = str(tmp_path / "t"), retention.cutoff("2026-08-11T12:00:00Z", Retention(2, 1))
    table(spark, path, "2026-08-09T10:00:00Z", "2026-08-09T12:00:00Z", "2026-08-10T10:00:00Z")
    steps, move = [], retention._move

    def dies(*args):
        if len(steps) == at_step:
            raise Lost
        steps.append(args)
        move(*args)

    monkeypatch.setattr(retention, "_move", dies)
    if at_step < 4:
        with pytest.raises(Lost):
            retention.trim_cutoff_day(spark, path, at)
    else:
        retention.trim_cutoff_day(spark, path, at)
    monkeypatch.setattr(retention, "_move", move)
    if at_step == 1:  # meanwhile another batch writes that day
        rows = read_logs(spark, path).where("id = 2").withColumns({"id": F.lit(9).cast("long"), "timestamp": F.lit("2026-08-09T13:00:00Z").cast("timestamp")}).withColumn("day", F.to_date("timestamp"))
        append_logs(rows, path, "other")
    deleted = retention.maintain(spark, path, "2026-08-11T12:00:00Z", Retention(2, 1)).first()["deletedCutoffRows"]
    # The run that was cut off has decided; the next tells what both have done.
    assert deleted == (1 if at_step < 4 else 0)
    assert sorted(r["id"] for r in read_logs(spark, path).collect()) == [1, 2] + [9] * (at_step == 1)
    assert not any((tmp_path / "t" / retention.STAGING).glob("*"))


@pytest.mark.parametrize("at_step", range(11))
def test_a_maintenance_that_is_cut_off_is_reported_whole(spark, tmp_path, monkeypatch, at_step):
    """Killed before any of its notes, drops and moves, and run again."""
    path, policy, now = str(tmp_path / "t"), Retention(2, 1), "2026-08-11T12:00:00Z"
    table(spark, path, "2026-08-07T10:00:00Z", "2026-08-08T23:00:00Z", "2026-08-09T10:00:00Z", "2026-08-09T12:00:00Z")
    steps = []

    def dies_at_step(f):
        def run(*args, **kwargs):
            steps.append(f.__name__)
            if len(steps) == at_step + 1:
                raise Lost
            return f(*args, **kwargs)

        return run

    for owner, name in ((retention, "_move"), (retention, "forget"), (retention, "drop_expired_days"), (retention.notes, "write"), (retention.notes, "clear")):
        monkeypatch.setattr(owner, name, dies_at_step(getattr(owner, name)))
    open_days = [date(2026, 8, d) for d in range(7, 12)]
    with pytest.raises(Lost):
        retention.maintain(spark, path, now, policy, open_days)
        raise Lost  # in case there are fewer steps
    monkeypatch.undo()
    done = at_step >= len(steps)
    report = retention.maintain(spark, path, now, policy, open_days).first()
    if not done:
        assert (report["createdPartitions"], report["droppedPartitions"], report["deletedCutoffRows"]) == (["logs_2026_08_12"], ["logs_2026_08_07", "logs_2026_08_08"], 1)
    assert sorted(r["id"] for r in read_logs(spark, path).collect()) == [3]
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name[0] == "_" and p.name not in ("_SUCCESS", "_batches", "_counts", "_trim")) == []
    assert not any((tmp_path / "t" / retention.STAGING).glob("*"))


@pytest.mark.parametrize("at_step", [0, 1, 3])
def test_a_batch_that_is_written_again_wins_over_a_trim_that_was_cut_off(spark, tmp_path, monkeypatch, at_step):
    path, at, times = str(tmp_path / "t"), retention.cutoff("2026-08-11T12:00:00Z", Retention(2, 1)), ("2026-08-09T10:00:00Z", "2026-08-09T12:00:00Z")
    table(spark, path, *times)
    steps, move = [], retention._move

    def dies(*args):
        steps.append(args)
        if len(steps) > at_step:
            raise Lost
        move(*args)

    monkeypatch.setattr(retention, "_move", dies)
    with pytest.raises(Lost):
        retention.trim_cutoff_day(spark, path, at)
    monkeypatch.undo()
    table(spark, path, *times, "2026-08-09T13:00:00Z")
    retention.trim_cutoff_day(spark, path, at)
    assert sorted(r["id"] for r in read_logs(spark, path).collect()) == [1, 2]


def test_a_trim_writes_only_files_that_hold_old_rows(spark, tmp_path):
    path = tmp_path / "t"
    for i, hour in enumerate((10, 11, 13, 14)):
        rows = spark.createDataFrame([(i, f"2026-08-09T{hour}:00:00Z"), (10 + i, f"2026-08-09T{hour}:40:00Z")], "id long, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        append_logs(rows.withColumns({"level": F.lit("info"), "service": F.lit("a, [b]"), "message": F.lit("m"), "attributes": F.lit("{}"), "attributes_normalized": F.create_map().cast("map<string,string>"), "day": F.to_date("timestamp")}), str(path), "a=b [c], d", i)
    files = lambda: {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet") if "_counts" not in p.parts}
    before = files()
    assert retention.trim_cutoff_day(spark, str(path), retention.cutoff("2026-08-11T11:30:00Z", Retention(2, 1))) == 3
    after = files()
    assert len(set(before.items()) & set(after.items())) == 2 and len(after) == 3
    assert sorted((r["id"], r["batch_id"], r["run_id"]) for r in read_logs(spark, str(path)).collect()) == [(i, b, "a=b [c], d") for i, b in ((2, 2), (3, 3), (11, 1), (12, 2), (13, 3))]


def test_a_backfill_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    path, target = str(tmp_path / "t"), str(tmp_path / "u")
    table(spark, path, *[f"2026-08-{d:02d}T10:00:00Z" for d in range(1, 8)])
    write, written = retention.notes.write, []

    def dies(spark, folder, content):
        written.append(content)
        if len(written) == 2:
            raise Lost
        write(spark, folder, content)

    monkeypatch.setattr(retention.notes, "write", dies)
    with pytest.raises(Lost):
        retention.backfill_normalized(spark, path, target, days_at_once=3)
    monkeypatch.undo()
    first = {p: p.stat().st_mtime_ns for d in (1, 2, 3) for p in (tmp_path / "u" / f"day=2026-08-0{d}").rglob("*.parquet")}
    retention.backfill_normalized(spark, path, target, days_at_once=3)
    assert first and {p: p.stat().st_mtime_ns for p in first} == first
    assert sorted(r["id"] for r in read_logs(spark, target).collect()) == list(range(7))


def test_trimming_a_day_to_nothing_drops_it(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path, "2026-08-09T10:00:00Z", "2026-08-10T10:00:00Z")
    assert retention.trim_cutoff_day(spark, path, retention.cutoff("2026-08-11T12:00:00Z", Retention(2, 1))) == 1
    assert retention.list_days(spark, path) == [date(2026, 8, 10)]


def test_backfill(spark, tmp_path):
    path, target = str(tmp_path / "t"), str(tmp_path / "u")
    df = spark.createDataFrame([(1, "2026-08-09T10:00:00Z", '{"a":1}'), (2, "2026-08-09T10:00:00Z", "{}")], "id long, timestamp string, attributes string")
    df = df.withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "level": F.lit("info"), "service": F.lit("s"), "message": F.lit("m"), "attributes_normalized": F.lit(None).cast("map<string,string>")})
    append_logs(df.withColumn("day", F.to_date("timestamp")), path, "run")
    retention.backfill_normalized(spark, path, target)
    assert {r["id"]: r["attributes_normalized"] for r in read_logs(spark, target).collect()} == {1: {"a": "1"}, 2: {}}


def test_day_labels(spark):
    found = spark.createDataFrame([("logs_2026_08_09",), ("logs_2026_02_31",), ("users_2026_08_09",), ("logs_2026_08_09\n",), (None,)], "n string").select(day_of_label(F.col("n")).cast("string")).collect()
    assert [r[0] for r in found] == ["2026-08-09", None, None, None, None]
    day = F.to_date(F.lit("2026-08-11T00:30:00+03:00").cast("timestamp"))
    row = spark.range(1).select(day_label(day), add_days(F.lit("2026-08-31").cast("date"), 1).cast("string")).first()
    assert tuple(row) == ("logs_2026_08_10", "2026-09-01")
    with pytest.raises(ArgumentError):
        add_days(day, 1.5)
    assert retention.day_of("logs_2026_08_09") == date(2026, 8, 9) and retention.day_of("logs_2026_02_31") is None


@pytest.mark.parametrize("bad", [(0, 1), (3651, 1), (1, 0), (1, 32), (1.5, 1)])
def test_retention_ranges(bad):
    with pytest.raises(ArgumentError):
        Retention(*bad)


def test_too_large_counts_are_an_error(spark):
    from tidelog.operators.buckets import MOST, exact

    assert spark.range(1).select(exact(F.lit(MOST))).first()[0] == MOST
    with pytest.raises(PySparkException):
        spark.range(1).select(exact(F.lit(MOST + 1) + F.col("id"))).collect()
