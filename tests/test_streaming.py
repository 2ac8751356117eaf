from __future__ import annotations

from pyspark.sql import functions as F

from sowmill.sources.merge import upsert
from sowmill.streaming import jobs as J

SOW = "id int, version int, title string"


def files(spark, tmp_path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SOW).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    return [str(tmp_path / f"in{i}") for i in range(len(batches))]


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_upsert_stream_takes_files_out_of_order(spark, tmp_path):
    newer, older, mixed = [(1, 5, "a"), (2, 1, "b"), (4, 3, "f")], [(1, 3, "stale"), (2, 2, "c"), (3, 1, "d"), (3, 2, "e")], [(4, 2, "stale"), (3, 3, "g")]
    files(spark, tmp_path, newer, older, mixed)
    source = spark.readStream.schema(SOW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    store = str(tmp_path / "store")
    J.stream_upsert(source, lambda d: d, store, "id", "version", str(tmp_path / "cp")).awaitTermination(60)
    want = {(1, 5, "a"), (2, 2, "c"), (3, 3, "g"), (4, 3, "f")}
    assert rows_of(J.read_store(spark, store, "id", "version")) == want
    table = spark.createDataFrame([], SOW)
    for part in (newer, older, mixed):
        table = upsert(table, spark.createDataFrame(part, SOW), "id", F.col("version"))
    assert rows_of(table) == want
    J.compact_store(spark, store, str(tmp_path / "fresh"), "id", "version")
    J.upsert_batch(str(tmp_path / "fresh"), "id", "version")(spark.createDataFrame([(1, 4, "stale"), (5, 1, "h")], SOW), 3)
    assert rows_of(J.read_store(spark, str(tmp_path / "fresh"), "id", "version")) == want | {(5, 1, "h")}


def test_a_batch_writes_its_own_part_alone_and_can_run_twice(spark, tmp_path):
    store = tmp_path / "s"
    assert J.read_store(spark, str(store), "id", "version") is None
    apply = J.upsert_batch(str(store), "id", "version")
    apply(spark.createDataFrame([(1, 1, "a")], SOW), 0)
    before = sorted(f.name for f in (store / "batch=0").iterdir())
    for _ in range(2):
        apply(spark.createDataFrame([(1, 2, "b"), (2, 1, "x")], SOW), 1)
    assert sorted(f.name for f in (store / "batch=0").iterdir()) == before
    assert rows_of(J.read_store(spark, str(store), "id", "version")) == {(1, 2, "b"), (2, 1, "x")}


def test_null_versions_are_the_oldest(spark):
    target = spark.createDataFrame([(1, None, "a"), (2, 4, "b")], SOW)
    batch = spark.createDataFrame([(1, 1, "c"), (2, None, "d"), (3, None, "e")], SOW)
    assert rows_of(upsert(target, batch, "id", F.col("version"))) == {(1, 1, "c"), (2, 4, "b"), (3, None, "e")}


def test_status_stream_with_late_and_repeated_events(spark, tmp_path):
    schema = "job_id int, status string, ts timestamp, event_id int"
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    batches = [[(1, "queued", at(10), 1)], [(3, "error", at(11), 2), (1, "queued", at(10), 1)], [(2, "completed", at(1), 3)], [(1, "stale", at(2), 4), (3, "done", at(11), 5)]]
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "job_id int, status string, ts string, event_id int").withColumn("ts", F.to_timestamp("ts"))
        frame.select("job_id", "status", "ts", "event_id").coalesce(1).write.parquet(str(tmp_path / f"ev{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev*"))
    J.stream_status(stream, str(tmp_path / "status"), str(tmp_path / "cp")).awaitTermination(90)
    got = {(r.job_id, r.status) for r in J.read_store(spark, str(tmp_path / "status"), "job_id", ["ts", "event_id"]).collect()}
    assert got == {(1, "queued"), (2, "completed"), (3, "done")}
    every = spark.read.schema(schema).parquet(*[str(tmp_path / f"ev{i}") for i in range(4)])
    assert got == {(r.job_id, r.status) for r in J.latest_status(every).collect()}


def test_routing_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "historical"), (2, "new_staffing")], "job_id int, processing_type string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    J.stream_route(stream, str(tmp_path / "out"), lambda d: d.withColumn("plan", F.lit("p")), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.job_id, r.confidence) for r in spark.read.parquet(str(tmp_path / "out/historical")).collect()] == [(1, 1.0)]
    assert [(r.job_id, r.plan) for r in spark.read.parquet(str(tmp_path / "out/planned")).collect()] == [(2, "p")]


def test_jobs_without_events_are_queued(spark):
    jobs = spark.createDataFrame([(1, "historical"), (2, "new_staffing")], "job_id int, processing_type string")
    status = spark.createDataFrame([(1, "completed")], "job_id int, status string")
    assert {(r.job_id, r.status) for r in J.list_jobs(jobs, status).collect()} == {(1, "completed"), (2, "queued")}


EVENT = "job_id int, status string, ts timestamp, event_id int"


def event_files(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "job_id int, status string, ts string, event_id int").withColumn("ts", F.to_timestamp("ts"))
        frame.select("job_id", "status", "ts", "event_id").coalesce(1).write.parquet(str(tmp_path / f"ev{i}"))
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev*"))


def test_job_states_by_allowed_moves(spark):
    at = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    rows = [(1, "queued", at(1), 1), (1, "processing", at(2), 2), (1, "completed", at(3), 3), (1, "queued", at(4), 4), (1, "error", at(5), 5),
            (2, "completed", at(1), 6), (2, "processing", at(2), 7), (3, "completed", at(1), 8), (4, "processing", at(1), 9), (4, "error", at(9), 10),
            (5, "processing", at(2), 12), (5, "completed", at(2), 11), (5, "error", at(2), 13), (6, "unknown", at(2), 14), (7, "processing", None, 15),
            (8, "processing", at(8), 16), (8, "processing", at(8), 16), (None, "processing", at(8), 17)]
    events = spark.createDataFrame(rows, "job_id int, status string, ts string, event_id int").withColumn("ts", F.to_timestamp("ts"))
    plain = {(r.job_id, r.status) for r in J.job_states(events).collect()}
    assert plain == {(1, "completed"), (2, "processing"), (3, "queued"), (4, "error"), (5, "error"), (6, "queued"), (8, "processing")}
    limited = {r.job_id: (r.status, r.reason) for r in J.job_states(events, 4 * 3600, F.lit(at(10)).cast("timestamp")).collect()}
    assert limited[2] == ("error", "stuck") and limited[4] == ("error", "stuck") and limited[1] == ("completed", None) and limited[8] == ("processing", None)


def test_job_state_stream_equals_the_batch_form_in_any_order(spark, tmp_path):
    import random

    draw = random.Random(6)
    rows = [(draw.randint(1, 25), draw.choice(["queued", "processing", "completed", "error", "other"]), f"2024-01-01 {draw.randint(0, 9):02d}:{draw.randint(0, 59):02d}:00", i)
            for i in range(150)]
    shuffled = [rows[i::5] + rows[:4] for i in range(5)]
    draw.shuffle(shuffled)
    stream = event_files(spark, tmp_path, shuffled)
    J.stream_job_states(stream, str(tmp_path / "states"), str(tmp_path / "cp"), late="20 hours").awaitTermination(120)
    got = {(r.job_id, r.status, r.reason, r.since) for r in J.read_store(spark, str(tmp_path / "states"), "job_id", "version").collect()}
    every = spark.read.schema(EVENT).parquet(*[str(tmp_path / f"ev{i}") for i in range(5)])
    assert got == {(r.job_id, r.status, r.reason, r.since) for r in J.job_states(every).collect()} and len(got) > 20


def test_job_state_stream_drops_late_events_and_ends_stuck_jobs(spark, tmp_path):
    at = lambda d, h: f"2024-01-{d:02d} {h:02d}:00:00"
    batches = [[(1, "processing", at(1, 1), 1), (2, "processing", at(1, 1), 2), (3, "queued", at(1, 1), 3)],
               [(9, "queued", at(3, 0), 4)],
               [(1, "completed", at(1, 2), 5), (9, "processing", at(3, 1), 6)],
               [(9, "completed", at(3, 2), 7)]]
    stream = event_files(spark, tmp_path, batches)
    J.stream_job_states(stream, str(tmp_path / "states"), str(tmp_path / "cp"), late="1 hour", stuck_after=6 * 3600).awaitTermination(120)
    got = {r.job_id: (r.status, r.reason) for r in J.read_store(spark, str(tmp_path / "states"), "job_id", "version").collect()}
    assert got == {1: ("error", "stuck"), 2: ("error", "stuck"), 3: ("queued", None), 9: ("completed", None)}
