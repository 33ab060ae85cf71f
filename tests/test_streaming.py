from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import events_of, operation, request
from opsight.operators import daily, dedup
from opsight.params import StatusCodes, Thresholds
from opsight.session import scratch_path
from opsight.sources import queue as queue_source
from opsight.streaming import events, findings, hosts, tables

@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every batch opens a state store for each partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


EVENT_SCHEMA = "record_type string, service string, job_id string, outcome string, event string, level string, message string, recorded_at string, duration_seconds double, failures array<struct<code:string,locator:string,message:string>>, diagnostics array<struct<source:string,message:string>>, event_time timestamp, line_id long"


class Feed:
    """A folder of Parquet files that a stream reads one batch at a time."""

    def __init__(self, spark, schema):
        self.spark, self.schema = spark, schema
        self.path = scratch_path(spark, "feed")
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows):
        frame = rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, self.schema)
        frame.coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def columns(rows):
    return rows.select("record_type", "service", "job_id", "outcome", "event", "level", "message", "recorded_at", "duration_seconds", "failures", "diagnostics", "event_time", F.col("line_id").cast("long"))


def test_late_events_rewrite_their_day_and_copies_do_not_count(spark):
    feed = Feed(spark, EVENT_SCHEMA)
    detail, table, checkpoint = (scratch_path(spark, name) for name in ("detail", "daily", "checkpoint"))
    batches = [
        [request("1"), request("2", "failed", "timed out"), operation("job-recovered", "1"), request("3", finished_at="2026-08-18T23:00:00Z")],
        [request("1"), operation("job-recovered", "1"), request("4", finished_at="2026-08-18T22:00:00Z"), request("5", finished_at="2026-08-20T01:00:00Z")],
        [request("6", finished_at="2026-06-01T00:00:00Z"), request("3", finished_at="2026-08-20T05:00:00Z")],
    ]
    for batch in batches:
        feed.add(columns(events_of(spark, batch)))
        events.daily_statistics(feed.stream(), detail, table, checkpoint, order=["line_id"]).awaitTermination()
    found = {str(r["date"]): (r["requests"], r["recovered_jobs"]) for r in daily.read_daily(spark, table).collect()}
    assert found == {"2026-08-18": (2, 0), "2026-08-19": (2, 1), "2026-08-20": (1, 0)}
    # What came too late is kept beside the detail, and a date has two versions at most.
    assert [r["job_id"] for r in spark.read.parquet(f"{detail}-late").collect()] == ["6"]
    folders = [f for _, _, f in tables._dated_versions(spark, detail)]
    assert len(folders) == 3 and {str(d) for d, _, _ in tables._dated_versions(spark, detail)} == {"2026-08-18", "2026-08-19", "2026-08-20"}
    kept = [record for batch in batches[:2] for record in batch]
    batch_rows = daily.daily_statistics(dedup.dedup_by_content(events_of(spark, kept), ["line_id"]))
    assert {str(r["date"]): (r["requests"], r["recovered_jobs"]) for r in batch_rows.collect()} == found


def test_dates_that_left_the_retention_are_removed(spark):
    feed = Feed(spark, EVENT_SCHEMA)
    detail, table, checkpoint = (scratch_path(spark, name) for name in ("detail", "daily", "checkpoint"))
    for day in ("01", "02", "02", "05", "02"):
        feed.add(columns(events_of(spark, [request(f"{day}-{len(list(tables._dated_versions(spark, detail)))}", finished_at=f"2026-08-{day}T01:00:00Z")])))
        events.daily_statistics(feed.stream(), detail, table, checkpoint, order=["line_id"], retention_days=3).awaitTermination()
    assert {str(d) for d, _, _ in tables._dated_versions(spark, detail)} == {"2026-08-05"}
    assert {str(r["date"]): r["requests"] for r in daily.read_daily(spark, table).collect()} == {"2026-08-01": 1, "2026-08-02": 2, "2026-08-05": 1}
    assert spark.read.parquet(f"{detail}-late").count() == 1


def test_moving_summary_equals_the_batch_report_of_each_slide(spark):
    from opsight.operators import dbreport
    from opsight.streaming.jobs import moving_job_summary

    schema = "uuid string, process string, state string, seconds double, started_at timestamp, ended_at timestamp, event_time timestamp"
    feed = Feed(spark, schema)
    path, checkpoint = scratch_path(spark, "moving"), scratch_path(spark, "checkpoint")

    def job(name, state, start, end=None):
        begin, finish = START + timedelta(minutes=start), None if end is None else START + timedelta(minutes=end)
        return (name, name[0], state, None if end is None else (end - start) * 60.0, begin, finish, finish or begin)

    opened = [job("a1", "running", 1), job("a2", "accepted", 2), job("b1", "running", 40), job("b2", "running", 90)]
    ended = [job("a1", "successful", 1, 70), job("b1", "failed", 40, 41), job("b2", "successful", 90, 100)]
    clock = job("c1", "running", 200)
    # An end before its start, and versions up to sixty minutes late.
    for part in ([ended[1], opened[0]], [opened[2], opened[1], ended[0]], [opened[3], ended[2]], [clock]):
        feed.add(part)
        moving_job_summary(feed.stream(), timedelta(minutes=60), timedelta(minutes=20), path, checkpoint, late=timedelta(minutes=60)).awaitTermination()
    found = spark.read.parquet(path).drop("batch_id").collect()
    last = spark.createDataFrame([opened[1], *ended, clock], schema)
    slides = sorted({r["slide"] for r in found})
    assert slides == [START + timedelta(minutes=m) for m in range(20, 141, 20)]
    for slide in slides:
        # The table as it was then: what began, and ends that had come.
        over = F.col("ended_at") <= F.lit(slide)
        then = last.where(F.col("started_at") <= F.lit(slide)).withColumns({"state": F.when(over, F.col("state")).when(F.col("ended_at").isNull(), F.col("state")).otherwise("running"), "seconds": F.when(over, F.col("seconds"))})
        expected = dbreport.window_job_report(then, slide, timedelta(minutes=60)).collect()
        own = [r for r in found if r["slide"] == slide]
        assert sorted(tuple(r)[1:] for r in own) == sorted(map(tuple, expected))


def test_repeated_batch_changes_nothing(spark):
    path = scratch_path(spark, "versions")
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    tables.write_batch(rows, path, 0)
    tables.write_batch(rows.where("k = 'a'").withColumn("v", F.lit(2)), path, 1)
    tables.write_batch(rows.where("k = 'a'").withColumn("v", F.lit(2)), path, 1)
    assert {r["k"]: r["v"] for r in tables.latest_versions(spark, path, ["k"]).collect()} == {"a": 2, "b": 1}
    assert tables.earlier_batches(spark, path, 1, rows).count() == 2
    assert tables.earlier_batches(spark, scratch_path(spark, "none"), 1, rows).count() == 0


def test_dedup_lasts_over_batches(spark):
    feed = Feed(spark, EVENT_SCHEMA)
    path, checkpoint = scratch_path(spark, "unique"), scratch_path(spark, "checkpoint")
    for jobs in (["1", "2", "1"], ["2", "3"]):
        feed.add(columns(events_of(spark, [request(job) for job in jobs])))
        events.ingest(events.deduplicated(feed.stream()), path, checkpoint).awaitTermination()
    assert sorted(r["job_id"] for r in spark.read.parquet(path).collect()) == ["1", "2", "3"]


START = datetime(2026, 8, 12, 12)


def test_metric_windows_are_updated_by_later_batches(spark):
    feed = Feed(spark, "host string, plugin string, metric string, column string, ts timestamp, value double")
    path, checkpoint = scratch_path(spark, "hourly"), scratch_path(spark, "checkpoint")
    for minutes in ([0, 59], [30, 60]):
        feed.add([("h", "load", "load", "shortterm", START + timedelta(minutes=m), float(m)) for m in minutes])
        tables.upsert_stream(hosts.metric_windows(feed.stream()), path, checkpoint).awaitTermination()
    found = {r["period"]: (r["count"], r["minimum"], r["maximum"]) for r in tables.latest_versions(spark, path, ["host", "plugin", "metric", "column", "period"]).collect()}
    assert found == {START: (3, 0.0, 59.0), START + timedelta(hours=1): (1, 60.0, 60.0)}


UUID = "123e4567-e89b-42d3-a456-426614174000"


def test_polls_add_up_over_batches(spark):
    feed = Feed(spark, "ts timestamp, job_id string")
    path, checkpoint = scratch_path(spark, "polls"), scratch_path(spark, "checkpoint")
    limits = Thresholds(poll_window_minutes=60, min_poll_count=3, min_poll_span_minutes=5)
    polls = [(8, UUID), (0, UUID), (4, UUID), (4, "other"), (31, "other")]
    for part in (polls[:1], polls[1:3], polls[3:], [(300, "clock")]):
        feed.add([(START + timedelta(minutes=m), job) for m, job in part])
        windows = findings.missing_status_windows(feed.stream(), limits, late="30 minutes")
        events.ingest(windows, path, checkpoint).awaitTermination()
    found = {r["window_end"]: (r["job_id"], r["polls"], r["first_seen"]) for r in spark.read.parquet(path).collect()}
    # Every five minutes while the window holds all three polls.
    assert found == {START + timedelta(minutes=m): (UUID, 3, START) for m in range(10, 65, 5)}


def test_job_timers_fire_and_final_jobs_are_forgotten(spark):
    feed = Feed(spark, "job_id string, status int, event_time timestamp")
    path, checkpoint = scratch_path(spark, "findings"), scratch_path(spark, "checkpoint")
    codes = StatusCodes()
    batches = [
        [("run", codes.started, 0), ("done", codes.started, 0), ("wait", codes.accepted, 0), ("paused", codes.paused, 0), ("late", codes.started, 0)],
        [("done", codes.succeeded, 5), ("late", codes.started, 60)],
        [("clock", codes.succeeded, 120)],
        [("clock", codes.succeeded, 2000)],
    ]
    for batch in batches:
        feed.add([(job, status, START + timedelta(minutes=m)) for job, status, m in batch])
        events.ingest(findings.job_findings(feed.stream(), Thresholds(), codes, "0 seconds"), path, checkpoint).awaitTermination()
    found = {(r["job_id"], r["finding"], (r["due_at"] - START).total_seconds() / 60) for r in spark.read.parquet(path).collect()}
    assert found == {
        ("run", "long-running", 10.0),
        ("run", "stalled", 95.0),
        ("late", "long-running", 10.0),
        ("late", "stalled", 155.0),
        ("wait", "stalled", 1440.0),
    }


def _expected_findings(updates, codes, limits):
    """Each job's updates in order of time, and the findings between them."""
    out = set()
    for job in {j for j, _, _ in updates}:
        own = sorted((m, s not in (codes.started, codes.accepted, codes.paused), s) for j, s, m in updates if j == job)
        reported, start = False, own[0][0]
        for at, (minute, final, status) in enumerate(own):
            until = own[at + 1][0] if at + 1 < len(own) else 10**9
            due = max(start + limits.long_running_minutes, minute)
            if status == codes.started and not reported and due < until:
                reported = True
                out.add((job, "long-running", float(due)))
            stale = {codes.started: limits.database_stale_minutes, codes.accepted: limits.accepted_stale_hours * 60}.get(status)
            if stale is not None and minute + stale < until:
                out.add((job, "stalled", float(minute + stale)))
    return out


def test_findings_do_not_depend_on_the_order_of_arrival(spark):
    """Ends before starts, older starts after ends, and every batch cut give one result."""
    import random

    codes, limits = StatusCodes(), Thresholds()
    updates = [("end-first", codes.succeeded, 8), ("end-first", codes.started, 0), ("slow", codes.started, 0), ("slow", codes.succeeded, 50)]
    updates += [("woken", codes.started, 0), ("woken", codes.started, 120), ("woken", codes.succeeded, 300), ("edge", codes.started, 5), ("edge", codes.succeeded, 15)]
    updates += [("queue", codes.accepted, 0), ("queue", codes.started, 30), ("tie", codes.succeeded, 40), ("tie", codes.started, 40)]
    expected = _expected_findings(updates, codes, limits)
    assert ("woken", "stalled", 95.0) in expected and ("woken", "stalled", 215.0) in expected
    assert not [f for f in expected if f[0] in ("end-first", "edge", "tie")]
    for seed in (1,):
        shuffled = random.Random(seed).sample(updates, len(updates))
        feed = Feed(spark, "job_id string, status int, event_time timestamp")
        path, checkpoint = scratch_path(spark, "findings"), scratch_path(spark, "checkpoint")
        for part in (shuffled[:4], shuffled[4:8], shuffled[8:], [("clock", codes.succeeded, 5000)], [("clock", codes.succeeded, 9000)]):
            feed.add([(job, status, START + timedelta(minutes=m)) for job, status, m in part])
            found = findings.job_findings(feed.stream(), limits, codes, "400 minutes")
            events.ingest(found, path, checkpoint).awaitTermination()
        rows = {(r["job_id"], r["finding"], (r["due_at"] - START).total_seconds() / 60) for r in spark.read.parquet(path).collect()}
        assert rows == expected


def test_alerts_are_raised_and_cleared_once(spark):
    feed = Feed(spark, "snapshot_ts timestamp, value string")
    path, checkpoint = scratch_path(spark, "alerts"), scratch_path(spark, "checkpoint")
    pending = [0, 2, 2, 0, 0, 3, 0]
    at = [START + timedelta(hours=9 * n) for n in range(len(pending))]
    nodes = queue_source.capacity(spark.createDataFrame([(t, n) for t in at for n in ("n|up|idle|none", "short|row")], "snapshot_ts timestamp, value string"))
    lines = [(t, f"{n}|{state}|0:01") for t, count in zip(at, pending) for n, state in enumerate(["RUNNING"] + ["PENDING"] * count)]
    # The second and third snapshot are split over batches, and their rows are mixed.
    for part in (lines[:2] + lines[5:6], lines[2:5] + lines[6:9], lines[9:], [(at[-1] + timedelta(hours=40), "9|RUNNING|0:01")]):
        feed.add(part)
        hosts.alert_transitions(queue_source.queue_jobs(feed.stream()), nodes, path, checkpoint, long_running_seconds=60, pending_critical=2, late="20 hours").awaitTermination()
    found = spark.read.parquet(path).orderBy("snapshot_ts").collect()
    assert [(r["snapshot_ts"], r["status"]) for r in found] == [(at[1], "red"), (at[3], "clear"), (at[5], "red"), (at[6], "clear")]


def test_rejected_documents_go_to_a_table_of_their_own(spark):
    from helpers import status_xml

    feed = Feed(spark, "job_id string, modification_time timestamp, content string")
    requests_path, rejects_path, checkpoint = (scratch_path(spark, n) for n in ("requests", "rejects", "checkpoint"))
    good, open_ = status_xml(), status_xml("<wps:ProcessStarted/>")
    for part in ([("a", good), ("b", "<x"), ("c", open_)], [("d", good), ("e", None)], [("f", open_)]):
        feed.add([(job, START, body) for job, body in part])
        events.ingest_documents(feed.stream(), "rook", requests_path, rejects_path, checkpoint).awaitTermination()
    stored = spark.read.parquet(requests_path).collect()
    assert sorted((r["job_id"], r["inputs"]["level"][1]["value"]) for r in stored) == [("a", "high"), ("d", "high")]
    assert sorted((r["job_id"], r["reject"]) for r in spark.read.parquet(rejects_path).collect()) == [("b", "invalid XML"), ("e", "invalid XML")]


def test_transitions_match_a_plain_loop(spark):
    statuses = ["clear", "red", "red", "clear", "red", "red", "red", "clear"]
    rows = spark.createDataFrame([(START + timedelta(hours=7 * n), s) for n, s in enumerate(statuses)], "snapshot_ts timestamp, status string")
    for initial in ("clear", "red"):
        expected = [START + timedelta(hours=7 * n) for n, s in enumerate(statuses) if s != ([initial] + statuses)[n]]
        assert [r["snapshot_ts"] for r in hosts.transitions(rows, initial).orderBy("snapshot_ts").collect()] == expected


class State:
    """A bucket's state between calls."""

    def __init__(self):
        self.value, self.watermark, self.timeout = None, 0, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, at):
        assert at >= self.watermark
        self.timeout = at


def test_one_call_serves_all_jobs_of_a_bucket():
    """Python and the state store are entered once for a bucket, not for each job."""
    import pandas as pd

    codes, limits = StatusCodes(), Thresholds()
    updates = [(f"job-{n}", codes.started, n % 40) for n in range(300)]
    updates += [(f"job-{n}", codes.succeeded, n % 40 + n % 200) for n in range(0, 300, 2)]
    late, keep = 400 * 60_000, 42 * 86_400_000
    watch, state, found = findings.JobWatch(limits, codes, late, keep), State(), set()
    start = int((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    for part, minute in ((updates[::2], 0), (updates[1::2], 60), ([], 240), ([], 100_000)):
        rows = pd.DataFrame([(j, c, START + timedelta(minutes=m)) for j, c, m in part], columns=["job_id", "status", "event_time"])
        state.watermark = start + minute * 60_000 if minute else 0
        for told in watch((0,), iter([rows] if part else []), state):
            found |= {(r.job_id, r.finding, (r.due_at.timestamp() * 1000 - start) / 60_000) for r in told.itertuples()}
    assert found == _expected_findings(updates, codes, limits)
    assert state.value is None


def test_state_has_few_partitions(spark):
    name, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    for given, taken in ((str(100 * cores), 3 * cores), ("2", 2)):
        spark.conf.set(name, given)
        with tables.state_settings(spark):
            assert int(spark.conf.get(name)) == taken
        assert spark.conf.get(name) == given


def test_a_batch_of_snapshots_is_worked_out_once(spark):
    feed = Feed(spark, "snapshot_ts timestamp, value string")
    path, checkpoint = scratch_path(spark, "alerts"), scratch_path(spark, "checkpoint")
    feed.add([(START + timedelta(hours=n), f"{n}|RUNNING|0:01") for n in range(3)])
    runs = spark.sparkContext.accumulator(0)

    def seen(value):
        runs.add(1)
        return value

    lines = feed.stream().withColumn("value", F.udf(seen)("value"))
    nodes = queue_source.capacity(spark.createDataFrame([(START, "n|up|idle|none")], "snapshot_ts timestamp, value string"))
    hosts.alert_transitions(queue_source.queue_jobs(lines), nodes, path, checkpoint, long_running_seconds=60, pending_critical=2, late="0 seconds").awaitTermination()
    assert runs.value <= 3 * 2
