"""Streaming queries, run to the end of the data there is, with their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.checks import documents, hosts, requests
from opsight.checks import jobs as job_checks
from opsight.checks.sql_tables import (
    ACCESS,
    CAPACITY,
    DOCUMENTS,
    JOB_FACTS,
    JOBS,
    METRICS,
    QUEUE,
    REQUESTS,
    iso,
    with_tables,
)
from opsight.functions import times
from opsight.functions.jobs import with_utc_times
from opsight.operators import daily, dbreport, findings
from opsight.operators.metrics import SERIES
from opsight.params import StatusCodes, Thresholds
from opsight.session import ROCKSDB_PROVIDER, scratch_path
from opsight.sources import access_log, status_xml
from opsight.sources import driver_tables as tables
from opsight.sources import queue as queue_source
from opsight.streaming import events
from opsight.streaming import findings as stream_findings_of
from opsight.streaming import hosts as host_streams
from opsight.streaming import tables as stream_tables
from opsight.streaming.jobs import moving_job_summary


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A stream over the files of one table."""
    schema = tables.table(spark, sf, name).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(sf)
    )


FILES_PER_BATCH = 16


def _in_batches(rows: DataFrame, time: str, late: timedelta, batches: int = 6) -> DataFrame:
    """A stream of ``rows`` in several batches that are not in the order of ``time``.

    A row is put up to half of ``late`` before or after its place, by its content. Batches
    are written one after the other, so that the stream reads them in that order. The rows
    are worked out once, into a table that the batches are cut from.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "feed")
    half = int(late.total_seconds() * 500_000)
    moved = F.unix_micros(F.col(time).cast("timestamp")) + (
        F.pmod(F.xxhash64(*rows.columns), F.lit(2 * half)) - half
    )
    whole = scratch_path(spark, "placed")
    rows.withColumn("__moved", moved).write.parquet(whole)
    placed = spark.read.parquet(whole)
    low, high = placed.agg(F.min("__moved"), F.max("__moved")).first()
    width = (high - low) // batches + 1
    for batch in range(batches):
        inside = F.col("__moved").between(low + batch * width, low + (batch + 1) * width - 1)
        part = placed.where(inside).drop("__moved").repartition(FILES_PER_BATCH)
        part.write.mode("append").parquet(path)
    stream_tables.delete(spark, whole)
    return (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)
    )


def _paths(spark: SparkSession, label: str) -> tuple[str, str]:
    return scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")


def _ingested(spark, sf):
    stored, checkpoint = _paths(spark, "requests")
    rejected = scratch_path(spark, "rejects")
    shaped = tables.shape_status_documents(_stream(spark, sf, "orders"))
    events.ingest_documents(shaped, "rook", stored, rejected, checkpoint).awaitTermination()
    return stored, rejected


def stream_ingest(spark, sf):
    """Status documents to stored request events, inputs included."""
    stored, _ = _ingested(spark, sf)
    return spark.read.parquet(stored).select(
        "job_id",
        "process",
        "outcome",
        "duration_seconds",
        F.to_json("inputs").alias("inputs"),
    )


STREAM_INGEST = with_tables(
    DOCUMENTS,
    body=f"""select job_id, process, {documents.OUTCOME}, {documents.DURATION}, {documents.INPUTS} from status_docs where final_state is not null""",
)


def stream_rejects(spark, sf):
    """The documents of the same stream that could not be used."""
    _, rejected = _ingested(spark, sf)
    return spark.read.parquet(rejected).select("job_id", "reject")


def stream_dedup(spark, sf):
    stored, checkpoint = _paths(spark, "unique")
    unique = events.deduplicated(tables.shape_requests(_stream(spark, sf, "events")))
    events.ingest(unique, stored, checkpoint).awaitTermination()
    return spark.read.parquet(stored).select("service", "job_id")


STREAM_DEDUP = with_tables(REQUESTS, body="select distinct service, job_id from requests")


def stream_daily(spark, sf):
    detail, checkpoint = _paths(spark, "detail")
    stored = scratch_path(spark, "daily")
    shaped = tables.shape_requests(_stream(spark, sf, "events")).withColumns(
        {
            name: F.lit(None).cast("string")
            for name in ("recorded_at", "event", "level")
        }
    )
    events.daily_statistics(
        shaped, detail, stored, checkpoint, order=["event_id"]
    ).awaitTermination()
    rows = daily.read_daily(spark, stored)
    return rows.withColumn("date", F.col("date").cast("string"))


STREAM_DAILY = requests.DAILY_OF_REQUESTS


SLIDE, MOVING = timedelta(days=30), timedelta(days=90)


def stream_job_summary(spark, sf):
    """A report of ninety days every thirty, from versions of jobs in mixed order."""
    stored, checkpoint = _paths(spark, "moving")
    facts = dbreport.job_facts(
        with_utc_times(tables.jobs(spark, sf)), StatusCodes(), other="other", unnamed="unknown"
    ).select("uuid", "process", "state", "seconds", "started_at", "ended_at")
    opened = facts.withColumns(
        {
            "state": F.when(F.col("state").isin("accepted", "running"), F.col("state")).otherwise("running"),
            "seconds": F.lit(None).cast("double"),
            "event_time": F.col("started_at"),
            "ended_at": F.lit(None).cast("timestamp"),
        }
    )
    closed = facts.where("ended_at is not null").withColumn("event_time", F.greatest("started_at", "ended_at"))
    versions = opened.unionByName(closed)
    stream = _in_batches(versions, "event_time", timedelta(days=20))
    moving_job_summary(stream, MOVING, SLIDE, stored, checkpoint, late=timedelta(days=20)).awaitTermination()
    return spark.read.parquet(stored).drop("batch_id").withColumn("slide", times.iso_text("slide"))


STREAM_JOBS = with_tables(
    JOBS,
    JOB_FACTS,
    """moments as (select unnest(generate_series((select time_bucket(interval 30 day, min(started_at), timestamp '1970-01-01') from facts) + interval 30 day,
  (select max(greatest(started_at, coalesce(ended_at, started_at))) from facts) - interval 20 day, interval 30 day)) as slide)""",
    """placed as (select slide, coalesce(identifier, 'unknown') as process, seconds, started_at >= slide - interval 90 day as recent,
  case when state in ('accepted','running') then state when ended_at is not null and ended_at > slide then 'running'
    when state in ('successful','failed') then state else 'other' end as state
  from facts, moments where started_at <= slide)""",
    "windowed as (select *, state in ('accepted','running') as active from placed)",
    body=f"""select slide, process, active, requests, successful, failed, other, success_rate, measured, median_seconds, p95_seconds, max_seconds from (
select {iso('slide')} as slide, process, count(case when active then 1 end) as active, {job_checks.REPORT_MEASURES.replace("'unmapped'", "'other'")}
from windowed where recent or active group by 1, 2
union all select {iso('slide')}, '(all)', count(case when active and recent then 1 end), {job_checks.REPORT_MEASURES.replace("'unmapped'", "'other'")}
from windowed where recent or active group by 1)""",
)


def stream_hourly_metrics(spark, sf):
    stored, checkpoint = _paths(spark, "hourly")
    changes = host_streams.metric_windows(
        tables.shape_metrics(_stream(spark, sf, "events"))
    )
    stream_tables.upsert_stream(changes, stored, checkpoint).awaitTermination()
    latest = stream_tables.latest_versions(spark, stored, [*SERIES, "period"])
    return latest.withColumn("period", times.iso_text("period"))


STREAM_METRICS = with_tables(
    METRICS,
    body=f"""select host, plugin, metric, "column", {iso("date_trunc('hour', ts)")} as period, count(value) as count,
round(min(value),2) as minimum, round(max(value),2) as maximum from metrics group by all""",
)


def stream_sliding_metrics(spark, sf):
    """Moving three-hour windows every hour."""
    stored, checkpoint = _paths(spark, "sliding")
    changes = host_streams.metric_windows(
        tables.shape_metrics(_stream(spark, sf, "events")), "3 hours", "1 hour"
    )
    stream_tables.upsert_stream(changes, stored, checkpoint).awaitTermination()
    latest = stream_tables.latest_versions(spark, stored, [*SERIES, "period"])
    return latest.withColumn("period", times.iso_text("period"))


STREAM_SLIDING = with_tables(
    METRICS,
    body=f"""select host, plugin, metric, "column", {iso("date_trunc('hour', ts) - to_hours(i)")} as period, count(value) as count,
round(min(value),2) as minimum, round(max(value),2) as maximum from metrics, (select unnest([0,1,2]) as i) group by all""",
)


POLL_START = datetime(2024, 1, 1)
POLL_NOW = POLL_START + timedelta(hours=11)
POLL_LATE = timedelta(minutes=20)
POLL_THRESHOLDS = Thresholds(min_poll_count=2, min_poll_span_minutes=60)


def stream_missing_status(spark, sf):
    """Polls of a month put into half a day; those after eleven hours lie in the future."""
    stored, checkpoint = _paths(spark, "polls")
    start = F.unix_micros(F.lit(POLL_START).cast("timestamp"))
    accesses = access_log.parse_access_log(tables.access_lines(spark, sf)).withColumn(
        "ts", F.timestamp_micros(start + F.floor((F.unix_micros("ts") - start) / 60))
    )
    stream = findings.not_from_the_future(
        _in_batches(accesses, "ts", POLL_LATE), F.lit(POLL_NOW).cast("timestamp")
    )
    windows = stream_findings_of.missing_status_windows(
        findings.failed_status_polls(stream, "/outputs/alpha"), POLL_THRESHOLDS, late="20 minutes"
    )
    events.ingest(windows, stored, checkpoint).awaitTermination()
    return spark.read.parquet(stored).withColumns(
        {
            name: times.iso_text(name)
            for name in ("window_end", "first_seen", "last_seen")
        }
    )


STREAM_MISSING = with_tables(
    ACCESS,
    """failed as (select uuid, polled from (select uuid, make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000)//60) as polled
  from access where method in ('GET','HEAD') and status=404 and service_path='alpha') where polled <= timestamp '2024-01-01 11:05:00')""",
    body=f"""select {iso('window_end')} as window_end, job_id, polls, {iso('first_seen')} as first_seen, {iso('last_seen')} as last_seen from (
select time_bucket(interval 5 minute, polled) + to_minutes(5*i) as window_end, uuid as job_id, count(*) as polls, min(polled) as first_seen, max(polled) as last_seen
from failed, (select unnest(generate_series(1, 38)) as i) group by all having count(*) >= 2 and epoch_us(max(polled)) - epoch_us(min(polled)) >= 3600000000)
where window_end <= (select max(polled) - interval 20 minute from failed)""",
)

STREAM_THRESHOLDS = Thresholds()
UPDATE_LATE = timedelta(days=40)


def stream_findings(spark, sf):
    """Started, accepted and finished jobs as updates; findings as they fall due."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    stored, checkpoint = _paths(spark, "findings")
    timed = with_utc_times(tables.jobs(spark, sf))
    opened = F.struct(
        F.when(F.col("status").isin(1, 2, 3), F.col("status")).otherwise(2).alias("status"),
        F.col("started_at").alias("event_time"),
    )
    closed = F.struct(F.col("status"), F.greatest("started_at", "ended_at").alias("event_time"))
    updates = timed.select(
        F.col("uuid").alias("job_id"),
        F.inline(
            F.when(F.col("ended_at").isNull(), F.array(opened)).otherwise(
                F.array(opened, closed)
            )
        ),
    )
    stream = _in_batches(updates, "event_time", UPDATE_LATE)
    found = stream_findings_of.job_findings(stream, STREAM_THRESHOLDS, StatusCodes(), "40 days")
    spark.conf.set(provider, ROCKSDB_PROVIDER)
    try:
        events.ingest(found, stored, checkpoint).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(stored).withColumn("due_at", times.iso_text("due_at"))


STREAM_FINDINGS = with_tables(
    JOBS,
    """watched as (select uuid, case when status in (1,2,3) then status else 2 end as opened, started_at,
  case when status not in (1,2,3) then greatest(started_at, ended_at) end as closed from jobs)""",
    body=f"""select uuid as job_id, finding, {iso("date_trunc('millisecond', due)")} as due_at from (
select uuid, closed, 'long-running' as finding, started_at + interval 10 minute as due from watched where opened=2
union all select uuid, closed, 'stalled', started_at + interval 95 minute from watched where opened=2
union all select uuid, closed, 'stalled', started_at + interval 24 hour from watched where opened=1)
where (closed is null or closed > due) and due <= (select max(greatest(started_at, coalesce(closed, started_at))) - interval 40 day from watched)""",
)


def stream_alerts(spark, sf):
    """Snapshots whose rows are spread over several batches."""
    stored, checkpoint = _paths(spark, "alerts")
    lines = tables.queue_lines(spark, sf).select("snapshot_ts", "value")
    host_streams.alert_transitions(
        queue_source.queue_jobs(_in_batches(lines, "snapshot_ts", timedelta(days=10))),
        queue_source.capacity(tables.capacity_lines(spark, sf)),
        stored,
        checkpoint,
        long_running_seconds=hosts.LONG_RUNNING,
        pending_critical=hosts.PENDING_CRITICAL,
        late="10 days",
    ).awaitTermination()
    return (
        spark.read.parquet(stored)
        .drop("batch_id")
        .withColumn("snapshot_ts", times.iso_text("snapshot_ts"))
    )


STREAM_ALERTS = with_tables(
    QUEUE,
    CAPACITY,
    hosts.PRESSURE_SQL,
    hosts.ISSUES_SQL,
    f"alerts as ({hosts.ALERT_SELECT})",
    body="""select * exclude (before) from (select *, lag(status, 1, 'clear') over (order by snapshot_ts) as before from alerts)
where status <> before and snapshot_ts <= (select strftime(max(snapshot_ts) - interval 10 day, '%Y-%m-%dT%H:%M:%S.%f') from queue)""",
)

REGISTRY = {
    "stream_ingest": (stream_ingest, STREAM_INGEST),
    "stream_rejects": (stream_rejects, documents.XML_REJECTS),
    "stream_dedup": (stream_dedup, STREAM_DEDUP),
    "stream_daily": (stream_daily, STREAM_DAILY),
    "stream_job_summary": (stream_job_summary, STREAM_JOBS),
    "stream_hourly_metrics": (stream_hourly_metrics, STREAM_METRICS),
    "stream_sliding_metrics": (stream_sliding_metrics, STREAM_SLIDING),
    "stream_missing_status": (stream_missing_status, STREAM_MISSING),
    "stream_findings": (stream_findings, STREAM_FINDINGS),
    "stream_alerts": (stream_alerts, STREAM_ALERTS),
}
