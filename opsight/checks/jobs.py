"""Queries over the job table, with their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from opsight.checks.sql_tables import JOB_FACTS, JOBS, category, iso, with_tables
from opsight.functions import jobs as job_columns
from opsight.functions import times
from opsight.operators import dbreport, findings
from opsight.params import StatusCodes, Thresholds, parse_time_range
from opsight.sources import driver_tables as tables
from opsight.sources import jobs as job_source

NOW = datetime(2001, 8, 2, tzinfo=timezone.utc)
WINDOW = timedelta(days=30)
CODES = StatusCodes()
# Ages in proportion to the seven years the test orders span.
THRESHOLDS = Thresholds(
    xml_stale_minutes=1_000_000,
    database_stale_minutes=1_000_000,
    accepted_stale_hours=20_000,
    long_running_minutes=500_000,
)


def _timed(spark, sf):
    return job_columns.with_utc_times(tables.jobs(spark, sf))


def _facts(spark, sf):
    return dbreport.job_facts(_timed(spark, sf), CODES)


def _window_facts(spark, sf):
    since = job_source.recent_or_active_jobs(tables.jobs(spark, sf), NOW - WINDOW, CODES)
    return dbreport.job_facts(since, CODES, other="other", unnamed="unknown")


def job_scan_range(spark, sf):
    period = parse_time_range("1997-03/1997-04-15T12:00:00Z")
    chosen = job_source.jobs_in_range(tables.jobs(spark, sf), period, "subset")
    return chosen.select(
        "uuid", "status", times.iso_text("started_at").alias("started_at")
    )


JOB_SCAN_RANGE = with_tables(
    JOBS,
    body=f"""select uuid, status, {iso('started_at')} as started_at from jobs where identifier='subset'
and started_at >= timestamp '1997-03-01' and started_at <= timestamp '1997-04-15 12:00:00'""",
)


def job_scan_active(spark, sf):
    chosen = job_source.recent_or_active_jobs(tables.jobs(spark, sf), NOW - WINDOW, CODES)
    return chosen.select(
        "uuid", "status", times.iso_text("started_at").alias("started_at")
    )


JOB_SCAN_ACTIVE = with_tables(
    JOBS,
    body=f"""select uuid, status, {iso('started_at')} as started_at from jobs
where status in (1,2,3) or time_start >= timestamp '2001-07-03' - interval 14 hour""",
)


def range_filter(spark, sf):
    """Requests per status of a year, a month and a date."""
    jobs = tables.jobs(spark, sf)
    parts = None
    for text in ("1996", "1997-02", "1998-05-09"):
        chosen = job_source.jobs_in_range(jobs, parse_time_range(text))
        counted = chosen.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))
        counted = counted.withColumn("period", F.lit(text))
        parts = counted if parts is None else parts.unionByName(counted)
    return parts


RANGE_FILTER = with_tables(
    JOBS,
    body="""select '1996' as period, status, count(*) as jobs from jobs where year(started_at)=1996 group by all
union all select '1997-02', status, count(*) from jobs where year(started_at)=1997 and month(started_at)=2 group by all
union all select '1998-05-09', status, count(*) from jobs where cast(started_at as date)=date '1998-05-09' group by all""",
)


def uuid1_time(spark, sf):
    return tables.jobs(spark, sf).select(
        "uuid", times.iso_text(times.uuid1_instant("uuid")).alias("created")
    )


UUID1_TIME = with_tables(JOBS, body=f"select uuid, {iso('started_at')} as created from jobs")


def wallclock_offset(spark, sf):
    return _timed(spark, sf).select(
        "uuid",
        "offset_minutes",
        times.iso_text("started_at").alias("started_at"),
        times.iso_text("ended_at").alias("ended_at"),
    )


WALLCLOCK_OFFSET = with_tables(
    JOBS,
    body=f"select uuid, offset_minutes, {iso('started_at')} as started_at, {iso('ended_at')} as ended_at from jobs",
)


def status_map(spark, sf):
    return _facts(spark, sf).select("uuid", "status", "state")


STATUS_MAP = with_tables(JOBS, JOB_FACTS, body="select uuid, status, state from facts")


def job_durations(spark, sf):
    now = times.instant(NOW)
    return _facts(spark, sf).select(
        "uuid",
        "seconds",
        F.when(F.col("state").isin("accepted", "running"), job_columns.age_seconds(now)).alias(
            "age_seconds"
        ),
    )


JOB_DURATIONS = with_tables(
    JOBS,
    JOB_FACTS,
    body="""select uuid, seconds, case when state in ('accepted','running')
then (epoch_us(timestamp '2001-08-02')-epoch_us(started_at))/1e6 end as age_seconds from facts""",
)

STATES = ", ".join(
    f"count(case when state='{name}' then 1 end) as {name}"
    for name in ("accepted", "running", "successful", "failed", "dismissed", "unmapped")
)
RATE = "count(case when state='successful' then 1 end)*100.0/nullif(count(case when state in ('successful','failed') then 1 end),0)"


def status_counts(spark, sf):
    return dbreport.status_counts(_facts(spark, sf))


STATUS_COUNTS = with_tables(
    JOBS,
    JOB_FACTS,
    body=f"select count(*) as total, {STATES}, round({RATE},2) as success_rate_percent from facts",
)


def status_share(spark, sf):
    return dbreport.status_share(_facts(spark, sf))


STATUS_SHARE = with_tables(
    JOBS,
    JOB_FACTS,
    body="""select state, count(*) as count, round(count(*)*100.0/sum(count(*)) over (),2) as share_percent from facts group by state""",
)

SCOPED = """scoped as (select process, seconds from facts where seconds is not null
union all select '(all)', seconds from facts where seconds is not null)"""


def numeric_summary(spark, sf):
    return dbreport.numeric_summary(_facts(spark, sf))


NUMERIC_SUMMARY = with_tables(
    JOBS,
    JOB_FACTS,
    SCOPED,
    body="""select process, count(*) as count, min(seconds) as minimum, max(seconds) as maximum,
median(seconds) as median, sum(seconds) as total from scoped group by process""",
)


def duration_histogram(spark, sf):
    return dbreport.duration_histogram(_facts(spark, sf))


DURATION_HISTOGRAM = with_tables(
    JOBS,
    JOB_FACTS,
    body="""select count(*) as count, count(case when seconds<60 then 1 end) as under_1_minute,
count(case when seconds>=60 and seconds<600 then 1 end) as from_1_to_under_10_minutes,
count(case when seconds>=600 and seconds<1800 then 1 end) as from_10_to_under_30_minutes,
count(case when seconds>=1800 then 1 end) as from_30_minutes, max(seconds) as maximum
from facts where state='successful' and seconds is not null""",
)


def requests_per_day(spark, sf):
    return dbreport.requests_per_day(_facts(spark, sf))


REQUESTS_PER_DAY = with_tables(
    JOBS,
    JOB_FACTS,
    body="""select count(*) as days, min(n) as minimum, max(n) as maximum, median(n) as median
from (select cast(started_at as date), count(*) as n from facts group by 1)""",
)


def process_report(spark, sf):
    return dbreport.process_report(_facts(spark, sf))


PROCESS_REPORT = with_tables(
    JOBS,
    JOB_FACTS,
    body=f"""select process, count(*) as total, {STATES}, count(seconds) as measured, min(seconds) as min_seconds,
max(seconds) as max_seconds, median(seconds) as median_seconds, sum(seconds) as total_seconds,
count(case when state in ('accepted','running') then 1 end) as active,
count(case when state in ('dismissed','unmapped') then 1 end) as other,
round({RATE},1) as success_rate_percent from facts group by process""",
)


def error_groups(spark, sf):
    return dbreport.error_groups(_facts(spark, sf), top=5).withColumns(
        {name: times.iso_text(name) for name in ("first", "last")}
    )


ERROR_GROUPS = with_tables(
    JOBS,
    JOB_FACTS,
    body=f"""select message, count, {iso('first')} as first, {iso('last')} as last from (
select message, count(*) as count, min(started_at) as first, max(started_at) as last from facts
where state='failed' group by message order by count desc, last desc, message limit 5)""",
)

WINDOWED = """windowed as (select f.* replace (coalesce(identifier,'unknown') as process),
  started_at between timestamp '2001-07-03' and timestamp '2001-08-02' as recent,
  state in ('accepted','running') as active from facts f)"""
REPORT_MEASURES = f"""count(case when recent then 1 end) as requests,
count(case when recent and state='successful' then 1 end) as successful, count(case when recent and state='failed' then 1 end) as failed,
count(case when recent and state='unmapped' then 1 end) as other,
round(count(case when recent and state='successful' then 1 end)*100.0/nullif(count(case when recent and state in ('successful','failed') then 1 end),0),2) as success_rate,
count(case when recent and not active then seconds end) as measured,
median(case when recent and not active then seconds end) as median_seconds,
quantile_disc(case when recent and not active then seconds end, 0.95) as p95_seconds,
max(case when recent and not active then seconds end) as max_seconds"""


def window_job_report(spark, sf):
    return dbreport.window_job_report(_window_facts(spark, sf), NOW, WINDOW)


WINDOW_JOB_REPORT = with_tables(
    JOBS,
    JOB_FACTS,
    WINDOWED,
    body=f"""select process, count(case when active then 1 end) as active, {REPORT_MEASURES} from windowed where recent or active group by process
union all select '(all)', count(case when active and recent then 1 end), {REPORT_MEASURES} from windowed where recent or active""",
)


def window_failure_categories(spark, sf):
    return dbreport.window_failure_categories(_window_facts(spark, sf), NOW, WINDOW)


WINDOW_FAILURES = with_tables(
    JOBS,
    JOB_FACTS,
    WINDOWED,
    body=f"select {category('message')} as category, count(*) as failures from windowed where recent and state='failed' group by 1",
)


def active_jobs(spark, sf):
    return dbreport.active_jobs(_window_facts(spark, sf), NOW, WINDOW).withColumn(
        "started_at", times.iso_text("started_at")
    )


ACTIVE_JOBS = with_tables(
    JOBS,
    JOB_FACTS,
    WINDOWED,
    body=f"""select uuid as job_id, process, state as status, {iso('started_at')} as started_at,
(epoch_us(timestamp '2001-08-02')-epoch_us(started_at))/1e6 as age_seconds, recent as in_window from windowed where active""",
)


def duration_summary_ceil(spark, sf):
    return dbreport.duration_summary_ceiling(_facts(spark, sf))


DURATION_CEIL = with_tables(
    JOBS,
    JOB_FACTS,
    body="""select process, count(*) as count, median(seconds) as median_seconds, quantile_disc(seconds, 0.95) as p95_seconds,
max(seconds) as max_seconds from facts where seconds is not null group by process""",
)


def recent_status_mix(spark, sf):
    return dbreport.recent_status_mix(
        _facts(spark, sf), NOW, timedelta(hours=THRESHOLDS.status_window_hours)
    )


RECENT_MIX = with_tables(
    JOBS,
    JOB_FACTS,
    body=f"""select count(*) as total, {STATES} from facts where started_at between timestamp '2001-08-01' and timestamp '2001-08-02'""",
)

DB_FINDINGS = """db_findings as (select * from (select 'database' as layer, uuid as job_id, state as status,
  case when status=2 and started_at <= timestamp '2001-08-02' - interval 1000000 minute then 'stalled'
       when status=1 and started_at <= timestamp '2001-08-02' - interval 20000 hour then 'stalled'
       when status=2 and started_at <= timestamp '2001-08-02' - interval 500000 minute then 'long-running' end as finding,
  started_at as evidence_ts, cast(null as varchar) as reason from facts where status in (1,2)) where finding is not null)"""


def database_findings(spark, sf):
    return findings.job_findings(tables.jobs(spark, sf), NOW, THRESHOLDS, CODES)


def job_findings(spark, sf):
    return database_findings(spark, sf).withColumn(
        "evidence_ts", times.iso_text("evidence_ts")
    )


JOB_FINDINGS = with_tables(
    JOBS,
    JOB_FACTS,
    DB_FINDINGS,
    body=f"select * replace ({iso('evidence_ts')} as evidence_ts), cast(null as varchar) as evidence from db_findings",
)

REGISTRY = {
    "job_scan_range": (job_scan_range, JOB_SCAN_RANGE),
    "job_scan_active": (job_scan_active, JOB_SCAN_ACTIVE),
    "range_filter": (range_filter, RANGE_FILTER),
    "uuid1_time": (uuid1_time, UUID1_TIME),
    "wallclock_offset": (wallclock_offset, WALLCLOCK_OFFSET),
    "status_map": (status_map, STATUS_MAP),
    "job_durations": (job_durations, JOB_DURATIONS),
    "status_counts": (status_counts, STATUS_COUNTS),
    "status_share": (status_share, STATUS_SHARE),
    "numeric_summary": (numeric_summary, NUMERIC_SUMMARY),
    "duration_histogram": (duration_histogram, DURATION_HISTOGRAM),
    "requests_per_day": (requests_per_day, REQUESTS_PER_DAY),
    "process_report": (process_report, PROCESS_REPORT),
    "error_groups": (error_groups, ERROR_GROUPS),
    "window_job_report": (window_job_report, WINDOW_JOB_REPORT),
    "window_failure_categories": (window_failure_categories, WINDOW_FAILURES),
    "active_jobs": (active_jobs, ACTIVE_JOBS),
    "duration_summary_ceil": (duration_summary_ceil, DURATION_CEIL),
    "recent_status_mix": (recent_status_mix, RECENT_MIX),
    "job_findings": (job_findings, JOB_FINDINGS),
}
