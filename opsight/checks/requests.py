"""Queries over request and operation events, with their SQL."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.checks.sql_tables import (
    DEDUPED,
    OPERATIONS,
    REQUESTS,
    category,
    iso,
    with_tables,
)
from opsight.functions import text, times
from opsight.operators import daily, dedup, insights
from opsight.params import TimeRange, parse_time, parse_time_range
from opsight.session import scratch_path
from opsight.sources import driver_tables as tables
from opsight.sources import incidents as incident_source
from opsight.sources import events as event_source
from opsight.sources.status_xml import new_requests

NOW = datetime(2024, 1, 30, 12, 0, 0, tzinfo=timezone.utc)


def _deduped(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_requests(tables.requests(spark, sf), ["event_id"])


def _operation_events(spark: SparkSession, sf: str) -> DataFrame:
    events = event_source.log_events(tables.operations(spark, sf))
    return events.withColumn("event_time", F.col("recorded_at"))


def _all_events(spark: SparkSession, sf: str) -> DataFrame:
    return _deduped(spark, sf).unionByName(
        _operation_events(spark, sf), allowMissingColumns=True
    )


def select_requests(spark, sf):
    chosen = insights.select_requests(
        tables.requests(spark, sf), parse_time_range("2024-01-10/2024-01-20"), "subset"
    )
    return chosen.select(
        "event_id", "job_id", "process", times.iso_text("event_time").alias("event_time")
    )


SELECT_REQUESTS = with_tables(
    REQUESTS,
    body=f"""select event_id, job_id, process, {iso('event_time')} as event_time from requests
where process = 'subset' and event_time >= timestamp '2024-01-10' and event_time < timestamp '2024-01-21'""",
)


def relative_day_filter(spark, sf):
    period = TimeRange(
        parse_time("yesterday", now=NOW),
        parse_time("today", end=True, now=NOW),
    )
    chosen = insights.select_requests(tables.requests(spark, sf), period)
    return chosen.groupBy("process").agg(F.count(F.lit(1)).alias("requests"))


RELATIVE_DAY = with_tables(
    REQUESTS,
    body="""select process, count(*) as requests from requests
where event_time >= timestamp '2024-01-29' and event_time < timestamp '2024-01-31' group by process""",
)


def ts_normalize(spark, sf):
    """Instants written with and without zones, dates, and unusable texts."""
    stamped = tables.requests(spark, sf).withColumn(
        "text",
        F.expr(
            "case event_id%6 when 0 then date_format(event_time,"
            " \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
            " when 1 then date_format(event_time, \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\")"
            " when 2 then date_format(event_time, 'yyyyMMdd')"
            " when 3 then date_format(event_time, 'yyyy-MM-dd HH:mm:ss')"
            " when 4 then date_format(event_time, 'yyyy') else 'soon' end"
        ),
    )
    return stamped.select(
        "event_id", times.iso_text(times.iso_instant("text")).alias("instant")
    )


TS_NORMALIZE = f"""select event_id, {iso('''case event_id%6 when 0 then ts
  when 1 then date_trunc('second', ts) - interval 2 hour when 2 then date_trunc('day', ts)
  when 3 then date_trunc('second', ts) end''')} as instant from events"""


def event_scan(spark, sf):
    """Requests written as text and parsed back, summed up."""
    parsed = event_source.parse_events(
        event_source.parsed_lines(tables.request_lines(spark, sf))
    )
    return parsed.groupBy("service", "process", "outcome").agg(
        F.count(F.lit(1)).alias("events"),
        F.round(F.sum(F.col("duration_seconds").cast("decimal(18,3)")), 3)
        .cast("double")
        .alias("seconds"),
        times.iso_text(F.min("event_time")).alias("first"),
        F.sum(F.size("failures")).alias("failures"),
    )


EVENT_SCAN = with_tables(
    REQUESTS,
    body=f"""select service, process, outcome, count(*) as events,
cast(sum(cast(duration_seconds as decimal(18,3))) as double) as seconds,
{iso('min(event_time)')} as first, count(message) as failures
from requests where event_id%50 not in (7,13) group by all""",
)


def event_rejects(spark, sf):
    rejects = event_source.event_rejects(
        event_source.parsed_lines(tables.request_lines(spark, sf))
    )
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


EVENT_REJECTS = """select case when event_id%50=7 then 'invalid-json' else 'not-an-object' end as reason,
count(*) as lines from events where event_id%50 in (7,13) group by 1"""


def event_append_defaults(spark, sf):
    """Events appended without version and time get both; the table is read back."""
    path = scratch_path(spark, "events")
    bare = tables.requests(spark, sf).select(
        "event_id",
        "service",
        F.when(F.col("event_id") % 2 == 0, 2).cast("int").alias("schema_version"),
        F.when(
            F.col("event_id") % 3 == 0,
            F.concat(times.iso_text("event_time"), F.lit("+00:00")),
        ).alias("recorded_at"),
        F.to_date("event_time").alias("date"),
    )
    event_source.append_events(bare, path, times.instant(NOW))
    return spark.read.parquet(path).select(
        "event_id", "service", "schema_version", "recorded_at"
    )


EVENT_APPEND = with_tables(
    REQUESTS,
    body=f"""select event_id, service, case when event_id%2=0 then 2 else 1 end as schema_version,
case when event_id%3=0 then concat({iso('event_time')}, '+00:00') else '2024-01-30T12:00:00.000000+00:00' end as recorded_at from requests""",
)


def dedup_requests(spark, sf):
    return _deduped(spark, sf).select("service", "job_id", "event_id", "process")


DEDUP_REQUESTS = with_tables(
    REQUESTS, DEDUPED, body="select service, job_id, event_id, process from deduped"
)


def dedup_operations(spark, sf):
    """Current and rotated copies of the operation log count once."""
    current = _operation_events(spark, sf).withColumn("file", F.lit(0))
    rotated = current.withColumn("file", F.lit(1))
    unique = dedup.dedup_by_content(
        current.unionByName(rotated), ["file", "event_time", "message"]
    )
    return unique.groupBy("event", "level", "file").agg(
        F.count(F.lit(1)).alias("events")
    )


DEDUP_OPERATIONS = with_tables(
    OPERATIONS,
    body="""select event, level, 0 as file, count(*) as events from
(select distinct recorded_at, event, job_id, message, level from operations) group by event, level""",
)


def process_outcomes(spark, sf):
    return insights.process_outcomes(_deduped(spark, sf))


PROCESS_OUTCOMES = with_tables(
    REQUESTS,
    DEDUPED,
    body="""select case when grouping(process)=1 then 'all' else 'process' end as scope,
coalesce(process, '(all)') as process, coalesce(outcome, 'unknown') as outcome, count(*) as requests
from deduped group by grouping sets ((outcome), (process, outcome))""",
)


def duration_summary(spark, sf):
    return insights.duration_summary(_deduped(spark, sf))


DURATION_SUMMARY = with_tables(
    REQUESTS,
    DEDUPED,
    """scoped as (
select 'all' as scope, 'all' as name, duration_seconds as v from deduped where duration_seconds >= 0
union all select 'outcome', coalesce(outcome,'unknown'), duration_seconds from deduped where duration_seconds >= 0
union all select 'process', process, duration_seconds from deduped where duration_seconds >= 0)""",
    """placed as (select *, row_number() over (partition by scope, name order by v) - 1 as pos,
count(*) over (partition by scope, name) as n from scoped)""",
    body="""select scope, name, count(*) as count, round(median(v),3) as median_seconds,
round(max(case when pos = cast(round_even((n-1)*0.95,0) as bigint) then v end),3) as p95_seconds,
round(max(v),3) as max_seconds from placed group by scope, name""",
)


def failure_category(spark, sf):
    failed = insights.failed_with_category(tables.requests(spark, sf))
    return failed.select("event_id", "message", "category")


FAILURE_TEXT = "concat('NoApplicableCode  ', message)"
FAILURE_CATEGORY = with_tables(
    REQUESTS,
    body=f"select event_id, message, {category(FAILURE_TEXT)} as category from requests where outcome='failed'",
)


def failure_categories(spark, sf):
    return insights.failure_categories(_deduped(spark, sf))


FAILURE_CATEGORIES = with_tables(
    REQUESTS,
    DEDUPED,
    body=f"""select {category(FAILURE_TEXT)} as category, count(*) as failures
from deduped where outcome='failed' group by 1""",
)

GROUPS = f"""failed as (select *, {category(FAILURE_TEXT)} as category, 'NoApplicableCode' as code, '' as locator,
coalesce(nullif(message,''),'unknown failure') as text from deduped where outcome='failed'),
grouped as (select category, code, locator, text, count(*) as count from failed group by all)"""


def failure_messages(spark, sf):
    return insights.failure_messages(_deduped(spark, sf), top=5)


FAILURE_MESSAGES = with_tables(
    REQUESTS,
    DEDUPED,
    GROUPS,
    body="select * from grouped order by count desc, category, code, locator, text limit 5",
)


def _incident_paths(spark, sf):
    return tables.table(spark, sf, "events").where("value > 15").select(
        F.concat(
            F.lit("/archive/rook/20240101T000000Z__error__rook__subset__JOB-"),
            F.col("event_id").cast("string"),
            F.lit(".xml"),
        ).alias("path"),
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
    )


def failure_examples(spark, sf):
    incidents = _incident_paths(spark, sf)
    return insights.failure_examples(_deduped(spark, sf), incidents)


FAILURE_EXAMPLES = with_tables(
    REQUESTS,
    DEDUPED,
    GROUPS,
    """named as (select distinct category, code, locator, text, job_id,
  case when job_id in (select concat('job-', cast(event_id as string)) from events where value > 15) then 1 else 0 end as documents from failed)""",
    body="""select * from (select category, code, locator, text, job_id, documents,
row_number() over (partition by category, code, locator, text order by documents desc, job_id) as rank from named)
where rank <= 3""",
)


def failure_report(spark, sf):
    """The most frequent failures with example jobs and their archived documents."""
    requests = _deduped(spark, sf)
    archived = incident_source.incident_index(
        _incident_paths(spark, sf).select(
            F.concat(
                F.lit("/archive/rook/20240101T000000Z__error__rook__subset__"),
                F.lpad(F.regexp_extract("job_id", r"(\d+)$", 1), 8, "0"),
                F.lit("-0000-4000-8000-000000000000.xml"),
            ).alias("path")
        )
    ).withColumn("job_id", F.concat(F.lit("job-"), F.regexp_extract("job_id", "^0*(\\d+)-", 1)))
    rows = insights.with_examples(
        insights.failure_messages(requests, top=5),
        insights.DETAIL_KEYS,
        insights.failure_items(requests),
        archived,
    )
    return rows.withColumns(
        {"example_jobs": F.array_join("example_jobs", ","), "status_xml": F.to_json("status_xml")}
    )


FAILURE_REPORT = with_tables(
    REQUESTS,
    DEDUPED,
    GROUPS,
    """named as (select distinct category, code, locator, text, job_id,
  case when job_id in (select concat('job-', cast(event_id as string)) from events where value > 15) then 1 else 0 end as documents from failed)""",
    """examples as (select *, row_number() over (partition by category, code, locator, text order by documents desc, job_id) as rank from named)""",
    """listed as (select category, code, locator, text, string_agg(job_id, ',' order by rank) as example_jobs,
  concat('{', coalesce(string_agg(concat('"', job_id, '":[{"kind":"error","path":"/archive/rook/20240101T000000Z__error__rook__subset__', lpad(substr(job_id, 5), 8, '0'),
    '-0000-4000-8000-000000000000.xml"}]'), ',' order by rank) filter (where documents > 0), ''), '}') as status_xml
  from examples where rank <= 3 group by all)""",
    body="""select g.*, example_jobs, status_xml from (select * from grouped order by count desc, category, code, locator, text limit 5) g
join listed using (category, code, locator, text)""",
)


def interleaved_failures(spark, sf):
    requests = _deduped(spark, sf)
    groups = insights.failure_messages(requests, top=None)
    ranked = insights.category_rank(insights.failure_categories(requests))
    chosen = insights.interleaved(
        groups, ranked, [F.col("count").desc(), F.col("text")], top=6
    )
    return chosen.select("category", "text", "count", "rank", "category_order")


INTERLEAVED = with_tables(
    REQUESTS,
    DEDUPED,
    GROUPS,
    """cats as (select category, row_number() over (order by case category when 'memory' then 0 when 'timeout' then 1 else 2 end,
  case when category in ('memory','timeout') then 0 else count(*) end desc, category) as category_order from failed group by category)""",
    """placed as (select g.*, row_number() over (partition by category order by count desc, text) as rank from grouped g)""",
    body="""select category, text, count, rank, category_order from placed join cats using (category)
order by rank, category_order limit 6""",
)


def root_cause(spark, sf):
    """Messages wrapped in scheduler output and tracebacks, cut to their cause."""
    wrapped = tables.requests(spark, sf).where("outcome = 'failed'").withColumn(
        "raw",
        F.expr(
            "concat(case event_id%7"
            " when 0 then 'warning slurmstepd: error: *** JOB 7 ON n1 CANCELLED AT 2026-08-12T19:59:13 DUE TO TIME LIMIT *** '"
            " when 1 then 'x slurmstepd: error: *** JOB 8 ON n1 CANCELLED AT 2026-08-19T21:01:02 *** '"
            " when 2 then 'Traceback ValueError: There were no valid data points found in the requested subset. Please wait '"
            " when 3 then concat('Requested datetimes include some not found in the dataset cftime.DatetimeNoLeap(2050, 1) cftime.Datetime360Day(', 2000+event_id%30, ', 2) cftime.DatetimeNoLeap(2015, 3) ')"
            " when 4 then 'Cannot create TimeComponentsParameter from: a Cannot create TimeComponentsParameter from: year:x  Traceback (most recent call last) '"
            " when 5 then 'ValueError: first During handling of it ProcessError:  second   one Traceback ' else '' end, message)"
        ),
    )
    return wrapped.select("event_id", text.root_cause("raw").alias("cause"))


ROOT_CAUSE = with_tables(
    REQUESTS,
    body="""select event_id, case event_id%7
when 0 then 'slurmstepd: error: *** JOB 7 ON n1 CANCELLED AT 2026-08-12T19:59:13 DUE TO TIME LIMIT ***'
when 1 then 'slurmstepd: error: *** JOB 8 ON n1 CANCELLED AT 2026-08-19T21:01:02 ***'
else case when message like 'slurmstepd%' then 'slurmstepd: error: Detected 1 oom-kill event(s) in StepId=7.'
else case event_id%7 when 2 then 'There were no valid data points found in the requested subset.'
when 3 then concat('Requested years not found in dataset: ', list_aggregate(list_sort(list_distinct([2015, 2050, 2000+event_id%30])), 'string_agg', ','))
when 4 then 'Invalid time components: year:x'
else coalesce(nullif(trim(list_extract(regexp_extract_all(
  concat(case when event_id%7=5 then 'ValueError: first During handling of it ProcessError: second one Traceback ' else '' end, message),
  '(?:ProcessError|ValueError|MemoryError|TimeoutError):\\s*(.+?)(?:\\s+During handling|\\s+Traceback|$)', 1), -1)), ''), message) end end end as cause
from requests where outcome='failed'""",
)


def truncate_message(spark, sf):
    long = tables.table(spark, sf, "documents").select(
        "doc_id", text.display_message("text").alias("shown")
    )
    return long


TRUNCATE = """select doc_id, case when length(text) > 300 then concat(regexp_replace(left(text, 295), '\\s+$', ''), ' [..]') else text end as shown from documents"""


def event_period(spark, sf):
    period = insights.event_period(_deduped(spark, sf))
    return period.withColumns(
        {name: times.iso_text(name) for name in ("first", "last")}
    )


EVENT_PERIOD = with_tables(
    REQUESTS,
    DEDUPED,
    body=f"""select string_agg(distinct service, ',' order by service) as services, {iso('min(event_time)')} as first,
{iso('max(event_time)')} as last, count(*) as requests from deduped""",
)


def log_fields(spark, sf):
    fields = text.log_fields("message")
    parsed = tables.operations(spark, sf).select("event_id", fields.alias("f"))

    def field(name):
        return F.try_element_at("f", F.lit(name)).alias(name)

    return parsed.select(
        "event_id",
        *[
            field(name)
            for name in ("layer", "job", "status", "finding", "action", "decision")
        ],
        F.try_element_at("f", F.lit("elapsed_minutes"))
        .try_cast("bigint")
        .alias("elapsed_minutes"),
        F.size("f").alias("fields"),
    )


LOG_FIELDS = with_tables(
    OPERATIONS,
    body="""select event_id, 'database' as layer, job_id as job, 'started' as status,
case event when 'job-long-running' then 'long-running' when 'stalled' then 'stalled' end as finding,
case event when 'job-recovered' then 'recovered' end as action,
case event when 'operation-error' then 'error' end as decision,
case event when 'job-long-running' then 12 end as elapsed_minutes,
case event when 'job-long-running' then 5 when 'operation-error' then 5 else 4 end as fields from operations""",
)


def log_events(spark, sf):
    events = event_source.log_events(tables.operations(spark, sf))
    return events.select(
        "service",
        "event",
        "level",
        "job_id",
        "message",
        times.iso_text("recorded_at").alias("recorded_at"),
    )


LOG_EVENTS = with_tables(
    OPERATIONS,
    body=f"select service, event, level, job_id, message, {iso('recorded_at')} as recorded_at from operations",
)


def operation_summary(spark, sf):
    return insights.operation_summary(_operation_events(spark, sf))


OPERATION_SUMMARY = with_tables(
    OPERATIONS,
    body="""select count(*) as events, count(distinct case when event='job-recovered' then job_id end) as recovered_jobs,
count(distinct case when event='job-long-running' then job_id end) as long_running_jobs,
count(case when event='operation-error' or level='critical' then 1 end) as errors from operations""",
)


def recent_operations(spark, sf):
    recent = insights.recent_operations(
        _operation_events(spark, sf), 10, ["message"]
    )
    return recent.withColumn("event_time", times.iso_text("event_time"))


RECENT_OPERATIONS = with_tables(
    OPERATIONS,
    body=f"""select {iso('recorded_at')} as event_time, event, job_id, message from operations
order by recorded_at desc, message limit 10""",
)


def _with_date_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("date", F.col("date").cast("string"))


def daily_stats(spark, sf):
    return _with_date_text(daily.daily_statistics(_all_events(spark, sf)))


def daily_stats_all_values(spark, sf):
    """Events read from JSON text whose failure messages stand in members of other names."""
    hidden = F.expr(
        "case when message is not null then array(named_struct('hint', message, 'n', 7)) end"
    )
    shaped = tables.requests(spark, sf).withColumn("found", hidden)
    halves = [
        shaped.where(f"event_id%2={half}").select(
            F.col("event_id").alias("line_id"),
            F.expr(
                "to_json(named_struct('record_type', record_type, 'service', service, 'job_id', job_id,"
                " 'process', process, 'outcome', outcome, 'duration_seconds', duration_seconds,"
                " 'finished_at', date_format(event_time, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"),"
                f" '{name}', found))"
            ).alias("value"),
        )
        for half, name in ((0, "failures"), (1, "diagnostics"))
    ]
    lines = halves[0].unionByName(halves[1]).withColumns(
        {"file_path": F.lit("f"), "block_start": F.lit(0).cast("bigint")}
    )
    events = event_source.parse_events(event_source.parsed_lines(lines))
    return _with_date_text(daily.daily_statistics(dedup.dedup_by_content(events, ["line_id"])))


# The same statistics as `daily` rows, reused by the queries on the stored table.
DAILY_TABLES = (
    REQUESTS,
    DEDUPED,
    OPERATIONS,
    f"""measured as (select *, cast(event_time as date) as date, {FAILURE_TEXT} as t,
  row_number() over (partition by cast(event_time as date), service, duration_seconds is null order by duration_seconds) - 1 as pos,
  count(duration_seconds) over (partition by cast(event_time as date), service) as n from deduped)""",
    f"""request_days as (select date, service, count(*) as requests, count(case when outcome='successful' then 1 end) as successful,
  count(case when outcome='failed' then 1 end) as failed, count(duration_seconds) as duration_count,
  coalesce(round(cast(sum(cast(duration_seconds as decimal(18,3))) as double),3),0) as duration_total_seconds,
  round(median(duration_seconds),3) as duration_median_seconds,
  round(max(case when pos = cast(round_even((n-1)*0.95,0) as bigint) then duration_seconds end),3) as duration_p95_seconds,
  round(max(duration_seconds),3) as duration_max_seconds,
  count(case when outcome='failed' and {category('t')}='memory' then 1 end) as memory_failures,
  count(case when outcome='failed' and {category('t')}='timeout' then 1 end) as timeout_failures
  from measured group by date, service)""",
    """operation_days as (select cast(recorded_at as date) as date, service,
  count(distinct case when event='job-recovered' then job_id end) as recovered_jobs,
  count(distinct case when event='job-long-running' then job_id end) as long_running_jobs,
  count(case when event='operation-error' or level='critical' then 1 end) as operation_errors
  from operations group by 1, 2)""",
    """daily as (select date, service, coalesce(requests,0) as requests, coalesce(successful,0) as successful, coalesce(failed,0) as failed,
  coalesce(duration_count,0) as duration_count, coalesce(duration_total_seconds,0.0) as duration_total_seconds, duration_median_seconds,
  duration_p95_seconds, duration_max_seconds, coalesce(memory_failures,0) as memory_failures, coalesce(timeout_failures,0) as timeout_failures,
  coalesce(recovered_jobs,0) as recovered_jobs, coalesce(long_running_jobs,0) as long_running_jobs, coalesce(operation_errors,0) as operation_errors
  from request_days full join operation_days using (date, service))""",
)
DAILY_SELECT = "select * replace (cast(date as varchar) as date) from daily"
DAILY_STATS = with_tables(*DAILY_TABLES, body=DAILY_SELECT)
DAILY_OF_REQUESTS = with_tables(
    *[part for part in DAILY_TABLES if "operation" not in part],
    """daily as (select d.*, 0 as recovered_jobs, 0 as long_running_jobs, 0 as operation_errors from request_days d)""",
    body=DAILY_SELECT,
)


def daily_stats_upsert(spark, sf):
    """Fresh days replace half of a stored table; its older rows stay as written."""
    fresh = daily.daily_statistics(_all_events(spark, sf))
    path = scratch_path(spark, "daily")
    stored = fresh.where("date < '2024-01-20'").withColumns(
        {"requests": F.lit(-1).cast("bigint"), "failed": F.lit(-1).cast("bigint")}
    )
    daily.write_daily(stored, path)
    daily.write_daily(fresh.where("date >= '2024-01-10'"), path)
    return _with_date_text(
        daily.read_daily(spark, path).withColumn("date", F.col("date").cast("date"))
    )


DAILY_UPSERT = with_tables(
    *DAILY_TABLES,
    body="""select * replace (cast(date as varchar) as date, case when date < date '2024-01-10' then -1 else requests end as requests,
case when date < date '2024-01-10' then -1 else failed end as failed) from daily""",
)


def stats_rollup(spark, sf):
    rows = daily.daily_statistics(_all_events(spark, sf))
    total = daily.rollup(rows, date(2024, 1, 5), date(2024, 1, 25))
    return total.withColumns(
        {name: F.col(name).cast("string") for name in ("first", "last")}
    )


STATS_ROLLUP = with_tables(
    *DAILY_TABLES,
    body="""select service, cast(min(date) as varchar) as first, cast(max(date) as varchar) as last,
sum(requests) as requests, sum(successful) as successful, sum(failed) as failed, sum(duration_count) as duration_count,
sum(memory_failures) as memory_failures, sum(timeout_failures) as timeout_failures, sum(recovered_jobs) as recovered_jobs,
sum(long_running_jobs) as long_running_jobs, sum(operation_errors) as operation_errors,
round(sum(successful)*100.0/sum(requests),1) as success_rate,
round(sum(duration_total_seconds)/sum(duration_count),3) as duration_average_seconds,
max(duration_max_seconds) as duration_max_seconds from daily
where date between date '2024-01-05' and date '2024-01-25' group by service""",
)


def stats_retention(spark, sf):
    rows = daily.daily_statistics(_all_events(spark, sf))
    return _with_date_text(daily.retained(rows, date(2024, 1, 30), 7))


STATS_RETENTION = with_tables(
    *DAILY_TABLES, body=DAILY_SELECT + " where date >= date '2024-01-24'"
)


def recent_days(spark, sf):
    rows = daily.daily_statistics(_all_events(spark, sf))
    return _with_date_text(daily.recent_days(rows))


RECENT_DAYS = with_tables(
    *DAILY_TABLES,
    body="""select * replace (cast(date as varchar) as date) from
(select * from daily order by date desc, service limit 14)""",
)


def report_json(spark, sf):
    """Report sections as JSON rows, written and read back as text."""
    path = scratch_path(spark, "report")
    requests = _deduped(spark, sf)
    sections = {
        "outcomes": insights.process_outcomes(requests),
        "failure_categories": insights.failure_categories(requests),
    }
    for name, section in sections.items():
        insights.as_report_rows(section, name).write.mode("append").json(path)
    return spark.read.schema("section string, row string").json(path)


REPORT_JSON = with_tables(
    REQUESTS,
    DEDUPED,
    GROUPS,
    body="""select 'failure_categories' as section, concat('{"category":"', category, '","failures":', count(*), '}') as row
from failed group by category
union all
select 'outcomes', concat('{"scope":"', case when grouping(process)=1 then 'all' else 'process' end, '","process":"',
coalesce(process, '(all)'), '","outcome":"', coalesce(outcome,'unknown'), '","requests":', count(*), '}')
from deduped group by grouping sets ((outcome), (process, outcome))""",
)


def new_requests_only(spark, sf):
    """Requests not seen by an earlier run that stopped at mid-month."""
    requests = tables.requests(spark, sf)
    recorded = requests.where("event_time < timestamp'2024-01-15'")
    return new_requests(requests, recorded).select("event_id", "job_id")


NEW_REQUESTS = with_tables(
    REQUESTS,
    body="""select event_id, job_id from requests where job_id not in
(select job_id from requests where event_time < timestamp '2024-01-15')""",
)

REGISTRY = {
    "event_scan": (event_scan, EVENT_SCAN),
    "event_rejects": (event_rejects, EVENT_REJECTS),
    "event_append_defaults": (event_append_defaults, EVENT_APPEND),
    "ts_normalize": (ts_normalize, TS_NORMALIZE),
    "select_requests": (select_requests, SELECT_REQUESTS),
    "relative_day_filter": (relative_day_filter, RELATIVE_DAY),
    "dedup_requests": (dedup_requests, DEDUP_REQUESTS),
    "dedup_operations": (dedup_operations, DEDUP_OPERATIONS),
    "new_requests_only": (new_requests_only, NEW_REQUESTS),
    "process_outcomes": (process_outcomes, PROCESS_OUTCOMES),
    "duration_summary": (duration_summary, DURATION_SUMMARY),
    "failure_category": (failure_category, FAILURE_CATEGORY),
    "failure_categories": (failure_categories, FAILURE_CATEGORIES),
    "failure_messages": (failure_messages, FAILURE_MESSAGES),
    "failure_report": (failure_report, FAILURE_REPORT),
    "failure_examples": (failure_examples, FAILURE_EXAMPLES),
    "interleaved_failures": (interleaved_failures, INTERLEAVED),
    "root_cause": (root_cause, ROOT_CAUSE),
    "truncate_message": (truncate_message, TRUNCATE),
    "event_period": (event_period, EVENT_PERIOD),
    "log_fields": (log_fields, LOG_FIELDS),
    "log_events": (log_events, LOG_EVENTS),
    "operation_summary": (operation_summary, OPERATION_SUMMARY),
    "recent_operations": (recent_operations, RECENT_OPERATIONS),
    "daily_stats_all_values": (daily_stats_all_values, DAILY_OF_REQUESTS),
    "daily_stats": (daily_stats, DAILY_STATS),
    "daily_stats_upsert": (daily_stats_upsert, DAILY_UPSERT),
    "stats_rollup": (stats_rollup, STATS_ROLLUP),
    "stats_retention": (stats_retention, STATS_RETENTION),
    "recent_days": (recent_days, RECENT_DAYS),
    "report_json": (report_json, REPORT_JSON),
}
