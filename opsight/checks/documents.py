"""Queries over status documents, dumps, access logs and the recovery plan."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.checks import jobs as job_checks
from opsight.checks.sql_tables import (
    ACCESS,
    ALL_DUMPS,
    DOCUMENTS,
    DUMPS,
    EVIDENCE,
    JOB_FACTS,
    JOBS,
    iso,
    with_tables,
)
from opsight.functions import text, times
from opsight.operators import findings
from opsight.params import Thresholds
from opsight.plans import monitor
from opsight.session import scratch_path
from opsight.sources import access_log, dumps, incidents, status_xml
from opsight.sources import driver_tables as tables

NOW = job_checks.NOW
THRESHOLDS = job_checks.THRESHOLDS
POLL_NOW = datetime(2024, 1, 30, 12, 0, 0, tzinfo=timezone.utc)
POLL_THRESHOLDS = Thresholds(
    poll_window_minutes=14_400, min_poll_count=3, min_poll_span_minutes=5_000
)


def _parsed(spark, sf):
    return status_xml.parse_status(tables.status_documents(spark, sf))


def _requests(spark, sf):
    return status_xml.status_requests(_parsed(spark, sf), "rook")


def _dumps(spark, sf):
    return dumps.parse_dumps(tables.job_dumps(spark, sf))


def _errors(spark, sf):
    return tables.error_outputs(spark, sf)


def xml_requests(spark, sf):
    first = F.get("failures", F.lit(0))
    return _requests(spark, sf).select(
        "job_id",
        "process",
        "outcome",
        "duration_seconds",
        "duration_source",
        times.iso_text("finished_at").alias("finished_at"),
        first["code"].alias("code"),
        first["locator"].alias("locator"),
        first["message"].alias("message"),
        F.to_json("inputs").alias("inputs"),
    )


INPUTS = """case when o_orderkey%8=4 then concat('{"site":[{"type":"LiteralData","value":"north ', o_orderkey%3,
' end","attributes":{"dataType":"string","note":"a>b"}},{"type":"ComplexData","value":"{\\"k\\": <1>}"}],"file":[{"type":"reference","value":"https://data.test/a b/',
o_custkey, '.nc"}]}') else '{}' end as inputs"""
STARTED = "coalesce(uuid_time, creation_time)"
OUTCOME = "case final_state when 'ProcessFailed' then 'failed' else 'successful' end as outcome"
DURATION = f"greatest(0, (epoch_us(modification_time) - epoch_us({STARTED}))/1e6) as duration_seconds"
REQUEST_COLUMNS = f"""job_id, process, {OUTCOME}, {DURATION},
case when uuid_time is not null then 'uuid1' else 'status_creation_time' end as duration_source,
{iso('modification_time')} as finished_at, case final_state when 'ProcessFailed' then 'NoApplicableCode' end as code,
case final_state when 'ProcessFailed' then 'dataset' end as locator, case final_state when 'ProcessFailed' then 'Dataset not found' end as message,
{INPUTS}"""
XML_REQUESTS = with_tables(
    DOCUMENTS,
    body=f"select {REQUEST_COLUMNS} from status_docs where final_state is not null",
)


def xml_rejects(spark, sf):
    return status_xml.rejected_documents(_parsed(spark, sf)).select("job_id", "reject")


XML_REJECTS = with_tables(
    DOCUMENTS, body="select job_id, reject from status_docs where reject is not null"
)


def xml_time_fix(spark, sf):
    """Creation times on a local clock, near the file time, and unrelated to it."""
    documents = tables.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "cast(o_orderdate + interval 10 hour as timestamp) as modified",
    )
    labelled = F.expr(
        "case o_orderkey%3 when 0 then from_utc_timestamp(modified, 'Europe/Berlin')"
        " when 1 then modified + interval 2 minute else modified - interval 1 day end"
    )
    fixed = times.corrected_creation_time(
        F.col("labelled"), F.col("modified"), "Europe/Berlin"
    )
    return documents.withColumn("labelled", labelled).select(
        "o_orderkey", times.iso_text(fixed).alias("creation_time")
    )


XML_TIME_FIX = f"""select o_orderkey, {iso('''case o_orderkey%3 when 0 then o_orderdate + interval 10 hour
when 1 then o_orderdate + interval 602 minute else o_orderdate - interval 14 hour end''')} as creation_time from orders"""


def job_diagnostics(spark, sf):
    whole = dumps.parse_dumps(tables.all_job_dumps(spark, sf))
    rows = dumps.job_diagnostics(whole, _errors(spark, sf))
    return rows.select(
        "job_id",
        F.size("diagnostics").alias("items"),
        F.get("diagnostics", F.lit(0))["message"].alias("message"),
    )


DIAGNOSTICS = """diagnostics as (
select job_id, arg_max(error_text, directory) as message from dumps where parsed group by job_id)"""
JOB_DIAGNOSTICS = with_tables(
    ALL_DUMPS, DIAGNOSTICS, body="select job_id, 1 as items, message from diagnostics"
)


def requests_with_diagnostics(spark, sf):
    attached = status_xml.with_diagnostics(
        _requests(spark, sf), dumps.job_diagnostics(_dumps(spark, sf), _errors(spark, sf))
    )
    return attached.select(
        "job_id",
        "outcome",
        F.get("diagnostics", F.lit(0))["message"].alias("message"),
    )


REQUESTS_WITH_DIAGNOSTICS = with_tables(
    DOCUMENTS,
    DUMPS,
    DIAGNOSTICS,
    body=f"""select s.job_id, {OUTCOME},
case final_state when 'ProcessFailed' then d.message end as message
from status_docs s left join diagnostics d using (job_id) where final_state is not null""",
)


def _started(spark, sf):
    parsed = status_xml.parse_status(tables.status_documents(spark, sf), with_inputs=False)
    return parsed.where("state = 'ProcessStarted' and problem is null").select("job_id")


def oom_marker(spark, sf):
    return dumps.oom_jobs(_started(spark, sf), tables.job_dumps(spark, sf), _errors(spark, sf))


OOM_MARKER = with_tables(
    DOCUMENTS,
    DUMPS,
    EVIDENCE,
    body="select job_id from status_docs join evidence using (job_id) where state='ProcessStarted' and oom",
)


def dump_match(spark, sf):
    return findings.dump_match(_started(spark, sf), _dumps(spark, sf))


DUMP_MATCH = with_tables(
    DOCUMENTS,
    DUMPS,
    EVIDENCE,
    body="""select s.job_id, coalesce(n, 0) as dumps, case when n is null then 'missing' when n=1 then 'matched' else 'duplicate' end as match,
directory from status_docs s left join evidence d using (job_id) where state='ProcessStarted'""",
)


def _xml_findings(spark, sf):
    parsed = status_xml.parse_status(tables.status_documents(spark, sf), with_inputs=False)
    return findings.xml_findings(
        parsed, tables.job_dumps(spark, sf), _errors(spark, sf), NOW, THRESHOLDS
    )


def xml_findings(spark, sf):
    return _xml_findings(spark, sf).withColumn(
        "evidence_ts", times.iso_text("evidence_ts")
    )


XML_SQL = f"""{EVIDENCE},
xml_findings as (select * from (select 'xml' as layer, job_id, 'running' as status,
  case when problem is not null then 'error' when state is distinct from 'ProcessStarted' then null
    when modification_time > timestamp '2001-08-02' - interval 500000 minute then null
    when n > 1 then 'error' when oom then 'slurm-oom'
    when modification_time <= timestamp '2001-08-02' - interval 1000000 minute then 'stalled' end as finding,
  modification_time as evidence_ts, case when problem is not null then problem when n > 1 then 'several job dumps' end as reason,
  case when problem is null then directory end as evidence
  from status_docs left join evidence using (job_id) where is_job) where finding is not null)"""
XML_FINDINGS = with_tables(
    DOCUMENTS,
    DUMPS,
    XML_SQL,
    body=f"select * replace ({iso('evidence_ts')} as evidence_ts) from xml_findings",
)


def access_log_parse(spark, sf):
    parsed = access_log.parse_access_log(tables.access_lines(spark, sf))
    return parsed.withColumn("ts", times.iso_text("ts"))


ACCESS_LOG = with_tables(
    ACCESS, body=f"select client, {iso('ts')} as ts, method, target, status from access"
)


def _polls(spark, sf):
    parsed = access_log.parse_access_log(tables.access_lines(spark, sf))
    return findings.missing_status_polls(
        parsed, "/outputs/alpha", POLL_NOW, POLL_THRESHOLDS
    )


def _iso_polls(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {name: times.iso_text(name) for name in ("first_seen", "last_seen")}
    )


def missing_status_polls(spark, sf):
    return _iso_polls(_polls(spark, sf))


POLLS = """polls as (select uuid as job_id, count(*) as polls, min(ts) as first_seen, max(ts) as last_seen from access
where method in ('GET','HEAD') and status=404 and service_path='alpha'
and ts between timestamp '2024-01-20 12:00:00' and timestamp '2024-01-30 12:05:00'
group by uuid having count(*) >= 3 and epoch_us(max(ts)) - epoch_us(min(ts)) >= 300000000000)"""
ISO_POLLS = f"{iso('first_seen')} as first_seen, {iso('last_seen')} as last_seen"
MISSING_POLLS = with_tables(ACCESS, POLLS, body=f"select job_id, polls, {ISO_POLLS} from polls")

EXISTING = "(select concat(lpad(lower(to_hex(s_suppkey)),8,'0'),'-0000-4000-8000-000000000000') from supplier where s_acctbal > 5000)"
OPEN_JOBS = "(select concat(lpad(lower(to_hex(c_custkey)),8,'0'),'-0000-4000-8000-000000000000') from customer where c_custkey%4 in (0,3))"


def missing_status(spark, sf):
    return _iso_polls(
        findings.missing_status(_polls(spark, sf), tables.poll_documents(spark, sf))
    )


MISSING_STATUS = with_tables(
    ACCESS,
    POLLS,
    body=f"select job_id, polls, {ISO_POLLS} from polls where job_id not in {EXISTING}",
)


def _decisions(spark, sf):
    return findings.polling_decisions(
        _polls(spark, sf), tables.poll_jobs(spark, sf), tables.poll_documents(spark, sf)
    )


def missing_status_vetoed(spark, sf):
    return _iso_polls(_decisions(spark, sf))


MISSING_VETOED = with_tables(
    ACCESS,
    POLLS,
    body=f"""select job_id, polls, {ISO_POLLS},
case when job_id in {OPEN_JOBS} then 'skip' when job_id in {EXISTING} then 'status-exists' else 'missing-status' end as decision,
case when job_id in {OPEN_JOBS} then 'database-request-is-nonfinal' end as reason from polls""",
)


def _all_findings(spark, sf, polls=None):
    decisions = findings.polling_decisions(
        _polls(spark, sf) if polls is None else polls,
        tables.poll_jobs(spark, sf),
        tables.poll_documents(spark, sf),
    )
    layers = [
        _xml_findings(spark, sf),
        job_checks.database_findings(spark, sf),
        findings.polling_findings(decisions),
    ]
    found = reduce(DataFrame.unionByName, layers)
    return findings.store_findings(spark, found, scratch_path(spark, "findings"))


FINDINGS = f"""findings as (select * from xml_findings union all by name
select *, cast(null as varchar) as evidence from db_findings union all by name
select 'polling' as layer, job_id, 'running' as status, 'missing-status' as finding, first_seen as evidence_ts, cast(null as varchar) as reason, cast(null as varchar) as evidence
from polls where job_id not in {OPEN_JOBS} and job_id not in {EXISTING})"""
CHECKED_SQL = """checked as (select 'xml' as layer, count(*) as checked from status_docs where is_job
union all select 'database', count(*) from facts where started_at between timestamp '2001-08-01' and timestamp '2001-08-02'
union all select 'polling', count(*) from polls)"""
FINDING_TABLES = (
    DOCUMENTS,
    DUMPS,
    XML_SQL,
    JOBS,
    JOB_FACTS,
    job_checks.DB_FINDINGS,
    ACCESS,
    POLLS,
    FINDINGS,
    CHECKED_SQL,
)


def _checked(spark, sf):
    return findings.checked_counts(
        xml=findings.status_files(tables.status_documents(spark, sf)).agg(F.count(F.lit(1))),
        database=monitor.recent_mix(tables.jobs(spark, sf), NOW, THRESHOLDS).select("total"),
        polling=_polls(spark, sf).agg(F.count(F.lit(1))),
    )


def layer_summary(spark, sf):
    return findings.layer_summary(_all_findings(spark, sf), _checked(spark, sf))


SUMMARY_SELECT = """select layer, any_value(checked) as checked, count(case when finding in ('stalled','slurm-oom','missing-status') then 1 end) as stalled,
count(case when finding='long-running' then 1 end) as long_running, count(case when finding='error' then 1 end) as errors
from checked left join findings using (layer) group by layer"""
LAYER_SUMMARY = with_tables(*FINDING_TABLES, body=SUMMARY_SELECT)
COMPLETED = "concat('completed with ', errors, case when errors=1 then ' error' else ' errors' end)"


def overall_result(spark, sf):
    return findings.overall_result(layer_summary(spark, sf))


OVERALL = with_tables(
    *FINDING_TABLES,
    body=f"""select *, case when errors > 0 then {COMPLETED} when stalled+long_running > 0 then 'attention required' else 'healthy' end as result
from (select sum(stalled) as stalled, sum(long_running) as long_running, sum(errors) as errors from ({SUMMARY_SELECT}))""",
)


def recovery_plan(spark, sf):
    return findings.recovery_plan(_all_findings(spark, sf), THRESHOLDS).withColumn(
        "evidence_ts", times.iso_text("evidence_ts")
    )


PLAN_SQL = """xml_stalled as (select * from findings where layer='xml' and finding in ('stalled','slurm-oom')),
stop as (select min(job_id) as last from xml_stalled where evidence is not null
  and job_id >= (select job_id from xml_stalled order by job_id offset 99 limit 1)),
marked as (select f.*, layer='xml' and (last is null or job_id <= last) as reached from findings f, stop where finding<>'long-running'),
failed as (select distinct job_id from marked where layer='xml' and reached and (finding='error' or evidence is null)),
placed as (select layer, job_id, row_number() over (partition by layer order by evidence_ts, job_id) as place
  from marked where layer<>'xml' and finding in ('stalled','missing-status') and not (layer='database' and job_id in (select job_id from failed))),
acted as (select m.*, case when place <= case m.layer when 'polling' then 20 else 100 end then place end as rank,
  case when m.layer='database' and job_id in (select job_id from failed) then 'blocked' when m.layer='xml' and not reached then 'defer'
    when finding='error' or (m.layer='xml' and evidence is null) then 'error'
    when m.layer='xml' or place <= case m.layer when 'polling' then 20 else 100 end then 'recover' else 'defer' end as action
  from marked m left join placed using (layer, job_id))"""
RECOVERY_PLAN = with_tables(
    *FINDING_TABLES,
    PLAN_SQL,
    body=f"""select case layer when 'xml' then 1 when 'database' then 2 else 3 end as step, layer, job_id, finding, {iso('evidence_ts')} as evidence_ts,
action, rank, coalesce(reason, case when action='error' then 'no job dump' end) as reason, evidence,
case when action<>'recover' then null
when finding='slurm-oom' then 'Process failed: stalled-job recovery detected that Slurm terminated the worker after it exceeded its memory allocation.'
when layer='xml' then 'Process failed: stalled-job recovery found no status update for at least 1e+06 minutes.'
when layer='polling' then 'Process failed: repeated polling found that this status document was not created. The request can no longer be monitored.'
when status='accepted' then 'Process failed: stalled-job recovery found an accepted database request that did not advance for at least 20000 hours.'
else 'Process failed: stalled-job recovery found no database update for at least 1e+06 minutes.' end as message from acted""",
)


def recovery_result(spark, sf):
    """Totals of a recovery run and its closing line."""
    plan = findings.recovery_plan(_all_findings(spark, sf), THRESHOLDS)
    return findings.overall_result(findings.recovery_summary(plan, _checked(spark, sf)))


RECOVERY_RESULT = with_tables(
    *FINDING_TABLES,
    PLAN_SQL,
    body=f"""select *, case when errors > 0 then {COMPLETED} when recovered > 0 then concat('recovered ', recovered, case when recovered=1 then ' job' else ' jobs' end)
else 'no recovery needed' end as result from (
select count(case when action in ('recover','error') and finding in ('stalled','slurm-oom','missing-status') then 1 end) as stalled,
count(case when action='recover' then 1 end) as recovered, count(case when action='error' then 1 end) as errors from acted)""",
)


def incident_archive(spark, sf):
    """Failed documents not archived yet: those of the first three years are."""
    parsed = _parsed(spark, sf)
    earlier = findings.incident_archive(
        parsed.where("modification_time < timestamp'1998-01-01'"), "rook"
    )
    return findings.incident_archive(parsed, "rook", earlier).select(
        "archive_name", "job_id", "kind"
    )


INCIDENT_ARCHIVE = with_tables(
    DOCUMENTS,
    body="""select concat(strftime(creation_time, '%Y%m%dT%H%M%SZ'), '__error__rook__', process, '__', job_id, '.xml') as archive_name,
job_id, 'error' as kind from status_docs where state='ProcessFailed' and is_job and modification_time >= timestamp '1998-01-01'""",
)


def incident_index(spark, sf):
    """Archive paths with readable and foreign names, indexed by job."""
    paths = tables.jobs(spark, sf).select(
        F.concat(
            F.lit("/archive/rook/"),
            F.date_format(times.uuid1_instant("uuid"), "yyyyMMdd'T'HHmmss'Z'"),
            F.when(F.col("status") == 5, "__error__")
            .when(F.col("status") == 4, "__recovered__")
            .otherwise("__open__"),
            text.name_component(F.lit("--rook service.")),
            F.lit("__"),
            text.name_component("identifier"),
            F.lit("__"),
            F.upper("uuid"),
            F.lit(".xml"),
        ).alias("path")
    )
    return incidents.incident_index(paths)


INCIDENT_INDEX = with_tables(
    JOBS,
    body="""select uuid as job_id, case status when 5 then 'error' else 'recovered' end as kind,
concat('/archive/rook/', strftime(started_at, '%Y%m%dT%H%M%SZ'), case status when 5 then '__error__' else '__recovered__' end,
'rook-service__', coalesce(identifier, 'unknown'), '__', upper(uuid), '.xml') as path from jobs where status in (4,5)""",
)


REGISTRY = {
    "xml_requests": (xml_requests, XML_REQUESTS),
    "xml_time_fix": (xml_time_fix, XML_TIME_FIX),
    "job_diagnostics": (job_diagnostics, JOB_DIAGNOSTICS),
    "requests_with_diagnostics": (requests_with_diagnostics, REQUESTS_WITH_DIAGNOSTICS),
    "xml_rejects": (xml_rejects, XML_REJECTS),
    "recovery_result": (recovery_result, RECOVERY_RESULT),
    "oom_marker": (oom_marker, OOM_MARKER),
    "dump_match": (dump_match, DUMP_MATCH),
    "xml_findings": (xml_findings, XML_FINDINGS),
    "access_log_parse": (access_log_parse, ACCESS_LOG),
    "missing_status_polls": (missing_status_polls, MISSING_POLLS),
    "missing_status": (missing_status, MISSING_STATUS),
    "missing_status_vetoed": (missing_status_vetoed, MISSING_VETOED),
    "layer_summary": (layer_summary, LAYER_SUMMARY),
    "overall_result": (overall_result, OVERALL),
    "recovery_plan": (recovery_plan, RECOVERY_PLAN),
    "incident_archive": (incident_archive, INCIDENT_ARCHIVE),
    "incident_index": (incident_index, INCIDENT_INDEX),
}
