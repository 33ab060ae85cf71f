"""The adapters of the test tables in the SQL dialect of the result checks."""

from __future__ import annotations

from opsight import fixed

REQUESTS = """requests as (
select 'request' as record_type, event_id,
  case cast(floor(j/100) as bigint)%3 when 0 then 'rook' when 1 then 'emu' else 'duck' end as service,
  concat('job-',cast(j as string)) as job_id,
  case event_type when 'click' then 'orchestrate' when 'view' then 'subset' when 'purchase' then 'average' when 'signup' then 'regrid' else 'dashboard' end as process,
  case when k<20 then 'failed' when k<96 then 'successful' end as outcome,
  case when k between 90 and 92 then null else round(value*10,3) end as duration_seconds,
  ts as event_time,
  case when k<20 then case k%10
    when 0 then 'slurmstepd: error: Detected 1 oom-kill event(s) in StepId=7.batch.'
    when 1 then 'Job cancelled due to time limit'
    when 2 then 'No timesteps are matching the selection criteria.'
    when 3 then 'Requested latitude not within latitude bounds'
    when 4 then 'Dataset not found'
    when 5 then 'sbatch refused the job'
    when 6 then 'Process error: unknown'
    when 7 then 'ValueError: broken chunk'
    when 8 then 'MemoryError after walltime check' else '' end end as message
from (select e.*, case when event_id%10=9 then event_id-1 else event_id end as j,
      cast(json_extract(props,'$.k') as bigint) as k from events e) e)"""

# First row of each (service, job) in event order.
DEDUPED = """deduped as (
select * from (select r.*, row_number() over (partition by service, job_id order by event_id) as rn
  from requests r) where rn = 1)"""

# Java's patterns are RE2's, but for quotes that SQL doubles.
CATEGORY = "\n".join(
    [
        "case",
        *[
            f"  when regexp_matches(t, '(?i){pattern}') then '{name}'"
            for name, pattern in fixed.FAILURE_CATEGORIES
        ],
        f"  when regexp_matches(trim(t), '(?i){fixed.GENERIC_FAILURE_PATTERN}') then 'unknown'",
        "  when trim(t) = '' then 'unknown' else 'other' end",
    ]
)

WORKFLOWS = """workflows as (
select event_id, concat('job-',cast(event_id as string)) as job_id, 'orchestrate' as process,
  case when k<20 then 'failed' else 'successful' end as outcome,
  case when k<20 then concat('message ', cast(k%4 as string), case when k%4=1 then ' out of memory' when k%4=2 then ' timed out' else '' end) end as message,
  k, user_id,
  case when k%17=0 then '{"inputs": [truncated]' else concat('{"inputs":{"tas":["c3s.ds',cast(user_id%12 as string),'"],"derived":["regrid_1/output"]},"steps":{"subset_1":{"run":"subset","in":{',
    case when k%7=0 then '' else '"collection":"inputs/tas",' end,
    case when k%3=0 then concat('"time_components":"month:jan|year:',cast(1950+user_id%40 as string),',',cast(1951+user_id%40 as string),',',cast(1954+user_id%40 as string),'"')
         when k%3=1 then concat('"time":"',cast(1950+user_id%40 as string),'/',cast(1950+user_id%40+k%6 as string),'"')
         else concat('"time":"',cast(1950+user_id%40 as string),'"') end,'}}}}') end as payload
from (select e.*, cast(json_extract(props,'$.k') as bigint) as k from events e where event_type='click') e)"""

OPERATIONS = """operations as (
select event_id, concat('layer=database job=job-',cast(event_id%200 as string),' status=started ',
    case k%4 when 0 then 'finding=long-running elapsed_minutes=12' when 1 then 'action=recovered' when 2 then 'decision=error reason=disk' else 'finding=stalled' end) as message,
  case k%4 when 1 then 'info' when 2 then 'critical' else 'warning' end as level,
  case user_id%3 when 0 then 'rook' when 1 then 'emu' else 'duck' end as service, ts as recorded_at,
  concat('job-',cast(event_id%200 as string)) as job_id,
  case k%4 when 0 then 'job-long-running' when 1 then 'job-recovered' when 2 then 'operation-error' else 'stalled' end as event
from (select e.*, cast(json_extract(props,'$.k') as bigint) as k from events e where event_type='error') e)"""

JOBS = """jobs as (
select concat(substr(h,8,8),'-',substr(h,4,4),'-1',substr(h,1,3),'-8000-',lpad(lower(to_hex(o_orderkey)),12,'0')) as uuid, 'execute' as operation,
  case o_orderpriority when '1-URGENT' then 'orchestrate' when '2-HIGH' then 'subset' when '3-MEDIUM' then 'average' when '4-NOT SPECIFIED' then 'regrid' end as identifier,
  utc_start + to_seconds(cast((o_orderkey%4-1)*3600 as int)) as time_start,
  case when status in (1,2,3) then null else utc_start + to_seconds(cast((o_orderkey%4-1)*3600 + floor(o_totalprice/50) - 30 as int)) end as time_end,
  status, case when status=5 then concat('Dataset ',cast(o_orderkey%7 as string),' unavailable') end as message,
  utc_start as started_at,
  case when status in (1,2,3) then null else utc_start + to_seconds(cast(floor(o_totalprice/50) - 30 as int)) end as ended_at,
  cast((o_orderkey%4-1)*60 as int) as offset_minutes, o_orderkey
from (select a.*, lpad(lower(to_hex(epoch_us(utc_start)*10+122192928000000000)),15,'0') as h
  from (select o.*, o_orderdate + to_seconds(cast(o_orderkey*37%86400 as int)) as utc_start,
    case when o_orderkey%97=0 then 9 when o_orderstatus='O' then cast(1+o_orderkey%3 as int) when o_orderstatus='F' then 4 else 5 end as status from orders o) a) b)"""

# Names, durations and the fixed report time of the jobs.
JOB_FACTS = """facts as (
select j.*, coalesce(identifier, '(unknown)') as process,
  case status when 1 then 'accepted' when 2 then 'running' when 3 then 'running' when 4 then 'successful' when 5 then 'failed' else 'unmapped' end as state,
  case when ended_at >= started_at then (epoch_us(ended_at)-epoch_us(started_at))/1e6 end as seconds,
  (select max(o_orderdate) from orders) as now
from jobs j)"""

METRICS = """metrics as (
select concat('host',cast(user_id%5 as string)) as host,
  case event_type when 'click' then 'load' when 'view' then 'memory' when 'purchase' then 'interface-eth0' when 'signup' then 'df-root' else 'swap' end as plugin,
  case event_type when 'click' then 'load' when 'view' then 'memory-used' when 'purchase' then 'if_octets' when 'signup' then 'percent_bytes-used' else 'swap-used' end as metric,
  case event_type when 'click' then ['shortterm','midterm','longterm'][event_id%3+1] when 'purchase' then case when event_id%4=0 then 'tx' else 'rx' end else 'value' end as "column",
  ts, case when event_type='purchase' then round(value*1000,0) else value end as value,
  cast(round(value*1000,0) as bigint) as counter from events)"""

ACCESS = """access as (
select concat('192.0.2.',cast(user_id%250 as string)) as client, date_trunc('second', ts) as ts,
  case when k%10=0 then 'POST' when k%10=1 then 'HEAD' else 'GET' end as method,
  concat('/outputs/',case when k%5=4 then 'other' else 'alpha' end,'/',lpad(lower(to_hex(user_id)),8,'0'),'-0000-4000-8000-000000000000.xml?poll=1') as target,
  case when k%3=0 then 200 else 404 end as status,
  case when k%5=4 then 'other' else 'alpha' end as service_path,
  concat(lpad(lower(to_hex(user_id)),8,'0'),'-0000-4000-8000-000000000000') as uuid
from (select e.*, cast(json_extract(props,'$.k') as bigint) as k from events e) e)"""

V4_ID = "concat(lpad(lower(to_hex(cast({key} as bigint)*2654435761%4294967296)),8,'0'),'-0000-4000-8000-000000000000')"
DOCUMENTS = f"""raw_docs as (
select case when o_orderkey%50=0 then concat('job-',cast(o_orderkey as string))
    when o_orderkey%4=1 then concat(substr(h,8,8),'-',substr(h,4,4),'-1',substr(h,1,3),'-8000-',lpad(lower(to_hex(o_orderkey)),12,'0'))
    else {V4_ID.format(key="o_orderkey")} end as job_id, o_orderkey%50<>0 as is_job,
  o_orderdate + to_seconds(cast(floor(o_totalprice/100) as int)) as modification_time, date_trunc('day', o_orderdate) as midnight,
  case when o_orderkey%50<>0 and o_orderkey%4=1 then utc_start end as uuid_time, concat('p', cast(o_orderkey%5 as string)) as process,
  case when o_orderstatus='F' then 'ProcessSucceeded' when o_orderstatus='P' then 'ProcessFailed' else 'ProcessStarted' end as given,
  o_orderkey, o_custkey, o_orderkey%40 as kind
from (select o.*, lpad(lower(to_hex(epoch_us(utc_start)*10+122192928000000000)),15,'0') as h
  from (select orders.*, o_orderdate + to_seconds(cast(o_orderkey*37%86400 as int)) as utc_start from orders) o)),
status_docs as (
select *, case when kind in (13,14) then null else midnight end as creation_time,
  case kind when 7 then 'invalid XML' when 9 then 'missing Status' when 11 then 'not exactly one state'
    when 13 then 'invalid Status creationTime' when 14 then 'invalid Status creationTime' end as problem,
  case when kind in (7,9,11,13,14) then null else given end as state,
  case when kind=7 then 'invalid XML' when kind=9 then 'missing Status'
    when kind in (13,14) and given<>'ProcessStarted' and uuid_time is null then 'invalid Status creationTime' end as reject,
  case when kind in (7,9) then null when kind=11 then 'ProcessSucceeded' when kind in (13,14) and uuid_time is null then null
    when given<>'ProcessStarted' then given end as final_state
from raw_docs)"""

# The dumps of all order lines, and those of a third of them.
ALL_DUMPS = f"""dumps as (
select concat('/work/process_',cast(l_orderkey as string),'_',cast(l_linenumber as string),'_',cast(l_partkey as string)) as directory,
  {V4_ID.format(key="l_orderkey")} as job_id, l_suppkey%9<>0 as parsed, l_suppkey%9>3 as valid, l_suppkey%2=0 as lineage,
  concat('warning line ',cast(l_linenumber as string),' ', case when l_partkey%4=0 then 'slurmstepd: error: Detected 1 oom-kill event(s) in StepId=7.batch.' when l_partkey%4=1 then 'ValueError: broken chunk' else 'slurmstepd: error: Detected 0 oom-kill event(s)' end) as error_text,
  l_partkey%4=0 as oom
from lineitem)"""
DUMPS = ALL_DUMPS.removesuffix(")") + " where l_partkey%3=0)"

# What the valid dumps of a job say; one is needed, not several.
EVIDENCE = """evidence as (select job_id, count(*) as n, case when count(*)=1 then min(directory) end as directory,
  count(*)=1 and bool_or(oom) as oom from dumps where valid group by job_id)"""

QUEUE = """queue as (
select o_orderdate as snapshot_ts, cast(o_orderkey as string) as job_id,
  case when o_orderkey%3=0 then 'PENDING' else 'RUNNING' end as state,
  case when o_orderkey%3=0 then '0:00' when o_orderkey%11=0 then concat('1-0',cast(o_orderkey%10 as string),':05:30') else concat(lpad(cast(o_orderkey%60 as string),2,'0'),':30') end as elapsed,
  case o_orderkey%5 when 0 then 'N/A' when 1 then '512' when 2 then '1.5G' when 3 then '2Gn' else '1024K' end as memory_limit,
  case when o_orderkey%3=0 then null when o_orderkey%11=0 then 86400+(o_orderkey%10)*3600+330 else (o_orderkey%60)*60+30 end as elapsed_seconds,
  o_orderkey
from orders)"""

CAPACITY = """capacity as (
select o_orderdate as snapshot_ts, concat('node',cast(o_custkey as string)) as node, case when o_orderkey%53=0 then 'down' else 'up' end as partition_state,
  case o_orderkey%12 when 0 then 'idle' when 1 then 'allocated+' when 2 then 'down*' when 3 then 'drained' when 4 then 'allocated*+' else 'MIXED' end as node_state,
  case when o_orderkey%53=0 or o_orderkey%12 in (2,3,4) then 0 else 1 end as usable
from orders where o_orderstatus='F' and o_orderkey%41<>0)"""

MEMORY = """captured as (
select concat('host',cast(c_custkey as string)) as host, case when c_custkey%17<>0 then 1000+c_custkey%100*10 end as total,
  case when c_custkey%19<>0 then 100+c_custkey%90 end as available, c_custkey%50 as swap_total,
  case when c_custkey%23<>0 then c_custkey%60 end as swap_free from customer)"""

FILESYSTEMS = """mounts as (
select concat('host',cast(c_custkey%5 as string)) as host, c_custkey as position, concat('/mnt/',cast(c_custkey as string)) as path, c_nationkey as device,
  case when c_custkey%13=0 then null when c_custkey%11=0 then 0 else 5000+c_nationkey end as total,
  case when c_custkey%13=0 then null else c_custkey%5000 end as used from customer)"""


def with_tables(*tables: str, body: str) -> str:
    return "with " + ",\n".join(tables) + "\n" + body


def category(text: str) -> str:
    return CATEGORY.replace("(t,", f"({text},").replace("trim(t)", f"trim({text})")


def iso(column: str) -> str:
    """UTC instant as the ISO text the queries return."""
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f')"
