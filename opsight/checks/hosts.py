"""Queries over host metrics and queue snapshots, with their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from opsight.checks.sql_tables import (
    CAPACITY,
    FILESYSTEMS,
    MEMORY,
    METRICS,
    QUEUE,
    iso,
    with_tables,
)
from opsight.functions import times, units
from opsight.operators import metrics as hosts
from opsight.operators import queue
from opsight.params import TimeRange
from opsight.session import scratch_path
from opsight.sources import driver_tables as tables
from opsight.sources import keyed
from opsight.sources import metrics as metric_source
from opsight.sources import queue as queue_source

NOW = datetime(2024, 1, 30, 18, 0, 0, tzinfo=timezone.utc)
WINDOW = timedelta(hours=36)
INTERVAL = 1800.0
LONG_RUNNING = 14400
PENDING_CRITICAL = 5
# An uneven scale: scaled two-digit values never fall on a rounding tie.
SCALE = 1 / 1.073741824


def metric_scan(spark, sf):
    """Samples stored by plugin and date, then read for a range of days."""
    path = scratch_path(spark, "metrics")
    metric_source.write_metrics(tables.metrics(spark, sf), path)
    period = TimeRange(NOW - timedelta(days=10), NOW - timedelta(days=3))
    chosen = hosts.select_metrics(spark.read.parquet(path), period, ["load", "swap"])
    return chosen.select("host", "plugin", "metric", "column", "value", times.iso_text("ts").alias("ts"))


METRIC_SCAN = with_tables(
    METRICS,
    body=f"""select host, plugin, metric, "column", value, {iso('ts')} as ts from metrics where plugin in ('load','swap')
and ts between timestamp '2024-01-20 18:00:00' and timestamp '2024-01-27 18:00:00'""",
)


def _period_query(period):
    def run(spark, sf):
        summary = hosts.period_summary(
            tables.metrics(spark, sf), period, memory_scale=SCALE, counter_scale=SCALE
        )
        return summary.withColumn("period", times.iso_text("period"))

    return run


SERIES = 'host, plugin, metric, "column"'


def _counter_sql(period: str, table: str = "metrics", name: str = "grown") -> str:
    return f"""{name} as (select {SERIES}, period, sum(case when previous is null then 0 when reading < previous then reading else reading - previous end) as total
from (select *, lag(reading) over (partition by {SERIES}, date_trunc('{period}', ts) order by ts, reading) as previous,
  date_trunc('{period}', ts) as period from (select *, cast(trunc(value) as bigint) as reading from {table})) group by all)"""


def _of(plugin: str, column: str) -> str:
    return f"""case when plugin='{plugin}' and "column"='{column}' then value end"""


def _summary_sql(period: str, table: str = "metrics", grown: str = "grown", scale: str = "1.073741824") -> str:
    return f"""select s.*, round(g.total/{scale},2) as received from (
select host, date_trunc('{period}', ts) as period,
 round(min({_of('load', 'shortterm')}),2) as load_min, round(max({_of('load', 'shortterm')}),2) as load_max,
 round(min({_of('df-root', 'value')}),2) as disk_min, round(max({_of('df-root', 'value')}),2) as disk_max,
 round(min({_of('memory', 'value')})/{scale},2) as memory_min, round(max({_of('memory', 'value')})/{scale},2) as memory_max
from {table} where plugin<>'swap' group by 1, 2) s left join {grown} g on g.host=s.host and g.period=s.period and g.plugin='interface-eth0' and g."column"='rx'"""


def _period_sql(period: str) -> str:
    return with_tables(
        METRICS,
        _counter_sql(period),
        body=f"select * replace ({iso('period')} as period) from ({_summary_sql(period)})",
    )


def counter_total(spark, sf):
    totals = hosts.counter_total(tables.metrics(spark, sf), "day")
    return totals.withColumn("period", times.iso_text("period"))


COUNTER_TOTAL = with_tables(
    METRICS,
    _counter_sql("day"),
    body=f"select {SERIES}, {iso('period')} as period, total from grown",
)


def metric_summary_replace(spark, sf):
    """A second run replaces the days it covers and leaves the stored ones before."""
    path = scratch_path(spark, "summary")
    samples = tables.metrics(spark, sf)
    shifted = samples.withColumn("value", F.col("value") + 1)
    for run in (shifted, samples.where("ts >= timestamp'2024-01-15'")):
        hosts.store_summary(hosts.period_summary(run, memory_scale=SCALE, counter_scale=SCALE), path)
    stored = hosts.summary_lines(keyed.read_keyed(spark, path))
    return stored.select("host", "label", "load_min", "memory_max", "received", "line")


def _text(column: str, unit: str = "") -> str:
    return f"coalesce(regexp_replace(printf('%.2f', {column}), '0$', '') || '{unit}', 'NA')"


LINE = " || ".join(
    [
        f"""'{gap}{shown}=' || {_text(name, unit)}"""
        for gap, shown, name, unit in (
            ("  ", "load_min", "load_min", ""),
            ("  ", "load_max", "load_max", ""),
            ("  ", "disk_min", "disk_min", ""),
            ("  ", "disk_max", "disk_max", ""),
            ("  ", "mem_min", "memory_min", " GiB"),
            ("  ", "mem_max", "memory_max", " GiB"),
            ("  ", "eth0_rx", "received", " GiB"),
        )
    ]
)
SUMMARY_REPLACE = with_tables(
    METRICS,
    "shifted as (select * replace (value + 1 as value) from metrics)",
    _counter_sql("day"),
    _counter_sql("day", "shifted", "shifted_grown"),
    f"""summary as (select * from ({_summary_sql('day')}) where period >= timestamp '2024-01-15'
union all select * from ({_summary_sql('day', 'shifted', 'shifted_grown')}) where period < timestamp '2024-01-15')""",
    body=f"""select host, label, load_min, memory_max, received, label || {LINE} as line from (select *, strftime(period, '%Y-%m-%d') as label from summary)""",
)

FILE_COLUMNS = {kind.metric: kind.columns for kind in metric_source.KINDS}


def _write_file(root: str):
    """Write the samples of one host, plugin, metric and day as the file they come in."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        host, plugin, metric, day = key
        columns = FILE_COLUMNS[metric]
        wide = pd.DataFrame({"epoch": rows["epoch"], **{c: rows["value"].where(rows["column"] == c) for c in columns}})
        store, folder = arrow_fs.FileSystem.from_uri(f"{root}/{host}/{plugin}")
        store.create_dir(folder, recursive=True)
        name = f"{metric}-{day}"
        text = wide.sort_values("epoch").to_csv(index=False, float_format="%.6f")
        packed = day.day % 2 == 0
        with store.open_output_stream(f"{folder}/.{name}", compression="gzip" if packed else None) as out:
            out.write(text.encode())
        store.move(f"{folder}/.{name}", f"{folder}/{name}.gz" if packed else f"{folder}/{name}")
        return pd.DataFrame({"path": [name]})

    return write


def _from_files(spark, sf):
    """The samples, written as daily CSV files and read back."""
    root = scratch_path(spark, "metric-files")
    samples = tables.metrics(spark, sf).where(F.col("metric").isin(*FILE_COLUMNS))
    epoch = (F.unix_micros("ts") / 1e6).alias("epoch")
    groups = samples.select("host", "plugin", "metric", "date", "column", "value", epoch)
    written = groups.groupBy("host", "plugin", "metric", "date").applyInPandas(_write_file(root), "path string")
    written.write.parquet(scratch_path(spark, "metric-file-list"))
    return metric_source.read_metrics(spark, root)


def metric_files_daily(spark, sf):
    summary = hosts.period_summary(_from_files(spark, sf), memory_scale=SCALE, counter_scale=SCALE)
    return summary.withColumn("period", times.iso_text("period"))


def metric_files_snapshot(spark, sf):
    return _snapshot(spark, sf, _from_files(spark, sf))


WINDOW_SQL = f"""win as (select {SERIES}, count(value) as count, arg_max(value, (ts, value)) as current,
  arg_max(value, (ts, value)) - arg_min(value, (ts, value)) as change, min(value) as min, avg(value) as average, max(value) as max
  from metrics where ts between timestamp '2024-01-29 06:00:00' and timestamp '2024-01-30 18:00:00' group by all)"""
LATEST_SQL = f"""latest as (select {SERIES}, max(ts) as ts, arg_max(value, (ts, value)) as value
  from metrics where ts >= timestamp '2024-01-29' and ts < timestamp '2024-01-31' group by all)"""
FRESH_SQL = """fresh as (select host, min(ts) as latest, greatest(0.0, (epoch_us(timestamp '2024-01-30 18:00:00') - epoch_us(min(ts)))/1e6) as age_seconds
  from latest where "column"='shortterm' or plugin='memory' group by host)"""
MEMORY_SQL = """memory as (select c.host, total, coalesce(l.value, total - available) as used, available, swap_total,
  case when swap_free is not null then greatest(0, swap_total - swap_free) end as swap_used
  from captured c left join latest l on l.host=c.host and l.plugin='memory')"""
DISKS_SQL = """disks as (select host, path, device, total, used, case when total is null then null when total > 0 then used*100.0/total else 0.0 end as percent,
  case when total is null then 'unavailable' end as error from (select *, row_number() over (partition by host, case when total is null then path end, case when total is not null then device end order by position, path) as rn from mounts) where rn=1)"""


def metric_window(spark, sf):
    summary = hosts.metric_window(tables.metrics(spark, sf), NOW - WINDOW, NOW)
    return summary.withColumns(
        {name: F.round(name, 4) for name in ("change", "average")}
    )


METRIC_WINDOW = with_tables(
    METRICS,
    WINDOW_SQL,
    body="select * replace (round(change,4) as change, round(average,4) as average) from win",
)


def metric_latest(spark, sf):
    latest = hosts.metric_latest(tables.metrics(spark, sf), NOW)
    return latest.withColumn("ts", times.iso_text("ts"))


METRIC_LATEST = with_tables(
    METRICS, LATEST_SQL, body=f"select * replace ({iso('ts')} as ts) from latest"
)


def metric_freshness(spark, sf):
    latest = hosts.metric_latest(tables.metrics(spark, sf), NOW)
    return hosts.metric_freshness(latest, NOW, INTERVAL).withColumn(
        "latest", times.iso_text("latest")
    )


METRIC_FRESHNESS = with_tables(
    METRICS,
    LATEST_SQL,
    FRESH_SQL,
    body=f"select host, {iso('latest')} as latest, age_seconds, age_seconds <= 4500 as fresh from fresh",
)


def _rounded(rows, *names):
    return rows.withColumns({name: F.round(name, 6) for name in names})


def memory_usage(spark, sf):
    latest = hosts.metric_latest(tables.metrics(spark, sf), NOW)
    usage = hosts.memory_usage(tables.memory_captures(spark, sf), latest)
    return _rounded(usage, "percent", "swap_percent")


MEMORY_USAGE = with_tables(
    METRICS,
    LATEST_SQL,
    MEMORY,
    MEMORY_SQL,
    body="""select host, total, used, available, round(used*100.0/nullif(total,0),6) as percent, swap_total, swap_used,
round(swap_used*100.0/nullif(swap_total,0),6) as swap_percent from memory""",
)


def filesystem_usage(spark, sf):
    return _rounded(
        hosts.filesystem_usage(tables.filesystem_captures(spark, sf)), "percent"
    )


FILESYSTEM_USAGE = with_tables(
    FILESYSTEMS,
    DISKS_SQL,
    body="select * replace (round(percent,6) as percent) from disks",
)


def _snapshot(spark, sf, samples):
    snapshot = hosts.host_snapshot(
        samples,
        tables.memory_captures(spark, sf),
        tables.filesystem_captures(spark, sf),
        NOW,
        WINDOW,
        INTERVAL,
    )
    return _rounded(
        snapshot.withColumn("latest", times.iso_text("latest")),
        *[name for name, kind in snapshot.dtypes if kind == "double"],
    )


def host_snapshot(spark, sf):
    return _snapshot(spark, sf, tables.metrics(spark, sf))


def _history(table: str, name: str) -> str:
    return ", ".join(
        [f"coalesce({table}.count, case when seen.host is not null then 0 end) as {name}_count"]
        + [
            f"round({table}.{measure}, 6) as {name}_{measure}"
            for measure in ("current", "change", "min", "average", "max")
        ]
    )


HOST_SNAPSHOT = with_tables(
    METRICS,
    LATEST_SQL,
    WINDOW_SQL,
    FRESH_SQL,
    MEMORY,
    MEMORY_SQL,
    FILESYSTEMS,
    DISKS_SQL,
    """seen as (select distinct host from metrics where plugin in ('load','memory','df-root')
  and ts >= timestamp '2024-01-29' and ts < timestamp '2024-01-31')""",
    body=f"""select m.host, m.total, round(m.used,6) as used, m.available, round(m.used*100.0/nullif(m.total,0),6) as percent, swap_total, swap_used,
round(swap_used*100.0/nullif(swap_total,0),6) as swap_percent, {iso('f.latest')} as latest, round(age_seconds,6) as age_seconds,
coalesce(age_seconds <= 4500, false) as fresh, round(l1.value,6) as load, round(l2.value,6) as load_mid, round(l3.value,6) as load_long,
{_history('wl', 'load')}, {_history('wm', 'memory')}, {_history('wd', 'disk')}, d.filesystems, round(d.fullest,6) as fullest_percent
from memory m left join fresh f using (host) left join seen on seen.host=m.host
left join latest l1 on l1.host=m.host and l1."column"='shortterm' left join latest l2 on l2.host=m.host and l2."column"='midterm'
left join latest l3 on l3.host=m.host and l3."column"='longterm'
left join win wl on wl.host=m.host and wl."column"='shortterm' left join win wm on wm.host=m.host and wm.plugin='memory'
left join win wd on wd.host=m.host and wd.plugin='df-root'
left join (select host, count(*) as filesystems, max(percent) as fullest from disks group by host) d on d.host=m.host""",
)


def _queue(spark, sf):
    return queue_source.queue_jobs(tables.queue_lines(spark, sf))


def queue_scan(spark, sf):
    """Good and malformed queue lines per state, with their problem."""
    lines = tables.queue_lines(spark, sf)
    broken = lines.withColumn(
        "value",
        F.expr(
            "case when cast(job_id as bigint)%31=1 then concat(value, '|x')"
            " when cast(job_id as bigint)%31=2 then concat_ws('|', job_id, 'DONE', elapsed)"
            " when cast(job_id as bigint)%31=3 then concat_ws('|', job_id, 'RUNNING', '1:99')"
            " else value end"
        ),
    )
    return queue_source.queue_jobs(broken).groupBy("problem").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("elapsed_seconds").alias("seconds")
    )


QUEUE_SCAN = with_tables(
    QUEUE,
    body="""select case o_orderkey%31 when 1 then 'invalid line' when 2 then 'unexpected state' when 3 then 'invalid elapsed time' end as problem,
count(*) as lines, sum(case when o_orderkey%31 in (2,3) then null else elapsed_seconds end) as seconds from queue group by 1""",
)


def queue_details(spark, sf):
    """The six-field snapshot; some rows lack a field."""
    lines = tables.queue_lines(spark, sf).withColumn(
        "value",
        F.expr(
            "concat_ws('|', job_id, concat('p', cast(job_id as bigint)%3), if(state='RUNNING', 'R', 'PD'), elapsed,"
            " case when cast(job_id as bigint)%37=1 then null else ' 1-00:00:00 ' end, memory_limit)"
        ),
    )
    return queue_source.queue_details(lines).select(
        "job_id", "partition", "state", "time_limit_seconds", "memory_limit_bytes", "problem"
    )


BYTES = "case memory_limit when '512' then 536870912 when '1.5G' then 1610612736 when '2Gn' then 2147483648 when '1024K' then 1048576 end"
QUEUE_DETAILS = with_tables(
    QUEUE,
    body=f"""select job_id, concat('p', o_orderkey%3) as partition, case when state='RUNNING' then 'R' else 'PD' end as state,
case when o_orderkey%37=1 then null else 86400 end as time_limit_seconds, case when o_orderkey%37=1 then null else {BYTES} end as memory_limit_bytes,
case when o_orderkey%37=1 then 'invalid line' end as problem from queue""",
)


def queue_elapsed(spark, sf):
    return tables.queue_lines(spark, sf).select(
        "job_id", "elapsed", units.elapsed_seconds("elapsed").alias("seconds")
    )


QUEUE_ELAPSED = with_tables(
    QUEUE, body="select job_id, elapsed, coalesce(elapsed_seconds, 0) as seconds from queue"
)


def queue_memory(spark, sf):
    return tables.queue_lines(spark, sf).select(
        "job_id", "memory_limit", units.memory_bytes("memory_limit").alias("bytes")
    )


QUEUE_MEMORY = with_tables(
    QUEUE, body=f"select job_id, memory_limit, {BYTES} as bytes from queue"
)


def queue_memory_usage(spark, sf):
    jobs = tables.queue_lines(spark, sf)
    usage = queue_source.step_usage(tables.usage_lines(spark, sf))
    return queue.queue_memory_usage(jobs, usage).select(
        "job_id", "used_bytes", "limit_bytes", "used_percent"
    )


QUEUE_USAGE = with_tables(
    QUEUE,
    body=f"""select job_id, used_bytes, limit_bytes, round(used_bytes*100.0/limit_bytes, 0) as used_percent from (
select job_id, case when o_orderkey%8<>0 and o_orderkey%6<>0 then (1000+o_orderkey%5000)*1024 end as used_bytes, {BYTES} as limit_bytes from queue)""",
)


def _pressure(spark, sf):
    return queue.queue_pressure(_queue(spark, sf), LONG_RUNNING, PENDING_CRITICAL)


def _issues(spark, sf):
    nodes = queue_source.capacity(tables.capacity_lines(spark, sf))
    return queue.capacity_issues(nodes, tables.queue_lines(spark, sf))


def queue_pressure(spark, sf):
    return _pressure(spark, sf).withColumn("snapshot_ts", times.iso_text("snapshot_ts"))


PRESSURE_SQL = """pressure as (select snapshot_ts, count(case when state='RUNNING' then 1 end) as running,
  count(case when state='PENDING' then 1 end) as pending, count(case when elapsed_seconds >= 14400 then 1 end) as long_running,
  count(*) as total, count(case when state='PENDING' then 1 end) >= 5 as is_critical from queue group by snapshot_ts)"""
ISSUES_SQL = """issues as (select snapshot_ts, node, concat('node=', node, ' partition_state=', partition_state, ' node_state=', node_state, ' reason=none') as issue
  from capacity where usable=0
  union all select distinct snapshot_ts, cast(null as varchar), 'reason=no-capacity-records' from queue where snapshot_ts not in (select snapshot_ts from capacity))"""
QUEUE_PRESSURE = with_tables(
    QUEUE,
    PRESSURE_SQL,
    body=f"select * replace ({iso('snapshot_ts')} as snapshot_ts) from pressure",
)


def capacity_issues(spark, sf):
    return _issues(spark, sf).withColumn("snapshot_ts", times.iso_text("snapshot_ts"))


CAPACITY_ISSUES = with_tables(
    QUEUE,
    CAPACITY,
    ISSUES_SQL,
    body=f"select * replace ({iso('snapshot_ts')} as snapshot_ts) from issues",
)


def queue_alert(spark, sf):
    alerts = queue.queue_alert(
        _pressure(spark, sf), _issues(spark, sf), PENDING_CRITICAL
    )
    return alerts.withColumn("snapshot_ts", times.iso_text("snapshot_ts"))


ALERT_SELECT = f"""select {iso('p.snapshot_ts')} as snapshot_ts,
case when i.n > 0 or p.is_critical then 'red' else 'clear' end as status,
case when i.n > 0 then 'slurm-capacity-unavailable' when p.is_critical then 'pending-queue-full' end as reason,
case when i.n is null and p.is_critical then p.pending end as pending, case when i.n is null and p.is_critical then 5 end as threshold,
coalesce(i.n, 0) as issues, i.detail from pressure p left join (select snapshot_ts, count(*) as n, string_agg(issue, '; ' order by node nulls first, issue) as detail from issues group by snapshot_ts) i
on i.snapshot_ts = p.snapshot_ts"""
QUEUE_ALERT = with_tables(QUEUE, CAPACITY, PRESSURE_SQL, ISSUES_SQL, body=ALERT_SELECT)

REGISTRY = {
    "metric_scan": (metric_scan, METRIC_SCAN),
    "metric_daily": (_period_query("day"), _period_sql("day")),
    "metric_hourly": (_period_query("hour"), _period_sql("hour")),
    "counter_total": (counter_total, COUNTER_TOTAL),
    "metric_summary_replace": (metric_summary_replace, SUMMARY_REPLACE),
    "metric_files_daily": (metric_files_daily, _period_sql("day")),
    "metric_files_snapshot": (metric_files_snapshot, HOST_SNAPSHOT),
    "metric_window": (metric_window, METRIC_WINDOW),
    "metric_latest": (metric_latest, METRIC_LATEST),
    "metric_freshness": (metric_freshness, METRIC_FRESHNESS),
    "memory_usage": (memory_usage, MEMORY_USAGE),
    "filesystem_usage": (filesystem_usage, FILESYSTEM_USAGE),
    "host_snapshot": (host_snapshot, HOST_SNAPSHOT),
    "queue_scan": (queue_scan, QUEUE_SCAN),
    "queue_details": (queue_details, QUEUE_DETAILS),
    "queue_elapsed": (queue_elapsed, QUEUE_ELAPSED),
    "queue_memory": (queue_memory, QUEUE_MEMORY),
    "queue_memory_usage": (queue_memory_usage, QUEUE_USAGE),
    "queue_pressure": (queue_pressure, QUEUE_PRESSURE),
    "capacity_issues": (capacity_issues, CAPACITY_ISSUES),
    "queue_alert": (queue_alert, QUEUE_ALERT),
}
