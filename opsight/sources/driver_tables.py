"""Logical tables derived from the test tables, whole and without sampling.

Each function reads one Parquet table and reshapes every row of it. Writer clocks,
text notations and failure texts are spread over the rows by key arithmetic, so all
branches of the transforms occur at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.functions.derive import computed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def shape_requests(events: DataFrame) -> DataFrame:
    """Requests from the event table; one row in ten repeats the previous key."""
    keyed = with_k(events).withColumn(
        "j", F.expr("case when event_id%10=9 then event_id-1 else event_id end")
    )
    return keyed.selectExpr(
        "'request' as record_type",
        "event_id",
        "case cast(floor(j/100) as bigint)%3 when 0 then 'rook' when 1 then 'emu'"
        " else 'duck' end as service",
        "concat('job-',cast(j as string)) as job_id",
        "case event_type when 'click' then 'orchestrate' when 'view' then 'subset'"
        " when 'purchase' then 'average' when 'signup' then 'regrid'"
        " else 'dashboard' end as process",
        "case when k<20 then 'failed' when k<96 then 'successful' end as outcome",
        "case when k between 90 and 92 then null else round(value*10,3) end"
        " as duration_seconds",
        "cast(ts as timestamp) as event_time",
        """case when k<20 then case k%10
            when 0 then 'slurmstepd: error: Detected 1 oom-kill event(s) in StepId=7.batch.'
            when 1 then 'Job cancelled due to time limit'
            when 2 then 'No timesteps are matching the selection criteria.'
            when 3 then 'Requested latitude not within latitude bounds'
            when 4 then 'Dataset not found'
            when 5 then 'sbatch refused the job'
            when 6 then 'Process error: unknown'
            when 7 then 'ValueError: broken chunk'
            when 8 then 'MemoryError after walltime check' else '' end end as message""",
    ).selectExpr(
        "*",
        "case when message is not null then array(named_struct('code',"
        " 'NoApplicableCode', 'locator', cast(null as string), 'message', message))"
        " else cast(array() as array<struct<code:string,locator:string,message:string>>)"
        " end as failures",
        "cast(array() as array<struct<source:string,message:string>>) as diagnostics",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_requests(table(spark, sf_dir, "events"))


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests as JSON text, with broken and non-object lines among them."""
    value = F.expr(
        "case when event_id%50=7 then '{\"service\": broken'"
        " when event_id%50=13 then concat('[', event_id, ']')"
        " else to_json(named_struct('record_type', record_type, 'service', service,"
        " 'job_id', job_id, 'process', process, 'outcome', outcome,"
        " 'duration_seconds', duration_seconds, 'finished_at',"
        " date_format(event_time, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"),"
        " 'failures', failures)) end"
    )
    return computed(requests(spark, sf_dir), value=value).select("event_id", "value")


def shape_workflows(events: DataFrame) -> DataFrame:
    """Workflow payloads of the orchestrate requests."""
    return with_k(events.where("event_type = 'click'")).selectExpr(
        "event_id",
        "concat('job-',cast(event_id as string)) as job_id",
        "'orchestrate' as process",
        "case when k<20 then 'failed' else 'successful' end as outcome",
        "case when k<20 then concat('message ', cast(k%4 as string),"
        " case when k%4=1 then ' out of memory' when k%4=2 then ' timed out'"
        " else '' end) end as message",
        """case when k%17=0 then '{"inputs": [truncated]' else
          concat('{"inputs":{"tas":["c3s.ds',cast(user_id%12 as string),'"],"derived":["regrid_1/output"]},"steps":{"subset_1":{"run":"subset","in":{',
          case when k%7=0 then '' else '"collection":"inputs/tas",' end,
          case when k%3=0 then concat('"time_components":"month:jan|year:',cast(1950+user_id%40 as string),',',cast(1951+user_id%40 as string),',',cast(1954+user_id%40 as string),'"')
               when k%3=1 then concat('"time":"',cast(1950+user_id%40 as string),'/',cast(1950+user_id%40+k%6 as string),'"')
               else concat('"time":"',cast(1950+user_id%40 as string),'"') end,'}}}}') end as payload""",
    )


def workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_workflows(table(spark, sf_dir, "events"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation log messages from the error events."""
    errors = with_k(table(spark, sf_dir, "events").where("event_type = 'error'"))
    return errors.selectExpr(
        "event_id",
        """concat('layer=database job=job-',cast(event_id%200 as string),' status=started ',
          case k%4 when 0 then 'finding=long-running elapsed_minutes=12'
            when 1 then 'action=recovered' when 2 then 'decision=error reason=disk'
            else 'finding=stalled' end) as message""",
        "case k%4 when 1 then 'info' when 2 then 'critical' else 'warning' end as level",
        "case user_id%3 when 0 then 'rook' when 1 then 'emu' else 'duck' end as service",
        "cast(ts as timestamp) as recorded_at",
    )


def shape_jobs(orders: DataFrame) -> DataFrame:
    """Job-table rows with version-1 UUID keys and four writer offsets."""
    return (
        orders.selectExpr(
            "*",
            "o_orderdate + make_dt_interval(0,0,0,cast(o_orderkey*37%86400 as int))"
            " as utc_start",
            "case when o_orderkey%97=0 then 9 when o_orderstatus='O'"
            " then cast(1+o_orderkey%3 as int) when o_orderstatus='F' then 4"
            " else 5 end as status",
        )
        .selectExpr(
            "*",
            "lpad(lower(hex(unix_micros(cast(utc_start as timestamp))*10"
            "+122192928000000000)),15,'0') as h",
        )
        .selectExpr(
            "concat(substr(h,8,8),'-',substr(h,4,4),'-1',substr(h,1,3),'-8000-',"
            "lpad(lower(hex(o_orderkey)),12,'0')) as uuid",
            "'execute' as operation",
            "case o_orderpriority when '1-URGENT' then 'orchestrate' when '2-HIGH'"
            " then 'subset' when '3-MEDIUM' then 'average' when '4-NOT SPECIFIED'"
            " then 'regrid' end as identifier",
            "utc_start + make_dt_interval(0,0,0,cast((o_orderkey%4-1)*3600 as int))"
            " as time_start",
            "case when status in (1,2,3) then null else utc_start + make_dt_interval("
            "0,0,0,cast((o_orderkey%4-1)*3600 + floor(o_totalprice/50) - 30 as int))"
            " end as time_end",
            "status",
            "case when status=5 then concat('Dataset ',cast(o_orderkey%7 as string),"
            "' unavailable') end as message",
        )
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_jobs(table(spark, sf_dir, "orders"))


def shape_metrics(events: DataFrame) -> DataFrame:
    """Long-form metric samples of several columns, and a counter that often falls."""
    return events.selectExpr(
        "concat('host',cast(user_id%5 as string)) as host",
        "case event_type when 'click' then 'load' when 'view' then 'memory'"
        " when 'purchase' then 'interface-eth0' when 'signup' then 'df-root'"
        " else 'swap' end as plugin",
        "case event_type when 'click' then 'load' when 'view' then 'memory-used'"
        " when 'purchase' then 'if_octets' when 'signup' then 'percent_bytes-used'"
        " else 'swap-used' end as metric",
        "case event_type when 'click' then element_at(array('shortterm','midterm','longterm'),"
        " cast(event_id%3 as int)+1) when 'purchase' then if(event_id%4=0,'tx','rx')"
        " else 'value' end as column",
        "cast(ts as timestamp) as ts",
        "to_date(ts) as date",
        "case when event_type='purchase' then round(value*1000,0) else value end as value",
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_metrics(table(spark, sf_dir, "events"))


def shape_access_lines(events: DataFrame) -> DataFrame:
    """Combined-format access lines with other methods, statuses and paths."""
    value = F.expr(
        """concat('192.0.2.',cast(user_id%250 as string),' - - [',
          date_format(cast(ts as timestamp),'dd/MMM/yyyy:HH:mm:ss'),' +0000] "',
          case when k%10=0 then 'POST' when k%10=1 then 'HEAD' else 'GET' end,
          ' /outputs/',case when k%5=4 then 'other' else 'alpha' end,'/',
          lpad(lower(hex(user_id)),8,'0'),
          '-0000-4000-8000-000000000000.xml?poll=1 HTTP/1.1" ',
          case when k%3=0 then '200' else '404' end,' 153 "-" "client" "-"')"""
    )
    return computed(with_k(events), value=value).select("value")


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_access_lines(table(spark, sf_dir, "events"))


#: A version-4 job id from an order key; the keys are spread over all names.
V4_ID = (
    "concat(lpad(lower(hex({key}*2654435761%4294967296)),8,'0'),"
    "'-0000-4000-8000-000000000000')"
)
#: The version-1 id that the job table gives an order.
V1_HEX = (
    "lpad(lower(hex(unix_micros(cast(o_orderdate + make_dt_interval(0,0,0,"
    "cast(o_orderkey*37%86400 as int)) as timestamp))*10+122192928000000000)),15,'0')"
)


def shape_status_documents(orders: DataFrame) -> DataFrame:
    """One status document per order, with unusable ones and foreign names among them."""
    inputs = (
        "'<wps:DataInputs><wps:Input><ows:Identifier>site</ows:Identifier><wps:Data>"
        "<wps:LiteralData dataType=\"string\" ows:note=\"a&gt;b\">north <b>',"
        "cast(o_orderkey%3 as string),'</b>\n end</wps:LiteralData></wps:Data></wps:Input>"
        "<wps:Input><ows:Identifier>file</ows:Identifier><wps:Reference"
        " ows:href=\"https://data.test/a%20b/',cast(o_custkey as string),'.nc\"/></wps:Input>"
        "<wps:Input><ows:Identifier>site</ows:Identifier><wps:Data><wps:ComplexData>"
        "{&quot;k&quot;: <![CDATA[<1>]]>}</wps:ComplexData></wps:Data></wps:Input></wps:DataInputs>'"
    )
    return orders.withColumn("h", F.expr(V1_HEX)).selectExpr(
        f"""case when o_orderkey%50=0 then concat('job-',cast(o_orderkey as string))
          when o_orderkey%4=1 then concat(substr(h,8,8),'-',substr(h,4,4),'-1',substr(h,1,3),
            '-8000-',lpad(lower(hex(o_orderkey)),12,'0'))
          else {V4_ID.format(key="o_orderkey")} end as job_id""",
        "cast(o_orderdate + make_dt_interval(0,0,0,cast(floor(o_totalprice/100) as int))"
        " as timestamp) as modification_time",
        f"""concat('<wps:ExecuteResponse xmlns:wps="http://www.opengis.net/wps/1.0.0" xmlns:ows="http://www.opengis.net/ows/1.1"><wps:Process><ows:Identifier>p',cast(o_orderkey%5 as string),
          '</ows:Identifier></wps:Process>',
          case when o_orderkey%40=9 then '' else concat('<wps:Status creationTime="',
            case when o_orderkey%40 in (13,14) then 'soon' else concat(substr(cast(o_orderdate as string),1,10),'T00:00:00Z') end,'">',
            case when o_orderkey%40=11 then '<wps:ProcessStarted>run</wps:ProcessStarted><wps:ProcessSucceeded>ok</wps:ProcessSucceeded>'
              when o_orderstatus='F' then '<wps:ProcessSucceeded>ok</wps:ProcessSucceeded>'
              when o_orderstatus='P' then '<wps:ProcessFailed><wps:ExceptionReport><ows:Exception exceptionCode="NoApplicableCode" locator="dataset"><ows:ExceptionText>Dataset <i>not</i>  found</ows:ExceptionText></ows:Exception></wps:ExceptionReport></wps:ProcessFailed>'
              else '<wps:ProcessStarted>run</wps:ProcessStarted>' end, '</wps:Status>') end,
          case when o_orderkey%8=4 then concat({inputs}) else '' end,
          case when o_orderkey%40=7 then '' else '</wps:ExecuteResponse>' end) as content""",
    )


def status_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_status_documents(table(spark, sf_dir, "orders"))


DUMP_FOLDER = (
    "concat('/work/process_',cast(l_orderkey as string),'_',"
    "cast(l_linenumber as string),'_',cast(l_partkey as string))"
)


def job_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dump files of a third of the order lines, so jobs have none, one or several."""
    return shape_job_dumps(table(spark, sf_dir, "lineitem").where("l_partkey%3=0"))


def all_job_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dump files of all order lines."""
    return shape_job_dumps(table(spark, sf_dir, "lineitem"))


def shape_job_dumps(lines: DataFrame) -> DataFrame:
    """A dump file of each order line.

    Some are no evidence: broken, in another folder than they say, with a list for
    inputs or a request that is no JSON.
    """
    request = (
        "to_json(named_struct('lineage', l_suppkey%2=0, 'inputs',"
        " map('dataset', array('a','b'), 'time', array('c'))))"
    )
    return lines.selectExpr(
        f"{DUMP_FOLDER} as directory",
        f"""case when l_suppkey%9=0 then '{{"process": {{' else
          to_json(named_struct('process', named_struct('uuid', {V4_ID.format(key="l_orderkey")},
            'workdir', case when l_suppkey%9=1 then '/elsewhere' else concat({DUMP_FOLDER}, '/') end),
            'wps_request', case when l_suppkey%9=2 then '{{"inputs": [1]}}'
              when l_suppkey%9=3 then 'no request' else {request} end)) end as dump""",
    )


def error_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error output of each line; part of it carries the memory marker."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{DUMP_FOLDER} as directory",
        "cast(concat('warning   line ',cast(l_linenumber as string), char(10),"
        " case when l_partkey%4=0 then"
        " 'slurmstepd: error: Detected 1 oom-kill event(s) in StepId=7.batch.'"
        " when l_partkey%4=1 then 'ValueError: broken chunk'"
        " else 'slurmstepd: error: Detected 0 oom-kill event(s)' end) as binary)"
        " as error_output",
    )


def shape_queue_lines(orders: DataFrame) -> DataFrame:
    """Queue rows in all elapsed and memory notations, one snapshot per day."""
    return orders.selectExpr(
        "cast(o_orderdate as timestamp) as snapshot_ts",
        "cast(o_orderkey as string) as job_id",
        "case when o_orderkey%3=0 then 'PENDING' else 'RUNNING' end as state",
        "case when o_orderkey%3=0 then '0:00' when o_orderkey%11=0 then"
        " concat('1-0',cast(o_orderkey%10 as string),':05:30') else"
        " concat(lpad(cast(o_orderkey%60 as string),2,'0'),':30') end as elapsed",
        "case o_orderkey%5 when 0 then 'N/A' when 1 then '512' when 2 then '1.5G'"
        " when 3 then '2Gn' else '1024K' end as memory_limit",
    ).selectExpr(
        "*", "concat_ws('|', job_id, state, elapsed) as value"
    )


def queue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_queue_lines(table(spark, sf_dir, "orders"))


def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch-step memory of the running jobs, with other steps among them."""
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderdate as timestamp) as snapshot_ts",
        "concat(cast(o_orderkey as string), case when o_orderkey%8=0 then '.0|' else"
        " '.batch|' end, case when o_orderkey%6=0 then '' else"
        " concat(cast(1000+o_orderkey%5000 as string),'K') end) as value",
    )


def capacity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows of each day: mostly healthy states, some flags, bad states, short rows."""
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return finished.selectExpr(
        "cast(o_orderdate as timestamp) as snapshot_ts",
        "case when o_orderkey%41=0 then 'node|up' else"
        " concat('node',cast(o_custkey as string),'|', case when o_orderkey%53=0 then"
        " 'down' else 'up' end,'|', case o_orderkey%12 when 0 then 'idle' when 1 then"
        " 'allocated+' when 2 then 'down*' when 3 then 'drained' when 4 then"
        " 'allocated*+' else 'MIXED' end,'|', case when o_orderkey%2=0 then 'none'"
        " else '' end) end as value",
    )


def memory_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured memory totals, one host per customer."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('host',cast(c_custkey as string)) as host",
        "case when c_custkey%17<>0 then 1000+c_custkey%100*10 end as total",
        "case when c_custkey%19<>0 then 100+c_custkey%90 end as available",
        "c_custkey%50 as swap_total",
        "case when c_custkey%23<>0 then c_custkey%60 end as swap_free",
    )


def filesystem_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured mounts: several paths per host and device, some unavailable."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('host',cast(c_custkey%5 as string)) as host",
        "c_custkey as position",
        "concat('/mnt/',cast(c_custkey as string)) as path",
        "c_nationkey as device",
        "case when c_custkey%13=0 then null when c_custkey%11=0 then 0"
        " else 5000+c_nationkey end as total",
        "case when c_custkey%13=0 then null else c_custkey%5000 end as used",
    )


def poll_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rows of the polled identifiers, finished and open ones."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat(lpad(lower(hex(c_custkey)),8,'0'),'-0000-4000-8000-000000000000') as uuid",
        "case c_custkey%4 when 0 then 2 when 1 then 4 when 2 then 5 end as status",
    )


def poll_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status documents that exist for some of the polled identifiers."""
    return table(spark, sf_dir, "supplier").where("s_acctbal > 5000").selectExpr(
        "concat(lpad(lower(hex(s_suppkey)),8,'0'),'-0000-4000-8000-000000000000')"
        " as job_id"
    )
