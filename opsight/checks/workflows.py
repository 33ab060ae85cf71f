"""Queries over workflow payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.checks.sql_tables import WORKFLOWS, with_tables
from opsight.functions import text, variants
from opsight.operators import coverage as cover
from opsight.operators import insights
from opsight.operators import lineage as lines
from opsight.sources import driver_tables as tables


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orchestrate requests with the payload as their workflow input."""
    return tables.workflows(spark, sf).selectExpr(
        "event_id",
        "job_id",
        "process",
        "outcome",
        "to_variant_object(named_struct('workflow', array(named_struct("
        "'type', 'ComplexData', 'value', payload)), 'site', array(named_struct("
        "'type', 'LiteralData', 'value', concat('site', event_id%3))))) as inputs",
        "case when message is null then"
        " cast(array() as array<struct<code:string,locator:string,message:string>>)"
        " else array(named_struct('code', cast(null as string), 'locator',"
        " cast(null as string), 'message', message)) end as failures",
        "cast(array() as array<struct<source:string,message:string>>) as diagnostics",
    )


def _lineage(spark, sf):
    return lines.request_lineage(_requests(spark, sf))


def json_flatten(spark, sf):
    nodes = tables.workflows(spark, sf).select(
        "event_id",
        F.lit("w").alias("path"),
        F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).alias("node"),
    )
    return cover.flatten_json(nodes)


LEAVES = """leaves as (
select event_id, 'inputs.tas' as path, concat('"c3s.ds', cast(user_id%12 as varchar), '"') as leaf from workflows where k%17<>0
union all select event_id, 'inputs.derived', '"regrid_1/output"' from workflows where k%17<>0
union all select event_id, 'steps.subset.in.collection', '"inputs/tas"' from workflows where k%17<>0 and k%7<>0
union all select event_id, 'steps.subset.in.time_components',
  concat('"month:jan|year:', 1950+user_id%40, ',', 1951+user_id%40, ',', 1954+user_id%40, '"') from workflows where k%17<>0 and k%3=0
union all select event_id, 'steps.subset.in.time', case when k%3=1 then concat('"', 1950+user_id%40, '/', 1950+user_id%40+k%6, '"')
  else concat('"', 1950+user_id%40, '"') end from workflows where k%17<>0 and k%3<>0)"""

JSON_FLATTEN = with_tables(
    WORKFLOWS,
    LEAVES,
    body="""select event_id, concat('w.', replace(path, 'steps.subset.', 'steps.subset_1.')) as path, leaf from leaves
union all select event_id, 'w.steps.subset_1.run', '"subset"' from workflows where k%17<>0""",
)

COVERED = """covered as (
select concat('orchestrate.workflow.', replace(path, '.in.', '.')) as dimension,
  case when path like '%time_components' then regexp_replace(leaf, 'year:(\\d+),(\\d+),(\\d+)', 'year:\\1-\\2,\\3') else leaf end as value from leaves
union all select 'orchestrate.site', concat('"site', event_id%3, '"') from workflows)"""


def coverage(spark, sf):
    return cover.coverage(cover.coverage_counts(_requests(spark, sf)))


COVERAGE = with_tables(
    WORKFLOWS,
    LEAVES,
    COVERED,
    body="select dimension, count(*) as uses, count(distinct value) as distinct_values from covered group by dimension",
)


def coverage_top(spark, sf):
    return cover.coverage_top(cover.coverage_counts(_requests(spark, sf)), top=5)


COVERAGE_TOP = with_tables(
    WORKFLOWS,
    LEAVES,
    COVERED,
    body="""select dimension, value, count, rank from (select dimension, value, count(*) as count,
row_number() over (partition by dimension order by count(*) desc, value) as rank from covered group by dimension, value) where rank <= 5""",
)

# Dataset, years and range of each parsed payload, from the source columns.
FACTS = """facts as (
select *, concat('c3s.ds', cast(user_id%12 as varchar)) as collection,
  case when k%3=0 then [1950+user_id%40, 1951+user_id%40, 1954+user_id%40]
       when k%3=1 then range(1950+user_id%40, 1951+user_id%40+k%6) else [1950+user_id%40] end as years,
  case when k%3=1 then concat(1950+user_id%40, '/', 1950+user_id%40+k%6) when k%3=2 then cast(1950+user_id%40 as varchar) end as time_range
from workflows where k%17<>0)"""

COMPACT = """case when k%3=0 then concat(1950+user_id%40, '-', 1951+user_id%40, ',', 1954+user_id%40)
  when k%3=1 and k%6>0 then concat(1950+user_id%40, '-', 1950+user_id%40+k%6) else cast(1950+user_id%40 as varchar) end"""


def requested_years(spark, sf):
    payload = F.try_parse_json("payload")
    parsed = tables.workflows(spark, sf).select("event_id", payload.alias("p"))

    def strings(name):
        return variants.string_values(
            F.try_variant_get("p", f"$.steps.subset_1.in.{name}", "variant")
        )

    years = lines.requested_years(strings("time"), strings("time_components"))
    return parsed.where("p is not null").select(
        "event_id", F.concat_ws(",", years.cast("array<string>")).alias("years")
    )


REQUESTED_YEARS = with_tables(
    WORKFLOWS,
    FACTS,
    body="select event_id, list_aggregate(years, 'string_agg', ',') as years from facts",
)


def year_ranges(spark, sf):
    return lines.exploded_lineage(_lineage(spark, sf), "event_id").select(
        "event_id", text.compact_years(F.col("years")).alias("year_coverage")
    )


YEAR_RANGES = with_tables(
    WORKFLOWS,
    FACTS,
    body=f"select event_id, {COMPACT} as year_coverage from facts",
)


def lineage(spark, sf):
    return lines.exploded_lineage(_lineage(spark, sf), "event_id", "outcome").select(
        "event_id",
        "outcome",
        "collection",
        F.concat_ws(",", F.col("years").cast("array<string>")).alias("years"),
        F.concat_ws(",", "ranges").alias("ranges"),
    )


LINEAGE = with_tables(
    WORKFLOWS,
    FACTS,
    body="""select event_id, outcome, collection, list_aggregate(years, 'string_agg', ',') as years,
coalesce(time_range, '') as ranges from facts""",
)

# Runs of consecutive years per collection.
ISLANDS = """islands as (
select collection, string_agg(case when lo=hi then cast(lo as varchar) else concat(lo, '-', hi) end, ',' order by lo) as year_coverage
from (select collection, min(y) as lo, max(y) as hi from (
  select collection, y, y - row_number() over (partition by collection order by y) as grp
  from (select distinct collection, unnest(years) as y from facts)) group by collection, grp) group by collection),
year_lists as (select collection, string_agg(cast(y as varchar), ',' order by y) as all_years from (select distinct collection, unnest(years) as y from facts) group by collection)"""
SUMMARY = """select f.collection, count(*) as requests, count(case when outcome='successful' then 1 end) as successful,
count(case when outcome='failed' then 1 end) as failed, any_value(year_coverage) as year_coverage,
concat('{', concat_ws(',', case when count(case when outcome='failed' then 1 end) > 0 then concat('"failed":', count(case when outcome='failed' then 1 end)) end,
case when count(case when outcome='successful' then 1 end) > 0 then concat('"successful":', count(case when outcome='successful' then 1 end)) end), '}') as outcomes,
any_value(all_years) as years
from facts f join islands using (collection) join year_lists using (collection) group by f.collection"""


def _as_text(rows):
    years = F.concat_ws(",", F.col("years").cast("array<string>"))
    return rows.withColumns({"outcomes": F.to_json("outcomes"), "years": years})


def collection_summary(spark, sf):
    return _as_text(lines.collection_summary(_lineage(spark, sf)))


COLLECTION_SUMMARY = with_tables(WORKFLOWS, FACTS, ISLANDS, body=SUMMARY)


def collections_sorted(spark, sf):
    return _as_text(lines.collections_sorted(lines.collection_summary(_lineage(spark, sf)), "failed"))


COLLECTIONS_SORTED = with_tables(
    WORKFLOWS,
    FACTS,
    ISLANDS,
    body=f"select * from ({SUMMARY}) order by failed desc, collection",
)


def collection_ranges(spark, sf):
    return lines.collection_ranges(_lineage(spark, sf), top=3)


COLLECTION_RANGES = with_tables(
    WORKFLOWS,
    FACTS,
    body="""select * from (select collection, time_range, count(*) as count,
row_number() over (partition by collection order by count(*) desc, time_range) as rank
from facts where time_range is not null group by collection, time_range) where rank <= 3""",
)

FAILED = f"""failed as (
select job_id, case when k%17=0 then 'unknown' else concat('c3s.ds', cast(user_id%12 as varchar)) end as collection,
  case when k%17=0 then 'unknown' else {COMPACT} end as years,
  case when k%17=0 then '' when k%3=1 then concat(1950+user_id%40, '/', 1950+user_id%40+k%6) when k%3=2 then cast(1950+user_id%40 as varchar) else '' end as time_ranges,
  case when k%4=1 then 'memory' when k%4=2 then 'timeout' else 'other' end as category, message from workflows where outcome='failed')"""


def collection_failures(spark, sf):
    """Failure groups with their example jobs and the number of groups."""
    asked = _lineage(spark, sf)
    groups = lines.collection_failures(asked)
    rows = insights.with_examples(groups, lines.FAILURE_KEYS, lines.collection_failure_rows(asked))
    total = lines.failure_group_count(groups).first()[0]
    return rows.drop("status_xml").withColumns(
        {"example_jobs": F.array_join("example_jobs", ","), "groups": F.lit(total)}
    )


COLLECTION_FAILURES = with_tables(
    WORKFLOWS,
    FAILED,
    """grouped as (select collection, years, time_ranges, category, message, count(*) as count, list_sort(list(distinct job_id)) as jobs
  from failed group by all)""",
    body="select * exclude (jobs), array_to_string(jobs[1:3], ',') as example_jobs, (select count(*) from grouped) as groups from grouped",
)


def lineage_availability(spark, sf):
    return lines.lineage_availability(_lineage(spark, sf))


LINEAGE_AVAILABILITY = with_tables(
    WORKFLOWS,
    body="""select count(*) as requests, count(case when k%17<>0 then 1 end) as with_lineage,
count(case when k%17=0 then 1 end) as without_lineage from workflows""",
)

REGISTRY = {
    "json_flatten": (json_flatten, JSON_FLATTEN),
    "coverage": (coverage, COVERAGE),
    "coverage_top": (coverage_top, COVERAGE_TOP),
    "requested_years": (requested_years, REQUESTED_YEARS),
    "year_ranges": (year_ranges, YEAR_RANGES),
    "lineage": (lineage, LINEAGE),
    "lineage_availability": (lineage_availability, LINEAGE_AVAILABILITY),
    "collection_summary": (collection_summary, COLLECTION_SUMMARY),
    "collections_sorted": (collections_sorted, COLLECTIONS_SORTED),
    "collection_ranges": (collection_ranges, COLLECTION_RANGES),
    "collection_failures": (collection_failures, COLLECTION_FAILURES),
}
