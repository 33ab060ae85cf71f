"""The request insights report over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.operators import coverage, dedup, insights, lineage
from opsight.params import TimeRange
from opsight.sources import events as event_source


def read_insight_events(
    spark: SparkSession, paths: str | list[str], stored: str, tz: str = "UTC"
) -> tuple[DataFrame, DataFrame]:
    """Deduplicated events of the logs, and the rejected lines.

    About ten report sections read the events, so they are written to ``stored`` once
    instead of being parsed again for each. Variant inputs are kept as JSON text.
    """
    lines = event_source.read_event_lines(spark, paths)
    parsed = event_source.parse_events(lines, tz)
    unique = dedup.dedup_requests(parsed, event_source.READ_ORDER)
    unique.withColumn("inputs", F.to_json("inputs")).write.mode("overwrite").parquet(
        stored
    )
    events = spark.read.parquet(stored).withColumn("inputs", F.try_parse_json("inputs"))
    return events, event_source.event_rejects(lines)


def insights_report(
    events: DataFrame,
    period: TimeRange,
    *,
    process: str | None = "orchestrate",
    top: int = 10,
    sort_by: str = "name",
    incidents: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All sections of the report by name; ``process=None`` reports every process."""
    requests = insights.select_requests(events, period, process)
    operations = insights.select_operations(events, period)
    values = coverage.coverage_counts(requests)
    asked = lineage.request_lineage(requests)
    groups = lineage.collection_failures(asked)
    ranked = insights.category_rank(
        insights.failure_categories(requests.where("process = 'orchestrate'"))
    )
    messages = insights.failure_messages(requests, top)
    return {
        "period": insights.event_period(requests),
        "outcomes": insights.process_outcomes(requests),
        "durations": insights.duration_summary(requests),
        "failure_categories": insights.failure_categories(requests),
        "failure_messages": insights.with_examples(
            messages, insights.DETAIL_KEYS, insights.failure_items(requests), incidents
        ),
        "coverage": coverage.coverage(values),
        "coverage_values": coverage.coverage_top(values, top),
        "lineage": lineage.lineage_availability(asked),
        "collections": lineage.collections_sorted(
            lineage.collection_summary(asked), sort_by
        ),
        "collection_ranges": lineage.collection_ranges(asked, top),
        "failure_group_count": lineage.failure_group_count(groups),
        "collection_failures": insights.with_examples(
            insights.interleaved(groups, ranked, lineage.failure_order(), top),
            lineage.FAILURE_KEYS,
            lineage.collection_failure_rows(asked),
            incidents,
        ).orderBy("rank", "category_order"),
        "operations": insights.operation_summary(operations),
        "recent_operations": insights.recent_operations(operations, top),
    }


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each section as JSON lines in its own folder."""
    for name, section in sections.items():
        section.write.mode("overwrite").json(f"{path}/{name}")
