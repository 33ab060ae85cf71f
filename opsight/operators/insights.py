"""Request reports: outcomes, durations, failure causes and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight import fixed
from opsight.functions import text
from opsight.functions.derive import computed
from opsight.operators.keys import top_per_group
from opsight.operators.quantiles import order_statistics
from opsight.params import TimeRange
from opsight.sources.jobs import within


def named_outcome() -> Column:
    return F.coalesce(F.nullif("outcome", F.lit("")), F.lit("unknown"))


def named_process() -> Column:
    return F.coalesce(F.nullif("process", F.lit("")), F.lit("unknown"))


def select_requests(
    events: DataFrame, period: TimeRange, process: str | None = None
) -> DataFrame:
    """Events inside ``period`` that are not operations, of one process if given.

    An undated event is kept only by a range that is open at both ends.
    """
    chosen = events.where(F.col("record_type") != "operation")
    if period.start is not None or period.end is not None:
        chosen = chosen.where(within(period, "event_time"))
    return chosen if process is None else chosen.where(F.col("process") == process)


def select_operations(events: DataFrame, period: TimeRange) -> DataFrame:
    chosen = events.where(F.col("record_type") == "operation")
    if period.start is not None or period.end is not None:
        chosen = chosen.where(within(period, "event_time"))
    return chosen


def event_period(requests: DataFrame) -> DataFrame:
    """Services seen, first and last event, request count. Services are few names."""
    return requests.agg(
        F.concat_ws(
            ",", F.sort_array(F.collect_set(F.nullif("service", F.lit(""))))
        ).alias("services"),
        F.min("event_time").alias("first"),
        F.max("event_time").alias("last"),
        F.count(F.lit(1)).alias("requests"),
    )


def process_outcomes(requests: DataFrame) -> DataFrame:
    """Requests per process and outcome, with totals over all processes."""
    return (
        requests.select(named_process().alias("process"), named_outcome().alias("outcome"))
        .groupBy("process", "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupingSets(
            [["outcome"], ["process", "outcome"]], "process", "outcome"
        )
        .agg(F.grouping("process").alias("is_total"), F.sum("n").alias("requests"))
        .select(
            F.when(F.col("is_total") == 1, "all").otherwise("process").alias("scope"),
            F.coalesce("process", F.lit("(all)")).alias("process"),
            "outcome",
            "requests",
        )
    )


def duration_summary(requests: DataFrame) -> DataFrame:
    """Count, median, p95 and maximum over all requests, per outcome, per process.

    Equal durations are counted before each count is credited to its three scopes,
    so the scopes multiply distinct values and not requests.
    """
    counted = (
        requests.where(F.col("duration_seconds") >= 0)
        .groupBy(
            named_process().alias("process"),
            named_outcome().alias("outcome"),
            "duration_seconds",
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    scoped = counted.select(
        F.inline(
            F.array(
                F.struct(F.lit("all").alias("scope"), F.lit("all").alias("name")),
                F.struct(F.lit("outcome").alias("scope"), F.col("outcome").alias("name")),
                F.struct(F.lit("process").alias("scope"), F.col("process").alias("name")),
            )
        ),
        "duration_seconds",
        "n",
    )
    summary = order_statistics(
        scoped, ["scope", "name"], "duration_seconds", weight="n"
    )
    return summary.select(
        "scope",
        "name",
        "count",
        F.round("median", 3).alias("median_seconds"),
        F.round("p95", 3).alias("p95_seconds"),
        F.round("maximum", 3).alias("max_seconds"),
    )


def failed_with_category(requests: DataFrame) -> DataFrame:
    """Failed requests with their category and root-cause message."""
    failures, diagnostics = F.col("failures"), F.col("diagnostics")
    read = computed(
        requests.where("outcome = 'failed'"),
        failure_text=text.failure_text(failures, diagnostics),
        first_message=text.first_message(failures, diagnostics),
    )
    return computed(
        read,
        category=text.failure_category("failure_text"),
        cause=text.root_cause("first_message"),
    ).drop("failure_text", "first_message")


def failure_categories(requests: DataFrame) -> DataFrame:
    return (
        failed_with_category(requests)
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def category_rank(counts: DataFrame, count: str = "failures") -> DataFrame:
    """Order of categories in a report: the pressing ones, then by count and name.

    One row per category name, so the unpartitioned window is a handful of rows.
    """
    priority = F.lit(len(fixed.PRIORITY_CATEGORIES))
    for at, name in reversed(list(enumerate(fixed.PRIORITY_CATEGORIES))):
        priority = F.when(F.col("category") == name, at).otherwise(priority)
    pressing = F.col("category").isin(*fixed.PRIORITY_CATEGORIES)
    by_count = F.when(pressing, F.lit(0)).otherwise(F.col(count))
    order = Window.orderBy(priority, by_count.desc(), "category")
    return counts.withColumn("category_order", F.row_number().over(order))


def failure_items(requests: DataFrame) -> DataFrame:
    """One row per failure or diagnostic of the failed requests."""
    failed = failed_with_category(requests).withColumn(
        "job_id", F.coalesce(F.nullif("job_id", F.lit("")), F.lit("unknown"))
    )

    def blank(value: Column) -> Column:
        return F.coalesce(value, F.lit(""))

    from_failures = F.transform(
        "failures",
        lambda item: F.struct(
            blank(item["code"]).alias("code"),
            blank(item["locator"]).alias("locator"),
            F.coalesce(
                F.nullif(item["message"], F.lit("")), F.lit(fixed.UNKNOWN_FAILURE)
            ).alias("text"),
        ),
    )
    from_diagnostics = F.transform(
        F.filter(
            "diagnostics", lambda item: text.stripped(blank(item["message"])) != ""
        ),
        lambda item: F.struct(
            F.lit("diagnostic").alias("code"),
            F.coalesce(F.nullif(item["source"], F.lit("")), F.lit("runtime")).alias(
                "locator"
            ),
            text.stripped(item["message"]).alias("text"),
        ),
    )
    nothing = F.expr("cast(array() as array<struct<code:string,locator:string,text:string>>)")
    return failed.select(
        "category",
        "job_id",
        F.inline(
            F.concat(
                F.coalesce(from_failures, nothing), F.coalesce(from_diagnostics, nothing)
            )
        ),
    )


DETAIL_KEYS = ["category", "code", "locator", "text"]


def failure_messages(requests: DataFrame, top: int | None = 10) -> DataFrame:
    """Failure groups by category, code, locator and message, most frequent first."""
    groups = failure_items(requests).groupBy(*DETAIL_KEYS).agg(
        F.count(F.lit(1)).alias("count")
    )
    return groups if top is None else most_frequent(groups, top)


def most_frequent(groups: DataFrame, top: int) -> DataFrame:
    return groups.orderBy(F.col("count").desc(), *DETAIL_KEYS).limit(top)


def example_jobs(
    jobs: DataFrame,
    groups: list[str],
    incidents: DataFrame | None = None,
    limit: int = fixed.EXAMPLE_JOBS,
) -> DataFrame:
    """A few jobs per group, archived ones first, with their archived documents.

    Each job is reduced to one row per group before ranking, and the ranking keeps
    ``limit`` rows per group on the map side.
    """
    distinct = jobs.select(*groups, "job_id").distinct()
    if incidents is None:
        marked = distinct.withColumn("documents", F.lit(0).cast("bigint"))
    else:
        archived = incidents.groupBy(F.col("job_id").alias("archived_id")).agg(
            F.count(F.lit(1)).alias("documents")
        )
        marked = distinct.join(
            archived, F.lower("job_id") == F.col("archived_id"), "left"
        ).withColumn("documents", F.coalesce("documents", F.lit(0)))
    return top_per_group(
        marked, groups, [(F.col("documents") > 0).desc(), F.col("job_id")], limit
    ).select(*groups, "rank", "job_id", "documents")


ARCHIVED = "array<struct<kind:string,path:string>>"


def with_examples(
    rows: DataFrame,
    groups: list[str],
    jobs: DataFrame,
    incidents: DataFrame | None = None,
    limit: int = fixed.EXAMPLE_JOBS,
) -> DataFrame:
    """Report rows with ``example_jobs`` and, for those archived, ``status_xml``.

    ``rows`` are the few groups that are reported; ``jobs`` has one row for each failure.
    ``status_xml`` gives kind and path of every archived document by job. Only the chosen
    jobs are joined with the archive for that.
    """
    keys = rows.select(*groups).distinct()
    chosen = example_jobs(jobs.join(keys, groups, "left_semi"), groups, incidents, limit)
    if incidents is None:
        listed = chosen.withColumn("archived", F.lit(None).cast(ARCHIVED))
    else:
        wanted = chosen.where("documents > 0").select(F.lower("job_id").alias("archived_id")).distinct()
        documents = (
            incidents.join(wanted, incidents["job_id"] == wanted["archived_id"])
            .groupBy("archived_id")
            .agg(F.array_sort(F.collect_list(F.struct("kind", "path"))).alias("archived"))
        )
        listed = chosen.join(documents, F.lower("job_id") == F.col("archived_id"), "left")
    examples = listed.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("rank", "job_id", "archived"))).alias("examples")
    )
    with_documents = F.filter("examples", lambda e: e["archived"].isNotNull())
    return rows.join(examples, groups, "left").select(
        *rows.columns,
        F.transform("examples", lambda e: e["job_id"]).alias("example_jobs"),
        F.map_from_entries(
            F.transform(with_documents, lambda e: F.struct(e["job_id"], e["archived"]))
        ).alias("status_xml"),
    )


def failure_examples(
    requests: DataFrame, incidents: DataFrame, limit: int = fixed.EXAMPLE_JOBS
) -> DataFrame:
    """Example jobs of every failure group with their archived documents."""
    return example_jobs(failure_items(requests), DETAIL_KEYS, incidents, limit)


def interleaved(
    groups: DataFrame, ranked_categories: DataFrame, order: list[Column], top: int
) -> DataFrame:
    """``top`` groups taken in turn from each category in report order.

    Taking turns equals sorting by the rank inside the category, then by category.
    The category table has one row per category name, few enough to broadcast.
    """
    best = top_per_group(groups, ["category"], order, top)
    return (
        best.join(
            F.broadcast(ranked_categories.select("category", "category_order")),
            "category",
        )
        .orderBy("rank", "category_order")
        .limit(top)
    )


def operation_summary(operations: DataFrame) -> DataFrame:
    def jobs_with(event: str) -> Column:
        return F.count_distinct(
            F.when(F.col("event") == event, F.nullif("job_id", F.lit("")))
        )

    return operations.agg(
        F.count(F.lit(1)).alias("events"),
        jobs_with("job-recovered").alias("recovered_jobs"),
        jobs_with("job-long-running").alias("long_running_jobs"),
        F.count_if(
            F.coalesce(F.col("event") == "operation-error", F.lit(False))
            | F.coalesce(F.col("level") == "critical", F.lit(False))
        ).alias("errors"),
    )


def recent_operations(
    operations: DataFrame, top: int = 10, tie_break: list[str] | None = None
) -> DataFrame:
    """Newest operations first; undated ones come last."""
    return (
        operations.orderBy(F.col("event_time").desc_nulls_last(), *(tie_break or []))
        .limit(top)
        .select("event_time", "event", "job_id", "message")
    )


def as_report_rows(report: DataFrame, name: str) -> DataFrame:
    """Any report section as named JSON rows."""
    return report.select(
        F.lit(name).alias("section"), F.to_json(F.struct(*report.columns)).alias("row")
    )


def success_share(successful: Column, total: Column, digits: int) -> Column:
    return F.when(total > 0, F.round(successful * F.lit(100.0) / total, digits))


