"""Job-table reports: range report and moving-window activity."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight import fixed
from opsight.functions import jobs as job_columns
from opsight.functions import text, times
from opsight.functions.derive import computed
from opsight.operators.insights import success_share
from opsight.operators.quantiles import order_statistics
from opsight.params import StatusCodes

ALL = "(all)"


def job_facts(
    jobs: DataFrame,
    codes: StatusCodes = StatusCodes(),
    *,
    other: str = "unmapped",
    unnamed: str = "(unknown)",
) -> DataFrame:
    """Jobs with UTC times plus ``process``, ``state`` and completed ``seconds``."""
    return computed(
        jobs.where("time_start is not null"),
        process=F.coalesce(F.nullif("identifier", F.lit("")), F.lit(unnamed)),
        state=job_columns.status_name("status", codes, other),
        seconds=job_columns.completed_seconds(),
    )


def _state_counts() -> list[Column]:
    return [F.count_if(F.col("state") == name).alias(name) for name in fixed.STATUS_NAMES]


def status_counts(facts: DataFrame) -> DataFrame:
    """Zero-filled count of every status and the rate over finished jobs."""
    final = F.col("successful") + F.col("failed")
    return facts.agg(F.count(F.lit(1)).alias("total"), *_state_counts()).withColumn(
        "success_rate_percent", success_share(F.col("successful"), final, 2)
    )


def status_share(facts: DataFrame) -> DataFrame:
    """Count and percentage of each status that occurs.

    The window spans the aggregated statuses, of which there are six at most.
    """
    counts = facts.groupBy("state").agg(F.count(F.lit(1)).alias("count"))
    share = F.col("count") * F.lit(100.0) / F.sum("count").over(Window.partitionBy())
    return counts.withColumn("share_percent", F.round(share, 2))


def numeric_summary(facts: DataFrame, value: str = "seconds") -> DataFrame:
    """Count, minimum, maximum, median and total over all and per process."""
    named = facts.where(F.col(value).isNotNull()).groupBy("process", value).agg(
        F.count(F.lit(1)).alias("n")
    )
    scoped = named.select(
        F.explode(F.array(F.lit(ALL), F.col("process"))).alias("process"), value, "n"
    )
    summary = order_statistics(scoped, ["process"], value, weight="n")
    return summary.select("process", "count", "minimum", "maximum", "median", "total")


def duration_histogram(facts: DataFrame) -> DataFrame:
    """Successful durations in four ranges, and the longest one."""
    seconds = F.col("seconds")
    done = facts.where((F.col("state") == "successful") & seconds.isNotNull())
    return done.agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(seconds < 60).alias("under_1_minute"),
        F.count_if((seconds >= 60) & (seconds < 600)).alias("from_1_to_under_10_minutes"),
        F.count_if((seconds >= 600) & (seconds < 1800)).alias(
            "from_10_to_under_30_minutes"
        ),
        F.count_if(seconds >= 1800).alias("from_30_minutes"),
        F.max("seconds").alias("maximum"),
    )


def requests_per_day(facts: DataFrame, local_tz: str = "UTC") -> DataFrame:
    """Fewest, median and most requests over the local days that have any.

    The second aggregate sees one row per calendar day.
    """
    day = F.to_date(F.from_utc_timestamp("started_at", local_tz))
    daily = facts.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    return daily.agg(
        F.count(F.lit(1)).alias("days"),
        F.min("requests").alias("minimum"),
        F.max("requests").alias("maximum"),
        F.median("requests").alias("median"),
    )


def process_report(facts: DataFrame) -> DataFrame:
    """Statuses, durations and success rate per process, busiest first."""
    counts = facts.groupBy("process").agg(
        F.count(F.lit(1)).alias("total"), *_state_counts()
    )
    durations = order_statistics(facts, ["process"], "seconds").select(
        "process",
        F.col("count").alias("measured"),
        F.col("minimum").alias("min_seconds"),
        F.col("maximum").alias("max_seconds"),
        F.col("median").alias("median_seconds"),
        F.col("total").alias("total_seconds"),
    )
    final = F.col("successful") + F.col("failed")
    return (
        counts.join(durations, "process", "left")
        .withColumns(
            {
                "measured": F.coalesce("measured", F.lit(0)),
                "active": F.col("accepted") + F.col("running"),
                "other": F.col("dismissed") + F.col("unmapped"),
                "success_rate_percent": success_share(F.col("successful"), final, 1),
            }
        )
        .orderBy(F.col("total").desc(), "process")
    )


def error_groups(facts: DataFrame, top: int | None = 10) -> DataFrame:
    """Failure messages with their count and first and last occurrence."""
    message = F.coalesce(F.nullif("message", F.lit("")), F.lit("(empty)"))
    groups = (
        facts.where("state = 'failed'")
        .groupBy(message.alias("message"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("started_at").alias("first"),
            F.max("started_at").alias("last"),
        )
        .orderBy(F.col("count").desc(), F.col("last").desc(), "message")
    )
    return groups if top is None else groups.limit(top)


def with_window(facts: DataFrame, now: datetime, window: timedelta) -> DataFrame:
    """Mark jobs that started inside the window ending now, and active ones."""
    started = F.col("started_at")
    return facts.withColumns(
        {
            "in_window": (started >= times.instant(now - window))
            & (started <= times.instant(now)),
            "is_active": F.col("state").isin("accepted", "running"),
        }
    )


def window_job_report(
    facts: DataFrame, now: datetime, window: timedelta
) -> DataFrame:
    """Activity over all (``(all)``) and per process.

    Requests, outcomes and durations count the window only. ``active`` counts open
    jobs of any age per process, and those of the window in the ``(all)`` row. A
    process without a request in the window or an open job has no row.
    """
    return _activity(with_window(facts, now, window), []).orderBy(
        F.col("requests").desc(), "process"
    )


def moving_job_reports(
    facts: DataFrame, slides: Column, window: timedelta
) -> DataFrame:
    """The window report of several instants, ``slide``, each as of that instant.

    ``slides`` is an array of instants in order; a job is copied to those at which it is open
    or inside the window, and has there the state that it had then.
    """
    micros = int(window.total_seconds() * 1_000_000)
    start, end = F.col("started_at"), F.col("ended_at")
    done = ~F.col("state").isin("accepted", "running")

    def counts(slide: Column) -> Column:
        inside = F.unix_micros(slide) - F.unix_micros(start) <= micros
        was_open = ~done | F.coalesce(end > slide, F.lit(False))
        return (start <= slide) & (inside | was_open)

    placed = facts.select("*", F.explode(F.filter(slides, counts)).alias("slide"))
    was_open = done & F.coalesce(end > F.col("slide"), F.lit(False))
    marked = placed.withColumns(
        {
            "in_window": F.unix_micros("slide") - F.unix_micros("started_at") <= micros,
            "state": F.when(was_open, "running").otherwise(F.col("state")),
        }
    ).withColumn("is_active", F.col("state").isin("accepted", "running"))
    return _activity(marked, ["slide"])


def _activity(marked: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the window report, for each value of ``by``."""
    marked = marked.where("in_window or is_active")
    recent = F.col("in_window")

    def in_window(condition: Column) -> Column:
        return F.count_if(recent & condition)

    state = F.col("state")
    measures = [
        F.count_if(recent).alias("requests"),
        in_window(state == "successful").alias("successful"),
        in_window(state == "failed").alias("failed"),
        in_window(~state.isin("successful", "failed", "accepted", "running")).alias(
            "other"
        ),
        in_window(F.col("is_active")).alias("active_in_window"),
        F.count_if("is_active").alias("active_any_age"),
    ]
    counts = marked.groupBy(*by, "process").agg(*measures)
    totals = [
        F.coalesce(F.sum(name), F.lit(0)).alias(name)
        for name in counts.columns
        if name not in ("process", *by)
    ]
    counts = counts.unionByName(
        counts.groupBy(*by).agg(*totals).withColumn("process", F.lit(ALL))
    )
    finished = marked.where("in_window and not is_active").groupBy(
        *by, "process", "seconds"
    ).agg(F.count(F.lit(1)).alias("n"))
    durations = order_statistics(
        finished.select(
            *by,
            F.explode(F.array(F.lit(ALL), F.col("process"))).alias("process"),
            "seconds",
            "n",
        ),
        [*by, "process"],
        "seconds",
        p95="ceiling",
        weight="n",
    )
    final = F.col("successful") + F.col("failed")
    return counts.join(
        durations.select(*by, "process", "count", "median", "p95", "maximum"),
        [*by, "process"],
        "left",
    ).select(
        *by,
        "process",
        "requests",
        "successful",
        "failed",
        F.when(F.col("process") == ALL, F.col("active_in_window"))
        .otherwise(F.col("active_any_age"))
        .alias("active"),
        "other",
        success_share(F.col("successful"), final, 2).alias("success_rate"),
        F.coalesce("count", F.lit(0)).alias("measured"),
        F.col("median").alias("median_seconds"),
        F.col("p95").alias("p95_seconds"),
        F.col("maximum").alias("max_seconds"),
    )


def window_failure_categories(
    facts: DataFrame, now: datetime, window: timedelta
) -> DataFrame:
    failed = with_window(facts, now, window).where("in_window and state = 'failed'")
    return failed.groupBy(text.failure_category("message").alias("category")).agg(
        F.count(F.lit(1)).alias("failures")
    )


def active_jobs(
    facts: DataFrame, now: datetime, window: timedelta, top: int | None = None
) -> DataFrame:
    """Open jobs of any age, oldest first."""
    active = (
        with_window(facts, now, window)
        .where("is_active")
        .select(
            F.coalesce(F.nullif("uuid", F.lit("")), F.lit("unknown")).alias("job_id"),
            "process",
            F.col("state").alias("status"),
            "started_at",
            job_columns.age_seconds(times.instant(now)).alias("age_seconds"),
            "in_window",
        )
        .orderBy("started_at", "job_id")
    )
    return active if top is None else active.limit(top)


def duration_summary_ceiling(facts: DataFrame) -> DataFrame:
    """Count, median, p95 (upper rank) and maximum per process."""
    return order_statistics(facts, ["process"], "seconds", p95="ceiling").select(
        "process",
        "count",
        F.col("median").alias("median_seconds"),
        F.col("p95").alias("p95_seconds"),
        F.col("maximum").alias("max_seconds"),
    )


def recent_status_mix(
    facts: DataFrame, now: datetime, window: timedelta
) -> DataFrame:
    """Status counts of the jobs that started inside the window."""
    recent = with_window(facts, now, window).where("in_window")
    return recent.agg(F.count(F.lit(1)).alias("total"), *_state_counts())
