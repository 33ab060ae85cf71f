"""Durable daily statistics: one row per UTC day and service."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight import fixed
from opsight.functions import text
from opsight.functions.derive import computed
from opsight.operators.quantiles import order_statistics

KEYS = ["date", "service"]


def daily_statistics(events: DataFrame) -> DataFrame:
    """The fifteen statistics of each day and service.

    ``events`` are deduplicated request and operation events with ``event_time``.
    Undated events are left out. Negative durations count here. A failure's category is
    read from all values of its failures and diagnostics (``all_values``, where the
    events have it), whatever the members are called.
    """
    failures, diagnostics = F.col("failures"), F.col("diagnostics")
    whole = text.failure_text(failures, diagnostics)
    if "all_values" in events.columns:
        whole = F.coalesce("all_values", whole)
    dated = events.where("event_time is not null").withColumn(
        "date", F.to_date("event_time")
    )
    read = computed(
        dated,
        message_text=F.when(
            F.col("outcome") == "failed", whole
        ),
    )
    request = F.col("record_type") == "request"
    operation = F.col("record_type") == "operation"
    failed = request & (F.col("outcome") == "failed")
    message = F.col("message_text")

    def rows(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    def job_of(event: str) -> Column:
        return F.when(
            operation & (F.col("event") == event), F.nullif("job_id", F.lit(""))
        )

    measures = {
        "requests": rows(request),
        "successful": rows(request & (F.col("outcome") == "successful")),
        "failed": rows(failed),
        "memory_failures": rows(failed & text.is_memory_failure(message)),
        "timeout_failures": rows(failed & text.is_timeout_failure(message)),
        "operation_errors": rows(
            operation
            & (
                (F.col("event") == "operation-error")
                | F.coalesce(F.col("level") == "critical", F.lit(False))
            )
        ),
    }
    # Distinct jobs by grouping twice: nearly all events have neither job and
    # collapse to one row per day and task, where DISTINCT would triple every event.
    by_job = read.groupBy(
        *KEYS,
        job_of("job-recovered").alias("recovered_job"),
        job_of("job-long-running").alias("long_running_job"),
    ).agg(*[measure.alias(name) for name, measure in measures.items()])
    counts = by_job.groupBy(*KEYS).agg(
        *[F.sum(name).alias(name) for name in measures],
        F.count("recovered_job").alias("recovered_jobs"),
        F.count("long_running_job").alias("long_running_jobs"),
    )
    durations = order_statistics(
        dated.where(request), KEYS, "duration_seconds"
    ).select(
        *KEYS,
        F.col("count").alias("duration_count"),
        F.round("total", 3).alias("duration_total_seconds"),
        F.round("median", 3).alias("duration_median_seconds"),
        F.round("p95", 3).alias("duration_p95_seconds"),
        F.round("maximum", 3).alias("duration_max_seconds"),
    )
    return (
        counts.join(durations, KEYS, "left")
        .withColumns(
            {
                "duration_count": F.coalesce("duration_count", F.lit(0)),
                "duration_total_seconds": F.coalesce(
                    "duration_total_seconds", F.lit(0.0)
                ),
            }
        )
        .select(*fixed.DAILY_COLUMNS)
    )


def for_service(events: DataFrame, service: str) -> DataFrame:
    """Events of one service; an event that names none is counted for it too."""
    return events.where(
        F.col("service").isNull() | (F.col("service") == service)
    ).withColumn("service", F.lit(service))


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows replace stored rows of the same day and service; others stay."""
    kept = stored.join(fresh.select(*KEYS), KEYS, "left_anti")
    return fresh.unionByName(kept)


def write_daily(fresh: DataFrame, path: str) -> None:
    """Replace only the days present in ``fresh`` (dynamic partition overwrite)."""
    (
        fresh.repartition("service", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("service", "date")
        .parquet(path)
    )


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*fixed.DAILY_COLUMNS)


def trim(spark: SparkSession, path: str, today: date, keep_days: int) -> None:
    """Remove the stored days that :func:`retained` would leave out."""
    if keep_days < 0:
        raise ValueError("keep_days must not be negative")
    if keep_days == 0:
        return
    first = today - timedelta(days=keep_days - 1)
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/service=*/date=*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(pattern) or []:
        folder = status.getPath()
        if date.fromisoformat(folder.getName().removeprefix("date=")) < first:
            files.delete(folder, True)


def retained(rows: DataFrame, today: date, keep_days: int) -> DataFrame:
    """Rows of the last ``keep_days`` calendar days; 0 keeps all."""
    if keep_days < 0:
        raise ValueError("keep_days must not be negative")
    if keep_days == 0:
        return rows
    first = today - timedelta(days=keep_days - 1)
    return rows.where(F.col("date") >= F.lit(first))


def recent_days(rows: DataFrame, days: int = 14) -> DataFrame:
    return rows.orderBy(F.col("date").desc(), "service").limit(days)


def rollup(
    rows: DataFrame, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Totals per service over an inclusive range of days."""
    chosen = rows
    if start is not None:
        chosen = chosen.where(F.col("date") >= F.lit(start))
    if end is not None:
        chosen = chosen.where(F.col("date") <= F.lit(end))
    totals = [
        "requests",
        "successful",
        "failed",
        "duration_count",
        "memory_failures",
        "timeout_failures",
        "recovered_jobs",
        "long_running_jobs",
        "operation_errors",
    ]
    summed = chosen.groupBy("service").agg(
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        *[F.sum(name).alias(name) for name in totals],
        F.sum("duration_total_seconds").alias("seconds"),
        F.max("duration_max_seconds").alias("duration_max_seconds"),
    )
    return summed.select(
        "service",
        "first",
        "last",
        *totals,
        F.when(
            F.col("requests") > 0,
            F.round(F.col("successful") * F.lit(100.0) / F.col("requests"), 1),
        )
        .otherwise(0.0)
        .alias("success_rate"),
        F.when(
            F.col("duration_count") > 0,
            F.round(F.col("seconds") / F.col("duration_count"), 3),
        ).alias("duration_average_seconds"),
        F.nullif("duration_max_seconds", F.lit(0.0)).alias("duration_max_seconds"),
    )
