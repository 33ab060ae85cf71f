"""The job table: one row per accepted request, times on the writer's clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.functions import times
from opsight.functions.jobs import with_utc_times
from opsight.params import StatusCodes, TimeRange

MAX_WRITER_OFFSET = timedelta(hours=14)


def read_job_table(
    spark: SparkSession,
    path: str | None = None,
    *,
    jdbc: dict[str, str] | None = None,
    predicates: list[str] | None = None,
) -> DataFrame:
    """The job table from Parquet, or over JDBC split by ``predicates``.

    ``predicates`` are ranges of ``time_start`` that together cover the table, so
    that executors read it side by side; without them one task would read it all, so
    they must be given.
    """
    if path is not None:
        return spark.read.parquet(path)
    reader = spark.read
    options = dict(jdbc or {})
    url, table = options.pop("url"), options.pop("dbtable")
    if not predicates:
        raise ValueError("reading over JDBC needs predicates that split the table")
    return reader.jdbc(url, table, predicates=predicates, properties=options)


def range_candidates(period: TimeRange) -> Column:
    """Superset filter on the raw clock: any zone up to 14 hours either side.

    It is written on the stored column, so it is pushed into the scan; the exact
    filter follows once the times are in UTC.
    """
    condition = (F.col("operation") == "execute") & F.col("time_start").isNotNull()
    if period.start is not None:
        earliest = times.wall_clock(period.start - MAX_WRITER_OFFSET)
        condition = condition & (F.col("time_start") >= earliest)
    if period.end is not None:
        latest = times.wall_clock(period.end + MAX_WRITER_OFFSET)
        condition = condition & (F.col("time_start") <= latest)
    return condition


def within(period: TimeRange, column: str = "started_at") -> Column:
    condition = F.lit(True)
    if period.start is not None:
        condition = condition & (F.col(column) >= times.instant(period.start))
    if period.end is not None:
        condition = condition & (F.col(column) <= times.instant(period.end))
    return condition


def jobs_in_range(
    jobs: DataFrame,
    period: TimeRange,
    identifier: str | None = None,
    local_tz: str = "UTC",
) -> DataFrame:
    """Executed jobs that started inside ``period``, with their UTC times."""
    candidates = jobs.where(range_candidates(period))
    if identifier is not None:
        candidates = candidates.where(F.col("identifier") == identifier)
    return with_utc_times(candidates, local_tz).where(within(period))


def recent_or_active_jobs(
    jobs: DataFrame,
    since: datetime,
    codes: StatusCodes = StatusCodes(),
    local_tz: str = "UTC",
) -> DataFrame:
    """Executed jobs that may have started since ``since`` or are still active."""
    earliest = times.wall_clock(since - MAX_WRITER_OFFSET)
    candidates = jobs.where(
        (F.col("operation") == "execute")
        & ((F.col("time_start") >= earliest) | F.col("status").isin(codes.active))
    )
    return with_utc_times(candidates, local_tz)
