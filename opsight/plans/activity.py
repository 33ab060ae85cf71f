"""Reports over the job table: a time range and a moving window."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from opsight.operators import dbreport
from opsight.params import StatusCodes, TimeRange
from opsight.sources import jobs as job_source


def range_report(
    jobs: DataFrame,
    period: TimeRange,
    *,
    identifier: str | None = None,
    codes: StatusCodes = StatusCodes(),
    local_tz: str = "UTC",
    top: int = 10,
) -> dict[str, DataFrame]:
    """Statuses, timing, processes and errors of the jobs started in ``period``."""
    chosen = job_source.jobs_in_range(jobs, period, identifier, local_tz)
    facts = dbreport.job_facts(chosen, codes)
    return {
        "requests": dbreport.status_counts(facts),
        "shares": dbreport.status_share(facts),
        "requests_per_day": dbreport.requests_per_day(facts, local_tz),
        "durations": dbreport.numeric_summary(facts),
        "successful_durations": dbreport.duration_histogram(facts),
        "processes": dbreport.process_report(facts),
        "errors": dbreport.error_groups(facts, top),
    }


def window_report(
    jobs: DataFrame,
    now: datetime,
    window: timedelta = timedelta(hours=1),
    *,
    codes: StatusCodes = StatusCodes(),
    local_tz: str = "UTC",
    top: int | None = None,
) -> dict[str, DataFrame]:
    """Recent activity and the jobs that are still open."""
    chosen = job_source.recent_or_active_jobs(jobs, now - window, codes, local_tz)
    facts = dbreport.job_facts(chosen, codes, other="other", unnamed="unknown")
    return {
        "processes": dbreport.window_job_report(facts, now, window),
        "failure_categories": dbreport.window_failure_categories(facts, now, window),
        "active_jobs": dbreport.active_jobs(facts, now, window, top),
    }
