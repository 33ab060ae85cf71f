"""Job-table columns: status names, UTC times, durations and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions import times
from opsight.functions.derive import computed
from opsight.params import StatusCodes


def status_name(
    status: Column | str, codes: StatusCodes, other: str = "unmapped"
) -> Column:
    """Status code to report name; paused jobs are running, unknown codes ``other``."""
    status = F.col(status) if isinstance(status, str) else status
    name = (
        F.when(status == codes.accepted, "accepted")
        .when(status.isin(codes.started, codes.paused), "running")
        .when(status == codes.succeeded, "successful")
        .when(status == codes.failed, "failed")
    )
    if codes.dismissed is not None:
        name = name.when(status == codes.dismissed, "dismissed")
    return name.otherwise(other)


def with_utc_times(jobs: DataFrame, local_tz: str = "UTC") -> DataFrame:
    """Add ``started_at``/``ended_at`` in UTC and the inferred ``offset_minutes``."""
    created = computed(jobs, created_at=times.uuid1_instant("uuid"))
    offset = times.writer_offset_minutes("time_start", F.col("created_at"))
    measured = computed(created, offset_minutes=offset).drop("created_at")

    def utc(name: str) -> Column:
        return times.from_wall_clock(name, F.col("offset_minutes"), local_tz)

    return computed(measured, started_at=utc("time_start"), ended_at=utc("time_end"))


def completed_seconds(
    started: Column | str = "started_at", ended: Column | str = "ended_at"
) -> Column:
    """Seconds from start to end; null while open or when the end precedes the start."""
    started = F.col(started) if isinstance(started, str) else started
    ended = F.col(ended) if isinstance(ended, str) else ended
    seconds = times.seconds_between(ended, started)
    return F.when(seconds >= 0, seconds)


def age_seconds(now: Column, started: Column | str = "started_at") -> Column:
    started = F.col(started) if isinstance(started, str) else started
    seconds = times.seconds_between(now, started)
    return F.when(seconds >= 0, seconds)
