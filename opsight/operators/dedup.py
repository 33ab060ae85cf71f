"""First-wins removal of repeated events over current and rotated logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.operators.keys import first_by_key


def dedup_requests(events: DataFrame, order: list[str]) -> DataFrame:
    """Keep the first request of each service and job; other events all stay."""
    keyed = (F.col("record_type") == "request") & (
        F.coalesce(F.col("job_id"), F.lit("")) != ""
    )
    own_place = F.when(~keyed, F.struct(*order))
    return first_by_key(
        events,
        [
            F.when(keyed, F.col("service")),
            F.when(keyed, F.col("job_id")),
            own_place,
        ],
        order,
    )


def dedup_by_content(events: DataFrame, order: list[str]) -> DataFrame:
    """As :func:`dedup_requests`, and operations with equal content count once.

    Daily statistics use this rule: a rotated copy of an operation line has the
    same time, event, job and message.
    """
    keyed = (F.col("record_type") == "request") & (
        F.coalesce(F.col("job_id"), F.lit("")) != ""
    )
    return first_by_key(
        events,
        [
            keyed,
            F.when(keyed, F.col("service")),
            F.col("job_id"),
            *[
                F.when(~keyed, F.col(name))
                for name in ("recorded_at", "event", "message")
            ],
        ],
        order,
    )
