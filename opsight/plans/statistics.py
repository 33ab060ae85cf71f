"""The durable daily statistics of a service."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.operators import daily, dedup
from opsight.sources import events as event_source


def update_statistics(
    spark: SparkSession,
    paths: str | list[str],
    table: str,
    service: str,
    *,
    keep_days: int = 0,
    today: date | None = None,
) -> DataFrame:
    """Replace the days the logs cover and return the rejected lines.

    Days that only the table still knows are left as they are; with ``keep_days`` the
    stored table is cut down to that many calendar days up to ``today``.
    """
    lines = event_source.read_event_lines(spark, paths)
    events = dedup.dedup_by_content(
        event_source.parse_events(lines), event_source.READ_ORDER
    )
    daily.write_daily(daily.daily_statistics(daily.for_service(events, service)), table)
    daily.trim(spark, table, today or date.today(), keep_days)
    return event_source.event_rejects(lines).where("reason = 'invalid-json'")


def statistics_report(
    spark: SparkSession,
    table: str,
    start: date | None = None,
    end: date | None = None,
    *,
    today: date | None = None,
    keep_days: int = 0,
) -> dict[str, DataFrame]:
    """Totals and the most recent days of the stored statistics."""
    rows = daily.read_daily(spark, table).withColumn("date", F.col("date").cast("date"))
    if keep_days:
        rows = daily.retained(rows, today or date.today(), keep_days)
    return {
        "totals": daily.rollup(rows, start, end),
        "recent_days": daily.recent_days(rows),
    }

