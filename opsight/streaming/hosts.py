"""Streams of host metrics and queue snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsight.operators import queue
from opsight.operators.metrics import SERIES
from opsight.streaming import tables


def metric_windows(
    metrics: DataFrame,
    length: str = "1 hour",
    slide: str | None = None,
    late: str = "2 hours",
) -> DataFrame:
    """Minimum, maximum and count per series and half-open window."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        tables.watermarked(metrics, "ts", late)
        .groupBy(*SERIES, window.alias("window"))
        .agg(
            F.count("value").alias("count"),
            F.round(F.min("value"), 2).alias("minimum"),
            F.round(F.max("value"), 2).alias("maximum"),
        )
        .select(
            *SERIES,
            F.col("window.start").alias("period"),
            "count",
            "minimum",
            "maximum",
        )
    )


def transitions(alerts: DataFrame, initial: str) -> DataFrame:
    """Snapshots whose status differs from the one before.

    Each day is compared inside itself; its first snapshot is compared with the last
    one of the day before, by one row per day.
    """
    dated = alerts.withColumn("day", F.to_date("snapshot_ts"))
    inside = F.lag("status").over(Window.partitionBy("day").orderBy("snapshot_ts"))
    days = dated.groupBy("day").agg(
        F.max_by("status", "snapshot_ts").alias("last_status")
    )
    carried = days.select(
        "day",
        F.lag("last_status", 1, initial).over(Window.orderBy("day")).alias("carried"),
    )
    return (
        dated.withColumn("inside", inside)
        .join(carried, "day")
        .where(F.col("status") != F.coalesce("inside", "carried"))
        .select(*alerts.columns)
    )


def alert_transitions(
    jobs: DataFrame,
    capacity: DataFrame,
    path: str,
    checkpoint: str,
    *,
    long_running_seconds: float,
    pending_critical: int,
    late: str = "10 minutes",
    initial: str = "clear",
    **trigger,
) -> StreamingQuery:
    """Store a row whenever the alert state differs from the snapshot before.

    ``jobs`` is a stream of queue rows; the rows of a snapshot may come in several
    batches, up to ``late`` after rows of newer ones. Its pressure is kept in state and
    judged once, when the watermark has passed it. ``capacity`` is the table of node
    rows. The last status goes along as one row for each batch, beside ``path``; a batch
    that is run again replaces its rows and its status.
    """
    status_path = f"{path.rstrip('/')}-status"

    def store(batch: DataFrame, batch_id: int) -> None:
        # One row for each closed snapshot; the state behind it is gone through once.
        held = batch.persist()
        try:
            store_held(held, batch_id)
        finally:
            held.unpersist()

    def store_held(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        snapshots = batch.select("snapshot_ts")
        nodes = capacity.join(snapshots, "snapshot_ts", "left_semi")
        alerts = queue.queue_alert(
            batch, queue.capacity_issues(nodes, snapshots), pending_critical
        )
        before = _last_status(spark, status_path, batch_id) or initial
        tables.write_batch(transitions(alerts, before), path, batch_id)
        last = alerts.agg(F.max_by("status", "snapshot_ts").alias("status"))
        tables.write_batch(
            last.select(F.coalesce("status", F.lit(before)).alias("status")), status_path, batch_id
        )

    closed = queue.queue_pressure(
        tables.watermarked(jobs, "snapshot_ts", late), long_running_seconds, pending_critical
    )
    return tables.run(closed, store, checkpoint, **trigger)


def _last_status(spark: SparkSession, path: str, batch_id: int) -> str | None:
    """The status after the batch before this one; only that folder is opened."""
    folder = f"{path}/{tables.BATCH}={batch_id - 1}"
    if batch_id == 0 or not tables.has_rows(spark, folder):
        return None
    row = spark.read.schema("status string").parquet(folder).first()
    return None if row is None else row["status"]
