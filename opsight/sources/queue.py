"""Captured queue, capacity and step-usage snapshots, pipe-delimited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.functions import units

QUEUE_FIELDS = ("job_id", "state", "elapsed")
QUEUE_DETAIL_FIELDS = (
    "job_id",
    "partition",
    "state",
    "elapsed",
    "time_limit",
    "memory_limit",
)
CAPACITY_FIELDS = ("node", "partition_state", "node_state", "reason")
USAGE_FIELDS = ("step_id", "max_rss")


def read_snapshot_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with the snapshot instant taken from their file's modification time."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_modification_time").alias("snapshot_ts"), "value"
    )


def split_fields(lines: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Trimmed fields by name, and the field count to check against."""
    parts = F.transform(F.split("value", r"\|"), lambda part: F.trim(part))
    return (
        lines.where(F.trim("value") != "")
        .withColumn("parts", parts)
        .select(
            "snapshot_ts",
            "value",
            F.size("parts").alias("field_count"),
            *[F.get("parts", F.lit(at)).alias(name) for at, name in enumerate(names)],
        )
    )


def _all_present(names: tuple[str, ...]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & (F.coalesce(F.col(name), F.lit("")) != "")
    return condition


def queue_jobs(lines: DataFrame) -> DataFrame:
    """Queue rows with ``elapsed_seconds`` and the ``problem`` of malformed ones."""
    elapsed = F.when(F.col("state") == "RUNNING", units.elapsed_seconds("elapsed"))
    return split_fields(lines, QUEUE_FIELDS).select(
        "snapshot_ts",
        *QUEUE_FIELDS,
        elapsed.alias("elapsed_seconds"),
        F.when(
            (F.col("field_count") != len(QUEUE_FIELDS)) | ~_all_present(QUEUE_FIELDS),
            "invalid line",
        )
        .when(~F.col("state").isin("PENDING", "RUNNING"), "unexpected state")
        .when((F.col("state") == "RUNNING") & elapsed.isNull(), "invalid elapsed time")
        .alias("problem"),
    )


def queue_details(lines: DataFrame) -> DataFrame:
    """Rows of the six-field snapshot with seconds, bytes and the ``problem`` of bad ones."""
    state = F.col("state")
    return split_fields(lines, QUEUE_DETAIL_FIELDS).select(
        "snapshot_ts",
        *QUEUE_DETAIL_FIELDS,
        units.elapsed_seconds("elapsed").alias("elapsed_seconds"),
        units.elapsed_seconds("time_limit").alias("time_limit_seconds"),
        units.memory_bytes("memory_limit").alias("memory_limit_bytes"),
        F.when(
            (F.col("field_count") != len(QUEUE_DETAIL_FIELDS)) | state.isNull(),
            "invalid line",
        ).alias("problem"),
    )


def capacity(lines: DataFrame) -> DataFrame:
    """Node capacity rows and the ``problem`` of malformed ones."""
    return split_fields(lines, CAPACITY_FIELDS).select(
        "snapshot_ts",
        *CAPACITY_FIELDS,
        F.when(
            (F.col("field_count") != len(CAPACITY_FIELDS))
            | ~_all_present(CAPACITY_FIELDS[:3]),
            "invalid line",
        ).alias("problem"),
    )


def step_usage(lines: DataFrame) -> DataFrame:
    """Peak memory per batch step."""
    return (
        split_fields(lines, USAGE_FIELDS)
        .where((F.col("field_count") >= 2) & F.col("step_id").endswith(".batch"))
        .select("snapshot_ts", *USAGE_FIELDS)
    )
