"""Queue pressure, node capacity, memory use and the red alert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions import units


def queue_pressure(
    jobs: DataFrame, long_running_seconds: float, pending_critical: int
) -> DataFrame:
    """Running, pending and long-running jobs of each snapshot."""
    running = F.col("state") == "RUNNING"
    return (
        jobs.groupBy("snapshot_ts")
        .agg(
            F.count_if(running).alias("running"),
            F.count_if(F.col("state") == "PENDING").alias("pending"),
            F.count_if(
                running & (F.col("elapsed_seconds") >= long_running_seconds)
            ).alias("long_running"),
        )
        .withColumn("total", F.col("running") + F.col("pending"))
        .withColumn("is_critical", F.col("pending") >= pending_critical)
    )


def queue_memory_usage(jobs: DataFrame, usage: DataFrame) -> DataFrame:
    """Peak memory of each job's batch step against its limit."""
    peaks = usage.groupBy(
        "snapshot_ts", F.regexp_replace("step_id", r"\.batch$", "").alias("job_id")
    ).agg(F.max(units.memory_bytes("max_rss")).alias("used_bytes"))
    return (
        jobs.withColumn("limit_bytes", units.memory_bytes("memory_limit"))
        .join(peaks, ["snapshot_ts", "job_id"], "left")
        .withColumn(
            "used_percent",
            F.round(units.percent_of(F.col("used_bytes"), F.col("limit_bytes")), 0),
        )
    )


def capacity_issues(nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Nodes that cannot take work; a snapshot without any node is an issue too.

    Malformed rows (``problem`` set by the reader) are no nodes.
    """
    if "problem" in nodes.columns:
        nodes = nodes.where("problem is null")
    usable = F.coalesce(
        units.is_usable_node("partition_state", "node_state"), F.lit(False)
    )
    broken = nodes.where(~usable).select(
        "snapshot_ts",
        "node",
        F.concat(
            F.lit("node="),
            F.col("node"),
            F.lit(" partition_state="),
            F.col("partition_state"),
            F.lit(" node_state="),
            F.col("node_state"),
            F.lit(" reason="),
            F.coalesce(F.nullif("reason", F.lit("")), F.lit("none")),
        ).alias("issue"),
    )
    silent = (
        snapshots.select("snapshot_ts")
        .distinct()
        .join(nodes.select("snapshot_ts").distinct(), "snapshot_ts", "left_anti")
        .select(
            "snapshot_ts",
            F.lit(None).cast("string").alias("node"),
            F.lit("reason=no-capacity-records").alias("issue"),
        )
    )
    return broken.unionByName(silent)


def queue_alert(
    pressure: DataFrame, issues: DataFrame, pending_critical: int
) -> DataFrame:
    """Alert state of each snapshot: capacity first, then a full queue, else clear.

    The alert carries all issues of its snapshot, by node; there are at most as many
    as the cluster has nodes.
    """
    by_node = F.array_sort(F.collect_list(F.struct("node", "issue")))
    counted = issues.groupBy("snapshot_ts").agg(
        F.count(F.lit(1)).alias("issues"),
        F.array_join(F.transform(by_node, lambda row: row["issue"]), "; ").alias("detail"),
    )
    joined = pressure.select("snapshot_ts", "pending", "is_critical").join(
        counted, "snapshot_ts", "full"
    )
    no_capacity = F.coalesce("issues", F.lit(0)) > 0
    full = F.coalesce("is_critical", F.lit(False))
    only_full = ~no_capacity & full
    return joined.select(
        "snapshot_ts",
        F.when(no_capacity | full, "red").otherwise("clear").alias("status"),
        F.when(no_capacity, "slurm-capacity-unavailable")
        .when(full, "pending-queue-full")
        .alias("reason"),
        F.when(only_full, F.col("pending")).alias("pending"),
        F.when(only_full, F.lit(pending_critical)).alias("threshold"),
        F.coalesce("issues", F.lit(0)).alias("issues"),
        "detail",
    )
