"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

# Session settings the transforms rely on: instants are UTC everywhere, AQE sizes
# and splits shuffles, dynamic overwrite replaces only the partitions written.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(
    app_name: str = "opsight", master: str | None = None, **settings: str
) -> SparkSession:
    """Create a session; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required runtime settings to a session made elsewhere."""
    for key, value in REQUIRED_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local master falls back to a folder of its own: a cluster without the
    setting must not write to one machine's disk.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    existing = spark.conf.get("opsight.local.dir", None)
    if existing is None:
        existing = tempfile.mkdtemp(prefix="opsight-")
        spark.conf.set("opsight.local.dir", existing)
    return existing


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder for one table or stream checkpoint."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
