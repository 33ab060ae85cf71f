"""Tables written by streams so that a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def write_batch(rows: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Store the rows of one batch; a retry of the batch replaces its own rows."""
    placed = rows.hint("rebalance", *partitions) if partitions else rows
    (
        placed.withColumn(BATCH, F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, BATCH)
        .parquet(path)
    )


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a working table that has been read for the last time."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


VERSION = "version"


def _dated_versions(spark: SparkSession, path: str) -> list[tuple[date, int, str]]:
    """Date, version and folder of everything stored in ``path/date=/version=``."""
    found = []
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date=*/{VERSION}=*")
    for status in target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or []:
        folder = status.getPath()
        day = folder.getParent().getName().removeprefix("date=")
        version = int(folder.getName().removeprefix(f"{VERSION}="))
        found.append((date.fromisoformat(day), version, folder.toString()))
    return found


def versions(spark: SparkSession, path: str, before: int) -> dict[date, str]:
    """The folder of each stored date's last version before a batch."""
    last: dict[date, tuple[int, str]] = {}
    for day, version, folder in _dated_versions(spark, path):
        if version < before:
            last[day] = max(last.get(day, (version, folder)), (version, folder))
    return {day: folder for day, (_, folder) in last.items()}


def remove_versions(spark: SparkSession, path: str, first: date, keep: dict[date, str], batch_id: int) -> None:
    """Remove dates before ``first`` and versions that a batch run again wouldn't read."""
    for day, version, folder in _dated_versions(spark, path):
        if day < first or (version < batch_id and keep.get(day) != folder):
            delete(spark, folder)


def earlier_batches(
    spark: SparkSession, path: str, batch_id: int, like: DataFrame
) -> DataFrame:
    """Rows stored before this batch, empty on the first one."""
    if not has_rows(spark, path):
        return like.withColumn(BATCH, F.lit(batch_id)).where("false")
    return spark.read.parquet(path).where(F.col(BATCH) < batch_id)


def upsert_stream(
    changes: DataFrame, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Keep every version an update-mode aggregate emits, one folder per batch."""

    def store(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return run(changes, store, checkpoint, "update", **trigger)


def latest_versions(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last stored version of each key, combined on the map side."""
    stored = spark.read.parquet(path)
    values = [name for name in stored.columns if name not in (*keys, BATCH)]
    return (
        stored.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), BATCH).alias("row"))
        .select(*keys, "row.*")
    )


PARTITIONS = "spark.sql.shuffle.partitions"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
#: Partitions of state for each core.
STATE_PARTITIONS_PER_CORE = 3


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Settings that a query takes along when it starts inside this block.

    Every batch opens and commits the state of each partition, whatever is in it, so there
    are only as many as keep the cores busy; RocksDB commits changes, not its files. A
    checkpoint keeps the number of partitions that it began with.
    """
    before = {PARTITIONS: spark.conf.get(PARTITIONS), CHANGELOG: spark.conf.get(CHANGELOG, None)}
    most = STATE_PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism
    spark.conf.set(PARTITIONS, str(min(int(before[PARTITIONS]), most)))
    spark.conf.set(CHANGELOG, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run(
    stream: DataFrame,
    store: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    **trigger,
) -> StreamingQuery:
    """Start a query that hands its batches to ``store``.

    Without a trigger it works off what is there and stops, as a scheduled job does.
    """
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
        .trigger(**(trigger or {"availableNow": True}))
    )
    with state_settings(stream.sparkSession):
        return writer.start()


def watermarked(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarks need a TIMESTAMP column; stored times may be zone-less."""
    timestamp: Column = F.col(column).cast("timestamp")
    return stream.withColumn(column, timestamp).withWatermark(column, delay)
