"""Streams of request and operation events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from opsight.operators import daily
from opsight.operators.dedup import dedup_by_content
from opsight.session import scratch_path
from opsight.sources import status_xml
from opsight.streaming import tables

RETENTION_DAYS = 42


def ingest(
    requests: DataFrame, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Append finished requests; the checkpoint remembers the documents read."""
    writer = (
        requests.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    with tables.state_settings(requests.sparkSession):
        return writer.start()


def ingest_documents(
    documents: DataFrame,
    service: str,
    requests_path: str,
    rejects_path: str,
    checkpoint: str,
    limits: status_xml.ValueLimits = status_xml.WHOLE,
    **trigger,
) -> StreamingQuery:
    """Store the requests of finished documents, and the documents that can't be read.

    A batch is parsed once into a table of its own and split from there. Both targets
    keep one folder for each batch, so a batch that is run again replaces its rows.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        parsed = status_xml.parse_status(batch)
        needed = parsed.where("reject is not null or final_state is not null")
        path = scratch_path(spark, "parsed-documents")
        needed.write.parquet(path)
        held = spark.read.schema(needed.schema).parquet(path)
        found = status_xml.status_requests(held, service, limits=limits)
        tables.write_batch(found, requests_path, batch_id)
        tables.write_batch(status_xml.rejected_documents(held), rejects_path, batch_id)
        tables.delete(spark, path)

    return tables.run(documents, store, checkpoint, **trigger)


def deduplicated(requests: DataFrame, keep: str = f"{RETENTION_DAYS} days") -> DataFrame:
    """One event per service and job while its copies may still arrive.

    State is kept per job for the time logs are retained and dropped by the watermark.
    """
    return tables.watermarked(requests, "event_time", keep).dropDuplicatesWithinWatermark(
        ["service", "job_id"]
    )


EVENT_KEYS = ("record_type", "service", "job_id", "recorded_at", "event", "message")


def daily_statistics(
    events: DataFrame,
    detail_path: str,
    daily_path: str,
    checkpoint: str,
    *,
    order: list[str],
    retention_days: int = RETENTION_DAYS,
    **trigger,
) -> StreamingQuery:
    """Keep the daily table up to date as events arrive, late ones included.

    The detail of each retained date lies in one folder that a batch with rows of that
    date writes anew (``detail_path/date=/version=``). A batch opens the dates of its own
    rows, and of the others only the narrow columns that tell a copy of a stored event. The
    days of its rows are worked out again and replaced. Dates that have left the retention
    are removed, and of the versions of a date the present one and the one before stay, from
    which a batch that is run again starts. Events that come when their date is no longer
    retained are stored beside it (``detail_path-late``); older days stay as they are.
    """
    root = detail_path.rstrip("/")

    def store(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        working = scratch_path(spark, "dated-events")
        dated = batch.where("event_time is not null").withColumn("date", F.to_date("event_time"))
        dated.transform(dedup_by_content, order).write.parquet(working)
        rows = spark.read.schema(dated.schema).parquet(working)
        versions = tables.versions(spark, root, before=batch_id)
        newest = max([*versions, *(row["date"] for row in rows.agg(F.max("date").alias("date")).collect() if row["date"])], default=None)
        if newest is not None:
            first = newest - timedelta(days=retention_days - 1)
            late = F.col("date") < F.lit(first)
            tables.write_batch(rows.where(late), f"{root}-late", batch_id)
            retained = {day: path for day, path in versions.items() if day >= first}
            fresh = _stored_beside(rows.where(~late), retained, working)
            days = [row["date"] for row in fresh.select("date").distinct().collect()]
            if days:
                whole = fresh.unionByName(_of_dates(fresh, retained, days))
                (
                    whole.withColumn(tables.VERSION, F.lit(batch_id))
                    .repartition("date")
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy("date", tables.VERSION)
                    .parquet(root)
                )
                present = tables.versions(spark, root, before=batch_id + 1)
                affected = _of_dates(fresh, present, days)
                daily.write_daily(daily.daily_statistics(affected.drop("date")), daily_path)
            tables.remove_versions(spark, root, first, keep=versions, batch_id=batch_id)
        tables.delete(spark, working)
        tables.delete(spark, f"{working}-fresh")

    return tables.run(events, store, checkpoint, **trigger)


def _of_dates(like: DataFrame, paths: dict, days: list) -> DataFrame:
    """The stored rows of some dates, with the columns of ``like``."""
    spark = like.sparkSession
    chosen = [paths[day] for day in days if day in paths]
    if not chosen:
        return like.where("false")
    schema = StructType([field for field in like.schema if field.name != "date"])
    stored = spark.read.schema(schema).parquet(*chosen)
    return stored.withColumn("date", F.to_date("event_time")).select(*like.columns)


def _stored_beside(rows: DataFrame, paths: dict, working: str) -> DataFrame:
    """The rows that no stored date has a copy of, as a working table."""
    fresh = _without_known(rows, _of_dates(rows, paths, list(paths)))
    fresh.write.parquet(f"{working}-fresh")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{working}-fresh")


def _without_known(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """Leave out requests of a stored job and operations with stored content."""
    request = (F.col("record_type") == "request") & (
        F.coalesce(F.col("job_id"), F.lit("")) != ""
    )
    names = [name for name in EVENT_KEYS if name in rows.columns]
    content = F.to_json(
        F.when(
            request, F.struct("record_type", "service", "job_id", *_nulls(names[3:]))
        ).otherwise(
            F.struct(
                "record_type",
                F.lit(None).cast("string").alias("service"),
                "job_id",
                *[F.col(name).cast("string").alias(name) for name in names[3:]],
            )
        )
    )
    known = earlier.select(content.alias("__key")).distinct()
    return (
        rows.withColumn("__key", content)
        .join(known, "__key", "left_anti")
        .drop("__key")
    )


def _nulls(names: list[str]) -> list:
    return [F.lit(None).cast("string").alias(name) for name in names]
