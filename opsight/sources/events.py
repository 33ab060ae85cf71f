"""Event logs: JSON lines, plain or compressed, current and rotated files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight import fixed
from opsight.functions import text, times
from opsight.functions.derive import computed

FAILURE = "struct<code:string,locator:string,message:string>"
DIAGNOSTIC = "struct<source:string,message:string>"
# Reading order of a record: given path, file, block of the file, line inside the block.
READ_ORDER = ["path_rank", "file_path", "block_start", "line_id"]


def read_event_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Non-blank lines, their parsed value ``v`` and the place they come from.

    Several paths are read in the order they are given in, the files of one by name.
    """
    given = [paths] if isinstance(paths, str) else paths
    parts = [
        spark.read.text(path).select(
            "value",
            F.lit(rank).alias("path_rank"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_id"),
        )
        for rank, path in enumerate(given)
    ]
    lines = reduce(DataFrame.unionByName, parts)
    return parsed_lines(lines.where(F.col("value").rlike(r"\S")))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Add the value ``v`` of each line; null where the line is not JSON."""
    return computed(lines, v=F.try_parse_json("value"))


def is_object() -> Column:
    """Whether the parsed value is an object, whatever blanks stand before it."""
    return F.schema_of_variant("v").startswith("OBJECT")


def event_rejects(lines: DataFrame) -> DataFrame:
    """Lines that are not JSON, or are JSON but not an object."""
    reason = F.when(F.col("v").isNull(), "invalid-json").when(
        ~is_object(), "not-an-object"
    )
    return (
        lines.withColumn("reason", reason).where("reason is not null").drop("v")
    )


def _text(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "string")


def _structs(name: str, kind: str) -> Column:
    """Items of a list that are objects; anything else in the list is skipped."""
    items = F.transform(
        F.try_variant_get("v", f"$.{name}", "array<variant>"),
        lambda item: F.try_variant_get(item, "$", kind),
    )
    return F.coalesce(
        F.filter(items, lambda item: item.isNotNull()),
        F.array().cast(f"array<{kind}>"),
    )


def _every_value(name: str) -> Column:
    """All values of the objects in a list, in the order written, blanks for empty ones.

    Read from the line itself: a parsed value has its members in order of their names.
    """
    items = F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>")
    objects = F.filter(items, lambda item: F.ltrim(item).startswith("{"))
    values = F.transform(
        objects, lambda item: F.map_values(F.from_json(item, "map<string,string>"))
    )
    return F.transform(F.flatten(values), lambda value: F.coalesce(value, F.lit("")))


def parse_events(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    """Typed request and operation events of the valid lines.

    ``tz`` is the zone of event times written without an offset.
    """
    objects = lines.where(F.col("v").isNotNull() & is_object())
    duration = F.try_variant_get("v", "$.duration_seconds", "variant")
    is_number = F.schema_of_variant(duration).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    position = [name for name in READ_ORDER if name in lines.columns]
    return (
        objects.select(
            *position,
            F.coalesce(_text("record_type"), F.lit("request")).alias("record_type"),
            *[
                _text(name).alias(name)
                for name in (
                    "service",
                    "job_id",
                    "process",
                    "outcome",
                    "event",
                    "source",
                    "level",
                    "message",
                    "started_at",
                    "finished_at",
                    "recorded_at",
                    "duration_source",
                )
            ],
            F.try_variant_get("v", "$.schema_version", "int").alias("schema_version"),
            F.when(is_number, F.try_variant_get(duration, "$", "double")).alias(
                "duration_seconds"
            ),
            _structs("failures", FAILURE).alias("failures"),
            _structs("diagnostics", DIAGNOSTIC).alias("diagnostics"),
            F.try_variant_get("v", "$.inputs", "variant").alias("inputs"),
            F.concat_ws(" ", _every_value("failures"), _every_value("diagnostics")).alias("all_values"),
        )
        .transform(with_event_time, tz)
    )


def with_event_time(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Add the instant an event counts for: finished, else recorded."""
    written = F.coalesce(
        F.nullif("finished_at", F.lit("")), F.nullif("recorded_at", F.lit(""))
    )
    events = computed(events, event_text=written)
    return computed(events, event_time=times.iso_instant(F.col("event_text"), tz)).drop(
        "event_text"
    )


def read_events(
    spark: SparkSession, paths: str | list[str], tz: str = "UTC"
) -> DataFrame:
    return parse_events(read_event_lines(spark, paths), tz)


def with_append_defaults(events: DataFrame, now: Column) -> DataFrame:
    """Fill the schema version and recording time an event was written without."""
    return events.withColumns(
        {
            "schema_version": F.coalesce(
                F.col("schema_version"), F.lit(fixed.SCHEMA_VERSION)
            ),
            "recorded_at": F.coalesce(
                F.col("recorded_at"), F.concat(times.iso_text(now), F.lit("+00:00"))
            ),
        }
    )


def append_events(events: DataFrame, path: str, now: Column) -> None:
    """Append events with their defaults to the table by service and ``date``.

    The rebalance hint lets Spark size the files: small partitions are joined and a
    service with most of the events is split.
    """
    (
        with_append_defaults(events, now)
        .hint("rebalance", "service", "date")
        .write.mode("append")
        .partitionBy("service", "date")
        .parquet(path)
    )


def log_events(messages: DataFrame, source: str = "job-control") -> DataFrame:
    """Operation events from log messages (``message, level, service, recorded_at``).

    Below warning level only recovery actions are kept.
    """
    kept = F.col("level").isin("warning", "error", "critical") | (
        text.log_field("message", "action") == "recovered"
    )
    return messages.where(kept).select(
        F.lit("operation").alias("record_type"),
        text.event_name("message", F.col("level")).alias("event"),
        "service",
        F.lit(source).alias("source"),
        "level",
        "message",
        text.log_fields("message").alias("fields"),
        text.log_field("message", "job").alias("job_id"),
        "recorded_at",
    )
