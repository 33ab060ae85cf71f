"""Web access logs in combined format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight import fixed
from opsight.functions.derive import computed

PARTS = ("client", "time", "method", "target", "protocol", "status")
PART_GROUPS = [f"${at + 1}" for at in range(len(PARTS))]
PART_MARK = "\u0001"


def read_access_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths)


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Client, instant, method, target and status of the lines that parse.

    One replacement puts the six parts of a line next to each other, so a line is
    matched twice and not once per part.
    """
    joined = F.regexp_replace(
        "value", "(?s)" + fixed.ACCESS_LOG_LINE + ".*$", PART_MARK.join(PART_GROUPS)
    )
    parsed = computed(
        lines.where(F.col("value").rlike(fixed.ACCESS_LOG_LINE)),
        parts=F.split(joined, PART_MARK),
    )
    part = {name: F.get("parts", F.lit(at)) for at, name in enumerate(PARTS)}
    stamp = F.try_to_timestamp(part["time"], F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return (
        computed(parsed, ts=stamp)
        .where("ts is not null")
        .select(
            part["client"].alias("client"),
            "ts",
            part["method"].alias("method"),
            part["target"].alias("target"),
            part["status"].cast("int").alias("status"),
        )
    )
