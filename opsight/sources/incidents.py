"""Archived incident documents, described by their file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight import fixed


def read_incident_paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths only: the content column is never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.xml")
        .load(path)
        .select("path")
    )


def incident_index(paths: DataFrame) -> DataFrame:
    """``job_id, kind, path`` of every archived document; job ids in lower case."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return paths.withColumn("name", name).where(
        F.col("name").rlike(fixed.INCIDENT_NAME)
    ).select(
        F.lower(F.regexp_extract("name", fixed.INCIDENT_NAME, 2)).alias("job_id"),
        F.regexp_extract("name", fixed.INCIDENT_NAME, 1).alias("kind"),
        "path",
    )
