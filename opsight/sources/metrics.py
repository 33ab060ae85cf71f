"""Host metrics: CSV files ``HOST/PLUGIN/METRIC-DATE``, plain or compressed."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_COLUMNS = ("host", "plugin", "metric", "date", "ts", "column", "value")
LONG = "host string, plugin string, metric string, date date, ts timestamp, column string, value double"
FILE_NAME = r"(?:([^/]+)/)?([^/]+)/([^/]+)-(\d{4}-\d{2}-\d{2})(?:\.gz)?$"


@dataclass(frozen=True)
class MetricKind:
    """Files with the same columns; ``plugin`` may be a pattern."""

    plugin: str
    metric: str
    columns: tuple[str, ...]


#: The files that summaries and snapshots are made from.
LOAD = MetricKind("load", "load", ("shortterm", "midterm", "longterm"))
MEMORY = MetricKind("memory", "memory-used", ("value",))
DISK = MetricKind("df-*", "percent_bytes-used", ("value",))
INTERFACE = MetricKind("interface-*", "if_octets", ("rx", "tx"))
KINDS = (LOAD, MEMORY, DISK, INTERFACE)


def disk_plugin(mount: str) -> str:
    """The plugin that samples a mount."""
    return "df-root" if mount == "/" else "df-" + mount.strip("/").replace("/", "-")


def read_metric_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str],
    *,
    host: str | None = None,
) -> DataFrame:
    """Metric files of one kind in long form.

    All files under ``path`` must share ``epoch`` plus ``columns``; a file with
    another header fails the read. Blank cells are skipped. Without ``host`` it is the
    name of the folder that holds the plugin's folder.
    """
    schema = T.StructType(
        [T.StructField("epoch", T.DoubleType())]
        + [T.StructField(name, T.DoubleType()) for name in columns]
    )
    wide = spark.read.csv(
        path,
        header=True,
        schema=schema,
        enforceSchema=False,
        recursiveFileLookup=True,
    )
    # The pattern starts anywhere: on the whole path it would be tried from each character,
    # for each row again.
    file_name = F.substring_index(F.col("_metadata.file_path"), "/", -3)
    named = F.regexp_extract(file_name, FILE_NAME, 1) if host is None else F.lit(host)
    return (
        wide.where("epoch is not null")
        .select(
            named.alias("host"),
            F.regexp_extract(file_name, FILE_NAME, 2).alias("plugin"),
            F.regexp_extract(file_name, FILE_NAME, 3).alias("metric"),
            F.regexp_extract(file_name, FILE_NAME, 4).cast("date").alias("date"),
            F.timestamp_micros(F.round(F.col("epoch") * 1e6).cast("bigint")).alias("ts"),
            *columns,
        )
        .unpivot(
            ["host", "plugin", "metric", "date", "ts"], columns, "column", "value"
        )
        .where("value is not null")
    )


def read_metrics(
    spark: SparkSession,
    root: str,
    kinds: tuple[MetricKind, ...] = KINDS,
    dates: list[date] | None = None,
) -> DataFrame:
    """All files of some kinds below ``root`` in long form, of all dates or of some.

    A kind or date without files adds nothing.
    """
    found = []
    for kind in kinds:
        ends = ["????-??-??*"] if dates is None else [f"{day.isoformat()}*" for day in dates]
        patterns = [f"{root.rstrip('/')}/*/{kind.plugin}/{kind.metric}-{end}" for end in ends]
        present = [pattern for pattern in patterns if _matches(spark, pattern)]
        if present:
            found.append(read_metric_csv(spark, present, list(kind.columns)))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], LONG)


def _matches(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Store long-form metrics so that plugin and date ranges prune partitions.

    The rebalance hint gives files of even size, also when one plugin has most rows.
    """
    (
        metrics.hint("rebalance", "plugin", "date")
        .write.mode("append")
        .partitionBy("plugin", "date")
        .parquet(path)
    )
