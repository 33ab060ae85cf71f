"""Stored tables whose rows are replaced by key, in one step for their readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The present version of the table; None before the first write."""
    version = _current(spark, path)
    return None if version is None else spark.read.parquet(f"{path.rstrip('/')}/{version}")


def replace_by_key(rows: DataFrame, path: str, keys: list[str], order: list[Column | str]) -> str:
    """Put ``rows`` in the place of all stored rows with their keys, and keep the others.

    The new version is a folder of its own, sorted as a whole by ``order``. It becomes the
    table when the pointer file is renamed over the old one, so a reader sees the rows
    before or after, and a run that fails or is repeated changes nothing else. The version
    that was replaced stays for readers that have begun with it; older ones are removed.
    Keys in ``rows`` that are null replace stored null keys.
    """
    spark = rows.sparkSession
    before = _current(spark, path)
    whole = rows
    if before is not None:
        stored = spark.read.parquet(f"{path.rstrip('/')}/{before}")
        fresh = rows.select(*[F.col(key).alias(f"__{key}") for key in keys]).distinct()
        same = None
        for key in keys:
            equal = F.col(key).eqNullSafe(F.col(f"__{key}"))
            same = equal if same is None else same & equal
        whole = stored.join(fresh, same, "left_anti").unionByName(rows)
    version = f"version-{uuid.uuid4().hex}"
    whole.orderBy(*order).write.parquet(f"{path.rstrip('/')}/{version}")
    _point(spark, path, version)
    _remove_others(spark, path, {version, before})
    return version


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, path: str) -> str | None:
    pointer = f"{path.rstrip('/')}/{POINTER}"
    target, files = _place(spark, pointer)
    if not files.exists(target):
        return None
    return spark.read.text(pointer).first()["value"]


def _point(spark: SparkSession, path: str, version: str) -> None:
    jvm = spark._jvm
    root = path.rstrip("/")
    temporary, files = _place(spark, f"{root}/.{POINTER}-{version}")
    out = files.create(temporary, True)
    out.write(bytearray(version.encode()))
    out.close()
    target, _ = _place(spark, f"{root}/{POINTER}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()
    )
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(temporary), files.makeQualified(target), overwrite)


def _remove_others(spark: SparkSession, path: str, keep: set[str | None]) -> None:
    target, files = _place(spark, path)
    for status in files.listStatus(target):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in keep:
            files.delete(status.getPath(), True)
