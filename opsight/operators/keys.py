"""Keyed row selection that stays balanced when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spark's default for spark.sql.optimizer.windowGroupLimitThreshold.
GROUP_LIMIT_THRESHOLD = 1000
SALTS = 256


def first_by_key(
    rows: DataFrame, keys: list[Column | str], order: list[str]
) -> DataFrame:
    """The first row of each key in ``order``.

    An aggregate rather than a window: every map task sends at most one row per
    key, so a key with a third of all rows costs its reducer one row per task.
    """
    named = [
        (F.col(key) if isinstance(key, str) else key).alias(f"__k{index}")
        for index, key in enumerate(keys)
    ]
    return (
        rows.groupBy(*named)
        .agg(
            F.min_by(
                F.struct(*[F.col(f"`{name}`") for name in rows.columns]),
                F.struct(*order),
            ).alias("__first")
        )
        .select("__first.*")
    )


def top_per_group(
    rows: DataFrame, groups: list[str], order: list[Column], limit: int
) -> DataFrame:
    """At most ``limit`` rows per group with their ``rank``.

    Spark turns the ``row_number() <= limit`` filter into a group limit that also
    runs before the shuffle, so no task receives a whole hot group. It does so up to
    a limit of 1000; above that, groups are first ranked in salted parts, which
    leaves at most ``limit`` rows of each part for the final ranking.
    """
    if limit > GROUP_LIMIT_THRESHOLD:
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
        parts = Window.partitionBy(*groups, "__salt").orderBy(*order)
        rows = (
            rows.withColumn("__salt", salt)
            .withColumn("__place", F.row_number().over(parts))
            .where(F.col("__place") <= limit)
            .drop("__salt", "__place")
        )
    window = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(
        F.col("rank") <= limit
    )
