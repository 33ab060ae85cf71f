"""Exact order statistics without gathering a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.session import scratch_path

BUCKETS_PER_E_FOLD = 256
#: Cells with more distinct values than this are cut into slices before they are sorted.
MOST_SORTED_VALUES = 10_000
SLICES = 4096
RANKS = ("rank_low", "rank_high", "rank_p95")


def _bucket(value: Column) -> Column:
    """Non-decreasing in ``value``; the values of a bucket differ by less than 0.4 percent.

    Never null, so that joining on it adds no filter below the shared shuffle.
    """
    size = F.least(F.log(F.nullif(F.abs(value), F.lit(0.0))), F.lit(800.0))
    scaled = F.signum(value) * (F.floor(size * BUCKETS_PER_E_FOLD) + 1_000_000)
    return F.coalesce(scaled.cast("bigint"), F.lit(0))


def p95_nearest(count: Column) -> Column:
    """Zero-based index ``round_half_even(0.95 * (n - 1))``."""
    return F.bround((count - 1) * F.lit(0.95)).cast("bigint")


def p95_ceiling(count: Column) -> Column:
    """Zero-based index ``ceil(0.95 * n) - 1``."""
    return F.greatest(F.lit(0), F.ceil(count * F.lit(0.95)) - 1).cast("bigint")


P95_RULES = {"nearest": p95_nearest, "ceiling": p95_ceiling}


def order_statistics(
    rows: DataFrame,
    keys: list[str],
    value: str,
    *,
    p95: str = "nearest",
    weight: str | None = None,
) -> DataFrame:
    """Exact count, minimum, maximum, total, median and p95 of ``value`` per key.

    Keys must not be null. Equal values are counted first, into a working table of distinct
    values. Their counts per bucket locate the cells that hold the wanted ranks, at most
    three per key. A cell with too many distinct values is cut into slices between its own
    least and greatest value, and again only the slice with the rank goes on, until the cells
    are small enough to be put in order. The values of a bucket are so close together that
    a double has no room for more than a few rounds. No task sorts a whole group or bucket.
    """
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    present = F.col(value).isNotNull() & ~F.isnan(value)
    for key in keys:
        present = present & F.col(key).isNotNull()
    measured = _stored(
        rows.where(present)
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(count.alias("c"))
        .withColumn("cell", _bucket(F.col("v")))
    )
    wanted = _stored(_wanted_buckets(measured, keys, p95))
    while (wanted.agg(F.max("values")).first()[0] or 0) > MOST_SORTED_VALUES:
        measured = _stored(_sliced(measured, wanted, keys))
        wanted = _stored(_wanted_slices(measured, wanted, keys))
    in_cell = Window.partitionBy(*keys, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = measured.join(wanted.drop("values", "low", "high"), [*keys, "cell"]).withColumn(
        "before", F.col("before") + F.coalesce(F.sum("c").over(in_cell), F.lit(0))
    )

    def at(rank: str) -> Column:
        return F.max(F.when(_holds(rank, "c"), F.col("v")))

    result = placed.groupBy(*keys).agg(
        F.max("n").alias("count"),
        F.max("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
        F.max("total").alias("total"),
        ((at("rank_low") + at("rank_high")) / 2).alias("median"),
        at("rank_p95").alias("p95"),
    )
    return result if keys else result.where(F.col("count").isNotNull())


def _stored(rows: DataFrame) -> DataFrame:
    """A working table: it is read several times, and cuts the lineage of the rounds."""
    path = scratch_path(rows.sparkSession, "order-statistics")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _holds(rank: str, width: str) -> Column:
    return (F.col(rank) >= F.col("before")) & (F.col(rank) < F.col("before") + F.col(width))


def _holding_a_rank(cells: DataFrame) -> DataFrame:
    condition = _holds(RANKS[0], "held")
    for rank in RANKS[1:]:
        condition = condition | _holds(rank, "held")
    return cells.where(condition)


def _cell_facts() -> list[Column]:
    return [
        F.sum("c").alias("held"),
        F.count(F.lit(1)).alias("values"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
    ]


def _wanted_buckets(measured: DataFrame, keys: list[str], p95: str) -> DataFrame:
    """The buckets that hold a wanted rank, with the totals of their key."""
    every = Window.partitionBy(*keys)
    below = every.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        measured.groupBy(*keys, "cell")
        .agg(*_cell_facts(), F.sum(F.col("v") * F.col("c")).alias("amount"))
        .select(
            *keys,
            "cell",
            "held",
            "values",
            "low",
            "high",
            F.coalesce(F.sum("held").over(below), F.lit(0)).alias("before"),
            F.sum("held").over(every).alias("n"),
            F.min("low").over(every).alias("minimum"),
            F.max("high").over(every).alias("maximum"),
            F.sum("amount").over(every).alias("total"),
        )
    )
    ranks = {
        "rank_low": F.floor((F.col("n") - 1) / 2).cast("bigint"),
        "rank_high": F.floor(F.col("n") / 2).cast("bigint"),
        "rank_p95": P95_RULES[p95](F.col("n")),
    }
    return _holding_a_rank(totals.withColumns(ranks)).drop("held")


def _sliced(measured: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The values of the wanted cells; ``parent`` is their cell, ``cell`` its slice."""
    found = measured.join(wanted.select(*keys, "cell", "values", "low", "high"), [*keys, "cell"])
    # Halves keep the width of a cell finite.
    share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    slice_ = F.when(F.col("values") > MOST_SORTED_VALUES, F.floor(share * (SLICES - 1))).otherwise(F.lit(0))
    return found.select(*keys, "v", "c", F.col("cell").alias("parent"), slice_.cast("bigint").alias("slice")).withColumn(
        "cell", F.xxhash64("parent", "slice")
    )


def _wanted_slices(sliced: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The slices that hold a wanted rank, in the form of ``wanted``."""
    below = Window.partitionBy(*keys, "parent").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = sliced.groupBy(*keys, "parent", "slice", "cell").agg(*_cell_facts())
    inside = cells.withColumn("inside", F.coalesce(F.sum("held").over(below), F.lit(0)))
    parents = wanted.drop("values", "low", "high").withColumnRenamed("cell", "parent")
    joined = inside.join(parents, [*keys, "parent"]).withColumn("before", F.col("before") + F.col("inside"))
    return _holding_a_rank(joined).select(*wanted.columns)
