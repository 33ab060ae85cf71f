"""Host metric summaries: periods, windows, latest values, counters, snapshots."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight import fixed
from opsight.functions import times, units
from opsight.operators.keys import first_by_key
from opsight.params import TimeRange
from opsight.sources import keyed
from opsight.sources import metrics as source

# One series is one column of one metric: files of a plugin have several.
SERIES = ["host", "plugin", "metric", "column"]
# Counter readings are first put in order inside slices of a period.
SLICES_PER_PERIOD = {"day": "hour", "hour": "minute"}


@dataclass(frozen=True)
class Series:
    """A column of a metric, on any host."""

    plugin: str
    metric: str
    column: str

    def is_row(self) -> Column:
        return (
            (F.col("plugin") == self.plugin)
            & (F.col("metric") == self.metric)
            & (F.col("column") == self.column)
        )


LOAD, LOAD_MID, LOAD_LONG = (Series("load", "load", c) for c in source.LOAD.columns)
MEMORY = Series("memory", "memory-used", "value")


def disk_series(plugin: str = "df-root") -> Series:
    return Series(plugin, "percent_bytes-used", "value")


def received_series(plugin: str) -> Series:
    return Series(plugin, "if_octets", "rx")


def between_dates(metrics: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Samples between two instants, both included.

    Where the table has a date, it is tested too: on one that is partitioned by plugin
    and date that prunes folders. A file may name a day of another zone, so the dates
    reach a day further.
    """
    dated = "date" in metrics.columns
    if start is not None:
        if dated:
            metrics = metrics.where(F.col("date") >= F.lit(start.date() - timedelta(days=1)))
        metrics = metrics.where(F.col("ts") >= times.instant(start))
    if end is not None:
        if dated:
            metrics = metrics.where(F.col("date") <= F.lit(end.date() + timedelta(days=1)))
        metrics = metrics.where(F.col("ts") <= times.instant(end))
    return metrics


def select_metrics(metrics: DataFrame, period: TimeRange, plugins: list[str]) -> DataFrame:
    """Samples of some plugins inside ``period``."""
    return between_dates(metrics.where(F.col("plugin").isin(plugins)), period.start, period.end)


def counter_total(metrics: DataFrame, period: str = "day") -> DataFrame:
    """Growth of rising counters per series and period; a fall restarts at zero.

    Readings are whole numbers; fractions are cut off.

    Readings are ordered inside slices of the period, then one row per slice is
    chained to the slice before. A busy host therefore spreads over its slices.
    """
    keys = [*SERIES, "period"]
    place = F.struct("ts", "counter")
    sliced = metrics.withColumn("counter", F.col("value").cast("bigint")).where("counter is not null").select(
        *SERIES,
        F.date_trunc(period, "ts").alias("period"),
        F.date_trunc(SLICES_PER_PERIOD[period], "ts").alias("slice"),
        "ts",
        "counter",
    )

    def growth(previous: Column, current: Column) -> Column:
        return F.when(current < previous, current).otherwise(current - previous)

    in_slice = Window.partitionBy(*keys, "slice").orderBy("ts", "counter")
    slices = (
        sliced.withColumn("previous", F.lag("counter").over(in_slice))
        .groupBy(*keys, "slice")
        .agg(
            F.sum(growth(F.col("previous"), F.col("counter"))).alias("grown"),
            F.min_by("counter", place).alias("first"),
            F.max_by("counter", place).alias("last"),
        )
    )
    across = Window.partitionBy(*keys).orderBy("slice")
    joined = slices.withColumn("before", F.lag("last").over(across))
    return joined.groupBy(*keys).agg(
        (
            F.coalesce(F.sum("grown"), F.lit(0))
            + F.coalesce(F.sum(growth(F.col("before"), F.col("first"))), F.lit(0))
        ).alias("total")
    )


def period_summary(
    metrics: DataFrame,
    period: str = "day",
    *,
    disk_plugin: str = "df-root",
    interface: str = "interface-eth0",
    memory_scale: float = 1 / fixed.GIB,
    counter_scale: float = 1 / fixed.GIB,
) -> DataFrame:
    """One row per host and period; a metric without samples is null."""
    disk, received = disk_series(disk_plugin), received_series(interface)

    def of(series: Series, measure, scale: float) -> Column:
        value = measure(F.when(series.is_row(), F.col("value")))
        return F.round(value * F.lit(scale), 2)

    used = metrics.where(F.col("plugin").isin(LOAD.plugin, MEMORY.plugin, disk.plugin, received.plugin))
    extremes = used.groupBy("host", F.date_trunc(period, "ts").alias("period")).agg(
        of(LOAD, F.min, 1.0).alias("load_min"),
        of(LOAD, F.max, 1.0).alias("load_max"),
        of(disk, F.min, 1.0).alias("disk_min"),
        of(disk, F.max, 1.0).alias("disk_max"),
        of(MEMORY, F.min, memory_scale).alias("memory_min"),
        of(MEMORY, F.max, memory_scale).alias("memory_max"),
    )
    grown = counter_total(metrics.where(received.is_row()), period).select(
        "host", "period", F.round(F.col("total") * counter_scale, 2).alias("received")
    )
    return extremes.join(grown, ["host", "period"], "left")


def summary_lines(summary: DataFrame, period: str = "day", interface: str = "eth0") -> DataFrame:
    """Add ``label`` and ``line``, the text form of a period's summary."""
    label = F.date_format("period", "yyyy-MM-dd" if period == "day" else "yyyy-MM-dd'T'HH:00")

    def text(name: str, unit: str = "") -> Column:
        value = F.col(name).cast("decimal(38,2)").cast("string")
        # At least one digit stands behind the point.
        plain = F.regexp_replace(value, "0$", "")
        return F.coalesce(F.concat(plain, F.lit(unit)), F.lit("NA"))

    gib = " GiB"
    fields = [
        F.concat(F.lit(f"{shown}="), text(name, unit))
        for shown, name, unit in (
            ("load_min", "load_min", ""),
            ("load_max", "load_max", ""),
            ("disk_min", "disk_min", ""),
            ("disk_max", "disk_max", ""),
            ("mem_min", "memory_min", gib),
            ("mem_max", "memory_max", gib),
            (f"{interface}_rx", "received", gib),
        )
    ]
    return summary.withColumn("label", label).withColumn("line", F.concat_ws("  ", "label", *fields))


def store_summary(summary: DataFrame, path: str) -> str:
    """Replace the stored summaries of the same host and period; all stay in order."""
    return keyed.replace_by_key(summary, path, ["host", "period"], ["period", "host"])


def metric_window(metrics: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Count, current value, change, minimum, average and maximum in a window."""
    place = F.struct("ts", "value")
    return between_dates(metrics, start, end).groupBy(*SERIES).agg(
        F.count("value").alias("count"),
        F.max_by("value", place).alias("current"),
        (F.max_by("value", place) - F.min_by("value", place)).alias("change"),
        F.min("value").alias("min"),
        F.avg("value").alias("average"),
        F.max("value").alias("max"),
    )


def _recent_days(now: datetime) -> tuple[datetime, datetime]:
    """From the start of yesterday to the end of today."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return midnight - timedelta(days=1), midnight + timedelta(days=1) - timedelta(microseconds=1)


def metric_latest(metrics: DataFrame, now: datetime) -> DataFrame:
    """Latest sample per series of today, or else of yesterday."""
    return between_dates(metrics, *_recent_days(now)).groupBy(*SERIES).agg(
        F.max("ts").alias("ts"),
        F.max_by("value", F.struct("ts", "value")).alias("value"),
    )


def _freshness(rows: DataFrame, now: datetime, interval_seconds: float) -> DataFrame:
    age = F.greatest(F.lit(0.0), times.seconds_between(times.instant(now), F.col("latest")))
    known = F.when(F.col("latest").isNotNull(), age)
    return rows.withColumn("age_seconds", known).withColumn(
        "fresh", F.col("age_seconds") <= interval_seconds * 2.5
    )


def metric_freshness(latest: DataFrame, now: datetime, interval_seconds: float) -> DataFrame:
    """Age of the older of a host's latest load and memory, and whether it is recent enough."""
    oldest = latest.where(LOAD.is_row() | MEMORY.is_row()).groupBy("host").agg(
        F.min("ts").alias("latest")
    )
    return _freshness(oldest, now, interval_seconds)


def memory_usage(captured: DataFrame, latest: DataFrame) -> DataFrame:
    """Memory and swap use per host from captured totals and the latest sample."""
    sampled = latest.where(MEMORY.is_row()).select("host", F.col("value").alias("sampled"))
    return _memory(captured.join(sampled, "host", "left"))


def _memory(joined: DataFrame) -> DataFrame:
    swap_known = F.col("swap_total").isNotNull() & F.col("swap_free").isNotNull()
    used = joined.withColumns(
        {
            "used": F.coalesce("sampled", F.col("total") - F.col("available")),
            "swap_used": F.when(
                swap_known, F.greatest(F.lit(0), F.col("swap_total") - F.col("swap_free"))
            ),
        }
    )
    return used.select(
        "host",
        "total",
        "used",
        "available",
        units.percent_of(F.col("used"), F.col("total")).alias("percent"),
        "swap_total",
        "swap_used",
        units.percent_of(F.col("swap_used"), F.col("swap_total")).alias("swap_percent"),
        *[name for name in joined.columns if name not in MEMORY_COLUMNS],
    )


MEMORY_COLUMNS = ("host", "total", "available", "swap_total", "swap_free", "sampled")


def filesystem_usage(captured: DataFrame) -> DataFrame:
    """Use per device, named by its first path; every unavailable path is listed."""
    unavailable = F.col("total").isNull()
    own_row = F.when(unavailable, F.col("path"))
    first = first_by_key(
        captured,
        ["host", F.when(~unavailable, F.col("device")), own_row],
        ["position", "path"],
    )
    percent = F.when(
        F.col("total") > 0, F.col("used") * F.lit(100.0) / F.col("total")
    ).otherwise(0.0)
    return first.select(
        "host",
        "path",
        "device",
        "total",
        "used",
        F.when(~F.col("total").isNull(), percent).alias("percent"),
        F.when(F.col("total").isNull(), "unavailable").alias("error"),
    )


def host_samples(
    metrics: DataFrame, now: datetime, window: timedelta, disk_plugin: str = "df-root"
) -> DataFrame:
    """What one aggregate over the recent samples tells of each host.

    The scan is limited to the plugins and dates that any of the values needs.
    """
    first_day, last_day = _recent_days(now)
    disk = disk_series(disk_plugin)
    plugins = [LOAD.plugin, MEMORY.plugin, disk.plugin]
    period = TimeRange(min(first_day, now - window), last_day)
    recent = select_metrics(metrics, period, plugins)
    place, value = F.struct("ts", "value"), F.col("value")
    is_latest = F.col("ts").between(times.instant(first_day), times.instant(last_day))
    is_inside = F.col("ts").between(times.instant(now - window), times.instant(now))

    def latest(series: Series) -> Column:
        return F.max_by("value", F.when(series.is_row() & is_latest, place))

    def latest_at(series: Series) -> Column:
        return F.max(F.when(series.is_row() & is_latest, F.col("ts")))

    def history(series: Series, name: str) -> list[Column]:
        inside = series.is_row() & is_inside
        at, chosen = F.when(inside, place), F.when(inside, value)
        return [
            F.count(chosen).alias(f"{name}_count"),
            F.max_by("value", at).alias(f"{name}_current"),
            (F.max_by("value", at) - F.min_by("value", at)).alias(f"{name}_change"),
            F.min(chosen).alias(f"{name}_min"),
            F.avg(chosen).alias(f"{name}_average"),
            F.max(chosen).alias(f"{name}_max"),
        ]

    return recent.groupBy("host").agg(
        F.least(latest_at(LOAD), latest_at(MEMORY)).alias("latest"),
        latest(LOAD).alias("load"),
        latest(LOAD_MID).alias("load_mid"),
        latest(LOAD_LONG).alias("load_long"),
        latest(MEMORY).alias("sampled"),
        *history(LOAD, "load"),
        *history(MEMORY, "memory"),
        *history(disk, "disk"),
    )


def host_snapshot(
    metrics: DataFrame,
    captured: DataFrame,
    filesystems: DataFrame,
    now: datetime,
    window: timedelta,
    interval_seconds: float,
    disk_plugin: str = "df-root",
) -> DataFrame:
    """One row per host: load, windows, memory, freshness and fullest disk.

    The metrics are scanned once.
    """
    samples = host_samples(metrics, now, window, disk_plugin)
    disks = filesystem_usage(filesystems).groupBy("host").agg(
        F.count(F.lit(1)).alias("filesystems"),
        F.max("percent").alias("fullest_percent"),
    )
    joined = captured.join(samples, "host", "left").join(disks, "host", "left")
    snapshot = _freshness(_memory(joined), now, interval_seconds)
    return snapshot.withColumn("fresh", F.coalesce("fresh", F.lit(False)))
