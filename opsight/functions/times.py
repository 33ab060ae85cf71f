"""Time columns: instants from text, identifiers and unknown wall clocks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsight import fixed

# Extended and compact ISO dates, with an optional time and an optional zone.
ISO_SHAPE = (
    r"^(?:\d{4}-\d{2}-\d{2}|\d{8})"
    r"(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
# The form nearly all writers use; the engine casts it as it is.
COMMON_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)?$"
)
# Rewrites of the other forms into the common one, applied in this order.
ISO_REWRITES = (
    (r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
    (r"[T ](\d{2}):?(\d{2}):?(\d{2})", "T$1:$2:$3"),
    (r"[T ](\d{2}):?(\d{2})(?=Z|[+-]|$)", "T$1:$2:00"),
    (r"[T ](\d{2})(?=Z|[+-]|$)", "T$1:00:00"),
    (r"[.,](\d{1,6})\d*", ".$1"),
    (r"(T.*[+-]\d{2})$", "$1:00"),
    (r"(T.*[+-]\d{2})(\d{2})$", "$1:$2"),
)


def instant(value: datetime) -> Column:
    """A UTC literal for an aware or naive-UTC Python time."""
    if value.tzinfo is not None:
        text = value.astimezone().isoformat()
    else:
        text = value.isoformat() + "+00:00"
    return F.lit(text).cast("timestamp")


def wall_clock(value: datetime) -> Column:
    """A zone-less UTC literal, so a filter on a raw NTZ column reaches the scan."""
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc)
    return F.lit(value.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")


def iso_instant(text: Column | str, tz: str = "UTC") -> Column:
    """ISO text to a UTC instant; naive text is read in ``tz``, other text is null."""
    text = F.col(text) if isinstance(text, str) else text

    rewritten = text
    for pattern, replacement in ISO_REWRITES:
        rewritten = F.regexp_replace(rewritten, pattern, replacement)
    parsed = F.when(
        text.rlike(COMMON_SHAPE), text.try_cast("timestamp")
    ).when(text.rlike(ISO_SHAPE), rewritten.try_cast("timestamp"))
    if tz == "UTC":
        return parsed
    has_zone = text.rlike(r"[T ].*(?:Z|[+-]\d{2}(?::?\d{2})?)$")
    return F.when(has_zone, parsed).otherwise(F.to_utc_timestamp(parsed, tz))


def iso_text(value: Column | str) -> Column:
    """UTC instant as fixed-width ISO text."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def seconds_between(end: Column, start: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def as_utc(naive: Column | str) -> Column:
    """Read a zone-less value as if it were UTC (session zone is pinned to UTC)."""
    return (F.col(naive) if isinstance(naive, str) else naive).cast("timestamp")


def uuid1_instant(identifier: Column | str) -> Column:
    """Creation instant carried by a version-1 UUID; null for any other text."""
    text = F.col(identifier) if isinstance(identifier, str) else identifier
    ticks = F.conv(
        F.concat(
            F.substring(text, 16, 3), F.substring(text, 10, 4), F.substring(text, 1, 8)
        ),
        16,
        10,
    ).try_cast("bigint")
    micros = F.floor((ticks - F.lit(fixed.UUID_EPOCH_100NS)) / F.lit(10).cast("decimal(20,0)"))
    shape = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-1[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return F.when(text.rlike(shape), F.timestamp_micros(micros.cast("bigint")))


def writer_offset_minutes(
    naive: Column | str,
    created: Column,
    max_offset_hours: int = 14,
    tolerance_seconds: int = 300,
) -> Column:
    """Minutes the writer's clock runs ahead of UTC, inferred from its UUID instant.

    Null when the difference is larger than any zone, or is not near a whole
    minute count, or when the identifier carries no instant.
    """
    difference = seconds_between(as_utc(naive), created)
    minutes = F.bround(difference / 60).cast("int")
    plausible = (F.abs(minutes) <= max_offset_hours * 60) & (
        F.abs(difference - minutes * 60) <= tolerance_seconds
    )
    return F.when(plausible, minutes)


def from_wall_clock(
    naive: Column | str, offset_minutes: Column, local_tz: str = "UTC"
) -> Column:
    """Writer wall clock to UTC: by the inferred offset, else by the local zone."""
    value = as_utc(naive)
    shifted = F.timestamp_micros(
        F.unix_micros(value) - offset_minutes.cast("bigint") * F.lit(60_000_000)
    )
    fallback = value if local_tz == "UTC" else F.to_utc_timestamp(value, local_tz)
    return F.coalesce(shifted, fallback)


def corrected_creation_time(
    labelled: Column, modified: Column, local_tz: str, tolerance_seconds: int = 300
) -> Column:
    """Undo a local wall clock that was labelled UTC, judged by the file time."""
    local = F.to_utc_timestamp(labelled, local_tz)

    def near(value: Column) -> Column:
        return F.abs(seconds_between(value, modified)) <= tolerance_seconds

    return F.when(~near(labelled) & near(local), local).otherwise(labelled)
