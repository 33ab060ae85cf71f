"""Parameters of the reports: thresholds, status codes, time ranges and windows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

UTC = timezone.utc
DAY_END = timedelta(days=1) - timedelta(microseconds=1)


@dataclass(frozen=True)
class StatusCodes:
    """Numeric status codes of the job table; they differ between writers."""

    accepted: int = 1
    started: int = 2
    paused: int = 3
    succeeded: int = 4
    failed: int = 5
    dismissed: int | None = None

    @property
    def active(self) -> list[int]:
        return [self.accepted, self.started, self.paused]


@dataclass(frozen=True)
class Thresholds:
    """Ages and limits of the stalled-job findings, checked when created."""

    xml_stale_minutes: float = 95
    database_stale_minutes: float = 95
    accepted_stale_hours: float = 24
    long_running_minutes: float = 10
    status_window_hours: float = 24
    poll_window_minutes: float = 190
    min_poll_count: int = 3
    min_poll_span_minutes: float = 100
    recovery_limit: int = 100
    polling_recovery_limit: int = 20

    def __post_init__(self) -> None:
        rules = {
            "stale ages must be positive": min(
                self.xml_stale_minutes,
                self.database_stale_minutes,
                self.accepted_stale_hours,
                self.long_running_minutes,
            )
            > 0,
            "accepted jobs need a longer stale age than started jobs": (
                self.accepted_stale_hours * 60 > self.database_stale_minutes
            ),
            "the long-running age must be shorter than both stale ages": (
                self.long_running_minutes
                < min(self.xml_stale_minutes, self.database_stale_minutes)
            ),
            "the status window must be between 3 and 24 hours": (
                3 <= self.status_window_hours <= 24
            ),
            "the poll window and count must be positive": (
                self.poll_window_minutes > 0 and self.min_poll_count > 0
            ),
            "the poll span must fit inside the poll window": (
                0 <= self.min_poll_span_minutes < self.poll_window_minutes
            ),
            "recovery limits must be positive": (
                min(self.recovery_limit, self.polling_recovery_limit) > 0
            ),
        }
        broken = [text for text, holds in rules.items() if not holds]
        if broken:
            raise ValueError("; ".join(broken))


@dataclass(frozen=True)
class TimeRange:
    """Inclusive range of UTC instants; an open end is ``None``."""

    start: datetime | None = None
    end: datetime | None = None

    def __post_init__(self) -> None:
        if self.start and self.end and self.start > self.end:
            raise ValueError("the start of a time range must not be after its end")


def _to_utc(value: datetime, tz: str) -> datetime:
    if value.tzinfo is None:
        value = value.replace(tzinfo=ZoneInfo(tz))
    return value.astimezone(UTC)


def _calendar_span(text: str) -> tuple[datetime, datetime] | None:
    """First and last microsecond of a bare year, month or date."""
    parts = [int(part) for part in text.split("-")]
    first = datetime(*(parts + [1, 1])[:3])
    if len(parts) == 1:
        following = datetime(parts[0] + 1, 1, 1) if parts[0] < 9999 else datetime.max
    elif len(parts) == 2:
        following = (first + timedelta(days=31)).replace(day=1)
    else:
        following = first + timedelta(days=1)
    return first, following - timedelta(microseconds=1)


CALENDAR_TEXT = re.compile(r"[0-9]{4}(-[0-9]{2}){0,2}")


def parse_endpoint(text: str, *, is_end: bool, tz: str = "UTC") -> datetime:
    """One end of a range: a year, month or date (whole period) or an ISO instant."""
    text = text.strip()
    try:
        if CALENDAR_TEXT.fullmatch(text):
            return _to_utc(_calendar_span(text)[1 if is_end else 0], tz)
        return _to_utc(datetime.fromisoformat(text), tz)
    except (ValueError, OverflowError) as error:
        raise ValueError(f"not an ISO time: {text!r}") from error


def parse_time_range(text: str, tz: str = "UTC") -> TimeRange:
    """``YEAR``, ``YEAR-MM``, ``DATE`` or ``START/END`` with either end left open."""
    first, slash, last = text.strip().partition("/")
    if not slash:
        if not CALENDAR_TEXT.fullmatch(first):
            raise ValueError("a single range value is a year, a month or a date")
        last = first
    elif "/" in last:
        raise ValueError("a time range has at most one '/'")
    return TimeRange(
        parse_endpoint(first, is_end=False, tz=tz) if first.strip() else None,
        parse_endpoint(last, is_end=True, tz=tz) if last.strip() else None,
    )


def parse_time(
    text: str, *, end: bool = False, now: datetime | None = None, tz: str = "UTC"
) -> datetime:
    """ISO date or instant, or ``today`` / ``yesterday`` relative to ``now``."""
    days_back = {"today": 0, "yesterday": 1}.get(text.strip().lower())
    if days_back is None:
        text = text.strip()
        if len(text) == 10:
            return parse_endpoint(text, is_end=end, tz=tz)
        return _to_utc(datetime.fromisoformat(text), tz)
    local = (now or datetime.now(UTC)).astimezone(ZoneInfo(tz))
    midnight = datetime(local.year, local.month, local.day) - timedelta(days=days_back)
    return _to_utc(midnight + (DAY_END if end else timedelta()), tz)


def parse_window(text: str) -> timedelta:
    """A moving window: a positive count of minutes, hours or days, as ``30m``."""
    match = re.fullmatch(r"([1-9][0-9]*)([mhd])", text.strip().lower())
    if match is None:
        raise ValueError("a window is a positive number followed by m, h or d")
    unit = {"m": "minutes", "h": "hours", "d": "days"}[match[2]]
    return timedelta(**{unit: int(match[1])})
