from datetime import datetime, timedelta, timezone

import pytest

from opsight.params import (
    Thresholds,
    TimeRange,
    parse_time,
    parse_time_range,
    parse_window,
)

UTC = timezone.utc


@pytest.mark.parametrize(
    "text, first, last",
    [
        ("2025", datetime(2025, 1, 1), datetime(2025, 12, 31, 23, 59, 59, 999999)),
        ("2024-02", datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59, 999999)),
        ("2024-12", datetime(2024, 12, 1), datetime(2024, 12, 31, 23, 59, 59, 999999)),
        ("2026-08-12", datetime(2026, 8, 12), datetime(2026, 8, 12, 23, 59, 59, 999999)),
    ],
)
def test_single_range_values_cover_the_whole_period(text, first, last):
    period = parse_time_range(text)
    assert period == TimeRange(first.replace(tzinfo=UTC), last.replace(tzinfo=UTC))


def test_open_and_mixed_ranges():
    assert parse_time_range("2025/").end is None
    assert parse_time_range("/2025").start is None
    mixed = parse_time_range("2025-03/2025-04-15T12:00:00+02:00")
    assert mixed.end == datetime(2025, 4, 15, 10, tzinfo=UTC)
    assert parse_time_range("2026-08-12", "Europe/Berlin").start == datetime(
        2026, 8, 11, 22, tzinfo=UTC
    )


@pytest.mark.parametrize("text", ["soon", "2025/2024", "a/b/c", "2025-13", "2025-01-01T10:00"])
def test_bad_ranges_are_refused(text):
    with pytest.raises(ValueError):
        parse_time_range(text)


def test_relative_days():
    now = datetime(2026, 8, 20, 1, tzinfo=UTC)
    assert parse_time("yesterday", now=now) == datetime(2026, 8, 19, tzinfo=UTC)
    assert parse_time("TODAY", end=True, now=now) == datetime(
        2026, 8, 20, 23, 59, 59, 999999, tzinfo=UTC
    )
    new_york = parse_time("today", now=now, tz="America/New_York")
    assert new_york == datetime(2026, 8, 19, 4, tzinfo=UTC)


def test_windows():
    assert parse_window("30m") == timedelta(minutes=30)
    assert parse_window("24h") == timedelta(hours=24)
    assert parse_window("7d") == timedelta(days=7)
    with pytest.raises(ValueError):
        parse_window("0h")


@pytest.mark.parametrize(
    "changes",
    [
        {"long_running_minutes": 95},
        {"accepted_stale_hours": 1},
        {"status_window_hours": 2},
        {"min_poll_span_minutes": 190},
        {"recovery_limit": 0},
        {"database_stale_minutes": -1},
    ],
)
def test_thresholds_are_checked_against_each_other(changes):
    with pytest.raises(ValueError):
        Thresholds(**changes)
