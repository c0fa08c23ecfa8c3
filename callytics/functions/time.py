"""Time helpers. All operators run with the session time zone set to UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# Default zone and the formats of rendered dates and times.
DEFAULT_ZONE = "America/Los_Angeles"
DATE_FORMAT = "yyyy-MM-dd"
TIME_FORMAT = "HH:mm:ss"

Instant = datetime | str


def as_utc(value: Instant) -> datetime:
    """A datetime or ISO text as an aware UTC datetime; without offset it is UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def instant(value: Instant | Column) -> Column:
    """A timestamp literal that does not depend on the Python or session zone."""
    if isinstance(value, Column):
        return value
    text = as_utc(value).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return F.lit(text).cast("timestamp")


def check_range(start: Instant, end: Instant, max_days: int | None = None) -> None:
    """Refuse an empty or overlong range before any plan is built."""
    first, last = as_utc(start), as_utc(end)
    if first >= last:
        raise ValueError("invalid_range: start must be before end")
    if max_days is not None and last - first > timedelta(days=max_days):
        raise ValueError(f"invalid_range: longer than {max_days} days")


def local_date(ts: Column, zone: str = DEFAULT_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), DATE_FORMAT)


def local_time(ts: Column, zone: str = DEFAULT_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), TIME_FORMAT)


def ms_to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def whole_minutes(micros: Column) -> Column:
    """Microseconds to minutes, halves rounded away from zero, in exact integers."""
    minute = F.lit(60_000_000)
    return F.call_function("div", F.abs(micros) + F.lit(30_000_000), minute) * F.signum(micros).cast("long")
