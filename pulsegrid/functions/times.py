"""Column functions on zone-less timestamps.

Every timestamp in the engine is ``TIMESTAMP_NTZ`` (local wall clock).  The
arithmetic below goes through day-time intervals, so no result depends on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
MINUTE, HOUR, DAY = 60, 3600, 86400

# Fixed pattern: a trailing Z or a +hh:mm / +hhmm offset.
OFFSET_PATTERN = r"(?i)(Z|[+-]\d{2}:?\d{2})$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """``later - earlier`` in seconds (double, microsecond resolution)."""
    gap = (_col(later) - _col(earlier)).cast("interval second")
    return gap.cast("decimal(18,6)").cast("double")


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    return seconds_between(later, earlier) / F.lit(60.0)


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 (bigint), rounded down."""
    gap = (_col(ts) - F.expr(EPOCH)).cast("interval second")
    return F.floor(gap.cast("decimal(18,6)")).cast("bigint")


def from_epoch_seconds(seconds: Column) -> Column:
    return F.expr(EPOCH) + F.expr("interval '1' second") * seconds


def shift(ts: Column | str, seconds: Column | int) -> Column:
    amount = F.lit(seconds) if isinstance(seconds, int) else seconds
    return _col(ts) + F.expr("interval '1' second") * amount


def floor_ts(ts: Column | str, step_seconds: int) -> Column:
    s = epoch_seconds(ts)
    return from_epoch_seconds(s - F.pmod(s, F.lit(step_seconds)))


def ceil_ts(ts: Column | str, step_seconds: int) -> Column:
    down = floor_ts(ts, step_seconds)
    return F.when(down < _col(ts), shift(down, step_seconds)).otherwise(down)


def round_ts(ts: Column | str, step_seconds: int) -> Column:
    """Nearest multiple of the step; a half rounds up."""
    return floor_ts(shift(ts, step_seconds // 2), step_seconds)


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(_col(ts)) * 60 + F.minute(_col(ts))


def parse_local(text: Column | str, zone: str = "UTC") -> Column:
    """Pump rule: an offset is converted to ``zone`` and dropped; a value
    without offset already is local.  Bad text gives null."""
    raw = F.trim(_col(text))
    instant = raw.try_cast("timestamp")
    # from_utc_timestamp expects the UTC wall clock; both casts below use the
    # session zone, so the pair keeps the instant's wall clock in UTC.
    utc_wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_wall)
    return F.when(raw.rlike(OFFSET_PATTERN) & raw.contains(":"), local).otherwise(raw.try_cast("timestamp_ntz"))


def parse_wall(text: Column | str, floor_seconds: int | None = None) -> Column:
    """Wearable rule: drop the offset, keep the wall clock."""
    wall = F.trim(_col(text)).try_cast("timestamp_ntz")
    return wall if floor_seconds is None else floor_ts(wall, floor_seconds)


def iso_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")
