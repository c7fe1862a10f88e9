"""Scalar column functions: dose kernels, calendar, segments, rules, clean-up."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.times import minute_of_day

# ---------------------------------------------------------------- dose kernel


def kernel_constants(duration: float, peak: float = 75.0) -> tuple[float, float, float]:
    """(tau, a, S) of the exponential dose model with a set peak time."""
    if duration <= 2 * peak:
        raise ValueError("duration must exceed twice the peak time")
    tau = peak * (1 - peak / duration) / (1 - 2 * peak / duration)
    a = 2 * tau / duration
    return tau, a, 1 / (1 - a + (1 + a) * math.exp(-duration / tau))


def kernel_activity(t: Column, duration: float = 300.0, peak: float = 75.0) -> Column:
    """Share of a dose acting per minute, ``t`` minutes after it."""
    tau, _, s = kernel_constants(duration, peak)
    return F.lit(s / tau**2) * t * (1 - t / F.lit(float(duration))) * F.exp(-t / F.lit(tau))


def kernel_remaining(t: Column, duration: float = 300.0, peak: float = 75.0) -> Column:
    """Share of a dose still on board, ``t`` minutes after it."""
    tau, a, s = kernel_constants(duration, peak)
    inner = t * t / F.lit(tau * duration * (1 - a)) - t / F.lit(tau) - 1
    return 1 - F.lit(s * (1 - a)) * (inner * F.exp(-t / F.lit(tau)) + 1)


def decay_level(dose: Column, t: Column, duration: float) -> Column:
    """Older variant: plain exponential decay with time constant ``duration / 3``."""
    return dose * F.exp(-t / F.lit(duration / 3.0))


# ------------------------------------------------------------------- calendar


def calendar_columns(ts: str = "ts") -> dict[str, Column]:
    hour = F.hour(ts) + F.minute(ts) / 60.0
    dow = F.weekday(ts)
    return {
        "hour_sin": F.sin(F.lit(2 * math.pi) * hour / 24.0),
        "hour_cos": F.cos(F.lit(2 * math.pi) * hour / 24.0),
        "dow_sin": F.sin(F.lit(2 * math.pi) * dow / 7.0),
        "dow_cos": F.cos(F.lit(2 * math.pi) * dow / 7.0),
        "is_weekend": (dow >= 5).cast("int"),
    }


DEFAULT_SEGMENTS = "overnight=00:00-06:00,morning=06:00-11:00,afternoon=11:00-17:00,evening=17:00-24:00"


def parse_segments(spec: str = DEFAULT_SEGMENTS) -> list[tuple[str, int, int]]:
    """``name=hh:mm-hh:mm`` list to (name, start minute, end minute)."""

    def minutes(clock: str) -> int:
        h, m = clock.strip().split(":")
        return int(h) * 60 + int(m)

    out = []
    for part in spec.split(","):
        name, span = part.split("=")
        start, end = span.split("-")
        out.append((name.strip(), minutes(start), minutes(end)))
    return out


def segment_columns(ts: str = "ts", spec: str = DEFAULT_SEGMENTS) -> dict[str, Column]:
    """Segment name, order and one 0/1 flag per segment.  The last matching
    segment names the row; the first one is the default."""
    minute, segments = minute_of_day(ts), parse_segments(spec)
    inside = {
        name: ((minute >= lo) & (minute < hi)) if lo < hi else ((minute >= lo) | (minute < hi))
        for name, lo, hi in segments
    }
    name_col, order_col = F.lit(segments[0][0]), F.lit(0)
    for i, (name, _, _) in enumerate(segments):
        name_col = F.when(inside[name], F.lit(name)).otherwise(name_col)
        order_col = F.when(inside[name], F.lit(i)).otherwise(order_col)
    flags = {f"segment__{name}": flag.cast("int") for name, flag in inside.items()}
    return {"therapy_segment": name_col, "therapy_segment_order": order_col, **flags}


# ---------------------------------------------------------------------- rules


def risk_score(glucose: Column) -> Column:
    """Distance to 110 with extra weight below 80 and 70 and above 180."""
    over = lambda x: F.greatest(x, F.lit(0.0))
    return F.abs(glucose - 110.0) + 2.0 * over(80.0 - glucose) + 4.0 * over(70.0 - glucose) + 0.5 * over(glucose - 180.0)


def safety_weight(actual: Column) -> Column:
    return F.when(actual < 70, 3.0).when(actual < 90, 2.0).otherwise(1.0)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def finite(x: Column) -> Column:
    """``x`` with NaN and infinities turned into null."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def safe_double(x: Column) -> Column:
    return finite(x.try_cast("double"))


def safe_flag(x: Column) -> Column:
    """Text or number to boolean; missing is false."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))


def tier(x: Column, high: float, middle: float, names: Sequence[str] = ("high", "medium", "low")) -> Column:
    return F.when(x >= high, names[0]).when(x >= middle, names[1]).otherwise(names[2])


def reasons(*pairs: tuple[str, Column]) -> Column:
    """Ordered ``array<string>`` of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


# ----------------------------------------------------------------------- text


def ratio_value(text: Column) -> Column:
    """First ``a:b`` in the text, as ``b / a``."""
    a = F.regexp_extract(text, r"([0-9]+):([0-9]+)", 1).try_cast("double")
    b = F.regexp_extract(text, r"([0-9]+):([0-9]+)", 2).try_cast("double")
    return F.when(a > 0, b / a)


def note_parts(text: Column, names: Sequence[str], sep: str = " - ") -> dict[str, Column]:
    parts = F.split(text, F.lit(sep))
    return {name: F.try_element_at(parts, F.lit(i + 1)) for i, name in enumerate(names)}


REDACTED = "[REDACTED]"
# Name fragments that mark a field as secret or as raw data, and
# name endings that mark a safe numeric summary.
SECRET_FRAGMENTS = ("password", "secret", "token", "auth", "cookie", "credential", "email", "serial")
RAW_FRAGMENTS = ("payload", "body", "headers", "glucose", "insulin", "heart_rate", "steps", "values")
SAFE_SUFFIXES = ("_rows", "_count", "_counts", "_seconds", "_minutes", "_hours", "_days")
EMAIL_PATTERN = r"^[\w.%+-]+@[\w-]+(\.[\w-]+)+$"


def _named_like(name: str, fragments: Sequence[str]) -> bool:
    return any(f in name.lower() for f in fragments)


def _redacted(name: str, value: Column, kind: T.DataType) -> Column:
    if _named_like(name, SECRET_FRAGMENTS):
        return F.lit(REDACTED)
    numeric = isinstance(kind, (T.NumericType, T.BooleanType))
    if numeric and name.lower().endswith(SAFE_SUFFIXES):
        return value
    if _named_like(name, RAW_FRAGMENTS):
        return F.lit(REDACTED)
    if isinstance(kind, T.StringType):
        return F.when(F.trim(value).rlike(EMAIL_PATTERN), F.lit(REDACTED)).otherwise(value)
    if isinstance(kind, T.StructType):
        fields = [_redacted(f.name, value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _redacted(name, x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        secret = "|".join(SECRET_FRAGMENTS + RAW_FRAGMENTS)
        return F.transform_values(
            value,
            lambda k, v: F.when(F.lower(k).rlike(secret) | F.trim(v).rlike(EMAIL_PATTERN), F.lit(REDACTED)).otherwise(v),
        )
    return value


def redact_columns(df: DataFrame) -> DataFrame:
    """Mask secret and raw-data fields by name and e-mail-like text by value."""
    return df.select(*[_redacted(f.name, F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def content_hash(*cols: str) -> Column:
    """Stable hash of a row's named fields, for change detection."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)
