"""Kinds, their schemas, and the source column names they are found under."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

_NTZ, _D, _S = T.TimestampNTZType(), T.DoubleType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Canonical files: schema and the columns that must not be null.
CANONICAL: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "cgm": (_struct(subject_id=_S, ts=_NTZ, glucose=_D, glucose_source=_S, source_file=_S), ("ts", "glucose")),
    "bolus": (_struct(subject_id=_S, ts=_NTZ, bolus_units=_D, carb_grams=_D, source_file=_S), ("ts", "bolus_units")),
    "carbs": (_struct(subject_id=_S, ts=_NTZ, carb_grams=_D, source_label=_S, source_file=_S), ("ts", "carb_grams")),
    "basal": (_struct(subject_id=_S, start_ts=_NTZ, end_ts=_NTZ, basal_units_per_hour=_D, source_file=_S), ("start_ts", "end_ts", "basal_units_per_hour")),
    "activity": (_struct(subject_id=_S, ts=_NTZ, activity_value=_D, source_file=_S), ("ts", "activity_value")),
}

# Column names of raw exports, in order of preference.
TIME_CGM = ("dateTime", "timestamp", "datetime", "eventdatetime", "date time")
TIME_BOLUS = ("completiondatetime", "datetime", "timestamp", "dateTime")
TIME_CARBS = ("completiondatetime", "eventdatetime", "startdatetime", "datetime", "timestamp", "dateTime", "date time", "time", "startdate", "date")
TIME_ACTIVITY = ("startdate", "timestamp", "datetime", "eventdatetime")
TIME_START = ("startdatetime", "startdate", "start")
TIME_END = ("enddatetime", "enddate", "end")
GLUCOSE = ("egv_estimatedGlucoseValue", "bg", "glucose", "readings (cgm / bgm)")
GENERIC_HINTS = ("type", "description", "eventHistoryReportEventDesc", "eventTypeId", "deviceType")
BOLUS_UNITS = ("actualtotalbolusrequested", "bolus", "bolus_units", "insulin", "units")
CARBS = ("carbsize", "carbs", "carbohydrates", "guessedcarbohydrate")
BASAL_RATE = ("basalrate", "rate", "units_per_hour", "units/hour")
ACTIVITY = ("value", "steps", "activity", "count")


def find_column(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """The column that matches a candidate: first exactly, then as a substring."""
    lowered = {str(c).strip().lower(): c for c in columns}
    wanted = [c.strip().lower() for c in candidates]
    exact = next((lowered[w] for w in wanted if w in lowered), None)
    return exact or next((orig for w in wanted for low, orig in lowered.items() if w in low), None)


def exact_column(columns: Iterable[str], name: str) -> str | None:
    return {str(c).strip().lower(): c for c in columns}.get(name.strip().lower())


def glucose_columns(columns: Sequence[str], *, generic: bool = True) -> list[tuple[str, str]]:
    """(source column, canonical name) of the glucose columns, best first.

    A plain ``value`` column counts only beside a column that tells the event type.
    """
    found = [(col, name) for name in GLUCOSE if (col := exact_column(columns, name))]
    value = exact_column(columns, "value")
    if not found and generic and value and any(exact_column(columns, h) for h in GENERIC_HINTS):
        found = [(value, "value")]
    return found


def kinds_of(columns: Sequence[str], file_name: str) -> list[str]:
    """Which kinds a raw table can give, from its column names and file name."""
    low, name = {c.strip().lower() for c in columns}, file_name.lower()
    out = []
    if find_column(columns, TIME_CGM) and glucose_columns(columns):
        out.append("cgm")
    if low & {"actualtotalbolusrequested", "bolus", "bolus_units", "insulin", "units", "carbsize", "carbs"}:
        out.append("bolus")
    if low & {"carbsize", "carbs", "carbohydrates", "guessedcarbohydrate", "carb_grams"}:
        out.append("carbs")
    if low & {"basalrate", "basal_units_per_hour", "units_per_hour", "rate"}:
        out.append("basal")
    if low & {"steps", "activity", "activity_value", "value"} and any(t in name for t in ("step", "activity", "normalized")):
        out.append("activity")
    return out
