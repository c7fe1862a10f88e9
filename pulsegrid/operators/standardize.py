"""Raw tables to engine kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import schemas as Sc
from pulsegrid.functions.scalars import safe_double
from pulsegrid.functions.times import floor_ts, parse_local
from pulsegrid.operators.audit import merge_by_priority
from pulsegrid.operators.timeline import HOUR, scan

BIN = 300


def _base(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """subject and file columns; constants where the table has none."""
    return [F.col(k) if k in df.columns else F.lit("").alias(k) for k in keys]


def _time(column: str, zone: str) -> Column:
    return parse_local(F.col(f"`{column}`").cast("string"), zone)


KEYS = ("subject_id", "source_file")


def standardize_cgm(df: DataFrame, *, zone: str = "UTC", bin_seconds: int = BIN, generic: bool = True, keys: Sequence[str] = KEYS) -> DataFrame | None:
    """First glucose value by column priority; per bin and file the best source wins,
    then the earliest sample.  None if the table has no glucose or time column."""
    time, glucose = Sc.find_column(df.columns, Sc.TIME_CGM), Sc.glucose_columns(df.columns, generic=generic)
    if time is None or not glucose:
        return None
    values = [safe_double(F.col(f"`{c}`")) for c, _ in glucose]
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for v, (_, name) in zip(values, glucose, strict=True)])
    rank = F.coalesce(*[F.when(v.isNotNull(), F.lit(i)) for i, v in enumerate(values)])
    rows = df.select(*_base(df, keys), _time(time, zone).alias("_t"), F.coalesce(*values).alias("glucose"), source.alias("glucose_source"), rank.alias("_rank"))
    rows = rows.filter(F.col("_t").isNotNull() & F.col("glucose").isNotNull()).withColumn("ts", floor_ts("_t", bin_seconds))
    best = F.min_by(F.struct("glucose", "glucose_source"), F.struct("_rank", "_t", "glucose"))
    return rows.groupBy(*keys, "ts").agg(best.alias("_b")).select(*keys, "ts", "_b.*")


def _summed(df: DataFrame, time: str, values: dict[str, str], zone: str, bin_seconds: int, keys: Sequence[str], required: str) -> DataFrame:
    rows = df.select(*_base(df, keys), _time(time, zone).alias("_t"), *[safe_double(F.col(f"`{c}`")).alias(n) for n, c in values.items()])
    rows = rows.filter(F.col("_t").isNotNull() & F.col(required).isNotNull())
    return rows.groupBy(*keys, floor_ts("_t", bin_seconds).alias("ts")).agg(*[F.sum(n).alias(n) for n in values])


def standardize_bolus(df: DataFrame, *, zone: str = "UTC", bin_seconds: int = BIN, keys: Sequence[str] = KEYS) -> DataFrame | None:
    time, units = Sc.find_column(df.columns, Sc.TIME_BOLUS), Sc.find_column(df.columns, Sc.BOLUS_UNITS)
    carbs = Sc.find_column(df.columns, Sc.CARBS)
    if time is None or units is None:
        return None
    return _summed(df, time, {"bolus_units": units, **({"carb_grams": carbs} if carbs else {})}, zone, bin_seconds, keys, "bolus_units")


def standardize_carbs(df: DataFrame, *, label: str | None = None, zone: str = "UTC", bin_seconds: int = BIN, keys: Sequence[str] = KEYS) -> DataFrame | None:
    time, carbs = Sc.find_column(df.columns, Sc.TIME_CARBS), Sc.find_column(df.columns, Sc.CARBS)
    if time is None or carbs is None:
        return None
    out = _summed(df, time, {"carb_grams": carbs}, zone, bin_seconds, keys, "carb_grams")
    return out.withColumn("source_label", F.lit(label) if label else F.col("source_file"))


def standardize_basal(df: DataFrame, *, zone: str = "UTC", keys: Sequence[str] = KEYS) -> DataFrame | None:
    rate = Sc.find_column(df.columns, Sc.BASAL_RATE)
    start, end = Sc.find_column(df.columns, Sc.TIME_START), Sc.find_column(df.columns, Sc.TIME_END)
    if rate is None:
        return None
    none = F.lit(None).cast("timestamp_ntz")
    return df.select(
        *_base(df, keys), (_time(start, zone) if start else none).alias("start_ts"), (_time(end, zone) if end else none).alias("end_ts"),
        safe_double(F.col(f"`{rate}`")).alias("basal_units_per_hour"),
    ).filter(F.col("basal_units_per_hour").isNotNull())


def standardize_activity(df: DataFrame, *, zone: str = "UTC", bin_seconds: int = BIN, keys: Sequence[str] = KEYS) -> DataFrame | None:
    time, value = Sc.find_column(df.columns, Sc.TIME_ACTIVITY), Sc.find_column(df.columns, Sc.ACTIVITY)
    if time is None or value is None:
        return None
    return _summed(df, time, {"activity_value": value}, zone, bin_seconds, keys, "activity_value")


def merge_carbs(direct: DataFrame | None, bolus: DataFrame | None) -> DataFrame | None:
    """Direct carb records first, then carbs entered with a dose; equal (time, grams) once."""
    parts = []
    if direct is not None:
        parts.append((0, direct))
    if bolus is not None and "carb_grams" in bolus.columns:
        parts.append((1, bolus.filter(F.col("carb_grams").isNotNull()).select(*KEYS, "ts", "carb_grams", F.lit("bolus").alias("source_label"))))
    return merge_by_priority(parts, ["subject_id", "ts", "carb_grams"]) if parts else None


def close_basal(basal: DataFrame, window_end: Column, keys: Sequence[str] = ("subject_id",), order: Sequence[str] = ()) -> DataFrame:
    """A missing end becomes the next start, else the day after the window's end."""
    dated = basal.filter(F.col("start_ts").isNotNull())
    out = scan(dated, keys=keys, ts="start_ts", order=order, chunk_seconds=HOUR, after={"_next": F.col("start_ts")})
    end = F.coalesce("end_ts", "_next", F.date_add(window_end, 1).cast("timestamp_ntz"))
    return out.withColumn("end_ts", end).drop("_next")


def standardize_table(df: DataFrame, file_name: str, *, zone: str = "UTC", bin_seconds: int = BIN) -> dict[str, DataFrame]:
    """All kinds a raw table can give (names are resolved on the driver, rows are not read)."""
    made = {}
    for kind in Sc.kinds_of(df.columns, file_name):
        fn = {"cgm": standardize_cgm, "bolus": standardize_bolus, "carbs": standardize_carbs, "basal": standardize_basal, "activity": standardize_activity}[kind]
        args = {"zone": zone} if kind == "basal" else {"zone": zone, "bin_seconds": bin_seconds}
        out = fn(df, **args)
        if out is not None:
            made[kind] = out
    return made
