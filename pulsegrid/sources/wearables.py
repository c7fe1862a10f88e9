"""Wearable JSON bundles: metrics and workouts to engine kinds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import safe_double
from pulsegrid.functions.times import floor_ts, parse_wall
from pulsegrid.operators.audit import dedupe_workouts, latest_wins
from pulsegrid.operators.grid import union_all

_POINT = ("date:string,source:string,qty:double,Avg:double,Min:double,Max:double,sleepStart:string,sleepEnd:string,inBedStart:string,inBedEnd:string,"
          "totalSleep:double,inBed:double,core:double,deep:double,rem:double,awake:double")
_QTY = "struct<qty:double,units:string>"
BUNDLE_SCHEMA = (
    f"data struct<metrics:array<struct<name:string,units:string,data:array<struct<{_POINT}>>>>,"
    f"workouts:array<struct<id:string,name:string,start:string,end:string,duration:double,distance:{_QTY},activeEnergyBurned:{_QTY},avgHeartRate:{_QTY},maxHeartRate:{_QTY}>>>"
)
# Metric names that are read, and glucose metrics that are ignored on purpose.
POINT_METRICS = ("step_count", "heart_rate_variability", "respiratory_rate", "resting_heart_rate", "weight_body_mass")
GLUCOSE_METRICS = ("blood_glucose",)
# Fixed formats: bundle folder ends in _yyyymmddhhmmss, file name holds first and last day.
BUNDLE_PATTERN = r"_(\d{14})$"
RANGE_PATTERN = r"(\d{4}-\d{2}-\d{2})-(\d{4}-\d{2}-\d{2})\.json$"


def bundle_metadata(path: Column) -> dict[str, Column]:
    """Export id and time from the folder, covered days from the file name."""
    parts = F.split(path, "/")
    folder, name = F.element_at(parts, -2), F.element_at(parts, -1)
    stamp = F.regexp_extract(folder, BUNDLE_PATTERN, 1)
    dashed = F.concat_ws(" ", F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2)),
                         F.concat_ws(":", F.substring(stamp, 9, 2), F.substring(stamp, 11, 2), F.substring(stamp, 13, 2)))
    return {
        "export_id": folder, "export_ts": F.when(stamp != "", dashed.try_cast("timestamp_ntz")), "source_json_filename": name,
        "covered_start_date": F.regexp_extract(name, RANGE_PATTERN, 1).try_cast("date"), "covered_end_date": F.regexp_extract(name, RANGE_PATTERN, 2).try_cast("date"),
    }


META = ("export_id", "export_ts", "source_json_filename", "covered_start_date", "covered_end_date")


def read_bundles(spark: SparkSession, paths: str | list[str], subject: Column | None = None) -> DataFrame:
    """One row per bundle file: subject, metadata and the parsed ``data``."""
    raw = spark.read.schema(BUNDLE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(paths)
    who = F.lit("") if subject is None else subject
    return raw.select(who.alias("subject_id"), *[c.alias(n) for n, c in bundle_metadata(F.col("_metadata.file_path")).items()], "data")


def metric_rows(bundles: DataFrame) -> DataFrame:
    """One row per metric sample."""
    metric = bundles.select("subject_id", *META, F.explode("data.metrics").alias("m"))
    return metric.select("subject_id", *META, F.col("m.name").alias("metric"), F.col("m.units").alias("unit"), F.explode("m.data").alias("r"))


def point_rows(rows: DataFrame) -> DataFrame:
    """Single-value metrics and heart rate (average, least, greatest) as long rows."""
    device = F.coalesce("r.source", F.lit(""))
    value = F.when(F.col("metric") == "heart_rate", F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(f"r.{k}").alias("value")) for s, k in (("avg", "Avg"), ("min", "Min"), ("max", "Max"))
    ])).otherwise(F.array(F.struct(F.lit("value").alias("stat"), F.col("r.qty").alias("value"))))
    known = rows.filter(F.col("metric").isin("heart_rate", *POINT_METRICS))
    out = known.select("subject_id", parse_wall("r.date").alias("ts"), "metric", "unit", device.alias("source_device"), *META, F.explode(value).alias("v"))
    return out.select("subject_id", "ts", "metric", "v.stat", "v.value", "unit", "source_device", *META).dropna(subset=["ts", "value"])


def sleep_rows(rows: DataFrame) -> DataFrame:
    hours = {"total_sleep_hours": "totalSleep", "in_bed_hours": "inBed", "core_hours": "core", "deep_hours": "deep", "rem_hours": "rem", "awake_hours": "awake"}
    times = {"sleep_start": "sleepStart", "sleep_end": "sleepEnd", "in_bed_start": "inBedStart", "in_bed_end": "inBedEnd"}
    return rows.filter(F.col("metric") == "sleep_analysis").select(
        "subject_id", parse_wall("r.date").cast("date").alias("date"), *[parse_wall(f"r.{k}").alias(n) for n, k in times.items()],
        *[F.col(f"r.{k}").alias(n) for n, k in hours.items()], F.coalesce("r.source", F.lit("")).alias("source_device"), *META,
    ).dropna(subset=["date"])


def workout_rows(bundles: DataFrame) -> DataFrame:
    w = bundles.select("subject_id", *META, F.explode("data.workouts").alias("w"))
    return w.select(
        "subject_id", F.coalesce("w.id", F.lit("")).alias("workout_id"), F.coalesce("w.name", F.lit("")).alias("workout_type"), parse_wall("w.start").alias("start_ts"), parse_wall("w.end").alias("end_ts"),
        F.col("w.duration").alias("duration_seconds"), F.col("w.distance.qty").alias("distance_value"), F.col("w.distance.units").alias("distance_unit"),
        F.col("w.activeEnergyBurned.qty").alias("active_energy_value"), F.col("w.activeEnergyBurned.units").alias("active_energy_unit"),
        F.col("w.avgHeartRate.qty").alias("avg_heart_rate"), F.col("w.maxHeartRate.qty").alias("max_heart_rate"), F.col("source_json_filename").alias("source_file"), *META,
    ).dropna(subset=["start_ts", "end_ts"])


def step_activity(points: DataFrame, bin_seconds: int = 300) -> DataFrame:
    """Step counts per bin, device and bundle."""
    steps = points.filter(F.col("metric") == "step_count").withColumn("ts", floor_ts("ts", bin_seconds))
    return steps.groupBy("subject_id", "ts", "source_device", *META).agg(F.sum("value").alias("activity_value"))


def bundle_notes(bundles: DataFrame) -> DataFrame:
    """Per bundle: metrics that were ignored and whether glucose was present."""
    names = bundles.select("subject_id", "export_id", F.explode("data.metrics.name").alias("metric"))
    known = F.col("metric").isin("heart_rate", "sleep_analysis", *POINT_METRICS)
    glucose = F.col("metric").isin(*GLUCOSE_METRICS)
    return names.groupBy("subject_id", "export_id").agg(
        F.sort_array(F.collect_set(F.when(~known & ~glucose, F.col("metric")))).alias("ignored_metrics"), F.max(glucose).alias("glucose_present")
    )


ORDER = ("export_ts", "export_id", "source_json_filename")


def canonical_types(df: DataFrame) -> DataFrame:
    """Text columns of a stored wearable table to their types, by name."""
    out = {}
    for c in df.columns:
        if c.endswith(("_ts", "_start", "_end")) or c == "ts":
            out[c] = parse_wall(F.col(c).cast("string"))
        elif c in ("date",) or c.endswith("_date"):
            out[c] = parse_wall(F.col(c).cast("string")).cast("date")
        elif c.endswith(("_value", "_hours", "_seconds", "_heart_rate")) or c == "value":
            out[c] = safe_double(F.col(c))
    return df.withColumns(out)


def attach_metadata(df: DataFrame, manifest: DataFrame, keys: tuple[str, ...] = ("subject_id", "export_id")) -> DataFrame:
    """Bundle metadata of a manifest (one row per export), only where the table lacks it."""
    cols = [c for c in META if c not in keys and c in manifest.columns]
    named = manifest.select(*keys, *[F.col(c).alias(f"_m_{c}") for c in cols])
    out = df.join(named, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") if c in df.columns else F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def load_wearables(bundles: DataFrame, bin_seconds: int = 300) -> dict[str, DataFrame]:
    """All kinds of all bundles; of overlapping exports the latest wins."""
    rows = metric_rows(bundles)
    points = point_rows(rows)
    return {
        "measurements": latest_wins(points, ["subject_id", "ts", "metric", "stat", "source_device"], ORDER),
        "health_activity": latest_wins(step_activity(points, bin_seconds), ["subject_id", "ts", "source_device"], ORDER),
        "sleep": latest_wins(sleep_rows(rows), ["subject_id", "date", "source_device"], ORDER).withColumn("event_id", F.col("export_ts")),
        "workouts": dedupe_workouts(workout_rows(bundles), ORDER),
    }


def union_kinds(sets: list[Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables of several sources joined by kind and column name."""
    kinds = sorted({k for s in sets for k in s})
    return {k: union_all([s[k] for s in sets if k in s]) for k in kinds}
