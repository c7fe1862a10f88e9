"""Driver tables as engine kinds (see FIXTURES.md, section 5).

``events`` is the per-subject event stream.  Each function returns one kind
with ``subject_id`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.times import shift
from pulsegrid.operators.timeline import HOUR, scan
from pulsegrid.sources.stored import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def event_rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type") == kind).withColumnRenamed("user_id", "subject_id")


def source_file(event_id: str = "event_id") -> Column:
    return F.concat(F.lit("export_"), (F.col(event_id) % 3).cast("string"))


def cgm(spark, sf_dir) -> DataFrame:
    return event_rows(spark, sf_dir, "view").select(
        "subject_id", "ts", (F.col("value") + 60).alias("glucose"), source_file().alias("source_file"), "event_id"
    )


def bolus(spark, sf_dir) -> DataFrame:
    return event_rows(spark, sf_dir, "purchase").select(
        "subject_id", "ts", (F.col("value") / 10).alias("bolus_units"), source_file().alias("source_file"), "event_id"
    )


def carbs(spark, sf_dir) -> DataFrame:
    return event_rows(spark, sf_dir, "error").select(
        "subject_id", "ts", F.col("value").alias("carb_grams"), source_file().alias("source_file"), "event_id"
    )


def activity(spark, sf_dir) -> DataFrame:
    return event_rows(spark, sf_dir, "click").select(
        "subject_id", "ts", F.col("value").alias("activity_value"), source_file().alias("source_file"), "event_id"
    )


def basal(spark, sf_dir) -> DataFrame:
    """Rate intervals; each ends where the subject's next one starts, the last has no end."""
    return shared(spark, sf_dir, "basal", lambda: _basal(spark, sf_dir))


def _basal(spark, sf_dir) -> DataFrame:
    rows = event_rows(spark, sf_dir, "signup").select("subject_id", "ts", "event_id", "value")
    return scan(rows, order=["event_id"], chunk_seconds=HOUR, after={"end_ts": F.col("ts")}).select(
        "subject_id", F.col("ts").alias("start_ts"), "end_ts", (F.col("value") / 50).alias("basal_units_per_hour"),
        source_file().alias("source_file"), "event_id",
    )


def workouts(spark, sf_dir) -> DataFrame:
    k = _k()
    return event_rows(spark, sf_dir, "click").filter(k >= 80).select(
        "subject_id", F.col("event_id").cast("string").alias("workout_id"), F.lit("walk").alias("workout_type"),
        F.col("ts").alias("start_ts"), shift("ts", k * 60).alias("end_ts"),
        (k * 60).cast("double").alias("duration_seconds"), (F.col("value") / 100).alias("distance_value"),
        F.col("value").alias("active_energy_value"), (F.col("value") / 4 + 60).alias("avg_heart_rate"),
        (F.col("value") / 3 + 80).alias("max_heart_rate"), "event_id",
    )


def sleep(spark, sf_dir) -> DataFrame:
    k = _k()
    return event_rows(spark, sf_dir, "signup").select(
        "subject_id", F.col("ts").cast("date").alias("date"), F.col("ts").alias("sleep_start"),
        shift("ts", k * 360).alias("sleep_end"), (k / 10.0).alias("total_sleep_hours"),
        (k / 10.0 + 0.5).alias("in_bed_hours"), (k / 20.0).alias("core_hours"), (k / 50.0).alias("deep_hours"),
        (k / 40.0).alias("rem_hours"), (F.lit(0.5) + k * 0).alias("awake_hours"), "event_id",
    )


def measurements(spark, sf_dir) -> DataFrame:
    metric = (
        F.when(_k() % 4 == 0, "heart_rate").when(_k() % 4 == 1, "heart_rate_variability")
        .when(_k() % 4 == 2, "respiratory_rate").otherwise("resting_heart_rate")
    )
    stat = (
        F.when(_k() % 4 != 0, "value").when(F.col("event_id") % 3 == 0, "avg")
        .when(F.col("event_id") % 3 == 1, "min").otherwise("max")
    )
    return event_rows(spark, sf_dir, "view").select(
        "subject_id", "ts", metric.alias("metric"), stat.alias("stat"), "value", F.lit("count").alias("unit"),
        source_file().alias("source_device"), "event_id",
    )


def health_activity(spark, sf_dir) -> DataFrame:
    return event_rows(spark, sf_dir, "click").select(
        "subject_id", "ts", _k().cast("double").alias("activity_value"), source_file().alias("source_device"), "event_id"
    )
