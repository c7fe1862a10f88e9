"""Wearable context on the grid."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.times import ceil_ts, epoch_seconds, floor_ts, minutes_between
from pulsegrid.operators import grid as G
from pulsegrid.operators.asof import freshness
from pulsegrid.operators.intervals import inside_flag
from pulsegrid.operators.timeline import WEEK, scan
from pulsegrid.session import cut_lineage

KEY = "subject_id"
DAY_MINUTES = 1440
SHORT_MINUTES = 120  # the longest window that is not one of a day
# Carried metrics with output name and freshness cap in minutes.
SPARSE_METRICS = {
    "heart_rate_variability": ("hrv", "hrv_minutes_since_last", DAY_MINUTES),
    "respiratory_rate": ("respiratory_rate", "respiratory_rate_minutes_since_last", DAY_MINUTES),
    "resting_heart_rate": ("resting_heart_rate", "resting_heart_rate_minutes_since_last", 7 * DAY_MINUTES),
    "weight_body_mass": ("weight", "weight_minutes_since_last", 30 * DAY_MINUTES),
}
SLEEP_HOURS = ("total_sleep_hours", "in_bed_hours", "core_hours", "deep_hours", "rem_hours", "awake_hours")
WORKOUT_VALUES = ("duration_seconds", "active_energy_value", "distance_value", "avg_heart_rate", "max_heart_rate")


def nightly_summary(sleep: DataFrame, order: str = "event_id") -> DataFrame:
    """One row per projected day (the day sleep ended): the last record wins."""
    day = F.coalesce(F.col("sleep_end").cast("date"), F.col("date"))
    picked = sleep.groupBy(KEY, day.alias("date")).agg(
        F.max_by(F.struct(*SLEEP_HOURS), F.struct("sleep_end", order)).alias("_n")
    )
    return picked.select(KEY, "date", *[F.col(f"_n.{h}").alias(f"prior_night_{h}") for h in SLEEP_HOURS])


def join_days(rows: DataFrame, daily: DataFrame) -> DataFrame:
    """Daily values onto every row of the day."""
    return rows.withColumn("date", F.col("ts").cast("date")).join(daily, [KEY, "date"], "left").drop("date")


def pivot_metric(measurements: DataFrame, metric: str, stats: list[str], step_seconds: int) -> DataFrame:
    """metric × stat to columns ``metric__stat``, mean per bin; stats are given, so no extra pass finds them."""
    rows = measurements.filter(F.col("metric") == metric).withColumn("ts", floor_ts("ts", step_seconds))
    wide = rows.groupBy(KEY, "ts").pivot("stat", stats).agg(F.avg("value"))
    return wide.select(KEY, "ts", *[F.col(s).alias(f"{metric}__{s}") for s in stats])


def workout_bins(workouts: DataFrame, step_seconds: int) -> DataFrame:
    """Finished workouts per bin of their end."""
    done = workouts.filter(F.col("end_ts").isNotNull())
    zero = F.lit(0.0)
    return G.bin_events(
        done, step_seconds,
        {
            "workout_event_count": F.count(F.lit(1)).cast("double"),
            "workout_duration_event": F.sum(F.coalesce("duration_seconds", zero)),
            "workout_energy_event": F.sum(F.coalesce("active_energy_value", zero)),
        },
        ts="end_ts",
    )


def workout_windows(w, step_seconds: int) -> dict[str, Column]:
    roll = lambda c, m: G.rolling(w, c, m, step_seconds)
    return {
        "recent_workout_6h": (roll("workout_event_count", 360) > 0).cast("int"),
        "recent_workout_12h": (roll("workout_event_count", 720) > 0).cast("int"),
        "workout_count_24h": roll("workout_event_count", DAY_MINUTES),
        "workout_duration_sum_24h": roll("workout_duration_event", DAY_MINUTES),
        "workout_active_energy_sum_24h": roll("workout_energy_event", DAY_MINUTES),
    }


def workout_plausible() -> Column:
    return (
        (F.col("workout_count_24h") <= 12) & (F.col("workout_duration_sum_24h") <= 86400)
        & (F.col("minutes_since_last_workout") >= 0)
    ).cast("int")


STATS = ("avg", "min", "max")


def health_parts(health: Mapping[str, DataFrame], step_seconds: int) -> list[DataFrame]:
    """Per-bin tables of the wearable kinds.

    ``_w`` and ``_m_*`` are what the as-of columns carry forward: the latest
    workout at the first bin that starts at or after its end, and each sparse
    metric's mean at its bin.
    """
    parts = []
    if "health_activity" in health:
        parts.append(G.bin_events(health["health_activity"], step_seconds, {"health_activity_value": F.sum("activity_value")}))
    if "sleep" in health:
        both = health["sleep"].filter(F.col("sleep_start").isNotNull() & F.col("sleep_end").isNotNull())
        parts.append(inside_flag(both, step_seconds, "in_sleep", "sleep_start", "sleep_end"))
    if "workouts" in health:
        done = health["workouts"].filter(F.col("end_ts").isNotNull())
        parts.append(workout_bins(done, step_seconds))
        parts.append(
            done.withColumn("ts", ceil_ts("end_ts", step_seconds)).groupBy(KEY, "ts")
            .agg(F.max(F.struct(F.col("end_ts").alias("t"), *WORKOUT_VALUES)).alias("_w"))
        )
    if "measurements" in health:
        rows = health["measurements"]
        parts.append(pivot_metric(rows, "heart_rate", list(STATS), step_seconds))
        at = F.struct(F.col("ts").alias("t"), F.col("value"))
        for metric, (name, _, _) in SPARSE_METRICS.items():
            binned = G.bin_events(rows.filter(F.col("metric") == metric), step_seconds, {"value": F.avg("value")})
            parts.append(binned.select(KEY, "ts", at.alias(f"_m_{name}")))
    return parts


def health_carries(health: Mapping[str, DataFrame]) -> dict[str, Column]:
    """What to carry forward (as-of columns) after :func:`health_parts`."""
    out = {"last_workout": F.col("_w")} if "workouts" in health else {}
    if "measurements" in health:
        out |= {name: F.col(f"_m_{name}") for name, _, _ in SPARSE_METRICS.values()}
    return out


def health_values(health: Mapping[str, DataFrame]) -> dict[str, Column]:
    """Row columns after the carry."""
    made: dict[str, Column] = {}
    if "health_activity" in health:
        made["health_activity_value"] = F.coalesce("health_activity_value", F.lit(0.0))
    if "sleep" in health:
        made["in_sleep"] = F.coalesce("in_sleep", F.lit(0))
    if "workouts" in health:
        made |= {c: F.coalesce(c, F.lit(0.0)) for c in ("workout_event_count", "workout_duration_event", "workout_energy_event")}
        made |= {f"last_workout_{v}": F.col(f"last_workout.{v}") for v in WORKOUT_VALUES}
        made["minutes_since_last_workout"] = F.coalesce(minutes_between("ts", F.col("last_workout.t")), F.lit(1e6))
    if "measurements" in health:
        made |= {f"heart_rate_{s}_latest": F.col(f"heart_rate__{s}") for s in STATS}
        for name, fresh, cap in SPARSE_METRICS.values():
            made |= {f"{name}_latest": F.col(f"{name}.value"), fresh: freshness(name, cap)}
    return made


def health_windows(w, health: Mapping[str, DataFrame], step_seconds: int, *, day: bool = True) -> dict[str, Column]:
    """Windows over bins; without ``day`` only those of up to two hours."""
    cols: dict[str, Column] = {}
    if "health_activity" in health:
        cols |= G.rolling_columns(w, "health_activity_value", "health_activity_roll_sum", (30, 60, 120), step_seconds, "sum")
    if "workouts" in health and day:
        cols |= workout_windows(w, step_seconds)
    if "measurements" in health:
        for s in STATS:
            cols |= G.rolling_columns(w, f"heart_rate__{s}", f"heart_rate_{s}_roll_mean", (30, 60), step_seconds, "mean")
        for name, _, _ in SPARSE_METRICS.values() if day else ():
            cols[f"{name}_roll_mean_24h"] = G.rolling(w, f"{name}_latest", DAY_MINUTES, step_seconds, "mean")
    return cols


def day_parts(health: Mapping[str, DataFrame]) -> list[str]:
    """The per-bin columns of :func:`health_parts` that windows of a day read."""
    out = ["workout_event_count"] if "workouts" in health else []
    return out + ([f"_m_{name}" for name, _, _ in SPARSE_METRICS.values()] if "measurements" in health else [])


def row_before(w, health: Mapping[str, DataFrame], seconds: str) -> dict[str, Column]:
    """What :func:`sparse_day_windows` needs of the row before: when it was and the values it carries."""
    if "measurements" not in health:
        return {}
    return {"_before": F.lag(seconds).over(w), **{f"_was_{name}": F.lag(f"{name}_latest").over(w) for name, _, _ in SPARSE_METRICS.values()}}


def sparse_day_windows(df: DataFrame, w, health: Mapping[str, DataFrame], step_seconds: int, seconds: str) -> DataFrame:
    """The windows of a day where bins without an event may be missing.

    ``w`` orders by ``seconds``.  A missing bin has no workout and the value
    that the row before it carries (:func:`row_before`); so each row also counts
    for the missing bins behind its predecessor.  The first bin of each wanted
    window must be a row, or be before the subject's first bin.
    """
    cols, held = {}, {}
    first = lambda minutes: (1 - G.steps_of(minutes, step_seconds)) * step_seconds
    if "workouts" in health:
        roll = lambda c, minutes: F.sum(c).over(w.rangeBetween(first(minutes), 0))
        cols |= {f"recent_workout_{m // 60}h": (roll("workout_event_count", m) > 0).cast("int") for m in (360, 720)}
        cols |= {
            "workout_count_24h": roll("workout_event_count", DAY_MINUTES),
            "workout_duration_sum_24h": roll("workout_duration_event", DAY_MINUTES),
            "workout_active_energy_sum_24h": roll("workout_energy_event", DAY_MINUTES),
        }
    if "measurements" in health:
        begin = first(DAY_MINUTES)
        missing = (F.col(seconds) - F.col("_before")) / step_seconds - 1
        behind = lambda c: F.when(missing > 0, missing * c).otherwise(0.0)
        over = lambda c, low, high: F.coalesce(F.sum(c).over(w.rangeBetween(low, high)), F.lit(0.0))
        for name, _, _ in SPARSE_METRICS.values():
            value, was = F.coalesce(f"{name}_latest", F.lit(0.0)), F.coalesce(f"_was_{name}", F.lit(0.0))
            known, knew = (F.col(c).isNotNull().cast("double") for c in (f"{name}_latest", f"_was_{name}"))
            held |= {f"_v_{name}": value + behind(was), f"_n_{name}": known + behind(knew)}
            total = over(f"_v_{name}", begin + step_seconds, 0) + over(value, begin, begin)
            count = over(f"_n_{name}", begin + step_seconds, 0) + over(known, begin, begin)
            cols[f"{name}_roll_mean_24h"] = F.try_divide(total, count)
    return df.withColumns(held).withColumns(cols).drop(*held, *row_before(w, health, seconds))


def finish_health(df: DataFrame, health: Mapping[str, DataFrame]) -> DataFrame:
    """Plausibility flag and nightly values; helper columns go."""
    if "workouts" in health:
        df = df.withColumn("workout_summary_plausible", workout_plausible())
    if "sleep" in health:
        df = join_days(df, nightly_summary(health["sleep"]))
    helpers = [n for n, _, _ in SPARSE_METRICS.values()] + [f"heart_rate__{s}" for s in STATS] + [
        "last_workout", "workout_event_count", "workout_duration_event", "workout_energy_event", "_w",
    ] + [f"_m_{n}" for n, _, _ in SPARSE_METRICS.values()]
    return df.drop(*helpers)


def health_names(columns: list[str]) -> list[str]:
    """The wearable feature names among ``columns``."""
    marks = ("health_activity", "in_sleep", "prior_night_", "last_workout", "minutes_since_last_workout", "recent_workout", "workout_count", "workout_duration",
             "workout_active", "heart_rate_", "hrv_", "respiratory_rate_", "resting_heart_rate_", "weight_")
    return [c for c in columns if c.startswith(marks) and not c.endswith("_minutes_since_last")]


def health_facts(columns: list[str]) -> list[str]:
    """The wearable columns that are no features: how old a value is, and whether a workout is plausible."""
    return [c for c in columns if c.endswith("_minutes_since_last") or c == "workout_summary_plausible"]


def health_context(
    grid: DataFrame, health: Mapping[str, DataFrame], step_seconds: int, chunk_seconds: int = WEEK
) -> tuple[DataFrame, list[str]]:
    """All wearable features for each (subject, bin) of ``grid`` and their names.

    Runs on the full grid, so "24 h" is 24 hours even where rows are dropped
    later.  One fold, one carry pass (every as-of column) and one window pass.
    """
    out = G.assemble(grid.select(KEY, "ts"), health_parts(health, step_seconds), keep_off_grid=True)
    out = scan(cut_lineage(out), last=health_carries(health), chunk_seconds=chunk_seconds)
    out = out.filter("_grid").drop("_grid").withColumns(health_values(health))
    back = G.steps_of(DAY_MINUTES, step_seconds) * step_seconds
    out = G.bounded(out, lambda w: health_windows(w, health, step_seconds), back_seconds=back, chunk_seconds=chunk_seconds)
    out = finish_health(out, health)
    return out, health_names(out.columns)
