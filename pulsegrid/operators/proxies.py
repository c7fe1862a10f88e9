"""Dose classes, context masks, epochs: the research columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import DEFAULT_SEGMENTS, segment_columns
from pulsegrid.functions.times import minute_of_day, minutes_between
from pulsegrid.operators.timeline import row_windows, scan
from pulsegrid.session import cut_lineage

KEY = "subject_id"
# Fixed values.
STEP_CHANGE = 0.4
STACK_ROWS = 12
HIGH_IOB = 1.5


def _or(col: str, default, have: set[str]) -> Column:
    return F.coalesce(F.col(col).cast("double"), F.lit(float(default))) if col in have else F.lit(float(default))


def yes(cond: Column) -> Column:
    """Condition with missing as false."""
    return F.coalesce(cond, F.lit(False))


def in_meal_hours(ts: str = "ts") -> Column:
    """06:00-10:00, 11:00-14:00 or 17:00-21:00."""
    m = minute_of_day(ts)
    return ((m >= 360) & (m < 600)) | ((m >= 660) & (m < 840)) | ((m >= 1020) & (m < 1260))


def dose_proxy(df: DataFrame, *, direct: str = "_direct", recent_doses: str = "_recent_doses", mode: str = "strict") -> DataFrame:
    """meal_like / correction_like / ambiguous / none with confidence and size.

    ``direct``: boolean column, an observed meal belongs to the row;
    ``recent_doses``: doses above 0.2 in the last 12 rows.  Modes: strict
    (default), broad (every dose that is no correction is a meal), off.
    """
    have = set(df.columns)
    dose, glucose = _or("bolus_units", 0, have), _or("glucose", 0, have)
    rise = glucose - (F.coalesce(F.col("glucose_lag_30m"), glucose) if "glucose_lag_30m" in have else glucose) > 12
    mean_hour = F.coalesce(F.col("glucose_roll_mean_60m"), glucose) if "glucose_roll_mean_60m" in have else glucose
    meant, direct_col, meal_hours = dose >= 0.5, yes(F.col(direct)), in_meal_hours()
    correction = meant & (glucose >= 165) & (rise | (mean_hour >= 155) | ~meal_hours) & ~direct_col
    meal = meant & ~correction & (direct_col | (meal_hours & (glucose < 180) & ~(F.col(recent_doses) > 1)))
    if mode == "broad":
        meal = meant & ~correction
    elif mode == "off":
        meal = correction = F.lit(False)
    elif mode != "strict":
        raise ValueError("mode must be strict, broad or off")
    other = meant & ~(meal | correction)

    cls = F.when(meal, "meal_like").when(correction, "correction_like").when(other, "ambiguous").otherwise("none")
    out = df.withColumns(
        {
            "bolus_proxy_class": cls,
            "meal_proxy_confidence": F.when(meal & direct_col, 0.98).when(meal, 0.80).otherwise(0.0),
            "correction_proxy_confidence": F.when(correction, 0.85).otherwise(0.0),
        }
    )
    out = out.withColumns(
        {
            "meal_proxy_event": (F.col("meal_proxy_confidence") >= 0.8).cast("int"),
            "correction_proxy_event": (F.col("correction_proxy_confidence") >= 0.8).cast("int"),
        }
    )
    units = F.when(F.col("meal_proxy_event") == 1, dose).otherwise(0.0)
    size = F.when(units >= 6, "large").when(units >= 3, "medium").when(units > 0, "small").otherwise("none")
    return out.withColumns({"meal_proxy_units": units, "meal_proxy_size_class": size})


def workout_trust(have: set[str]) -> Column:
    """Are the workout sums plausible?  Missing columns do not count against."""
    trust = F.lit(True)
    if "workout_summary_plausible" in have:
        trust = trust & (_or("workout_summary_plausible", 0, have) == 1)
    if "workout_count_24h" in have:
        trust = trust & (_or("workout_count_24h", 0, have) <= 12)
    if "workout_duration_sum_24h" in have:
        trust = trust & (_or("workout_duration_sum_24h", 0, have) <= 86400)
    return trust.cast("int")


def direct_meal(df: DataFrame) -> DataFrame:
    """Adds ``_direct``: an observed meal at the row or up to 30 minutes before.
    Needs ``_meals`` (meal rows of the subject)."""
    now = yes(F.col("explicit_meal_event") > 0) | yes(F.col("explicit_carb_grams") > 0)
    near = yes(F.col("minutes_since_last_explicit_meal") <= 30) & (F.col("_meals") > 0)
    return df.withColumn("_direct", now | near)


def context_masks(df: DataFrame) -> DataFrame:
    """Recent meal, dose and exercise; fasting; the three task contexts; confounding."""
    have = set(df.columns)
    since, known = F.col("minutes_since_last_explicit_meal"), F.col("_meals") > 0
    proxy = F.col("meal_proxy_event") == 1
    meal = F.when(known, F.col("_direct") | proxy | yes(since <= 120)).otherwise(proxy)
    fasting = F.when(known, yes(since >= 240) & ~proxy).otherwise(~proxy)
    dose, iob = _or("bolus_units", 0, have), _or("iob_roll_sum_120m", 0, have)
    bit = lambda c: c.cast("int")
    df = df.withColumns(
        {
            "recent_meal_120m": bit(meal), "_fasting": fasting,
            "recent_bolus_120m": bit((dose > 0) | (iob > HIGH_IOB)),
            "workout_summary_trustworthy": workout_trust(have),
            "high_iob_state": bit(iob > HIGH_IOB),
            "stacked_bolus_state": bit(F.col("_recent_doses") > 1),
            "meaningful_basal_rate_change": bit(yes(F.abs(F.col("basal_units_per_hour") - F.col("_prev_rate")) >= STEP_CHANGE)),
        }
    )
    exercise = ((_or("recent_workout_12h", 0, have) > 0) & (F.col("workout_summary_trustworthy") == 1)) | (
        _or("health_activity_roll_sum_60m", 0, have) > 0
    )
    confounded = (F.col("high_iob_state") + F.col("stacked_bolus_state") + F.col("meaningful_basal_rate_change")) > 0
    df = df.withColumns(
        {
            "recent_exercise_context": bit(exercise), "recent_therapy_transition": F.col("meaningful_basal_rate_change"),
            "closed_loop_confounding_flag": bit(confounded), "meal_context": F.col("recent_meal_120m"),
            "sleep_deficit_flag": bit(_or("prior_night_total_sleep_hours", 0, have) < 7),
        }
    )
    basal = (
        F.col("_fasting") & (F.col("recent_bolus_120m") == 0) & (iob <= HIGH_IOB) & (_or("missing_cgm", 0, have) == 0)
        & (F.col("recent_exercise_context") == 0) & (F.col("closed_loop_confounding_flag") == 0)
    )
    correction = (F.col("correction_proxy_event") == 1) & (F.col("recent_meal_120m") == 0) & (dose > 0) & (F.col("glucose") >= 140)
    return df.withColumns(
        {
            "basal_context": bit(basal), "correction_context": bit(yes(correction)),
            "post_workout_meal_context": F.col("meal_context") * F.col("recent_exercise_context"),
            "overnight_hrv_interaction": _or("segment__overnight", 0, have) * _or("hrv_latest", 0, have),
            "in_sleep_heart_rate_interaction": _or("in_sleep", 0, have) * _or("heart_rate_avg_latest", 0, have),
        }
    ).drop("_fasting")


def stable_epochs(df: DataFrame, gap_minutes: float = 180.0) -> DataFrame:
    """Running epoch number: a new one after a long gap or at a rate change."""
    gap = yes(minutes_between("ts", "_prev_ts") > gap_minutes)
    new = (gap | yes(F.col("basal_schedule_change") > 0)).cast("int")
    # the running sum reads its input twice
    return scan(cut_lineage(df.withColumn("_new", new)), cumsum={"therapy_stable_epoch": F.col("_new")}).drop("_new")


def research_frame(frame: DataFrame, *, segments: str = DEFAULT_SEGMENTS, mode: str = "strict") -> DataFrame:
    """Prepared rows with segments, proxies, masks and epochs.

    Row-counting windows run on the rows that are there, as in the prepared
    table (rows without glucose or target are already gone).
    """
    meals = (yes(F.col("explicit_meal_event") > 0) | yes(F.col("explicit_carb_grams") > 0)).cast("int")
    out = cut_lineage(frame.withColumns(segment_columns("ts", segments)))
    out = scan(
        out, prev={"_prev_ts": F.col("ts"), "_prev_rate": F.col("basal_units_per_hour")}, total={"_meals": meals}, row_index="_i"
    )
    dosed = (F.coalesce(F.col("bolus_units"), F.lit(0.0)) > 0.2).cast("int")
    out = row_windows(
        out, lambda w: {"_recent_doses": F.sum(dosed).over(w.rowsBetween(1 - STACK_ROWS, 0))}, back_rows=STACK_ROWS - 1, index="_i"
    )
    out = context_masks(dose_proxy(direct_meal(out), mode=mode))
    return stable_epochs(out).drop("_prev_ts", "_prev_rate", "_meals", "_i", "_recent_doses", "_direct")
