"""Event clusters, clean windows and day samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import reasons
from pulsegrid.functions.times import epoch_seconds, minutes_between
from pulsegrid.operators.asof import nearest_within, window_join
from pulsegrid.operators.proxies import yes
from pulsegrid.operators.timeline import HOUR, scan

KEY = "subject_id"
NO_EXCLUSIONS = "accepted_without_exclusions"


def session_ids(events: DataFrame, gap_minutes: float, name: str = "session", order: tuple[str, ...] = ()) -> DataFrame:
    """Number the runs of events with gaps up to ``gap_minutes`` (an equal gap joins), from 1."""
    out = scan(events, order=order, chunk_seconds=HOUR, prev={"_before": F.col("ts")})
    new = F.coalesce((minutes_between("ts", "_before") > gap_minutes).cast("int"), F.lit(1))
    return scan(out, order=order, chunk_seconds=HOUR, cumsum={name: new}).drop("_before")


def meal_events(research: DataFrame, gap_minutes: float = 90.0) -> DataFrame:
    """One row per meal cluster: its best row and its evidence."""
    explicit = yes(F.col("explicit_meal_event") > 0) | yes(F.col("explicit_carb_grams") > 0)
    proxy = F.col("meal_proxy_event") > 0
    rows = research.filter(explicit | proxy).withColumns({"_explicit": explicit.cast("int"), "_proxy": proxy.cast("int")})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    best = F.struct(
        "_explicit", zero("explicit_carb_grams").alias("c"), zero("meal_proxy_confidence").alias("p"), zero("bolus_units").alias("b"),
        (-epoch_seconds("ts")).alias("t"),
    )
    picked = session_ids(rows, gap_minutes, "_cluster").groupBy(KEY, "_cluster").agg(
        F.max_by(F.struct("ts", "therapy_segment", "explicit_carb_grams", "bolus_units", "meal_proxy_confidence", "glucose"), best).alias("r"),
        F.sum("_explicit").alias("explicit_carb_rows"), F.sum("_proxy").alias("proxy_rows"),
    )
    both, some = (F.col("explicit_carb_rows") > 0) & (F.col("proxy_rows") > 0), F.col("explicit_carb_rows") > 0
    return picked.select(
        KEY, F.format_string("meal_%04d", "_cluster").alias("meal_id"), F.col("r.ts").alias("ts"), F.col("r.therapy_segment").alias("segment"),
        F.when(both, "explicit_and_proxy").when(some, "explicit_logged").otherwise("proxy_only").alias("evidence_source"),
        "explicit_carb_rows", "proxy_rows",
        F.when(F.col("r.explicit_carb_grams") > 0, F.col("r.explicit_carb_grams")).alias("stated_carbs"),
        F.coalesce("r.bolus_units", F.lit(0.0)).alias("bolus_units"),
        F.coalesce("r.meal_proxy_confidence", F.lit(0.0)).alias("meal_proxy_confidence"), F.col("r.glucose").alias("glucose"),
    )


@dataclass(frozen=True)
class CleanWindowRules:
    """Limits of a clean first-meal window (defaults: the standard cohort)."""

    segment: str = "morning"
    min_dose: float = 1.5
    premeal_minutes: int = 30
    postmeal_minutes: int = 180
    prior_minutes: int = 240
    early_minutes: int = 90
    followup_minutes: int = 120
    repeat_dose: float = 0.5
    max_iob: float = 1.0
    glucose_range: tuple[float, float] = (80.0, 130.0)
    max_slope: float = 20.0
    min_coverage: float = 0.9


def first_candidates(research: DataFrame, rules: CleanWindowRules = CleanWindowRules()) -> DataFrame:
    """First qualifying dose row of each (subject, day)."""
    ok = (F.col("therapy_segment") == rules.segment) & (F.coalesce("bolus_units", F.lit(0.0)) >= rules.min_dose)
    rows = research.filter(ok).withColumn("date", F.col("ts").cast("date"))
    keep = [c for c in ("ts", "therapy_segment", "bolus_units", "glucose", "iob_units", "explicit_carb_grams", "explicit_carb_source_available",
                        "meal_truth_status", "recent_workout_6h", "workout_summary_trustworthy") if c in research.columns]
    first = rows.groupBy(KEY, "date").agg(F.min_by(F.struct(*keep), "ts").alias("_r")).select(KEY, "date", "_r.*")
    # one row per day and subject: the numbering window is bounded by the calendar
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("date"))
    return first.withColumnRenamed("ts", "anchor_ts").withColumn("candidate_id", F.format_string("first_meal_%04d", number))


def clean_windows(research: DataFrame, rules: CleanWindowRules = CleanWindowRules()) -> DataFrame:
    """Each candidate with its window facts, exclusion reasons, status and grade.

    All five windows come from one bucketed join and one aggregation.
    """
    anchors = first_candidates(research, rules)
    rows = research.select(KEY, "ts", *[
        F.col(c).alias(f"w_{c}") for c in ("glucose", "iob_units", "missing_cgm", "bolus_units", "meaningful_basal_rate_change", "stacked_bolus_state")
    ])
    hit = window_join(
        anchors.select(KEY, "candidate_id", "anchor_ts"), rows, back_minutes=max(rules.prior_minutes, rules.premeal_minutes),
        ahead_minutes=max(rules.postmeal_minutes, rules.early_minutes, rules.followup_minutes),
    )
    at = minutes_between("ts", "anchor_ts")
    pre = (at >= -rules.premeal_minutes) & (at < 0)
    whole = (at >= -rules.premeal_minutes) & (at <= rules.postmeal_minutes)
    early = (at >= 0) & (at <= rules.early_minutes)
    prior = (at >= -rules.prior_minutes) & (at < 0)
    follow = (at > 0) & (at <= rules.followup_minutes)
    g_pre = pre & F.col("w_glucose").isNotNull()
    facts = hit.groupBy(KEY, "candidate_id").agg(
        F.max_by("w_glucose", F.when(g_pre, F.col("ts"))).alias("_last_g"), F.min_by("w_glucose", F.when(g_pre, F.col("ts"))).alias("_first_g"),
        F.max_by("w_iob_units", F.when(pre & F.col("w_iob_units").isNotNull(), F.col("ts"))).alias("_iob"),
        F.max(F.when(pre, F.greatest("w_meaningful_basal_rate_change", "w_stacked_bolus_state"))).alias("_conf"),
        F.max((prior & (F.col("w_bolus_units") >= rules.repeat_dose)).cast("int")).alias("_prior"),
        F.max((follow & (F.col("w_bolus_units") >= rules.repeat_dose)).cast("int")).alias("_follow"),
        F.avg(F.when(whole, F.coalesce(F.col("w_missing_cgm").cast("double"), F.lit(1.0)))).alias("_miss"),
        F.max((early & (F.col("w_missing_cgm") > 0)).cast("int")).alias("_early"), F.count_if(whole).alias("window_row_count"),
    )
    zero = F.lit(0)
    have = set(anchors.columns)
    workout = (F.col("recent_workout_6h") > 0) & (F.coalesce("workout_summary_trustworthy", F.lit(1)) > 0) if "recent_workout_6h" in have else F.lit(False)
    out = anchors.join(facts, [KEY, "candidate_id"], "left").withColumns(
        {
            "premeal_glucose": F.coalesce("_last_g", "glucose"),
            "premeal_delta_30m": F.coalesce("_last_g", "glucose") - F.col("_first_g"),
            "premeal_iob": F.coalesce("_iob", "iob_units", F.lit(0.0)),
            "recent_workout_6h": yes(workout).cast("int"),
            "closed_loop_confounding_premeal": F.coalesce("_conf", zero),
            "prior_bolus_4h": F.coalesce("_prior", zero), "postmeal_additional_bolus_120m": F.coalesce("_follow", zero),
            "cgm_coverage_fraction": F.coalesce(1 - F.col("_miss"), F.lit(0.0)), "missing_cgm_first_90m": F.coalesce("_early", zero),
            "window_row_count": F.coalesce("window_row_count", zero),
        }
    )
    lo, hi = rules.glucose_range
    why = reasons(
        ("recent_bolus_4h", F.col("prior_bolus_4h") == 1),
        ("high_premeal_iob", F.col("premeal_iob") >= rules.max_iob),
        ("premeal_bg_out_of_range", F.coalesce(~F.col("premeal_glucose").between(lo, hi), F.lit(True))),
        ("steep_premeal_slope", F.coalesce(F.abs("premeal_delta_30m") > rules.max_slope, F.lit(True))),
        ("recent_workout_6h", F.col("recent_workout_6h") == 1),
        ("closed_loop_confounding_premeal", F.col("closed_loop_confounding_premeal") > 0),
        ("postmeal_additional_bolus_120m", F.col("postmeal_additional_bolus_120m") == 1),
        ("poor_cgm_coverage", F.col("cgm_coverage_fraction") < rules.min_coverage),
        ("missing_cgm_first_90m", F.col("missing_cgm_first_90m") == 1),
    )
    out = out.withColumn("exclusion_reasons", why)
    clean = F.size("exclusion_reasons") == 0
    good = (F.col("cgm_coverage_fraction") >= rules.min_coverage) & (F.col("missing_cgm_first_90m") == 0)
    return out.withColumns(
        {
            "included": clean.cast("int"), "candidate_status": F.when(clean, "accepted").otherwise("rejected"),
            "source_quality_grade": F.when(good, "good").otherwise("degraded"), "stated_carbs": F.col("explicit_carb_grams"),
        }
    ).select(
        KEY, "candidate_id", "date", "anchor_ts", F.col("therapy_segment").alias("segment"), "candidate_status", "included", "exclusion_reasons",
        "explicit_carb_source_available", "meal_truth_status", "stated_carbs", "bolus_units", "premeal_glucose", "premeal_delta_30m", "premeal_iob",
        "recent_workout_6h", "closed_loop_confounding_premeal", "prior_bolus_4h", "postmeal_additional_bolus_120m", "cgm_coverage_fraction",
        "missing_cgm_first_90m", "window_row_count", "source_quality_grade",
    )


def exclusion_summary(windows: DataFrame) -> DataFrame:
    """Reason counts per subject; ``accepted_without_exclusions`` where no window has a reason."""
    label = F.when(F.size("exclusion_reasons") > 0, F.col("exclusion_reasons")).otherwise(F.array(F.lit(NO_EXCLUSIONS)))
    counts = windows.select(KEY, F.explode(label).alias("reason")).groupBy(KEY, "reason").agg(F.count(F.lit(1)).alias("count"))
    real = F.max((F.col("reason") != NO_EXCLUSIONS).cast("int")).over(Window.partitionBy(KEY))
    return counts.withColumn("_real", real).filter((F.col("_real") == 0) | (F.col("reason") != NO_EXCLUSIONS)).drop("_real")


def subjects_without_candidates(subjects: DataFrame, windows: DataFrame) -> DataFrame:
    """The other empty case: subjects with no candidate at all."""
    return subjects.select(KEY).distinct().join(windows, KEY, "left_anti").select(KEY, F.lit("no_candidates").alias("reason"), F.lit(0).cast("bigint").alias("count"))


def window_metrics(research: DataFrame, events: DataFrame, windows: DataFrame, rules: CleanWindowRules = CleanWindowRules(), step_seconds: int = 300) -> DataFrame:
    """Response after each accepted window: peak, delta, area (value × hours of a bin), mean, evidence, context."""
    kept = windows.filter(F.col("included") > 0)
    context = [c for c in ("sleep_deficit_flag", "recent_exercise_context", "post_workout_meal_context", "meal_proxy_confidence") if c in research.columns]
    rows = research.select(KEY, "ts", F.col("glucose").alias("w_glucose"), *context)
    hit = window_join(
        kept.select(KEY, "candidate_id", "anchor_ts", "premeal_glucose"), rows, back_minutes=5, ahead_minutes=rules.postmeal_minutes
    )
    at = minutes_between("ts", "anchor_ts")
    post, near = at >= 0, F.abs(at) <= 5
    above = F.greatest(F.col("w_glucose") - F.col("premeal_glucose"), F.lit(0.0)) * (step_seconds / 3600.0)
    facts = hit.groupBy(KEY, "candidate_id").agg(
        F.max(F.when(post, F.col("w_glucose"))).alias("observed_peak_glucose"), F.sum(F.when(post, above)).alias("observed_auc_above_baseline"),
        F.avg(F.when(post, F.col("w_glucose"))).alias("observed_mean_glucose_180m"), F.count(F.when(post, F.col("w_glucose"))).alias("observed_cgm_points"),
        *[F.min_by(c, F.when(near, F.col("ts"))).alias(c) for c in context],
    )
    anchors = kept.select(KEY, F.col("candidate_id").alias("anchor_id"), "anchor_ts")
    source = nearest_within(anchors, events, "evidence_source", max_minutes=90).select(
        KEY, F.col("anchor_id").alias("candidate_id"), F.col("evidence_source").alias("_near")
    )
    out = kept.join(facts, [KEY, "candidate_id"]).join(source, [KEY, "candidate_id"], "left")
    evidence = F.coalesce("_near", F.lit("proxy_only"))
    return out.withColumns(
        {
            "observed_peak_delta": F.col("observed_peak_glucose") - F.col("premeal_glucose"),
            "evidence_source": F.when((evidence == "proxy_only") & (F.col("stated_carbs") > 0), "explicit_logged").otherwise(evidence),
        }
    ).drop("_near")


# ------------------------------------------------------------------ day samples


def day_summary(research: DataFrame) -> DataFrame:
    return research.groupBy(KEY, F.col("ts").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.coalesce("bolus_units", F.lit(0.0)) > 0).alias("bolus_rows")
    )


def even_positions(position: Column, size: Column, k: int) -> Column:
    """Is ``position`` (0-based) one of k evenly spaced ones of ``size``?

    Rounds half to even; with k = 1 the first is taken.
    """
    picks = F.least(F.lit(k), size)
    exact = F.transform(
        F.sequence(F.lit(0), picks.cast("int") - 1),
        lambda i: F.when(picks > 1, F.bround(i * (size - 1) / (picks - 1), 0)).otherwise(F.lit(0.0)).cast("bigint"),
    )
    return F.array_contains(exact, position.cast("bigint"))


def background_days(days: DataFrame, taken: DataFrame, k: int) -> DataFrame:
    """k evenly spaced days of each subject that are not taken."""
    free = days.join(taken.select(KEY, "date").distinct(), [KEY, "date"], "left_anti")
    # one row per subject and day: bounded by the calendar
    w = Window.partitionBy(KEY)
    ranked = free.withColumns({"_p": F.row_number().over(w.orderBy("date")) - 1, "_n": F.count(F.lit(1)).over(w)})
    if k <= 0:
        return ranked.limit(0).drop("_p", "_n")
    return ranked.filter(even_positions(F.col("_p"), F.col("_n"), k)).drop("_p", "_n")


def representative_days(research: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """Candidate days plus background days, with why each was chosen."""
    days = day_summary(research)
    chosen = windows.select(KEY, "date", "candidate_id", "source_quality_grade", F.array_join("exclusion_reasons", "|").alias("exclusion_reasons"))
    candidates = chosen.join(days, [KEY, "date"], "left").withColumns(
        {"selection_type": F.lit("candidate"), "selection_reason": F.lit("first_meal_candidate_day")}
    )
    background = background_days(days, chosen, k).withColumns(
        {
            "selection_type": F.lit("background"), "selection_reason": F.lit("evenly_spaced_non_candidate_day"),
            "candidate_id": F.lit(""), "source_quality_grade": F.lit(""), "exclusion_reasons": F.lit(""),
        }
    )
    return candidates.unionByName(background)


def rows_of_days(frame: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the selected days only."""
    return frame.withColumn("date", F.col("ts").cast("date")).join(days.select(KEY, "date").distinct(), [KEY, "date"], "left_semi").drop("date")


def exclusion_retention(source: DataFrame, sample: DataFrame) -> DataFrame:
    """Reason counts of the whole set against those of the sample; subjects without exclusions are none."""
    real = F.col("reason") != NO_EXCLUSIONS
    a = source.filter(real).groupBy("reason").agg(F.sum("count").alias("source_count"))
    b = sample.filter(real).groupBy("reason").agg(F.sum("count").alias("sample_count"))
    out = a.join(b, "reason", "full").fillna(0, subset=["source_count", "sample_count"])
    return out.withColumn("retained", F.when(F.col("sample_count") > 0, "yes").otherwise("no"))


def recent_rows(df: DataFrame, n: int, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """The n newest rows of each key: first trimmed per day, so no task sees a whole key."""
    day = F.col("ts").cast("date")
    per_day = F.row_number().over(Window.partitionBy(*keys, day).orderBy(F.desc("ts")))
    trimmed = df.withColumn("_r", per_day).filter(F.col("_r") <= n)
    counts = trimmed.groupBy(*keys, day.alias("_day")).agg(F.count(F.lit(1)).alias("_c"))
    newer = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1))
    offset = counts.select(*keys, "_day", F.coalesce(newer, F.lit(0)).alias("_newer")).filter(F.col("_newer") < n)
    joined = trimmed.withColumn("_day", day).join(offset, [*keys, "_day"])
    return joined.filter(F.col("_newer") + F.col("_r") <= n).drop("_r", "_day", "_newer")
