"""Latent exposure of accepted windows: parameters, estimators, comparison, events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import clamp, reasons, tier
from pulsegrid.operators.profile import safe_correlation
from pulsegrid.operators.quantiles import exact_quantiles, leave_one_out_median
from pulsegrid.session import cut_lineage

KEY = "subject_id"
ESTIMATORS = ("bolus_reference", "stated_prior_blend", "response_adjusted")
# Defaults and bounds of the reference parameters.
DEFAULTS = {"icr_prior": 10.0, "peak_per_carb": 4.0, "auc_per_carb": 8.0}
BOUNDS = {"icr_prior": (4.0, 20.0), "peak_per_carb": (0.5, 12.0), "auc_per_carb": (0.5, 30.0)}


def with_ratios(metrics: DataFrame) -> DataFrame:
    """Per window: stated grams, peak and area per dose unit (null without a dose)."""
    dose = F.when(F.col("bolus_units") != 0, F.col("bolus_units"))
    icr = F.col("stated_carbs") / dose
    return metrics.withColumns(
        {
            "_icr": F.when((icr > 3) & (icr < 30), icr), "_peak": F.col("observed_peak_delta") / dose,
            "_auc": F.col("observed_auc_above_baseline") / dose,
        }
    )


def _parameters(icr: Column, peak: Column, auc: Column) -> dict[str, Column]:
    """Bounded parameters from the medians (peak and area are per dose unit)."""
    raw = {
        "icr_prior": F.coalesce(icr, F.lit(DEFAULTS["icr_prior"])),
        "peak_per_carb": F.coalesce(peak / F.coalesce(icr, F.lit(DEFAULTS["icr_prior"])), F.lit(DEFAULTS["peak_per_carb"])),
        "auc_per_carb": F.coalesce(auc / F.coalesce(icr, F.lit(DEFAULTS["icr_prior"])), F.lit(DEFAULTS["auc_per_carb"])),
    }
    return {n: clamp(c, *BOUNDS[n]) for n, c in raw.items()}


def reference_parameters(metrics: DataFrame) -> DataFrame:
    """Medians over a subject's windows, within bounds."""
    rows = with_ratios(metrics)
    out = rows.select(KEY).distinct()
    for c in ("_icr", "_peak", "_auc"):
        out = out.join(exact_quantiles(rows, [KEY], c, {c: 0.5}).drop("_n"), KEY, "left")
    return out.select(KEY, *[c.alias(n) for n, c in _parameters(F.col("_icr"), F.col("_peak"), F.col("_auc")).items()])


def estimates() -> dict[str, Column]:
    """The three estimators, at least 1 g each; needs the parameters as columns."""
    dose, stated = F.coalesce("bolus_units", F.lit(0.0)), F.col("stated_carbs")
    ref, told = dose * F.col("icr_prior"), F.coalesce(F.col("stated_carbs") > 0, F.lit(False))
    area = F.coalesce(F.col("observed_auc_above_baseline") / F.col("auc_per_carb"), ref)
    peak = F.coalesce(F.col("observed_peak_delta") / F.col("peak_per_carb"), ref)
    response = 0.55 * area + 0.25 * peak + 0.20 * ref
    out = {
        "bolus_reference": ref,
        "stated_prior_blend": F.when(told, 0.7 * stated + 0.3 * ref).otherwise(ref),
        "response_adjusted": F.when(told, 0.2 * stated + 0.8 * response).otherwise(response),
    }
    return {n: F.greatest(c, F.lit(1.0)) for n, c in out.items()}


def _long(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per estimator: ``model``, ``latent``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("latent")) for n, c in estimates().items()])
    return df.withColumn("_e", F.explode(pairs)).select(*keep, F.col("_e.model").alias("model"), F.col("_e.latent").alias("latent"))


def leave_one_out(metrics: DataFrame, row_id: str = "meal_id") -> DataFrame:
    """Each window predicted from the subject's other windows, per estimator.

    Medians without one row take few distinct values, so there are few distinct
    parameter sets per subject; each set is evaluated once over the subject's
    windows instead of once per held-out window.
    """
    rows = cut_lineage(with_ratios(metrics))
    params = rows.select(KEY, row_id)
    for c in ("_icr", "_peak", "_auc"):
        # a lone row has no other rows and uses itself
        loo = leave_one_out_median(rows, [KEY], row_id, c, float("nan"), f"{c}_m")
        params = params.join(loo, [KEY, row_id], "left")
    alone = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("_rows"))
    params = params.join(alone, KEY).join(rows.select(KEY, row_id, "_icr", "_peak", "_auc"), [KEY, row_id])
    med = {c: F.when(F.col("_rows") == 1, F.col(c)).otherwise(F.when(~F.isnan(f"{c}_m"), F.col(f"{c}_m"))) for c in ("_icr", "_peak", "_auc")}
    params = params.select(KEY, row_id, *[c.alias(n) for n, c in _parameters(med["_icr"], med["_peak"], med["_auc"]).items()])
    names = list(BOUNDS)
    sets = params.select(KEY, *names).distinct().withColumn("_set", F.hash(*names))
    base = [KEY, row_id, "bolus_units", "stated_carbs", "observed_peak_delta", "observed_auc_above_baseline"]
    every = rows.select(*base).join(sets, KEY)
    long = _long(every, [KEY, *names, row_id, "stated_carbs", "observed_peak_delta"]).withColumn("_ratio", F.col("observed_peak_delta") / F.col("latent"))
    long = cut_lineage(long)
    scale = leave_one_out_median(long, [KEY, *names, "model"], row_id, "_ratio", float("nan"), "_scale")
    own = params.join(long, [KEY, row_id, *names]).join(scale, [KEY, row_id, *names, "model"]).join(alone, KEY)
    lone = F.when(F.col("_rows") == 1, F.col("_ratio"))
    used = F.coalesce(lone, F.when(~F.isnan("_scale"), F.col("_scale")), F.col("peak_per_carb"))
    return own.withColumns(
        {
            "peak_error": F.abs(F.col("latent") * used - F.col("observed_peak_delta")),
            "stated_error": F.abs(F.col("latent") - F.col("stated_carbs")),
        }
    ).select(KEY, row_id, "model", "latent", "peak_error", "stated_error")


def compare_estimators(metrics: DataFrame, row_id: str = "meal_id") -> DataFrame:
    """Held-out errors per subject and estimator; one is selected."""
    errors = leave_one_out(metrics, row_id).groupBy(KEY, "model").agg(
        F.count(F.lit(1)).alias("meal_count"), F.avg("peak_error").alias("peak_delta_mae"), F.avg("stated_error").alias("stated_carb_mae")
    )
    full = _long(metrics.join(reference_parameters(metrics), KEY), [KEY, "observed_peak_delta"])
    corr = safe_correlation(full, [KEY, "model"], "latent", "observed_peak_delta", "peak_delta_correlation")
    inf = F.lit(float("inf"))
    # rounded, so that float noise does not decide between equal errors
    rank = F.struct(F.coalesce(F.round("peak_delta_mae", 6), inf).alias("p"), F.coalesce(F.round("stated_carb_mae", 6), inf).alias("s"), "model")
    # three rows per subject
    out = errors.join(corr, [KEY, "model"], "left").withColumn("_rank", rank)
    return out.withColumn("selected", F.col("_rank") == F.min("_rank").over(Window.partitionBy(KEY))).drop("_rank")


def latent_events(metrics: DataFrame, selected: DataFrame) -> DataFrame:
    """Per-window estimate with bounds, accuracy, ratio and why it may be withheld.

    ``selected``: one row per subject with ``model``.
    """
    rows = metrics.join(reference_parameters(metrics), KEY).join(selected.select(KEY, "model"), KEY)
    est = estimates()
    rows = rows.withColumns({f"{n}_carbs": c for n, c in est.items()})
    mean = F.coalesce(*[F.when(F.col("model") == n, F.col(f"{n}_carbs")) for n in ESTIMATORS])
    rows = cut_lineage(rows.withColumn("latent_mean", mean).withColumn("_ratio", F.col("observed_peak_delta") / F.col("latent_mean")))
    scale = exact_quantiles(rows, [KEY], "_ratio", {"_scale": 0.5}).drop("_n")
    rows = rows.join(scale, KEY, "left").withColumn("_scale", F.coalesce("_scale", "peak_per_carb"))
    m, dose = F.col("latent_mean"), F.coalesce("bolus_units", F.lit(0.0))
    ref = dose * F.col("icr_prior")
    off = F.abs(F.col("observed_peak_delta") - m * F.col("_scale")) / F.greatest("_scale", F.lit(1e-6))
    explicit = F.col("explicit_carb_source_available") == 1
    width = F.when(explicit, 1.1).otherwise(1.35) * F.greatest(m * 0.18, F.coalesce(off, m * 0.12))
    told, stated = F.coalesce(F.col("stated_carbs") > 0, F.lit(False)), F.coalesce("stated_carbs", F.lit(0.0))
    score = F.when(told, F.exp(-F.abs(m - stated) / F.greatest(F.lit(15.0), stated * 0.35))).otherwise(
        0.75 * F.exp(-F.abs(m - ref) / F.greatest(F.lit(12.0), ref * 0.30))
    )
    rows = rows.withColumns({"latent_lower": F.greatest(F.lit(1.0), m - width), "latent_upper": m + width, "carb_accuracy_score": F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))})
    why = reasons(
        ("degraded_source_quality", F.col("source_quality_grade") != "good"),
        ("exercise_context", F.coalesce(F.col("recent_exercise_context") > 0, F.lit(False))),
        ("weak_postmeal_signal", F.coalesce(F.col("observed_peak_delta") < 20, F.lit(True))),
        ("wide_posterior_interval", (F.col("latent_upper") - F.col("latent_lower")) / m > 0.70),
        ("small_bolus_anchor", dose < 2.0),
    )
    rows = rows.withColumn("suppression_reasons", why)
    shown, has = F.size("suppression_reasons") == 0, lambda n: F.array_contains("suppression_reasons", n)
    ratio = lambda c: F.when(shown, F.col(c) / F.greatest(dose, F.lit(1e-6)))
    identified = (
        F.when(shown & explicit, "directly_observed").when(shown, "proxy_supported")
        .when(has("degraded_source_quality") | has("weak_postmeal_signal"), "not_identified").otherwise("weakly_identified")
    )
    return rows.withColumns(
        {
            "ic_mean": ratio("latent_mean"), "ic_lower": ratio("latent_lower"), "ic_upper": ratio("latent_upper"), "identifiability_status": identified,
            "confounding_grade": F.when(has("exercise_context"), "moderate").when(~shown, "low_to_moderate").otherwise("low"),
            "confidence_tier": tier(F.col("carb_accuracy_score"), 0.8, 0.6),
        }
    ).withColumnRenamed("model", "selected_model").drop("_ratio", "_scale", "icr_prior", "peak_per_carb", "auc_per_carb")


def _window_counts(windows: DataFrame, subjects: DataFrame) -> DataFrame:
    """Candidates and accepted windows of every subject, also of those without any."""
    counts = windows.groupBy(KEY).agg(F.count(F.lit(1)).alias("evaluated_candidates"), F.sum("included").cast("bigint").alias("accepted_windows"))
    return subjects.select(KEY).distinct().join(counts, KEY, "left").fillna(0, subset=["evaluated_candidates", "accepted_windows"])


def _window_quality() -> Column:
    return F.when(F.col("accepted_windows") > 0, "good").when(F.col("evaluated_candidates") > 0, "limited").otherwise("failed")


def cohort_gate(windows: DataFrame, subjects: DataFrame) -> DataFrame:
    """Foundation gate: how many candidates became clean windows, per subject of ``subjects``."""
    status = F.when(F.col("accepted_windows") > 0, "ready_for_latent_fit").otherwise("no_clean_windows_identified")
    share = F.when(F.col("evaluated_candidates") > 0, F.col("accepted_windows") / F.col("evaluated_candidates")).otherwise(0.0)
    return _window_counts(windows, subjects).withColumns({"accepted_fraction": share, "source_quality_status": _window_quality(), "cohort_status": status})


def full_gate(windows: DataFrame, events: DataFrame, subjects: DataFrame) -> DataFrame:
    """Three gate rows per subject: exposure, entry confidence, morning ratio."""
    shown = events.groupBy(KEY).agg(F.count("ic_mean").alias("reportable"))
    out = _window_counts(windows, subjects).join(shown, KEY, "left").fillna(0, subset=["reportable"])
    some, ic = F.col("accepted_windows") > 0, F.col("reportable") > 0

    def row(name: str, ok: Column, level: str) -> Column:
        return F.struct(
            F.lit(name).alias("parameter"), F.when(ok, level).otherwise("not_identified").alias("identifiability"),
            F.when(ok, "research_enabled").otherwise("diagnostics_only").alias("gate_status"),
        )

    rows = F.array(row("latent_carbs", some, "proxy_supported"), row("carb_entry_confidence", some, "proxy_supported"), row("morning_icr", ic, "weakly_identified"))
    return out.withColumn("_g", F.explode(rows)).select(KEY, "_g.*", "accepted_windows", "reportable", _window_quality().alias("source_quality_status"))
