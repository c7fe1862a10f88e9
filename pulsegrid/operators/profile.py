"""Profiling and scoring aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import safety_weight
from pulsegrid.operators.proxies import yes
from pulsegrid.operators.quantiles import exact_quantiles
from pulsegrid.operators.timeline import HOUR, row_windows, scan

KEY = "subject_id"

# Plausible range by feature name (exact names first, then parts).
EXACT_LIMITS = {
    "glucose": (40, 450), "basal_units_per_hour": (0, 10), "bolus_units": (0, 40), "workout_count_24h": (0, 12),
    "workout_duration_sum_24h": (0, 86400), "minutes_since_last_workout": (0, None),
}
PART_LIMITS = (("heart_rate", (25, 220)), ("hrv", (0, 250)), ("respiratory", (5, 40)), ("weight", (50, 500)))


def plausible_range(feature: str) -> tuple[float | None, float | None]:
    if feature in EXACT_LIMITS and feature in ("glucose", "basal_units_per_hour", "bolus_units"):
        return EXACT_LIMITS[feature]
    for part, limits in PART_LIMITS:
        if part in feature:
            return limits
    return EXACT_LIMITS.get(feature, (None, None))


def to_long(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Features as (keys, feature, value) rows."""
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features])
    return typed.unpivot(list(keys), list(features), "feature", "value")


def report_card(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Missing share, mean, median, IQR, range and implausible count per feature.

    Quartiles are exact and skew-safe (:func:`exact_quantiles`).
    """
    long = to_long(df, features, keys)
    bad = F.lit(False)
    for f in features:
        lo, hi = plausible_range(f)
        out = F.lit(False)
        if lo is not None:
            out = out | (F.col("value") < lo)
        if hi is not None:
            out = out | (F.col("value") > hi)
        if lo is not None or hi is not None:
            bad = bad | ((F.col("feature") == f) & yes(out))
    by = [*keys, "feature"]
    facts = long.groupBy(*by).agg(
        (1 - F.count("value") / F.count(F.lit(1))).alias("missing_fraction"), F.count("value").alias("non_missing_count"),
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(bad).alias("impossible_count"),
    )
    quart = exact_quantiles(long, by, "value", {"_q1": 0.25, "median": 0.5, "_q3": 0.75}).drop("_n")
    return facts.join(quart, by, "left").withColumn("iqr", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")


# ---------------------------------------------------------- feature registry


# Labels of features by name.  The first pattern found in a name gives its label.
PROXY = r"^(meal|correction)_proxy_|^bolus_proxy_class$"
CONTEXT = r"^segment__|_context$"
ALL_USES = "basal,icr,sensitivity_factor"
LABELS = {
    "source_family": (
        (PROXY, "meal_bolus_proxy"), (CONTEXT + r"|^(sleep_deficit_flag|overnight_hrv_interaction|in_sleep_heart_rate_interaction)$", "therapy_context"),
        (r"^(glucose|cgm|missing_cgm$|minutes_since_last_cgm$)", "pump_cgm"), (r"basal", "pump_basal"), (r"bolus|iob|insulin", "pump_bolus"),
        (r"carb|meal", "pump_carbs"), (r"activity", "activity"), (r"hour_|dow_|weekend", "calendar"), (r"", "derived"),
    ),
    # wearable features, unless one of the first two families has them
    "wearable_family": ((r"sleep", "wearable_sleep"), (r"workout", "wearable_workout"), (r"heart_rate|hrv|respiratory|weight", "wearable_measurements"), (r"", "wearable_activity")),
    "alignment_rule": (
        (r"^bolus_proxy_class$", "proxy_label"), (PROXY, "event_proxy"), (r"^glucose_lag_", "lagged_observation"), (r"_roll_", "rolling_summary"),
        (r"^prior_night_", "projected_next_day"), (r"^in_sleep$", "interval_overlay"), (r"^heart_rate_.*_latest$", "current_bin_or_direct_state"),
        (r"_latest$", "carry_forward"), (r"^segment__|_(context|flag)$", "context_mask"), (r"_interaction$", "interaction_term"), (r"", "current_bin_or_direct_state"),
    ),
    "allowed_use_cases": (
        (PROXY, "icr,sensitivity_factor"), (CONTEXT, ALL_USES), (r"meal|carb", "icr"), (r"basal", "basal"), (r"correction|glucose", ALL_USES),
        (r"sleep|workout|heart_rate|hrv|respiratory", "basal,icr"), (r"", ALL_USES),
    ),
    "leakage_risk": ((PROXY, "moderate"), (r"^target_(glucose|delta)$", "high"), (r"", "low")),
}


def feature_label(kind: str, feature: Column) -> Column:
    """Label of a feature name, from the rules of ``kind``."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(LABELS[kind]):
        out = F.when(feature.rlike(pattern), label).otherwise(out)
    return out


def feature_labels(names: DataFrame, health: Sequence[str] = ()) -> DataFrame:
    """A table of feature names (``feature``) with all labels."""
    name = F.col("feature")
    family = feature_label("source_family", name)
    worn = name.isin(*health) & ~family.isin("meal_bolus_proxy", "therapy_context") if health else F.lit(False)
    return names.withColumns(
        {
            "source_family": F.when(worn, feature_label("wearable_family", name)).otherwise(family),
            **{k: feature_label(k, name) for k in ("alignment_rule", "allowed_use_cases", "leakage_risk")},
        }
    )


def feature_registry(
    df: DataFrame, health: Sequence[str] = (), skip: Sequence[str] = (KEY, "ts", "target_glucose", "target_delta"), unfilled: DataFrame | None = None,
) -> DataFrame:
    """Availability and non-zero share of every column, with its labels.

    ``unfilled`` is the frame before missing wearable values became 0: the
    availability of the ``health`` columns is measured there.  One aggregation
    over all columns per frame; its single row is then unfolded.
    """
    names = [c for c in df.columns if c not in skip]
    types = dict(df.dtypes)

    def nonzero(c: str) -> Column:
        if types[c] in ("string",):
            return F.count_if(F.col(c) != "")
        return F.count_if(F.col(c).cast("double") != 0)

    def unfolded(frame: DataFrame, columns: Sequence[str], share, name: str) -> DataFrame:
        facts = frame.agg(F.count(F.lit(1)).alias("_n"), *[share(c).alias(c) for c in columns])
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) / F.col("_n")).alias(name)) for c in columns])
        return facts.select(F.explode(rows).alias("r")).select("r.*")

    worn = [c for c in names if unfilled is not None and c in health]
    rest = [c for c in names if c not in worn]
    have = unfolded(df, rest, F.count, "availability")
    if worn:
        have = have.unionByName(unfolded(unfilled, worn, F.count, "availability"))
    return feature_labels(have.join(unfolded(df, names, nonzero, "nonzero_fraction"), "feature"), health)


def registry_rollup(registry: DataFrame) -> DataFrame:
    return registry.groupBy("source_family").agg(
        F.count(F.lit(1)).alias("feature_count"), F.avg("availability").alias("mean_availability"), F.avg("nonzero_fraction").alias("mean_nonzero_fraction")
    )


def proxy_audit(research: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, confidence and high-glucose share per dose class."""
    either = F.greatest("meal_proxy_confidence", "correction_proxy_confidence")
    return research.groupBy(*keys, "bolus_proxy_class").agg(
        F.count(F.lit(1)).alias("count"), F.avg("meal_proxy_confidence").alias("mean_meal_confidence"), F.avg(either).alias("mean_confidence"),
        F.avg((F.coalesce("glucose", F.lit(0.0)) >= 160).cast("int")).alias("high_glucose_fraction"),
    )


def truth_status_counts(research: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    return research.groupBy(*keys, "meal_truth_status").agg(F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------------------- scores


def forecast_scores(df: DataFrame, keys: Sequence[str], actual: str = "actual", pred: str = "pred", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """MAE, RMSE, interval coverage and width, safety-weighted and low-range MAE."""
    err = F.abs(F.col(actual) - F.col(pred))
    w = safety_weight(F.col(actual))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(((F.col(actual) >= F.col(lower)) & (F.col(actual) <= F.col(upper))).cast("int")).alias("coverage"),
        F.avg(F.col(upper) - F.col(lower)).alias("interval_width"), (F.sum(w * err) / F.sum(w)).alias("safety_weighted_mae"),
        F.coalesce(F.avg(F.when(F.col(actual) < 80, err)), F.avg(err)).alias("low_bg_mae"),
    )


def fit_quality(df: DataFrame, keys: Sequence[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """MSE and R²."""
    sq = (F.col(actual) - F.col(pred)) ** 2
    sst = F.var_pop(actual) * F.count(actual)
    return df.groupBy(*keys).agg(F.avg(sq).alias("mse"), F.when(sst > 0, 1 - F.sum(sq) / sst).alias("r2"))


def persistence_scores(df: DataFrame, keys: Sequence[str] = (KEY,), target: str = "target_glucose", current: str = "glucose") -> DataFrame:
    """Error of "nothing changes" on rows that have both values."""
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col(target) - F.col(current))).alias("persistence_mae"))


def self_difference(df: DataFrame, steps: int, value: str, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Mean absolute h-row change of a series."""
    indexed = scan(df.select(*keys, "ts", value), keys=keys, chunk_seconds=HOUR, row_index="_i")
    out = row_windows(indexed, lambda w: {"_d": F.abs(F.col(value) - F.lag(value, steps).over(w))}, back_rows=steps, index="_i", keys=keys)
    return out.groupBy(*keys).agg(F.avg("_d").alias("persistence_mae"))


def safe_median(df: DataFrame, keys: Sequence[str], value: str | Column, default: float, name: str) -> DataFrame:
    """Median per group of every key seen, or the default where no value is left."""
    medians = exact_quantiles(df, keys, value, {name: 0.5}).drop("_n")
    return df.select(*keys).distinct().join(medians, list(keys), "left").fillna(default, subset=[name])


def correlation(left: Column, right: Column) -> Column:
    """Aggregate: Pearson correlation, null where a side does not vary."""
    both = left.isNotNull() & right.isNotNull()
    a, b = F.when(both, left), F.when(both, right)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def safe_correlation(df: DataFrame, keys: Sequence[str], left: str, right: str, name: str = "correlation") -> DataFrame:
    """Correlation per group, null where a side has fewer than two distinct values."""
    return df.groupBy(*keys).agg(correlation(F.col(left), F.col(right)).alias(name))


def sampler_rollup(stats: DataFrame, keys: Sequence[str] = ("fit_id",), max_depth: int = 10) -> DataFrame:
    """Divergences, deepest tree and depth hits of a table of sampler statistics."""
    return stats.groupBy(*keys).agg(
        F.sum(F.col("diverging").cast("int")).alias("divergences"), F.max("tree_depth").alias("max_tree_depth"),
        F.count_if(F.col("tree_depth") >= max_depth).alias("max_tree_depth_hits"), F.count_distinct("chain").alias("chains"),
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each group by a total order (the limit is also applied
    before the shuffle, so a hot group sends k rows per task)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


# --------------------------------------------------------------------- gates


def research_gate(research: DataFrame, health: Sequence[str] = (), min_ts: str = "2024-01-01", unfilled: DataFrame | None = None) -> DataFrame:
    """Per subject and parameter: evidence counts, identifiability and gate.

    Wearable availability is measured on ``unfilled``, the frame before missing values became 0.
    """
    positive = lambda c: F.count_if(yes(F.col(c) > 0))
    available = reduce(lambda a, b: a + b, [F.count(c) for c in health]) / (F.count(F.lit(1)) * len(health)) if health else F.lit(0.0)
    facts = research.groupBy(KEY).agg(
        F.count_if(F.col("ts") < F.lit(min_ts).cast("timestamp_ntz")).alias("issues"), positive("explicit_meal_event").alias("direct_meal_rows"),
        positive("meal_proxy_event").alias("proxy_meal_rows"), positive("basal_context").alias("basal_context_rows"),
        positive("correction_context").alias("correction_context_rows"), F.count_if(F.col("bolus_proxy_class") == "ambiguous").alias("ambiguous"),
    ).join((research if unfilled is None else unfilled).groupBy(KEY).agg(available.alias("wearable_availability")), KEY, "left")
    meal, proxy, basal = F.col("direct_meal_rows"), F.col("proxy_meal_rows"), F.col("basal_context_rows")
    wearable = F.lit(bool(health))
    none, weak, off = F.lit("not_identified"), F.lit("weakly_identified"), F.lit("diagnostics_only")
    seen, on = F.lit("directly_observed"), F.lit("research_enabled")
    rows = F.array(
        F.struct(
            F.lit("basal").alias("parameter"),
            F.when((basal >= 96) & (F.col("issues") == 0), seen).when(basal >= 48, weak).otherwise(none).alias("identifiability"),
            F.when((basal >= 96) & (F.col("issues") == 0), on).otherwise(off).alias("gate_status"),
        ),
        F.struct(
            F.lit("I/C ratio").alias("parameter"),
            F.when(meal >= 48, seen).when(proxy >= 48, "proxy_supported").otherwise(none).alias("identifiability"),
            F.when(meal >= 48, on).otherwise(off).alias("gate_status"),
        ),
        F.struct(
            F.lit("sensitivity factor").alias("parameter"),
            F.when((F.col("correction_context_rows") >= 48) & wearable, weak).otherwise(none).alias("identifiability"), off.alias("gate_status"),
        ),
    )
    out = facts.withColumns(
        {
            "source_quality_status": F.when(F.col("issues") > 0, "degraded").otherwise("good"),
            "closed_loop_confounding_risk": F.when(meal > 0, "moderate").when((proxy > 0) | (F.col("ambiguous") > 0), "high").otherwise("moderate"),
            "wearable_alignment_status": F.when(wearable & (F.col("wearable_availability") >= 0.1), "credible").when(wearable, "limited").otherwise("absent"),
            "_row": F.explode(rows),
        }
    )
    return out.select(KEY, "_row.*", "source_quality_status", "direct_meal_rows", "proxy_meal_rows", "basal_context_rows", "correction_context_rows",
                      "closed_loop_confounding_risk", "wearable_alignment_status")


def overnight_evidence(research: DataFrame) -> DataFrame:
    """Is there enough clean overnight data?  One row per subject with overnight rows."""
    night = research.filter(F.col("therapy_segment") == "overnight").withColumn("_day", F.col("ts").cast("date"))
    clean = F.col("basal_context") == 1
    out = night.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("overnight_rows"), F.count_if(clean).alias("clean_rows"), F.count_distinct("_day").alias("overnight_nights"),
        F.count_distinct(F.when(clean, F.col("_day"))).alias("clean_nights"), F.count_distinct(F.when(clean, F.col("therapy_stable_epoch"))).alias("stable_epochs"),
        F.avg(F.when(clean, F.col("glucose"))).alias("mean_glucose"), F.avg(F.when(clean, F.col("target_delta"))).alias("mean_target_delta"),
        F.sum("recent_meal_120m").alias("excl_recent_meal"), F.sum("recent_bolus_120m").alias("excl_recent_bolus"),
        F.sum("recent_exercise_context").alias("excl_recent_exercise"), F.sum("closed_loop_confounding_flag").alias("excl_transition"),
        F.count_if(F.col("missing_cgm") > 0).alias("excl_missing_cgm"),
    )
    strong = (F.col("clean_rows") >= 72) & (F.col("clean_nights") >= 3) & (F.col("stable_epochs") >= 2)
    weak = (F.col("clean_rows") >= 36) & (F.col("clean_nights") >= 2)
    return out.withColumns(
        {
            "status": F.when(strong, "identifiable").when(weak, "weakly_identifiable").otherwise("blocked"),
            "reason": F.when(strong, "").when(weak, "limited_clean_overnight_windows").otherwise("insufficient_clean_overnight_windows"),
        }
    )
