"""What-if scenarios: scaled settings, forecast loss, recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import reasons, risk_score, segment_columns
from pulsegrid.operators import grid as G
from pulsegrid.operators import models as M
from pulsegrid.operators.kernels import kernel_per_bin

KEY = "subject_id"


@dataclass(frozen=True)
class Scenario:
    name: str
    basal: float = 1.0
    bolus: float = 1.0
    icr: float = 1.0

    @property
    def setting(self) -> str:
        return "basal" if self.basal != 1 else "bolus" if self.bolus != 1 else "I/C ratio"

    @property
    def multiplier(self) -> float:
        return self.basal if self.basal != 1 else self.bolus if self.bolus != 1 else self.icr


CURRENT = Scenario("current")
SCENARIOS = (
    CURRENT, Scenario("basal_minus_10", basal=0.9), Scenario("basal_plus_10", basal=1.1), Scenario("bolus_minus_10", bolus=0.9),
    Scenario("bolus_plus_10", bolus=1.1), Scenario("icr_plus_10", icr=1.1), Scenario("icr_minus_10", icr=0.9),
)


def apply_scenarios(df: DataFrame, scenarios: Sequence[Scenario] = SCENARIOS) -> DataFrame:
    """Every row once per scenario with scaled doses and what follows from them.

    The dose kernel is linear, so scaling every dose by m scales remaining dose,
    activity, their rolling sums and products by m: no expansion is redone, and
    doses that lie in dropped rows are not lost.
    """
    have, structs = df.columns, []
    for s in scenarios:
        structs.append(F.struct(
            F.lit(s.name).alias("scenario"), F.lit(s.setting).alias("setting"), F.lit(s.multiplier).alias("multiplier"),
            F.lit(s.basal).alias("_basal"), F.lit(s.bolus * s.icr).alias("_dose"),
        ))
    out = df.withColumn("_s", F.explode(F.array(*structs))).select(*have, "_s.*")
    basal = [c for c in ("basal_units_per_hour", "basal_units_delivered") if c in have]
    dose = [c for c in have if c in ("bolus_units", "insulin_activity_units", "iob_units", "carb_bolus_interaction_60m", "carb_iob_interaction_60m") or c.startswith("iob_roll_sum_")]
    return out.withColumns({**{c: F.col(c) * F.col("_basal") for c in basal}, **{c: F.col(c) * F.col("_dose") for c in dose}}).drop("_basal", "_dose")


def scenario_forecasts(df: DataFrame, fits: DataFrame, keys: Sequence[str], features: Sequence[str], spread: str, scenarios: Sequence[Scenario] = SCENARIOS) -> DataFrame:
    """Rows × scenarios with ``pred`` of the keyed fits and ``current_pred`` of today's settings."""
    joined = M.lookup(df, fits.select(*keys, "slope", "intercept"), keys, spread)
    out = apply_scenarios(joined.withColumn("current_pred", M.linear_prediction(features)), scenarios)
    return out.withColumn("pred", M.linear_prediction(features)).drop("slope", "intercept")


def scenario_loss(forecasts: DataFrame, keys: Sequence[str], target: str = "target_glucose") -> DataFrame:
    """Mean distance of forecast and observed future per scenario."""
    return forecasts.groupBy(*keys, "scenario", "setting", "multiplier").agg(
        F.avg(F.abs(F.col("pred") - F.col(target))).alias("expected_loss"), F.count(F.lit(1)).alias("rows")
    )


def recommend(
    forecasts: DataFrame, keys: Sequence[str], policy: DataFrame, *, target_bg: float = 110.0, min_gain: float = 5.0
) -> DataFrame:
    """Scenarios that beat the current settings, ranked by gain.

    ``policy``: keys, ``status``, ``carbs_present``, ``activity_present``.  The
    probability is the share of rows nearer to the target than today.
    """
    better = F.abs(F.col("pred") - target_bg) < F.abs(F.col("current_pred") - target_bg)
    rows = forecasts.withColumn("_better", better.cast("int"))
    loss = rows.groupBy(*keys, "scenario", "setting", "multiplier").agg(
        F.avg(F.abs(F.col("pred") - F.col("target_glucose"))).alias("expected_loss"), F.avg("_better").alias("probability_better")
    )
    base = F.max(F.when(F.col("scenario") == "current", F.col("expected_loss"))).over(Window.partitionBy(*keys))
    out = loss.withColumn("expected_gain", base - F.col("expected_loss")).filter((F.col("scenario") != "current") & (F.col("expected_gain") >= min_gain))
    out = out.join(policy.select(*keys, "status", "carbs_present", "activity_present"), list(keys)).filter(F.col("status") == "generated")
    out = out.filter(F.col("carbs_present") | (F.col("setting") == "basal"))
    p = F.col("probability_better")
    confidence = F.when(~F.col("activity_present"), "low").when(p >= 0.9, "high").when(p >= 0.75, "moderate").otherwise("low")
    flags = reasons(("low_signal", ~F.col("activity_present")), ("missing_carbs", ~F.col("carbs_present")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("expected_gain"), "scenario"))
    return out.select(
        *keys, "setting", F.when(F.col("multiplier") < 1, "decrease").otherwise("increase").alias("direction"),
        F.round(F.abs(F.col("multiplier") - 1) * 100, 6).alias("change_percent"), "expected_gain", "probability_better",
        F.col("scenario").alias("scenario_name"), confidence.alias("confidence"), flags.alias("flags"), rank.alias("rank"),
    )


# ------------------------------------------------------------ segment changes

CHANGES = (-10.0, -5.0, 5.0, 10.0)


def segment_kernels(grid: DataFrame, step_seconds: int, segments: Sequence[str], windows: Sequence[int] = (60, 120), chunk_seconds: int = G.WEEK) -> DataFrame:
    """Activity and remaining dose that stem from each segment's own doses.

    ``grid``: every bin with ``bolus_units``.  Columns ``ia__<segment>``,
    ``iob__<segment>`` and ``iob_roll_sum_<m>m__<segment>``.
    """
    doses = grid.filter(F.col("bolus_units") > 0).withColumns({"therapy_segment": segment_columns("ts")["therapy_segment"]})
    curve = kernel_per_bin(doses, step=step_seconds // 60, keys=(KEY, "therapy_segment"))
    wide = curve.groupBy(KEY, "ts").agg(*[
        F.sum(F.when(F.col("therapy_segment") == s, F.col(src))).alias(f"{name}__{s}")
        for s in segments for src, name in (("insulin_activity_units", "ia"), ("iob_units", "iob"))
    ])
    cols = [f"{n}__{s}" for s in segments for n in ("ia", "iob")]
    out = G.assemble(grid.select(KEY, "ts"), [wide]).fillna(0.0, subset=cols)
    make = lambda w: {f"iob_roll_sum_{m}m__{s}": G.rolling(w, f"iob__{s}", m, step_seconds) for s in segments for m in windows}
    return G.bounded(out, make, back_seconds=max(windows) * 60, chunk_seconds=chunk_seconds)


def segment_scenarios(df: DataFrame, task: str, segments: Sequence[str], changes: Sequence[float] = CHANGES) -> DataFrame:
    """Every row once per (segment, change): only that segment's settings change.

    For ``icr`` the remaining dose changes by the part that stems from the
    segment's doses (see :func:`segment_kernels`), wherever it acts.
    """
    have = df.columns
    pairs = F.array(*[F.struct(F.lit(s).alias("change_segment"), F.lit(c).alias("change_percent")) for s in segments for c in changes])
    out = df.withColumn("_c", F.explode(pairs)).select(*have, "_c.*")
    inside, m = F.col("therapy_segment") == F.col("change_segment"), F.col("change_percent") / 100.0
    if task == "basal":
        cols = {c: F.when(inside, F.col(c) * (1 + m)).otherwise(F.col(c)) for c in ("basal_units_per_hour", "basal_units_delivered") if c in have}
        return out.withColumns(cols)
    part = lambda stem: F.coalesce(*[F.when(F.col("change_segment") == s, F.col(f"{stem}__{s}")) for s in segments])
    cols: dict[str, Column] = {"bolus_units": F.when(inside, F.col("bolus_units") * (1 + m)).otherwise(F.col("bolus_units"))}
    for col, stem in (("insulin_activity_units", "ia"), ("iob_units", "iob"), *[(c, c) for c in have if c.startswith("iob_roll_sum_") and "__" not in c]):
        if col in have and f"{stem}__{segments[0]}" in have:
            cols[col] = F.col(col) + m * part(stem)
    out = out.withColumns(cols)
    if "carb_roll_sum_60m" in have:
        out = out.withColumns({"carb_bolus_interaction_60m": F.col("carb_roll_sum_60m") * F.col("bolus_units"), "carb_iob_interaction_60m": F.col("carb_roll_sum_60m") * F.col("iob_units")})
    return out


def segment_gains(scored: DataFrame, keys: Sequence[str], min_rows: int = 3) -> DataFrame:
    """Mean drop in risk per (fold, segment, change); ``base_pred`` and ``pred`` are glucose."""
    rows = scored.filter(F.col("therapy_segment") == F.col("change_segment"))
    gain = risk_score(F.col("base_pred")) - risk_score(F.col("pred"))
    return rows.groupBy(*keys, "fold", F.col("change_segment").alias("segment"), "change_percent").agg(
        F.avg(gain).alias("gain"), F.count(F.lit(1)).alias("segment_rows")
    ).filter(F.col("segment_rows") >= min_rows)


def segment_recommendations(gains: DataFrame, keys: Sequence[str], gate: DataFrame, model: DataFrame, *, task: str, exploratory: bool = False) -> DataFrame:
    """Best change per segment with the reasons against it.

    ``gate``: keys, ``gate_status``, ``identifiability``; ``model``: keys,
    ``safety_weighted_mae``, ``coverage`` of the selected model.
    """
    by = [*keys, "segment"]
    grouped = gains.groupBy(*by, "change_percent").agg(
        F.avg("gain").alias("mean_expected_gain"), F.avg((F.col("gain") > 0).cast("int")).alias("fold_better_fraction"),
        F.stddev("gain").alias("gain_std"), F.count(F.lit(1)).alias("fold_count"),
    )
    best = grouped.groupBy(*by).agg(F.max_by(
        F.struct("change_percent", "mean_expected_gain", "fold_better_fraction", "gain_std", "fold_count"),
        F.struct("mean_expected_gain", "fold_better_fraction", -F.col("change_percent")),
    ).alias("b")).select(*by, "b.*")
    out = best.join(gate, list(keys), "left").join(model, list(keys), "left")
    against = reasons(
        ("model_safety_error_too_high", F.col("safety_weighted_mae") > 25), ("coverage_too_low", F.col("coverage") < 0.65),
        ("gate_diagnostics_only", F.coalesce(F.col("gate_status") != "research_enabled", F.lit(False))),
        ("too_few_folds", F.col("fold_count") < 2),
        ("expected_gain_too_small", F.col("mean_expected_gain") < 1), ("inconsistent_fold_direction", F.col("fold_better_fraction") < 0.6),
    )
    out = out.withColumn("reasons_against", against)
    ok = F.size("reasons_against") == 0
    status = F.when(~ok, "suppressed").otherwise("exploratory" if exploratory else "candidate")
    out = out.withColumns({"task": F.lit(task), "status": status})
    if exploratory:
        out = out.withColumn("reasons_against", F.concat("reasons_against", F.array(F.lit("exploratory_only_policy"))))
    candidate = F.col("status") == "candidate"
    strong = (F.col("fold_better_fraction") >= 0.8) & (F.col("mean_expected_gain") >= 5)
    return out.withColumns(
        {
            "proposed_change_percent": F.when(candidate, F.col("change_percent")),
            "expected_direction": F.when(F.col("change_percent") > 0, "increase").otherwise("decrease"),
            "confidence": F.when(candidate & strong, "high").when(candidate, "moderate").otherwise("low"),
        }
    )


def segment_evidence(test: DataFrame, keys: Sequence[str], min_rows: int = 3) -> DataFrame:
    """What was observed per (fold, segment), rolled up over folds."""
    per = test.groupBy(*keys, "fold", F.col("therapy_segment").alias("segment")).agg(
        F.count(F.lit(1)).alias("split_rows"), F.avg("target_glucose").alias("actual_target_mean"),
        F.avg("target_delta").alias("actual_target_delta_mean"), F.avg((F.col("target_glucose") < 80).cast("int")).alias("low_target_fraction"),
    ).filter(F.col("split_rows") >= min_rows)
    return per.groupBy(*keys, "segment").agg(
        F.sum("split_rows").alias("split_rows"), F.avg("actual_target_mean").alias("actual_target_mean"),
        F.avg("actual_target_delta_mean").alias("actual_target_delta_mean"), F.avg("low_target_fraction").alias("low_target_fraction"),
    )
