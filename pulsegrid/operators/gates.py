"""Policy, readiness, promotion and status gates on small result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import finite, reasons
from pulsegrid.functions.times import seconds_between
from pulsegrid.operators.proxies import yes
from pulsegrid.operators.timeline import HOUR, scan

LEVELS = ("diagnostics_only", "research_only", "published_latest", "default_trusted")


def sampler_failed(rhat: float, ess: float, *, depth: bool) -> Column:
    """Sampler health by the given strictness (R-hat above, effective size below)."""
    bad = yes(F.col("rhat_max") > rhat) | yes(F.col("ess_bulk_min") < ess) | yes(F.col("divergences") > 0)
    return bad | yes(F.col("max_tree_depth_hits") > 0) if depth else bad


def recommendation_policy(facts: DataFrame, *, rhat: float = 1.01, ess: float = 200.0) -> DataFrame:
    """May recommendations be made?  One row in, one row out.

    Needs n_folds, min_test_rows, coverage, mae, persistence_mae, quality_status,
    chains, divergences, max_tree_depth_hits, rhat_max, ess_bulk_min,
    ess_tail_min, carbs_present, activity_present.
    """
    none = F.col("n_folds").isNull()
    validation = (
        ("walk_forward_missing", none), ("walk_forward_insufficient_folds", yes(F.col("n_folds") < 2)),
        ("walk_forward_small_test_fold", yes(F.col("min_test_rows") < 200)),
        ("coverage_out_of_range", ~none & ~yes(F.col("coverage").between(0.70, 0.90))),
        ("mae_not_meaningfully_better_than_persistence", ~none & ~yes(F.col("mae") <= 0.90 * finite(F.col("persistence_mae")))),
        ("data_incomplete", yes(F.col("quality_status") != "good")),
    )
    sampler = (
        ("sampler_chains_lt_2", F.col("chains").isNull() | (F.col("chains") < 2)), ("sampler_divergences", yes(F.col("divergences") > 0)),
        ("sampler_max_treedepth_hits", yes(F.col("max_tree_depth_hits") > 0)), ("sampler_rhat_too_high", yes(F.col("rhat_max") > rhat)),
        ("sampler_ess_too_low", yes(F.col("ess_bulk_min") < ess) | yes(F.col("ess_tail_min") < ess)),
    )
    signal = (("missing_carbs", ~yes(F.col("carbs_present"))), ("low_signal", ~yes(F.col("activity_present"))))
    out = facts.withColumns(
        {
            "reasons": reasons(*validation, *sampler, *signal), "validation_passed": F.size(reasons(*validation)) == 0,
            "sampler_passed": F.size(reasons(*sampler)) == 0,
            "allowed_settings": F.when(yes(F.col("carbs_present")), F.array(F.lit("basal"), F.lit("bolus"), F.lit("I/C ratio"))).otherwise(F.array(F.lit("basal"))),
        }
    )
    ok = F.col("validation_passed") & F.col("sampler_passed")
    return out.withColumn("status", F.when(ok, "generated").otherwise("suppressed"))


def readiness(artifacts: DataFrame) -> DataFrame:
    """Trust level of each artifact.

    Needs source_quality_status, validation_passed, reproducible, generated_at,
    now, freshness_seconds (nullable), publication_allowed, default_trusted_allowed.
    """
    stale = yes(seconds_between("now", "generated_at") > F.col("freshness_seconds"))
    hard = (
        ("source_quality_not_good", F.coalesce(F.col("source_quality_status") != "good", F.lit(True))),
        ("validation_not_passed", ~yes(F.col("validation_passed"))), ("not_reproducible", ~yes(F.col("reproducible"))),
    )
    out = artifacts.withColumns({"blocked": F.size(reasons(*hard)) > 0, "stale": stale, "reasons": reasons(*hard, ("stale_artifact", stale))})
    level = (
        F.when(F.col("blocked"), LEVELS[0]).when(F.col("stale"), LEVELS[1]).when(yes(F.col("default_trusted_allowed")), LEVELS[3])
        .when(yes(F.col("publication_allowed")), LEVELS[2]).otherwise(LEVELS[1])
    )
    out = out.withColumn("trust_level", level)
    return out.withColumns(
        {"publish_latest": F.col("trust_level").isin(LEVELS[2], LEVELS[3]), "default_trusted": F.col("trust_level") == LEVELS[3]}
    )


def promotion(decisions: DataFrame, keys: Sequence[str], run_time: str, order: Sequence[str] = ()) -> DataFrame:
    """Compare each run's trust level with the run before it."""
    order_of = lambda c: F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c) - 1
    out = scan(decisions, keys=keys, ts=run_time, order=order, chunk_seconds=HOUR, prev={"previous_level": F.col("trust_level")})
    now, before = order_of(F.col("trust_level")), order_of(F.col("previous_level"))
    first = F.col("previous_level").isNull()
    return out.withColumns({"promoted": first | yes(now > before), "demoted": ~first & yes(now < before)}).withColumn(
        "changed", F.col("promoted") | F.col("demoted")
    )


# Next step for each blocker.
NEXT_ACTIONS = {
    "insufficient_clean_overnight_windows": "collect_clean_overnight_windows",
    "high_closed_loop_confounding": "inspect_closed_loop_activity",
    "degraded_source_quality": "repair_source_windows",
    "insufficient_carb_or_meal_signal": "capture_meal_evidence",
    "weak_forecast_validation": "treat_forecast_as_untrusted",
    "sampler_diagnostics_failure": "fix_sampler_diagnostics",
}


def current_status(facts: DataFrame) -> DataFrame:
    """Overall state, blockers and next actions; one row per subject.

    Needs overnight_status, confounding_risk, research_quality_status,
    direct_meal_rows, proxy_meal_rows, data_quality_status, model_mae,
    persistence_mae, coverage, rhat_max, ess_bulk_min, divergences,
    max_tree_depth_hits, candidate_count.
    """
    weak = F.col("model_mae").isNull() | F.col("persistence_mae").isNull() | (F.col("model_mae") >= F.col("persistence_mae")) | yes(F.col("coverage") < 0.65)
    pairs = (
        ("insufficient_clean_overnight_windows", yes(F.col("overnight_status") == "blocked")),
        ("high_closed_loop_confounding", yes(F.col("confounding_risk") == "high")),
        ("degraded_source_quality", yes(F.col("research_quality_status").isin("degraded", "failed")) | F.coalesce(F.col("data_quality_status") != "good", F.lit(True))),
        ("insufficient_carb_or_meal_signal", yes((F.col("direct_meal_rows") == 0) & (F.col("proxy_meal_rows") < 48))),
        ("weak_forecast_validation", weak), ("sampler_diagnostics_failure", sampler_failed(1.1, 100.0, depth=False)),
    )
    out = facts.withColumn("blockers", reasons(*pairs))
    actions = F.create_map(*[F.lit(x) for pair in NEXT_ACTIONS.items() for x in pair])
    clear = F.size("blockers") == 0
    state = F.when(~clear, "blocked").when(F.col("candidate_count") > 0, "recommendation_ready").otherwise("no_change_supported")
    todo = F.when(~clear, F.transform("blockers", lambda b: F.element_at(actions, b))).when(F.col("candidate_count") > 0, F.array(F.lit("review_candidate"))).otherwise(F.array(F.lit("keep_monitoring")))
    return out.withColumns({"overall_state": state, "next_actions": todo})
