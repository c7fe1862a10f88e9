"""Whole flows: compositions of the operators, one function per command."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import parse_segments
from pulsegrid.operators import audit, cohorts, gates, latent, profile, scenarios, validate
from pulsegrid.operators.proxies import research_frame
from pulsegrid.plans.feature_frame import FeatureConfig
from pulsegrid.plans.prepared import PreparedDataset, build_prepared_dataset, fill_health, preparation_report
from pulsegrid.plans.segments import segment_results
from pulsegrid.session import cut_lineage
from pulsegrid.sources.files import load_exports

KEY = "subject_id"


def ingest(spark: SparkSession, tables: Mapping[str, str], *, zone: str = "UTC") -> dict[str, DataFrame]:
    """Raw files to kinds, their manifest and its summary."""
    kinds = load_exports(spark, tables, zone=zone)
    times = None
    for kind, df in kinds.items():
        columns = ("start_ts", "end_ts") if kind == "basal" else ("ts",)
        for i, c in enumerate(columns):
            part = df.select(KEY, F.lit(kind).alias("kind"), "source_file", F.col(c).alias("ts"), F.lit(int(i == 0)).alias("row_weight"))
            times = part if times is None else times.unionByName(part)
    manifest = cut_lineage(audit.export_manifest(times, (KEY, "kind", "source_file")))
    # files count as exported in the order in which they were named
    ordered = manifest.withColumn("source_order", F.array_position(F.array(*[F.lit(t) for t in tables]), "source_file"))
    return {**kinds, "manifest": manifest, "manifest_summary": audit.manifest_summary(ordered), "quality": audit.quality_from_manifest(manifest)}


def prepare(data: Mapping[str, DataFrame], health: Mapping[str, DataFrame], config: FeatureConfig = FeatureConfig()) -> tuple[PreparedDataset, DataFrame]:
    """Prepared dataset and the report on its spans."""
    dataset = build_prepared_dataset(data, health, config)
    dataset.frame = cut_lineage(dataset.frame)
    return dataset, preparation_report(data, health, dataset.frame)


def forecast(dataset: PreparedDataset, policy_facts: DataFrame, *, folds: int = 4) -> dict[str, DataFrame]:
    """Walk-forward report, scenario losses, policy and ranked recommendations per subject."""
    config, frame, features = dataset.config, dataset.frame, dataset.feature_columns
    blocks = validate.fold_columns(frame, [KEY], horizon_seconds=config.horizon_minutes * 60, folds=folds)
    scored = validate.linear_walk(blocks, [KEY], features, dataset.target_column)
    report = cut_lineage(validate.walk_forward_report(scored, [KEY]))
    total = report.filter(F.col("fold") == 0).select(KEY, "coverage", "mae", "persistence_mae")
    per_fold = report.filter(F.col("fold") > 0).groupBy(KEY).agg(F.count(F.lit(1)).alias("n_folds"), F.min("n_test").alias("min_test_rows"))
    policy = cut_lineage(gates.recommendation_policy(policy_facts.join(total, KEY, "left").join(per_fold, KEY, "left")))
    fits = cut_lineage(validate.M.solve(validate.M.gram_sums(frame, [KEY], features, dataset.target_column), [KEY]))
    forecasts = scenarios.scenario_forecasts(frame, fits, [KEY], features, "ts")
    return {
        "walk_forward": report, "policy": policy, "scenario_loss": scenarios.scenario_loss(forecasts, [KEY]),
        "recommendations": scenarios.recommend(forecasts, [KEY], policy),
    }


def research(dataset: PreparedDataset, features: Sequence[str], *, mode: str = "strict", keys: Sequence[str] = (KEY,), families: Sequence[str] = validate.FAMILIES) -> dict[str, DataFrame]:
    """Research frame, gate, registry, audit, report card, model comparison, segment evidence and recommendations."""
    frame = cut_lineage(research_frame(fill_health(dataset), mode=mode))
    registry = profile.feature_registry(frame, dataset.health_columns, unfilled=dataset.frame)
    horizon = dataset.config.horizon_minutes * 60
    gate = cut_lineage(profile.research_gate(frame, dataset.health_columns, unfilled=dataset.frame))
    comparison = cut_lineage(validate.model_comparison(frame, features, keys, families=families, horizon_seconds=horizon))
    segments = [name for name, _, _ in parse_segments()]
    doses = frame
    if dataset.full_grid is not None:
        parts = scenarios.segment_kernels(dataset.full_grid, dataset.config.step_seconds, segments)
        doses = cut_lineage(frame.join(parts, [KEY, "ts"], "left"))
    evidence, advice = segment_results(doses, gate, comparison, features, keys, segments=segments, horizon_seconds=horizon)
    return {
        "research_frame": frame, "research_gate": gate, "feature_registry": registry,
        "feature_families": profile.registry_rollup(registry), "proxy_audit": profile.proxy_audit(frame), "overnight": profile.overnight_evidence(frame),
        "report_card": profile.report_card(dataset.frame, dataset.feature_columns), "model_comparison": comparison,
        "segment_evidence": evidence, "segment_recommendations": advice,
    }


def latent_exposure(research: DataFrame, rules: cohorts.CleanWindowRules = cohorts.CleanWindowRules(), *, scope: str = "full", step_seconds: int = 300) -> dict[str, DataFrame]:
    """Meal events, clean windows, exclusions and (scope ``full``) the latent estimates."""
    events = cut_lineage(cohorts.meal_events(research))
    windows = cut_lineage(cohorts.clean_windows(research, rules))
    out = {
        "meal_events": events, "windows": windows, "gate": latent.cohort_gate(windows, research),
        "exclusions": cohorts.exclusion_summary(windows).unionByName(cohorts.subjects_without_candidates(research, windows)),
    }
    if scope == "foundation":
        return out
    metrics = cut_lineage(cohorts.window_metrics(research, events, windows, rules, step_seconds).withColumn("meal_id", F.col("candidate_id")))
    comparison = cut_lineage(latent.compare_estimators(metrics))
    estimates = cut_lineage(latent.latent_events(metrics, comparison.filter("selected")))
    return {**out, "metrics": metrics, "comparison": comparison, "latent_events": estimates, "full_gate": latent.full_gate(windows, estimates, research)}
