"""Segment evidence and recommendations from the selected models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import models as M
from pulsegrid.operators import scenarios as S
from pulsegrid.operators import validate as V
from pulsegrid.session import cut_lineage

OUT = (
    "task", "parameter", "segment", "status", "proposed_change_percent", "expected_direction", "mean_expected_gain", "fold_better_fraction", "confidence",
    "reasons_for", "reasons_against", "identifiability", "selected_model",
)
REASON_FOR = "predicted safety-weighted loss improved on held-out folds"


def scored_changes(research: DataFrame, task: str, context: str, selected: DataFrame, features: Sequence[str], keys: Sequence[str], segments: Sequence[str], *, order: Sequence[str] = (), horizon_seconds: int = 1800, min_rows: int = 40) -> tuple[DataFrame, DataFrame] | None:
    """Test rows of the selected models (``base_pred``) and the same rows under every segment change (``pred``); None without a model.

    ``selected``: keys and ``model_name``.
    """
    by, min_train = [*keys, "fold"], max(len(features) + 5, 20)
    folds = V.task_folds(research, context, keys, order=order, horizon_seconds=horizon_seconds, min_rows=min_rows)
    fits = None
    for (family,) in selected.select("model_name").distinct().collect():  # as many as there are families
        theirs = M.lookup(folds, selected.filter(F.col("model_name") == family).select(*keys), keys, "_i", "left_semi")
        found = V.fitted_models(family, theirs, keys, features, "target_delta", min_train)
        fits = found if fits is None else fits.unionByName(found)
    if fits is None:
        return None
    sizes = V.fold_sizes(folds, keys).filter(F.col("n_test") >= V.MIN_TEST).select(*by)
    rows = M.lookup(V.test_rows(folds), cut_lineage(fits.join(sizes, by)), by, "_i")
    pred = F.col("glucose") + V.model_prediction(features)
    test = cut_lineage(rows.withColumn("base_pred", pred))
    changed = S.segment_scenarios(test, task, segments).withColumn("pred", pred)
    return test.drop("parts"), changed.drop("parts")


def segment_results(
    research: DataFrame, gate: DataFrame, comparison: DataFrame, features: Sequence[str], keys: Sequence[str], *, segments: Sequence[str],
    order: Sequence[str] = (), horizon_seconds: int = 1800, min_rows: int = 40, exploratory: Sequence[str] = ("icr",),
) -> tuple[DataFrame, DataFrame]:
    """(evidence, recommendations): one recommendation per key, task and segment, with every reason against it.

    ``research`` holds the doses of each segment (``ia__<segment>``, ...) where
    the dose task shall change what is left of them.  Staged tasks, tasks
    without a selected model and segments without enough test rows have rows
    that say so.
    """
    keys = list(keys)
    chosen = cut_lineage(comparison.filter("selected").select(*keys, "task", "model_name", "safety_weighted_mae", "coverage"))
    spots = cut_lineage(research.select(*keys).distinct()).withColumn("segment", F.explode(F.array(*[F.lit(s) for s in segments])))
    evidence, results = [], []
    for task, parameter, context, staged in V.TASKS:
        facts = gate.filter(F.col("parameter") == parameter).select(*keys, "gate_status", "identifiability")
        model = chosen.filter(F.col("task") == task)
        found = None if staged else scored_changes(research, task, context, model, features, keys, segments, order=order, horizon_seconds=horizon_seconds, min_rows=min_rows)
        grid = spots.join(facts.select(*keys, F.coalesce("identifiability", F.lit("weakly_identified")).alias("identifiability")), keys, "left").fillna("weakly_identified", ["identifiability"])
        grid = grid.join(model.select(*keys, F.col("model_name").alias("selected_model")), keys, "left")
        label = {"task": F.lit(task), "parameter": F.lit(parameter)}
        if found:
            test, changed = found
            seen = S.segment_evidence(test, keys).join(facts, keys, "left").join(model.select(*keys, F.col("model_name").alias("selected_model")), keys, "left")
            evidence.append(seen.withColumns(label))
            gains = cut_lineage(S.segment_gains(changed, keys))
            advice = S.segment_recommendations(gains, keys, facts, model.select(*keys, "safety_weighted_mae", "coverage"), task=task, exploratory=task in exploratory)
            advice = advice.select(*keys, "segment", "status", "proposed_change_percent", "expected_direction", "mean_expected_gain", "fold_better_fraction", "confidence", F.array_join("reasons_against", ",").alias("reasons_against"))
        else:
            none = "segment string, status string, proposed_change_percent double, expected_direction string, mean_expected_gain double, fold_better_fraction double, confidence string, reasons_against string"
            advice = research.sparkSession.createDataFrame([], M.T.StructType([*[research.schema[k] for k in keys], *M.T.StructType.fromDDL(none).fields]))
        missing = F.lit("staged_parameter") if staged else F.when(F.col("selected_model").isNull(), "insufficient_data_or_model").otherwise("insufficient_segment_evidence")
        out = grid.join(advice, [*keys, "segment"], "left").withColumns(label)
        out = out.withColumns(
            {
                "reasons_for": F.when(F.col("status").isNotNull(), REASON_FOR).otherwise(""),
                "reasons_against": F.coalesce("reasons_against", missing),
                "expected_direction": F.coalesce("expected_direction", F.lit("")),
                "confidence": F.coalesce("confidence", F.lit("staged" if staged else "low")),
                "status": F.coalesce("status", F.lit("suppressed")),
            }
        )
        results.append(out.select(*keys, *OUT))
    stack = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(stack(frames[1:]))
    if not evidence:
        return S.segment_evidence(research.limit(0).withColumn("fold", F.lit(0)), keys), stack(results)
    return stack(evidence), stack(results)
