"""Pump kinds plus wearable context: the prepared dataset and its report."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import reasons
from pulsegrid.operators import grid as G
from pulsegrid.operators.audit import backfill_need, intersect_spans
from pulsegrid.operators.context import health_names
from pulsegrid.plans.feature_frame import TARGET, FeatureConfig, feature_names, full_grid, kind_spans

KEY = "subject_id"
HEALTH_TIMES = {
    "health_activity": ("ts",), "measurements": ("ts",), "sleep": ("sleep_start", "sleep_end"), "workouts": ("start_ts", "end_ts"),
}


@dataclass
class PreparedDataset:
    frame: DataFrame
    feature_columns: list[str]
    pump_columns: list[str]
    health_columns: list[str]
    config: FeatureConfig
    target_column: str = TARGET
    full_grid: DataFrame | None = None

    @property
    def mode(self) -> str:
        return "wearable_enriched" if self.health_columns else "pump_only"


def prepared_grid(
    data: Mapping[str, DataFrame], health: Mapping[str, DataFrame] | None, config: FeatureConfig = FeatureConfig(), *, targets_only: bool = False
) -> DataFrame:
    """Every bin with features, wearable context and meal truth; features filled with 0."""
    grid = full_grid(data, config, health, targets_only=targets_only)
    return grid.fillna(0, subset=[n for n in feature_names(grid.columns) if n != "glucose"])


def prepared_rows(data: Mapping[str, DataFrame], health: Mapping[str, DataFrame] | None, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The rows with glucose and target of :func:`prepared_grid`, without making the rest of the grid."""
    return prepared_grid(data, health, config, targets_only=True).dropna(subset=["glucose", TARGET])


def from_grid(grid: DataFrame, has_health: bool, config: FeatureConfig = FeatureConfig()) -> PreparedDataset:
    """The dataset of a (stored) prepared grid: rows with glucose and target."""
    pump = feature_names(grid.columns)
    names = health_names(grid.columns) if has_health else []
    frame = grid.dropna(subset=["glucose", TARGET])
    return PreparedDataset(frame=frame, feature_columns=pump + names, pump_columns=pump, health_columns=names, config=config, full_grid=grid)


def build_prepared_dataset(
    data: Mapping[str, DataFrame], health: Mapping[str, DataFrame] | None, config: FeatureConfig = FeatureConfig()
) -> PreparedDataset:
    """Feature rows with wearable context (when given) and meal truth."""
    return from_grid(prepared_grid(data, health, config), bool(health), config)


def fill_health(dataset: PreparedDataset) -> DataFrame:
    """Zeros for missing wearable values; measure availability before this."""
    return dataset.frame.fillna(0, subset=dataset.health_columns) if dataset.health_columns else dataset.frame


def health_spans(health: Mapping[str, DataFrame], pump: DataFrame) -> DataFrame:
    """First and last wearable time per subject; without wearables no row (``pump`` gives the columns)."""
    names = [n for n in HEALTH_TIMES if n in health]
    if not names:
        return pump.filter(F.lit(False))
    return G.span([health[n] for n in names], [HEALTH_TIMES[n] for n in names])


def preparation_report(
    data: Mapping[str, DataFrame], health: Mapping[str, DataFrame], frame: DataFrame, *, history_days: int = 365, min_history_days: int = 180
) -> DataFrame:
    """One row per subject: spans, overlap, backfill need, final span and warnings."""
    pump = kind_spans(data)
    wear = health_spans(health, pump)
    final = frame.groupBy(KEY).agg(
        F.min("ts").alias("final_start"), F.max("ts").alias("final_end"), F.count(F.lit(1)).alias("final_row_count")
    )
    out = (
        pump.withColumnsRenamed({"first_ts": "pump_start", "last_ts": "pump_end"})
        .join(wear.withColumnsRenamed({"first_ts": "wearable_start", "last_ts": "wearable_end"}), KEY, "full")
        .join(intersect_spans(wear, pump), KEY, "left").join(backfill_need(pump, wear, history_days), KEY, "left").join(final, KEY, "left")
    )
    days = F.datediff(F.col("final_end").cast("date"), F.col("final_start").cast("date")) + 1
    return out.withColumns(
        {
            "final_row_count": F.coalesce("final_row_count", F.lit(0)),
            "warnings": reasons(
                ("short_history", days < min_history_days), ("empty_dataset", F.col("final_row_count").isNull()),
            ),
        }
    )
