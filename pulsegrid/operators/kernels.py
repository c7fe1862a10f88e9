"""Dose kernels on the grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import decay_level, kernel_activity, kernel_remaining
from pulsegrid.functions.times import floor_ts, shift

KEY = "subject_id"


def expand_doses(doses: DataFrame, *, duration: int = 300, step: int = 5, peak: int = 75, dose: str = "bolus_units") -> DataFrame:
    """Each positive dose to its ``duration / step + 1`` later points."""
    t = F.col("minutes").cast("double")
    return (
        doses.filter(F.col(dose) > 0)
        .withColumn("minutes", F.explode(F.sequence(F.lit(0), F.lit(duration), F.lit(step))))
        .withColumns(
            {
                "ts": shift("ts", F.col("minutes") * 60),
                "ia_units": F.col(dose) * kernel_activity(t, duration, peak),
                "iob_units": F.col(dose) * kernel_remaining(t, duration, peak),
            }
        )
    )


def kernel_per_bin(doses: DataFrame, *, duration: int = 300, step: int = 5, peak: int = 75, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Summed activity and remaining dose per bin.

    Doses are summed per instant before they are expanded, so many equal
    doses of one subject cost one expansion.
    """
    merged = doses.filter(F.col("bolus_units") > 0).groupBy(*keys, "ts").agg(F.sum("bolus_units").alias("bolus_units"))
    points = expand_doses(merged, duration=duration, step=step, peak=peak)
    return points.withColumn("ts", floor_ts("ts", step * 60)).groupBy(*keys, "ts").agg(
        F.sum("ia_units").alias("insulin_activity_units"), F.sum("iob_units").alias("iob_units")
    )


def decay_per_point(doses: DataFrame, *, duration: int = 300, step: int = 5) -> DataFrame:
    """Older exponential-decay curve of each dose, one row per point."""
    return doses.withColumn("minutes", F.explode(F.sequence(F.lit(0), F.lit(duration), F.lit(step)))).withColumn(
        "level", decay_level(F.col("bolus_units"), F.col("minutes").cast("double"), float(duration))
    )
