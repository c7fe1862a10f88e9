"""Interval tables on a grid: overlap, point-in-interval, rate per bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.times import DAY, epoch_seconds, floor_ts, from_epoch_seconds, minutes_between, shift
from pulsegrid.operators.timeline import HOUR, scan

KEY = "subject_id"


def explode_bins(df: DataFrame, step_seconds: int, start: str = "start_ts", end: str = "end_ts", only: DataFrame | None = None) -> DataFrame:
    """One row per bin that ``[start, end)`` touches, as ``ts``.

    The interval join becomes an equi-join on the bin.  Long intervals are cut
    into days first, so no row carries a large array.  With ``only`` (subject,
    ``ts``) just these bins are made, and each interval's first and last one:
    days of intervals meet the wanted bins of that day.
    """
    lo, hi = epoch_seconds(floor_ts(start, step_seconds)), epoch_seconds(end)
    last = F.when(from_epoch_seconds(hi) < F.col(end), hi).otherwise(hi - 1)
    cut = (
        df.filter(F.col(end) > F.col(start))
        .withColumns({"_lo": lo, "_last": last})
        .withColumn("_day", F.explode(F.sequence(F.floor(F.col("_lo") / DAY), F.floor(F.col("_last") / DAY))))
    )
    # the first bin of the grid at or after midnight; the step need not divide a day
    midnight = F.greatest(F.col("_lo"), F.col("_day") * DAY)
    first = midnight + F.pmod(F.col("_lo") - midnight, F.lit(step_seconds))
    to = F.least(F.col("_last"), (F.col("_day") + 1) * DAY - 1)
    if only is None:
        days, bins = cut.filter(first <= to), F.sequence(first, to, F.lit(step_seconds).cast("bigint"))
    else:
        ends = df.filter(F.col(end) > F.col(start)).select(KEY, lo.alias("_lo"), last.alias("_last"))
        ends = ends.select(KEY, F.explode(F.array("_lo", F.col("_last") - F.pmod(F.col("_last") - F.col("_lo"), F.lit(step_seconds)))).alias("_s"))
        wanted = only.select(KEY, epoch_seconds("ts").alias("_s")).unionByName(ends).groupBy(KEY, F.floor(F.col("_s") / DAY).alias("_day"))
        # at most a day's bins
        wanted = wanted.agg(F.collect_set("_s").alias("_wanted"))
        days = cut.withColumns({"_first": first, "_to": to}).join(wanted.hint("merge"), [KEY, "_day"])
        bins = F.filter("_wanted", lambda s: (s >= F.col("_first")) & (s <= F.col("_to")))
    return days.withColumn("_s", F.explode(bins)).withColumn("ts", from_epoch_seconds(F.col("_s"))).drop("_lo", "_last", "_day", "_s", "_wanted", "_first", "_to")


def overlap_minutes(step_seconds: int, start: str = "start_ts", end: str = "end_ts") -> Column:
    """Minutes of ``[start, end)`` inside the bin that begins at ``ts``."""
    return minutes_between(F.least(shift("ts", step_seconds), F.col(end)), F.greatest(F.col("ts"), F.col(start)))


def interval_overlap(intervals: DataFrame, step_seconds: int, start: str = "start_ts", end: str = "end_ts", only: DataFrame | None = None) -> DataFrame:
    """Each interval with every bin it touches (``only``: see :func:`explode_bins`) and the overlap in minutes."""
    return explode_bins(intervals, step_seconds, start, end, only).withColumn(
        "overlap_minutes", overlap_minutes(step_seconds, start, end)
    ).filter(F.col("overlap_minutes") > 0)


def inside_flag(intervals: DataFrame, step_seconds: int, name: str, start: str, end: str) -> DataFrame:
    """Bins whose start lies in one of the subject's intervals, flag 1."""
    hit = explode_bins(intervals, step_seconds, start, end)
    return hit.filter((F.col("ts") >= F.col(start)) & (F.col("ts") < F.col(end))).groupBy(KEY, "ts").agg(
        F.max(F.lit(1)).alias(name)
    )


def close_open_ends(intervals: DataFrame, spans: DataFrame, step_seconds: int) -> DataFrame:
    """Give an interval without end the end of its subject's grid plus one bin.

    Only open intervals are joined with the spans (one row per subject)."""
    from pulsegrid.functions.times import ceil_ts

    open_rows = intervals.filter(F.col("end_ts").isNull()).drop("end_ts").join(
        spans.select(KEY, shift(ceil_ts("last_ts", step_seconds), step_seconds).alias("end_ts")), KEY
    )
    return intervals.filter(F.col("end_ts").isNotNull()).unionByName(open_rows)


def rate_changed(rate: Column, previous: Column) -> Column:
    """Change beyond the usual float tolerance (1e-8 + 1e-5 relative)."""
    return F.abs(rate - previous) > F.lit(1e-8) + F.lit(1e-5) * F.abs(previous)


def rate_per_bin(intervals: DataFrame, step_seconds: int, order: str, only: DataFrame | None = None) -> DataFrame:
    """Overlap-weighted rate, delivered units and change flag per bin.

    ``intervals`` must have closed ends; ``order`` breaks ties of equal starts.
    With ``only`` just these bins (subject, ``ts``) are made, and those where an
    interval begins or ends: the last bin with a change flag before one of
    ``only`` is among them, as a run of bins that several intervals share ends
    where an interval does.
    """
    valid = intervals.filter(
        F.col("start_ts").isNotNull() & F.col("basal_units_per_hour").isNotNull() & (F.col("end_ts") > F.col("start_ts"))
    )
    with_prev = scan(valid, ts="start_ts", order=[order], chunk_seconds=HOUR, prev={"_prev": F.col("basal_units_per_hour")})
    hit = interval_overlap(with_prev, step_seconds, only=only)
    rate, minutes = F.col("basal_units_per_hour"), F.col("overlap_minutes")
    starts_here = F.col("ts") == floor_ts("start_ts", step_seconds)
    changed = starts_here & F.col("_prev").isNotNull() & rate_changed(rate, F.col("_prev"))
    return hit.groupBy(KEY, "ts").agg(
        (F.sum(rate * minutes) / F.sum(minutes)).alias("basal_units_per_hour"),
        (F.sum(rate * minutes) / 60.0).alias("basal_units_delivered"),
        F.greatest(F.max(changed.cast("int")), (F.count(F.lit(1)) > 1).cast("int")).alias("basal_schedule_change"),
    )
