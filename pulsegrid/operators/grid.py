"""Regular grids and the per-bin features on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import calendar_columns
from pulsegrid.functions.times import (
    DAY, ceil_ts, epoch_seconds, floor_ts, from_epoch_seconds, minutes_between,
)
from pulsegrid.operators.timeline import WEEK, Window, chunk_window, drop_halo, scan, with_halo

KEY = "subject_id"


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def span(frames: Sequence[DataFrame], columns: Sequence[Sequence[str]], key: str = KEY) -> DataFrame:
    """First and last time of each subject over all time columns of all tables."""
    parts = []
    for df, cols in zip(frames, columns, strict=True):
        times = [F.col(c).cast("timestamp_ntz") for c in cols]
        low = F.least(*times) if len(times) > 1 else times[0]
        high = F.greatest(*times) if len(times) > 1 else times[0]
        parts.append(df.groupBy(key).agg(F.min(low).alias("lo"), F.max(high).alias("hi")))
    return union_all(parts).groupBy(key).agg(F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"))


def time_grid(spans: DataFrame, step_seconds: int, key: str = KEY) -> DataFrame:
    """All bins from floor(first) to ceil(last), both included.

    Days are generated first and spread over the cluster, then bins inside each
    day, so a long history is not one array in one task.
    """
    lo = epoch_seconds(floor_ts("first_ts", step_seconds))
    hi = epoch_seconds(ceil_ts("last_ts", step_seconds))
    days = (
        spans.filter(F.col("first_ts").isNotNull())
        .select(key, lo.alias("_lo"), hi.alias("_hi"))
        .withColumn("_day", F.explode(F.sequence(F.floor(F.col("_lo") / DAY), F.floor(F.col("_hi") / DAY))))
        .repartition(key, "_day")
    )
    start = F.greatest(F.col("_lo"), F.col("_day") * DAY)
    offset = F.pmod(F.col("_lo") - start, F.lit(step_seconds))
    end = F.least(F.col("_hi"), (F.col("_day") + 1) * DAY - 1)
    bins = F.when(start + offset <= end, F.sequence(start + offset, end, F.lit(step_seconds).cast("bigint")))
    return days.select(key, F.explode(bins).alias("_s")).select(key, from_epoch_seconds(F.col("_s")).alias("ts"))


def bin_events(df: DataFrame, step_seconds: int, aggs: Mapping[str, Column], key: str = KEY, ts: str = "ts") -> DataFrame:
    """Events floored to bins and aggregated (partial sums before the shuffle)."""
    return (
        df.withColumn("ts", floor_ts(ts, step_seconds)).groupBy(key, "ts")
        .agg(*[a.alias(n) for n, a in aggs.items()])
    )


def assemble(grid: DataFrame, parts: Sequence[DataFrame], key: str = KEY, *, keep_off_grid: bool = False) -> DataFrame:
    """Grid left-joined with any number of per-bin tables in one shuffle.

    Each part has at most one row per (subject, bin).  Instead of a chain of
    joins, grid and parts are stacked and folded by (subject, bin).  With
    ``keep_off_grid`` rows outside the grid stay, for carrying forward; they
    lack the flag ``_grid``.
    """
    names = [c for p in parts for c in p.columns if c not in (key, "ts")]
    stacked = union_all([grid.withColumn("_grid", F.lit(True)), *parts])
    folded = stacked.groupBy(key, "ts").agg(F.max("_grid").alias("_grid"), *[F.max(n).alias(n) for n in names])
    return folded if keep_off_grid else folded.filter("_grid").drop("_grid")


def join_bins(grid: DataFrame, part: DataFrame, key: str = KEY) -> DataFrame:
    """Plain form of the grid join: left equi-join on (subject, bin)."""
    return grid.join(part, [key, "ts"], "left")


def minutes_since(last_ts: str, ts: str = "ts") -> Column:
    return minutes_between(ts, last_ts)


def fill_glucose(df: DataFrame, *, fill_edges: bool = False, gaps: Sequence[int] = (10, 20, 30), chunk_seconds: int = WEEK) -> DataFrame:
    """Linear interpolation between observed neighbours, missing flag, minutes
    since the last sample and gap flags.  Needs ``glucose_observed``."""
    seen = F.col("glucose_observed").isNotNull()
    point = F.when(seen, F.struct(F.col("ts").alias("t"), F.col("glucose_observed").alias("g")))
    out = scan(df, chunk_seconds=chunk_seconds, last={"_p": point}, next={"_q": point})
    return fill_from_neighbours(out, fill_edges=fill_edges, gaps=gaps).drop("_p", "_q")


def fill_from_neighbours(df: DataFrame, *, fill_edges: bool = False, gaps: Sequence[int] = (10, 20, 30)) -> DataFrame:
    """The column part of :func:`fill_glucose`, given ``_p`` (at or before) and ``_q`` (at or after)."""
    share = F.try_divide(minutes_between("ts", F.col("_p.t")), minutes_between(F.col("_q.t"), F.col("_p.t")))
    inner = F.col("_p.g") + (F.col("_q.g") - F.col("_p.g")) * share
    glucose = F.coalesce(F.col("glucose_observed"), inner)
    if fill_edges:
        glucose = F.coalesce(glucose, F.col("_p.g"), F.col("_q.g"))
    since = minutes_between("ts", F.col("_p.t"))
    return df.withColumns(
        {
            "glucose": glucose,
            "missing_cgm": F.col("glucose_observed").isNull().cast("int"),
            "minutes_since_last_cgm": since,
            **{f"cgm_gap_ge_{g}m": F.coalesce((since >= g).cast("int"), F.lit(0)) for g in gaps},
        }
    )


def steps_of(minutes: int, step_seconds: int) -> int:
    return max(minutes * 60 // step_seconds, 1)


def lag_columns(w: Window, minutes: Sequence[int], step_seconds: int, col: str = "glucose") -> dict[str, Column]:
    """Value n rows back, or the current value at the start."""
    return {
        f"{col}_lag_{m}m": F.coalesce(F.lag(col, steps_of(m, step_seconds)).over(w), F.col(col)) for m in minutes
    }


def rolling(w: Window, col: str, minutes: int, step_seconds: int, how: str = "sum") -> Column:
    """Mean or sum over the last n rows, the current one included; one row is enough.

    The frame is summed afresh for each row at any width, so a sum of values
    that are not negative never is, and an infinity leaves with its row.
    """
    n = steps_of(minutes, step_seconds)
    return {"sum": F.sum, "mean": F.avg}[how](col).over(w.rowsBetween(1 - n, 0))


def rolling_columns(w: Window, col: str, prefix: str, minutes: Sequence[int], step_seconds: int, how: str) -> dict[str, Column]:
    return {f"{prefix}_{m}m": rolling(w, col, m, step_seconds, how) for m in minutes}


def lead_target(w: Window, horizon_minutes: int, step_seconds: int, *, imputed: bool = False) -> Column:
    h = steps_of(horizon_minutes, step_seconds)
    target = F.lead("glucose_observed", h).over(w)
    return F.coalesce(target, F.lead("glucose", h).over(w)) if imputed else target


def bounded(
    df: DataFrame, make, *, back_seconds: int = 0, ahead_seconds: int = 0, chunk_seconds: int = WEEK, key: str = KEY,
) -> DataFrame:
    """Add window columns of bounded reach: ``make(window)`` returns name → column."""
    halo = with_halo(df, back_seconds=back_seconds, ahead_seconds=ahead_seconds, chunk_seconds=chunk_seconds)
    return drop_halo(halo.withColumns(make(chunk_window((key,)))))


def add_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(calendar_columns(ts))
