"""As-of, nearest and time-window joins without range joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.times import epoch_seconds, minutes_between, seconds_between, shift
from pulsegrid.operators.timeline import HOUR, scan

KEY = "subject_id"


def asof_backward(
    left: DataFrame, rights: Mapping[str, tuple[DataFrame, str, Sequence[str]]], *, keys: Sequence[str] = (KEY,),
    ts: str = "ts", chunk_seconds: int = HOUR,
) -> DataFrame:
    """Latest row of each right table at or before each left row.

    ``rights``: name → (table, time column, value columns).  Left and right rows
    are stacked and the last right row is carried forward; all right tables
    share the one pass.  Adds a struct column ``name`` with the right time ``t``
    and the values (null where nothing came before).  Right rows sort first at
    equal times; equal right times are resolved by the largest values.
    """
    stacked = left.withColumn("_side", F.lit(1))
    last = {}
    for name, (df, time, values) in rights.items():
        row = F.struct(F.col(time).alias("t"), *[F.col(v) for v in values])
        part = df.filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("_v"))
        part = part.select(*keys, F.col(time), *[F.col("_v")[v].alias(v) for v in values])
        part = part.select(*keys, F.col(time).alias(ts), row.alias(f"_r_{name}"), F.lit(0).alias("_side"))
        stacked = stacked.unionByName(part, allowMissingColumns=True)
        last[name] = F.col(f"_r_{name}")
    out = scan(stacked, keys=keys, ts=ts, order=["_side"], chunk_seconds=chunk_seconds, last=last)
    return out.filter(F.col("_side") == 1).select(*left.columns, *rights)


def freshness(name: str, cap_minutes: float, ts: str = "ts") -> Column:
    """Minutes since the as-of row, between 0 and the cap; the cap if there is none."""
    age = minutes_between(ts, F.col(f"{name}.t"))
    return F.least(F.greatest(F.coalesce(age, F.lit(1e6)), F.lit(0.0)), F.lit(float(cap_minutes)))


def window_join(
    anchors: DataFrame, rows: DataFrame, *, back_minutes: int, ahead_minutes: int, keys: Sequence[str] = (KEY,),
    anchor_ts: str = "anchor_ts", ts: str = "ts", bucket_seconds: int = 4 * 3600,
) -> DataFrame:
    """Anchor × rows within ``[anchor - back, anchor + ahead]``.

    Anchors are copied to the time buckets their window touches, rows keep
    their own bucket, and the join is an equi-join on (key, bucket) plus the
    exact bounds.  Inner join: anchors without rows drop out.
    """
    bucket = lambda c: F.floor(epoch_seconds(c) / bucket_seconds)
    lo, hi = shift(anchor_ts, -back_minutes * 60), shift(anchor_ts, ahead_minutes * 60)
    copies = anchors.withColumn("_bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    placed = rows.withColumn("_bucket", bucket(F.col(ts)))
    joined = copies.join(placed, [*keys, "_bucket"])
    return joined.filter((F.col(ts) >= lo) & (F.col(ts) <= hi)).drop("_bucket")


def nearest_within(
    anchors: DataFrame, events: DataFrame, value: str, *, max_minutes: int, keys: Sequence[str] = (KEY,),
    anchor_id: str = "anchor_id", anchor_ts: str = "anchor_ts", ts: str = "ts", same_day: bool = True,
) -> DataFrame:
    """Nearest event of the same key (and day) within the bound, earliest on a tie."""
    hit = window_join(
        anchors.select(*keys, anchor_id, anchor_ts), events.select(*keys, ts, value), back_minutes=max_minutes,
        ahead_minutes=max_minutes, keys=keys, anchor_ts=anchor_ts, ts=ts,
    )
    if same_day:
        hit = hit.filter(F.col(ts).cast("date") == F.col(anchor_ts).cast("date"))
    far = F.abs(seconds_between(ts, anchor_ts))
    best = hit.groupBy(*keys, anchor_id).agg(
        F.min_by(F.struct(F.col(value).alias("v"), F.col(ts).alias("t")), F.struct(far, ts, value)).alias("_b")
    )
    return best.select(*keys, anchor_id, F.col("_b.v").alias(value), F.col("_b.t").alias("nearest_ts"))


def neighbours(events: DataFrame, keys: Sequence[str] = (KEY,), ts: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """Time of the event before and after each event."""
    return scan(events, keys=keys, ts=ts, order=order, chunk_seconds=HOUR, prev={"prev_ts": F.col(ts)}, after={"next_ts": F.col(ts)})


def event_study(
    doses: DataFrame, samples: DataFrame, target: float = 110.0, *, back_minutes: float = 10000 / 60, ahead_minutes: int = 300,
) -> DataFrame:
    """Mean-level area before and after each dose, cut at the neighbouring doses.

    ``doses``: subject_id, ts, event_id.  Area: trapezoids over the sample
    positions of ``abs(glucose - target)``.
    """
    near = neighbours(doses, order=["event_id"]).select(KEY, F.col("ts").alias("anchor_ts"), "event_id", "prev_ts", "next_ts")
    back = int(-(-back_minutes // 1))
    joined = window_join(near, samples.select(KEY, "ts", "glucose"), back_minutes=back, ahead_minutes=ahead_minutes)
    lo = F.greatest(shift("anchor_ts", -int(back_minutes * 60)), F.coalesce("prev_ts", shift("anchor_ts", -back * 60)))
    hi = F.least(shift("anchor_ts", ahead_minutes * 60), F.coalesce("next_ts", shift("anchor_ts", ahead_minutes * 60)))
    cut = joined.filter((F.col("ts") >= lo) & (F.col("ts") <= hi)).withColumn("_y", F.abs(F.col("glucose") - target))
    # a sample at the anchor belongs to both sides
    before = cut.filter(F.col("ts") <= F.col("anchor_ts")).withColumn("side", F.lit("before"))
    after = cut.filter(F.col("ts") >= F.col("anchor_ts")).withColumn("side", F.lit("after"))
    areas = trapezoid(before.unionByName(after), [KEY, "event_id", "side"], "ts", "_y")
    return areas.groupBy(KEY, "event_id").agg(
        F.max(F.when(F.col("side") == "before", F.col("area"))).alias("area_before"),
        F.max(F.when(F.col("side") == "after", F.col("area"))).alias("area_after"),
    ).withColumn("area_difference", F.col("area_after") - F.col("area_before"))


def trapezoid(df: DataFrame, keys: Sequence[str], order: str, y: str) -> DataFrame:
    """Sum of trapezoids over unit steps in ``order``: total minus half the ends.

    A pure aggregate: no sorting of a group is needed.
    """
    first, last = F.min_by(y, F.col(order)), F.max_by(y, F.col(order))
    return df.groupBy(*keys).agg((F.sum(y) - (first + last) / 2.0).alias("area"))
