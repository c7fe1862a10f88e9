"""Exact window functions over keyed time lines, split into time chunks.

A plain ``Window.partitionBy("subject_id")`` puts a whole subject into one
task.  A subject may hold a third of all rows, so no operator here does that.
Rows are partitioned by (key, time chunk) instead:

* windows of bounded width copy a *halo* of neighbouring rows into the chunk
  (:func:`with_halo`);
* unbounded fills, running sums and row numbers run inside the chunk and add
  what earlier (or later) chunks contribute, which is one small summary row
  per (key, chunk) (:func:`scan`).

Both give the same result as the one-partition window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.times import DAY, epoch_seconds

CHUNK = "_chunk"
OWN = "_own"
WEEK = 7 * DAY  # for binned grids: 2016 five-minute rows
HOUR = 3600  # for raw events, where one subject may be dense


def chunk_of(ts: str | Column, chunk_seconds: int) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(chunk_seconds)).cast("bigint")


def with_halo(
    df: DataFrame, *, back_seconds: int = 0, ahead_seconds: int = 0, ts: str = "ts", chunk_seconds: int = WEEK
) -> DataFrame:
    """Copy each row into every chunk whose windows can reach it.

    Adds ``_chunk`` and ``_own``; keep ``_own`` rows after the window step
    (:func:`drop_halo`).  Copies are ``(back + ahead) / chunk`` of the rows.
    """
    s = epoch_seconds(ts)
    width = F.lit(chunk_seconds)
    first = F.floor((s - ahead_seconds) / width).cast("bigint")
    last = F.floor((s + back_seconds) / width).cast("bigint")
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(CHUNK) == F.floor(s / width).cast("bigint")
    )


def chunk_window(keys: Sequence[str] = ("subject_id",), ts: str = "ts", *order: str | Column) -> Window:
    return Window.partitionBy(*keys, CHUNK).orderBy(ts, *order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(OWN).drop(CHUNK, OWN)


def scan(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("subject_id",),
    ts: str = "ts",
    order: Sequence[str] = (),
    chunk_seconds: int = WEEK,
    last: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    cumsum: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    row_index: str | None = None,
    row_count: str | None = None,
) -> DataFrame:
    """Whole-history window results, one column per entry.

    ``last`` / ``prev``: last non-null value at or before / strictly before the
    row.  ``next`` / ``after``: first non-null value at or after / strictly
    after it.  ``cumsum``: running sum up to the row.  ``total``: sum over the
    whole key.  ``row_index``: 0-based
    position in the key; ``row_count``: rows of the key.  Rows are ordered by
    ``ts`` and then ``order``, which must make the order total where ties matter.
    Keys and ``ts`` must not be null.
    """
    last, prev, next, after, cumsum, total = ({} if m is None else dict(m) for m in (last, prev, next, after, cumsum, total))
    rows = df.withColumn(CHUNK, chunk_of(ts, chunk_seconds))
    rank = F.struct(ts, *order)

    back, ahead, sums = {**last, **prev}, {**next, **after}, dict(cumsum)
    aggs = [F.max_by(e, F.when(e.isNotNull(), rank)).alias(f"_b_{n}") for n, e in back.items()]
    aggs += [F.min_by(e, F.when(e.isNotNull(), rank)).alias(f"_a_{n}") for n, e in ahead.items()]
    aggs += [F.sum(e).alias(f"_s_{n}") for n, e in sums.items()]
    aggs += [F.sum(e).alias(f"_t_{n}") for n, e in total.items()]
    if row_index or row_count:
        aggs.append(F.count(F.lit(1)).alias("_c"))
    summary = rows.groupBy(*keys, CHUNK).agg(*aggs)

    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = by_key.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"_b_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in back]
    carried += [F.last(f"_a_{n}", ignorenulls=True).over(later).alias(f"_a_{n}") for n in ahead]
    carried += [F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums]
    carried += [F.sum(f"_t_{n}").over(by_key).alias(f"_t_{n}") for n in total]
    if row_index:
        carried.append(F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_i"))
    if row_count:
        carried.append(F.sum("_c").over(by_key).alias("_n"))
    offsets = summary.select(*keys, CHUNK, *carried)

    # same keys as the windows below: one shuffle serves the join and the windows; the driver never gathers a row per (key, chunk)
    out = rows.join(offsets.hint("merge"), [*keys, CHUNK], "left")
    asc = Window.partitionBy(*keys, CHUNK).orderBy(ts, *order)
    desc = Window.partitionBy(*keys, CHUNK).orderBy(F.desc(ts), *[F.desc(c) for c in order])
    here, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)

    made = {}
    for n, e in back.items():
        frame = asc.rowsBetween(*(here if n in last else before))
        made[n] = F.coalesce(F.last(e, ignorenulls=True).over(frame), F.col(f"_b_{n}"))
    for n, e in ahead.items():
        frame = desc.rowsBetween(*(here if n in next else before))
        made[n] = F.coalesce(F.last(e, ignorenulls=True).over(frame), F.col(f"_a_{n}"))
    for n, e in sums.items():
        made[n] = F.coalesce(F.sum(e).over(asc.rowsBetween(*here)), F.lit(0)) + F.col(f"_s_{n}")
    for n in total:
        made[n] = F.col(f"_t_{n}")
    if row_index:
        made[row_index] = F.row_number().over(asc) - 1 + F.col("_i")
    if row_count:
        made[row_count] = F.col("_n")
    # one select, so that all windows of one order share one sort
    keep = [c for c in df.columns if c not in made]
    return out.select(*keep, *[c.alias(n) for n, c in made.items()])


def row_windows(
    df: DataFrame, make, *, back_rows: int, index: str, keys: Sequence[str] = ("subject_id",), chunk_rows: int = 4096
) -> DataFrame:
    """Windows that count rows, on rows that may be far apart in time.

    ``index`` is the row's position in its key (``scan(row_index=...)``).  Chunks
    are runs of positions; each copies the ``back_rows`` rows before it.
    ``make(window)`` returns name → column.
    """
    width, i = F.lit(chunk_rows), F.col(index)
    own = F.floor(i / width)
    copies = df.withColumn(CHUNK, F.explode(F.sequence(own, F.floor((i + back_rows) / width)))).withColumn(OWN, F.col(CHUNK) == own)
    return drop_halo(copies.withColumns(make(Window.partitionBy(*keys, CHUNK).orderBy(index))))
