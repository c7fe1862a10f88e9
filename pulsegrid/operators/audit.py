"""Completeness audit: manifests, window quality, de-duplication, spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import reasons
from pulsegrid.functions.times import minutes_between
from pulsegrid.operators.quantiles import exact_quantiles
from pulsegrid.operators.timeline import HOUR, scan

REQUIRED_KINDS = ("cgm", "bolus", "basal")
GAP_MINUTES = 7.5


# ------------------------------------------------------------------- manifests


def step_minutes(times: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Minutes from each distinct time of a group to the one before it."""
    unique = times.select(*keys, "ts").distinct()
    return scan(unique, keys=keys, chunk_seconds=HOUR, prev={"_before": F.col("ts")}).withColumn(
        "step_minutes", minutes_between("ts", "_before")
    )


def export_manifest(times: DataFrame, keys: Sequence[str] = ("kind", "source_file")) -> DataFrame:
    """One row per export file and kind: rows, span, spacing and gap facts.

    ``times`` has one row per (source row, time column): ``keys``, ``ts``
    (null allowed) and ``row_weight`` (1 on one of them, else 0).
    """
    seen = times.filter(F.col("ts").isNotNull())
    counts = times.groupBy(*keys).agg(
        F.sum("row_weight").alias("rows"), F.count("ts").alias("_times"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    steps = step_minutes(seen, keys)
    spacing = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_unique"), F.max("step_minutes").alias("max_step_minutes"))
    median = exact_quantiles(steps, keys, "step_minutes", {"median_step_minutes": 0.5}).drop("_n")
    gap = F.coalesce((F.col("kind") == "cgm") & (F.col("max_step_minutes") > GAP_MINUTES), F.lit(False))
    return (
        counts.join(spacing, list(keys), "left").join(median, list(keys), "left")
        .withColumns(
            {
                "duration_minutes": minutes_between("last_ts", "first_ts"),
                "has_internal_gap": gap,
                "has_duplicates": F.col("_times") != F.coalesce("_unique", F.lit(0)),
            }
        )
        .withColumn("is_complete_window", F.col("first_ts").isNotNull() & ~F.col("has_internal_gap"))
        .drop("_times", "_unique")
    )


def manifest_summary(manifest: DataFrame, keys: Sequence[str] = ("subject_id",), required: Sequence[str] = ("cgm", "bolus")) -> DataFrame:
    """Gaps, overlaps, duplicates and missing kinds per subject.

    Windows here run over manifest rows (one per file), not data rows.
    """
    same = Window.partitionBy(*keys, "kind", "source_file", "first_ts", "last_ts")
    by_source = Window.partitionBy(*keys, "kind").orderBy("source_order", "source_file")
    chrono = Window.partitionBy(*keys, "kind").orderBy("first_ts", "last_ts", "source_order")
    is_cgm = F.col("kind") == "cgm"
    marked = (
        manifest.withColumns(
            {
                "_dup": F.count(F.lit(1)).over(same) > 1,
                "_disorder": is_cgm & (F.col("first_ts") < F.last(F.col("first_ts"), True).over(by_source.rowsBetween(Window.unboundedPreceding, -1))),
                "_prev_end": F.max("last_ts").over(chrono.rowsBetween(Window.unboundedPreceding, -1)),
            }
        )
        .withColumn("_gap", minutes_between("first_ts", "_prev_end"))
    )
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    out = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("manifest_rows"),
        count(F.col("is_complete_window")).alias("complete_windows"),
        count(~F.col("is_complete_window")).alias("incomplete_windows"),
        count(is_cgm & (F.col("_gap") > GAP_MINUTES)).alias("gap_count"),
        count(is_cgm & (F.col("_gap") < 0)).alias("overlap_count"),
        count(F.col("_dup")).alias("duplicate_windows"),
        count(F.col("_disorder")).alias("out_of_order_windows"),
        F.sort_array(F.collect_set("kind")).alias("present_kinds"),
    )
    missing = F.array_except(F.array(*[F.lit(k) for k in required]), "present_kinds")
    bad = F.col("gap_count") + F.col("overlap_count") + F.col("duplicate_windows") + F.col("out_of_order_windows") + F.col("incomplete_windows")
    return out.withColumn("missing_kinds", missing).withColumn("is_complete", (F.size("missing_kinds") == 0) & (bad == 0))


def kind_counts(kinds: dict[str, DataFrame], keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Row counts per kind as columns ``<kind>_rows``."""
    parts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{kind}_rows")) for kind, df in kinds.items()]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.coalesce(F.sum(f"{k}_rows"), F.lit(0)).alias(f"{k}_rows") for k in kinds])


def dense_stream(cgm: DataFrame, keys: Sequence[str] = ("subject_id", "source_file"), max_spacing: float = 10.0) -> DataFrame:
    """Is each file a dense sensor stream (three rows or more, median spacing
    within the bound)?  Files without the primary sensor column use all rows."""
    primary = F.col("glucose_source") == "egv_estimatedGlucoseValue"
    has = cgm.groupBy(*keys).agg(F.max(primary.cast("int")).alias("_has"), F.count_distinct("ts").alias("all_cgm_rows"))
    used = cgm.join(has, list(keys)).filter((F.col("_has") == 0) | primary)
    steps = step_minutes(used, keys)
    facts = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("cgm_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    median = exact_quantiles(steps, keys, "step_minutes", {"median_spacing_minutes": 0.5}).drop("_n")
    return (
        has.drop("_has").join(facts, list(keys), "left").join(median, list(keys), "left")
        .withColumn(
            "has_dense_cgm_stream",
            F.coalesce((F.col("cgm_rows") >= 3) & (F.col("median_spacing_minutes") <= max_spacing), F.lit(False)),
        )
    )


# -------------------------------------------------------------- window quality


def export_windows(spans: DataFrame, days: int, direction: str = "backward", start: str = "first_ts", end: str = "last_ts") -> DataFrame:
    """n-day windows covering each subject's span; the odd one is the last made."""
    first, last = F.col(start).cast("date"), F.col(end).cast("date")
    count = F.ceil((F.datediff(last, first) + 1) / F.lit(days)).cast("int")
    rows = spans.filter(first <= last).withColumn("_i", F.explode(F.sequence(F.lit(0), count - 1)))
    if direction == "forward":
        lo = F.date_add(first, F.col("_i") * days)
        hi = F.least(last, F.date_add(lo, days - 1))
    elif direction == "backward":
        hi = F.date_sub(last, F.col("_i") * days)
        lo = F.greatest(first, F.date_sub(hi, days - 1))
    else:
        raise ValueError("direction must be 'forward' or 'backward'")
    out = rows.withColumns({"requested_start": lo, "requested_end": hi})
    window_id = F.concat_ws("__", F.col("requested_start").cast("string"), F.col("requested_end").cast("string"))
    return out.withColumn("window_id", window_id).drop("_i", start, end)


def expected_kinds(rows: DataFrame, keys: Sequence[str], required: Sequence[str] = REQUIRED_KINDS) -> DataFrame:
    """Add the required kinds a window has no row for (empty rows)."""
    wanted = rows.select(*keys).distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in required])))
    missing = wanted.join(rows, [*keys, "kind"], "left_anti")
    return rows.unionByName(missing, allowMissingColumns=True)


def completeness_reasons(
    *, required: Column, rows: Column, requested_start: Column, requested_end: Column, first_ts: Column, last_ts: Column,
    gap: Column, duplicates: Column, overlap: Column,
) -> Column:
    """Reasons in their fixed order."""
    no = F.lit(False)
    return reasons(
        ("missing_kind", required & (F.coalesce(rows, F.lit(0)) <= 0)),
        ("starts_late", first_ts.cast("date") > requested_start),
        ("ends_early", last_ts.cast("date") < requested_end),
        ("internal_gap", F.coalesce(gap, no)),
        ("duplicates", F.coalesce(duplicates, no)),
        ("overlap", F.coalesce(overlap, no)),
    )


def window_quality(rows: DataFrame) -> DataFrame:
    """Quality facts of (window, kind) rows.

    Needs window_id, kind, requested_start, requested_end, row_count, first_ts,
    last_ts, has_internal_gap, has_duplicates, has_overlap.
    """
    required = F.col("kind").isin(*REQUIRED_KINDS)
    days = F.datediff("requested_end", "requested_start") + 1
    observed = F.datediff(F.col("last_ts").cast("date"), F.col("first_ts").cast("date")) + 1
    share = F.greatest(F.least(observed / days, F.lit(1.0)), F.lit(0.0))
    why = completeness_reasons(
        required=required, rows=F.col("row_count"), requested_start=F.col("requested_start"), requested_end=F.col("requested_end"),
        first_ts=F.col("first_ts"), last_ts=F.col("last_ts"), gap=F.col("has_internal_gap"),
        duplicates=F.col("has_duplicates"), overlap=F.col("has_overlap"),
    )
    return rows.withColumns(
        {
            "row_count": F.coalesce("row_count", F.lit(0).cast("bigint")),
            "observed_duration_days": observed,
            "coverage_fraction": F.when((days > 0) & observed.isNotNull(), share).otherwise(0.0),
            "completeness_reasons": why,
        }
    ).withColumn("is_complete_window", F.size("completeness_reasons") == 0)


def quality_from_manifest(manifest: DataFrame) -> DataFrame:
    """Quality rows where no window manifest exists: one per export file."""
    no = F.lit(False)
    gap, dup = F.coalesce("has_internal_gap", no), F.coalesce("has_duplicates", no)
    why = reasons(
        ("internal_gap", gap), ("duplicates", dup),
        ("ends_early", ~F.coalesce("is_complete_window", F.lit(True)) & ~gap & ~dup),
    )
    return manifest.withColumns(
        {
            "window_id": F.col("source_file"), "requested_start": F.col("first_ts").cast("date"),
            "requested_end": F.col("last_ts").cast("date"), "row_count": F.col("rows"), "has_overlap": no,
            "coverage_fraction": F.lit(1.0), "completeness_reasons": why,
        }
    ).withColumn("is_complete_window", F.size("completeness_reasons") == 0)


def quality_status(quality: DataFrame, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """good / degraded / broken per subject, with incomplete window counts."""
    windows = quality.groupBy(*keys, "window_id").agg(
        F.max((F.size("completeness_reasons") > 0).cast("int")).alias("_bad"),
        F.max(((F.col("kind") == "cgm") & (F.col("row_count") <= 0)).cast("int")).alias("_no_cgm"),
    )
    out = windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("window_count"), F.sum("_bad").alias("incomplete_window_count"), F.max("_no_cgm").alias("_no_cgm")
    )
    status = F.when(F.col("_no_cgm") > 0, "broken").when(F.col("incomplete_window_count") > 0, "degraded").otherwise("good")
    return out.withColumn("status", status).drop("_no_cgm")


def reason_counts(quality: DataFrame, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Windows per reason; a reason counts once in a window."""
    each = quality.select(*keys, "window_id", F.explode("completeness_reasons").alias("reason")).distinct()
    return each.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("windows"))


def window_timeline(quality: DataFrame, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Requested against observed range and all reasons of each window."""
    why = F.array_sort(F.array_distinct(F.flatten(F.collect_set("completeness_reasons"))))
    return quality.groupBy(*keys, "window_id").agg(
        F.min("requested_start").alias("requested_start"), F.max("requested_end").alias("requested_end"),
        F.min("first_ts").alias("observed_start"), F.max("last_ts").alias("observed_end"),
        F.sum("row_count").alias("row_count"), why.alias("reasons"),
    )


def latest_window(quality: DataFrame, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """The most recently requested window of each subject."""
    return quality.groupBy(*keys).agg(F.max_by("window_id", F.struct("requested_end", "window_id")).alias("window_id"))


def acquisition_ledger(quality: DataFrame, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """One row per acquired window: status, rows, span, per-kind counts and completeness as JSON, hash."""
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "row_count"))))
    per_window = quality.groupBy(*keys, "window_id", "requested_start", "requested_end").agg(
        F.sum("row_count").alias("row_count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("completeness_reasons")))).alias("_why"),
        F.max(F.when(F.col("kind") == "cgm", F.col("coverage_fraction"))).alias("_cover"),
        F.to_json(counts).alias("row_counts_json"),
    )
    complete = F.size("_why") == 0
    body = F.to_json(
        F.struct(
            F.coalesce("_cover", F.lit(0.0)).alias("coverage_fraction"), F.col("_why").alias("completeness_reasons"),
            complete.alias("is_complete_window"),
        )
    )
    return per_window.withColumns(
        {
            "status": F.when(complete, "complete").otherwise("incomplete"),
            "observed_window_days": F.datediff(F.col("last_ts").cast("date"), F.col("first_ts").cast("date")) + 1,
            "completeness_json": body, "sha256": F.sha2(F.concat_ws("|", "window_id", "row_counts_json", body), 256),
        }
    ).drop("_why", "_cover")


def pending_windows(windows: DataFrame, ledger: DataFrame, keys: Sequence[str] = ("subject_id", "window_id")) -> DataFrame:
    """Windows that no complete ledger row covers yet."""
    return windows.join(ledger.filter(F.col("status") == "complete"), list(keys), "left_anti")


# ------------------------------------------------------------ de-duplication


def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (nulls first).

    An aggregate, not a row-number window: copies are reduced before the
    shuffle, so one key with many copies is no hot spot.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[x for c in order for x in (F.col(c).isNotNull().alias(f"{c}_set"), F.col(c))])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def dedupe_workouts(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Latest row per workout id; without an id, per start, type and file."""
    fallback = F.concat_ws("::", F.lit("fallback"), F.col("start_ts").cast("string"), "workout_type", "source_file")
    key = F.when(F.trim("workout_id") != "", F.concat(F.lit("id::"), "workout_id")).otherwise(fallback)
    return latest_wins(df.withColumn("_key", key), [*keys, "_key"], order).drop("_key")


def merge_by_priority(parts: Sequence[tuple[int, DataFrame]], keys: Sequence[str], order: Sequence[str] = ("source_file", "source_label")) -> DataFrame:
    """Union of sources; of equal ``keys`` the lowest priority number stays."""
    stacked = None
    for priority, df in parts:
        df = df.withColumn("_priority", F.lit(priority))
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    rest = [c for c in stacked.columns if c not in keys and c != "_priority"]
    ranked = F.struct("_priority", *[c for c in order if c in rest])
    return stacked.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("_row")).select(*keys, "_row.*")


# ----------------------------------------------------------------------- spans


def best_time_column(df: DataFrame, keys: Sequence[str] = (), day_bounds: bool = True) -> DataFrame:
    """Of a table of text columns, the one with most parseable times, with its span."""
    texts = [c for c in df.columns if c not in keys]
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.col(c).cast("string").try_cast("timestamp_ntz").alias("t"))
        for i, c in enumerate(texts)
    ])).alias("c"))
    per = long.groupBy(*keys, "c.pos", "c.column").agg(
        F.count("c.t").alias("parsed"), F.min("c.t").alias("first_ts"), F.max("c.t").alias("last_ts"), F.count(F.lit(1)).alias("row_count")
    )
    best = per.groupBy(*keys).agg(F.max_by(F.struct("column", "parsed", "first_ts", "last_ts", "row_count"), F.struct("parsed", -F.col("pos"))).alias("b"))
    out = best.select(*keys, "b.*")
    seen = F.col("parsed") > 0
    return out.select(
        *keys, F.when(seen, F.col("column")).alias("timestamp_column"), "first_ts", "last_ts", "row_count",
        (F.datediff(F.col("last_ts").cast("date"), F.col("first_ts").cast("date")) + 1).alias("observed_window_days"),
    )


def intersect_spans(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Common range of two span tables; null where they do not meet."""
    right = b.select(*keys, F.col("first_ts").alias("_f"), F.col("last_ts").alias("_l"))
    both = a.join(right, list(keys), "full")
    lo = F.when(F.col("first_ts").isNotNull() & F.col("_f").isNotNull(), F.greatest("first_ts", "_f"))
    hi = F.when(F.col("last_ts").isNotNull() & F.col("_l").isNotNull(), F.least("last_ts", "_l"))
    return both.select(*keys, F.when(hi >= lo, lo).alias("overlap_start"), F.when(hi >= lo, hi).alias("overlap_end"))


def backfill_need(pump: DataFrame, wearable: DataFrame, history_days: int = 365, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Requested range (the wearable span, else the last n days) and whether the pump span covers it."""
    w = wearable.select(*keys, F.col("first_ts").cast("date").alias("_ws"), F.col("last_ts").cast("date").alias("_we"))
    both = pump.join(w, list(keys), "full")
    first, last = F.col("first_ts").cast("date"), F.col("last_ts").cast("date")
    start = F.coalesce("_ws", F.date_sub(last, history_days - 1))
    end = F.coalesce("_we", last)
    need = start.isNotNull() & end.isNotNull() & (first.isNull() | last.isNull() | (first > start) | (last < end))
    return both.select(
        *keys, start.alias("requested_start"), end.alias("requested_end"),
        F.when(need, "needed").otherwise("not_needed").alias("backfill_status"),
    )
