"""Audit, de-duplication and span queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pulsegrid.operators import audit as Q
from pulsegrid.operators.grid import span
from pulsegrid.plans.feature_frame import kind_spans
from pulsegrid.queries.grid_queries import pump_kinds
from pulsegrid.queries.sqlparts import minutes, r, rounded, rs, with_
from pulsegrid.sources import adapters as A

KIND = "case event_type when 'view' then 'cgm' when 'purchase' then 'bolus' when 'error' then 'carbs' when 'signup' then 'basal' else 'activity' end"


def event_times(spark, sf_dir):
    """All events as (subject, kind, file, ts); times cut to the second so that copies occur."""
    kind = F.expr(KIND)
    return A.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"), kind.alias("kind"), A.source_file().alias("source_file"),
        (F.col("event_id") % 3).cast("int").alias("source_order"), F.expr("date_trunc('minute', ts)").cast("timestamp_ntz").alias("ts"),
        F.lit(1).alias("row_weight"),
    )


TIMES = (
    f"times as (select user_id as subject_id, {KIND} as kind, 'export_' || (event_id % 3) as source_file, cast(event_id % 3 as integer) as source_order, "
    "date_trunc('minute', ts) as ts from events)"
)


def manifest_sql(keys: str) -> str:
    on = " and ".join(f"c.{k} = s.{k}" for k in keys.split(", "))
    out = ", ".join(f"c.{k}" for k in keys.split(", "))
    return (
        f"{TIMES}, counts as (select {keys}, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from times group by all), "
        f"steps as (select *, {minutes('ts', 'lag(ts) over (partition by ' + keys + ' order by ts)')} as step from (select distinct {keys}, ts from times)), "
        f"spacing as (select {keys}, count(*) as u, max(step) as max_step, median(step) as med from steps group by all), "
        f"man as (select {out}, n as rows, first_ts, last_ts, {minutes('last_ts', 'first_ts')} as duration_minutes, med as median_step_minutes, max_step as max_step_minutes, "
        "coalesce(c.kind = 'cgm' and max_step > 7.5, false) as has_internal_gap, n <> u as has_duplicates, "
        f"not coalesce(c.kind = 'cgm' and max_step > 7.5, false) as is_complete_window from counts c join spacing s on {on})"
    )


def _manifest_out(df):
    out = df.withColumns({c: F.col(c).cast("int") for c in ("has_internal_gap", "has_duplicates", "is_complete_window")})
    return rounded(out, "duration_minutes", "median_step_minutes", "max_step_minutes")


def manifest_cols(keys: str) -> str:
    return (
        f"{keys}, rows, first_ts, last_ts, {rs('duration_minutes')} as duration_minutes, {rs('median_step_minutes')} as median_step_minutes, "
        f"{rs('max_step_minutes')} as max_step_minutes, cast(has_internal_gap as integer) as has_internal_gap, "
        "cast(has_duplicates as integer) as has_duplicates, cast(is_complete_window as integer) as is_complete_window"
    )


def q_export_manifest(spark, sf_dir):
    return _manifest_out(Q.export_manifest(event_times(spark, sf_dir).drop("subject_id", "source_order")))


SUBJECT_KEYS = ("subject_id", "kind", "source_file", "source_order")


def subject_manifest(spark, sf_dir):
    return Q.export_manifest(event_times(spark, sf_dir), SUBJECT_KEYS)


def q_manifest_summary(spark, sf_dir):
    out = Q.manifest_summary(subject_manifest(spark, sf_dir))
    return out.withColumns(
        {
            "present_kinds": F.array_join("present_kinds", ","), "missing_kinds": F.array_join("missing_kinds", ","),
            "is_complete": F.col("is_complete").cast("int"),
        }
    )


SQL_MANIFEST_SUMMARY = (
    f"with {manifest_sql('subject_id, kind, source_file, source_order')}, marked as (select *, "
    "count(*) over (partition by subject_id, kind, source_file, first_ts, last_ts) > 1 as dup, "
    "lag(first_ts) over (partition by subject_id, kind order by source_order) as before, "
    "max(last_ts) over (partition by subject_id, kind order by first_ts, last_ts, source_order rows between unbounded preceding and 1 preceding) as prev_end from man) "
    "select subject_id, count(*) as manifest_rows, count(*) filter (is_complete_window) as complete_windows, count(*) filter (not is_complete_window) as incomplete_windows, "
    f"count(*) filter (kind = 'cgm' and {minutes('first_ts', 'prev_end')} > 7.5) as gap_count, count(*) filter (kind = 'cgm' and first_ts < prev_end) as overlap_count, "
    "count(*) filter (dup) as duplicate_windows, count(*) filter (kind = 'cgm' and first_ts < before) as out_of_order_windows, "
    "array_to_string(list_sort(list(distinct kind)), ',') as present_kinds, "
    "array_to_string([k for k in ['cgm', 'bolus'] if not list_contains(list(distinct kind), k)], ',') as missing_kinds, "
    f"cast(count(*) filter (not is_complete_window or dup or (kind = 'cgm' and (abs({minutes('first_ts', 'prev_end')} - 3.75) > 3.75 or first_ts < before))) = 0 "
    "and list_contains(list(distinct kind), 'cgm') and list_contains(list(distinct kind), 'bolus') as integer) as is_complete from marked group by 1"
)


def q_coverage_summary(spark, sf_dir):
    kinds = pump_kinds(spark, sf_dir)
    counts = Q.kind_counts({**kinds, "workouts": A.workouts(spark, sf_dir), "sleep": A.sleep(spark, sf_dir)})
    return counts.join(kind_spans(kinds), "subject_id", "left").withColumn(
        "has_wearable_data", ((F.col("workouts_rows") + F.col("sleep_rows")) > 0).cast("int")
    )


SQL_COVERAGE = with_(
    "spans workouts",
    "select user_id as subject_id, count(*) filter (event_type = 'view') as cgm_rows, count(*) filter (event_type = 'purchase') as bolus_rows, "
    "count(*) filter (event_type = 'error') as carbs_rows, count(*) filter (event_type = 'click') as activity_rows, count(*) filter (event_type = 'signup') as basal_rows, "
    "coalesce(any_value(w.n), 0) as workouts_rows, count(*) filter (event_type = 'signup') as sleep_rows, any_value(s.first_ts) as first_ts, any_value(s.last_ts) as last_ts, "
    "cast(coalesce(any_value(w.n), 0) + count(*) filter (event_type = 'signup') > 0 as integer) as has_wearable_data "
    "from events e left join spans s on s.subject_id = e.user_id left join (select subject_id, count(*) as n from workouts group by 1) w on w.subject_id = e.user_id group by 1",
)


def quality_rows(spark, sf_dir):
    """(window, kind) facts on 10-day windows of each subject's span."""
    times = event_times(spark, sf_dir)
    spans = times.groupBy("subject_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    windows = Q.export_windows(spans, 10, "forward")
    start = windows.select("subject_id", "window_id", "requested_start", "requested_end")
    # the window of an event follows from its subject's first day
    first = spans.select("subject_id", F.col("first_ts").cast("date").alias("_d0"))
    placed = times.join(first, "subject_id").withColumn(
        "requested_start", F.date_add("_d0", (F.floor(F.datediff(F.col("ts").cast("date"), F.col("_d0")) / 10) * 10).cast("int"))
    )
    facts = placed.groupBy("subject_id", "requested_start", "kind").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        (F.count("ts") != F.count_distinct("ts")).alias("has_duplicates"),
    )
    rows = start.join(facts, ["subject_id", "requested_start"]).withColumns({"has_internal_gap": F.lit(False), "has_overlap": F.lit(False)})
    filled = Q.expected_kinds(rows, ["subject_id", "window_id", "requested_start", "requested_end"])
    return Q.window_quality(filled)


QUALITY_SQL = (
    f"{TIMES}, sp as (select subject_id, cast(min(ts) as date) as d0, cast(max(ts) as date) as d1 from times group by 1), "
    "win as (select subject_id, d0 + i as requested_start, least(d1, d0 + i + 9) as requested_end from (select subject_id, d0, d1, cast(unnest(generate_series(0, d1 - d0, 10)) as integer) as i from sp)), "
    "facts as (select w.subject_id, w.requested_start, w.requested_end, kind, count(*) as row_count, min(ts) as first_ts, max(ts) as last_ts, count(ts) <> count(distinct ts) as dup "
    "from win w join times t on w.subject_id = t.subject_id and cast(t.ts as date) between w.requested_start and w.requested_end group by all), "
    "wanted as (select distinct subject_id, requested_start, requested_end, unnest(['cgm', 'bolus', 'basal']) as kind from facts), "
    "allrows as (select * from facts union all select w.*, 0, null, null, null from wanted w anti join facts f using (subject_id, requested_start, kind)), "
    "qual as (select subject_id, requested_start || '__' || requested_end as window_id, requested_start, requested_end, kind, row_count, first_ts, last_ts, "
    "cast(last_ts as date) - cast(first_ts as date) + 1 as observed_duration_days, "
    "case when first_ts is null then 0.0 else least((cast(last_ts as date) - cast(first_ts as date) + 1) / (requested_end - requested_start + 1), 1.0) end as coverage_fraction, "
    "[x for x in [case when row_count <= 0 and kind in ('cgm', 'bolus', 'basal') then 'missing_kind' end, case when cast(first_ts as date) > requested_start then 'starts_late' end, "
    "case when cast(last_ts as date) < requested_end then 'ends_early' end, case when dup then 'duplicates' end] if x is not null] as why from allrows)"
)


def q_window_quality(spark, sf_dir):
    out = quality_rows(spark, sf_dir).select(
        "subject_id", "window_id", "kind", "row_count", "first_ts", "last_ts", F.col("observed_duration_days").cast("bigint").alias("observed_duration_days"),
        r("coverage_fraction").alias("coverage_fraction"), F.array_join("completeness_reasons", "|").alias("reasons"),
        F.col("is_complete_window").cast("int").alias("is_complete_window"),
    )
    return out


SQL_WINDOW_QUALITY = (
    f"with {QUALITY_SQL} select subject_id, window_id, kind, row_count, first_ts, last_ts, observed_duration_days, {rs('coverage_fraction')} as coverage_fraction, "
    "array_to_string(why, '|') as reasons, cast(len(why) = 0 as integer) as is_complete_window from qual"
)


def q_quality_status(spark, sf_dir):
    return Q.quality_status(quality_rows(spark, sf_dir)).withColumn("incomplete_window_count", F.col("incomplete_window_count").cast("bigint"))


SQL_QUALITY_STATUS = (
    f"with {QUALITY_SQL}, w as (select subject_id, window_id, max(case when len(why) > 0 then 1 else 0 end) as bad, max(case when kind = 'cgm' and row_count <= 0 then 1 else 0 end) as no_cgm from qual group by 1, 2) "
    "select subject_id, count(*) as window_count, cast(sum(bad) as bigint) as incomplete_window_count, case when max(no_cgm) > 0 then 'broken' when sum(bad) > 0 then 'degraded' else 'good' end as status from w group by 1"
)


def q_reason_counts(spark, sf_dir):
    return Q.reason_counts(quality_rows(spark, sf_dir))


SQL_REASON_COUNTS = f"with {QUALITY_SQL} select subject_id, reason, count(distinct window_id) as windows from (select subject_id, window_id, unnest(why) as reason from qual) group by 1, 2"


def q_window_timeline(spark, sf_dir):
    return Q.window_timeline(quality_rows(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", "|"))


SQL_WINDOW_TIMELINE = (
    f"with {QUALITY_SQL} select subject_id, window_id, min(requested_start) as requested_start, max(requested_end) as requested_end, min(first_ts) as observed_start, "
    "max(last_ts) as observed_end, cast(sum(row_count) as bigint) as row_count, array_to_string(list_sort(list_distinct(flatten(list(why)))), '|') as reasons from qual group by 1, 2"
)


def q_ledger(spark, sf_dir):
    out = Q.acquisition_ledger(quality_rows(spark, sf_dir))
    return out.select(
        "subject_id", "window_id", "status", "row_count", "first_ts", "last_ts", F.col("observed_window_days").cast("bigint").alias("observed_window_days"), "row_counts_json"
    )


SQL_LEDGER = (
    f"with {QUALITY_SQL} select subject_id, window_id, case when max(len(why)) = 0 then 'complete' else 'incomplete' end as status, cast(sum(row_count) as bigint) as row_count, "
    "min(first_ts) as first_ts, max(last_ts) as last_ts, cast(max(last_ts) as date) - cast(min(first_ts) as date) + 1 as observed_window_days, "
    "'{' || string_agg('\"' || kind || '\":' || row_count, ',' order by kind) || '}' as row_counts_json from qual group by 1, 2"
)


def q_pending_windows(spark, sf_dir):
    quality = quality_rows(spark, sf_dir)
    ledger = Q.acquisition_ledger(quality)
    windows = quality.select("subject_id", "window_id").distinct()
    return Q.pending_windows(windows, ledger)


SQL_PENDING = f"with {QUALITY_SQL} select subject_id, window_id from qual group by 1, 2 having max(len(why)) > 0"


def q_latest_window(spark, sf_dir):
    return Q.latest_window(quality_rows(spark, sf_dir))


def q_manifest_quality(spark, sf_dir):
    out = Q.quality_from_manifest(subject_manifest(spark, sf_dir))
    return out.select("subject_id", "kind", "window_id", "row_count", F.array_join("completeness_reasons", "|").alias("reasons"), F.col("is_complete_window").cast("int").alias("is_complete_window"))


SQL_MANIFEST_QUALITY = (
    f"with {manifest_sql('subject_id, kind, source_file, source_order')} select subject_id, kind, source_file as window_id, rows as row_count, "
    "concat_ws('|', case when has_internal_gap then 'internal_gap' end, case when has_duplicates then 'duplicates' end) as reasons, "
    "cast(not has_internal_gap and not has_duplicates as integer) as is_complete_window from man"
)


def q_dense_stream(spark, sf_dir):
    cgm = A.cgm(spark, sf_dir).withColumns(
        {
            "glucose_source": F.when(F.col("event_id") % 5 == 0, "bg").otherwise("egv_estimatedGlucoseValue"),
            "ts": F.expr("date_trunc('minute', ts)").cast("timestamp_ntz"),
        }
    )
    out = Q.dense_stream(cgm, max_spacing=2880.0)
    return out.withColumns({"median_spacing_minutes": r("median_spacing_minutes"), "has_dense_cgm_stream": F.col("has_dense_cgm_stream").cast("int")})


SQL_DENSE = with_(
    "cgm",
    "select a.subject_id, a.source_file, all_cgm_rows, cgm_rows, first_ts, last_ts, median_spacing_minutes, has_dense_cgm_stream from "
    "(select subject_id, source_file, count(distinct date_trunc('minute', ts)) as all_cgm_rows from cgm group by 1, 2) a left join "
    f"(select subject_id, source_file, count(*) as cgm_rows, min(ts) as first_ts, max(ts) as last_ts, {rs('median(step)')} as median_spacing_minutes, "
    "cast(coalesce(count(*) >= 3 and median(step) <= 2880, false) as integer) as has_dense_cgm_stream from "
    f"(select *, {minutes('ts', 'lag(ts) over (partition by subject_id, source_file order by ts)')} as step from "
    "(select distinct c.subject_id, c.source_file, date_trunc('minute', c.ts) as ts from cgm c join (select subject_id, source_file, max(case when event_id % 5 <> 0 then 1 else 0 end) as has from cgm group by 1, 2) h "
    "using (subject_id, source_file) where has = 0 or event_id % 5 <> 0)) group by 1, 2) b using (subject_id, source_file)",
)


def q_latest_wins(spark, sf_dir):
    rows = A.measurements(spark, sf_dir).withColumns({"day": F.col("ts").cast("date"), "export_ts": F.col("ts")})
    out = Q.latest_wins(rows, ["subject_id", "day", "metric", "stat"], ["export_ts", "event_id"])
    return out.select("subject_id", "day", "metric", "stat", "value", "event_id")


SQL_LATEST = with_(
    "meas",
    "select subject_id, cast(ts as date) as day, metric, stat, value, event_id from meas qualify row_number() over (partition by subject_id, cast(ts as date), metric, stat order by ts desc, event_id desc) = 1",
)


def q_latest_orders(spark, sf_dir):
    """Latest line of each part at larger row counts."""
    lines = A.table(spark, sf_dir, "lineitem")
    out = Q.latest_wins(lines, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return out.select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")


def q_dedupe_workouts(spark, sf_dir):
    rows = A.workouts(spark, sf_dir).withColumns(
        {
            "workout_id": F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("w"), (F.col("event_id") % 40).cast("string"))).otherwise(""),
            "source_file": A.source_file(), "start_ts": F.expr("date_trunc('day', start_ts)").cast("timestamp_ntz"),
        }
    )
    out = Q.dedupe_workouts(rows, ["end_ts", "event_id"])
    return out.select("subject_id", "workout_id", "start_ts", "end_ts", "event_id")


SQL_WORKOUTS = with_(
    "workouts",
    "select subject_id, workout_id, start_ts, end_ts, event_id from (select subject_id, case when event_id % 2 = 0 then 'w' || (event_id % 40) else '' end as workout_id, "
    "date_trunc('day', start_ts) as start_ts, end_ts, event_id, event_id % 3 as f from workouts) qualify row_number() over "
    "(partition by subject_id, workout_id, case when workout_id = '' then start_ts end, case when workout_id = '' then f end order by end_ts desc, event_id desc) = 1",
)


def q_merge_carbs(spark, sf_dir):
    day = F.expr("date_trunc('day', ts)").cast("timestamp_ntz")
    grams = F.round(F.col("carb_grams") / 20) * 20
    direct = A.carbs(spark, sf_dir).select("subject_id", day.alias("ts"), grams.alias("carb_grams"), "source_file", F.lit("carbs").alias("source_label"))
    implied = A.bolus(spark, sf_dir).select(
        "subject_id", day.alias("ts"), (F.round(F.col("bolus_units") / 2) * 20).alias("carb_grams"), "source_file", F.lit("bolus").alias("source_label")
    )
    return Q.merge_by_priority([(0, direct), (1, implied)], ["subject_id", "ts", "carb_grams"])


SQL_MERGE_CARBS = with_(
    "carbs bolus",
    "select subject_id, ts, carb_grams, source_file, source_label from (select subject_id, date_trunc('day', ts) as ts, round(carb_grams / 20) * 20 as carb_grams, source_file, 'carbs' as source_label, 0 as p from carbs "
    "union all select subject_id, date_trunc('day', ts), round(bolus_units / 2) * 20, source_file, 'bolus', 1 from bolus) qualify row_number() over (partition by subject_id, ts, carb_grams order by p, source_file, source_label) = 1",
)


def q_best_time_column(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("status_group"), F.col("o_orderkey").cast("string").alias("order_key_text"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("string")).alias("sparse_date"),
        F.col("o_orderdate").cast("string").alias("order_date"), F.col("o_orderpriority").alias("priority"),
    )
    # plain numbers are not times
    rows = rows.withColumn("order_key_text", F.concat(F.lit("k"), "order_key_text"))
    return Q.best_time_column(rows, ["status_group"]).withColumn("observed_window_days", F.col("observed_window_days").cast("bigint"))


def wearable_spans(spark, sf_dir):
    return span(
        [A.workouts(spark, sf_dir), A.measurements(spark, sf_dir)], [("start_ts", "end_ts"), ("ts",)]
    )


def q_span_overlap(spark, sf_dir):
    return Q.intersect_spans(kind_spans(pump_kinds(spark, sf_dir)), wearable_spans(spark, sf_dir))


WEAR = "wear as (select subject_id, min(t) as f, max(t) as l from (select subject_id, start_ts as t from workouts union all select subject_id, end_ts from workouts union all select subject_id, ts from meas) group by 1)"


def _wear_sql(body: str) -> str:
    return with_("spans workouts meas", "").rstrip() + ", " + WEAR + " " + body


def q_backfill_need(spark, sf_dir):
    bolus_span = span([A.bolus(spark, sf_dir)], [("ts",)])
    wear = span([A.workouts(spark, sf_dir)], [("start_ts", "end_ts")])
    return Q.backfill_need(bolus_span, wear, history_days=14)


def q_export_calendar(spark, sf_dir):
    spans = kind_spans(pump_kinds(spark, sf_dir))
    back = Q.export_windows(spans, 7, "backward").withColumn("direction", F.lit("backward"))
    fore = Q.export_windows(spans, 7, "forward").withColumn("direction", F.lit("forward"))
    return back.unionByName(fore).select("subject_id", "direction", "requested_start", "requested_end", "window_id")


SQL_CALENDAR = with_(
    "spans",
    ", d as (select subject_id, cast(first_ts as date) as a, cast(last_ts as date) as b from spans), i as (select *, cast(unnest(generate_series(0, b - a, 7)) as integer) as k from d), "
    "w as (select subject_id, 'forward' as direction, a + k as requested_start, least(b, a + k + 6) as requested_end from i "
    "union all select subject_id, 'backward', greatest(a, b - k - 6), b - k from i) select *, requested_start || '__' || requested_end as window_id from w",
).replace(") , d as", "), d as")


def q_latest_device(spark, sf_dir):
    """Per subject the source with the newest event (device selection)."""
    times = event_times(spark, sf_dir)
    last = times.groupBy("subject_id", "source_file").agg(F.max("ts").alias("max_event_ts"), F.count("*").alias("events"))
    return last.groupBy("subject_id").agg(
        F.max_by("source_file", F.struct("max_event_ts", "source_file")).alias("device"), F.max("max_event_ts").alias("max_event_ts")
    )


QUERIES = {
    "export_manifest": (q_export_manifest, f"with {manifest_sql('kind, source_file')} select {manifest_cols('kind, source_file')} from man"),
    "manifest_summary": (q_manifest_summary, SQL_MANIFEST_SUMMARY),
    "coverage_summary": (q_coverage_summary, SQL_COVERAGE),
    "window_quality": (q_window_quality, SQL_WINDOW_QUALITY),
    "quality_status": (q_quality_status, SQL_QUALITY_STATUS),
    "quality_reason_counts": (q_reason_counts, SQL_REASON_COUNTS),
    "window_timeline": (q_window_timeline, SQL_WINDOW_TIMELINE),
    "acquisition_ledger": (q_ledger, SQL_LEDGER),
    "pending_windows": (q_pending_windows, SQL_PENDING),
    "latest_window": (q_latest_window, f"with {QUALITY_SQL} select subject_id, arg_max(window_id, requested_end) as window_id from qual group by 1"),
    "manifest_quality": (q_manifest_quality, SQL_MANIFEST_QUALITY),
    "dense_stream": (q_dense_stream, SQL_DENSE),
    "latest_wins_dedupe": (q_latest_wins, SQL_LATEST),
    "latest_wins_lines": (
        q_latest_orders,
        "select l_partkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice from lineitem qualify row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) = 1",
    ),
    "dedupe_workouts": (q_dedupe_workouts, SQL_WORKOUTS),
    "merge_carbs": (q_merge_carbs, SQL_MERGE_CARBS),
    "best_time_column": (
        q_best_time_column,
        "select o_orderstatus as status_group, 'order_date' as timestamp_column, min(o_orderdate) as first_ts, max(o_orderdate) as last_ts, count(*) as row_count, "
        "cast(max(o_orderdate) as date) - cast(min(o_orderdate) as date) + 1 as observed_window_days from orders group by 1",
    ),
    "span_overlap": (
        q_span_overlap,
        _wear_sql("select subject_id, case when least(last_ts, l) >= greatest(first_ts, f) and f is not null and first_ts is not null then greatest(first_ts, f) end as overlap_start, "
                  "case when least(last_ts, l) >= greatest(first_ts, f) and f is not null and first_ts is not null then least(last_ts, l) end as overlap_end from spans full join wear using (subject_id)"),
    ),
    "backfill_need": (
        q_backfill_need,
        with_("bolus workouts", "").rstrip() + ", b as (select subject_id, cast(min(ts) as date) as first, cast(max(ts) as date) as last from bolus group by 1), "
        "w as (select subject_id, cast(f as date) as ws, cast(l as date) as we from (select subject_id, min(start_ts) as f, max(end_ts) as l from workouts group by 1)), j as (select subject_id, first, last, coalesce(ws, last - 13) as s, coalesce(we, last) as e from b full join w using (subject_id)) "
        "select subject_id, s as requested_start, e as requested_end, case when s is not null and e is not null and (first is null or last is null or first > s or last < e) then 'needed' else 'not_needed' end as backfill_status from j",
    ),
    "export_calendar": (q_export_calendar, SQL_CALENDAR),
    "latest_device": (
        q_latest_device,
        f"with {TIMES} select subject_id, arg_max(source_file, (max_event_ts, source_file)) as device, max(max_event_ts) as max_event_ts from "
        "(select subject_id, source_file, max(ts) as max_event_ts from times group by 1, 2) group by 1",
    ),
}
