"""Research frame, cohorts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.scalars import risk_score, segment_columns
from pulsegrid.operators import cohorts as K
from pulsegrid.operators import profile as P
from pulsegrid.operators.proxies import research_frame
from pulsegrid.plans.prepared import fill_health
from pulsegrid.queries.context_queries import prepared
from pulsegrid.queries.grid_queries import hourly_grid
from pulsegrid.queries.sqlparts import PARTS, minutes, r, rounded, rs, with_
from pulsegrid.sources import adapters as A
from pulsegrid.sources.stored import shared

KEY = "subject_id"
RULES = K.CleanWindowRules(
    premeal_minutes=180, postmeal_minutes=360, prior_minutes=360, early_minutes=120, followup_minutes=240,
    glucose_range=(60.0, 200.0), max_slope=60.0, min_coverage=0.0, max_iob=5.0,
)


def research(spark, sf_dir, mode="strict"):
    """The research frame feeds several branches: stored once per application."""
    return shared(spark, sf_dir, f"research_{mode}", lambda: research_frame(fill_health(prepared(spark, sf_dir)), mode=mode))


stored_research = research


_MIN = "(hour(ts) * 60 + minute(ts))"
SEG = f"case when {_MIN} < 360 then 'overnight' when {_MIN} < 660 then 'morning' when {_MIN} < 1020 then 'afternoon' else 'evening' end"
PARTS["r0"] = (
    "prep",
    f"select p.*, coalesce(p.health_activity_roll_sum_60m, 0.0) as act60, coalesce(prior_night_total_sleep_hours, 0.0) as sleep_h, {SEG} as therapy_segment, "
    "lag(ts) over w as prev_ts, lag(basal_units_per_hour) over w as prev_rate, sum(case when explicit_meal_event > 0 then 1 else 0 end) over (partition by subject_id) as meals, "
    "sum(case when bolus_units > 0.2 then 1 else 0 end) over (partition by subject_id order by ts rows between 11 preceding and current row) as recent_doses, "
    f"(({_MIN} >= 360 and {_MIN} < 600) or ({_MIN} >= 660 and {_MIN} < 840) or ({_MIN} >= 1020 and {_MIN} < 1260)) as meal_hours from prep p window w as (partition by subject_id order by ts)",
)
PARTS["r1"] = (
    "r0",
    "select *, (coalesce(explicit_meal_event > 0, false) or (meals > 0 and coalesce(minutes_since_last_explicit_meal <= 30, false))) as direct, "
    "glucose - glucose_lag_30m > 12 as rise from r0",
)
PARTS["r2"] = (
    "r1",
    "select *, bolus_units >= 0.5 and glucose >= 165 and (rise or glucose_roll_mean_60m >= 155 or not meal_hours) and not direct as corr from r1",
)
PARTS["r3"] = ("r2", "select *, bolus_units >= 0.5 and not corr and (direct or (meal_hours and glucose < 180 and not (recent_doses > 1))) as meal from r2")
PARTS["r4"] = (
    "r3",
    "select *, case when meal then 'meal_like' when corr then 'correction_like' when bolus_units >= 0.5 then 'ambiguous' else 'none' end as bolus_proxy_class, "
    "case when meal and direct then 0.98 when meal then 0.8 else 0.0 end as meal_proxy_confidence, case when corr then 0.85 else 0.0 end as correction_proxy_confidence, "
    "case when meal then 1 else 0 end as meal_proxy_event, case when corr then 1 else 0 end as correction_proxy_event, case when meal then bolus_units else 0.0 end as meal_proxy_units, "
    "case when iob_roll_sum_120m > 1.5 then 1 else 0 end as high_iob_state, case when recent_doses > 1 then 1 else 0 end as stacked_bolus_state, "
    "case when abs(basal_units_per_hour - prev_rate) >= 0.4 then 1 else 0 end as meaningful_basal_rate_change, "
    "case when bolus_units > 0 or iob_roll_sum_120m > 1.5 then 1 else 0 end as recent_bolus_120m, "
    "case when (recent_workout_12h > 0 and workout_count_24h <= 12 and workout_duration_sum_24h <= 86400) or act60 > 0 then 1 else 0 end as recent_exercise_context, "
    "case when sleep_h < 7 then 1 else 0 end as sleep_deficit_flag from r3",
)
PARTS["r5"] = (
    "r4",
    "select *, case when case when meals > 0 then direct or meal or coalesce(minutes_since_last_explicit_meal <= 120, false) else meal end then 1 else 0 end as recent_meal_120m, "
    "case when meals > 0 then coalesce(minutes_since_last_explicit_meal >= 240, false) and not meal else not meal end as fasting, "
    "case when high_iob_state + stacked_bolus_state + meaningful_basal_rate_change > 0 then 1 else 0 end as closed_loop_confounding_flag from r4",
)
PARTS["research"] = (
    "r5",
    "select *, case when fasting and recent_bolus_120m = 0 and missing_cgm = 0 and recent_exercise_context = 0 and closed_loop_confounding_flag = 0 then 1 else 0 end as basal_context, "
    "case when corr and recent_meal_120m = 0 and bolus_units > 0 and glucose >= 140 then 1 else 0 end as correction_context, recent_meal_120m * recent_exercise_context as post_workout_meal_context, "
    f"cast(sum(case when coalesce({minutes('ts', 'prev_ts')} > 180, false) or basal_schedule_change > 0 then 1 else 0 end) over (partition by subject_id order by ts) as bigint) as therapy_stable_epoch from r5",
)
MASKS = (
    "recent_meal_120m", "recent_bolus_120m", "recent_exercise_context", "basal_context", "correction_context", "post_workout_meal_context",
    "sleep_deficit_flag", "high_iob_state", "stacked_bolus_state", "meaningful_basal_rate_change", "closed_loop_confounding_flag",
)
PROXY = ("bolus_proxy_class", "meal_proxy_event", "correction_proxy_event")


def q_segments(spark, sf_dir):
    return hourly_grid(spark, sf_dir).withColumns(segment_columns("ts", "overnight=22:00-06:00,morning=06:00-11:00,afternoon=11:00-17:00,evening=17:00-22:00"))


SQL_SEGMENTS = with_(
    "grid",
    "select *, case therapy_segment when 'overnight' then 0 when 'morning' then 1 when 'afternoon' then 2 else 3 end as therapy_segment_order, "
    + ", ".join(f"case when therapy_segment = '{s}' then 1 else 0 end as segment__{s}" for s in ("overnight", "morning", "afternoon", "evening"))
    + " from (select subject_id, ts, case when hour(ts) >= 22 or hour(ts) < 6 then 'overnight' when hour(ts) < 11 then 'morning' when hour(ts) < 17 then 'afternoon' else 'evening' end as therapy_segment from grid)",
)


def q_dose_proxy(spark, sf_dir):
    out = research(spark, sf_dir).select(KEY, "ts", *PROXY, "meal_proxy_confidence", "correction_proxy_confidence", "meal_proxy_units")
    return rounded(out, "meal_proxy_confidence", "correction_proxy_confidence", "meal_proxy_units")


def q_dose_proxy_broad(spark, sf_dir):
    return research(spark, sf_dir, "broad").groupBy("bolus_proxy_class").agg(F.count("*").alias("rows"), F.sum("meal_proxy_event").alias("meals"))


def q_context_masks(spark, sf_dir):
    return research(spark, sf_dir).select(KEY, "ts", "therapy_segment", *MASKS)


def q_epochs(spark, sf_dir):
    return research(spark, sf_dir).select(KEY, "ts", F.col("therapy_stable_epoch").cast("bigint").alias("therapy_stable_epoch"))


def q_risk_score(spark, sf_dir):
    rows = A.cgm(spark, sf_dir)
    return rows.select(KEY, "event_id", r(risk_score(F.col("glucose"))).alias("risk"))


def q_session_clusters(spark, sf_dir):
    out = K.session_ids(A.carbs(spark, sf_dir).select(KEY, "ts", "event_id", "carb_grams"), 90.0, order=("event_id",))
    agg = out.groupBy(KEY, "session").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("events"),
                                          F.max_by("event_id", F.struct("carb_grams", "event_id")).alias("best_event"))
    return agg.withColumn("session", F.col("session").cast("bigint"))


SQL_SESSIONS = with_(
    "carbs",
    f"select subject_id, session, min(ts) as start_ts, max(ts) as end_ts, count(*) as events, arg_max(event_id, (carb_grams, event_id)) as best_event from (select *, cast(sum(new) over (partition by subject_id order by ts, event_id) as bigint) as session from "
    f"(select *, case when {minutes('ts', 'lag(ts) over (partition by subject_id order by ts, event_id)')} <= 90 then 0 else 1 end as new from carbs)) group by 1, 2",
)


def q_meal_events(spark, sf_dir):
    out = K.meal_events(stored_research(spark, sf_dir))
    return rounded(out, "stated_carbs", "bolus_units", "meal_proxy_confidence", "glucose")


PARTS["meal_ev"] = (
    "research",
    "select subject_id, c, 'meal_' || lpad(cast(c as varchar), 4, '0') as meal_id, arg_max(ts, k) as ts, arg_max(therapy_segment, k) as segment, "
    "case when sum(e) > 0 and sum(meal_proxy_event) > 0 then 'explicit_and_proxy' when sum(e) > 0 then 'explicit_logged' else 'proxy_only' end as evidence_source, "
    "cast(sum(e) as bigint) as explicit_carb_rows, cast(sum(meal_proxy_event) as bigint) as proxy_rows, max(explicit_carb_grams) as stated_carbs, "
    "arg_max(bolus_units, k) as bolus_units, arg_max(meal_proxy_confidence, k) as meal_proxy_confidence, arg_max(glucose, k) as glucose from "
    "(select *, (e, coalesce(explicit_carb_grams, 0.0), meal_proxy_confidence, bolus_units, -epoch_us(ts)) as k, sum(new) over (partition by subject_id order by ts) as c from "
    f"(select *, case when explicit_meal_event > 0 then 1 else 0 end as e, case when {minutes('ts', 'lag(ts) over (partition by subject_id order by ts)')} <= 90 then 0 else 1 end as new "
    "from research where explicit_meal_event > 0 or meal_proxy_event > 0)) group by 1, 2",
)


def q_clean_windows(spark, sf_dir):
    out = K.clean_windows(stored_research(spark, sf_dir), RULES)
    out = out.withColumns({"exclusion_reasons": F.array_join("exclusion_reasons", "|"), "window_row_count": F.col("window_row_count").cast("bigint")})
    return rounded(out, "stated_carbs", "bolus_units", "premeal_glucose", "premeal_delta_30m", "premeal_iob", "cgm_coverage_fraction", digits=3)


def q_candidates_default(spark, sf_dir):
    """Default cohort rules: status counts."""
    out = K.clean_windows(stored_research(spark, sf_dir))
    return out.groupBy("candidate_status", "source_quality_grade").agg(F.count("*").alias("candidates"), F.sum("included").alias("included"))


PARTS["cand"] = (
    "research",
    "select *, 'first_meal_' || lpad(cast(row_number() over (partition by subject_id order by date) as varchar), 4, '0') as candidate_id from "
    "(select *, cast(ts as date) as date from research where therapy_segment = 'morning' and bolus_units >= 1.5 qualify row_number() over (partition by subject_id, cast(ts as date) order by ts) = 1)",
)
PARTS["hits"] = (
    "cand",
    f"select c.subject_id, c.candidate_id, {minutes('w.ts', 'c.ts')} as rel, w.* exclude (subject_id) from cand c join research w on c.subject_id = w.subject_id "
    "and w.ts between c.ts - interval 6 hour and c.ts + interval 6 hour",
)
PARTS["wfacts"] = (
    "hits",
    "select subject_id, candidate_id, arg_max(glucose, ts) filter (rel >= -180 and rel < 0) as last_g, arg_min(glucose, ts) filter (rel >= -180 and rel < 0) as first_g, "
    "arg_max(iob_units, ts) filter (rel >= -180 and rel < 0) as iob, max(greatest(meaningful_basal_rate_change, stacked_bolus_state)) filter (rel >= -180 and rel < 0) as conf, "
    "max(case when rel >= -360 and rel < 0 and bolus_units >= 0.5 then 1 else 0 end) as prior, max(case when rel > 0 and rel <= 240 and bolus_units >= 0.5 then 1 else 0 end) as follow, "
    "avg(missing_cgm) filter (rel >= -180 and rel <= 360) as miss, max(case when rel >= 0 and rel <= 120 and missing_cgm > 0 then 1 else 0 end) as early, "
    "count(*) filter (rel >= -180 and rel <= 360) as n from hits group by 1, 2",
)
PARTS["win0"] = (
    "cand wfacts",
    "select c.*, coalesce(f.last_g, c.glucose) as premeal_glucose, coalesce(f.last_g, c.glucose) - f.first_g as premeal_delta_30m, coalesce(f.iob, c.iob_units, 0.0) as premeal_iob, "
    "case when c.recent_workout_6h > 0 and c.workout_count_24h <= 12 and c.workout_duration_sum_24h <= 86400 then 1 else 0 end as wk6, coalesce(f.conf, 0) as conf, coalesce(f.prior, 0) as prior, "
    "coalesce(f.follow, 0) as follow, coalesce(1 - f.miss, 0.0) as cover, coalesce(f.early, 0) as early, coalesce(f.n, 0) as n from cand c left join wfacts f using (subject_id, candidate_id)",
)
PARTS["win"] = (
    "win0",
    "select *, concat_ws('|', case when prior = 1 then 'recent_bolus_4h' end, case when premeal_iob >= 5.0 then 'high_premeal_iob' end, "
    "case when premeal_glucose is null or premeal_glucose not between 60 and 200 then 'premeal_bg_out_of_range' end, case when premeal_delta_30m is null or abs(premeal_delta_30m) > 60 then 'steep_premeal_slope' end, "
    "case when wk6 = 1 then 'recent_workout_6h' end, case when conf > 0 then 'closed_loop_confounding_premeal' end, case when follow = 1 then 'postmeal_additional_bolus_120m' end, "
    "case when cover < 0.0 then 'poor_cgm_coverage' end, case when early = 1 then 'missing_cgm_first_90m' end) as why from win0",
)
SQL_WINDOWS = with_(
    "win",
    "select subject_id, candidate_id, date, ts as anchor_ts, therapy_segment as segment, case when why = '' then 'accepted' else 'rejected' end as candidate_status, case when why = '' then 1 else 0 end as included, "
    f"why as exclusion_reasons, explicit_carb_source_available, meal_truth_status, {rs('explicit_carb_grams', 3)} as stated_carbs, {rs('bolus_units', 3)} as bolus_units, {rs('premeal_glucose', 3)} as premeal_glucose, "
    f"{rs('premeal_delta_30m', 3)} as premeal_delta_30m, {rs('premeal_iob', 3)} as premeal_iob, wk6 as recent_workout_6h, conf as closed_loop_confounding_premeal, prior as prior_bolus_4h, "
    f"follow as postmeal_additional_bolus_120m, {rs('cover', 3)} as cgm_coverage_fraction, early as missing_cgm_first_90m, n as window_row_count, case when cover >= 0.0 and early = 0 then 'good' else 'degraded' end as source_quality_grade from win",
)


def q_exclusion_summary(spark, sf_dir):
    rows = stored_research(spark, sf_dir)
    windows = K.clean_windows(rows, RULES)
    return K.exclusion_summary(windows).unionByName(K.subjects_without_candidates(rows, windows))


SQL_EXCLUSIONS = with_(
    "win",
    "select subject_id, reason, count(*) as count from (select subject_id, unnest(string_split(why, '|')) as reason from win where why <> '') group by 1, 2 "
    "union all select subject_id, 'accepted_without_exclusions', count(*) from win group by 1 having max(why) = '' "
    "union all select subject_id, 'no_candidates', 0 from (select distinct subject_id from research) anti join win using (subject_id)",
)


def q_day_summary(spark, sf_dir):
    return K.day_summary(research(spark, sf_dir))


def q_day_sample(spark, sf_dir):
    rows = stored_research(spark, sf_dir)
    out = K.representative_days(rows, K.clean_windows(rows, RULES), 3)
    return out.select(KEY, "date", "selection_type", "selection_reason", "row_count", "bolus_rows", "candidate_id", "source_quality_grade", "exclusion_reasons")


PARTS["days"] = ("research", "select subject_id, cast(ts as date) as date, count(*) as row_count, count(*) filter (bolus_units > 0) as bolus_rows from research group by 1, 2")
PARTS["sample"] = (
    "days win",
    "select w.subject_id, w.date, 'candidate' as selection_type, 'first_meal_candidate_day' as selection_reason, row_count, bolus_rows, candidate_id, case when cover >= 0.0 and early = 0 then 'good' else 'degraded' end as source_quality_grade, "
    "why as exclusion_reasons from win w left join days d on w.subject_id = d.subject_id and w.date = d.date union all "
    "select subject_id, date, 'background', 'evenly_spaced_non_candidate_day', row_count, bolus_rows, '', '', '' from (select *, row_number() over (partition by subject_id order by date) - 1 as p, count(*) over (partition by subject_id) as n "
    "from days anti join win using (subject_id, date)) where list_contains([case when least(3, n) > 1 then cast(round_even(i * (n - 1) / (least(3, n) - 1), 0) as bigint) else 0 end for i in generate_series(0, least(3, n) - 1)], p)",
)
SQL_SAMPLE = with_("sample", "select * from sample")


def q_sample_rows(spark, sf_dir):
    rows = stored_research(spark, sf_dir)
    days = K.representative_days(rows, K.clean_windows(rows, RULES), 3)
    return K.rows_of_days(rows, days).groupBy(KEY).agg(F.count("*").alias("rows"))


def q_retention(spark, sf_dir):
    rows = stored_research(spark, sf_dir)
    windows = K.clean_windows(rows, RULES)
    sample = K.rows_of_days(rows, K.representative_days(rows, windows, 3))
    return K.exclusion_retention(K.exclusion_summary(windows), K.exclusion_summary(K.clean_windows(sample, RULES))).select("reason", "source_count", "retained")


SQL_RETENTION = with_(
    "win", "select reason, count(*) as source_count, 'yes' as retained from (select unnest(string_split(why, '|')) as reason from win where why <> '') group by 1 "
)
CARD = ("glucose", "bolus_units", "basal_units_per_hour", "iob_units", "carb_grams", "minutes_since_last_cgm", "heart_rate_avg_latest", "hrv_latest", "respiratory_rate_latest",
        "workout_count_24h", "minutes_since_last_workout", "prior_night_total_sleep_hours")


def q_report_card(spark, sf_dir):
    out = P.report_card(prepared(spark, sf_dir).frame, CARD)
    return rounded(out, "missing_fraction", "mean", "median", "iqr", "min", "max", digits=3)


# the limits that the report card must apply
CARD_LIMITS = {
    "glucose": (40, 450), "bolus_units": (0, 40), "basal_units_per_hour": (0, 10), "heart_rate_avg_latest": (25, 220), "hrv_latest": (0, 250), "respiratory_rate_latest": (5, 40),
    "workout_count_24h": (0, 12), "minutes_since_last_workout": (0, None),
}


def _limit_sql(f: str) -> str:
    lo, hi = CARD_LIMITS.get(f, (None, None))
    parts = ([f"{f} < {lo}"] if lo is not None else []) + ([f"{f} > {hi}"] if hi is not None else [])
    return f"count(*) filter ({' or '.join(parts)})" if parts else "cast(0 as bigint)"


SQL_CARD = with_(
    "prep",
    " union all ".join(
        f"select '{f}' as feature, {rs(f'1 - count({f}) / count(*)', 3)} as missing_fraction, count({f}) as non_missing_count, {rs(f'avg({f})', 3)} as mean, {rs(f'min({f})', 3)} as min, {rs(f'max({f})', 3)} as max, "
        f"{_limit_sql(f)} as impossible_count, {rs(f'median({f})', 3)} as median, {rs(f'quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)', 3)} as iqr from prep"
        for f in CARD
    ),
)
REG = ("glucose", "glucose_lag_30m", "bolus_proxy_class", "meal_proxy_event", "basal_units_per_hour", "recent_meal_120m", "basal_context", "hrv_latest", "heart_rate_avg_latest",
       "in_sleep", "explicit_carb_grams", "is_weekend", "iob_roll_sum_60m", "therapy_segment")


def registry(spark, sf_dir):
    rows = research(spark, sf_dir).select(*REG)
    return P.feature_registry(rows, health=("hrv_latest", "heart_rate_avg_latest", "in_sleep"), unfilled=prepared(spark, sf_dir).frame)


def q_feature_registry(spark, sf_dir):
    return rounded(registry(spark, sf_dir), "availability", "nonzero_fraction")


# the labels that the registry must give: family, alignment, uses, risk
REG_LABELS = {
    "glucose": ("pump_cgm", "current_bin_or_direct_state", "basal,icr,sensitivity_factor", "low"),
    "glucose_lag_30m": ("pump_cgm", "lagged_observation", "basal,icr,sensitivity_factor", "low"),
    "bolus_proxy_class": ("meal_bolus_proxy", "proxy_label", "icr,sensitivity_factor", "moderate"),
    "meal_proxy_event": ("meal_bolus_proxy", "event_proxy", "icr,sensitivity_factor", "moderate"),
    "basal_units_per_hour": ("pump_basal", "current_bin_or_direct_state", "basal", "low"),
    "recent_meal_120m": ("pump_carbs", "current_bin_or_direct_state", "icr", "low"),
    "basal_context": ("therapy_context", "context_mask", "basal,icr,sensitivity_factor", "low"),
    "hrv_latest": ("wearable_measurements", "carry_forward", "basal,icr", "low"),
    "heart_rate_avg_latest": ("wearable_measurements", "current_bin_or_direct_state", "basal,icr", "low"),
    "in_sleep": ("wearable_sleep", "interval_overlay", "basal,icr", "low"),
    "explicit_carb_grams": ("pump_carbs", "current_bin_or_direct_state", "icr", "low"),
    "is_weekend": ("calendar", "current_bin_or_direct_state", "basal,icr,sensitivity_factor", "low"),
    "iob_roll_sum_60m": ("pump_bolus", "rolling_summary", "basal,icr,sensitivity_factor", "low"),
    "therapy_segment": ("derived", "current_bin_or_direct_state", "basal,icr,sensitivity_factor", "low"),
}


def _reg_sql(f: str) -> str:
    nz = f"{f} <> ''" if f in ("bolus_proxy_class", "therapy_segment") else f"{f} <> 0"
    family, rule, uses, risk = REG_LABELS[f]
    return (
        f"select '{f}' as feature, '{family}' as source_family, '{rule}' as alignment_rule, '{uses}' as allowed_use_cases, '{risk}' as leakage_risk, "
        f"{rs(f'count({f}) / count(*)')} as availability, {rs(f'count(*) filter ({nz}) / count(*)')} as nonzero_fraction from research"
    )


SQL_REGISTRY = with_("research", " union all ".join(_reg_sql(f) for f in REG))


def q_registry_rollup(spark, sf_dir):
    return rounded(P.registry_rollup(q_feature_registry(spark, sf_dir)), "mean_availability", "mean_nonzero_fraction")


def q_research_gate(spark, sf_dir):
    """With a first good day inside the data, so that both quality grades occur."""
    return P.research_gate(research(spark, sf_dir), health=("hrv_latest", "in_sleep"), min_ts="2024-01-04", unfilled=prepared(spark, sf_dir).frame)


SQL_GATE = with_(
    "research",
    "select subject_id, p as parameter, case when p = 'basal' then case when b >= 96 and i = 0 then 'directly_observed' when b >= 48 then 'weakly_identified' else 'not_identified' end "
    "when p = 'I/C ratio' then case when d >= 48 then 'directly_observed' when x >= 48 then 'proxy_supported' else 'not_identified' end when c >= 48 then 'weakly_identified' else 'not_identified' end as identifiability, "
    "case when (p = 'basal' and b >= 96 and i = 0) or (p = 'I/C ratio' and d >= 48) then 'research_enabled' else 'diagnostics_only' end as gate_status, case when i > 0 then 'degraded' else 'good' end as source_quality_status, d as direct_meal_rows, x as proxy_meal_rows, "
    "b as basal_context_rows, c as correction_context_rows, case when d > 0 then 'moderate' when x > 0 or a > 0 then 'high' else 'moderate' end as closed_loop_confounding_risk, case when h >= 0.1 then 'credible' else 'limited' end as wearable_alignment_status from "
    "(select subject_id, count(*) filter (explicit_meal_event > 0) as d, count(*) filter (meal_proxy_event > 0) as x, count(*) filter (basal_context > 0) as b, count(*) filter (correction_context > 0) as c, "
    "count(*) filter (bolus_proxy_class = 'ambiguous') as a, count(*) filter (ts < timestamp '2024-01-04') as i, (count(hrv_latest) + count(in_sleep)) / (2.0 * count(*)) as h from research group by 1), (select unnest(['basal', 'I/C ratio', 'sensitivity factor']) as p)",
)


def q_overnight(spark, sf_dir):
    out = rounded(P.overnight_evidence(research(spark, sf_dir)), "mean_glucose", "mean_target_delta")
    return out


SQL_OVERNIGHT = with_(
    "research",
    "select *, case when clean_rows >= 72 and clean_nights >= 3 and stable_epochs >= 2 then 'identifiable' when clean_rows >= 36 and clean_nights >= 2 then 'weakly_identifiable' else 'blocked' end as status, "
    "case when clean_rows >= 72 and clean_nights >= 3 and stable_epochs >= 2 then '' when clean_rows >= 36 and clean_nights >= 2 then 'limited_clean_overnight_windows' else 'insufficient_clean_overnight_windows' end as reason from "
    "(select subject_id, count(*) as overnight_rows, count(*) filter (basal_context = 1) as clean_rows, count(distinct cast(ts as date)) as overnight_nights, count(distinct case when basal_context = 1 then cast(ts as date) end) as clean_nights, "
    f"count(distinct case when basal_context = 1 then therapy_stable_epoch end) as stable_epochs, {rs('avg(glucose) filter (basal_context = 1)')} as mean_glucose, {rs('avg(target_delta) filter (basal_context = 1)')} as mean_target_delta, "
    "cast(sum(recent_meal_120m) as bigint) as excl_recent_meal, cast(sum(recent_bolus_120m) as bigint) as excl_recent_bolus, cast(sum(recent_exercise_context) as bigint) as excl_recent_exercise, "
    "cast(sum(closed_loop_confounding_flag) as bigint) as excl_transition, count(*) filter (missing_cgm > 0) as excl_missing_cgm from research where therapy_segment = 'overnight' group by 1)",
)


def q_proxy_audit(spark, sf_dir):
    return rounded(P.proxy_audit(research(spark, sf_dir)), "mean_meal_confidence", "mean_confidence", "high_glucose_fraction")


SQL_AUDIT = with_(
    "research",
    f"select bolus_proxy_class, count(*) as count, {rs('avg(meal_proxy_confidence)')} as mean_meal_confidence, {rs('avg(greatest(meal_proxy_confidence, correction_proxy_confidence))')} as mean_confidence, "
    f"{rs('avg(case when glucose >= 160 then 1 else 0 end)')} as high_glucose_fraction from research group by 1",
)


def q_truth_status(spark, sf_dir):
    return P.truth_status_counts(prepared(spark, sf_dir).frame)


def q_recent_rows(spark, sf_dir):
    night = hourly_grid(spark, sf_dir).withColumns(segment_columns("ts")).filter(F.col("therapy_segment") == "overnight")
    return K.recent_rows(night.select(KEY, "ts"), 48)


def q_window_metrics(spark, sf_dir):
    rows = stored_research(spark, sf_dir)
    windows = K.clean_windows(rows, RULES).withColumn("included", F.lit(1))
    out = K.window_metrics(rows, K.meal_events(rows), windows, RULES, step_seconds=3600)
    out = out.select(KEY, "candidate_id", "evidence_source", "observed_cgm_points", "observed_peak_glucose", "observed_peak_delta", "observed_auc_above_baseline",
                     "observed_mean_glucose_180m", "sleep_deficit_flag", "recent_exercise_context")
    return rounded(out, "observed_peak_glucose", "observed_peak_delta", "observed_auc_above_baseline", "observed_mean_glucose_180m", digits=3)


SQL_METRICS = with_(
    "win hits meal_ev",
    "select h.subject_id, h.candidate_id, case when coalesce(any_value(e.src), 'proxy_only') = 'proxy_only' and any_value(w.explicit_carb_grams) > 0 then 'explicit_logged' else coalesce(any_value(e.src), 'proxy_only') end as evidence_source, "
    f"count(*) as observed_cgm_points, {rs('max(h.glucose)', 3)} as observed_peak_glucose, {rs('max(h.glucose) - any_value(w.premeal_glucose)', 3)} as observed_peak_delta, "
    f"{rs('sum(greatest(h.glucose - w.premeal_glucose, 0.0))', 3)} as observed_auc_above_baseline, {rs('avg(h.glucose)', 3)} as observed_mean_glucose_180m, "
    "any_value(w.sleep_deficit_flag) as sleep_deficit_flag, any_value(w.recent_exercise_context) as recent_exercise_context from hits h join win w on w.subject_id = h.subject_id and w.candidate_id = h.candidate_id left join "
    "(select w.subject_id, w.candidate_id, arg_min(m.evidence_source, (abs(epoch_us(m.ts) - epoch_us(w.ts)), m.ts)) as src from win w join meal_ev m on w.subject_id = m.subject_id and cast(m.ts as date) = w.date "
    "and abs(epoch_us(m.ts) - epoch_us(w.ts)) <= 5400000000 group by 1, 2) e on e.subject_id = h.subject_id and e.candidate_id = h.candidate_id where h.rel >= 0 and h.rel <= 360 group by 1, 2",
)

QUERIES = {
    "segments": (q_segments, SQL_SEGMENTS),
    "dose_proxy": (
        q_dose_proxy,
        with_("research", "select subject_id, ts, " + ", ".join(PROXY) + f", {rs('meal_proxy_confidence')} as meal_proxy_confidence, {rs('correction_proxy_confidence')} as correction_proxy_confidence, {rs('meal_proxy_units')} as meal_proxy_units from research"),
    ),
    "dose_proxy_broad": (
        q_dose_proxy_broad,
        with_("r2", "select case when corr then 'correction_like' when bolus_units >= 0.5 then 'meal_like' else 'none' end as bolus_proxy_class, count(*) as rows, count(*) filter (bolus_units >= 0.5 and not corr) as meals from r2 group by 1"),
    ),
    "context_masks": (q_context_masks, with_("research", "select subject_id, ts, therapy_segment, " + ", ".join(MASKS) + " from research")),
    "epochs": (q_epochs, with_("research", "select subject_id, ts, therapy_stable_epoch from research")),
    "risk_score": (
        q_risk_score,
        with_("cgm", f"select subject_id, event_id, {rs('abs(glucose - 110) + 2 * greatest(80 - glucose, 0) + 4 * greatest(70 - glucose, 0) + 0.5 * greatest(glucose - 180, 0)')} as risk from cgm"),
    ),
    "session_clusters": (q_session_clusters, SQL_SESSIONS),
    "meal_events": (
        q_meal_events,
        with_("meal_ev", f"select subject_id, meal_id, ts, segment, evidence_source, explicit_carb_rows, proxy_rows, {rs('stated_carbs')} as stated_carbs, {rs('bolus_units')} as bolus_units, {rs('meal_proxy_confidence')} as meal_proxy_confidence, {rs('glucose')} as glucose from meal_ev"),
    ),
    "first_event_windows": (q_clean_windows, SQL_WINDOWS),
    "first_event_windows_default": (q_candidates_default, None),
    "exclusion_summary": (q_exclusion_summary, SQL_EXCLUSIONS),
    "window_metrics": (q_window_metrics, SQL_METRICS),
    "day_summary": (q_day_summary, with_("days", "select * from days")),
    "day_sample": (q_day_sample, SQL_SAMPLE),
    "sample_rows": (q_sample_rows, with_("sample", "select r.subject_id, count(*) as rows from research r semi join sample s on r.subject_id = s.subject_id and cast(r.ts as date) = s.date group by 1")),
    "exclusion_retention": (q_retention, SQL_RETENTION),
    "report_card": (q_report_card, SQL_CARD),
    "feature_registry": (q_feature_registry, SQL_REGISTRY),
    "registry_rollup": (
        q_registry_rollup,
        SQL_REGISTRY.replace("select 'glucose' as feature", "select source_family, count(*) as feature_count, " + f"{rs('avg(a)')} as mean_availability, {rs('avg(n)')} as mean_nonzero_fraction from (select source_family, availability as a, nonzero_fraction as n from (select 'glucose' as feature", 1) + ")) group by 1",
    ),
    "research_gate": (q_research_gate, SQL_GATE),
    "overnight_evidence": (q_overnight, SQL_OVERNIGHT),
    "proxy_audit": (q_proxy_audit, SQL_AUDIT),
    "truth_status": (q_truth_status, with_("prep", "select subject_id, meal_truth_status, count(*) as count from prep group by 1, 2")),
    "recent_rows": (q_recent_rows, with_("grid", "select subject_id, ts from grid where hour(ts) < 6 qualify row_number() over (partition by subject_id order by ts desc) <= 48")),
}
