"""Scenario, gate and latent-exposure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import gates as Gt
from pulsegrid.operators import latent as L
from pulsegrid.operators import models as M
from pulsegrid.operators import profile as P
from pulsegrid.operators import scenarios as S
from pulsegrid.operators import validate as V
from pulsegrid.operators.asof import nearest_within
from pulsegrid.operators.cohorts import clean_windows
from pulsegrid.operators.quantiles import exact_quantiles, leave_one_out_median
from pulsegrid.queries.context_queries import bolus_anchors, prepared_bins, q_event_metrics, SQL_EVENT_METRICS
from pulsegrid.plans.segments import segment_results
from pulsegrid.queries.model_queries import therapy_lines
from pulsegrid.queries.research_queries import RULES, research
from pulsegrid.queries.sqlparts import PARTS, r, rounded, rs, with_
from pulsegrid.sources import adapters as A
from pulsegrid.sources.stored import shared

KEY, SEG = "subject_id", "therapy_segment"
X = "iob_roll_sum_120m"


def _fits(rows):
    return M.solve(M.gram_sums(rows, [SEG], [X], "target_glucose"), [SEG], alpha=1.0)


def forecasts(spark, sf_dir):
    rows = research(spark, sf_dir)
    return S.scenario_forecasts(rows, _fits(rows), [SEG], [X], "ts")


def q_scenarios(spark, sf_dir):
    cols = ["basal_units_per_hour", "bolus_units", "iob_units", X, "carb_iob_interaction_60m"]
    rows = S.apply_scenarios(research(spark, sf_dir).select(KEY, "ts", *cols))
    agg = rows.groupBy(KEY, "scenario").agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in cols])
    return rounded(agg, *cols)


PARTS["scen"] = (
    "",
    "select * from (values " + ", ".join(f"('{s.name}', '{s.setting}', {s.multiplier!r}::double, {s.basal!r}::double, {s.bolus * s.icr!r}::double)" for s in S.SCENARIOS) + ") t(scenario, setting, multiplier, bm, dm)",
)
SQL_SCENARIOS = with_(
    "research scen",
    "select subject_id, scenario, count(*) as rows, " + ", ".join(f"{rs(f'sum({c} * {m})')} as {c}" for c, m in (
        ("basal_units_per_hour", "bm"), ("bolus_units", "dm"), ("iob_units", "dm"), (X, "dm"), ("carb_iob_interaction_60m", "dm"))) + " from research, scen group by 1, 2",
)


def q_scenario_loss(spark, sf_dir):
    return rounded(S.scenario_loss(forecasts(spark, sf_dir), [SEG]), "expected_loss")


PARTS["sfit"] = (
    "research",
    f"select therapy_segment, covar_pop(target_glucose, {X}) * count(*) / (count(*) + 1.0) / var_pop({X}) as slope, avg(target_glucose) - covar_pop(target_glucose, {X}) * count(*) / (count(*) + 1.0) / var_pop({X}) * avg({X}) as intercept "
    "from research group by 1",
)
PARTS["fc"] = (
    "research sfit scen",
    f"select r.therapy_segment, scenario, setting, multiplier, target_glucose, intercept + slope * {X} * dm as pred, intercept + slope * {X} as cur from research r join sfit using (therapy_segment), scen",
)


def q_recommend(spark, sf_dir):
    rows = research(spark, sf_dir)
    policy = rows.groupBy(SEG).agg(
        F.lit("generated").alias("status"), (F.max("meal_event") > 0).alias("carbs_present"), (F.sum("activity_value") > 0).alias("activity_present")
    )
    out = S.recommend(forecasts(spark, sf_dir), [SEG], policy, min_gain=0.0001)
    return rounded(out.withColumn("flags", F.array_join("flags", "|")), "change_percent", "expected_gain", "probability_better")


SQL_RECOMMEND = with_(
    "fc",
    f"select therapy_segment, setting, case when multiplier < 1 then 'decrease' else 'increase' end as direction, {rs('abs(multiplier - 1) * 100')} as change_percent, {rs('gain')} as expected_gain, {rs('p')} as probability_better, scenario as scenario_name, "
    "case when p >= 0.9 then 'high' when p >= 0.75 then 'moderate' else 'low' end as confidence, '' as flags, cast(row_number() over (partition by therapy_segment order by gain desc, scenario) as integer) as rank from "
    "(select *, max(case when scenario = 'current' then loss end) over (partition by therapy_segment) - loss as gain from (select therapy_segment, scenario, setting, multiplier, avg(abs(pred - target_glucose)) as loss, "
    "avg(case when abs(pred - 110) < abs(cur - 110) then 1 else 0 end) as p from fc group by 1, 2, 3, 4)) where scenario <> 'current' and gain >= 0.0001",
)


def q_segment_recommendations(spark, sf_dir):
    """Every subject, segment and task with all reasons: gate, model and gains differ by subject."""
    rows = therapy_lines(spark, sf_dir)
    k = F.col(KEY)
    subjects = rows.select(KEY).distinct()
    off = F.when(k % 5 == 0, "diagnostics_only").otherwise("research_enabled")
    gate = subjects.select(KEY, F.lit("basal").alias("parameter"), off.alias("gate_status"), F.lit("directly_observed").alias("identifiability")).unionByName(
        subjects.filter(k % 4 != 0).select(KEY, F.lit("I/C ratio").alias("parameter"), off.alias("gate_status"), F.lit("proxy_supported").alias("identifiability"))
    )
    facts = {"model_name": F.lit("ridge"), "selected": F.lit(True), "safety_weighted_mae": (k % 30).cast("double"), "coverage": 0.6 + k % 10 / 25}
    comparison = subjects.filter(k % 3 != 0).withColumns({"task": F.lit("basal"), **facts}).unionByName(subjects.filter(k % 2 == 0).withColumns({"task": F.lit("icr"), **facts}))
    _, out = segment_results(rows, gate, comparison, ["basal_units_per_hour"], [KEY], segments=["A", "N", "R", "Z"], order=["l_orderkey", "l_linenumber"])
    return rounded(out, "mean_expected_gain", "fold_better_fraction")


def _risk(g: str) -> str:
    return f"(abs({g} - 110) + 2.0 * greatest(80 - ({g}), 0) + 4.0 * greatest(70 - ({g}), 0) + 0.5 * greatest({g} - 180, 0))"


SQL_SEGMENT_RECOMMENDATIONS = with_(
    "tl",
    f"""select * from (with task as (select * from (values ('basal', 'basal', 0), ('icr', 'I/C ratio', 0), ('sensitivity_factor', 'sensitivity factor', 1)) t(task, parameter, staged)),
model as (select distinct subject_id, task from tl, task where (task = 'basal' and subject_id % 3 <> 0) or (task = 'icr' and subject_id % 2 = 0)),
f as (select task, tl.*, row_number() over (partition by task, subject_id order by ts, l_orderkey, l_linenumber) - 1 as i, count(*) over (partition by task, subject_id) as n from tl, task where (task = 'basal' and basal) or (task = 'icr' and icr)),
g as (select *, case when greatest(n // 2, 24) + greatest(cast(floor(n * 0.2) as bigint), 12) <= n then greatest(n // 2, 24) else greatest(cast(floor(n * 0.6) as bigint), 12) end as first,
  case when greatest(n // 2, 24) + greatest(cast(floor(n * 0.2) as bigint), 12) <= n then greatest(cast(floor(n * 0.2) as bigint), 12) else greatest(n - greatest(cast(floor(n * 0.6) as bigint), 12), 8) end as test from f where n >= 40),
b as (select *, case when i < first then 0 when (i - first) // test + 1 <= (n - first) // test then (i - first) // test + 1 else 0 end as fold from g),
st as (select task, subject_id, fold, min(ts) as start, count(*) as n_test from b where fold > 0 group by all),
tr as (select b.task, b.subject_id, st.fold, x, target_delta as y from b join st on b.task = st.task and b.subject_id = st.subject_id and st.start >= b.ts + interval 1800 second),
fit as (select task, subject_id, fold, covar_pop(y, x) * count(*) / (count(*) + 1.0) / var_pop(x) as slope, avg(y) - covar_pop(y, x) * count(*) / (count(*) + 1.0) / var_pop(x) * avg(x) as intercept from tr group by all having count(*) >= 20),
sc as (select b.task, b.subject_id, b.fold, segment, c, glucose + intercept + slope * x as base, glucose + intercept + slope * x * case when b.task = 'basal' then 1 + c / 100 else 1 end as pred
  from b join fit using (task, subject_id, fold) join st using (task, subject_id, fold) join model using (task, subject_id), (select unnest([-10.0, -5.0, 5.0, 10.0])::double as c) where n_test >= 8),
ga as (select task, subject_id, fold, segment, c, avg({_risk('base')} - {_risk('pred')}) as gain from sc group by all having count(*) >= 3),
gr as (select task, subject_id, segment, c, avg(gain) as gain, avg(case when gain > 0 then 1.0 else 0.0 end) as better, count(*) as folds from ga group by all),
be as (select * from gr qualify row_number() over (partition by task, subject_id, segment order by gain desc, better desc, c) = 1),
gate as (select distinct subject_id, 'basal' as parameter, 'directly_observed' as identifiability from tl union all select distinct subject_id, 'I/C ratio', 'proxy_supported' from tl where subject_id % 4 <> 0),
sp as (select * from (select distinct subject_id from tl), (select unnest(['A', 'N', 'R', 'Z']) as segment), task),
j as (select sp.*, be.c, gain, better, coalesce(identifiability, 'weakly_identified') as identifiability, model.task is not null as has_model, gain is not null as has,
  concat_ws(',', case when subject_id % 30 > 25 then 'model_safety_error_too_high' end, case when 0.6 + subject_id % 10 / 25 < 0.65 then 'coverage_too_low' end,
  case when subject_id % 5 = 0 and identifiability is not null then 'gate_diagnostics_only' end, case when folds < 2 then 'too_few_folds' end, case when gain < 1 then 'expected_gain_too_small' end, case when better < 0.6 then 'inconsistent_fold_direction' end) as against
  from sp left join be using (task, subject_id, segment) left join gate using (subject_id, parameter) left join model using (subject_id, task))
select subject_id, task, parameter, segment, case when not has or against <> '' then 'suppressed' when task = 'icr' then 'exploratory' else 'candidate' end as status,
  case when has and against = '' and task <> 'icr' then c end as proposed_change_percent, case when not has then '' when c > 0 then 'increase' else 'decrease' end as expected_direction,
  {rs('gain')} as mean_expected_gain, {rs('better')} as fold_better_fraction,
  case when staged = 1 then 'staged' when not has or against <> '' or task = 'icr' then 'low' when better >= 0.8 and gain >= 5 then 'high' else 'moderate' end as confidence,
  case when has then 'predicted safety-weighted loss improved on held-out folds' else '' end as reasons_for,
  case when has and task = 'icr' then concat_ws(',', nullif(against, ''), 'exploratory_only_policy') when has then against when staged = 1 then 'staged_parameter' when not has_model then 'insufficient_data_or_model' else 'insufficient_segment_evidence' end as reasons_against,
  identifiability, case when has_model then 'ridge' end as selected_model from j)""",
)


def q_segment_evidence(spark, sf_dir):
    rows = research(spark, sf_dir).withColumns({"cohort": F.lit("all"), "fold": F.weekday("ts")})
    return rounded(S.segment_evidence(rows, ["cohort"]), "actual_target_mean", "actual_target_delta_mean", "low_target_fraction")


SQL_EVIDENCE = with_(
    "research",
    f"select 'all' as cohort, segment, cast(sum(n) as bigint) as split_rows, {rs('avg(a)')} as actual_target_mean, {rs('avg(d)')} as actual_target_delta_mean, {rs('avg(l)')} as low_target_fraction from "
    "(select therapy_segment as segment, isodow(ts) as k, count(*) as n, avg(target_glucose) as a, avg(target_delta) as d, avg(case when target_glucose < 80 then 1 else 0 end) as l from research group by 1, 2 having count(*) >= 3) group by 2",
)


def q_segment_scaling(spark, sf_dir):
    cols = ["basal_units_per_hour", "basal_units_delivered"]
    rows = S.segment_scenarios(research(spark, sf_dir).select(KEY, "ts", SEG, *cols), "basal", ["overnight", "morning"])
    return rounded(rows.groupBy("change_segment", "change_percent").agg(*[F.sum(c).alias(c) for c in cols]), *cols)


SQL_SCALING = with_(
    "research",
    "select s as change_segment, c as change_percent, " + ", ".join(f"{rs(f'sum({v} * case when therapy_segment = s then 1 + c / 100 else 1 end)')} as {v}" for v in ("basal_units_per_hour", "basal_units_delivered"))
    + " from research, (select unnest(['overnight', 'morning']) as s), (select unnest([-10.0, -5.0, 5.0, 10.0]::double[]) as c) group by 1, 2",
)


def q_segment_kernels(spark, sf_dir):
    grid = prepared_bins(spark, sf_dir, KEY, "ts", "bolus_units")
    out = S.segment_kernels(grid, 3600, ["overnight", "morning", "afternoon", "evening"])
    cols = [f"iob__{s}" for s in ("overnight", "morning", "afternoon", "evening")]
    return rounded(out.groupBy(KEY).agg(*[F.sum(c).alias(c) for c in cols], F.sum("iob_roll_sum_120m__morning").alias("roll_morning")), *cols, "roll_morning")


# ------------------------------------------------------------------------ gates


def policy_facts(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias(KEY)).agg(
        F.floor(F.count("*") / 250).alias("n_folds"), F.floor(F.count("*") / 3).alias("min_test_rows"), (F.avg("l_discount") * 16).alias("coverage"),
        F.avg("l_tax").alias("mae"), (F.avg("l_discount") * 0.95).alias("persistence_mae"), F.when(F.min("l_linenumber") == 1, "good").otherwise("degraded").alias("quality_status"),
        F.count_distinct("l_linestatus").alias("chains"), F.count_if((F.col("l_quantity") == 50) & (F.col("l_tax") == 0)).alias("divergences"),
        F.count_if((F.col("l_quantity") == 1) & (F.col("l_discount") == 0)).alias("max_tree_depth_hits"), (1 + F.stddev_pop("l_discount") / 3.2).alias("rhat_max"),
        F.count_if(F.col("l_returnflag") == "A").cast("double").alias("ess_bulk_min"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("ess_tail_min"),
        (F.max("l_extendedprice") > 1000).alias("carbs_present"), (F.max("l_quantity") > 49).alias("activity_present"),
    )


PARTS["pf"] = (
    "",
    "select l_suppkey as subject_id, count(*) // 250 as n_folds, count(*) // 3 as min_test_rows, avg(l_discount) * 16 as coverage, avg(l_tax) as mae, avg(l_discount) * 0.95 as pers, min(l_linenumber) = 1 as good, count(distinct l_linestatus) as chains, "
    "count(*) filter (l_quantity = 50 and l_tax = 0) as divergences, count(*) filter (l_quantity = 1 and l_discount = 0) as hits, 1 + stddev_pop(l_discount) / 3.2 as rhat, count(*) filter (l_returnflag = 'A') as eb, "
    "count(*) filter (l_returnflag = 'R') as et, max(l_extendedprice) > 1000 as carbs, max(l_quantity) > 49 as act from lineitem group by 1",
)


def q_policy(spark, sf_dir):
    out = Gt.recommendation_policy(policy_facts(spark, sf_dir))
    return out.select(KEY, "status", F.array_join("reasons", "|").alias("reasons"), F.col("validation_passed").cast("int").alias("validation_passed"),
                      F.col("sampler_passed").cast("int").alias("sampler_passed"), F.array_join("allowed_settings", "|").alias("allowed_settings"))


SQL_POLICY = with_(
    "pf",
    "select subject_id, case when v = '' and s = '' then 'generated' else 'suppressed' end as status, concat_ws('|', nullif(v, ''), nullif(s, ''), case when not carbs then 'missing_carbs' end, case when not act then 'low_signal' end) as reasons, "
    "cast(v = '' as integer) as validation_passed, cast(s = '' as integer) as sampler_passed, case when carbs then 'basal|bolus|I/C ratio' else 'basal' end as allowed_settings from "
    "(select *, concat_ws('|', case when n_folds < 2 then 'walk_forward_insufficient_folds' end, case when min_test_rows < 200 then 'walk_forward_small_test_fold' end, case when coverage not between 0.70 and 0.90 then 'coverage_out_of_range' end, "
    "case when mae > 0.90 * pers then 'mae_not_meaningfully_better_than_persistence' end, case when not good then 'data_incomplete' end) as v, concat_ws('|', case when chains < 2 then 'sampler_chains_lt_2' end, case when divergences > 0 then 'sampler_divergences' end, "
    "case when hits > 0 then 'sampler_max_treedepth_hits' end, case when rhat > 1.01 then 'sampler_rhat_too_high' end, case when eb < 200 or et < 200 then 'sampler_ess_too_low' end) as s from pf)",
)


def artifacts(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("artifact_family"), "o_orderkey", F.col("o_orderdate").alias("generated_at"), F.lit("1998-01-01").cast("timestamp_ntz").alias("now"),
        F.when(F.col("o_orderstatus") == "P", "degraded").otherwise("good").alias("source_quality_status"), (F.col("o_totalprice") > 20000).alias("validation_passed"),
        (F.col("o_orderkey") % 11 != 0).alias("reproducible"), F.when(F.col("o_orderstatus") == "F", 86400.0 * 365 * 5).alias("freshness_seconds"),
        (F.col("o_orderkey") % 3 != 0).alias("publication_allowed"), (F.col("o_orderkey") % 7 == 0).alias("default_trusted_allowed"),
    )


PARTS["art"] = (
    "",
    "select o_orderpriority as artifact_family, o_orderkey, o_orderdate as generated_at, o_orderstatus = 'P' as bq, o_totalprice <= 20000 as bv, o_orderkey % 11 = 0 as br, "
    "coalesce(o_orderstatus = 'F' and epoch(timestamp '1998-01-01') - epoch(o_orderdate) > 86400.0 * 365 * 5, false) as stale, o_orderkey % 3 <> 0 as pub, o_orderkey % 7 = 0 as dt from orders",
)
PARTS["ready"] = (
    "art",
    "select *, bq or bv or br as blocked, case when bq or bv or br then 'diagnostics_only' when stale then 'research_only' when dt then 'default_trusted' when pub then 'published_latest' else 'research_only' end as trust_level from art",
)


def q_readiness(spark, sf_dir):
    out = Gt.readiness(artifacts(spark, sf_dir))
    return out.select("o_orderkey", "artifact_family", "trust_level", F.array_join("reasons", "|").alias("reasons"), *[F.col(c).cast("int").alias(c) for c in ("blocked", "stale", "publish_latest", "default_trusted")])


SQL_READY = with_(
    "ready",
    "select o_orderkey, artifact_family, trust_level, concat_ws('|', case when bq then 'source_quality_not_good' end, case when bv then 'validation_not_passed' end, case when br then 'not_reproducible' end, case when stale then 'stale_artifact' end) as reasons, "
    "cast(blocked as integer) as blocked, cast(stale as integer) as stale, cast(trust_level in ('published_latest', 'default_trusted') as integer) as publish_latest, cast(trust_level = 'default_trusted' as integer) as default_trusted from ready",
)


def q_promotion(spark, sf_dir):
    out = Gt.promotion(Gt.readiness(artifacts(spark, sf_dir)), ["artifact_family"], "generated_at", ["o_orderkey"])
    return out.select("o_orderkey", "artifact_family", "previous_level", "trust_level", *[F.col(c).cast("int").alias(c) for c in ("promoted", "demoted", "changed")])


_LV = "list_position(['diagnostics_only', 'research_only', 'published_latest', 'default_trusted'], {0})"
SQL_PROMOTION = with_(
    "ready",
    f"select o_orderkey, artifact_family, prev as previous_level, trust_level, cast(prev is null or {_LV.format('trust_level')} > {_LV.format('prev')} as integer) as promoted, cast(prev is not null and {_LV.format('trust_level')} < {_LV.format('prev')} as integer) as demoted, "
    f"cast(prev is null or trust_level <> prev as integer) as changed from (select *, lag(trust_level) over (partition by artifact_family order by generated_at, o_orderkey) as prev from ready)",
)


def q_status(spark, sf_dir):
    rows = research(spark, sf_dir)
    gate = P.research_gate(rows, health=("hrv_latest",)).filter(F.col("parameter") == "I/C ratio")
    night = P.overnight_evidence(rows).select(KEY, F.col("status").alias("overnight_status"))
    scores = P.forecast_scores(
        rows.withColumns({"actual": F.col("target_glucose"), "pred": F.col("glucose_roll_mean_120m"), "lower": F.col("glucose_roll_mean_120m") - 20, "upper": F.col("glucose_roll_mean_120m") + 20}), [KEY]
    ).join(P.persistence_scores(rows), KEY)
    facts = gate.join(night, KEY, "left").join(scores, KEY, "left").select(
        KEY, "overnight_status", F.col("closed_loop_confounding_risk").alias("confounding_risk"), F.col("source_quality_status").alias("research_quality_status"), "direct_meal_rows", "proxy_meal_rows",
        F.lit("good").alias("data_quality_status"), F.col("mae").alias("model_mae"), "persistence_mae", "coverage", F.lit(1.0).alias("rhat_max"), F.lit(400.0).alias("ess_bulk_min"),
        F.lit(0).alias("divergences"), F.lit(0).alias("max_tree_depth_hits"), F.lit(0).alias("candidate_count"),
    )
    out = Gt.current_status(facts)
    return out.select(KEY, "overall_state", F.array_join("blockers", "|").alias("blockers"), F.array_join("next_actions", "|").alias("next_actions"))


SQL_STATUS = with_(
    "research",
    "select subject_id, case when b <> '' then 'blocked' else 'no_change_supported' end as overall_state, b as blockers, case when b <> '' then a else 'keep_monitoring' end as next_actions from (select subject_id, "
    "concat_ws('|', case when blocked then 'insufficient_clean_overnight_windows' end, case when risky then 'high_closed_loop_confounding' end, case when d = 0 and x < 48 then 'insufficient_carb_or_meal_signal' end, case when weak then 'weak_forecast_validation' end) as b, "
    "concat_ws('|', case when blocked then 'collect_clean_overnight_windows' end, case when risky then 'inspect_closed_loop_activity' end, case when d = 0 and x < 48 then 'capture_meal_evidence' end, case when weak then 'treat_forecast_as_untrusted' end) as a from "
    "(select subject_id, count(*) filter (explicit_meal_event > 0) as d, count(*) filter (meal_proxy_event > 0) as x, count(*) filter (explicit_meal_event > 0) = 0 and (count(*) filter (meal_proxy_event > 0) > 0 or count(*) filter (bolus_proxy_class = 'ambiguous') > 0) as risky, "
    "count(*) filter (therapy_segment = 'overnight') > 0 and not (count(*) filter (therapy_segment = 'overnight' and basal_context = 1) >= 36 and count(distinct case when therapy_segment = 'overnight' and basal_context = 1 then cast(ts as date) end) >= 2) as blocked, "
    "avg(abs(target_glucose - glucose_roll_mean_120m)) >= avg(abs(target_glucose - glucose)) or avg(case when target_glucose between glucose_roll_mean_120m - 20 and glucose_roll_mean_120m + 20 then 1 else 0 end) < 0.65 as weak from research group by 1))",
)

# ----------------------------------------------------------------------- latent


def latent_metrics(spark, sf_dir):
    """Response metrics of every dose as latent-exposure input."""
    return shared(spark, sf_dir, "latent_metrics", lambda: _latent_metrics(spark, sf_dir))


def _latent_metrics(spark, sf_dir):
    anchors = bolus_anchors(spark, sf_dir)
    near = nearest_within(anchors, A.carbs(spark, sf_dir), "carb_grams", max_minutes=720, same_day=False).select(KEY, "anchor_id", F.col("carb_grams").alias("stated_carbs"))
    facts = q_event_metrics(spark, sf_dir).filter(F.col("peak_delta").isNotNull())
    return facts.join(anchors, [KEY, "anchor_id"]).join(near, [KEY, "anchor_id"], "left").select(
        KEY, F.col("anchor_id").alias("meal_id"), F.col("anchor_ts").alias("ts"), "bolus_units", "stated_carbs", F.col("peak_delta").alias("observed_peak_delta"),
        F.col("area_above").alias("observed_auc_above_baseline"), F.col("stated_carbs").isNotNull().cast("int").alias("explicit_carb_source_available"),
        F.when(F.col("points_post") >= 1, "good").otherwise("degraded").alias("source_quality_grade"), (F.col("points_pre") > 2).cast("int").alias("recent_exercise_context"),
    )


PARTS["em"] = ("", SQL_EVENT_METRICS)
PARTS["lm"] = (
    "em bolus carbs",
    "select e.subject_id, e.anchor_id as meal_id, b.ts, b.bolus_units, n.carb_grams as stated_carbs, e.peak_delta as peak, e.area_above as auc, case when n.carb_grams is not null then 1 else 0 end as explicit, "
    "case when points_post >= 1 then 'good' else 'degraded' end as grade, case when points_pre > 2 then 1 else 0 end as exercise, row_number() over (partition by e.subject_id order by e.anchor_id) as rn, count(*) over (partition by e.subject_id) as cnt "
    "from em e join bolus b on b.event_id = e.anchor_id left join (select b.event_id, c.carb_grams from bolus b join carbs c on b.subject_id = c.subject_id and abs(epoch_us(c.ts) - epoch_us(b.ts)) <= 43200000000 "
    "qualify row_number() over (partition by b.event_id order by abs(epoch_us(c.ts) - epoch_us(b.ts)), c.ts, c.carb_grams) = 1) n on n.event_id = e.anchor_id where e.peak_delta is not null",
)
_ICR = "median(case when stated_carbs / nullif(bolus_units, 0) > 3 and stated_carbs / nullif(bolus_units, 0) < 30 then stated_carbs / nullif(bolus_units, 0) end)"


def _param_sql(source: str, by: str) -> str:
    return (
        f"select {by}, least(greatest(i, 4.0), 20.0) as icr_prior, least(greatest(coalesce(p / i, 4.0), 0.5), 12.0) as peak_per_carb, least(greatest(coalesce(a / i, 8.0), 0.5), 30.0) as auc_per_carb from "
        f"(select {by}, coalesce({_ICR}, 10.0) as i, median(peak / nullif(bolus_units, 0)) as p, median(auc / nullif(bolus_units, 0)) as a from {source} group by all)"
    )


_REF = "bolus_units * icr_prior"
_RESP = f"(0.55 * coalesce(auc / auc_per_carb, {_REF}) + 0.25 * coalesce(peak / peak_per_carb, {_REF}) + 0.20 * {_REF})"
EST = {
    "bolus_reference": f"greatest({_REF}, 1.0)",
    "stated_prior_blend": f"greatest(case when stated_carbs > 0 then 0.7 * stated_carbs + 0.3 * {_REF} else {_REF} end, 1.0)",
    "response_adjusted": f"greatest(case when stated_carbs > 0 then 0.2 * stated_carbs + 0.8 * {_RESP} else {_RESP} end, 1.0)",
}
PARTS["lparam"] = ("lm", _param_sql("lm", "subject_id"))
_EST_ROWS = "unnest([" + ", ".join(f"{{'model': '{m}', 'latent': {e}}}" for m, e in EST.items()) + "])"
# brute force: every held-out window against all others of its subject
PARTS["pairs"] = ("lm", "select h.meal_id as held, t.* from lm h join lm t on h.subject_id = t.subject_id and (h.meal_id <> t.meal_id or h.cnt = 1)")
PARTS["pparam"] = ("pairs", _param_sql("pairs", "held"))
PARTS["ptrain"] = ("pairs pparam", f"select held, peak, p.peak_per_carb, {_EST_ROWS} as e from pairs join pparam p using (held)")
PARTS["pscale"] = ("ptrain", "select held, e.model as model, coalesce(median(peak / e.latent), any_value(peak_per_carb)) as scale from ptrain group by 1, 2")
PARTS["phold"] = ("lm pparam", f"select subject_id, meal_id, peak, stated_carbs, {_EST_ROWS} as e from lm join pparam p on p.held = lm.meal_id")
PARTS["ploo"] = (
    "phold pscale",
    "select h.subject_id, h.meal_id, h.e.model as model, h.e.latent as latent, abs(h.e.latent * s.scale - h.peak) as peak_error, abs(h.e.latent - h.stated_carbs) as stated_error from phold h join pscale s on s.held = h.meal_id and s.model = h.e.model",
)
PARTS["lfull"] = ("lm lparam", f"select subject_id, peak, {_EST_ROWS} as e from lm join lparam using (subject_id)")
PARTS["lcomp"] = (
    "ploo lfull",
    "select *, row_number() over (partition by subject_id order by coalesce(round(pm, 6), 1e300), coalesce(round(sm, 6), 1e300), model) = 1 as selected from (select subject_id, model, count(*) as meal_count, avg(peak_error) as pm, avg(stated_error) as sm from ploo group by 1, 2) "
    "left join (select subject_id, e.model as model, case when min(e.latent) < max(e.latent) and min(peak) < max(peak) then corr(e.latent, peak) end as pc from lfull group by 1, 2) using (subject_id, model)",
)


def q_latent_params(spark, sf_dir):
    return rounded(L.reference_parameters(latent_metrics(spark, sf_dir)), "icr_prior", "peak_per_carb", "auc_per_carb")


def q_latent_estimates(spark, sf_dir):
    rows = latent_metrics(spark, sf_dir)
    out = rows.join(L.reference_parameters(rows), KEY).withColumns(L.estimates()).select(KEY, "meal_id", *L.ESTIMATORS)
    return rounded(out, *L.ESTIMATORS)


def q_latent_loo(spark, sf_dir):
    return rounded(L.leave_one_out(latent_metrics(spark, sf_dir)), "latent", "peak_error", "stated_error", digits=3)


def compared(spark, sf_dir):
    return shared(spark, sf_dir, "latent_comparison", lambda: L.compare_estimators(latent_metrics(spark, sf_dir)))


def q_latent_comparison(spark, sf_dir):
    out = compared(spark, sf_dir).withColumn("selected", F.col("selected").cast("int"))
    return rounded(out, "peak_delta_mae", "stated_carb_mae", "peak_delta_correlation", digits=3)


def events_of(spark, sf_dir):
    return L.latent_events(latent_metrics(spark, sf_dir), compared(spark, sf_dir).filter("selected"))


EV = ("latent_mean", "latent_lower", "latent_upper", "carb_accuracy_score", "ic_mean", "ic_lower", "ic_upper")


def q_latent_events(spark, sf_dir):
    out = events_of(spark, sf_dir).withColumn("suppression_reasons", F.array_join("suppression_reasons", "|"))
    out = out.select(KEY, "meal_id", "selected_model", "identifiability_status", "confounding_grade", "confidence_tier", "suppression_reasons", *EV)
    return rounded(out, *EV, digits=3)


PARTS["lsel"] = (
    "lm lparam lcomp",
    f"select *, case model when 'bolus_reference' then {EST['bolus_reference']} when 'stated_prior_blend' then {EST['stated_prior_blend']} else {EST['response_adjusted']} end as m from lm join lparam using (subject_id) join (select subject_id, model from lcomp where selected) using (subject_id)",
)
PARTS["lw"] = (
    "lsel",
    "select *, case when explicit = 1 then 1.1 else 1.35 end * greatest(m * 0.18, abs(peak - m * sc) / greatest(sc, 1e-6)) as w, case when stated_carbs > 0 then exp(-abs(m - stated_carbs) / greatest(15.0, stated_carbs * 0.35)) "
    "else 0.75 * exp(-abs(m - bolus_units * icr_prior) / greatest(12.0, bolus_units * icr_prior * 0.30)) end as score from (select *, median(peak / m) over (partition by subject_id) as sc from lsel)",
)
PARTS["lev"] = (
    "lw",
    "select *, concat_ws('|', case when grade <> 'good' then 'degraded_source_quality' end, case when exercise > 0 then 'exercise_context' end, case when peak < 20 then 'weak_postmeal_signal' end, "
    "case when (m + w - greatest(1.0, m - w)) / m > 0.70 then 'wide_posterior_interval' end, case when bolus_units < 2 then 'small_bolus_anchor' end) as why from lw",
)
SQL_EVENTS = with_(
    "lev",
    "select subject_id, meal_id, model as selected_model, case when why = '' then case when explicit = 1 then 'directly_observed' else 'proxy_supported' end when grade <> 'good' or peak < 20 then 'not_identified' else 'weakly_identified' end as identifiability_status, "
    "case when exercise > 0 then 'moderate' when why <> '' then 'low_to_moderate' else 'low' end as confounding_grade, case when score >= 0.8 then 'high' when score >= 0.6 then 'medium' else 'low' end as confidence_tier, why as suppression_reasons, "
    f"{rs('m', 3)} as latent_mean, {rs('greatest(1.0, m - w)', 3)} as latent_lower, {rs('m + w', 3)} as latent_upper, {rs('score', 3)} as carb_accuracy_score, "
    + ", ".join(f"{rs(f'''case when why = '' then ({e}) / greatest(bolus_units, 1e-6) end''', 3)} as {n}" for n, e in (("ic_mean", "m"), ("ic_lower", "greatest(1.0, m - w)"), ("ic_upper", "m + w"))) + " from lev",
)


def q_cohort_gate(spark, sf_dir):
    rows = research(spark, sf_dir)
    return rounded(L.cohort_gate(clean_windows(rows, RULES), rows), "accepted_fraction")


SQL_COHORT = with_(
    "win research",
    f"select subject_id, n as evaluated_candidates, ok as accepted_windows, {rs('case when n > 0 then ok / n else 0.0 end')} as accepted_fraction, "
    "case when ok > 0 then 'good' when n > 0 then 'limited' else 'failed' end as source_quality_status, case when ok > 0 then 'ready_for_latent_fit' else 'no_clean_windows_identified' end as cohort_status from "
    "(select r.subject_id, count(w.subject_id) as n, count(*) filter (w.why = '') as ok from (select distinct subject_id from research) r left join win w on w.subject_id = r.subject_id group by 1)",
)


def q_latent_gate(spark, sf_dir):
    windows = latent_metrics(spark, sf_dir).withColumn("included", (F.col("source_quality_grade") == "good").cast("int"))
    return L.full_gate(windows, events_of(spark, sf_dir), research(spark, sf_dir))


SQL_LATENT_GATE = with_(
    "lev research",
    "select subject_id, p as parameter, case when p = 'morning_icr' then case when rep > 0 then 'weakly_identified' else 'not_identified' end when acc > 0 then 'proxy_supported' else 'not_identified' end as identifiability, "
    "case when (p = 'morning_icr' and rep > 0) or (p <> 'morning_icr' and acc > 0) then 'research_enabled' else 'diagnostics_only' end as gate_status, acc as accepted_windows, rep as reportable, case when acc > 0 then 'good' when n > 0 then 'limited' else 'failed' end as source_quality_status from "
    "(select r.subject_id, count(lev.subject_id) as n, count(*) filter (grade = 'good') as acc, count(*) filter (why = '') as rep from (select distinct subject_id from research) r left join lev on lev.subject_id = r.subject_id group by 1), (select unnest(['latent_carbs', 'carb_entry_confidence', 'morning_icr']) as p)",
)


def q_loo_median(spark, sf_dir):
    """Leave-one-out medians at larger group sizes: prices per supplier."""
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("v"))
    out = leave_one_out_median(rows, ["grp"], "row_id", "v", 0.0, "loo")
    return rounded(out.groupBy("grp").agg(F.count("*").alias("rows"), F.count_distinct("loo").alias("values"), F.min("loo").alias("lo"), F.max("loo").alias("hi")), "lo", "hi")


def q_quantiles(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem")
    out = exact_quantiles(rows, ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p999": 0.999})
    return rounded(out.withColumnRenamed("_n", "n"), "p10", "p25", "p50", "p90", "p999")


QUERIES = {
    "scenarios": (q_scenarios, SQL_SCENARIOS),
    "scenario_loss": (q_scenario_loss, with_("fc", f"select therapy_segment, scenario, setting, multiplier, {rs('avg(abs(pred - target_glucose))')} as expected_loss, count(*) as rows from fc group by 1, 2, 3, 4")),
    "recommendations": (q_recommend, SQL_RECOMMEND),
    "segment_recommendations": (q_segment_recommendations, SQL_SEGMENT_RECOMMENDATIONS),
    "segment_evidence": (q_segment_evidence, SQL_EVIDENCE),
    "segment_scaling": (q_segment_scaling, SQL_SCALING),
    "segment_kernels": (q_segment_kernels, None),
    "recommendation_policy": (q_policy, SQL_POLICY),
    "readiness": (q_readiness, SQL_READY),
    "promotion": (q_promotion, SQL_PROMOTION),
    "current_status": (q_status, SQL_STATUS),
    "latent_params": (q_latent_params, with_("lparam", f"select subject_id, {rs('icr_prior')} as icr_prior, {rs('peak_per_carb')} as peak_per_carb, {rs('auc_per_carb')} as auc_per_carb from lparam")),
    "latent_estimates": (q_latent_estimates, with_("lm lparam", "select subject_id, meal_id, " + ", ".join(f"{rs(e)} as {m}" for m, e in EST.items()) + " from lm join lparam using (subject_id)")),
    "latent_loo": (q_latent_loo, with_("ploo", f"select subject_id, meal_id, model, {rs('latent', 3)} as latent, {rs('peak_error', 3)} as peak_error, {rs('stated_error', 3)} as stated_error from ploo")),
    "latent_comparison": (
        q_latent_comparison,
        with_("lcomp", f"select subject_id, model, meal_count, {rs('pm', 3)} as peak_delta_mae, {rs('sm', 3)} as stated_carb_mae, {rs('pc', 3)} as peak_delta_correlation, cast(selected as integer) as selected from lcomp"),
    ),
    "latent_events": (q_latent_events, SQL_EVENTS),
    "cohort_gate": (q_cohort_gate, SQL_COHORT),
    "latent_gate": (q_latent_gate, SQL_LATENT_GATE),
    "leave_one_out_median": (q_loo_median, None),
    "exact_quantiles": (
        q_quantiles,
        "select l_returnflag, count(*) as n, " + ", ".join(f"{rs(f'quantile_cont(l_extendedprice, {p})')} as {n}" for n, p in (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p90", 0.9), ("p999", 0.999))) + " from lineitem group by 1",
    ),
}
