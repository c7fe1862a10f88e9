"""Grid, exposure and feature-frame queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.times import HOUR
from pulsegrid.operators import grid as G
from pulsegrid.operators.intervals import close_open_ends, interval_overlap, rate_per_bin
from pulsegrid.operators.kernels import decay_per_point, expand_doses, kernel_per_bin
from pulsegrid.operators.timeline import scan
from pulsegrid.plans.feature_frame import HOURLY, build_feature_frame, full_grid, kind_spans
from pulsegrid.queries.sqlparts import K_ACT, K_IOB, minutes, r, rounded, rs, with_
from pulsegrid.sources import adapters as A
from pulsegrid.sources.stored import shared


def pump_kinds(spark, sf_dir):
    return {
        "cgm": A.cgm(spark, sf_dir), "bolus": A.bolus(spark, sf_dir), "carbs": A.carbs(spark, sf_dir),
        "activity": A.activity(spark, sf_dir), "basal": A.basal(spark, sf_dir),
    }


def hourly_grid(spark, sf_dir):
    return shared(spark, sf_dir, "hourly_grid", lambda: _hourly_grid(spark, sf_dir))


def _hourly_grid(spark, sf_dir):
    return G.time_grid(kind_spans(pump_kinds(spark, sf_dir)), HOUR)


def cgm_bins(spark, sf_dir):
    return G.bin_events(A.cgm(spark, sf_dir), HOUR, {"glucose_observed": F.avg("glucose")})


def q_span(spark, sf_dir):
    return kind_spans(pump_kinds(spark, sf_dir))


def q_time_grid(spark, sf_dir):
    return _hourly_grid(spark, sf_dir)


def q_bin_join(spark, sf_dir):
    step = HOUR
    frame = G.assemble(
        hourly_grid(spark, sf_dir),
        [
            cgm_bins(spark, sf_dir),
            G.bin_events(A.activity(spark, sf_dir), step, {"activity_value": F.sum("activity_value")}),
            G.bin_events(A.carbs(spark, sf_dir), step, {"carb_grams": F.sum("carb_grams")}),
            G.bin_events(A.bolus(spark, sf_dir), step, {"bolus_units": F.sum("bolus_units")}),
        ],
    ).fillna(0.0, subset=["activity_value", "carb_grams", "bolus_units"])
    return rounded(frame, "glucose_observed", "activity_value", "carb_grams", "bolus_units")


SQL_BIN_JOIN = with_(
    "grid cgm_bin act_bin carb_bin bolus_bin",
    f"select g.subject_id, g.ts, {rs('c.glucose_observed')} as glucose_observed, {rs('coalesce(a.v, 0.0)')} as activity_value, "
    f"{rs('coalesce(cb.v, 0.0)')} as carb_grams, {rs('coalesce(b.v, 0.0)')} as bolus_units from grid g left join cgm_bin c using (subject_id, ts) "
    "left join act_bin a using (subject_id, ts) left join carb_bin cb using (subject_id, ts) left join bolus_bin b using (subject_id, ts)",
)


def observed_grid(spark, sf_dir):
    return G.assemble(hourly_grid(spark, sf_dir), [cgm_bins(spark, sf_dir)])


def glucose_grid(spark, sf_dir):
    return G.fill_glucose(observed_grid(spark, sf_dir), gaps=HOURLY.gaps)


def q_gap_flags(spark, sf_dir):
    out = glucose_grid(spark, sf_dir).select(
        "subject_id", "ts", "missing_cgm", "minutes_since_last_cgm", *[f"cgm_gap_ge_{g}m" for g in HOURLY.gaps]
    )
    return rounded(out, "minutes_since_last_cgm")


SQL_GLUCOSE = {"cgm_grid": "grid cgm_bin"}
_OBS = (
    "obs as (select g.subject_id, g.ts, glucose_observed, last_value(case when glucose_observed is not null then ts end ignore nulls) over w as pt, "
    "last_value(glucose_observed ignore nulls) over w as pg, first_value(case when glucose_observed is not null then ts end ignore nulls) over f as qt, "
    "first_value(glucose_observed ignore nulls) over f as qg from grid g left join cgm_bin using (subject_id, ts) "
    "window w as (partition by subject_id order by ts rows between unbounded preceding and current row), "
    "f as (partition by subject_id order by ts rows between current row and unbounded following)), "
    f"glu as (select *, coalesce(glucose_observed, pg + (qg - pg) * {minutes('ts', 'pt')} / {minutes('qt', 'pt')}) as glucose, "
    f"{minutes('ts', 'pt')} as since from obs) "
)


def glucose_sql(body: str) -> str:
    head = with_("grid cgm_bin", "")
    return f"{head.rstrip()}, {_OBS} {body}"


SQL_GAP_FLAGS = glucose_sql(
    f"select subject_id, ts, case when glucose_observed is null then 1 else 0 end as missing_cgm, {rs('since')} as minutes_since_last_cgm, "
    + ", ".join(f"case when since >= {g} then 1 else 0 end as cgm_gap_ge_{g}m" for g in HOURLY.gaps)
    + " from glu"
)


def q_interpolate(spark, sf_dir):
    return rounded(glucose_grid(spark, sf_dir).select("subject_id", "ts", "glucose_observed", "glucose"), "glucose_observed", "glucose")


def q_interpolate_edges(spark, sf_dir):
    out = G.fill_glucose(observed_grid(spark, sf_dir), fill_edges=True, gaps=())
    return rounded(out.select("subject_id", "ts", "glucose"), "glucose")


def q_lags(spark, sf_dir):
    out = G.bounded(
        glucose_grid(spark, sf_dir).select("subject_id", "ts", "glucose"),
        lambda w: G.lag_columns(w, (60, 120, 360), HOUR), back_seconds=6 * HOUR,
    )
    return rounded(out, "glucose", "glucose_lag_60m", "glucose_lag_120m", "glucose_lag_360m")


SQL_LAGS = glucose_sql(
    f"select subject_id, ts, {rs('glucose')} as glucose, "
    + ", ".join(f"{rs(f'coalesce(lag(glucose, {m // 60}) over w, glucose)')} as glucose_lag_{m}m" for m in (60, 120, 360))
    + " from glu window w as (partition by subject_id order by ts)"
)


def q_rolling(spark, sf_dir):
    rows = G.assemble(
        hourly_grid(spark, sf_dir),
        [cgm_bins(spark, sf_dir), G.bin_events(A.activity(spark, sf_dir), HOUR, {"activity_value": F.sum("activity_value")})],
    ).fillna(0.0, subset=["activity_value"])
    out = G.bounded(
        rows,
        lambda w: {
            **G.rolling_columns(w, "glucose_observed", "glucose_roll_mean", (120, 360, 1440), HOUR, "mean"),
            **G.rolling_columns(w, "activity_value", "activity_roll_sum", (120, 360, 1440), HOUR, "sum"),
        },
        back_seconds=24 * HOUR,
    ).drop("glucose_observed", "activity_value")
    return rounded(out, *[c for c in out.columns if "_roll_" in c])


SQL_ROLLING = with_(
    "grid cgm_bin act_bin",
    "select g.subject_id, g.ts, "
    + ", ".join(
        f"{rs(f'{fn} over (partition by g.subject_id order by g.ts rows between {m // 60 - 1} preceding and current row)')} as {name}_{m}m"
        for fn, name in (("avg(glucose_observed)", "glucose_roll_mean"), ("sum(coalesce(v, 0.0))", "activity_roll_sum"))
        for m in (120, 360, 1440)
    )
    + " from grid g left join cgm_bin c using (subject_id, ts) left join act_bin a using (subject_id, ts)",
)


def q_calendar(spark, sf_dir):
    out = G.add_calendar(hourly_grid(spark, sf_dir))
    return rounded(out, "hour_sin", "hour_cos", "dow_sin", "dow_cos", digits=6)


SQL_CALENDAR = with_(
    "grid",
    "select subject_id, ts, "
    f"{rs('sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24.0)', 6)} as hour_sin, {rs('cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24.0)', 6)} as hour_cos, "
    f"{rs('sin(2 * pi() * (isodow(ts) - 1) / 7.0)', 6)} as dow_sin, {rs('cos(2 * pi() * (isodow(ts) - 1) / 7.0)', 6)} as dow_cos, "
    "case when isodow(ts) >= 6 then 1 else 0 end as is_weekend from grid",
)


def q_lead_target(spark, sf_dir):
    rows = glucose_grid(spark, sf_dir).select("subject_id", "ts", "glucose", "glucose_observed")
    out = G.bounded(
        rows,
        lambda w: {
            "target_glucose": G.lead_target(w, 120, HOUR),
            "target_imputed": G.lead_target(w, 120, HOUR, imputed=True),
        },
        ahead_seconds=2 * HOUR,
    ).withColumn("target_delta", F.col("target_glucose") - F.col("glucose"))
    return rounded(out.drop("glucose_observed"), "glucose", "target_glucose", "target_imputed", "target_delta")


SQL_LEAD_TARGET = glucose_sql(
    f"select subject_id, ts, {rs('glucose')} as glucose, {rs('lead(glucose_observed, 2) over w')} as target_glucose, "
    f"{rs('coalesce(lead(glucose_observed, 2) over w, lead(glucose, 2) over w)')} as target_imputed, "
    f"{rs('lead(glucose_observed, 2) over w - glucose')} as target_delta from glu window w as (partition by subject_id order by ts)"
)


def q_minutes_since(spark, sf_dir):
    meals = G.bin_events(A.carbs(spark, sf_dir), HOUR, {"carb_grams": F.sum("carb_grams")})
    rows = G.assemble(hourly_grid(spark, sf_dir), [meals])
    out = scan(rows, last={"_m": F.when(F.col("carb_grams") > 0, F.col("ts"))})
    since = F.coalesce(G.minutes_since("_m"), F.lit(0.0))
    return out.select("subject_id", "ts", r(since).alias("minutes_since_last_meal"))


SQL_MINUTES_SINCE = with_(
    "grid carb_bin",
    "select g.subject_id, g.ts, "
    + rs("coalesce((epoch_us(g.ts) - epoch_us(last_value(case when v > 0 then g.ts end ignore nulls) over (partition by g.subject_id order by g.ts "
         "rows between unbounded preceding and current row))) / 60000000.0, 0.0)")
    + " as minutes_since_last_meal from grid g left join carb_bin using (subject_id, ts)",
)


def q_kernel_expand(spark, sf_dir):
    out = kernel_per_bin(A.bolus(spark, sf_dir), duration=300, step=60)
    return rounded(out, "insulin_activity_units", "iob_units", digits=6)


def q_kernel_points(spark, sf_dir):
    out = expand_doses(A.bolus(spark, sf_dir).filter(F.col("bolus_units") > 0), duration=300, step=5)
    agg = out.groupBy("minutes").agg(F.count("*").alias("points"), F.sum("ia_units").alias("ia_units"), F.sum("iob_units").alias("iob_units"))
    return rounded(agg, "ia_units", "iob_units")


def q_decay_points(spark, sf_dir):
    out = decay_per_point(A.bolus(spark, sf_dir), duration=300, step=30).groupBy("subject_id", "minutes").agg(F.sum("level").alias("level"))
    return rounded(out, "level")


def q_interval_overlap(spark, sf_dir):
    data = pump_kinds(spark, sf_dir)
    closed = close_open_ends(data["basal"], kind_spans(data), HOUR)
    out = interval_overlap(closed, HOUR)
    return out.select("subject_id", "event_id", "ts", r("overlap_minutes").alias("overlap_minutes"))


def q_rate_per_bin(spark, sf_dir):
    data = pump_kinds(spark, sf_dir)
    out = rate_per_bin(close_open_ends(data["basal"], kind_spans(data), HOUR), HOUR, "event_id")
    return rounded(out, "basal_units_per_hour", "basal_units_delivered")


FEATURES = (
    "bolus_units", "insulin_activity_units", "iob_units", "basal_units_per_hour", "basal_units_delivered", "minutes_since_basal_change",
    "activity_value", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "glucose", "minutes_since_last_cgm", "carb_grams",
    "minutes_since_last_meal", "carb_bolus_interaction_60m", "carb_iob_interaction_60m", "glucose_lag_30m", "glucose_lag_60m",
    "glucose_lag_120m", "glucose_roll_mean_60m", "glucose_roll_mean_120m", "glucose_roll_mean_240m", "iob_roll_sum_60m",
    "iob_roll_sum_120m", "iob_roll_sum_240m", "activity_roll_sum_60m", "activity_roll_sum_120m", "activity_roll_sum_240m",
    "carb_roll_sum_60m", "carb_roll_sum_120m", "carb_roll_sum_240m", "target_glucose", "target_delta",
)
FLAGS = ("basal_schedule_change", "is_weekend", "missing_cgm", "meal_event", "cgm_gap_ge_120m", "cgm_gap_ge_240m", "cgm_gap_ge_480m")


def q_feature_frame(spark, sf_dir):
    frame = build_feature_frame(pump_kinds(spark, sf_dir), HOURLY).frame
    return rounded(frame.select("subject_id", "ts", *FEATURES, *FLAGS), *FEATURES, digits=3)


SQL_FEATURE_FRAME = with_(
    "feat",
    "select subject_id, ts, " + ", ".join(f"{rs(c, 3)} as {c}" for c in FEATURES) + ", " + ", ".join(FLAGS) + " from feat",
)


def q_dose_to_samples(spark, sf_dir):
    """Doses rounded to the nearest bin, left-joined with the mean sample of that bin."""
    from pulsegrid.functions.times import round_ts

    doses = A.bolus(spark, sf_dir).select("subject_id", "event_id", "bolus_units", round_ts("ts", HOUR).alias("ts"))
    out = G.join_bins(doses, cgm_bins(spark, sf_dir))
    return rounded(out, "bolus_units", "glucose_observed")


SQL_DOSE_TO_SAMPLES = with_(
    "bolus cgm_bin",
    f"select b.subject_id, b.event_id, {rs('bolus_units')} as bolus_units, b.ts, {rs('glucose_observed')} as glucose_observed from "
    "(select subject_id, event_id, bolus_units, date_trunc('hour', ts + interval 30 minute) as ts from bolus) b left join cgm_bin using (subject_id, ts)",
)


QUERIES = {
    "source_span": (q_span, with_("spans", "select * from spans")),
    "time_grid": (q_time_grid, with_("grid", "select * from grid")),
    "bin_join": (q_bin_join, SQL_BIN_JOIN),
    "gap_flags": (q_gap_flags, SQL_GAP_FLAGS),
    "interpolate": (q_interpolate, glucose_sql(f"select subject_id, ts, {rs('glucose_observed')} as glucose_observed, {rs('glucose')} as glucose from glu")),
    "interpolate_edges": (q_interpolate_edges, glucose_sql(f"select subject_id, ts, {rs('coalesce(glucose, pg, qg)')} as glucose from glu")),
    "lags": (q_lags, SQL_LAGS),
    "rolling": (q_rolling, SQL_ROLLING),
    "calendar": (q_calendar, SQL_CALENDAR),
    "lead_target": (q_lead_target, SQL_LEAD_TARGET),
    "minutes_since": (q_minutes_since, SQL_MINUTES_SINCE),
    "kernel_expand": (q_kernel_expand, with_("kernel_bin", f"select subject_id, ts, {rs('ia', 6)} as insulin_activity_units, {rs('iob', 6)} as iob_units from kernel_bin")),
    "kernel_points": (
        q_kernel_points,
        with_("bolus", f"select cast(m as integer) as minutes, count(*) as points, {rs(f'sum(bolus_units * {K_ACT})')} as ia_units, "
              f"{rs(f'sum(bolus_units * {K_IOB})')} as iob_units from bolus, (select unnest(generate_series(0, 300, 5)) as m) where bolus_units > 0 group by 1"),
    ),
    "decay_points": (
        q_decay_points,
        with_("bolus", f"select subject_id, cast(m as integer) as minutes, {rs('sum(bolus_units * exp(-m / 100.0))')} as level "
              "from bolus, (select unnest(generate_series(0, 300, 30)) as m) group by 1, 2"),
    ),
    "interval_overlap": (q_interval_overlap, with_("overlap", f"select subject_id, event_id, ts, {rs('overlap_minutes')} as overlap_minutes from overlap")),
    "rate_per_bin": (
        q_rate_per_bin,
        with_("rate_bin", f"select subject_id, ts, {rs('rate')} as basal_units_per_hour, {rs('delivered')} as basal_units_delivered, changed as basal_schedule_change from rate_bin"),
    ),
    "feature_frame": (q_feature_frame, SQL_FEATURE_FRAME),
    "dose_to_samples": (q_dose_to_samples, SQL_DOSE_TO_SAMPLES),
}
