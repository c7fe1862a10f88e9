"""Shared SQL building blocks of the oracle queries (one-hour grid)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import kernel_constants


def _nudge(digits: int) -> float:
    """Far below the last digit kept, far above float noise: exact halves round
    the same way on both sides."""
    return 2.7 * 10.0 ** -(digits + 3)


def r(x: Column | str, digits: int = 4) -> Column:
    """Round for comparison and drop the sign of zero."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(_nudge(digits)), digits) + F.lit(0.0)


def rs(x: str, digits: int = 4) -> str:
    return f"(round(({x}) + {_nudge(digits)!r}, {digits}) + 0.0)"


def rounded(df, *names: str, digits: int = 4):
    return df.withColumns({n: r(n, digits) for n in names})


_TAU, _A, _S = kernel_constants(300.0)
K_ACT = f"({_S / _TAU**2!r} * m * (1 - m / 300.0) * exp(-m / {_TAU!r}))"
K_IOB = f"(1 - {_S * (1 - _A)!r} * ((m * m / {_TAU * 300 * (1 - _A)!r} - m / {_TAU!r} - 1) * exp(-m / {_TAU!r}) + 1))"
K = "cast(json_extract(props, '$.k') as integer)"
MIN = "(epoch_us({0}) - epoch_us({1})) / 60000000.0"


def minutes(later: str, earlier: str) -> str:
    return "(" + MIN.format(later, earlier) + ")"


def _kind(event: str, cols: str) -> str:
    return (
        f"select user_id as subject_id, ts, {cols}, 'export_' || (event_id % 3) as source_file, event_id "
        f"from events where event_type = '{event}'"
    )


# name -> (needs, sql)
PARTS: dict[str, tuple[str, str]] = {
    "cgm": ("", _kind("view", "value + 60 as glucose")),
    "bolus": ("", _kind("purchase", "value / 10 as bolus_units")),
    "carbs": ("", _kind("error", "value as carb_grams")),
    "activity": ("", _kind("click", "value as activity_value")),
    "basal": (
        "",
        "select user_id as subject_id, ts as start_ts, lead(ts) over (partition by user_id order by ts, event_id) as end_ts, "
        "value / 50 as basal_units_per_hour, 'export_' || (event_id % 3) as source_file, event_id from events where event_type = 'signup'",
    ),
    "workouts": (
        "",
        f"select user_id as subject_id, event_id, ts as start_ts, ts + to_minutes({K}) as end_ts, cast({K} * 60 as double) as duration_seconds, "
        f"value / 100 as distance_value, value as active_energy_value, value / 4 + 60 as avg_heart_rate, value / 3 + 80 as max_heart_rate "
        f"from events where event_type = 'click' and {K} >= 80",
    ),
    "sleep": (
        "",
        f"select user_id as subject_id, cast(ts as date) as date, ts as sleep_start, ts + to_minutes({K} * 6) as sleep_end, {K} / 10.0 as total_sleep_hours, "
        f"{K} / 10.0 + 0.5 as in_bed_hours, {K} / 20.0 as core_hours, {K} / 50.0 as deep_hours, {K} / 40.0 as rem_hours, 0.5 as awake_hours, event_id "
        "from events where event_type = 'signup'",
    ),
    "meas": (
        "",
        f"select user_id as subject_id, ts, case {K} % 4 when 0 then 'heart_rate' when 1 then 'heart_rate_variability' when 2 then 'respiratory_rate' "
        f"else 'resting_heart_rate' end as metric, case when {K} % 4 <> 0 then 'value' else ['avg','min','max'][1 + event_id % 3] end as stat, value, "
        "'export_' || (event_id % 3) as source_device, event_id from events where event_type = 'view'",
    ),
    "hact": (
        "",
        f"select user_id as subject_id, ts, cast({K} as double) as activity_value, 'export_' || (event_id % 3) as source_device, event_id "
        "from events where event_type = 'click'",
    ),
    "spans": (
        "cgm bolus carbs activity basal",
        "select subject_id, min(t) as first_ts, max(t) as last_ts from (select subject_id, ts as t from cgm union all select subject_id, ts from bolus "
        "union all select subject_id, ts from carbs union all select subject_id, ts from activity union all select subject_id, start_ts from basal "
        "union all select subject_id, end_ts from basal) where t is not null group by 1",
    ),
    "bounds": (
        "spans",
        "select subject_id, date_trunc('hour', first_ts) as lo, case when date_trunc('hour', last_ts) < last_ts then date_trunc('hour', last_ts) + interval 1 hour "
        "else last_ts end as hi from spans",
    ),
    "grid": ("bounds", "select subject_id, unnest(generate_series(lo, hi, interval 1 hour)) as ts from bounds"),
    "cgm_bin": ("cgm", "select subject_id, date_trunc('hour', ts) as ts, avg(glucose) as glucose_observed from cgm group by 1, 2"),
    "act_bin": ("activity", "select subject_id, date_trunc('hour', ts) as ts, sum(activity_value) as v from activity group by 1, 2"),
    "carb_bin": ("carbs", "select subject_id, date_trunc('hour', ts) as ts, sum(carb_grams) as v from carbs group by 1, 2"),
    "bolus_bin": ("bolus", "select subject_id, date_trunc('hour', ts) as ts, sum(bolus_units) as v from bolus group by 1, 2"),
    "kernel_bin": (
        "bolus",
        "select subject_id, date_trunc('hour', ts + to_minutes(cast(m as bigint))) as ts, "
        f"sum(bolus_units * {K_ACT}) as ia, sum(bolus_units * {K_IOB}) as iob "
        "from bolus, (select unnest(generate_series(0, 300, 60)) as m) where bolus_units > 0 group by 1, 2",
    ),
    "basal_closed": (
        "basal bounds",
        "select b.subject_id, start_ts, coalesce(end_ts, hi + interval 1 hour) as end_ts, basal_units_per_hour, event_id from basal b join bounds using (subject_id)",
    ),
    "basal_prev": (
        "basal_closed",
        "select *, lag(basal_units_per_hour) over (partition by subject_id order by start_ts, event_id) as prev from basal_closed where end_ts > start_ts",
    ),
    "overlap": (
        "basal_prev grid",
        f"select g.subject_id, g.ts, b.start_ts, b.end_ts, b.event_id, b.basal_units_per_hour, b.prev, "
        f"{minutes('least(g.ts + interval 1 hour, b.end_ts)', 'greatest(g.ts, b.start_ts)')} as overlap_minutes "
        "from grid g join basal_prev b on g.subject_id = b.subject_id and b.start_ts < g.ts + interval 1 hour and b.end_ts > g.ts",
    ),
    "rate_bin": (
        "overlap",
        "select subject_id, ts, sum(basal_units_per_hour * overlap_minutes) / sum(overlap_minutes) as rate, "
        "sum(basal_units_per_hour * overlap_minutes) / 60.0 as delivered, greatest(max(case when date_trunc('hour', start_ts) = ts and prev is not null and "
        "abs(basal_units_per_hour - prev) > 1e-8 + 1e-5 * abs(prev) then 1 else 0 end), case when count(*) > 1 then 1 else 0 end) as changed from overlap group by 1, 2",
    ),
    "base": (
        "grid cgm_bin act_bin carb_bin bolus_bin kernel_bin rate_bin",
        "select g.subject_id, g.ts, c.glucose_observed, coalesce(a.v, 0.0) as activity_value, coalesce(cb.v, 0.0) as carb_grams, coalesce(b.v, 0.0) as bolus_units, "
        "coalesce(k.ia, 0.0) as insulin_activity_units, coalesce(k.iob, 0.0) as iob_units, coalesce(r.rate, 0.0) as basal_units_per_hour, "
        "coalesce(r.delivered, 0.0) as basal_units_delivered, coalesce(r.changed, 0) as basal_schedule_change, "
        "case when coalesce(cb.v, 0.0) > 0 then 1 else 0 end as meal_event from grid g left join cgm_bin c using (subject_id, ts) "
        "left join act_bin a using (subject_id, ts) left join carb_bin cb using (subject_id, ts) left join bolus_bin b using (subject_id, ts) "
        "left join kernel_bin k using (subject_id, ts) left join rate_bin r using (subject_id, ts)",
    ),
    "carried": (
        "base",
        "select *, last_value(case when glucose_observed is not null then ts end ignore nulls) over w as pt, last_value(glucose_observed ignore nulls) over w as pg, "
        "first_value(case when glucose_observed is not null then ts end ignore nulls) over f as qt, first_value(glucose_observed ignore nulls) over f as qg, "
        "last_value(case when meal_event = 1 then ts end ignore nulls) over w as meal_ts, last_value(case when basal_schedule_change = 1 then ts end ignore nulls) over w as change_ts "
        "from base window w as (partition by subject_id order by ts rows between unbounded preceding and current row), "
        "f as (partition by subject_id order by ts rows between current row and unbounded following)",
    ),
    "filled": (
        "carried",
        f"select *, coalesce(glucose_observed, pg + (qg - pg) * {minutes('ts', 'pt')} / {minutes('qt', 'pt')}) as glucose, "
        "case when glucose_observed is null then 1 else 0 end as missing_cgm, "
        f"{minutes('ts', 'pt')} as since_cgm, coalesce({minutes('ts', 'meal_ts')}, 0.0) as minutes_since_last_meal, "
        f"coalesce({minutes('ts', 'change_ts')}, 0.0) as minutes_since_basal_change from carried",
    ),
    "gridded": (
        "filled",
        "select *, coalesce(lag(glucose, 1) over w, glucose) as glucose_lag_30m, coalesce(lag(glucose, 1) over w, glucose) as glucose_lag_60m, "
        "coalesce(lag(glucose, 2) over w, glucose) as glucose_lag_120m, "
        + ", ".join(
            f"{fn}({col}) over (partition by subject_id order by ts rows between {m // 60 - 1} preceding and current row) as {name}_{m}m"
            for col, name, fn in (
                ("glucose", "glucose_roll_mean", "avg"), ("iob_units", "iob_roll_sum", "sum"),
                ("activity_value", "activity_roll_sum", "sum"), ("carb_grams", "carb_roll_sum", "sum"),
            )
            for m in (60, 120, 240)
        )
        + ", lead(glucose_observed, 1) over w as target_glucose, coalesce(since_cgm, 0.0) as minutes_since_last_cgm, "
        + ", ".join(f"case when since_cgm >= {g} then 1 else 0 end as cgm_gap_ge_{g}m" for g in (120, 240, 480))
        + f", sin({2 * math.pi!r} * hour(ts) / 24.0) as hour_sin, cos({2 * math.pi!r} * hour(ts) / 24.0) as hour_cos, "
        f"sin({2 * math.pi!r} * (isodow(ts) - 1) / 7.0) as dow_sin, cos({2 * math.pi!r} * (isodow(ts) - 1) / 7.0) as dow_cos, "
        "case when isodow(ts) >= 6 then 1 else 0 end as is_weekend from filled window w as (partition by subject_id order by ts)",
    ),
    "feat": (
        "gridded",
        "select *, target_glucose - glucose as target_delta, carb_roll_sum_60m * bolus_units as carb_bolus_interaction_60m, "
        "carb_roll_sum_60m * iob_units as carb_iob_interaction_60m from gridded where glucose is not null and target_glucose is not null",
    ),
}


def with_(names: str, body: str) -> str:
    """``body`` with the named parts, and what they need, as CTEs."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in PARTS[name][0].split():
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    ctes = ", ".join(f"{n} as materialized ({PARTS[n][1]})" for n in wanted)
    return f"with {ctes} {body}" if ctes else body
