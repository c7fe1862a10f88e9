"""Models, validation and score queries.

``lineitem`` gives the larger regression tables: a supplier is the subject,
the ship date the time, the price the target.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import models as M
from pulsegrid.operators import profile as P
from pulsegrid.operators import validate as V
from pulsegrid.operators.splits import hash_split
from pulsegrid.queries.context_queries import prepared
from pulsegrid.queries.research_queries import research
from pulsegrid.queries.sqlparts import PARTS, minutes, r, rounded, rs, with_
from pulsegrid.sources import adapters as A

KEY = "subject_id"
ORDER = ["l_orderkey", "l_linenumber"]
MANY = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "dow"]
COHORT = ("glucose", "iob_units", "basal_units_per_hour", "carb_roll_sum_120m", "glucose_lag_30m", "glucose_roll_mean_120m", "hour_sin", "hour_cos")


def lines(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias(KEY), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        F.weekday("l_shipdate").alias("dow"), F.col("l_returnflag").alias("therapy_segment"), F.col("l_extendedprice").alias("y"),
    )


PARTS["lines"] = (
    "",
    "select l_suppkey as subject_id, l_shipdate as ts, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag as therapy_segment, l_extendedprice as y from lineitem",
)


def line_folds(spark, sf_dir):
    return V.fold_columns(lines(spark, sf_dir), [KEY], order=ORDER, horizon_rows=6, folds=4)


PARTS["folds"] = (
    "lines",
    "select *, case when i < first then 0 else (i - first) // test + 1 end as block, case when i + 6 < first then 1 else (i + 6 - first) // test + 2 end as train_from from "
    "(select *, greatest(n // 5, 1) as test, n - 4 * greatest(n // 5, 1) as first from (select *, row_number() over (partition by subject_id order by ts, l_orderkey, l_linenumber) - 1 as i, "
    "count(*) over (partition by subject_id) as n from lines))",
)
PARTS["train"] = ("folds", "select f.*, k as fold from folds f, (select unnest([1, 2, 3, 4]) as k) where train_from <= k")
PARTS["fit1"] = (
    "train",
    "select subject_id, fold, (covar_pop(y, l_quantity) * count(*) / (count(*) + 1.0)) / var_pop(l_quantity) as slope, avg(y) - (covar_pop(y, l_quantity) * count(*) / (count(*) + 1.0)) / var_pop(l_quantity) * avg(l_quantity) as intercept "
    "from train group by 1, 2",
)
PARTS["band1"] = (
    "train fit1",
    "select subject_id, fold, quantile_cont(y - intercept - slope * l_quantity, 0.1) as lo, quantile_cont(y - intercept - slope * l_quantity, 0.9) as hi from train join fit1 using (subject_id, fold) group by 1, 2",
)
PARTS["scored1"] = (
    "folds fit1 band1",
    "select f.*, t.fold, intercept + slope * l_quantity as pred, intercept + slope * l_quantity + lo as lower, intercept + slope * l_quantity + hi as upper from folds f join fit1 t on f.subject_id = t.subject_id and f.block = t.fold "
    "join band1 b on b.subject_id = f.subject_id and b.fold = f.block",
)
SCORES = ("mae", "rmse", "coverage", "interval_width", "safety_weighted_mae", "low_bg_mae")


def score_sql(actual: str) -> str:
    err, w = f"abs({actual} - pred)", f"case when {actual} < 70 then 3.0 when {actual} < 90 then 2.0 else 1.0 end"
    return (
        f"count(*) as n_test, {rs(f'avg({err})')} as mae, {rs(f'sqrt(avg({err} * {err}))')} as rmse, {rs(f'avg(case when {actual} between lower and upper then 1 else 0 end)')} as coverage, "
        f"{rs('avg(upper - lower)')} as interval_width, {rs(f'sum({w} * {err}) / sum({w})')} as safety_weighted_mae, {rs(f'coalesce(avg(case when {actual} < 80 then {err} end), avg({err}))')} as low_bg_mae"
    )


def q_blocks(spark, sf_dir):
    return V.fold_sizes(line_folds(spark, sf_dir), [KEY]).select(KEY, "fold", "n_train", "n_test")


SQL_BLOCKS = with_(
    "train folds",
    "select subject_id, fold, n_train, n_test from (select subject_id, fold, count(*) as n_train from train group by 1, 2) join (select subject_id, cast(block as integer) as fold, count(*) as n_test from folds where block > 0 group by 1, 2) using (subject_id, fold)",
)


def q_ridge_one(spark, sf_dir):
    sums = M.gram_sums(lines(spark, sf_dir), [KEY], ["l_quantity"], "y")
    fit = M.solve(sums, [KEY], alpha=1.0)
    out = fit.select(KEY, F.col("n").cast("bigint").alias("n"), F.col("coef")[0].alias("coef"), F.col("slope")[0].alias("slope"), "intercept", (F.col("sse") / F.col("n")).alias("mse"))
    return rounded(rounded(out, "coef", "slope", "intercept", digits=3), "mse", digits=0)


SQL_RIDGE_ONE = with_(
    "lines",
    f"select subject_id, n, {rs('b * sx', 3)} as coef, {rs('b', 3)} as slope, {rs('my - b * mx', 3)} as intercept, {rs('vy - 2 * b * c + b * b * vx', 0)} as mse from (select subject_id, count(*) as n, avg(y) as my, avg(l_quantity) as mx, var_pop(y) as vy, "
    "covar_pop(y, l_quantity) as c, var_pop(l_quantity) as vx, stddev_pop(l_quantity) as sx, covar_pop(y, l_quantity) * count(*) / (count(*) + 1.0) / var_pop(l_quantity) as b from lines group by 1)",
)


def q_walk_one(spark, sf_dir):
    scored = V.linear_walk(line_folds(spark, sf_dir), [KEY], ["l_quantity"], "y")
    return rounded(P.forecast_scores(scored, [KEY, "fold"], "y"), *SCORES, digits=4)


SQL_WALK_ONE = with_("scored1", f"select subject_id, fold, {score_sql('y')} from scored1 group by 1, 2")


def _scores(df):
    return rounded(P.forecast_scores(df, [KEY, "fold"], "y"), *SCORES)


def q_walk_many(spark, sf_dir):
    return _scores(V.linear_walk(line_folds(spark, sf_dir), [KEY], MANY, "y"))


def q_elastic(spark, sf_dir):
    return _scores(V.linear_walk(line_folds(spark, sf_dir), [KEY], MANY, "y", method="elastic_net", alpha=0.05, l1=0.5))


def q_segmented(spark, sf_dir):
    return _scores(V.segmented_walk(line_folds(spark, sf_dir), [KEY], MANY, "y"))


def q_stumps(spark, sf_dir):
    return _scores(V.stump_walk(line_folds(spark, sf_dir), [KEY], MANY, "y"))


STUMP_FEATURES = ("l_quantity", "l_tax")


def q_stumps_two(spark, sf_dir):
    """Two rounds on two features: every step of the booster, in reach of SQL."""
    return _scores(V.stump_walk(line_folds(spark, sf_dir), [KEY], STUMP_FEATURES, "y", rounds=2))


def q_stumps_all(spark, sf_dir):
    """All rounds of the product's booster."""
    return _scores(V.stump_walk(line_folds(spark, sf_dir), [KEY], STUMP_FEATURES, "y"))


def _stump_round(k: int) -> str:
    """CTEs of round k: bins with residuals, the best split of each fit, moved predictions."""
    bins = " union all ".join(
        f"select subject_id, fold, {i} as f, len(list_filter(t{i}, lambda t: t < {c})) as b, y - pred as r from p{k - 1} join cuts using (subject_id, fold) where not test" for i, c in enumerate(STUMP_FEATURES)
    )
    value = " ".join(f"when s.f = {i} then len(list_filter(t{i}, lambda t: t < p.{c}))" for i, c in enumerate(STUMP_FEATURES))
    return (
        f"h{k} as (select subject_id, fold, f, b, count(*) as c, sum(r) as s from ({bins}) group by all), "
        f"q{k} as (select *, sum(c) over r as cl, sum(s) over r as sl, sum(c) over w as ca, sum(s) over w as sa from h{k} window w as (partition by subject_id, fold, f), r as (partition by subject_id, fold, f order by b rows unbounded preceding)), "
        f"s{k} as (select * from q{k} where cl < ca qualify row_number() over (partition by subject_id, fold order by round(sl * sl / cl + (sa - sl) * (sa - sl) / (ca - cl) - sa * sa / ca, 6) desc, f, b) = 1), "
        f"p{k} as materialized (select p.* exclude (pred), p.pred + coalesce(0.1 * case when (case {value} end) <= s.b then s.sl / s.cl else (s.sa - s.sl) / (s.ca - s.cl) end, 0.0) as pred "
        f"from p{k - 1} p join cuts using (subject_id, fold) left join s{k} s on s.subject_id = p.subject_id and s.fold = p.fold)"
    )


def _stump_sql(rounds: int) -> str:
    return with_(
        "folds train",
        "select * from (with cuts as (select subject_id, fold, " + ", ".join(f"list_sort(list_distinct([{', '.join(f'quantile_cont({c}, {d / 10})' for d in range(1, 10))}])) as t{i}" for i, c in enumerate(STUMP_FEATURES))
        + " from train group by 1, 2), m as (select subject_id, fold, avg(y) as mean from train group by 1, 2), "
        "p0 as (select t.subject_id, t.fold, i, l_quantity, l_tax, y, false as test, mean as pred from train t join m using (subject_id, fold) "
        "union all select f.subject_id, m.fold, i, l_quantity, l_tax, y, true, mean from folds f join m on m.subject_id = f.subject_id and m.fold = f.block), "
        + ", ".join(_stump_round(k) for k in range(1, rounds + 1))
        + f", band as (select subject_id, fold, quantile_cont(y - pred, 0.1) as lo, quantile_cont(y - pred, 0.9) as hi from p{rounds} where not test group by 1, 2), "
        f"done as (select p{rounds}.*, pred + lo as lower, pred + hi as upper from p{rounds} join band using (subject_id, fold) where test) select subject_id, fold, {score_sql('y')} from done group by 1, 2)",
    )


def q_elastic_one(spark, sf_dir):
    return _scores(V.linear_walk(line_folds(spark, sf_dir), [KEY], ["l_quantity"], "y", method="elastic_net", alpha=0.05, l1=0.5))


def _walk_sql(fit: str, by: str = "subject_id, fold") -> str:
    """Scores of a one-feature fit (slope, intercept per ``by``) with its training band."""
    return (
        f"select * from (with fit as ({fit}), band as (select {by}, quantile_cont(y - intercept - slope * l_quantity, 0.1) as lo, quantile_cont(y - intercept - slope * l_quantity, 0.9) as hi from train join fit using ({by}) group by all), "
        f"done as (select t.*, intercept + slope * l_quantity as pred, intercept + slope * l_quantity + lo as lower, intercept + slope * l_quantity + hi as upper from (select *, block as fold from folds where block > 0) t join fit using ({by}) join band using ({by})) "
        f"select subject_id, cast(fold as integer) as fold, {score_sql('y')} from done group by 1, 2)"
    )


# soft threshold 0.025 on the covariance with the scaled feature, then shrunk by 1.025
SQL_ELASTIC_ONE = with_(
    "folds train",
    _walk_sql(
        "select subject_id, fold, b as slope, my - b * mx as intercept from (select subject_id, fold, avg(y) as my, avg(l_quantity) as mx, "
        "sign(covar_pop(y, l_quantity)) * greatest(abs(covar_pop(y, l_quantity) / stddev_pop(l_quantity)) - 0.025, 0.0) / 1.025 / stddev_pop(l_quantity) as b from train group by 1, 2)"
    ),
)


def q_segmented_one(spark, sf_dir):
    return _scores(V.segmented_walk(line_folds(spark, sf_dir), [KEY], ["l_quantity"], "y"))


_RIDGE = "(covar_pop(y, l_quantity) * count(*) / (count(*) + 1.0)) / var_pop(l_quantity)"
def _segmented_sql(kept: str) -> str:
    """Scores of the segments' fits; ``kept`` makes a column of the segmented value {0} and the plain ridge's {1}."""
    done = ", ".join(f"{kept.format(f'coalesce({part}, {whole})', whole)} as {whole}" for whole, part in (("pred", "intercept + slope * l_quantity"), ("lower", "intercept + slope * l_quantity + lo"), ("upper", "intercept + slope * l_quantity + hi")))
    return with_(
        "folds train scored1",
        "select * from (with fit as (select * from (select subject_id, therapy_segment, fold, count(*) as n, " + f"{_RIDGE} as slope, avg(y) - {_RIDGE} * avg(l_quantity) as intercept from train group by 1, 2, 3) where n >= 20), "
        "band as (select subject_id, therapy_segment, fold, quantile_cont(y - intercept - slope * l_quantity, 0.1) as lo, quantile_cont(y - intercept - slope * l_quantity, 0.9) as hi from train join fit using (subject_id, therapy_segment, fold) group by all), "
        f"done as (select s.subject_id, s.fold, s.y, {done} "
        "from scored1 s left join fit f on f.subject_id = s.subject_id and f.therapy_segment = s.therapy_segment and f.fold = s.fold left join band b on b.subject_id = s.subject_id and b.therapy_segment = s.therapy_segment and b.fold = s.fold) "
        f"select subject_id, fold, {score_sql('y')} from done group by 1, 2)",
    )


SQL_SEGMENTED_ONE = _segmented_sql("{0}")


def q_ensemble_two(spark, sf_dir):
    """Mean of a ridge and a segmented ridge, in reach of SQL."""
    args = line_folds(spark, sf_dir), [KEY], ["l_quantity"], "y"
    return _scores(V.ensemble([V.linear_walk(*args), V.segmented_walk(*args)], [KEY]))


def q_ridge_two(spark, sf_dir):
    fit = M.solve(M.gram_sums(lines(spark, sf_dir), [KEY], ["l_quantity", "l_tax"], "y"), [KEY], alpha=1.0)
    return rounded(fit.select(KEY, F.col("coef")[0].alias("coef_quantity"), F.col("coef")[1].alias("coef_tax"), "intercept"), "coef_quantity", "coef_tax", "intercept", digits=3)


SQL_RIDGE_TWO = with_(
    "lines",
    f"select subject_id, {rs('u', 3)} as coef_quantity, {rs('v', 3)} as coef_tax, {rs('my - u / s1 * m1 - v / s2 * m2', 3)} as intercept from (select *, ((n + 1) * n * c1 - n * r * n * c2) / ((n + 1) * (n + 1) - n * r * n * r) as u, ((n + 1) * n * c2 - n * r * n * c1) / ((n + 1) * (n + 1) - n * r * n * r) as v "
    "from (select subject_id, count(*) as n, avg(y) as my, avg(l_quantity) as m1, avg(l_tax) as m2, stddev_pop(l_quantity) as s1, stddev_pop(l_tax) as s2, corr(l_quantity, l_tax) as r, covar_pop(y, l_quantity) / stddev_pop(l_quantity) as c1, "
    "covar_pop(y, l_tax) / stddev_pop(l_tax) as c2 from lines group by 1))",
)


def q_bayes_one(spark, sf_dir):
    return _scores(V.bayes_ar_walk(line_folds(spark, sf_dir), [KEY], ["l_quantity"], "y"))


def q_bayes_two(spark, sf_dir):
    return _scores(V.bayes_ar_walk(line_folds(spark, sf_dir), [KEY], ["l_quantity", "l_tax"], "y"))


def _bayes_sql(fit: str, line: str, spread: str) -> str:
    """Scores with a carried residual; ``spread`` is the variance by the coefficients, in units of the residual's."""
    z = 1.2815515655446004
    t = f"({z} + {z**3 + z} / (4 * (n - 1)) + {5 * z**5 + 16 * z**3 + 3 * z} / (96 * (n - 1) * (n - 1)))"
    return with_(
        "folds train",
        f"select * from (with fit as ({fit}), res as (select subject_id, fold, i, y - ({line}) as r from train join fit using (subject_id, fold)), "
        "pair as (select *, lag(r) over (partition by subject_id, fold order by i) as b from res), "
        "fact as (select subject_id, fold, coalesce(corr(r, b), 0.0) as rho, stddev_pop(r) as sd, arg_max(r, i) as last, max(i) as i_last from pair group by 1, 2), "
        f"done as (select subject_id, fold, y, {line} + pow(rho, i - i_last) * last as pred, {t} * sd * sqrt(greatest(1 - pow(rho, i - i_last) * pow(rho, i - i_last), 0.0) + {spread}) as half "
        "from (select * exclude (n), block as fold from folds where block > 0) join fit using (subject_id, fold) join fact using (subject_id, fold)), full_ as (select *, pred - half as lower, pred + half as upper from done) "
        f"select subject_id, cast(fold as integer) as fold, {score_sql('y')} from full_ group by 1, 2)",
    )


SQL_BAYES_ONE = _bayes_sql(
    f"select subject_id, fold, count(*) as n, avg(l_quantity) as m1, var_pop(l_quantity) as v1, {_RIDGE} as slope, avg(y) - {_RIDGE} * avg(l_quantity) as intercept from train group by 1, 2",
    "intercept + slope * l_quantity", "1.0 / n + pow(l_quantity - m1, 2) / v1 / (n + 1)",
)


def _two_feature_fit(source: str, x2: str) -> str:
    """Ridge fits of y on l_quantity (b1) and on both (a1, a2), with the moments, per subject and fold."""
    return (
        f"select *, c1 * n / (n + 1) / s1 as b1, u / s1 as a1, v / s2 as a2, my - c1 * n / (n + 1) / s1 * m1 as b0, my - u / s1 * m1 - v / s2 * m2 as a0 from (select *, ((n + 1) * n * c1 - n * r * n * c2) / d as u, ((n + 1) * n * c2 - n * r * n * c1) / d as v "
        f"from (select *, (n + 1) * (n + 1) - n * r * n * r as d from (select subject_id, fold, cast(count(*) as double) as n, avg(y) as my, avg(l_quantity) as m1, avg({x2}) as m2, stddev_pop(l_quantity) as s1, stddev_pop({x2}) as s2, corr(l_quantity, {x2}) as r, "
        f"covar_pop(y, l_quantity) / stddev_pop(l_quantity) as c1, covar_pop(y, {x2}) / stddev_pop({x2}) as c2 from {source} group by 1, 2)))"
    )


SQL_BAYES_TWO = _bayes_sql(
    _two_feature_fit("train", "l_tax"), "a0 + a1 * l_quantity + a2 * l_tax",
    "1.0 / n + ((n + 1) * (pow((l_quantity - m1) / s1, 2) + pow((l_tax - m2) / s2, 2)) - 2 * n * r * (l_quantity - m1) / s1 * (l_tax - m2) / s2) / d",
)


def q_bayes(spark, sf_dir):
    return _scores(V.bayes_ar_walk(line_folds(spark, sf_dir), [KEY], MANY, "y"))


def q_ensemble(spark, sf_dir):
    """The product's ensemble: ridge, segmented ridge and boosted stumps."""
    return _scores(V.family_walk("ensemble", line_folds(spark, sf_dir), [KEY], MANY, "y", 1))


def q_report(spark, sf_dir):
    scored = V.linear_walk(line_folds(spark, sf_dir), [KEY], ["l_quantity"], "y").withColumn("naive", F.col("l_quantity") * 1500.0)
    out = V.walk_forward_report(scored, [KEY], "y", "naive")
    return rounded(out, *SCORES, "persistence_mae")


SQL_REPORT = with_(
    "scored1",
    f"select subject_id, cast(f as integer) as fold, {score_sql('y')}, {rs('avg(abs(y - l_quantity * 1500.0))')} as persistence_mae from (select *, unnest([fold, 0]) as f from scored1) group by 1, 2",
)


def q_standardize(spark, sf_dir):
    out = M.standardize(lines(spark, sf_dir), [KEY], ["l_quantity", "l_discount"], "l_orderkey")
    return rounded(out.select(KEY, "l_orderkey", "l_linenumber", "l_quantity", "l_discount"), "l_quantity", "l_discount")


SQL_STANDARDIZE = with_(
    "lines",
    "select subject_id, l_orderkey, l_linenumber, "
    + ", ".join(f"{rs(f'({c} - avg({c}) over w) / stddev_pop({c}) over w')} as {c}" for c in ("l_quantity", "l_discount")) + " from lines window w as (partition by subject_id)",
)


def q_persistence(spark, sf_dir):
    return rounded(P.persistence_scores(prepared(spark, sf_dir).frame), "persistence_mae")


def q_self_difference(spark, sf_dir):
    return rounded(P.self_difference(A.cgm(spark, sf_dir), 3, "glucose"), "persistence_mae")


def _calibrated(spark, sf_dir):
    """A simple forecast with a band: the 2-hour mean."""
    g = F.col("glucose_roll_mean_120m")
    return prepared(spark, sf_dir).frame.withColumns({"actual": F.col("target_glucose"), "pred": g, "lower": g - 20, "upper": g + 20})


def q_calibration(spark, sf_dir):
    return rounded(P.forecast_scores(_calibrated(spark, sf_dir), [KEY]), *SCORES)


SQL_CALIBRATION = with_(
    "feat",
    "select subject_id, " + score_sql("actual") + " from (select subject_id, target_glucose as actual, glucose_roll_mean_120m as pred, glucose_roll_mean_120m - 20 as lower, glucose_roll_mean_120m + 20 as upper from feat) group by 1",
)


def q_fit_quality(spark, sf_dir):
    out = P.fit_quality(_calibrated(spark, sf_dir).withColumn("part", F.weekday("ts")), ["part"])
    return rounded(out, "mse", "r2")


SQL_QUALITY = with_(
    "feat",
    f"select cast(isodow(ts) - 1 as integer) as part, {rs('avg((target_glucose - glucose_roll_mean_120m) ** 2)')} as mse, {rs('1 - sum((target_glucose - glucose_roll_mean_120m) ** 2) / (var_pop(target_glucose) * count(*))')} as r2 from feat group by 1",
)


def q_safe_median(spark, sf_dir):
    meas = A.measurements(spark, sf_dir)
    return rounded(P.safe_median(meas, [KEY], F.when(F.col("metric") == "heart_rate", F.col("value")), 10.0, "median_value"), "median_value")


def q_safe_correlation(spark, sf_dir):
    return rounded(P.safe_correlation(lines(spark, sf_dir), [KEY, "therapy_segment"], "l_quantity", "y"), "correlation")


def q_sampler(spark, sf_dir):
    stats = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("fit_id"), (F.col("l_orderkey") % 2).alias("chain"), ((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07)).alias("diverging"),
        F.col("l_linenumber").alias("tree_depth"),
    )
    return P.sampler_rollup(stats, max_depth=7)


def q_hash_split(spark, sf_dir):
    return hash_split(A.table(spark, sf_dir, "events"), "event_id", 0.2).groupBy("split").agg(F.count("*").alias("rows"), F.sum("event_id").alias("id_sum"))


def q_top_parts(spark, sf_dir):
    """Top-k per group: the three largest samples of each subject."""
    return P.top_per_group(A.cgm(spark, sf_dir).select(KEY, "event_id", "glucose"), [KEY], [F.desc("glucose"), F.asc("event_id")], 3)


def therapy_lines(spark, sf_dir):
    """Order lines as a research frame whose subjects (suppliers) have enough rows for every task."""
    basal = F.col("l_tax") * 10 + F.col("l_linenumber") * 0.1
    delta = F.col("l_orderkey") % 61 + 30 - basal * 100
    out = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias(KEY), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", (F.col("l_quantity") + 90).alias("glucose"),
        basal.alias("basal_units_per_hour"), (F.col("l_discount") * 10).alias("bolus_units"), F.col("l_returnflag").alias("therapy_segment"),
        (F.col("l_linenumber") <= 5).cast("int").alias("basal_context"), F.col("l_linenumber").isin(2, 4).cast("int").alias("meal_context"),
        (F.col("l_linenumber") == 1).cast("int").alias("correction_context"), delta.alias("target_delta"),
    )
    return out.withColumn("target_glucose", F.col("glucose") + F.col("target_delta"))


PARTS["tl"] = (
    "",
    "select *, glucose + target_delta as target_glucose from (select l_suppkey as subject_id, l_shipdate as ts, l_orderkey, l_linenumber, l_quantity + 90 as glucose, l_tax * 10 + l_linenumber * 0.1 as x, "
    "l_returnflag as segment, l_linenumber <= 5 as basal, l_linenumber in (2, 4) as icr, l_orderkey % 61 + 30 - (l_tax * 10 + l_linenumber * 0.1) * 100 as target_delta from lineitem)",
)
LINE_FEATURES = ("basal_units_per_hour", "glucose", "bolus_units")


def q_model_comparison(spark, sf_dir):
    """All families and tasks on subjects with enough rows."""
    out = V.model_comparison(therapy_lines(spark, sf_dir), LINE_FEATURES, [KEY], order=ORDER)
    return out.select(KEY, "task", "parameter", "model_name", "status", "n_rows", "n_features", "fold_count", "mae", "safety_weighted_mae", "selected")


def q_model_comparison_sparse(spark, sf_dir):
    """Subjects without enough rows for any task: the same columns, no scores."""
    out = V.model_comparison(research(spark, sf_dir), COHORT, [KEY], horizon_seconds=3600)
    return out.select(KEY, "task", "parameter", "model_name", "status", "n_rows", "n_features", "fold_count", "mae", "selected")


SQL_COMPARISON_SPARSE = with_(
    "research",
    "select subject_id, task, parameter, model_name, case when staged then 'staged' else 'insufficient_data' end as status, cast(case task when 'basal' then b when 'icr' then m else c end as bigint) as n_rows, "
    f"{len(COHORT)} as n_features, cast(null as bigint) as fold_count, cast(null as double) as mae, false as selected from "
    "(select subject_id, count(*) filter (basal_context = 1) as b, count(*) filter (recent_meal_120m = 1) as m, count(*) filter (correction_context = 1) as c from research group by 1), "
    "(values ('basal', 'basal', false), ('icr', 'I/C ratio', false), ('sensitivity_factor', 'sensitivity factor', true)) t(task, parameter, staged), "
    f"(select unnest([{', '.join(repr(f) for f in V.FAMILIES)}]) as model_name)",
)

def q_rank_models(spark, sf_dir):
    """Ranking, rejection and selection on fold scores from order lines: the part stands for the family, the line number for the fold."""
    rows = A.table(spark, sf_dir, "lineitem")
    name = F.array(*[F.lit(f) for f in V.FAMILIES])[(F.col("l_partkey") % len(V.FAMILIES)).cast("int")]
    scores = rows.groupBy((F.col("l_suppkey") % 10 + F.col("l_orderkey") % 30 * 10).alias(KEY), F.col("l_linenumber").alias("fold"), F.when(F.col("l_tax") < 0.04, "basal").otherwise("icr").alias("task"), name.alias("model_name")).agg(
        F.avg("l_quantity").alias("mae"), F.max("l_quantity").alias("rmse"), F.avg("l_discount").alias("coverage"), F.avg("l_tax").alias("interval_width"),
        F.min("l_quantity").alias("low_bg_mae"), F.round(F.avg("l_quantity"), 0).alias("safety_weighted_mae"),
    ).filter(F.col("low_bg_mae") > 20)
    keys = scores.select(KEY).distinct()
    label = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(s).alias("staged")) for t, _, _, s in V.TASKS])
    grid = keys.withColumn("t", F.explode(label)).select(KEY, "t.*").withColumn("model_name", F.explode(F.array(*[F.lit(f) for f in V.FAMILIES])))
    out = V.rank_models(grid, scores, [KEY]).select(KEY, "task", "model_name", "status", "fold_count", "mae", "safety_weighted_mae", "fold_mae_std", "fold_safety_std", "selected")
    return rounded(out, "mae", "safety_weighted_mae", "fold_mae_std", "fold_safety_std")


SQL_RANK_MODELS = f"""
with s as (
  select l_suppkey % 10 + l_orderkey % 30 * 10 as subject_id, l_linenumber as fold, case when l_tax < 0.04 then 'basal' else 'icr' end as task,
    case l_partkey % 6 {' '.join(f"when {k} then '{v}'" for k, v in enumerate(V.FAMILIES))} end as model_name,
    avg(l_quantity) as mae, min(l_quantity) as low, round(avg(l_quantity), 0) as safe
  from lineitem group by all having min(l_quantity) > 20
),
m as (select subject_id, task, model_name, count(*) as folds, avg(mae) as mae, avg(low) as low, avg(safe) as safe, stddev_pop(mae) as mae_std, stddev_pop(safe) as safe_std from s group by all),
g as (
  select * from (select distinct subject_id from s), (values ('basal', false), ('icr', false), ('sensitivity_factor', true)) t(task, staged), (select unnest([{', '.join(repr(f) for f in V.FAMILIES)}]) as model_name)
),
o as (select g.*, folds, mae, low, safe, mae_std, safe_std, row_number() over (partition by g.subject_id, g.task order by model_name = 'ensemble', folds is null, safe, low, safe_std, mae, model_name) as place from g left join m using (subject_id, task, model_name)),
best as (select subject_id, task, safe as best_safe, safe_std as best_std from o where place = 1 and folds is not null and model_name <> 'ensemble'),
st as (
  select o.*, case when staged then 'staged' when folds is null and max(folds) over (partition by subject_id, task) is not null then 'failed' when folds is null then 'insufficient_data'
    when model_name = 'ensemble' and best_safe is not null and not coalesce(safe < best_safe * 0.995 and safe_std <= best_std, false) then 'rejected' else 'completed' end as status
  from o left join best using (subject_id, task)
)
select subject_id, task, model_name, status, folds as fold_count, {rs('mae')} as mae, {rs('safe')} as safety_weighted_mae, {rs('mae_std')} as fold_mae_std, {rs('safe_std')} as fold_safety_std,
  status = 'completed' and row_number() over (partition by subject_id, task order by status <> 'completed', safe, low, safe_std, mae, model_name) = 1 as selected
from st
"""


def q_screening(spark, sf_dir):
    extra = ["health_activity_value", "prior_night_total_sleep_hours", "hrv_latest", "workout_count_24h"]
    scores, _ = V.screen_features(prepared(spark, sf_dir).frame, [KEY], COHORT, extra, horizon_seconds=3600)
    return scores


def q_screening_one(spark, sf_dir):
    """Does a second feature, missing in some rows, help a ridge on one?  Feature score and errors of both models."""
    rows = lines(spark, sf_dir).withColumn("x", F.when(F.col("l_linenumber") <= 5, F.col("l_tax")))
    scores, error = V.screen_features(rows, [KEY], ["l_quantity"], ["x"], target="y", order=ORDER)
    out = scores.join(error.drop("split_count"), KEY)
    return rounded(out, "availability", "mean_abs_coefficient", "std_abs_coefficient", "baseline_rmse", "augmented_rmse", "baseline_mae", "augmented_mae")


PARTS["screen_folds"] = (
    "lines",
    "select *, case when i < first then 0 when (i - first) // test < (n - first) // test then (i - first) // test + 1 else 0 end as block from "
    "(select *, greatest(n // 2, 24) as first, greatest(n // 5, 12) as test from (select *, case when l_linenumber <= 5 then l_tax end as x0, coalesce(case when l_linenumber <= 5 then l_tax end, 0.0) as x, "
    "row_number() over (partition by subject_id order by ts, l_orderkey, l_linenumber) - 1 as i, count(*) over (partition by subject_id) as n from lines))",
)
SQL_SCREENING = with_(
    "screen_folds",
    "select * from (with begun as (select subject_id, block as fold, min(ts) as t from screen_folds where block > 0 group by 1, 2), "
    "train as (select f.*, b.fold from screen_folds f join begun b on b.subject_id = f.subject_id and b.t >= f.ts + interval 1800 second), "
    f"fit as ({_two_feature_fit('train', 'x')}), "
    "miss as (select f.subject_id, fold, y - b0 - b1 * l_quantity as e, y - a0 - a1 * l_quantity - a2 * x as g from screen_folds f join fit t on t.subject_id = f.subject_id and t.fold = f.block), "
    "each as (select subject_id, fold, sqrt(avg(e * e)) as e2, avg(abs(e)) as e1, sqrt(avg(g * g)) as g2, avg(abs(g)) as g1 from miss group by 1, 2), "
    f"error as (select subject_id, {rs('avg(e2)')} as baseline_rmse, {rs('avg(g2)')} as augmented_rmse, {rs('avg(e1)')} as baseline_mae, {rs('avg(g1)')} as augmented_mae from each group by 1), "
    f"coefs as (select subject_id, {rs('avg(abs(v))')} as mean_abs_coefficient, {rs('stddev_pop(abs(v))')} as std_abs_coefficient, count(*) as split_count from fit group by 1), "
    "have as (select subject_id, count(x0) / count(*) as share from screen_folds group by 1) "
    f"select subject_id, 'x' as feature, {rs('share')} as availability, mean_abs_coefficient, std_abs_coefficient, split_count, share >= 0.2 as recommended, baseline_rmse, augmented_rmse, baseline_mae, augmented_mae "
    "from have join coefs using (subject_id) join error using (subject_id))",
)

QUERIES = {
    "walk_forward_blocks": (q_blocks, SQL_BLOCKS),
    "ridge_one_feature": (q_ridge_one, SQL_RIDGE_ONE),
    "ridge_walk_forward_one": (q_walk_one, SQL_WALK_ONE),
    "walk_forward_report": (q_report, SQL_REPORT),
    "ridge_walk_forward": (q_walk_many, None),
    "elastic_net": (q_elastic, None),
    "segmented_ridge": (q_segmented, None),
    "boosted_stumps": (q_stumps, None),
    "boosted_stumps_two_rounds": (q_stumps_two, _stump_sql(2)),
    "boosted_stumps_all_rounds": (q_stumps_all, _stump_sql(18)),
    "elastic_net_one_feature": (q_elastic_one, SQL_ELASTIC_ONE),
    "segmented_ridge_one_feature": (q_segmented_one, SQL_SEGMENTED_ONE),
    "ridge_two_features": (q_ridge_two, SQL_RIDGE_TWO),
    "bayes_ar_one_feature": (q_bayes_one, SQL_BAYES_ONE),
    "bayes_ar_two_features": (q_bayes_two, SQL_BAYES_TWO),
    "bayes_ar": (q_bayes, None),
    "ensemble_two_members": (q_ensemble_two, _segmented_sql("({0} + {1}) / 2")),
    "ensemble": (q_ensemble, None),
    "standardize": (q_standardize, SQL_STANDARDIZE),
    "persistence_mae": (q_persistence, with_("feat", f"select subject_id, {rs('avg(abs(target_glucose - glucose))')} as persistence_mae from feat group by 1")),
    "self_difference": (
        q_self_difference,
        with_("cgm", f"select subject_id, {rs('avg(abs(d))')} as persistence_mae from (select subject_id, glucose - lag(glucose, 3) over (partition by subject_id order by ts) as d from cgm) group by 1"),
    ),
    "calibration": (q_calibration, SQL_CALIBRATION),
    "fit_quality": (q_fit_quality, SQL_QUALITY),
    "safe_median": (q_safe_median, with_("meas", f"select subject_id, {rs('''coalesce(median(value) filter (metric = 'heart_rate'), 10.0)''')} as median_value from meas group by 1")),
    "safe_correlation": (q_safe_correlation, with_("lines", f"select subject_id, therapy_segment, {rs('case when min(l_quantity) < max(l_quantity) and min(y) < max(y) then corr(l_quantity, y) end')} as correlation from lines group by 1, 2")),
    "sampler_rollup": (
        q_sampler,
        "select l_suppkey as fit_id, cast(count(*) filter (l_returnflag = 'R' and l_tax > 0.07) as bigint) as divergences, max(l_linenumber) as max_tree_depth, count(*) filter (l_linenumber >= 7) as max_tree_depth_hits, count(distinct l_orderkey % 2) as chains from lineitem group by 1",
    ),
    "hash_split": (
        q_hash_split,
        "select case when cast('0x' || substr(md5(cast(event_id as varchar)), 1, 8) as bigint) / 4294967296.0 < 0.2 then 'test' else 'train' end as split, count(*) as rows, cast(sum(event_id) as bigint) as id_sum from events group by 1",
    ),
    "top_per_group": (q_top_parts, with_("cgm", "select subject_id, event_id, glucose from cgm qualify row_number() over (partition by subject_id order by glucose desc, event_id) <= 3")),
    "model_comparison": (q_model_comparison, None),
    "model_comparison_sparse": (q_model_comparison_sparse, SQL_COMPARISON_SPARSE),
    "rank_models": (q_rank_models, SQL_RANK_MODELS),
    "feature_screening": (q_screening, None),
    "feature_screening_one": (q_screening_one, SQL_SCREENING),
}
