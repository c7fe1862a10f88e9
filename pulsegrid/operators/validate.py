"""Walk-forward validation, model comparison, feature screening.

A fold trains on all rows before its test block, less those whose target lies
in the block or after it.  Row i first trains in fold ``f(i)``, so sums per
(key, f) added up over f give every training set without copying rows.

Tables with a row per key and fold are merged, never broadcast: stored or
shuffled they look small, in the driver they are not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.times import shift
from pulsegrid.operators import models as M
from pulsegrid.operators.profile import correlation, forecast_scores
from pulsegrid.operators.timeline import HOUR, row_windows, scan
from pulsegrid.session import cut_lineage


def equal_folds(n: Column, folds: int) -> tuple[Column, Column]:
    """First training size and test size for a set number of folds."""
    test = F.greatest(F.floor(n / (folds + 1)), F.lit(1))
    return n - folds * test, test


def half_folds(n: Column, folds: int = 0) -> tuple[Column, Column]:
    """Start at half of the rows, then blocks of a fifth."""
    first, test = F.greatest(F.floor(n * 0.5), F.lit(24)), F.greatest(F.floor(n * 0.2), F.lit(12))
    fits = first + test <= n
    late = F.greatest(F.floor(n * 0.6), F.lit(12))
    return F.when(fits, first).otherwise(late), F.when(fits, test).otherwise(F.greatest(n - late, F.lit(8)))


def fold_columns(df: DataFrame, keys: Sequence[str], *, order: Sequence[str] = (), horizon_rows: int = 0, horizon_seconds: int | None = None, folds: int = 4, rule=equal_folds, ts: str = "ts") -> DataFrame:
    """Adds ``_i``, ``_n``, ``test_fold`` (0: none), ``train_from`` and ``n_folds``.

    Purged by time (``horizon_seconds``): a row first trains in the fold whose
    block begins at or after the row's target time.  Or by rows
    (``horizon_rows``), for data without a regular step.
    """
    out = scan(df, keys=keys, ts=ts, order=order, chunk_seconds=HOUR, row_index="_i", row_count="_n")
    first, test = rule(F.col("_n"), folds)
    out = out.withColumns({"_first": first.cast("bigint"), "_test": test.cast("bigint")})
    count = F.when(
        (F.col("_first") > 0) & (F.col("_first") + F.col("_test") <= F.col("_n")),
        F.floor((F.col("_n") - F.col("_first")) / F.col("_test")),
    ).otherwise(0)
    late = F.col("_i") - F.col("_first")
    purged = late + horizon_rows
    block = F.when(late < 0, 0).otherwise(F.floor(late / F.col("_test")) + 1)
    out = out.withColumns(
        {
            "n_folds": count.cast("int"),
            "test_fold": F.when(block <= count, block).otherwise(0).cast("int"),
            "train_from": F.when(purged < 0, 1).otherwise(F.floor(purged / F.col("_test")) + 2).cast("int"),
        }
    ).drop("_first", "_test")
    if horizon_seconds is not None:
        # a few blocks per key
        starts = out.filter("test_fold > 0").groupBy(*keys, "test_fold").agg(F.min(ts).alias("_t")).groupBy(*keys).agg(F.collect_list("_t").alias("_starts"))
        out = M.lookup(cut_lineage(out), starts, keys, "_i", "left")
        target = shift(ts, horizon_seconds)
        passed = F.size(F.filter(F.coalesce("_starts", F.array().cast("array<timestamp_ntz>")), lambda s: s < target))
        out = out.withColumn("train_from", F.greatest(F.lit(1), passed + 1).cast("int")).drop("_starts")
    # sums, training residuals and scoring each read the folds
    return cut_lineage(out)


def fold_sizes(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Training and test rows of each fold, from counts per block."""
    each = folds.groupBy(*keys, "train_from", "n_folds").agg(F.count(F.lit(1)).alias("c"))
    train = each.filter(F.col("train_from") <= F.col("n_folds")).withColumn(
        "fold", F.explode(F.sequence("train_from", "n_folds"))
    ).groupBy(*keys, "fold").agg(F.sum("c").alias("n_train"))
    test = folds.filter(F.col("test_fold") > 0).groupBy(*keys, F.col("test_fold").alias("fold")).agg(F.count(F.lit(1)).alias("n_test"))
    return test.join(train.hint("merge"), [*keys, "fold"], "left").fillna(0, subset=["n_train"])


def fold_sums(folds: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Sums of products of every fold's training rows."""
    block = M.product_sums(folds.filter(F.col("train_from") <= F.col("n_folds")), [*keys, "train_from", "n_folds"], features, target)
    each = block.withColumn("fold", F.explode(F.sequence("train_from", "n_folds")))
    by, size = [*keys, "fold"], len(features) + 2
    return M.as_matrix(M.added(each, by, size), by, size)


def training_rows(folds: DataFrame) -> DataFrame:
    """Each row once per fold it trains in."""
    return folds.filter(F.col("train_from") <= F.col("n_folds")).withColumn("fold", F.explode(F.sequence("train_from", "n_folds")))


def test_rows(folds: DataFrame) -> DataFrame:
    return folds.filter(F.col("test_fold") > 0).withColumn("fold", F.col("test_fold"))


def linear_walk(folds: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, method: str = "ridge", min_train: int = 1, **params: float) -> DataFrame:
    """Test rows with ``pred``, ``lower``, ``upper`` of a keyed linear model per fold."""
    by = [*keys, "fold"]
    fits = cut_lineage(M.solve(fold_sums(folds, keys, features, target), by, method, **params).filter(F.col("n") >= min_train))
    model = fits.select(*by, "slope", "intercept")
    pred = M.linear_prediction(features)
    # a row meets the models of its key once and is copied for its folds after that
    fitted = model.groupBy(*keys).agg(F.collect_list(F.struct("fold", "slope", "intercept")).alias("_fits"))
    rows = folds.filter((F.col("train_from") <= F.col("n_folds")) & F.col(target).isNotNull()).select(*dict.fromkeys([*keys, "_i", "train_from", "n_folds", target, *features]))
    own = F.filter("_fits", lambda f: f["fold"].between(F.col("train_from"), F.col("n_folds")))
    train = M.lookup(rows, fitted, keys, "_i").select("*", F.inline(own)).drop("_fits")
    band = M.interval(train.withColumn("_r", F.col(target) - pred), by, F.col("_r"))
    scored = M.lookup(test_rows(folds), model.join(band.hint("merge"), by), by, "_i").withColumn("pred", pred)
    return scored.withColumns({"lower": F.col("pred") + F.col("q_lo"), "upper": F.col("pred") + F.col("q_hi")}).drop("slope", "intercept", "q_lo", "q_hi")


def segmented_walk(folds: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, segment: str = "therapy_segment", min_train: int = 1, alpha: float = 1.0, whole: DataFrame | None = None) -> DataFrame:
    """Ridge per (key, segment); segments with few rows use the key's own fit (``whole``, where it is known already)."""
    enough = max(len(features) + 5, 20)
    whole = linear_walk(folds, keys, features, target, min_train=min_train, alpha=alpha) if whole is None else whole
    parts = linear_walk(folds, [*keys, segment], features, target, min_train=enough, alpha=alpha)
    part = parts.select(*keys, "_i", *[F.col(c).alias(f"_s_{c}") for c in ("pred", "lower", "upper")])
    out = whole.join(part.hint("merge"), [*keys, "_i"], "left")
    return out.withColumns({c: F.coalesce(f"_s_{c}", c) for c in ("pred", "lower", "upper")}).drop("_s_pred", "_s_lower", "_s_upper")


def bayes_ar_fits(folds: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, min_train: int = 1, alpha: float = 1.0) -> DataFrame:
    """Per key and fold the regression with its posterior, and the residual's lag-1 correlation, deviation, last value and its row."""
    by = [*keys, "fold"]
    fits = cut_lineage(M.solve(fold_sums(folds, keys, features, target), by, "ridge", posterior=True, alpha=alpha).filter(F.col("n") >= min_train))
    model, pred = fits.select(*by, "slope", "intercept", "n", "mean", "whiten"), M.linear_prediction(features)
    train = M.lookup(training_rows(folds), model.select(*by, "slope", "intercept"), by, "_i").select(*by, "_i", (F.col(target) - pred).alias("_r"))
    pairs = row_windows(train, lambda w: {"_b": F.lag("_r").over(w)}, back_rows=1, index="_i", keys=by)
    facts = pairs.groupBy(*by).agg(
        F.coalesce(correlation(F.col("_r"), F.col("_b")), F.lit(0.0)).alias("_rho"), F.stddev_pop("_r").alias("_sd"), F.max_by("_r", "_i").alias("_last"), F.max("_i").alias("_at")
    )
    return model.join(facts.hint("merge"), by)


def bayes_ar_walk(folds: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, min_train: int = 1, alpha: float = 1.0, z: float = 1.2815515655446004) -> DataFrame:
    """Conjugate normal regression with a lag-1 residual.

    The coefficient posterior mean under a normal prior is the ridge solution;
    the residual's lag-1 correlation rho carries the last training residual
    forward as rho^k.  The 10-90 % band is Student's t with n - 1 degrees of
    freedom, over the variance of that residual plus that of the coefficients
    at the row.  A stand-in for a sampled state-space model, not the same
    estimator.
    """
    by = [*keys, "fold"]
    pred = M.linear_prediction(features)
    scored = M.lookup(test_rows(folds), bayes_ar_fits(folds, keys, features, target, min_train, alpha), by, "_i")
    carry = F.pow(F.col("_rho"), F.col("_i") - F.col("_at"))
    out = scored.withColumn("pred", pred + carry * F.col("_last"))
    spread = F.greatest(1 - carry * carry, F.lit(0.0)) + M.coefficient_variance(features)
    half = M.student_quantile(z, F.greatest(F.col("n") - 1, F.lit(1.0))) * F.col("_sd") * F.sqrt(spread)
    return out.withColumns({"lower": F.col("pred") - half, "upper": F.col("pred") + half}).drop("slope", "intercept", "n", "mean", "whiten", "_rho", "_sd", "_last", "_at")


def stump_models(folds: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, min_train: int = 1, rounds: int = 18) -> DataFrame:
    """Stored boosted stumps of every fold with enough training rows."""
    by = [*keys, "fold"]
    return cut_lineage(_large_enough(M.fit_stumps(training_rows(folds), by, features, target, rounds), folds, keys, min_train))


def _large_enough(models: DataFrame, folds: DataFrame, keys: Sequence[str], min_train: int) -> DataFrame:
    """``models`` of folds with test rows and enough training rows: the models are looked up, not the rows."""
    sizes = fold_sizes(folds, keys).filter(F.col("n_train") >= min_train)
    return models.join(sizes.hint("merge"), [*keys, "fold"], "left_semi")


def stump_walk(folds: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, min_train: int = 1, rounds: int = 18, models: DataFrame | None = None) -> DataFrame:
    """Test rows with ``pred``, ``lower``, ``upper`` of keyed boosted stumps, for every fold of every key.

    ``models``: stumps of at least as many rounds (:func:`stump_models`); a round does not depend on later ones.
    """
    by = [*keys, "fold"]
    models = stump_models(folds, keys, features, target, min_train, rounds) if models is None else models.withColumn("stumps", F.slice("stumps", 1, rounds))
    train = training_rows(folds).filter(F.col(target).isNotNull()).select(*dict.fromkeys([*by, "_i", target, *features]))
    band = M.interval(M.boosted_prediction(train, models, by, features), by, F.col(target) - F.col("pred"))
    out = M.boosted_prediction(test_rows(folds), models.join(band.hint("merge"), by), by, features)
    return out.withColumns({"lower": F.col("pred") + F.col("q_lo"), "upper": F.col("pred") + F.col("q_hi")}).drop("q_lo", "q_hi")


def ensemble(members: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Mean of member predictions on the rows all members scored."""
    cols = ["pred", "lower", "upper"]
    stacked = members[0].select(*keys, "_i", *cols)
    for m in members[1:]:
        stacked = stacked.unionByName(m.select(*keys, "_i", *cols))
    mean = stacked.groupBy(*keys, "_i").agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("_m")).filter(F.col("_m") == len(members))
    return members[0].drop(*cols).join(mean.drop("_m").hint("merge"), [*keys, "_i"])


LINE = "struct<slope:array<double>,intercept:double>"
PART = f"struct<slope:array<double>,intercept:double,segments:map<string,{LINE}>,stumps:{M.STUMPS},rho:double,last:double,at:bigint>"


def _part(slope: Column, intercept: Column, segments: Column | None = None, stumps: Column | None = None, carry: Sequence[str] = ()) -> Column:
    null = F.lit(None)
    extra = [F.col(c) for c in carry] or [null] * 3
    fields = zip(("slope", "intercept", "segments", "stumps", "rho", "last", "at"), (slope, intercept, null if segments is None else segments, null if stumps is None else stumps, *extra), strict=True)
    return F.struct(*[c.alias(n) for n, c in fields]).cast(PART)


def fitted_models(family: str, folds: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, min_train: int = 1, segment: str = "therapy_segment", alpha: float = 1.0) -> DataFrame:
    """The models of a family as rows: keys, ``fold``, ``model_name`` and ``parts``, whose mean prediction is the model's.

    A part is a line, lines of segments that replace it there, stumps, and a
    residual carried forward; :func:`model_prediction` evaluates it on any
    rows, changed ones included.
    """
    by, args = [*keys, "fold"], (folds, keys, features, target)
    line = F.col("slope"), F.col("intercept")

    def ridge() -> DataFrame:
        return M.solve(fold_sums(*args), by, "ridge", alpha=alpha).filter(F.col("n") >= min_train).select(*by, "slope", "intercept")

    def segmented() -> DataFrame:
        enough = max(len(features) + 5, 20)
        each = M.solve(fold_sums(folds, [*keys, segment], features, target), [*keys, segment, "fold"], "ridge", alpha=alpha).filter((F.col("n") >= enough) & F.col(segment).isNotNull())
        # one line per segment, of which there are a few
        lines = each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(segment).cast("string"), F.struct("slope", "intercept")))).alias("segments"))
        return ridge().join(lines.hint("merge"), by, "left").select(*by, _part(*line, segments=F.col("segments")).alias("part"))

    def stumps(rounds: int) -> DataFrame:
        found = _large_enough(M.fit_stumps(training_rows(folds), by, features, target, rounds), folds, keys, min_train)
        return found.select(*by, _part(F.array_repeat(F.lit(0.0), len(features)), F.col("base"), stumps=F.col("stumps")).alias("part"))

    if family == "ridge":
        parts = ridge().select(*by, _part(*line).alias("part"))
    elif family == "elastic_net":
        fits = M.solve(fold_sums(*args), by, "elastic_net", alpha=0.05, l1=0.5).filter(F.col("n") >= min_train)
        parts = fits.select(*by, _part(*line).alias("part"))
    elif family == "segmented_ridge":
        parts = segmented()
    elif family == "tree_boost":
        parts = stumps(18)
    elif family == "bayes_ar":
        parts = bayes_ar_fits(*args, min_train, alpha).select(*by, _part(*line, carry=("_rho", "_last", "_at")).alias("part"))
    elif family == "ensemble":
        members = [ridge().select(*by, _part(*line).alias("part")), segmented(), stumps(12)]
        parts = members[0].unionByName(members[1]).unionByName(members[2])
    else:
        raise ValueError(f"unknown model family {family}")
    size = 3 if family == "ensemble" else 1
    out = parts.groupBy(*by).agg(F.collect_list("part").alias("parts")).filter(F.size("parts") == size)
    return out.withColumn("model_name", F.lit(family))


def model_prediction(features: Sequence[str], segment: str = "therapy_segment") -> Column:
    """What ``parts`` of :func:`fitted_models` predict for a row with ``_i``."""
    values = M.feature_values(features)
    on = lambda x: F.aggregate(F.zip_with(x["slope"], values, lambda a, b: a * b), x["intercept"], lambda s, t: s + t)

    def one(p: Column) -> Column:
        here = on(F.when(F.col(segment).isNotNull(), p["segments"][F.col(segment).cast("string")]))
        carried = F.coalesce(F.pow(p["rho"], F.col("_i") - p["at"]) * p["last"], F.lit(0.0))
        return M.stump_sum(F.coalesce(p["stumps"], F.array().cast(M.STUMPS)), values, F.coalesce(here, on(p))) + carried

    return F.aggregate(F.transform("parts", one), F.lit(0.0), lambda s, x: s + x) / F.size("parts")


def walk_forward_report(scored: DataFrame, keys: Sequence[str], target: str = "target_glucose", current: str = "glucose") -> DataFrame:
    """Scores per fold and over all folds (fold 0), with the persistence error."""
    rows = scored.withColumn("_p", F.abs(F.col(target) - F.col(current)))
    both = rows.withColumn("fold", F.explode(F.array(F.col("fold"), F.lit(0))))
    by = [*keys, "fold"]
    return forecast_scores(both, by, target).join(both.groupBy(*by).agg(F.avg("_p").alias("persistence_mae")).hint("merge"), by)


# ----------------------------------------------------------- model comparison

TASKS = (("basal", "basal", "basal_context", False), ("icr", "I/C ratio", "meal_context", False), ("sensitivity_factor", "sensitivity factor", "correction_context", True))
FAMILIES = ("ridge", "elastic_net", "segmented_ridge", "tree_boost", "bayes_ar", "ensemble")


def family_walk(name: str, folds: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, min_train: int, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """Scored test rows of one model family.

    ``known`` keeps, for the other families on the same folds, what several of
    them use: walks of the ridges and the boosted stumps.
    """
    args = (folds, keys, features, target)
    known = {} if known is None else known

    def once(part: str, build) -> DataFrame:
        if part not in known:
            known[part] = build()
        return known[part]

    ridge = lambda: once("ridge", lambda: cut_lineage(linear_walk(*args, min_train=min_train)))
    segmented = lambda: once("segmented_ridge", lambda: cut_lineage(segmented_walk(*args, min_train=min_train, whole=ridge())))
    stumps = lambda rounds: stump_walk(*args, min_train=min_train, rounds=rounds, models=once("tree_boost", lambda: stump_models(*args, min_train)))
    if name == "ridge":
        return ridge()
    if name == "elastic_net":
        return linear_walk(*args, method="elastic_net", min_train=min_train, alpha=0.05, l1=0.5)
    if name == "segmented_ridge":
        return segmented()
    if name == "tree_boost":
        return stumps(18)
    if name == "bayes_ar":
        return bayes_ar_walk(*args, min_train=min_train)
    if name == "ensemble":
        return ensemble([ridge(), segmented(), stumps(12)], keys)
    raise ValueError(f"unknown model family {name}")


def model_comparison(
    research: DataFrame, features: Sequence[str], keys: Sequence[str], *, families: Sequence[str] = FAMILIES, order: Sequence[str] = (),
    horizon_seconds: int = 1800, min_rows: int = 40,
) -> DataFrame:
    """Families × tasks: fold scores, means, spread, rank and the selected model.

    Tasks without enough rows have rows of status ``insufficient_data``.  A
    family without a scored fold, where another family has one, is ``failed``.
    """
    min_train = max(len(features) + 5, 20)
    names = F.array(*[F.lit(f) for f in families])
    none = T.StructType([*[research.schema[k] for k in keys], *T.StructType.fromDDL(SCORES).fields])
    grid, scores = None, research.sparkSession.createDataFrame([], none)
    for task, parameter, context, staged in TASKS:
        sizes = research.groupBy(*keys).agg(F.count_if(F.col(context) == 1).alias("n_rows"))
        label = {"task": F.lit(task), "parameter": F.lit(parameter), "staged": F.lit(staged), "n_features": F.lit(len(features)), "model_name": F.explode(names)}
        part = sizes.withColumns(label)
        grid = part if grid is None else grid.unionByName(part)
        if staged:
            continue
        folds = task_folds(research, context, keys, order=order, horizon_seconds=horizon_seconds, min_rows=min_rows)
        if folds.isEmpty():
            continue
        known: dict[str, DataFrame] = {}
        for name in families:
            scored = family_walk(name, folds, keys, features, "target_delta", min_train, known)
            moved = scored.withColumns({c: F.col("glucose") + F.col(c) for c in ("pred", "lower", "upper")})
            one = forecast_scores(moved, [*keys, "fold"], "target_glucose").filter(F.col("n_test") >= MIN_TEST)
            kept = one.withColumns({"task": F.lit(task), "model_name": F.lit(name)}).select(*none.names)
            scores = scores.unionByName(cut_lineage(kept))
    return rank_models(grid, scores, keys)


def task_folds(research: DataFrame, context: str, keys: Sequence[str], *, order: Sequence[str] = (), horizon_seconds: int = 1800, min_rows: int = 40) -> DataFrame:
    """Folds of the rows of a task, for keys that have enough of them."""
    return fold_columns(research.filter(F.col(context) == 1), keys, order=order, horizon_seconds=horizon_seconds, rule=half_folds).filter(F.col("_n") >= min_rows)


MIN_TEST = 8
SCORES = "fold int, task string, model_name string, mae double, rmse double, coverage double, interval_width double, low_bg_mae double, safety_weighted_mae double"
METRICS = ("mae", "rmse", "coverage", "interval_width", "low_bg_mae", "safety_weighted_mae")


def rank_models(grid: DataFrame, fold_scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and spread over folds; the ensemble must be 0.5 % better and no less
    stable than the best single model; the first by five keys is selected."""
    by = [*keys, "task", "model_name"]
    means = fold_scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fold_count"), *[F.avg(m).alias(m) for m in METRICS],
        F.stddev_pop("mae").alias("fold_mae_std"), F.stddev_pop("safety_weighted_mae").alias("fold_safety_std"),
    )
    # a handful of rows per (key, task)
    w = Window.partitionBy(*keys, "task")
    rank = F.struct("safety_weighted_mae", "low_bg_mae", "fold_safety_std", "mae", "model_name")
    # a family without scores is no rival: its nulls would come first
    single = F.when((F.col("model_name") != "ensemble") & F.col("fold_count").isNotNull(), rank)
    out = grid.join(means.hint("merge"), by, "left").withColumn("_best", F.min(single).over(w))
    better = (F.col("safety_weighted_mae") < F.col("_best.safety_weighted_mae") * 0.995) & (F.col("fold_safety_std") <= F.col("_best.fold_safety_std"))
    rejected = (F.col("model_name") == "ensemble") & F.col("_best").isNotNull() & ~F.coalesce(better, F.lit(False))
    others = F.max("fold_count").over(w).isNotNull()
    status = (
        F.when(F.col("staged"), "staged").when(F.col("fold_count").isNull() & others, "failed")
        .when(F.col("fold_count").isNull(), "insufficient_data").when(rejected, "rejected").otherwise("completed")
    )
    out = out.withColumn("status", status)
    first = F.min(F.when(F.col("status") == "completed", rank)).over(w)
    return out.withColumn("selected", F.coalesce((F.col("status") == "completed") & (rank == first), F.lit(False))).drop("_best", "staged")


# ------------------------------------------------------------------ screening


def screen_features(
    frame: DataFrame, keys: Sequence[str], base: Sequence[str], extra: Sequence[str], *, target: str = "target_glucose", order: Sequence[str] = (), horizon_seconds: int = 1800,
) -> tuple[DataFrame, DataFrame]:
    """Do the extra features help a ridge?  (feature scores, error of both models).

    Availability is measured on the unfilled columns.  The smaller model is
    solved from rows and columns of the larger one's matrix, and one pass over
    the test rows scores both.
    """
    folds = fold_columns(frame, keys, order=order, horizon_seconds=horizon_seconds, rule=half_folds)
    by, names = [*keys, "fold"], [*base, *extra]
    size = len(names) + 2
    sums = cut_lineage(fold_sums(folds, keys, names, target))
    both = cut_lineage(M.solve(sums, by))
    small = M.solve(M.part_of_matrix(sums, by, size, [*range(len(base) + 1), size - 1]), by)
    models = both.select(*by, "slope", "intercept").join(small.select(*by, F.col("slope").alias("_s0"), F.col("intercept").alias("_i0")).hint("merge"), by)
    scored = M.lookup(test_rows(folds), models, by, "_i")
    miss = {"baseline": F.col(target) - M.linear_prediction(base, "_s0", "_i0"), "augmented": F.col(target) - M.linear_prediction(names)}
    per = scored.groupBy(*by).agg(*[c for k, e in miss.items() for c in (F.sqrt(F.avg(e * e)).alias(f"{k}_rmse"), F.avg(F.abs(e)).alias(f"{k}_mae"))])
    error = per.groupBy(*keys).agg(*[F.avg(f"{k}_{m}").alias(f"{k}_{m}") for k in miss for m in ("rmse", "mae")], F.count(F.lit(1)).alias("split_count"))

    if not extra:
        none = "feature string, availability double, mean_abs_coefficient double, std_abs_coefficient double, split_count long, recommended boolean"
        empty = frame.sparkSession.createDataFrame([], T.StructType([*[frame.schema[k] for k in keys], *T.StructType.fromDDL(none).fields]))
        return empty, error
    pick = F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.col("coef")[i]).alias("c")) for i, f in enumerate(names) if f in extra])
    coefs = both.select(*keys, F.explode(pick).alias("p")).groupBy(*keys, F.col("p.feature").alias("feature")).agg(
        F.avg("p.c").alias("mean_abs_coefficient"), F.stddev_pop("p.c").alias("std_abs_coefficient"), F.count(F.lit(1)).alias("split_count")
    )
    have = frame.groupBy(*keys).agg(*[F.avg(F.col(f).isNotNull().cast("int")).alias(f) for f in extra]).unpivot(list(keys), list(extra), "feature", "availability")
    scores = have.join(coefs.hint("merge"), [*keys, "feature"], "left").fillna(0, subset=["mean_abs_coefficient", "std_abs_coefficient", "split_count"])
    # few features and splits per key: built-in median is bounded
    w = Window.partitionBy(*keys)
    enough = F.greatest(F.floor(F.max("split_count").over(w) / 2), F.lit(1))
    good = (F.col("availability") >= 0.2) & (F.col("split_count") >= enough) & (F.col("mean_abs_coefficient") >= F.median("mean_abs_coefficient").over(w))
    return scores.withColumn("recommended", good), error
