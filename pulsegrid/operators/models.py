"""Keyed regression models from distributed sufficient statistics.

Every fit reads its rows once, as sums of products per key.  Python workers
only solve one small system per key; rows are summed and scored in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.groups import by_key, whole_groups
from pulsegrid.operators.lookups import lookup, salts_of
from pulsegrid.operators.quantiles import exact_quantiles
from pulsegrid.session import cut_lineage, delete_stored, stored_into

# ------------------------------------------------------- sums of products


def _key_schema(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _products(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def product_sums(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Per key the upper triangle of Z'Z of Z = (1, features, target), a column ``_g<i>_<j>`` each.

    Rows with a missing target are left out, missing features count as 0.
    Plain sums: every task adds up its own rows of a key before the shuffle, so
    partial results are at most keys × tasks and a hot key is no burden.
    """
    cols = [F.lit(1.0).alias("z0"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"z{i}") for i, f in enumerate(features, 1)]]
    rows = df.filter(F.col(target).isNotNull()).select(*keys, *cols, F.col(target).cast("double").alias(f"z{len(features) + 1}"))
    return rows.groupBy(*keys).agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"_g{i}_{j}") for i, j in _products(len(features) + 2)])


def added(sums: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Sums of product sums per (fewer) keys."""
    return sums.groupBy(*keys).agg(*[F.sum(f"_g{i}_{j}").alias(f"_g{i}_{j}") for i, j in _products(size)])


def as_matrix(sums: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Product sums as one flattened symmetric matrix ``g`` per key."""
    cells = [F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)]
    return sums.select(*keys, F.array(*cells).alias("g"))


def gram_sums(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Per key the flattened matrix Z'Z of Z = (1, features, target)."""
    return as_matrix(product_sums(df, keys, features, target), keys, len(features) + 2)


# ----------------------------------------------------------------- solving


def _moments(g: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, np.ndarray, float]:
    """n, means, y mean, scales, correlation matrix, x-y covariance (scaled), y variance."""
    size = int(round(len(g) ** 0.5))
    s = g.reshape(size, size)
    n = s[0, 0]
    mean, y_mean = s[0, 1:-1] / n, s[0, -1] / n
    cov = s[1:-1, 1:-1] / n - np.outer(mean, mean)
    var = np.diag(cov).copy()
    # a constant column has only rounding noise as variance
    noise = 1e-12 * np.maximum(np.diag(s)[1:-1] / n, 1e-300)
    scale = np.where(var > noise, np.sqrt(np.maximum(var, 0)), 1.0)
    dead = var <= noise
    cov[dead, :] = cov[:, dead] = 0.0
    xy = s[1:-1, -1] / n - mean * y_mean
    xy[dead] = 0.0
    return n, mean, y_mean, scale, cov / np.outer(scale, scale), xy / scale, s[-1, -1] / n - y_mean**2


def ridge_coefficients(g: np.ndarray, alpha: float) -> np.ndarray:
    n, _, _, _, corr, xy, _ = _moments(g)
    return np.linalg.solve(n * corr + alpha * np.eye(len(xy)), n * xy)


def elastic_net_coefficients(g: np.ndarray, alpha: float = 0.05, l1: float = 0.5, rounds: int = 300, tol: float = 1e-5) -> np.ndarray:
    """Coordinate descent on the correlation matrix (same steps as on rows)."""
    _, _, _, _, corr, xy, _ = _moments(g)
    coef = np.zeros(len(xy))
    diag = np.diag(corr)
    denom = diag + alpha * (1 - l1)
    denom = np.where(denom > 0, denom, 1.0)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(xy)):
            rho = xy[j] - corr[j] @ coef + diag[j] * coef[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / denom[j]
            moved, coef[j] = max(moved, abs(new - coef[j])), new
        if moved < tol:
            break
    return coef


FIT_FIELDS = "n double, coef array<double>, slope array<double>, intercept double, sse double"


POSTERIOR_FIELDS = "mean array<double>, whiten array<array<double>>"


def solve(sums: DataFrame, keys: Sequence[str], method: str = "ridge", posterior: bool = False, **params: float) -> DataFrame:
    """Coefficients per key: standardised (``coef``) and raw (``slope``, ``intercept``).

    With ``posterior`` also what :func:`coefficient_variance` needs: the means
    and the inverse Cholesky factor of Z'Z + alpha I on raw differences.
    """
    keys = list(keys)
    alpha = params.get("alpha", 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {name: [] for name in ("n", "coef", "slope", "intercept", "sse", *(("mean", "whiten") if posterior else ()))}
            for g in pdf["g"]:
                g = np.asarray(g, dtype=float)
                n, mean, y_mean, scale, corr, xy, y_var = _moments(g)
                coef = ridge_coefficients(g, alpha) if method == "ridge" else elastic_net_coefficients(g, **params)
                slope = coef / scale
                out["n"].append(n)
                out["coef"].append(coef)
                out["slope"].append(slope)
                out["intercept"].append(y_mean - float(slope @ mean))
                out["sse"].append(max(n * (y_var - 2 * coef @ xy + coef @ corr @ coef), 0.0))
                if posterior:
                    factor = np.linalg.cholesky(n * corr + alpha * np.eye(len(xy)))
                    out["mean"].append(mean)
                    out["whiten"].append(list(np.linalg.inv(factor) / scale))
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    fields = [*_key_schema(sums, keys), *T.StructType.fromDDL(f"{FIT_FIELDS}, {POSTERIOR_FIELDS}" if posterior else FIT_FIELDS).fields]
    return sums.mapInPandas(run, T.StructType(fields))


def part_of_matrix(sums: DataFrame, keys: Sequence[str], size: int, kept: Sequence[int]) -> DataFrame:
    """The rows and columns ``kept`` of each key's matrix: the sums of a smaller model without another pass."""
    return sums.select(*keys, F.array(*[F.col("g")[i * size + j] for i in kept for j in kept]).alias("g"))


def coefficient_variance(features: Sequence[str]) -> Column:
    """Variance of a prediction by its coefficients, in units of the residual's: 1/n + x'(Z'Z + alpha I)^-1 x, x about the means."""
    off = F.zip_with(feature_values(features), F.col("mean"), lambda x, m: x - m)
    dot = lambda w: F.aggregate(F.zip_with(w, off, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return F.aggregate(F.transform("whiten", lambda w: dot(w) * dot(w)), 1 / F.col("n"), lambda s, t: s + t)


def student_quantile(z: float, degrees: Column) -> Column:
    """Quantile of Student's t where the normal one is ``z``, by the first terms of its series in 1 / degrees."""
    return F.lit(z) + (z**3 + z) / (4 * degrees) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * degrees * degrees)


def linear_prediction(features: Sequence[str], slope: str = "slope", intercept: str = "intercept") -> Column:
    terms = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.col(slope)[i] for i, f in enumerate(features)]
    total = F.col(intercept)
    for t in terms:
        total = total + t
    return total


def interval(train: DataFrame, keys: Sequence[str], residual: Column, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """10-90 % band of training residuals per key (exact, skew-safe)."""
    return _kept_alone(train, lambda: exact_quantiles(train, keys, residual, {"q_lo": lo, "q_hi": hi}).drop("_n"))


def _kept_alone(df: DataFrame, build) -> DataFrame:
    """The stored result of ``build``; what it stored on the way, such as a row for each value, is deleted."""
    stored: list[str] = []
    with stored_into(stored):
        out = build()
    out = cut_lineage(out)
    delete_stored(df.sparkSession, stored)
    return out


def standardize(df: DataFrame, keys: Sequence[str], features: Sequence[str], spread: str) -> DataFrame:
    """Features as z scores per key (population deviation; a constant gives 0)."""
    stats = df.groupBy(*keys).agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features]
    )
    out = lookup(df, stats, keys, spread)
    z = {f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0) for f in features}
    return out.withColumns(z).drop(*[f"_{k}_{f}" for f in features for k in ("m", "s")])


# ------------------------------------------------------------ boosted stumps


def stump_thresholds(train: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Per key the inner deciles of each feature (exact), as an array ``t<i>`` of distinct values."""
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    long = train.select(*keys, F.posexplode(values).alias("_feature", "_value"))
    cuts = exact_quantiles(long, [*keys, "_feature"], "_value", {f"_d{k}": k / 10 for k in range(1, 10)})
    cut = F.array_sort(F.array_distinct(F.array(*[F.col(f"_d{k}") for k in range(1, 10)])))
    # one array per feature
    return cuts.groupBy(*keys).agg(*[F.max(F.when(F.col("_feature") == i, cut)).alias(f"t{i}") for i in range(len(features))])


STUMPS = "array<struct<feature:int,cut:double,low:double,high:double>>"
BINS = 16  # at most ten are used
MODEL_CELLS = 1 << 22  # of the models that are solved together


def _boost(count: np.ndarray, total: np.ndarray, rounds: int, rate: float) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """First predictions, whether there are stumps, and these (feature, bin, left, right; by model and round) from bin co-occurrence.

    ``count[m, f, b, g, c]``: rows of model m in bin b of feature f and bin c of g; ``total[m, f, b]``: their target sum.
    A stump moves predictions by its own bins only, so the residual sums of all
    other bins follow from the counts: no round looks at rows again.
    """
    each, n = np.arange(len(total)), total.shape[1]
    size = np.stack([np.diagonal(count[:, f, :, f, :], axis1=1, axis2=2) for f in range(n)], 1)
    rows = size[:, 0].sum(1)
    base = total[:, 0].sum(1) / rows
    residual = total - base[:, None, None] * size
    left_rows = size.cumsum(2)
    splits = (size > 0) & (left_rows < rows[:, None, None])
    steps = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds):
            left, whole = residual.cumsum(2), residual.sum(2, keepdims=True)
            gain = left**2 / left_rows + (whole - left) ** 2 / (rows[:, None, None] - left_rows) - whole**2 / rows[:, None, None]
            # equal gains up to rounding noise are ties: the earlier feature, then the smaller threshold
            gain = np.where(splits, np.floor(gain * 1e6 + 0.5), -np.inf)
            f, b = np.divmod(gain.reshape(len(each), -1).argmax(1), BINS)
            low = rate * left[each, f, b] / left_rows[each, f, b]
            high = rate * (whole[each, f, 0] - left[each, f, b]) / (rows - left_rows[each, f, b])
            moved = np.where(np.arange(BINS) <= b[:, None], low[:, None], high[:, None])
            residual = residual - np.einsum("mb,mbgc->mgc", moved, count[each, f])
            steps.append((f, b, low, high))
    return base, splits.any((1, 2)), tuple(np.stack(c, 1) for c in zip(*steps, strict=True)) if steps else (np.zeros((len(each), 0)),) * 4


def _pair_counts(model: np.ndarray, bins: np.ndarray, models: int) -> np.ndarray:
    """``count`` of :func:`_boost` from rows: their model and their bin of each feature."""
    n = bins.shape[1]
    own = np.arange(n) * BINS + bins
    cells = (model[:, None] * (n * BINS) + own)[:, :, None] * (n * BINS) + own[:, None, :]
    return np.bincount(cells.ravel(), minlength=models * (n * BINS) ** 2).reshape(models, n, BINS, n, BINS)


def packed_bins(binned: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows (``_y``, bins ``b<i>``) of a key in a task as one row: packed, or their sums where these are smaller.

    Sums have a fixed size, so a hot key is no burden.
    """
    keys, size = list(keys), (n * BINS) ** 2 * 8 + n * BINS * 8

    def pack(batches):
        for table, bounds in whole_groups(batches, keys):
            y = table.column("_y").to_numpy()
            bins = np.stack([table.column(f"b{i}").to_numpy() for i in range(n)], 1)
            small, out = bins.astype(np.uint8), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if (b - a) * (n + 8) <= size:
                    out.append(small[a:b].tobytes() + y[a:b].tobytes())
                    continue
                none = np.zeros(b - a, np.int64)
                total = [np.bincount(bins[a:b, i], y[a:b], BINS) for i in range(n)]
                out.append(_pair_counts(none, bins[a:b], 1).tobytes() + np.stack(total).tobytes())
            rows = np.diff(bounds)
            heads = table.select(keys).take(pa.array(bounds[:-1]))
            columns = [*heads.columns, pa.array(np.where(rows * (n + 8) <= size, rows, 0)), pa.array(out, pa.binary())]
            yield from pa.table(columns, [*keys, "_rows", "_packed"]).to_batches()

    schema = T.StructType([*_key_schema(binned, keys), *T.StructType.fromDDL("_rows long, _packed binary").fields])
    return binned.select(*keys, "_y", *[f"b{i}" for i in range(n)]).mapInArrow(pack, schema)


def fit_stumps(train: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, rounds: int = 18, rate: float = 0.1) -> DataFrame:
    """Boosted depth-1 trees, one model per key: ``base`` and ``stumps`` (see :func:`boosted_prediction`).

    Candidate thresholds are the deciles of the key's rows (``_i`` numbers them); a row goes
    left where its value is at most the threshold.  The split with the largest
    fall of squared error is taken, shrunk by ``rate``; the first prediction is
    the mean.  All rounds come from the co-occurrence of pairs of bins, which
    is counted where a key's packed rows meet.
    """
    keys, n = list(keys), len(features)
    rows = train.filter(F.col(target).isNotNull())
    cuts = _kept_alone(rows, lambda: stump_thresholds(rows, keys, features))
    # bin b: the value is above b of the thresholds, so a split at threshold k sends bins up to k left
    below = lambda value: lambda t: t < value
    bins = [F.size(F.filter(f"t{i}", below(F.coalesce(F.col(f).cast("double"), F.lit(0.0))))).alias(f"b{i}") for i, f in enumerate(features)]
    binned = lookup(rows, cuts, keys, "_i").select(*keys, F.col(target).cast("double").alias("_y"), *bins)
    cells, most = (n * BINS) ** 2, max(1, MODEL_CELLS // (n * BINS) ** 2)
    fields = T.StructType.fromDDL("base double, _steps array<struct<feature:int,bin:int,low:double,high:double>>").fields

    def solve(batches):
        for table, bounds in whole_groups(batches, keys):
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            held, packed = table.column("_rows").to_numpy(), table.column("_packed").to_pylist()
            for start in range(0, len(bounds) - 1, most):
                models = min(most, len(bounds) - 1 - start)
                here = range(bounds[start], bounds[start + models])
                each = [k for k in here if held[k]]
                raw = [np.frombuffer(packed[k], np.uint8, held[k] * n) for k in each]
                model = np.repeat(group[each] - start, held[each]) if each else np.zeros(0, np.int64)
                b = np.concatenate(raw or [np.zeros(0, np.uint8)]).reshape(-1, n).astype(np.int64)
                y = np.concatenate([np.frombuffer(packed[k], offset=held[k] * n) for k in each] or [np.zeros(0)])
                count = _pair_counts(model, b, models)
                total = np.stack([np.bincount(model * BINS + b[:, i], y, models * BINS).reshape(models, BINS) for i in range(n)], 1).astype(float)
                for k in here:
                    if not held[k]:
                        count[group[k] - start] += np.frombuffer(packed[k], np.int64, cells).reshape(count.shape[1:])
                        total[group[k] - start] += np.frombuffer(packed[k], offset=cells * 8).reshape(n, BINS)
                base, some, steps = _boost(count, total, rounds, rate)
                f, k, low, high = (c[some].ravel() for c in steps)
                ends = np.concatenate([[0], np.cumsum(some * steps[0].shape[1])])
                found = pa.StructArray.from_arrays([pa.array(f, pa.int32()), pa.array(k, pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["feature", "bin", "low", "high"])
                heads = table.select(keys).take(pa.array(bounds[start : start + models]))
                columns = [*heads.columns, pa.array(base), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)]
                yield from pa.table(columns, [*keys, "base", "_steps"]).combine_chunks().to_batches()

    packed = packed_bins(binned, keys, n)
    models = by_key(packed, *keys).mapInArrow(solve, T.StructType([*_key_schema(train, keys), *fields]))
    at = F.array(*[F.col(f"t{i}") for i in range(n)])
    stumps = F.transform("_steps", lambda s: F.struct(s["feature"].alias("feature"), at[s["feature"]][s["bin"]].alias("cut"), s["low"].alias("low"), s["high"].alias("high")))
    return models.join(cuts.hint("merge"), keys).select(*keys, "base", stumps.alias("stumps"))


def stump_sum(stumps: Column, values: Column, base: Column) -> Column:
    """``base`` and what each stump adds for an array of feature values."""
    return F.aggregate(stumps, base, lambda total, s: total + F.when(values[s["feature"]] <= s["cut"], s["low"]).otherwise(s["high"]))


def feature_values(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])


def boosted_prediction(rows: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str], spread: str = "_i") -> DataFrame:
    """``rows`` whose key has a model (``base``, ``stumps``), with ``pred`` and the model's other columns, all of them double.

    Models go before their rows through one sorted pass, a copy for each task
    that a key is spread over, so that no row carries its stumps.
    """
    keys, have, salts = list(keys), rows.columns, salts_of(rows.sparkSession)
    extra = [c for c in models.columns if c not in (*keys, "base", "stumps")]
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, f in enumerate(features)]
    own = ["_salt", *[f"_x{i}" for i in range(len(features))], "base", "stumps", *extra]
    left = rows.select(*have, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int").alias("_salt"), *values)
    right = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a model has columns that its rows leave empty, and the other way round
    both = left.unionByName(right, allowMissingColumns=True).select(*have, *own)
    both = both.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt", F.col("base").isNull())

    def predict(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            first = batch.column("base").is_valid().to_numpy(zero_copy_only=False)
            known = table.filter(pa.array(first))
            known = known if last is None else pa.concat_tables([last, known])
            table = table.filter(pa.array(~first))
            if not known.num_rows:
                continue
            last, model = known.slice(known.num_rows - 1), (np.cumsum(first) - 1 + (last is not None))[~first]
            # rows of a key without a model stand behind another key's
            same = model >= 0
            for k in keys:
                same &= table.column(k).to_numpy() == known.column(k).to_numpy()[model]
            table, model = table.filter(pa.array(same)), model[same]
            lists = known.column("stumps").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            size = np.diff(lists.offsets.to_numpy())
            flat, most = lists.flatten(), int(size.max(initial=0))
            place = np.arange(most) < size[:, None]
            filled = {}
            for name in ("feature", "cut", "low", "high"):
                filled[name] = np.zeros((len(size), most), np.int64 if name == "feature" else float)
                filled[name][place] = flat.field(name).to_numpy(zero_copy_only=False)
            x = np.stack([table.column(f"_x{i}").to_numpy() for i in range(len(features))], 1)
            each, pred = np.arange(len(x)), known.column("base").to_numpy()[model]
            for r in range(most):
                pred = pred + np.where(x[each, filled["feature"][model, r]] <= filled["cut"][model, r], filled["low"][model, r], filled["high"][model, r])
            columns = [*table.select(have).columns, pa.array(pred), *[pa.array(known.column(c).to_numpy()[model]) for c in extra]]
            yield from pa.table(columns, [*have, "pred", *extra]).to_batches()

    return both.mapInArrow(predict, T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("pred", *extra)]]))


def boosted_stumps(train: DataFrame, test: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, rounds: int = 18, rate: float = 0.1) -> DataFrame:
    """``train`` and ``test`` rows with ``pred`` of the key's boosted stumps, told apart by ``_test``."""
    models = cut_lineage(fit_stumps(train, keys, features, target, rounds, rate))
    rows = train.filter(F.col(target).isNotNull()).withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True)))
    return boosted_prediction(rows, models, keys, features)
