"""Exact grouped quantiles that never gather a group in one task.

The built-in ``percentile`` keeps every distinct value of a group in one
buffer, which fails for a hot group.  Here values are counted per (group,
value bucket, value); the few buckets that hold the wanted ranks are found from
bucket totals, and only their values are ordered.  A first bucket is about 1 %
wide.  A wanted bucket with more than ``LARGEST`` distinct values is cut into
``PARTS`` equal parts of its own range, and the wanted part again, at most four
times: that reaches single values of any distribution.  Every rule is monotone,
so the result is exact (linear interpolation, as ``percentile``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.lookups import lookup
from pulsegrid.session import cut_lineage

LARGEST, PARTS, REFINEMENTS = 1 << 12, 1024, 4


def value_bucket(value: Column) -> Column:
    """Monotone integer bucket: 64 buckets per power of two, sign kept."""
    size = F.floor(F.log2(F.abs(value)) * 64).cast("int") + 80000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str | Column, ranks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """One row per group: ``keys`` (not null), ``_n`` (values seen) and the value
    at each 0-based rank, given as a function of the group size.  A rank
    outside the group gives null."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, v.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = rows.withColumn("_bucket", value_bucket(F.col("_v")).cast("long")).groupBy(*keys, "_bucket", "_v").agg(F.count(F.lit(1)).alias("_c"))
    counts = cut_lineage(counts)
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = F.array(*[F.struct(F.lit(n).alias("name"), rank(F.col("_n")).cast("bigint").alias("rank")) for n, rank in ranks.items()])
    here = lambda c: F.filter(c, lambda r: (r["rank"] >= F.col("_start")) & (r["rank"] < F.col("_start") + F.col("_bc")))
    size = (F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_distinct"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # the first bucket stays, so that every group keeps its size
    kept = (F.size("_here") > 0) | (F.col("_start") == 0)
    wanted = counts.groupBy(*keys, "_bucket").agg(*size)
    wanted = wanted.withColumn("_start", F.coalesce(F.sum("_bc").over(before), F.lit(0))).withColumn("_n", F.sum("_bc").over(by_key))
    wanted = cut_lineage(wanted.withColumn("_here", here(names)).filter(kept))
    large = (F.col("_distinct") > LARGEST) & (F.size("_here") > 0)
    for _ in range(REFINEMENTS):
        if wanted.filter(large).isEmpty():
            break
        # the wanted large buckets are cut into parts of their own range; rows of all others go
        facts = wanted.select(*keys, "_bucket", "_start", "_n", "_here", "_low", "_high", large.alias("_large"))
        inner = lookup(counts, facts, [*keys, "_bucket"], "_v")
        part = F.when(F.col("_large"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (PARTS - 1))).otherwise(0)
        inner = inner.withColumn("_part", (F.col("_bucket") * PARTS + part).cast("long"))
        counts = cut_lineage(inner.select(*keys, F.col("_part").alias("_bucket"), "_v", "_c"))
        parts = inner.groupBy(*keys, "_bucket", "_part").agg(*size, F.min("_start").alias("_start"), F.min("_n").alias("_n"), F.first("_here").alias("_all"))
        inside = Window.partitionBy(*keys, "_bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_bc").over(inside), F.lit(0))).withColumn("_here", here("_all"))
        wanted = cut_lineage(parts.filter(kept).drop("_bucket", "_all").withColumnRenamed("_part", "_bucket"))
    wanted = wanted.select(*keys, "_bucket", "_start", "_n", "_here")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        lookup(counts, wanted, [*keys, "_bucket"], "_v", salts=2)
        .withColumn("_to", F.col("_start") + F.sum("_c").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_c"))
    )
    at = lambda name: F.max(
        F.when(F.exists("_here", lambda r: (r["name"] == name) & (r["rank"] >= F.col("_from")) & (r["rank"] < F.col("_to"))), F.col("_v"))
    )
    return picked.groupBy(*keys).agg(F.max("_n").alias("_n"), *[at(n).alias(n) for n in ranks])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str | Column, probs: dict[str, float]
) -> DataFrame:
    """One row per group: ``keys`` (not null), ``_n`` (values seen) and one column per prob."""
    place = lambda p, n: F.lit(p) * (n - 1)
    ranks = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = lambda n, p=p: F.floor(place(p, n))
        ranks[f"_hi_{name}"] = lambda n, p=p: F.ceil(place(p, n))
    ends = order_statistics(df, keys, value, ranks)
    n = F.col("_n")
    out = [
        (
            F.col(f"_lo_{name}")
            + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place(p, n) - F.floor(place(p, n)))
        ).alias(name)
        for name, p in probs.items()
    ]
    return ends.select(*keys, "_n", *out)


def leave_one_out_median(df: DataFrame, keys: Sequence[str], row_id: str, value: str, default: float, name: str) -> DataFrame:
    """Per row the median of the other rows' values in its group.

    Taking one value out shifts the middle by at most one place, so four order
    statistics of the group and the row's own value are enough: no pairs of
    rows are made.  Rows without a value get the median of all values; where no
    value is left, the default.
    """
    lo, hi = (lambda n: F.floor((n - 2) / 2)), (lambda n: F.ceil((n - 2) / 2))
    ranks = {
        "_a": lo, "_a1": lambda n: lo(n) + 1, "_b": hi, "_b1": lambda n: hi(n) + 1,
        "_m": lambda n: F.floor((n - 1) / 2), "_m1": lambda n: F.ceil((n - 1) / 2),
    }
    stats = order_statistics(df, keys, value, ranks)
    v = F.col(value)
    without = lambda k, k1: F.when(v <= F.col(k), F.col(k1)).otherwise(F.col(k))
    loo = F.when(F.col("_n") > 1, (without("_a", "_a1") + without("_b", "_b1")) / 2)
    whole = (F.col("_m") + F.col("_m1")) / 2
    joined = df.select(*keys, row_id, value).join(stats.hint("merge"), list(keys), "left")
    picked = F.coalesce(F.when(v.isNull() | F.isnan(v), whole).otherwise(loo), F.lit(float(default)))
    return joined.select(*keys, row_id, picked.alias(name))
