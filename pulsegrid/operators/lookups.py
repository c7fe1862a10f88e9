"""Joins of one row per key onto many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 16


def salts_of(spark: SparkSession) -> int:
    return min(MOST, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: str, how: str = "inner", salts: int | None = None) -> DataFrame:
    """Join one row per key onto many, with the many spread over ``salts`` tasks per key.

    ``spread`` is a column of ``big`` that varies inside a key, so a key with a
    third of all rows does not end in one task.  Without ``salts`` a key is
    spread over a quarter of the shuffle partitions, at most ``MOST``.

    The copies are merged, never broadcast: Spark takes their size from the
    compressed table before it is copied, and would gather many keys in the
    driver.
    """
    salts = salts or salts_of(big.sparkSession)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")
