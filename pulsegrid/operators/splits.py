"""Repeatable random splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_split(df: DataFrame, key: str, test_share: float = 0.2) -> DataFrame:
    """``split`` = train / test by a hash of the key: same rows on every run and
    any partitioning, and rows of one key stay together."""
    u = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return df.withColumn("split", F.when(u < test_share, "test").otherwise("train"))
