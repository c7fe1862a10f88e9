"""Derived tables that several queries share, built once per application.

A shared frame is stored in the cluster's shared folder (see
:func:`pulsegrid.session.cut_lineage`); later users read the stored table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.session import store, stored_frame

_PATHS: dict[tuple[str, str, str], tuple[str, object]] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of ``build`` for this application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _PATHS:
        path, schema = _PATHS[key]
        try:
            return stored_frame(spark, path, schema)
        except PySparkException:
            # the folder was cleared: build again
            del _PATHS[key]
    df = build()
    path = store(df)
    _PATHS[key] = (path, df.schema)
    return stored_frame(spark, path, df.schema)


def forget() -> None:
    """Forget all shared tables (benchmarks time the whole work)."""
    _PATHS.clear()
