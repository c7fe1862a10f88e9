"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Settings the operators are tuned for.  On a cluster, shuffle partitions are
# left to AQE: start high, let it coalesce.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# application id → folder made for it, where the cluster names none
_OWN_FOLDER: dict[str, str] = {}
# lists that collect the tables being stored
_COLLECTORS: list[list[str]] = []
_SHIPPED: set[str] = set()


def build_session(app_name: str = "pulsegrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local["):
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a cluster, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/{os.path.basename(here)}.zip"
        with zipfile.ZipFile(path, "w") as out:
            for top, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        out.write(f"{top}/{name}", os.path.relpath(f"{top}/{name}", os.path.dirname(here)))
        spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may do without it: tests then get a fresh folder under
    /tmp.  On a cluster every executor would write to its own disk and the
    tables would read back short, so there a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN_FOLDER[app]


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the tables written or collected inside go with the action, not when the driver next collects its garbage.

    For tables that are made in the block and have one action.
    """
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def store(df: DataFrame) -> str:
    """Write ``df`` as a parquet table in the shared folder; returns its path."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    track(path)
    return path


def track(path: str) -> None:
    """Remember a stored table for :func:`delete_stored`."""
    for paths in _COLLECTORS:
        paths.append(path)


@contextmanager
def stored_into(paths: list[str]):
    """The tables stored inside the block are added to ``paths``."""
    _COLLECTORS.append(paths)
    try:
        yield paths
    finally:
        # this very list, not the first of the same content
        _COLLECTORS[:] = [c for c in _COLLECTORS if c is not paths]


def delete_stored(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables and empty the list; what was read from them must be written elsewhere by then."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    paths.clear()


def stored_frame(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` once and read it back.

    Used where a costly table feeds several branches.  The stored table is
    reliable (lost executors do not matter), keeps column pruning, and gives
    the optimizer true sizes for its join choices.
    """
    return stored_frame(df.sparkSession, store(df), df.schema)
