"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.grid import union_all
from pulsegrid.operators.standardize import merge_carbs, standardize_table
from pulsegrid.schemas import CANONICAL

SUFFIXES = ("csv", "parquet", "pq")
# Folders and file-name parts that are no raw exports.
EXCLUDED_FOLDERS = ("health_auto_export", "archive data", "apple_health_data")
EXCLUDED_NAMES = ("manifest", "coverage", "summary")


def file_name(path: Column | None = None) -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path") if path is None else path, "/"), -1)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Path, name, suffix, size of the export files of a tree (content is not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    path = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    out = files.withColumns({"path": path, "name": F.element_at(F.split(path, "/"), -1)})
    out = out.withColumn("suffix", F.lower(F.element_at(F.split("name", r"\."), -1)))
    keep = F.col("suffix").isin(*SUFFIXES)
    for folder in EXCLUDED_FOLDERS:
        keep = keep & ~F.contains("path", F.lit(f"/{folder}/"))
    for part in EXCLUDED_NAMES:
        keep = keep & ~F.contains(F.lower("name"), F.lit(part))
    return out.filter(keep)


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; without a schema all columns stay text (no inference pass)."""
    reader = spark.read.option("header", True)
    paths = paths if isinstance(paths, str) else list(paths)
    return (reader.schema(schema) if schema is not None else reader).csv(paths)


def read_parquet(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path, schema)
    if suffix in ("parquet", "pq"):
        return read_parquet(spark, path)
    raise ValueError(f"unsupported file type: .{suffix}")


def read_canonical(spark: SparkSession, kind: str, paths: str | Sequence[str], fmt: str = "csv") -> DataFrame:
    """Canonical table of one kind with its fixed schema; rows without key values are dropped."""
    schema, required = CANONICAL[kind]
    if fmt == "csv":
        text = read_csv(spark, paths)
        df = text.select(*[
            (F.col(f.name).try_cast(f.dataType) if f.name in text.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields
        ])
    else:
        df = spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths))
    return df.dropna(subset=list(required))


def manifest_paths(manifest: DataFrame) -> DataFrame:
    """Distinct table paths a CSV or JSON manifest lists.

    Understands ``normalized_path`` (one), ``normalized_paths`` (comma list, list or
    map) and the same fields inside ``windows``.
    """
    parts = []

    def take(df: DataFrame, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StringType):
            parts.append(df.select(F.explode(F.split(F.col(name), ",")).alias("path")))
        elif isinstance(kind, T.ArrayType):
            parts.append(df.select(F.explode(name).alias("path")))
        elif isinstance(kind, T.MapType):
            parts.append(df.select(F.explode(F.map_values(name)).alias("path")))
        elif isinstance(kind, T.StructType):
            parts.append(df.select(F.explode(F.array(*[F.col(f"{name}.`{f}`") for f in kind.names])).alias("path")))

    fields = {f.name: f.dataType for f in manifest.schema.fields}
    for name in ("normalized_path", "normalized_paths"):
        if name in fields:
            take(manifest, name, fields[name])
    if isinstance(fields.get("windows"), T.ArrayType):
        inner = manifest.select(F.explode("windows").alias("w")).select("w.*")
        for f in inner.schema.fields:
            if f.name in ("normalized_path", "normalized_paths"):
                take(inner, f.name, f.dataType)
    if not parts:
        return manifest.sparkSession.createDataFrame([], "path string")
    return union_all(parts).select(F.trim("path").alias("path")).filter(F.col("path") != "").distinct()


def load_manifest(spark: SparkSession, manifest: DataFrame, kinds: Sequence[str] = tuple(CANONICAL), fmt: str = "csv") -> dict[str, DataFrame]:
    """Canonical tables of all files that a manifest lists, united by kind.

    A path belongs to the kind that one of its folders is named after
    (``kind=cgm`` or ``cgm``).  The list of paths, not their content, comes to
    the driver.
    """
    paths = [r["path"] for r in manifest_paths(manifest).orderBy("path").collect()]
    out = {}
    for kind in kinds:
        own = [p for p in paths if {kind, f"kind={kind}"} & set(p.split("/"))]
        if own:
            out[kind] = read_canonical(spark, kind, own, fmt)
    return out


def load_exports(spark: SparkSession, tables: Mapping[str, str], *, zone: str = "UTC", bin_seconds: int = 300) -> dict[str, DataFrame]:
    """Standardise raw tables and union them by kind.

    ``tables``: file name → path.  The number of distinct layouts is small; a path
    may be a glob over any number of files of one layout.
    """
    made: dict[str, list[DataFrame]] = {}
    for name, path in tables.items():
        raw = read_table(spark, path)
        raw = raw.select(*raw.columns, file_name().alias("source_file"))
        for kind, df in standardize_table(raw, name, zone=zone, bin_seconds=bin_seconds).items():
            made.setdefault(kind, []).append(df)
    out = {kind: union_all(frames) for kind, frames in made.items()}
    carbs = merge_carbs(out.get("carbs"), out.get("bolus"))
    return {**out, **({"carbs": carbs} if carbs is not None else {})}


# -------------------------------------------------------------------------- sinks


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        # the default formats cut times to milliseconds
        writer.options(header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    else:
        writer.format(fmt).save(path)


def write_windows(kinds: Mapping[str, DataFrame], root: str) -> None:
    """Normalised tables by (kind, window): rewriting a window replaces only that window."""
    for kind, df in kinds.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_id").parquet(f"{root}/kind={kind}")


def window_manifest(kinds: Mapping[str, DataFrame], root: str) -> DataFrame:
    """One row per window: rows of each kind, first and last time, and the paths of its tables."""
    rows = None
    for kind, df in kinds.items():
        time = "start_ts" if kind == "basal" else "ts"
        each = df.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")).withColumn("kind", F.lit(kind))
        rows = each if rows is None else rows.unionByName(each)
    path = F.concat(F.lit(f"{root}/kind="), F.col("kind"), F.lit("/window_id="), F.col("window_id"))
    count = {f"{kind}_rows": F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)) for kind in kinds}
    return rows.groupBy("window_id").agg(
        *[c.alias(n) for n, c in count.items()], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.array_sort(F.collect_list(path)).alias("normalized_paths"),
    )


# Columns of a prepared table that are no features, and name parts of wearable features.
NOT_FEATURES = ("subject_id", "ts", "target_glucose", "target_delta", "explicit_carb_grams", "explicit_meal_event", "minutes_since_last_explicit_meal",
                "explicit_carb_source_available", "meal_truth_status", "glucose_observed")
HEALTH_PARTS = ("sleep", "workout", "hrv", "heart_rate", "respiratory", "resting_", "health_")


def reload_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """A stored prepared table with its pump and wearable feature names."""
    df = spark.read.parquet(path)
    features = [c for c in df.columns if c not in NOT_FEATURES]
    health = [c for c in features if any(p in c for p in HEALTH_PARTS)]
    return df, [c for c in features if c not in health], health


def write_results(results: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Registries, evidence and scores, one folder each."""
    for name, df in results.items():
        write_table(df, f"{root}/{name}", fmt=fmt)


def run_summary(parts: Mapping[str, DataFrame], keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """One JSON record per subject from one-row-per-subject tables."""
    out = None
    for name, df in parts.items():
        row = df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
        out = row if out is None else out.join(row, list(keys), "full")
    return out.select(*keys, F.to_json(F.struct(*parts)).alias("summary"))
