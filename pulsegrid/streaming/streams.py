"""Incremental variants of the ingest and window steps.

State is bounded everywhere: windows by the watermark, de-duplication by the
same bound, sessions by their gap, gap alerts by one time per subject and the
samples that the watermark has not passed.  Tables change in snapshots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.operators.audit import latest_wins, pending_windows
from pulsegrid.session import cut_lineage, delete_stored, shared_folder, stored_into
from pulsegrid.sources import payloads as Pl
from pulsegrid.streaming import snapshots as Sn

KEY = "subject_id"


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as they arrive; the checkpoint remembers those done."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def event_time(df: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Event time with a lateness bound (watermarks need a zoned timestamp type)."""
    return df.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)


def dedupe(df: DataFrame, keys: Sequence[str], delay: str, ts: str = "ts") -> DataFrame:
    """First row of each key within the lateness bound."""
    return event_time(df, delay, ts).dropDuplicatesWithinWatermark(list(keys))


def _out(grouped: DataFrame, cols: Sequence[str]) -> DataFrame:
    return grouped.select(*cols, F.col("w.start").cast("timestamp_ntz").alias("start_ts"), F.col("w.end").cast("timestamp_ntz").alias("end_ts"),
                          *[c for c in grouped.columns if c not in (*cols, "w")])


def tumbling(df: DataFrame, aggs: dict[str, Column], *, step: str = "5 minutes", delay: str = "10 minutes", keys: Sequence[str] = (KEY,), ts: str = "ts") -> DataFrame:
    """Sums or means per closed bin."""
    g = event_time(df, delay, ts).groupBy(*keys, F.window("event_time", step).alias("w")).agg(*[a.alias(n) for n, a in aggs.items()])
    return _out(g, keys)


def sliding(df: DataFrame, aggs: dict[str, Column], *, width: str = "60 minutes", step: str = "5 minutes", delay: str = "10 minutes", keys: Sequence[str] = (KEY,), ts: str = "ts") -> DataFrame:
    """Rolling aggregates: overlapping windows of ``width`` every ``step``."""
    g = event_time(df, delay, ts).groupBy(*keys, F.window("event_time", width, step).alias("w")).agg(*[a.alias(n) for n, a in aggs.items()])
    return _out(g, keys)


def sessions(df: DataFrame, aggs: dict[str, Column], *, gap: str = "90 minutes", delay: str = "10 minutes", keys: Sequence[str] = (KEY,), ts: str = "ts") -> DataFrame:
    """Runs of events with gaps below ``gap``, emitted once closed."""
    g = event_time(df, delay, ts).groupBy(*keys, F.session_window("event_time", gap).alias("w")).agg(*[a.alias(n) for n, a in aggs.items()])
    return _out(g, keys)


ALERT_STATE = "last bigint, told boolean, held array<bigint>"


def gap_alerts(df: DataFrame, gap_minutes: float, *, delay: str = "10 minutes", key_type: str = "bigint", ts: str = "ts") -> DataFrame:
    """For each silence of a subject longer than the bound an ``open`` alert once the bound has passed, and a ``gap`` row with its length once a sample has ended it.

    Samples wait until the watermark has passed their millisecond, so a late
    sample within ``delay`` closes what would look like a gap, and alerts do
    not depend on how samples fall into batches.  State per subject: the last
    passed sample, whether its silence is told, and the samples that wait.  A
    timer wakes the subject for the next of them or for the end of the bound.
    """
    bound = round(gap_minutes * 60_000_000)
    schema = f"{KEY} {key_type}, alert string, last_at bigint, at bigint"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told, held = state.get if state.exists else (None, False, [])
        new = [] if state.hasTimedOut else [b["at"].to_numpy(np.int64) for b in batches]
        times = np.unique(np.concatenate([np.array(held, np.int64), *new]))
        mark = state.getCurrentWatermarkMs()
        ready = times // 1000 < mark
        known = np.concatenate([np.array([] if last is None else [last], np.int64), times[ready]])
        ended = np.flatnonzero(np.diff(known) > bound)
        begin, end = known[ended], known[ended + 1]
        # the silence after the stored sample may have been told before
        silent = begin[1:] if told and len(begin) and begin[0] == last else begin
        waits = times[~ready]
        if len(known):
            told = bool(told and known[-1] == last)
            last = int(known[-1])
            if not told and (last + bound) // 1000 < mark:
                silent, told = np.append(silent, last), True
        state.update((last, told, waits.tolist()))
        timers = [int(waits[0]) // 1000] if len(waits) else []
        if last is not None and not told:
            timers.append((last + bound) // 1000)
        if timers:
            state.setTimeoutTimestamp(max(min(timers), 1))
        yield pd.DataFrame(
            {
                KEY: key[0], "alert": ["open"] * len(silent) + ["gap"] * len(begin),
                "last_at": np.concatenate([silent, begin]).astype(np.int64), "at": np.concatenate([silent + bound, end]).astype(np.int64),
            }
        )

    rows = event_time(df, delay, ts).select(KEY, "event_time", F.unix_micros("event_time").alias("at")).groupBy(KEY)
    out = rows.applyInPandasWithState(step, schema, ALERT_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    minutes = (F.col("at") - F.col("last_at")) / 60_000_000
    return out.select(KEY, "alert", F.timestamp_micros("last_at").alias("last_ts"), F.timestamp_micros("at").alias("ts"), minutes.alias("gap_minutes"))


def upsert_batch(path: str, keys: Sequence[str], order: Sequence[str], day: str = "day") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: latest-export-wins into a snapshot table with a part per ``day``.

    Only the days a batch touches are read and written anew, and all of them
    become visible by one commit.  Running a batch twice gives the same table.
    :func:`snapshots.read_snapshot` reads it.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        with stored_into([]) as stored:
            rows = cut_lineage(batch)
            # days: bounded by the calendar
            touched = [r[0] for r in rows.select(Sn.part_name(day)).distinct().collect()]
            if touched:
                number, parts = Sn.parts_of(spark, path)
                current = Sn.read_folders(spark, path, [parts[t] for t in touched if t in parts], rows.schema)
                folder = Sn.new_folder()
                merged = latest_wins(rows.unionByName(current), keys, order).withColumn(Sn.PART, Sn.part_name(day))
                merged.hint("rebalance", Sn.PART).write.partitionBy(Sn.PART).parquet(f"{path}/{folder}")
                Sn.commit(spark, path, number + 1, {**parts, **{t: f"{folder}/{Sn.PART}={t}" for t in touched}})
        delete_stored(spark, stored)

    return run


LEDGER = "ledger"
WAITING = "waiting"


def ingest_windows(path: str, *, zone: str = "UTC", bin_seconds: int = 300, families: Sequence[str] = tuple(Pl.KEYS)) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: payloads of windows (as in :func:`payloads.normalize_windows`) to tables by kind, each window once.

    A window is ingested when all ``families`` have arrived, in one batch or in
    several; until then its payloads wait in the table.  The ledger lists the
    windows done, and payloads of those (deliveries again, a restart) are
    skipped.  Of several texts for one family of a waiting window the longest
    stays, then the greatest.  Rows, ledger and waiting payloads change by one
    commit.  :func:`ingested` reads them.
    """
    keys = ["subject_id", "window_id"]

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(*keys, "window_end", F.lower("family").alias("family"), "value").filter(F.col("family").isin(*families))
        number, parts = Sn.parts_of(spark, path)
        with stored_into([]) as stored:
            rest = [parts[WAITING]] if WAITING in parts else []
            todo = pending_windows(fresh, ledger_of(spark, path, fresh.schema, parts)).unionByName(Sn.read_folders(spark, path, rest, fresh.schema))
            text = F.max_by(F.struct("window_end", "value"), F.struct(F.length("value"), "value"))
            rows = cut_lineage(todo.groupBy(*keys, "family").agg(text.alias("_t")).select(*keys, "_t.window_end", "family", "_t.value"))
            full = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(families)).drop("_n")
            full = cut_lineage(full)
            # texts are parsed once for all kinds
            records, folder = cut_lineage(Pl.window_records(rows.join(full, keys))), Sn.new_folder()
            for kind, df in Pl.window_kinds(records, zone=zone, bin_seconds=bin_seconds).items():
                df.write.parquet(f"{path}/{folder}/{kind}")
            full.withColumn("status", F.lit("complete")).write.parquet(f"{path}/{folder}/{LEDGER}")
            rows.join(full, keys, "left_anti").write.parquet(f"{path}/{folder}/{WAITING}")
            Sn.commit(spark, path, number + 1, {**parts, f"batch-{number + 1}": folder, WAITING: f"{folder}/{WAITING}"})
        delete_stored(spark, stored)

    return run


def batches_of(parts: dict[str, str]) -> list[str]:
    return [f for p, f in parts.items() if p != WAITING]


def ledger_of(spark: SparkSession, path: str, rows: T.StructType, parts: dict[str, str]) -> DataFrame:
    """Windows done: keys and status; ``rows`` gives the types of the keys."""
    schema = T.StructType([rows["subject_id"], rows["window_id"], T.StructField("status", T.StringType())])
    return Sn.read_folders(spark, path, batches_of(parts), schema, f"/{LEDGER}")


def ingested(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All ingested rows of a kind, or the ``ledger``."""
    folders = batches_of(Sn.parts_of(spark, path)[1])
    if not folders:
        raise ValueError(f"nothing ingested in {path}")
    return spark.read.parquet(*[f"{path}/{f}/{kind}" for f in sorted(folders)])


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Process everything that is there now into parquet files, then stop."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", f"{shared_folder(spark)}/stream-{path.rsplit('/', 1)[-1]}").trigger(availableNow=True).start()
    )
    query.awaitTermination()
