"""Sources and sinks on the driver tables: what is written must read back whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsegrid.functions.times import HOUR
from pulsegrid.operators import standardize as St
from pulsegrid.queries.context_queries import prepared
from pulsegrid.queries.sqlparts import rounded, rs, with_
from pulsegrid.session import cut_lineage, shared_folder
from pulsegrid.sources import adapters as A
from pulsegrid.sources import files as Fi
from pulsegrid.sources import payloads as Pl
from pulsegrid.streaming import streams as Sm

KEY = "subject_id"


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def q_export_tree(spark, sf_dir):
    """Exports and a summary in one tree; discovered paths are read back, the summary is not."""
    root = folder(spark, "tree")
    rows = A.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for kind in ("view", "error"):
        Fi.write_table(rows.filter(F.col("event_type") == kind), f"{root}/{kind}", fmt="csv")
    Fi.write_table(rows, f"{root}/archive data/all", fmt="csv")
    paths = [x["path"] for x in Fi.discover(spark, root).select("path").collect()]
    return rounded(Fi.read_csv(spark, paths, "event_id long, event_type string, value double"), "value")


def q_canonical(spark, sf_dir):
    """Canonical CSV files that a manifest lists; rows without key values are dropped."""
    root = folder(spark, "canonical")
    glucose = A.cgm(spark, sf_dir).select(KEY, "ts", F.when(F.col("event_id") % 5 != 0, F.col("glucose")).alias("glucose"), "source_file")
    for part in (0, 1):
        Fi.write_table(glucose.filter(F.col(KEY) % 2 == part), f"{root}/cgm/part{part}", fmt="csv")
    manifest = spark.createDataFrame([(f"{root}/cgm/part0, {root}/cgm/part1",)], "normalized_paths string")
    out = Fi.load_manifest(spark, manifest)["cgm"]
    return rounded(out.select(F.col(KEY).cast("long").alias(KEY), "ts", "glucose", "source_file"), "glucose")


def q_parquet_table(spark, sf_dir):
    path = f"{folder(spark, 'table')}.parquet"
    Fi.write_table(A.bolus(spark, sf_dir), path, partition_by=["source_file"])
    return rounded(Fi.read_table(spark, path).select(KEY, "event_id", "ts", "bolus_units", "source_file"), "bolus_units")


def q_standardize_carbs(spark, sf_dir):
    raw = A.event_rows(spark, sf_dir, "error").select(KEY, A.source_file().alias("source_file"), F.col("ts").cast("string").alias("eventDateTime"), F.col("value").cast("string").alias("CarbSize"))
    return rounded(St.standardize_carbs(raw, label="log", bin_seconds=HOUR), "carb_grams")


def q_standardize_activity(spark, sf_dir):
    raw = A.event_rows(spark, sf_dir, "click").select(KEY, A.source_file().alias("source_file"), F.col("ts").cast("string").alias("startDate"), F.col("value").alias("steps"))
    return rounded(St.standardize_activity(raw, bin_seconds=HOUR), "activity_value")


def q_standardize_basal(spark, sf_dir):
    """Rates, a few of them unreadable, then closed by the next start or the end of January."""
    rate = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("value") / 50).cast("string"))
    raw = A.event_rows(spark, sf_dir, "signup").select(KEY, A.source_file().alias("source_file"), F.col("ts").cast("string").alias("startDate"), rate.alias("BasalRate"))
    out = St.close_basal(St.standardize_basal(raw), F.lit("2024-01-31").cast("date"), order=["basal_units_per_hour"])
    return rounded(out, "basal_units_per_hour")


def _window_payloads(spark, sf_dir):
    """Payload texts of ten-day windows per subject and family."""
    time = F.col("ts").cast("string")
    families = {
        "cgm": ("view", {"eventDateTime": time, "egv_estimatedGlucoseValue": F.col("value")}),
        "bolus": ("purchase", {"completionDateTime": time, "actualTotalBolusRequested": F.col("value"), "carbSize": F.when(F.col("event_id") % 2 == 0, F.col("value"))}),
        "carbs": ("error", {"eventDateTime": time, "carbSize": F.col("value")}),
        "basal": ("signup", {"startDateTime": time, "basalRate": F.col("value")}),
        "activity": ("click", {"startDateTime": time, "steps": F.col("value")}),
    }
    start = F.lit("2024-01-01").cast("date")
    first = F.date_add(start, F.floor(F.datediff(F.col("ts").cast("date"), start) / 10).cast("int") * 10)
    out = None
    for family, (kind, fields) in families.items():
        record = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
        rows = A.event_rows(spark, sf_dir, kind).withColumns({"window_id": first.cast("string"), "window_end": F.date_add(first, 9), "_r": record})
        text = F.concat(F.lit('{"records": ['), F.array_join(F.array_sort(F.collect_list("_r")), ","), F.lit("]}"))
        part = rows.groupBy(KEY, "window_id", "window_end").agg(text.alias("value")).withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part)
    return out


def q_window_payloads(spark, sf_dir):
    """Whole windows of all families: rows of each kind, carbs merged, hour bins."""
    return Pl.normalize_windows(_window_payloads(spark, sf_dir), bin_seconds=HOUR)[1]


_WINDOW = "cast(date '2024-01-01' + cast(floor(date_diff('day', date '2024-01-01', cast(ts as date)) / 10) * 10 as integer) as varchar)"
_SUBJECT = f"select user_id as subject_id, left({_WINDOW}, 10) as window_id"


def _window_count(kind: str, name: str, what: str = "distinct date_trunc('hour', ts)") -> str:
    return f"{_SUBJECT}, '{name}' as kind, count({what}) as n from events where event_type = '{kind}' group by 1, 2"


SQL_WINDOWS = (
    f"with carb as (select distinct subject_id, window_id, h, v from ({_SUBJECT}, date_trunc('hour', ts) as h, sum(value) as v from events where event_type = 'error' group by 1, 2, 3 union all "
    f"{_SUBJECT}, date_trunc('hour', ts), sum(value) filter (event_id % 2 = 0) from events where event_type = 'purchase' group by 1, 2, 3) where v is not null), "
    f"n as ({_window_count('view', 'cgm')} union all {_window_count('purchase', 'bolus')} union all {_window_count('signup', 'basal', '*')} union all {_window_count('click', 'activity')} "
    "union all select subject_id, window_id, 'carbs', count(*) from carb group by 1, 2) "
    "select subject_id, window_id, " + ", ".join(f"cast(coalesce(max(n) filter (kind = '{k}'), 0) as bigint) as {k}_rows" for k in ("cgm", "bolus", "carbs", "basal", "activity")) + " from n group by 1, 2"
)


def q_window_ingest(spark, sf_dir):
    """Payloads that arrive in three deliveries, the last one everything again: values of the complete windows, each once."""
    root = folder(spark, "ingest")
    payloads = cut_lineage(_window_payloads(spark, sf_dir))
    early = F.col("family").isin("cgm", "bolus") | (F.col("window_id") == "2024-01-01")
    for part in (early, ~early, F.lit(True)):
        payloads.filter(part).write.mode("append").parquet(f"{root}/archive")
        stream = Sm.file_stream(spark, f"{root}/archive", payloads.schema)
        run = stream.writeStream.foreachBatch(Sm.ingest_windows(f"{root}/table", bin_seconds=HOUR)).option("checkpointLocation", f"{root}/check")
        run.trigger(availableNow=True).start().awaitTermination()
    out = None
    for kind, value in (("cgm", "glucose"), ("bolus", "bolus_units"), ("carbs", "carb_grams"), ("activity", "activity_value"), ("basal", "basal_units_per_hour")):
        time = F.date_trunc("hour", "start_ts").cast("timestamp_ntz") if kind == "basal" else F.col("ts")
        part = Sm.ingested(spark, f"{root}/table", kind).select(KEY, "window_id", F.lit(kind).alias("kind"), time.alias("ts"), F.col(value).alias("value"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "value")


_VALUES = f"{_SUBJECT}, '{{1}}' as kind, date_trunc('hour', ts) as ts, {{2}} as value from events where event_type = '{{0}}' group by 1, 2, 3, 4"
SQL_INGEST = (
    f"with each as ({_VALUES.format('view', 'cgm', 'arg_min(value, ts)')} union all {_VALUES.format('purchase', 'bolus', 'sum(value)')} union all {_VALUES.format('click', 'activity', 'sum(value)')} "
    f"union all select distinct subject_id, window_id, 'carbs', ts, value from ({_VALUES.format('error', 'carbs', 'sum(value)')} union all {_VALUES.format('purchase', 'carbs', 'sum(value) filter (event_id % 2 = 0)')}) where value is not null "
    f"union all {_SUBJECT}, 'basal', date_trunc('hour', ts), value from events where event_type = 'signup'), "
    f"whole as ({_SUBJECT} from events group by 1, 2 having count(distinct event_type) = 5) "
    f"select subject_id, window_id, kind, ts, {rs('value')} as value from each join whole using (subject_id, window_id)"
)


def q_window_tables(spark, sf_dir):
    """Tables by window, one window written again; the manifest leads back to all rows."""
    root = folder(spark, "windows")
    day = F.date_format("ts", "yyyy-MM-dd")
    glucose = A.cgm(spark, sf_dir).select(F.col(KEY).cast("string").alias(KEY), "ts", "glucose", F.lit(None).cast("string").alias("glucose_source"), "source_file", day.alias("window_id"))
    Fi.write_windows({"cgm": glucose}, root)
    Fi.write_windows({"cgm": glucose.filter(F.col("window_id") == "2024-01-05").withColumn("glucose", F.col("glucose") + 1)}, root)
    manifest = Fi.window_manifest({"cgm": glucose}, root)
    out = Fi.load_manifest(spark, manifest.select("normalized_paths"), fmt="parquet")["cgm"]
    return rounded(out.select(F.col(KEY).cast("long").alias(KEY), "ts", "glucose"), "glucose")


def q_prepared_reload(spark, sf_dir):
    """The stored prepared table: its feature groups, and how many of its values are set."""
    data, path = prepared(spark, sf_dir), folder(spark, "prepared")
    Fi.write_results({"prepared": data.frame}, path)
    frame, pump, health = Fi.reload_prepared(spark, f"{path}/prepared")
    return frame.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.count("hrv_latest").alias("hrv_rows"), F.lit(int("iob_units" in pump)).alias("has_pump"), F.lit(int("hrv_latest" in health)).alias("has_health"),
    )


def q_run_summary(spark, sf_dir):
    rows = A.cgm(spark, sf_dir).groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"))
    doses = A.bolus(spark, sf_dir).groupBy(KEY).agg(F.count(F.lit(1)).alias("doses"))
    return Fi.run_summary({"sensor": rows, "pump": doses})


_FILE = "'export_' || (event_id % 3)"
_DAY_5 = "glucose + case when cast(ts as date) = date '2024-01-05' then 1 else 0 end"
QUERIES = {
    "export_tree": (q_export_tree, f"select event_id, event_type, {rs('value')} as value from events where event_type in ('view', 'error')"),
    "canonical_manifest": (q_canonical, with_("cgm", f"select subject_id, ts, {rs('glucose')} as glucose, {_FILE} as source_file from cgm where event_id % 5 <> 0")),
    "parquet_table": (q_parquet_table, with_("bolus", f"select subject_id, event_id, ts, {rs('bolus_units')} as bolus_units, {_FILE} as source_file from bolus")),
    "standardize_carbs": (
        q_standardize_carbs,
        f"select user_id as subject_id, {_FILE} as source_file, date_trunc('hour', ts) as ts, {rs('sum(value)')} as carb_grams, 'log' as source_label from events where event_type = 'error' group by 1, 2, 3",
    ),
    "standardize_activity": (
        q_standardize_activity,
        f"select user_id as subject_id, {_FILE} as source_file, date_trunc('hour', ts) as ts, {rs('sum(value)')} as activity_value from events where event_type = 'click' group by 1, 2, 3",
    ),
    "standardize_basal": (
        q_standardize_basal,
        f"select user_id as subject_id, {_FILE} as source_file, ts as start_ts, coalesce(lead(ts) over (partition by user_id order by ts, value), timestamp '2024-02-01') as end_ts, {rs('value / 50')} as basal_units_per_hour "
        "from events where event_type = 'signup' and event_id % 7 <> 0",
    ),
    "window_payloads": (q_window_payloads, SQL_WINDOWS),
    "stream_window_ingest": (q_window_ingest, SQL_INGEST),
    "window_tables": (q_window_tables, with_("cgm", f"select subject_id, ts, {rs(_DAY_5)} as glucose from cgm")),
    "prepared_reload": (q_prepared_reload, with_("prep", "select subject_id, count(*) as rows, count(hrv_latest) as hrv_rows, 1 as has_pump, 1 as has_health from prep group by 1")),
    "run_summary": (
        q_run_summary,
        with_(
            "cgm bolus",
            """select subject_id, '{' || array_to_string(list_filter(['"sensor":{"rows":' || s.n || '}', '"pump":{"doses":' || p.n || '}'], lambda x: x is not null), ',') || '}' as summary """
            "from (select subject_id, count(*) as n from cgm group by 1) s full join (select subject_id, count(*) as n from bolus group by 1) p using (subject_id)",
        ),
    ),
}
