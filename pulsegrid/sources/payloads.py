"""JSON payloads, device events, nested records and sectioned text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import safe_double
from pulsegrid.functions.times import floor_ts, parse_local, shift
from pulsegrid.operators.audit import merge_by_priority
from pulsegrid.operators.standardize import close_basal
from pulsegrid.operators.timeline import CHUNK

# Keys that may hold the record list, and keys that mark a single record.
LIST_KEYS = ("data", "items", "rows", "results", "records", "events", "measurements", "payload")
RECORD_KEYS = ("timestamp", "datetime", "eventdatetime", "completiondatetime", "startdatetime", "startdate", "start", "enddatetime", "enddate", "end")
# Record keys by kind, in order of preference.
KEYS = {
    "cgm": (("eventDateTime", "dateTime", "timestamp", "datetime", "date time", "time"),
            ("egv_estimatedGlucoseValue", "estimatedGlucoseValue", "sensorGlucose", "glucose", "bg", "value", "reading", "readingValue")),
    "bolus": (("completionDateTime", "dateTime", "timestamp", "datetime"), ("actualTotalBolusRequested", "bolus", "bolus_units", "insulin", "units")),
    "carbs": (("completionDateTime", "eventDateTime", "startDateTime", "dateTime", "timestamp", "time"), ("carbSize", "carbs", "carbohydrates", "guessedCarbohydrate")),
    "basal": (("startDateTime", "startDate", "start", "timestamp", "dateTime"), ("basalRate", "rate", "units_per_hour", "units/hour", "unitsPerHour")),
    "activity": (("startDateTime", "startDate", "start", "timestamp", "dateTime", "eventDateTime"), ("steps", "activity", "value", "count", "activityValue")),
}
END_KEYS = ("endDateTime", "endDate", "end", "stopTime", "stopDateTime")


def payload_records(df: DataFrame, text: str, name: str = "record") -> DataFrame:
    """One row per record of a JSON payload, as ``map<string,string>`` with lower-case keys.

    A payload is a list of records, an object with the list under a known key,
    or a single record; anything else gives no rows.
    """
    whole = F.try_parse_json(F.col(text))
    pick = lambda path: F.filter(
        F.try_variant_get(whole, path, "array<variant>"), lambda v: F.schema_of_variant(v).startswith("OBJECT")
    )
    lists = [F.when(F.size(pick(p)) > 0, pick(p)) for p in ("$", *[f"$.{k}" for k in LIST_KEYS])]
    single = F.array(whole)
    rows = df.withColumn("_v", F.explode(F.coalesce(*lists, single)))
    as_map = F.try_variant_get(F.col("_v"), "$", "map<string,variant>")
    plain = F.transform_keys(
        F.transform_values(as_map, lambda k, v: F.try_variant_get(v, "$", "string")), lambda k, v: F.lower(F.trim(k))
    )
    out = rows.withColumn(name, plain).filter(F.col(name).isNotNull())
    is_list = F.coalesce(*lists).isNotNull()
    marked = F.exists(F.map_keys(name), lambda k: k.isin(*RECORD_KEYS))
    return out.filter(is_list | marked).drop("_v")


def pick_key(record: str, candidates: Sequence[str]) -> Column:
    """Value of the first candidate key: exact first, then as a substring."""
    m, low = F.col(record), [c.strip().lower() for c in candidates]

    def partly(c: str) -> Column:
        hits = F.map_values(F.map_filter(m, lambda k, v: k.contains(c)))
        return F.when(F.size(hits) > 0, F.struct(F.get(hits, 0).alias("v")))

    exact = [F.when(F.map_contains_key(m, c), F.struct(F.try_element_at(m, F.lit(c)).alias("v"))) for c in low]
    return F.coalesce(*exact, *[partly(c) for c in low])["v"]


def normalize_records(records: DataFrame, kind: str, *, zone: str = "UTC", bin_seconds: int = 300, keys: Sequence[str] = ("subject_id", "window_id"), record: str = "record") -> DataFrame:
    """Payload records of one kind as engine rows: glucose first per bin, sums for the rest."""
    times, values = KEYS[kind]
    value, time = safe_double(pick_key(record, values)), parse_local(pick_key(record, times), zone)
    if kind == "basal":
        return records.select(*keys, time.alias("start_ts"), parse_local(pick_key(record, END_KEYS), zone).alias("end_ts"), value.alias("basal_units_per_hour")).filter(
            F.col("basal_units_per_hour").isNotNull()
        )
    name = {"cgm": "glucose", "bolus": "bolus_units", "carbs": "carb_grams", "activity": "activity_value"}[kind]
    extra = [safe_double(pick_key(record, KEYS["carbs"][1])).alias("carb_grams")] if kind == "bolus" else []
    rows = records.select(*keys, time.alias("_t"), value.alias(name), *extra).filter(F.col("_t").isNotNull() & F.col(name).isNotNull())
    binned = rows.groupBy(*keys, floor_ts("_t", bin_seconds).alias("ts"))
    if kind == "cgm":
        return binned.agg(F.min_by(name, F.struct("_t", name)).alias(name))
    return binned.agg(F.sum(name).alias(name), *([F.sum("carb_grams").alias("carb_grams")] if extra else []))


def window_records(payloads: DataFrame) -> DataFrame:
    """The records of archived windows: keys, window_end, family (lower case) and ``record``."""
    known = payloads.select("subject_id", "window_id", "window_end", F.lower("family").alias("family"), "value")
    return payload_records(known.filter(F.col("family").isin(*KEYS)), "value").drop("value")


def normalize_windows(payloads: DataFrame, *, zone: str = "UTC", bin_seconds: int = 300) -> tuple[dict[str, DataFrame], DataFrame]:
    """All kinds of archived windows (:func:`window_kinds`), and one summary row per window.

    ``payloads``: subject_id, window_id, window_end, family, value (JSON text),
    as :func:`read_archived_payloads` gives them.
    """
    keys = ("subject_id", "window_id")
    kinds = window_kinds(window_records(payloads), zone=zone, bin_seconds=bin_seconds)
    counts = None
    for kind, df in kinds.items():
        each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        counts = each if counts is None else counts.unionByName(each)
    total = payloads.select(*keys).distinct().join(counts, list(keys), "left")
    return kinds, total.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{k}_rows") for k in kinds])


def window_kinds(records: DataFrame, *, zone: str = "UTC", bin_seconds: int = 300) -> dict[str, DataFrame]:
    """Rows of each kind from :func:`window_records`.

    Carbs entered with a dose join the direct ones; an open rate ends with the
    next start or the window.
    """
    keys = ("subject_id", "window_id")
    kinds = {}
    for family in KEYS:
        each = records.filter(F.col("family") == family)
        kinds[family] = normalize_records(each, family, zone=zone, bin_seconds=bin_seconds, keys=(*keys, "window_end") if family == "basal" else keys)
    kinds["basal"] = close_basal(kinds["basal"], F.col("window_end"), keys=keys, order=["basal_units_per_hour"]).drop("window_end")
    with_dose = kinds["bolus"].filter(F.col("carb_grams").isNotNull()).select(*keys, "ts", "carb_grams", F.lit("bolus").alias("source_label"))
    direct = kinds["carbs"].withColumn("source_label", F.lit("carbs"))
    kinds["carbs"] = merge_by_priority([(0, direct), (1, with_dose)], [*keys, "ts", "carb_grams"])
    kinds["bolus"] = kinds["bolus"].drop("carb_grams")
    return kinds


def read_archived_payloads(spark: SparkSession, root: str, *, stream: bool = False) -> DataFrame:
    """Archived payload files ``<start>__<end>/raw/<family>.json``: window, family, text; as they arrive with ``stream``."""
    raw = (spark.readStream if stream else spark.read).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    pattern = r"/(\d{4}-\d{2}-\d{2})__(\d{4}-\d{2}-\d{2})/raw/([^/]+)\.json$"
    part = lambda i: F.regexp_extract("_metadata.file_path", pattern, i)
    out = raw.select(part(1).try_cast("date").alias("window_start"), part(2).try_cast("date").alias("window_end"), part(3).alias("family"), "value")
    out = out.filter(F.col("window_start").isNotNull() & ~F.col("family").endswith(".meta"))
    return out.withColumn("window_id", F.concat_ws("__", F.col("window_start").cast("string"), F.col("window_end").cast("string")))


# ----------------------------------------------------------------- device events


def route_device_events(events: DataFrame, *, zone: str = "UTC") -> dict[str, DataFrame]:
    """Decoded device events to kinds by name.

    ``events``: subject_id, name, event_time (text), current_glucose, egv,
    commanded_rate, delivered_total, event_id.  Rates and doses come in
    thousandths; a rate event covers five minutes.
    """
    name, time = F.upper("name"), parse_local("event_time", zone)
    base = ["subject_id", "event_id"]
    cgm = events.filter(name.contains("CGM")).select(*base, time.alias("ts"), F.coalesce(safe_double(F.col("current_glucose")), safe_double(F.col("egv"))).alias("glucose"))
    basal = events.filter(name == "LID_BASAL_DELIVERY").select(
        *base, time.alias("start_ts"), shift(time, 300).alias("end_ts"), (safe_double(F.col("commanded_rate")) / 1000).alias("basal_units_per_hour")
    )
    bolus = events.filter(name == "LID_BOLUS_DELIVERY").select(*base, time.alias("ts"), (safe_double(F.col("delivered_total")) / 1000).alias("bolus_units"))
    return {"cgm": cgm, "basal": basal, "bolus": bolus}


# ------------------------------------------------------------------ nested records


def flatten(df: DataFrame, column: str) -> DataFrame:
    """A struct column's fields as top-level columns."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, f"{column}.*")


def key_values(df: DataFrame, text: str) -> DataFrame:
    """JSON object text to long (key, value) rows."""
    entries = F.explode(F.from_json(text, "map<string,string>")).alias("key", "value")
    return df.select(*[c for c in df.columns if c != text], entries)


# ------------------------------------------------------------------ sectioned text


def section_lines(lines: DataFrame, markers: dict[str, str], *, keys: Sequence[str], line_no: str = "line_no", text: str = "value") -> DataFrame:
    """Label each line with the marker that opened its section.

    ``markers``: section → text its header line contains.  The header's columns
    are kept as ``header``; blank lines end a section.  Positions of headers
    and blanks are carried forward through row chunks.
    """
    name = F.coalesce(*[F.when(F.contains(F.col(text), F.lit(m)), F.lit(s)) for s, m in markers.items()])
    blank = F.trim(text) == ""
    mark = F.when(name.isNotNull() | blank, F.struct(F.when(~blank, name).alias("section"), F.col(text).alias("header"), F.col(line_no).alias("at")))
    rows = lines.withColumn(CHUNK, F.floor(F.col(line_no) / 4096))
    here = Window.partitionBy(*keys, CHUNK).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.groupBy(*keys, CHUNK).agg(F.max_by(mark, F.when(mark.isNotNull(), F.col(line_no))).alias("_m"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, CHUNK, F.last("_m", True).over(before).alias("_m"))
    out = rows.join(carried, [*keys, CHUNK], "left").withColumn("_s", F.coalesce(F.last(mark, True).over(here), F.col("_m")))
    out = out.filter(F.col("_s.section").isNotNull() & (F.col("_s.at") != F.col(line_no)))
    return out.select(*keys, line_no, text, F.col("_s.section").alias("section"), F.col("_s.header").alias("header"))


def read_sectioned(spark: SparkSession, path: str, markers: dict[str, str]) -> DataFrame:
    """Lines of sectioned CSV files with their section.

    Line order comes from the file read whole per file (such exports are small
    single files; many files are read in parallel).
    """
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"), "value")
    lines = whole.select("source_file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return section_lines(lines, markers, keys=["source_file"])


def parse_section(lines: DataFrame, section: str, schema: str) -> DataFrame:
    """CSV lines of one section to columns, by the declared schema (header order)."""
    rows = lines.filter(F.col("section") == section)
    return rows.withColumn("_c", F.from_csv("value", schema)).select("source_file", "line_no", "_c.*")
