"""Source, scalar and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsegrid.functions import scalars as Fn
from pulsegrid.functions.times import HOUR, floor_ts, iso_text, parse_local, parse_wall, round_ts
from pulsegrid.operators import standardize as St
from pulsegrid.queries.sqlparts import K, minutes, r, rounded, rs, with_
from pulsegrid.session import shared_folder
from pulsegrid.sources import adapters as A
from pulsegrid.sources import payloads as Pl
from pulsegrid.streaming import snapshots as Sn
from pulsegrid.streaming import streams as Sm

KEY = "subject_id"


def q_payload_flatten(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").select("event_id", "props")
    return Pl.key_values(rows, "props")


def q_payload_records(spark, sf_dir):
    """Events packed as payload objects, unpacked to records and standardised."""
    rows = A.event_rows(spark, sf_dir, "view").select(
        KEY, F.lit("w").alias("window_id"),
        F.to_json(F.struct(F.array(F.struct(F.col("ts").cast("string").alias("eventDateTime"), (F.col("value") + 60).alias("egv_estimatedGlucoseValue"))).alias("data"))).alias("text"),
    )
    out = Pl.normalize_records(Pl.payload_records(rows, "text"), "cgm", bin_seconds=HOUR)
    return rounded(out.select(KEY, "ts", "glucose"), "glucose")


SQL_PAYLOAD = with_("cgm", f"select subject_id, date_trunc('hour', ts) as ts, {rs('arg_min(glucose, (ts, glucose))')} as glucose from cgm group by 1, 2")


def q_device_events(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").select(
        F.col("user_id").alias(KEY), "event_id", F.col("ts").cast("string").alias("event_time"),
        F.when(F.col("event_type") == "view", "LID_CGM_DATA").when(F.col("event_type") == "signup", "LID_BASAL_DELIVERY").when(F.col("event_type") == "purchase", "LID_BOLUS_DELIVERY").otherwise("LID_OTHER").alias("name"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("current_glucose"), F.col("value").alias("egv"), (F.col("value") * 1000).alias("commanded_rate"), (F.col("value") * 1000).alias("delivered_total"),
    )
    kinds = Pl.route_device_events(rows)
    parts = [
        kinds["cgm"].select(KEY, "event_id", "ts", F.col("glucose").alias("value"), F.lit("cgm").alias("kind")),
        kinds["basal"].select(KEY, "event_id", F.col("end_ts").alias("ts"), F.col("basal_units_per_hour").alias("value"), F.lit("basal").alias("kind")),
        kinds["bolus"].select(KEY, "event_id", "ts", F.col("bolus_units").alias("value"), F.lit("bolus").alias("kind")),
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "value")


SQL_DEVICE = (
    f"select user_id as subject_id, event_id, case event_type when 'signup' then ts + interval 5 minute else ts end as ts, {rs('value')} as value, case event_type when 'view' then 'cgm' when 'signup' then 'basal' else 'bolus' end as kind "
    "from events where event_type in ('view', 'signup', 'purchase')"
)


def q_standardize_cgm(spark, sf_dir):
    """Sensor and fingerstick columns: sensor first, one row per bin and file."""
    raw = A.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"), A.source_file().alias("source_file"), F.col("ts").cast("string").alias("EventDateTime"),
        F.when(F.col("event_type") == "view", F.col("value").cast("string")).alias("egv_estimatedGlucoseValue"),
        F.when(F.col("event_type") != "click", F.col("value").cast("string")).alias("BG"),
    )
    return rounded(St.standardize_cgm(raw, bin_seconds=HOUR), "glucose")


SQL_STD_CGM = (
    f"select subject_id, source_file, ts, {rs('arg_min(value, (p, t, value))')} as glucose, arg_min(src, (p, t, value)) as glucose_source from (select user_id as subject_id, 'export_' || (event_id % 3) as source_file, date_trunc('hour', ts) as ts, ts as t, value, "
    "case when event_type = 'view' then 0 else 1 end as p, case when event_type = 'view' then 'egv_estimatedGlucoseValue' else 'bg' end as src from events where event_type <> 'click') group by 1, 2, 3"
)


def q_standardize_bolus(spark, sf_dir):
    raw = A.event_rows(spark, sf_dir, "purchase").select(
        KEY, A.source_file().alias("source_file"), F.col("ts").cast("string").alias("CompletionDateTime"), F.col("value").alias("ActualTotalBolusRequested"), (F.col("value") * 2).alias("CarbSize"))
    return rounded(St.standardize_bolus(raw, bin_seconds=HOUR), "bolus_units", "carb_grams")


def q_time_rounding(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", floor_ts("ts", 300).alias("floor_5m"), round_ts("ts", 300).alias("round_5m"), iso_text("ts").alias("iso"))


def q_time_parsing(spark, sf_dir):
    """Offset-bearing and plain times: converted by the pump rule, kept by the wearable rule."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    mixed = F.when(F.col("event_id") % 2 == 0, F.concat(text, F.lit(" -0400"))).otherwise(text)
    return A.table(spark, sf_dir, "events").select("event_id", parse_local(mixed, "America/New_York").alias("pump"), parse_local(F.concat(text, F.lit("Z")), "UTC").alias("utc"), parse_wall(mixed).alias("wall"))


SQL_PARSING = (
    "select event_id, case when event_id % 2 = 0 then date_trunc('second', ts) - interval 1 hour else date_trunc('second', ts) end as pump, date_trunc('second', ts) as utc, date_trunc('second', ts) as wall from events"
)


def q_redact(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat("role", F.lit("@example.org"))).otherwise(F.col("role")).alias("contact"),
        F.col("text").alias("body"), F.length("text").cast("bigint").alias("glucose_count"), F.col("role").alias("auth_name"),
    )
    return Fn.redact_columns(rows)


SQL_REDACT = (
    "select conv_id, turn, case when turn % 3 = 0 then '[REDACTED]' else role end as contact, '[REDACTED]' as body, cast(length(text) as bigint) as glucose_count, '[REDACTED]' as auth_name from conversations"
)


def q_redact_documents(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", F.col("source").alias("email"), F.col("text").alias("payload")).alias("meta"), "n_chars")
    return Pl.flatten(Fn.redact_columns(rows), "meta")


def q_text_fields(spark, sf_dir):
    """Ratio text, note parts and safe casts."""
    note = F.concat(F.lit("1:"), F.col("o_orderkey").cast("string"), F.lit(" - 1:"), (F.col("o_orderkey") % 20 + 1).cast("string"), F.lit(" - x"))
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), "o_orderpriority", "o_orderstatus")
    parts = Fn.note_parts(F.col("note"), ["factor", "ratio", "target"])
    return rows.select("o_orderkey", parts["factor"].alias("factor"), Fn.ratio_value(parts["ratio"]).alias("ratio"), Fn.safe_double(parts["target"]).alias("target"),
                       Fn.safe_double(F.substring("o_orderpriority", 1, 1)).alias("level"), Fn.safe_flag(F.col("o_orderstatus")).cast("int").alias("flag"))


SQL_TEXT = (
    "select o_orderkey, '1:' || o_orderkey as factor, (o_orderkey % 20 + 1) * 1.0::double as ratio, cast(null as double) as target, cast(substr(o_orderpriority, 1, 1) as double) as level, "
    "case when lower(o_orderstatus) in ('1', 'true', 't', 'yes', 'y') then 1 else 0 end as flag from orders"
)


def q_content_changes(spark, sf_dir):
    """Copies found by content hash: groups of documents with equal text."""
    rows = A.table(spark, sf_dir, "documents").select("doc_id", Fn.content_hash("text", "lang").alias("sha"))
    return rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).drop("sha")


def q_sections(spark, sf_dir):
    """Lines of every document under the marker line that opened their section."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    out = Pl.section_lines(docs, {"license": "icense", "the": "the "}, keys=["doc_id"])
    return out.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.count_distinct("header").alias("headers"))


SQL_SECTIONS = (
    "with l as (select doc_id, unnest(string_split(text, chr(10))) as v, generate_subscripts(string_split(text, chr(10)), 1) as n from documents), "
    "m as (select *, case when contains(v, 'icense') then 'license' when contains(v, 'the ') then 'the' end as s, trim(v) = '' as blank from l), "
    "c as (select *, last_value(case when s is not null or blank then {'s': case when not blank then s end, 'h': v, 'n': n} end ignore nulls) over (partition by doc_id order by n rows between unbounded preceding and current row) as k from m) "
    "select doc_id, k.s as section, count(*) as lines, count(distinct k.h) as headers from c where k.s is not null and k.n <> n group by 1, 2"
)

# --------------------------------------------------------------------- streaming


def event_stream(spark, sf_dir, kind):
    schema = A.table(spark, sf_dir, "events").schema
    rows = Sm.file_stream(spark, sf_dir, schema, glob="events.parquet")
    return rows.filter(F.col("event_type") == kind).withColumnRenamed("user_id", KEY)


def arrivals(spark, sf_dir, kind):
    """The events of a kind three times as a stream, each time after ten more days of arrivals; an event arrives up to two days after its time."""
    source = f"{shared_folder(spark)}/in-{uuid.uuid4().hex}"
    events = A.table(spark, sf_dir, "events")
    late = F.datediff(F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 3).cast("int")), F.lit("2024-01-01").cast("date"))
    rows = events.filter(F.col("event_type") == kind).withColumnRenamed("user_id", KEY)
    delivery = F.least(F.floor(late / 10), F.lit(2))
    for number in range(3):
        rows.filter(delivery == number).write.mode("append").parquet(source)
        yield Sm.file_stream(spark, source, rows.schema)


def finished(spark, stream):
    path = f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"
    Sm.run_to_end(stream, path)
    return spark.read.schema(stream.schema).parquet(path)


def q_stream_tumbling(spark, sf_dir):
    out = finished(spark, Sm.tumbling(event_stream(spark, sf_dir, "view"), {"rows": F.count(F.lit(1)), "mean_value": F.avg("value")}, step="1 hour"))
    return rounded(out, "mean_value")


_LIMIT = "(select max(ts) - interval 10 minute from events where event_type = '{0}')"
SQL_TUMBLING = (
    f"select user_id as subject_id, date_trunc('hour', ts) as start_ts, date_trunc('hour', ts) + interval 1 hour as end_ts, count(*) as rows, {rs('avg(value)')} as mean_value from events where event_type = 'view' group by 1, 2, 3 having end_ts <= "
    + _LIMIT.format("view")
)


def q_stream_sliding(spark, sf_dir):
    out = finished(spark, Sm.sliding(event_stream(spark, sf_dir, "click"), {"sum_value": F.sum("value")}, width="3 hours", step="1 hour"))
    return rounded(out, "sum_value")


SQL_SLIDING = (
    f"select user_id as subject_id, s as start_ts, s + interval 3 hour as end_ts, {rs('sum(value)')} as sum_value from (select *, date_trunc('hour', ts) - to_hours(k) as s from events, (select unnest([0, 1, 2]) as k) where event_type = 'click') group by 1, 2, 3 having end_ts <= "
    + _LIMIT.format("click")
)


def q_stream_sessions(spark, sf_dir):
    return finished(spark, Sm.sessions(event_stream(spark, sf_dir, "error"), {"events": F.count(F.lit(1))}, gap="90 minutes"))


SQL_STREAM_SESSIONS = with_(
    "carbs",
    f"select subject_id, min(ts) as start_ts, max(ts) + interval 90 minute as end_ts, count(*) as events from (select *, sum(new) over (partition by subject_id order by ts) as s from (select *, case when "
    f"{minutes('ts', 'lag(ts) over (partition by subject_id order by ts)')} <= 90 then 0 else 1 end as new from carbs)) group by subject_id, s having end_ts <= " + _LIMIT.format("error"),
)


def q_stream_dedupe(spark, sf_dir):
    """Copies of an event (same subject and whole value) within the bound: one stays."""
    rows = event_stream(spark, sf_dir, "purchase").withColumn("level", F.floor("value"))
    out = finished(spark, Sm.dedupe(rows, [KEY, "level"], "60 days"))
    return out.groupBy(KEY).agg(F.count("*").alias("rows"))


def q_stream_upsert(spark, sf_dir):
    """Latest value per subject, day and level, kept by a commit per batch of arrivals."""
    path = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    rows = lambda events: events.select(
        KEY, F.col("ts").cast("date").alias("day"), F.floor(F.col("value") / 10).alias("level"), "ts", "event_id", "value"
    )
    merge = Sm.upsert_batch(path, [KEY, "day", "level"], ["ts", "event_id"])
    schema = None
    for events in arrivals(spark, sf_dir, "purchase"):
        schema = rows(events).schema
        query = rows(events).writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}-check").trigger(availableNow=True).start()
        query.awaitTermination()
    return Sn.read_snapshot(spark, path, schema).select(KEY, "day", "level", "event_id", "value")


def q_stream_gaps(spark, sf_dir):
    """Silences over two days, from three deliveries in which samples come up to two days late."""
    path = f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"
    for events in arrivals(spark, sf_dir, "view"):
        out = Sm.gap_alerts(events, 2880.0, delay="3 days")
        Sm.run_to_end(out, path)
    found = spark.read.schema(out.schema).parquet(path)
    return found.select(KEY, "alert", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_ts", "ts")], r("gap_minutes", 2).alias("gap_minutes"))


_PASSED = "(select epoch_us(max(ts)) // 1000 - 3 * 86400000 from cgm)"
SQL_STREAM_GAPS = with_(
    "cgm",
    f"""select subject_id, 'gap' as alert, p as last_ts, ts, {rs(minutes('ts', 'p'), 2)} as gap_minutes from (select *, lag(ts) over (partition by subject_id order by ts) as p from cgm)
    where ts > p + interval 2880 minute and epoch_us(ts) // 1000 < {_PASSED}
    union all select subject_id, 'open', ts, ts + interval 2880 minute, 2880.0 from (select *, lead(ts) over (partition by subject_id order by ts) as q from cgm)
    where (q is null or q > ts + interval 2880 minute) and epoch_us(ts + interval 2880 minute) // 1000 < {_PASSED}""",
)

QUERIES = {
    "payload_flatten": (q_payload_flatten, "select event_id, 'k' as key, json_extract_string(props, '$.k') as value from events"),
    "payload_records": (q_payload_records, SQL_PAYLOAD),
    "device_events": (q_device_events, SQL_DEVICE),
    "standardize_cgm": (q_standardize_cgm, SQL_STD_CGM),
    "standardize_bolus": (
        q_standardize_bolus,
        with_("bolus", f"select subject_id, source_file, date_trunc('hour', ts) as ts, {rs('sum(bolus_units * 10)')} as bolus_units, {rs('sum(bolus_units * 20)')} as carb_grams from bolus group by 1, 2, 3"),
    ),
    "time_rounding": (
        q_time_rounding,
        "select event_id, time_bucket(interval 5 minute, ts) as floor_5m, time_bucket(interval 5 minute, ts + interval 150 second) as round_5m, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events",
    ),
    "time_parsing": (q_time_parsing, SQL_PARSING),
    "redact_columns": (q_redact, SQL_REDACT),
    "redact_documents": (q_redact_documents, "select doc_id, n_chars, lang, '[REDACTED]' as email, '[REDACTED]' as payload from documents"),
    "text_fields": (q_text_fields, SQL_TEXT),
    "content_changes": (q_content_changes, "select count(*) as copies, min(doc_id) as first_doc from documents group by text, lang"),
    "section_lines": (q_sections, SQL_SECTIONS),
    "stream_tumbling": (q_stream_tumbling, SQL_TUMBLING),
    "stream_sliding": (q_stream_sliding, SQL_SLIDING),
    "stream_sessions": (q_stream_sessions, SQL_STREAM_SESSIONS),
    "stream_dedupe": (q_stream_dedupe, "select user_id as subject_id, count(distinct floor(value)) as rows from events where event_type = 'purchase' group by 1"),
    "stream_upsert": (
        q_stream_upsert,
        "select user_id as subject_id, cast(ts as date) as day, cast(floor(value / 10) as bigint) as level, event_id, value from events where event_type = 'purchase' qualify row_number() over (partition by user_id, cast(ts as date), floor(value / 10) order by ts desc, event_id desc) = 1",
    ),
    "stream_gap_alerts": (q_stream_gaps, SQL_STREAM_GAPS),
}
