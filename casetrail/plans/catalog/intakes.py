"""Intake, event log, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.functions import text
from casetrail.operators import documents
from casetrail.plans.catalog.common import LOG_SQL, rnd, sec, utc, web_sql
from casetrail.sources import adapters as A, files, intake
from casetrail.sources.scratch import scratch_path
from casetrail.streaming import intake as streams


def s(c):
    return F.unix_seconds(c).alias(c)


def _raw(spark, d):
    return A.raw_payloads(utc(spark), d)


def intake_events(spark, d):
    i = intake.intake_events(_raw(spark, d))
    return i.select("event_id", "process_key", "connector_type", "document_external_id", "document_uuid", "event_key", "external_event_key", s("occurred_at"))


def validate_intake(spark, d):
    return intake.validate_intake(_raw(spark, d)).select("event_id", "error", "field")


def _normal(spark, d):
    ok = intake.validate_intake(_raw(spark, d)).filter(F.col("error").isNull()).drop("error", "field")
    return intake.normalize_events(ok)


def normalize_events(spark, d):
    return _normal(spark, d).select(
        "event_id", "external_event_key", "source_system", "process_key", "event_key", "step_key", "event_phase",
        "document_external_id", "document_uuid", "document_version", "actor_ref", s("occurred_at"), "context",
    )


def parse_event_time(spark, d):
    e = A.table(utc(spark), d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    summer = F.timestamp_add("MONTH", F.lit(6), F.col("at"))
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return e.select(
        "event_id",
        *[
            F.unix_seconds(text.parse_event_time(x)).alias(n)
            for n, x in {
                "zulu": F.concat(F.date_format("at", iso), F.lit("Z")),
                "naive": F.concat(F.lit(" "), F.date_format("at", iso)),
                "naive_summer": F.date_format(summer, iso),
                "lost_plus": F.concat(F.date_format("at", iso), F.lit(" 02:00")),
                "short_offset": F.concat(F.date_format("at", iso), F.lit("-0330")),
                "broken": F.concat(F.date_format("at", iso), F.lit("?")),
            }.items()
        ],
    )


def event_key(spark, d):
    """Keys of events that carry none of their own."""
    log = A.web_log(utc(spark), d).withColumn("occurred_at", F.date_trunc("second", F.col("occurred_at")))
    return log.select(F.col("event_id"), intake.event_key(F.lit(None).cast("string")).alias("key"))


def derive_process_key(spark, d):
    return intake.normalize_events(_raw(spark, d)).groupBy("process_key").agg(F.count(F.lit(1)).alias("events"))


def _repeated(spark, d):
    log = A.web_log(utc(spark), d)
    again = log.filter("event_id % 20 = 0").withColumn("received_at", F.timestamp_add("HOUR", F.lit(1), F.col("received_at")))
    return log.unionByName(again)


def dedup_events(spark, d):
    return intake.dedup_events(_repeated(spark, d)).select("external_event_key", "step_key", s("received_at"), "arrivals")


def flag_duplicates(spark, d):
    return intake.flag_duplicates(_repeated(spark, d)).groupBy("step_key", "duplicate").agg(F.count(F.lit(1)).alias("n"))


def load_summary(spark, d):
    return intake.load_summary(_repeated(spark, d))


def _counts(events):
    return events.groupBy("process_key", "step_key").agg(F.count(F.lit(1)).alias("n"))


def read_event_files(spark, d):
    # Each file an array of at most 1000 events; broken payloads break files of their own.
    part = F.concat_ws("-", F.floor(F.col("event_id") / 1000), F.col("payload").endswith("}") | F.col("payload").endswith("]"))
    path = scratch_path(spark, "arrays")
    arrays = _raw(spark, d).groupBy(part.alias("part")).agg(F.concat_ws(",", F.collect_list("payload")).alias("body"))
    arrays.select(F.concat(F.lit("["), "body", F.lit("]")).alias("value"), "part").write.partitionBy("part").text(path)
    back = files.read_event_files(spark, f"{path}/*/*").withColumns({"received_at": F.lit(None).cast("timestamp"), "event_id": F.lit(None).cast("long")})
    return intake.normalize_events(back).groupBy("error", "step_key", "event_phase").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_uuid").alias("cases"))


def read_event_log_jsonl(spark, d):
    path = scratch_path(spark, "lines")
    _raw(spark, d).select(F.concat("payload", F.lit("\n")).alias("value")).write.text(path)
    back = files.read_event_log_jsonl(spark, path)
    return intake.validate_intake(back).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def append_event_log(spark, d):
    path = scratch_path(spark, "log")
    files.append_event_log(A.web_log(utc(spark), d, split_process=True), path)
    files.append_event_log(A.order_log(spark, d), path)
    return _counts(files.read_event_log(spark, path))


def delete_process_data(spark, d):
    path = scratch_path(spark, "kept")
    files.append_event_log(A.web_log(utc(spark), d, split_process=True), path)
    removed = files.remove_from_log(spark, path, "billing", "user-8")
    left = files.read_event_log(spark, path)
    return left.groupBy("process_key").agg(F.count(F.lit(1)).alias("events")).withColumn("removed", F.lit(removed).cast("long"))


def _export_rows(spark, d):
    o = A.table(utc(spark), d, "orders")
    rows = o.select(
        "o_orderkey",
        text.fmt_number(F.col("o_orderkey") * 12345, 2).alias("number"),
        text.clean_export_text(F.concat("o_orderpriority", F.lit("|"), "o_orderstatus"), 12).alias("label"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    return documents.split_by_period(rows, text.fmt_date(F.col("at"), "yyyy-MM")).drop("at")


def export_delimited(spark, d):
    path = scratch_path(spark, "export")
    files.export_delimited(_export_rows(spark, d), path, encoding="ansi")
    back = spark.read.option("header", True).option("sep", ";").option("encoding", "windows-1252").csv(path)
    return back.groupBy(F.col("period").cast("string").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.max("number").alias("top_number"), F.min("label").alias("low_label")
    )


# ------------------------------------------------------------------ streams


def _payload_folder(spark, d):
    path = scratch_path(spark, "payloads")
    raw = _raw(spark, d).select("payload", "received_at", "event_id")
    raw.unionByName(raw.filter("event_id % 20 = 0")).repartition(4).write.parquet(path)
    return path


def stream_intake(spark, d):
    out, mark = scratch_path(spark, "stream-log"), scratch_path(spark, "stream-mark")
    q = streams.stream_intake(streams.payload_stream(spark, _payload_folder(spark, d)), out, mark)
    q.awaitTermination()
    return _counts(spark.read.parquet(out))


def dead_letters(spark, d):
    out, mark = scratch_path(spark, "rejected"), scratch_path(spark, "rejected-mark")
    streams.stream_dead_letters(streams.payload_stream(spark, _payload_folder(spark, d)), out, mark).awaitTermination()
    _, after = streams.replay_dead_letters(spark.read.parquet(out).drop("batch"), 2)
    return after.groupBy("error", "attempts", "status").agg(F.count(F.lit(1)).alias("n"))


def stream_instances(spark, d):
    log, out, mark = (scratch_path(spark, n) for n in ("inst-log", "inst", "inst-mark"))
    events = A.web_log(utc(spark), d, split_process=True)
    events.repartition(4).write.parquet(log)
    streams.stream_instances(log, events.schema, out, mark, spark).awaitTermination()
    now = streams.current_instances(spark, out)
    return now.select("process_key", "document_uuid", "document_version", "current_step_key", s("started_at"), s("last_event_at"), "event_count")


def incremental_batches(spark, d):
    """Two runs over a growing folder: the second reads only what is new."""
    src, out, mark = (scratch_path(spark, n) for n in ("inc-src", "inc-out", "inc-mark"))
    log = A.web_log(utc(spark), d)
    early = F.col("occurred_at") < F.lit("2024-01-15").cast("timestamp")
    log.filter(early).write.mode("append").parquet(src)
    streams.incremental_batches(spark, src, log.schema, out, mark).awaitTermination()
    log.filter(~early).write.mode("append").parquet(src)
    streams.incremental_batches(spark, src, log.schema, out, mark).awaitTermination()
    return _counts(spark.read.parquet(out))


QUERIES = {
    f.__name__: f
    for f in (
        intake_events, validate_intake, normalize_events, parse_event_time, event_key, derive_process_key, dedup_events,
        flag_duplicates, load_summary, read_event_files, read_event_log_jsonl, append_event_log, delete_process_data,
        export_delimited, stream_intake, dead_letters, stream_instances, incremental_batches,
    )
}

ERR = "CASE WHEN event_id % 17 = 0 THEN 'invalid_json' WHEN event_id % 19 = 0 THEN 'invalid_payload' WHEN event_id % 13 = 0 OR event_id % 23 = 0 THEN 'unknown_process_key' END"
EVS = f"evs AS (SELECT *, {ERR} AS error, 1 + (day(ts) - 1) // 7 AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
GOOD = "event_id % 17 <> 0 AND event_id % 19 <> 0"


def hash_sql(ts: str = "ts") -> str:
    return (
        "sha256('{\"documentUuid\":\"user-' || user_id || '\",\"documentVersion\":' || v || ',\"processKey\":\"web\",\"eventKey\":\"' || event_type"
        " || '\",\"stepKey\":\"' || event_type || '\",\"occurredAt\":\"' || strftime(" + ts + ", '%Y-%m-%dT%H:%M:%S') || 'Z\"}')"
    )


STEP_COUNTS = "SELECT process_key, step_key, count(*) AS n FROM {src} GROUP BY ALL"
ORACLES = {
    "intake_events": f"""WITH {EVS} SELECT event_id, CASE WHEN NOT ({GOOD}) OR event_id % 13 = 0 THEN 'unknown' WHEN event_id % 23 = 0 THEN 'Unknown' ELSE 'web' END AS process_key,
  CASE WHEN {GOOD} THEN 'shop' ELSE 'unknown' END AS connector_type, CASE WHEN {GOOD} AND event_id % 4 <> 0 THEN 'ext-' || user_id END AS document_external_id,
  CASE WHEN {GOOD} AND event_id % 4 <> 0 THEN 'user-' || user_id END AS document_uuid, CASE WHEN {GOOD} AND event_id % 4 >= 2 THEN event_type END AS event_key,
  CASE WHEN {GOOD} AND event_id % 4 <> 2 THEN 'evt-' || event_id END AS external_event_key, CASE WHEN {GOOD} THEN {sec('ts')} END AS occurred_at FROM evs""",
    "validate_intake": f"WITH {EVS} SELECT event_id, error, CASE WHEN error = 'unknown_process_key' THEN 'processKey' END AS field FROM evs",
    "normalize_events": f"""WITH {EVS} SELECT event_id, CASE WHEN event_id % 4 = 2 THEN {hash_sql()} ELSE 'evt-' || event_id END AS external_event_key, 'shop' AS source_system,
  CASE WHEN event_id % 2 = 0 THEN 'web' ELSE ' web ' END AS process_key, event_type AS event_key, event_type AS step_key, CASE WHEN event_id % 4 = 3 THEN 'before' ELSE 'after' END AS event_phase,
  'ext-' || user_id AS document_external_id, 'user-' || user_id AS document_uuid, CAST(v AS INTEGER) AS document_version, CASE WHEN event_id % 4 = 2 THEN 'u' || user_id END AS actor_ref, {sec('ts')} AS occurred_at,
  CASE WHEN event_id % 4 < 2 THEN '{{"k":' || k || '}}' ELSE '{{}}' END AS context FROM evs WHERE error IS NULL""",
    "parse_event_time": f"SELECT event_id, {sec('ts')} AS zulu, {sec('ts')} - 3600 AS naive, {sec('ts + INTERVAL 6 MONTH')} - 7200 AS naive_summer, {sec('ts')} - 7200 AS lost_plus, {sec('ts')} + 12600 AS short_offset, CAST(NULL AS BIGINT) AS broken FROM events",
    "event_key": f"WITH {EVS} SELECT event_id, {hash_sql()} AS key FROM evs",
    "derive_process_key": f"""WITH {EVS} SELECT CASE WHEN NOT ({GOOD}) THEN 'unknown::v1' WHEN event_id % 13 = 0 THEN 'shop:user-' || user_id || ':v' || v WHEN event_id % 23 = 0 THEN 'Unknown'
  WHEN event_id % 2 = 0 THEN 'web' ELSE ' web ' END AS process_key, count(*) AS events FROM evs GROUP BY ALL""",
    "dedup_events": f"WITH {web_sql()} SELECT external_event_key, step_key, {sec('received_at')} AS received_at, CASE WHEN event_id % 20 = 0 THEN 2 ELSE 1 END AS arrivals FROM web",
    "flag_duplicates": f"WITH {web_sql()} SELECT step_key, FALSE AS duplicate, count(*) AS n FROM web GROUP BY step_key UNION ALL SELECT step_key, TRUE, count(*) FROM web WHERE event_id % 20 = 0 GROUP BY step_key",
    "load_summary": f"WITH {web_sql()} SELECT count(*) AS imported, count(*) FILTER (WHERE event_id % 20 = 0) AS duplicates, count(DISTINCT (document_uuid, document_version)) AS instances FROM web",
    "read_event_files": f"""WITH {EVS}, a AS (SELECT *, event_id % 19 = 0 AS no_object FROM evs WHERE event_id % 17 <> 0)
SELECT CAST(NULL AS VARCHAR) AS error, CASE WHEN no_object THEN 'unknown' ELSE event_type END AS step_key, CASE WHEN NOT no_object AND event_id % 4 = 3 THEN 'before' ELSE 'after' END AS event_phase,
  count(*) AS n, count(DISTINCT CASE WHEN NOT no_object THEN user_id END) AS cases FROM a GROUP BY ALL
UNION ALL SELECT 'invalid_json', 'unknown', 'after', count(DISTINCT event_id // 1000), 0 FROM evs WHERE event_id % 17 = 0""",
    "read_event_log_jsonl": f"WITH {EVS} SELECT error, count(*) AS n FROM evs GROUP BY ALL",
    "append_event_log": f"WITH {LOG_SQL}, {web_sql('sw', split=True)}, a AS (SELECT process_key, step_key FROM sw UNION ALL SELECT process_key, step_key FROM ord) {STEP_COUNTS.format(src='a')}",
    "delete_process_data": f"WITH {web_sql(split=True)} SELECT process_key, count(*) AS events, (SELECT count(*) FROM web WHERE process_key = 'billing' AND document_uuid = 'user-8') AS removed FROM web WHERE NOT (process_key = 'billing' AND document_uuid = 'user-8') GROUP BY ALL",
    "export_delimited": "SELECT strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m') AS period, count(*) AS n, max(CAST((o_orderkey * 12345 + 50) // 100 // 100 AS VARCHAR) || ',' || lpad(CAST((o_orderkey * 12345 + 50) // 100 % 100 AS VARCHAR), 2, '0')) AS top_number, min(substr(o_orderpriority || ' / ' || o_orderstatus, 1, 12)) AS low_label FROM orders GROUP BY ALL",
    "stream_intake": f"WITH {EVS} SELECT CASE WHEN event_id % 2 = 0 THEN 'web' ELSE ' web ' END AS process_key, event_type AS step_key, count(*) AS n FROM evs WHERE error IS NULL GROUP BY ALL",
    "dead_letters": f"WITH {EVS} SELECT error, 2 AS attempts, 'dead' AS status, count(*) + count(*) FILTER (WHERE event_id % 20 = 0) AS n FROM evs WHERE error IS NOT NULL GROUP BY ALL",
    "stream_instances": f"""WITH {web_sql(split=True)} SELECT process_key, document_uuid, document_version, coalesce(arg_max(step_key, (received_at, event_id)) FILTER (WHERE event_phase = 'after'), 'unknown') AS current_step_key,
  {sec('arg_min(occurred_at, (received_at, event_id))')} AS started_at, {sec('arg_max(occurred_at, (received_at, event_id))')} AS last_event_at, count(*) AS event_count FROM web GROUP BY process_key, document_uuid, document_version""",
    "incremental_batches": f"WITH {web_sql()} {STEP_COUNTS.format(src='web')}",
}
