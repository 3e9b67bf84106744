"""Timelines, lists, eligibility and heatmaps."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from casetrail.operators import cases, kpi, lists
from casetrail.plans.catalog.common import (
    BASE_SQL,
    CASE_SQL,
    LOG_SQL,
    ORDER_SQL,
    attach_sql,
    rnd,
    sec,
    snaps_sql,
    templates,
    timeline_sql,
    utc,
    web_sql,
    web_template,
)
from casetrail.plans.catalog.checks import FULL
from casetrail.plans.check import check_processes
from casetrail.sources import adapters as A
from casetrail.sources.scratch import held

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
NOW_SEC = int(NOW.timestamp())
SINCE = datetime(2024, 1, 20, tzinfo=timezone.utc)
SINCE_SQL = "TIMESTAMP '2024-01-20 00:00:00'"
UNTIL = datetime(2024, 1, 25, tzinfo=timezone.utc)
ORDERS_SINCE_SQL = "TIMESTAMP '1998-01-01 00:00:00'"


def s(c: str, alias: str | None = None):
    return F.unix_seconds(c).alias(alias or c)


def versions_table(spark):
    rows = [
        (1, "web", "v1", "2024-01-03"),
        (2, "web", "v2", "2024-01-10"),
        (3, "web", "v3", "2024-01-20"),
        (4, "orders", "v1", "1996-06-01"),
        (5, "orders", "v2", "1999-01-01"),
    ]
    return spark.createDataFrame(rows, "version_id int, process_key string, version string, d string").selectExpr(
        "version_id", "process_key", "version", "cast(d AS timestamp) AS valid_from"
    )


VERSIONS_SQL = """versions(version_id, process_key, version, valid_from) AS (VALUES
  (1, 'web', 'v1', TIMESTAMP '2024-01-03'), (2, 'web', 'v2', TIMESTAMP '2024-01-10'), (3, 'web', 'v3', TIMESTAMP '2024-01-20'),
  (4, 'orders', 'v1', TIMESTAMP '1996-06-01'), (5, 'orders', 'v2', TIMESTAMP '1999-01-01'))"""

TPL_STEPS_SQL = "tpl_steps(template_key, step_key) AS (VALUES ('web','signup'), ('web','view'), ('web','click'), ('web','purchase'), ('web','refund'), ('orders','placed'), ('orders','shipped'), ('orders','returned'))"
TPL_EDGES_SQL = "tpl_edges(template_key, from_step, to_step) AS (VALUES ('web','signup','view'), ('web','view','click'), ('web','click','purchase'), ('web','click','view'), ('orders','placed','shipped'), ('orders','shipped','returned'))"


def _order(order):
    def run(spark, d):
        t = cases.order_timeline(A.full_log(utc(spark), d), order)
        return t.select(*cases.CASE, "external_event_key", "pos")

    return run


def _order_sql(cols):
    return f"WITH {LOG_SQL} SELECT {CASE_SQL}, external_event_key, row_number() OVER (PARTITION BY {CASE_SQL} ORDER BY {cols}, coalesce(event_id, 9223372036854775807), external_event_key) AS pos FROM log"


def attach_snapshots(spark, d):
    log = A.full_log(utc(spark), d)
    a = cases.attach_snapshots(log, A.log_snapshots(log))
    return a.select("document_uuid", "external_event_key", "ctx", s("ctx_loaded_at"), "ctx_freshness", "has_snapshot")


def select_case_version(spark, d):
    return cases.select_case_version(A.web_log(utc(spark), d)).select("document_uuid", "document_version", "external_event_key")


def collapse_repeats(spark, d):
    log = A.full_log(utc(spark), d)
    t = cases.case_timeline(cases.attach_snapshots(log, A.log_snapshots(log)), sized_by=log)
    e = cases.collapse_repeats(t, ["k", "flag"])
    return e.select(
        *cases.CASE,
        "entry",
        "step_key",
        "n_events",
        s("occurred_at"),
        F.to_json(F.try_variant_get(F.parse_json("context"), "$.k", "variant")).alias("k"),
        F.to_json(F.try_variant_get(F.parse_json("context"), "$.flag", "variant")).alias("flag"),
        s("sum_loaded_at"),
    )


def filter_phase(spark, d):
    return cases.filter_phase(A.web_log(utc(spark), d)).groupBy("step_key", "event_phase").agg(F.count(F.lit(1)).alias("n"))


def filter_time_window(spark, d):
    w = cases.filter_time_window(A.web_log(utc(spark), d), SINCE, UNTIL)
    return w.select("external_event_key", "step_key")


def build_instances(spark, d):
    i = cases.build_instances(A.full_log(utc(spark), d))
    return i.select(
        "source_system", "case_identity", "document_version", "process_key", "template_version",
        s("started_at"), s("last_event_at"), "current_step_key", "event_count", "status",
    )


def journey_overview(spark, d):
    log = A.web_log(utc(spark), d, split_process=True)
    j = cases.journey_overview(log, cases.build_instances(log))
    return j.select(
        "document_uuid", "process_key", "event_count", "instance_count",
        F.array_join("versions", ",").alias("versions"), s("first_at"), s("last_at"),
    )


def case_list(spark, d):
    c = lists.case_list(A.full_log(utc(spark), d))
    return c.select("process_key", "document_uuid", "document_external_id", "document_version", "event_count", s("last_event_at"))


def case_refs_since(spark, d):
    c = lists.case_refs_since(A.web_log(utc(spark), d), SINCE, limit=100)
    return c.select("process_key", "document_uuid", "document_external_id", "document_version", s("last_event_at"))


def process_overview(spark, d):
    return lists.process_overview(A.full_log(utc(spark), d))


def case_version_overview(spark, d):
    c = lists.case_version_overview(A.full_log(utc(spark), d))
    return c.select("process_key", "document_uuid", "document_version", "event_count", s("first_at"), s("last_at"))


def process_status(spark, d):
    p = lists.process_status(cases.build_instances(A.full_log(utc(spark), d)))
    return p.select("process_key", "current_step_key", "instance_count", "open_count", s("last_event_at"))


def latest_events(spark, d):
    e = lists.latest_events(A.full_log(utc(spark), d), "orders", 10)
    return e.select("external_event_key", "document_uuid", "document_version", "step_key", s("occurred_at"))


def event_list(spark, d):
    e = lists.event_list(A.full_log(utc(spark), d), process_key="web", since=SINCE, limit=200)
    return e.select("external_event_key", "document_uuid", "step_key", s("occurred_at"), s("received_at"))


def event_details(spark, d):
    log = A.web_log(utc(spark), d)
    e = lists.event_details(log, A.log_snapshots(log))
    return e.select("external_event_key", "step_key", s("captured_at"), "snapshot_context", s("snapshot_loaded_at"))


# ------------------------------------------------------------------ key figures


def _kpi_timeline(spark, d):
    return cases.case_timeline(A.full_log(utc(spark), d), include_before=False, merge_versions=True)


def _eligibility(spark, d):
    return kpi.kpi_eligibility(_kpi_timeline(spark, d), versions_table(spark), templates(spark))


def kpi_eligibility(spark, d):
    e = _eligibility(spark, d)
    return e.select(
        "template_key", "document_uuid", "is_eligible", "exclusion_reason", "version",
        s("first_event_at"), s("last_event_at"), "first_step",
    )


def kpi_summary(spark, d):
    return kpi.kpi_summary(_eligibility(spark, d))


def process_version_latest(spark, d):
    used = kpi.process_version_latest(versions_table(spark))
    return (
        A.full_log(utc(spark), d).join(F.broadcast(used), "process_key")
        .groupBy("process_key", "version")
        .agg(F.count_if(F.col("occurred_at") >= F.col("valid_from")).alias("events_since"))
    )


def flow_heatmap(spark, d):
    starts = cases.run_starts(_kpi_timeline(spark, d))
    return kpi.flow_heatmap(starts, templates(spark))


def flow_heatmap_uncollapsed(spark, d):
    return kpi.flow_heatmap(_kpi_timeline(spark, d), templates(spark))


def duration_heatmap(spark, d):
    return kpi.duration_heatmap(cases.run_starts(_kpi_timeline(spark, d)), templates(spark), NOW)


def flow_by_context(spark, d):
    return kpi.flow_by_context(_kpi_timeline(spark, d).withColumn("ctx", F.col("context")))


def heatmap_report(spark, d):
    tl, tpl = _kpi_timeline(spark, d), templates(spark)
    starts = cases.run_starts(cases.with_case_value(tl, F.max("occurred_at"), "last_at"))
    starts = held(starts.select(*cases.CASE, "pos", "entry", "step_key", "occurred_at", "next_step", "next_at", "last_at"))
    el = kpi.kpi_eligibility(starts, versions_table(spark), tpl)
    r = kpi.heatmap_report(starts, el, tpl, NOW)
    flow = r["flow"].select("template_key", F.concat_ws(">", F.lit("flow"), "from_step", "to_step").alias("item"), "observed", F.col("intensity").alias("value"))
    steps = r["durations"].select("template_key", F.concat_ws(">", F.lit("step"), "step_key").alias("item"), F.col("completed").alias("observed"), F.col("avg_minutes").alias("value"))
    docs = r["documents_used"].select("template_key", F.lit("documents_used").alias("item"), F.col("documents_used").alias("observed"), F.lit(0.0).alias("value"))
    return flow.unionByName(steps).unionByName(docs)


def case_filter_by_status(spark, d):
    log = A.web_log(utc(spark), d)
    status = check_processes(log, A.log_snapshots(log), web_template(spark)).status
    kept = kpi.case_filter_by_status(log, status, "deviating")
    return kept.groupBy("step_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_uuid").alias("cases"))


QUERIES = {
    "order_timeline": _order("occurred-then-received"),
    "order_timeline_occurred": _order("occurred-at"),
    "order_timeline_received": _order("received-at"),
    "attach_snapshots": attach_snapshots,
    "select_case_version": select_case_version,
    "collapse_repeats": collapse_repeats,
    "filter_phase": filter_phase,
    "filter_time_window": filter_time_window,
    "build_instances": build_instances,
    "journey_overview": journey_overview,
    "case_list": case_list,
    "case_refs_since": case_refs_since,
    "process_overview": process_overview,
    "case_version_overview": case_version_overview,
    "process_status": process_status,
    "latest_events": latest_events,
    "event_list": event_list,
    "event_details": event_details,
    "kpi_eligibility": kpi_eligibility,
    "kpi_summary": kpi_summary,
    "process_version_latest": process_version_latest,
    "flow_heatmap": flow_heatmap,
    "flow_heatmap_uncollapsed": flow_heatmap_uncollapsed,
    "duration_heatmap": duration_heatmap,
    "flow_by_context": flow_by_context,
    "heatmap_report": heatmap_report,
    "case_filter_by_status": case_filter_by_status,
}

# ------------------------------------------------------------------ SQL

INSTANCES_SQL = f"""inst AS (
  SELECT source_system, 'uuid:' || document_uuid AS case_identity, document_version, process_key, 'draft' AS template_version,
    arg_min(document_uuid, r) AS document_uuid, arg_min(occurred_at, r) AS started_at, arg_max(occurred_at, r) AS last_event_at,
    coalesce(arg_max(step_key, r) FILTER (WHERE event_phase = 'after'), 'unknown') AS current_step_key, count(*) AS event_count, 'running' AS status
  FROM (SELECT *, row_number() OVER (ORDER BY received_at, coalesce(event_id, 9223372036854775807), external_event_key) AS r FROM log) x
  GROUP BY ALL)"""

KTL_SQL = f"""ktl AS (
  SELECT *, row_number() OVER (PARTITION BY process_key, document_uuid ORDER BY occurred_at, received_at, coalesce(event_id, 9223372036854775807), external_event_key) AS pos
  FROM log WHERE event_phase = 'after')"""

KENT_SQL = """kent AS (
  SELECT *, row_number() OVER (PARTITION BY process_key, document_uuid ORDER BY pos) AS entry,
    lead(step_key) OVER (PARTITION BY process_key, document_uuid ORDER BY pos) AS nxt,
    lead(occurred_at) OVER (PARTITION BY process_key, document_uuid ORDER BY pos) AS nxt_at
  FROM (SELECT *, lag(step_key) OVER (PARTITION BY process_key, document_uuid ORDER BY pos) AS prv FROM ktl) q
  WHERE prv IS NULL OR prv <> step_key)"""


def flow_sql(rows: str, name: str = "flow") -> str:
    return f"""{name} AS (
  SELECT f.process_key AS template_key, f.from_step, f.to_step, f.observed, {rnd('f.observed * 100.0 / c.n', 2)} AS percentage,
    {rnd('f.observed * 1.0 / max(f.observed) OVER (PARTITION BY f.process_key)')} AS intensity, e.from_step IS NOT NULL AS is_allowed
  FROM (SELECT process_key, step_key AS from_step, nxt AS to_step, count(*) AS observed FROM {rows} WHERE nxt IS NOT NULL GROUP BY ALL) f
  JOIN (SELECT process_key, count(DISTINCT document_uuid) AS n FROM {rows} GROUP BY ALL) c USING (process_key)
  LEFT JOIN tpl_edges e ON e.template_key = f.process_key AND e.from_step = f.from_step AND e.to_step = f.to_step)"""


def durations_sql(rows: str = "kent", name: str = "dur") -> str:
    gap = f"greatest(0, {sec('nxt_at')} - {sec('occurred_at')})"
    age = f"greatest(0, {NOW_SEC} - {sec('occurred_at')})"
    return f"""{name}_raw AS (
  SELECT process_key AS template_key, step_key, count(nxt_at) AS completed,
    coalesce({rnd(f'sum(CASE WHEN nxt_at IS NOT NULL THEN {gap} END) * 1.0 / nullif(count(nxt_at), 0) / 60', 2)}, 0) AS avg_minutes,
    coalesce(quantile_cont(CASE WHEN nxt_at IS NOT NULL THEN {gap} END, 0.5) / 60, 0) AS median_minutes,
    coalesce(max(CASE WHEN nxt_at IS NOT NULL THEN {gap} END) / 60, 0) AS max_minutes,
    count(*) - count(nxt_at) AS open,
    coalesce({rnd(f'sum(CASE WHEN nxt_at IS NULL THEN {age} END) * 1.0 / nullif(count(*) - count(nxt_at), 0) / 60', 2)}, 0) AS avg_open_minutes,
    coalesce(max(CASE WHEN nxt_at IS NULL THEN {age} END) / 60, 0) AS max_open_minutes
  FROM {rows} GROUP BY ALL),
{name}_all AS (
  SELECT template_key, step_key, coalesce(completed, 0) AS completed, coalesce(avg_minutes, 0) AS avg_minutes, coalesce(median_minutes, 0) AS median_minutes,
    coalesce(max_minutes, 0) AS max_minutes, coalesce(open, 0) AS open, coalesce(avg_open_minutes, 0) AS avg_open_minutes, coalesce(max_open_minutes, 0) AS max_open_minutes
  FROM {name}_raw FULL JOIN tpl_steps USING (template_key, step_key)),
{name} AS (
  SELECT *, coalesce({rnd('avg_minutes / nullif(max(avg_minutes) OVER w, 0)')}, 0) AS duration_intensity,
    coalesce({rnd('avg_open_minutes / nullif(max(avg_open_minutes) OVER w, 0)')}, 0) AS backlog_age_intensity,
    coalesce({rnd('open * 1.0 / nullif(max(open) OVER w, 0)')}, 0) AS backlog_count_intensity
  FROM {name}_all WINDOW w AS (PARTITION BY template_key))"""


ELIG_SQL = f"""{VERSIONS_SQL},
spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY process_key ORDER BY valid_from) AS valid_until FROM versions),
firsts AS (SELECT process_key, document_uuid, arg_min(step_key, pos) AS first_step, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM ktl GROUP BY ALL),
elig AS (
  SELECT f.process_key AS template_key, f.document_uuid, f.first_step, f.first_at, f.last_at, s.version,
    CASE WHEN s.version IS NULL THEN 'before_first_baseline'
      WHEN f.first_step <> CASE f.process_key WHEN 'web' THEN 'signup' ELSE 'placed' END THEN 'started_mid_process'
      WHEN f.last_at >= s.valid_until THEN 'crossed_version_boundary' END AS exclusion_reason
  FROM firsts f LEFT JOIN spans s ON s.process_key = f.process_key AND f.first_at >= s.valid_from AND (s.valid_until IS NULL OR f.first_at < s.valid_until))"""

KBASE_SQL = ",\n".join([LOG_SQL, KTL_SQL, KENT_SQL, TPL_STEPS_SQL, TPL_EDGES_SQL])

WEB_SNAPS = f"{web_sql()},\n{snaps_sql('web')}"

ORACLES = {
    "order_timeline": _order_sql("occurred_at, received_at"),
    "order_timeline_occurred": _order_sql("occurred_at"),
    "order_timeline_received": _order_sql("received_at"),
    "attach_snapshots": f"WITH {LOG_SQL}, {snaps_sql()}, {attach_sql('log')} SELECT document_uuid, external_event_key, ctx, {sec('ctx_loaded_at')} AS ctx_loaded_at, ctx_freshness, has_snapshot FROM att",
    "select_case_version": f"WITH {web_sql()} SELECT document_uuid, document_version, external_event_key FROM web QUALIFY document_version = max(document_version) OVER (PARTITION BY document_uuid)",
    "collapse_repeats": f"WITH {BASE_SQL} SELECT {CASE_SQL}, entry, step_key, n_events, {sec('occurred_at')} AS occurred_at, f_k AS k, f_flag AS flag, {sec('sum_loaded_at')} AS sum_loaded_at FROM ent",
    "filter_phase": f"WITH {web_sql()} SELECT step_key, event_phase, count(*) AS n FROM web WHERE event_phase = 'after' GROUP BY ALL",
    "filter_time_window": f"WITH {web_sql()} SELECT external_event_key, step_key FROM web WHERE (occurred_at >= {SINCE_SQL} OR received_at >= {SINCE_SQL}) AND occurred_at <= TIMESTAMP '2024-01-25'",
    "build_instances": f"WITH {LOG_SQL}, {INSTANCES_SQL} SELECT source_system, case_identity, document_version, process_key, template_version, {sec('started_at')} AS started_at, {sec('last_event_at')} AS last_event_at, current_step_key, event_count, status FROM inst",
    "journey_overview": f"""WITH {web_sql(split=True)}
SELECT document_uuid, process_key, count(*) AS event_count, count(DISTINCT document_version) AS instance_count,
  list_aggregate(list_sort(list(DISTINCT document_version)), 'string_agg', ',') AS versions, {sec('min(occurred_at)')} AS first_at, {sec('max(occurred_at)')} AS last_at
FROM web GROUP BY ALL""",
    "case_list": f"WITH {LOG_SQL} SELECT process_key, document_uuid, max(document_external_id) AS document_external_id, max(document_version) AS document_version, count(*) AS event_count, {sec('max(received_at)')} AS last_event_at FROM log GROUP BY ALL",
    "case_refs_since": f"WITH {web_sql()} SELECT process_key, document_uuid, max(document_external_id) AS document_external_id, max(document_version) AS document_version, {sec('max(received_at)')} AS last_event_at FROM web WHERE received_at >= {SINCE_SQL} OR occurred_at >= {SINCE_SQL} GROUP BY process_key, document_uuid ORDER BY max(received_at) DESC, process_key, document_uuid LIMIT 100",
    "process_overview": f"WITH {LOG_SQL} SELECT process_key, count(*) AS event_count, count(DISTINCT document_uuid) AS case_count FROM log GROUP BY ALL",
    "case_version_overview": f"WITH {LOG_SQL} SELECT process_key, document_uuid, document_version, count(*) AS event_count, {sec('min(occurred_at)')} AS first_at, {sec('max(occurred_at)')} AS last_at FROM log GROUP BY ALL",
    "process_status": f"WITH {LOG_SQL}, {INSTANCES_SQL} SELECT process_key, current_step_key, count(*) AS instance_count, count(*) AS open_count, {sec('max(last_event_at)')} AS last_event_at FROM inst GROUP BY ALL",
    "latest_events": f"WITH {ORDER_SQL} SELECT external_event_key, document_uuid, document_version, step_key, {sec('o')} AS occurred_at FROM (SELECT *, occurred_at AS o FROM ord ORDER BY occurred_at DESC, external_event_key LIMIT 10) x",
    "event_list": f"WITH {web_sql()} SELECT external_event_key, document_uuid, step_key, {sec('o')} AS occurred_at, {sec('r')} AS received_at FROM (SELECT *, occurred_at AS o, received_at AS r FROM web WHERE received_at >= {SINCE_SQL} OR occurred_at >= {SINCE_SQL} ORDER BY received_at DESC, event_id DESC, external_event_key LIMIT 200) x",
    "event_details": f"WITH {WEB_SNAPS} SELECT w.external_event_key, w.step_key, {sec('s.captured_at')} AS captured_at, s.context AS snapshot_context, {sec('s.loaded_at')} AS snapshot_loaded_at FROM web w LEFT JOIN snaps s USING (document_uuid, external_event_key)",
    "kpi_eligibility": f"WITH {LOG_SQL}, {KTL_SQL}, {ELIG_SQL} SELECT template_key, document_uuid, exclusion_reason IS NULL AS is_eligible, exclusion_reason, version, {sec('first_at')} AS first_event_at, {sec('last_at')} AS last_event_at, first_step FROM elig",
    "kpi_summary": f"WITH {LOG_SQL}, {KTL_SQL}, {ELIG_SQL} SELECT template_key, exclusion_reason, count(*) AS cases, CAST(coalesce(sum(sum(CASE WHEN exclusion_reason IS NULL THEN 1 END)) OVER w, 0) AS BIGINT) AS included, CAST(coalesce(sum(sum(CASE WHEN exclusion_reason IS NOT NULL THEN 1 END)) OVER w, 0) AS BIGINT) AS excluded FROM elig GROUP BY template_key, exclusion_reason WINDOW w AS (PARTITION BY template_key)",
    "process_version_latest": f"WITH {LOG_SQL}, {VERSIONS_SQL}, latest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY process_key ORDER BY valid_from DESC, version_id DESC) = 1) SELECT process_key, version, count(*) FILTER (WHERE occurred_at >= valid_from) AS events_since FROM log JOIN latest USING (process_key) GROUP BY ALL",
    "flow_heatmap": f"WITH {KBASE_SQL}, {flow_sql('kent')} SELECT * FROM flow",
    "flow_heatmap_uncollapsed": f"WITH {KBASE_SQL}, raw AS (SELECT *, lead(step_key) OVER (PARTITION BY process_key, document_uuid ORDER BY pos) AS nxt FROM ktl), {flow_sql('raw')} SELECT * FROM flow",
    "duration_heatmap": f"WITH {KBASE_SQL}, {durations_sql()} SELECT * FROM dur",
    "flow_by_context": f"""WITH {KBASE_SQL},
raw AS (SELECT process_key, document_uuid, step_key AS from_step, lead(step_key) OVER (PARTITION BY process_key, document_uuid ORDER BY pos) AS to_step,
  coalesce('{{' || array_to_string(list_transform(list_sort(json_keys(context)), lambda k: '"' || k || '":' || regexp_replace(CAST(json_extract(context, '$.' || k) AS VARCHAR), '\\.0$', '')), ',') || '}}', 'null') AS context_key FROM ktl),
cnt AS (SELECT process_key, from_step, to_step, context_key, count(*) AS observed FROM raw WHERE to_step IS NOT NULL GROUP BY ALL)
SELECT cnt.*, {rnd('observed * 100.0 / n', 2)} AS percentage, {rnd('observed * 1.0 / max(observed) OVER (PARTITION BY process_key)')} AS intensity
FROM cnt JOIN (SELECT process_key, count(DISTINCT document_uuid) AS n FROM raw GROUP BY ALL) c USING (process_key)""",
    "heatmap_report": f"""WITH {KBASE_SQL}, {ELIG_SQL},
used AS (SELECT k.* FROM kent k JOIN elig e ON e.template_key = k.process_key AND e.document_uuid = k.document_uuid AND e.exclusion_reason IS NULL),
{flow_sql('used')}, {durations_sql('used')}
SELECT template_key, 'flow>' || from_step || '>' || to_step AS item, observed, intensity AS value FROM flow
UNION ALL SELECT template_key, 'step>' || step_key, completed, avg_minutes FROM dur
UNION ALL SELECT process_key, 'documents_used', count(DISTINCT document_uuid), 0 FROM used GROUP BY process_key""",
    "case_filter_by_status": f"{FULL} SELECT step_key, count(*) AS n, count(DISTINCT document_uuid) AS cases FROM web WHERE document_uuid IN (SELECT document_uuid FROM rows_ WHERE template_key = 'web' AND NOT (status = 'OK' AND context_issue_count = 0)) GROUP BY ALL",
}
