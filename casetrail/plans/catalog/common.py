"""Shared pieces of the query catalogue: templates, and the SQL of the log views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from casetrail.plans.templates import TemplateSet
from casetrail.sources.adapters import WEB_CONTEXT, WEB_PROCESS

WEB = {
    "key": "web",
    "version": "1",
    "initial_step": "signup",
    "steps": [
        {"key": "signup"},
        {"key": "view"},
        {"key": "click"},
        {"key": "purchase"},
        {"key": "refund", "required": False},
    ],
    "required_steps": ["signup", "view", "click", "purchase"],
    "transitions": [
        {"from": "signup", "to": "view"},
        {"from": "signup", "to_parallel_group": "browse"},
        {"from": "view", "to": "click"},
        {"from": "click", "to": "purchase"},
        {"from": "click", "to": "view"},
    ],
    "parallel_groups": [
        {"key": "browse", "required_steps": ["view", "click"], "next": "purchase"},
        {"key": "paid", "required_steps": ["purchase", "refund"]},
        {"key": "fixed", "required_steps": ["view", "purchase"], "order": "strict", "next": "click"},
    ],
    "decision_points": [
        {
            "key": "after_click",
            "after": "click",
            "required_fields": ["k"],
            "rules": [
                {"when": {"k": {"gt": 80}}, "next": "purchase"},
                {"when": {"k": {"lt": 20}}, "next": "view"},
                {"when": {"flag": {"eq": True}}, "next_parallel_group": "browse"},
                {"else": True, "next": "click"},
            ],
        },
        {
            "key": "after_purchase",
            "after": "purchase",
            "rules": [
                {"when": {"value": {"gte": 50}}, "next": "signup"},
                {"when": {"band": {"in": ["low", "mid"]}}, "next": "view"},
                {"else": True, "next": "refund"},
            ],
        },
        {
            "key": "after_refund",
            "after": "refund",
            "rules": [{"when": {"k": {"exists": True}}, "next": "view"}],
        },
    ],
    "field_mappings": {
        "k": {"stability": "mutable"},
        "flag": {"stability": "immutable"},
        "value": {"stability": "immutable"},
        "band": {"stability": "immutable"},
    },
    "context_policy": {"max_delay_seconds": 300},
    "sign_checks": [{"key": "signoff", "required_set": "req", "actual_set": "act"}],
}

ORDERS = {
    "key": "orders",
    "steps": [{"key": "placed"}, {"key": "shipped"}, {"key": "returned", "required": False}],
    "required_steps": ["placed", "shipped"],
    "transitions": [{"from": "placed", "to": "shipped"}, {"from": "shipped", "to": "returned"}],
    "decision_points": [
        {
            "key": "after_placed",
            "after": "placed",
            "rules": [
                {"when": {"status": {"eq": "P"}}, "next": "returned"},
                {"else": True, "next": "shipped"},
            ],
        }
    ],
    "field_mappings": {"status": {"stability": "immutable"}},
}


def templates(spark: SparkSession) -> TemplateSet:
    return TemplateSet(spark, [WEB, ORDERS])


def web_template(spark: SparkSession) -> TemplateSet:
    return TemplateSet(spark, [WEB])


def utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


# ------------------------------------------------------------------ SQL side


def sec(c: str) -> str:
    return f"CAST(floor(epoch({c})) AS BIGINT)"


def rnd(x: str, digits: int = 4) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def web_sql(name: str = "web", split: bool = False) -> str:
    process = WEB_PROCESS if split else "'web'"
    return f"""{name} AS (
  SELECT 'evt-' || event_id AS external_event_key, 'shop' AS source_system, {process} AS process_key,
    event_type AS event_key, event_type AS step_key,
    CASE WHEN event_id % 10 = 0 THEN 'before' ELSE 'after' END AS event_phase,
    'ext-' || user_id AS document_external_id, 'user-' || user_id AS document_uuid,
    CAST(1 + floor((day(ts) - 1) / 7.0) AS INTEGER) AS document_version, 'user-' || user_id AS actor_ref,
    ts AS occurred_at, ts + to_seconds(event_id % 7) AS received_at, event_id,
    {WEB_CONTEXT} AS context
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e)"""


ORDER_SQL = """ord AS (
  SELECT external_event_key, 'erp' AS source_system, 'orders' AS process_key, step_key AS event_key, step_key,
    'after' AS event_phase, 'o-' || k AS document_external_id, 'order-' || k AS document_uuid,
    1 AS document_version, CAST(NULL AS VARCHAR) AS actor_ref, occurred_at, occurred_at AS received_at,
    CAST(NULL AS BIGINT) AS event_id, context
  FROM (
    SELECT 'ord-' || o_orderkey AS external_event_key, 'placed' AS step_key, o_orderkey AS k, o_orderdate AS occurred_at,
      '{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '","total":' || CAST(o_totalprice AS DECIMAL(18,2)) || '}' AS context
    FROM orders
    UNION ALL
    SELECT concat_ws('-', 'ship', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate), 'shipped', l_orderkey, l_shipdate, NULL FROM lineitem
    UNION ALL
    SELECT concat_ws('-', 'back', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate), 'returned', l_orderkey, l_shipdate + INTERVAL 30 DAY, NULL
    FROM lineitem WHERE l_returnflag = 'R') x)"""

CHAT_SQL = """chat AS (
  SELECT 'msg-' || conv_id || '-' || turn AS external_event_key, 'chat' AS process_key, role AS step_key,
    'after' AS event_phase, 'conv-' || conv_id AS document_uuid, 1 AS document_version,
    TIMESTAMP '2024-03-01 00:00:00' + to_minutes(turn) AS occurred_at,
    TIMESTAMP '2024-03-01 00:00:00' + to_minutes(turn) AS received_at, turn AS event_id
  FROM conversations)"""

LOG_SQL = web_sql() + ",\n" + ORDER_SQL + ",\nlog AS (SELECT * FROM web UNION ALL SELECT * FROM ord)"

ORDER_BY = "occurred_at, received_at, coalesce(event_id, 9223372036854775807), external_event_key"
CASE_SQL = "process_key, document_uuid, document_version"


def snaps_sql(source: str = "log", name: str = "snaps") -> str:
    n = "coalesce(event_id, 1)"
    cols = "document_uuid, document_version, process_key, external_event_key, event_id"
    return f"""{name} AS (
  SELECT {cols}, occurred_at + to_seconds(d) AS captured_at, occurred_at, occurred_at + to_seconds(d) AS loaded_at, context
  FROM (SELECT *, CASE WHEN {n} % 9 = 0 THEN -60 WHEN {n} % 9 = 8 THEN 900 ELSE ({n} % 9) * 30 END AS d FROM {source} WHERE context IS NOT NULL) a
  UNION ALL
  SELECT {cols}, occurred_at + to_seconds(3600), occurred_at, occurred_at + to_seconds(3600), replace(context, '"k":', '"late":1,"k":')
  FROM {source} WHERE context IS NOT NULL AND {n} % 15 = 0)"""


def timeline_sql(source: str, name: str = "tl", version: str = "latest", where: str = "TRUE") -> str:
    top = "QUALIFY document_version = max(document_version) OVER (PARTITION BY process_key, document_uuid)" if version == "latest" else ""
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY {CASE_SQL} ORDER BY {ORDER_BY}) AS pos
  FROM {source} WHERE {where} {top})"""


def attach_sql(timeline: str = "tl", snaps: str = "snaps", name: str = "att") -> str:
    return f"""last_snap AS (
  SELECT document_uuid, external_event_key, m.context AS context, m.loaded_at AS loaded_at, m.occurred_at AS occurred_at FROM (
    SELECT document_uuid, external_event_key, max({{'captured_at': captured_at, 'loaded_at': loaded_at, 'context': context, 'occurred_at': occurred_at}}) AS m
    FROM {snaps} GROUP BY document_uuid, external_event_key) q),
{name} AS (
  SELECT t.*, s.context AS ctx, s.loaded_at AS ctx_loaded_at, s.occurred_at AS ctx_occurred_at,
    {sec('s.loaded_at')} - {sec('s.occurred_at')} AS ctx_freshness, s.external_event_key IS NOT NULL AS has_snapshot
  FROM {timeline} t LEFT JOIN last_snap s ON s.document_uuid = t.document_uuid AND s.external_event_key = t.external_event_key)"""


def entries_sql(source: str = "att", name: str = "ent", fields: tuple[str, ...] = ("k", "flag", "value", "band", "req", "act", "status")) -> str:
    """Collapsed entries; merged fields as f_<name> JSON texts (NULL = absent)."""
    merged = ", ".join(
        f"arg_max(CAST(json_extract(ctx, '$.{f}') AS VARCHAR), pos) FILTER (WHERE json_exists(ctx, '$.{f}')) AS f_{f}" for f in fields
    )
    return f"""runs AS (
  SELECT *, sum(CASE WHEN chg THEN 1 ELSE 0 END) OVER (PARTITION BY {CASE_SQL} ORDER BY pos) AS entry
  FROM (SELECT *, step_key IS DISTINCT FROM lag(step_key) OVER (PARTITION BY {CASE_SQL} ORDER BY pos) AS chg FROM {source}) q),
{name} AS (
  SELECT {CASE_SQL}, entry, min(pos) AS pos, count(*) AS n_events, arg_min(step_key, pos) AS step_key,
    arg_min(occurred_at, pos) AS occurred_at, count(ctx) > 0 AS has_ctx, {merged},
    arg_max(ctx, pos) FILTER (WHERE ctx IS NOT NULL) AS sum_context,
    arg_max(ctx_loaded_at, pos) FILTER (WHERE ctx IS NOT NULL) AS sum_loaded_at,
    arg_max(ctx_freshness, pos) FILTER (WHERE ctx IS NOT NULL) AS sum_freshness
  FROM runs GROUP BY {CASE_SQL}, entry)"""


BASE_SQL = ",\n".join([LOG_SQL, snaps_sql(), timeline_sql("log"), attach_sql(), entries_sql()])
