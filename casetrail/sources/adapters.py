"""Event logs derived from the shared warehouse tables.

The tables are an e-commerce warehouse; these views read them as process logs:
``web`` (users clicking), ``orders`` (orders shipped and returned) and ``chat``
(turns of conversations).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG = [
    "external_event_key",
    "source_system",
    "process_key",
    "event_key",
    "step_key",
    "event_phase",
    "document_external_id",
    "document_uuid",
    "document_version",
    "actor_ref",
    "occurred_at",
    "received_at",
    "event_id",
    "context",
]

# JSON context of a web event, in SQL both engines read alike.
WEB_CONTEXT = """CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat(
  '{"k":', cast(k AS string), ',"value":', cast(value AS string),
  CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(',"band":"',
    CASE WHEN k < 34 THEN 'low' WHEN k < 67 THEN 'mid' ELSE 'high' END, '"') END,
  CASE WHEN event_id % 5 = 0 THEN ',"flag":null' WHEN k % 2 = 0 THEN ',"flag":true' ELSE ',"flag":"false"' END,
  CASE WHEN event_id % 4 = 0 THEN concat(',"req":[{"name":"n', cast(k % 3 AS string), '"},{"id":', cast(k % 4 AS string), '}]') ELSE '' END,
  CASE WHEN event_id % 6 = 0 THEN concat(',"act":"n', cast(k % 2 AS string), '; ', cast(k % 4 AS string), '"') ELSE '' END,
  '}') END"""

WEB_PROCESS = "CASE event_type WHEN 'purchase' THEN 'billing' WHEN 'error' THEN 'support' ELSE 'web' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def web_log(spark: SparkSession, sf_dir: str, split_process: bool = False) -> DataFrame:
    """``split_process`` spreads the steps over the processes web, billing and support."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "*",
            "cast(get_json_object(props, '$.k') AS int) AS k",
            "cast(ts AS timestamp) AS occurred_at",
        )
        .selectExpr(
            "concat('evt-', cast(event_id AS string)) AS external_event_key",
            "'shop' AS source_system",
            (WEB_PROCESS if split_process else "'web'") + " AS process_key",
            "event_type AS event_key",
            "event_type AS step_key",
            "CASE WHEN event_id % 10 = 0 THEN 'before' ELSE 'after' END AS event_phase",
            "concat('ext-', cast(user_id AS string)) AS document_external_id",
            "concat('user-', cast(user_id AS string)) AS document_uuid",
            "cast(1 + floor((day(occurred_at) - 1) / 7.0) AS int) AS document_version",
            "concat('user-', cast(user_id AS string)) AS actor_ref",
            "occurred_at",
            "occurred_at + make_dt_interval(0, 0, 0, event_id % 7) AS received_at",
            "event_id",
            WEB_CONTEXT + " AS context",
        )
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "concat('ord-', cast(o_orderkey AS string)) AS external_event_key",
        "'placed' AS step_key",
        "o_orderkey AS k",
        "cast(o_orderdate AS timestamp) AS occurred_at",
        "concat('{\"status\":\"', o_orderstatus, '\",\"priority\":\"', o_orderpriority,"
        " '\",\"total\":', cast(cast(o_totalprice AS decimal(18,2)) AS string), '}') AS context",
    )
    line_key = "concat_ws('-', {tag}, cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string), cast(l_suppkey AS string), cast(l_shipdate AS string))"
    lines = table(spark, sf_dir, "lineitem")
    shipped = lines.selectExpr(
        line_key.format(tag="'ship'") + " AS external_event_key",
        "'shipped' AS step_key",
        "l_orderkey AS k",
        "cast(l_shipdate AS timestamp) AS occurred_at",
        "cast(NULL AS string) AS context",
    )
    returned = lines.filter("l_returnflag = 'R'").selectExpr(
        line_key.format(tag="'back'") + " AS external_event_key",
        "'returned' AS step_key",
        "l_orderkey AS k",
        "cast(l_shipdate AS timestamp) + interval 30 days AS occurred_at",
        "cast(NULL AS string) AS context",
    )
    return (
        orders.unionByName(shipped)
        .unionByName(returned)
        .selectExpr(
            "external_event_key",
            "'erp' AS source_system",
            "'orders' AS process_key",
            "step_key AS event_key",
            "step_key",
            "'after' AS event_phase",
            "concat('o-', cast(k AS string)) AS document_external_id",
            "concat('order-', cast(k AS string)) AS document_uuid",
            "1 AS document_version",
            "cast(NULL AS string) AS actor_ref",
            "occurred_at",
            "occurred_at AS received_at",
            "cast(NULL AS bigint) AS event_id",
            "context",
        )
    )


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .selectExpr("*", "timestamp '2024-03-01 00:00:00' + make_dt_interval(0, 0, turn, 0) AS occurred_at")
        .selectExpr(
            "concat('msg-', cast(conv_id AS string), '-', cast(turn AS string)) AS external_event_key",
            "'chat' AS source_system",
            "'chat' AS process_key",
            "role AS event_key",
            "role AS step_key",
            "'after' AS event_phase",
            "concat('c-', cast(conv_id AS string)) AS document_external_id",
            "concat('conv-', cast(conv_id AS string)) AS document_uuid",
            "1 AS document_version",
            "role AS actor_ref",
            "occurred_at",
            "occurred_at AS received_at",
            "turn AS event_id",
            "cast(NULL AS string) AS context",
        )
    )


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_log(spark, sf_dir).unionByName(order_log(spark, sf_dir))


def log_snapshots(log: DataFrame) -> DataFrame:
    """Context snapshots of the events that have a context.

    Most are loaded shortly after the event, some before it (clock skew), some
    late; every fifteenth event has a second one, captured an hour later, whose
    context replaces the first.
    """
    n = F.coalesce(F.col("event_id"), F.lit(1))
    delay = F.when(n % 9 == 0, -60).when(n % 9 == 8, 900).otherwise((n % 9) * 30)

    def shot(df, loaded, context):
        return df.select(
            "document_uuid",
            "document_version",
            "process_key",
            "external_event_key",
            "event_id",
            loaded.alias("captured_at"),
            "occurred_at",
            loaded.alias("loaded_at"),
            F.lit(None).cast("long").alias("freshness_seconds"),
            context.alias("context"),
        )

    has = log.filter(F.col("context").isNotNull())
    first = shot(has, F.timestamp_add("SECOND", delay.cast("int"), F.col("occurred_at")), F.col("context"))
    again = shot(
        has.filter(n % 15 == 0),
        F.timestamp_add("SECOND", F.lit(3600), F.col("occurred_at")),
        F.regexp_replace("context", '"k":', '"late":1,"k":'),
    )
    return first.unionByName(again)


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web events as the JSON payloads senders post, in four spellings, some broken."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr("*", "cast(get_json_object(props, '$.k') AS int) AS k", "cast(ts AS timestamp) AS at")
        .selectExpr("*", "cast(1 + floor((day(at) - 1) / 7.0) AS string) AS v", "at + interval 1 hour AS berlin")
        .selectExpr(
            "event_id",
            "at + make_dt_interval(0, 0, 0, event_id % 7) AS received_at",
            """CASE WHEN event_id % 17 = 0 THEN '{"broken'
  WHEN event_id % 19 = 0 THEN '[1, 2]'
  ELSE concat('{',
    CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 23 = 0 THEN '"processKey":"Unknown",' WHEN event_id % 2 = 0 THEN '"process_key":"web",' ELSE '"processKey":" web ",' END,
    CASE event_id % 4
      WHEN 0 THEN concat('"source_system":"shop","step_key":"', event_type, '","document":{"documentId":"ext-', user_id, '","uuid":"user-', user_id, '","version":', v, '},"occurred_at":"', date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), 'Z","id":"evt-', event_id, '","attributes":{"k":', k, '}')
      WHEN 1 THEN concat('"sourceSystem":"shop","stepKey":"', event_type, '","documentId":"ext-', user_id, '","documentUuid":"user-', user_id, '","documentVersion":"', v, '","occurredAt":"', date_format(berlin, "yyyy-MM-dd'T'HH:mm:ss"), ' 01:00","eventId":"evt-', event_id, '","context":{"k":', k, '}')
      WHEN 2 THEN concat('"source":"shop","eventType":"', event_type, '","document_id":{"x":1},"documentId":"ext-', user_id, '","uuid":"user-', user_id, '","version":', v, ',"timestamp":"', date_format(berlin, 'yyyy-MM-dd HH:mm:ss'), '","actor":"u', user_id, '"')
      ELSE concat('"source":"shop","type":"', event_type, '","externalId":"ext-', user_id, '","externalUuid":"user-', user_id, '","version":', v, ',"phase":"BEFORE","changeDate":"', date_format(berlin, "yyyy-MM-dd'T'HH:mm:ss"), '+0100","external_event_key":" evt-', event_id, ' "') END,
    '}') END AS payload""",
        )
    )
