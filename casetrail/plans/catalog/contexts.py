"""Context history, routing and journeys."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from casetrail.functions import values as V
from casetrail.operators import cases, context, routing
from casetrail.plans.catalog.common import LOG_SQL, WEB, rnd, sec, snaps_sql, utc, web_sql, web_template
from casetrail.plans.templates import TemplateSet, small_table
from casetrail.sources import adapters as A

DOC = ["process_key", "document_uuid"]
LOADED = datetime(2024, 2, 1, tzinfo=timezone.utc)


def _web(spark, d):
    log = A.web_log(utc(spark), d)
    return log, A.log_snapshots(log)


def _timeline(spark, d):
    log, snaps = _web(spark, d)
    return cases.case_timeline(cases.attach_snapshots(log, snaps), include_before=False, merge_versions=True, sized_by=log)


def context_history(spark, d):
    log, snaps = _web(spark, d)
    h = context.context_history(context.context_entries(snaps), log, ["k", "flag", "band"])
    return h.select("document_uuid", "seq", F.unix_seconds("at").alias("at"), "step_key", "document_version", "field", "value_json")


def context_diff_by_event(spark, d):
    c = context.context_diff_by_event(_timeline(spark, d), DOC)
    return c.select("document_uuid", "external_event_key", "field", "change", "from_json", "to_json")


def context_field_changes(spark, d):
    log, snaps = _web(spark, d)
    c = context.context_field_changes(context.context_entries(snaps))
    return c.select("document_uuid", "seq", "field", "change", "from_json", "to_json")


def context_coverage(spark, d):
    log = A.full_log(utc(spark), d)
    c = context.context_coverage(A.log_snapshots(log))
    return c.select(
        "process_key", "field", "coverage", "present", "missing",
        F.array_join("types", ",").alias("types"), F.array_join("examples", " ").alias("examples"),
    )


def _lookup(spark, d):
    """Attributes known about every even user, from their own rows."""
    e = A.table(spark, d, "events").filter("user_id % 2 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.selectExpr("concat('user-', cast(user_id AS string)) AS document_uuid", "concat('{\"k\":', cast(n AS string), ',\"seg\":\"s', cast(user_id % 3 AS string), '\"}') AS attributes")


def capture_snapshot(spark, d):
    log, _ = _web(spark, d)
    c = context.capture_snapshots(log, _lookup(spark, d), ["k", "band"], F.lit(LOADED), 86400)
    obj = V.as_object(F.col("context"))
    return c.select(
        "external_event_key",
        F.unix_seconds("loaded_at").alias("loaded_at"),
        "freshness_seconds",
        "is_fresh",
        *[V.value_text(V.field(obj, n)).alias(n) for n in ("k", "band", "seg", "value")],
        F.array_join("warnings", " ").alias("warnings"),
    )


def repair_freshness(spark, d):
    _, snaps = _web(spark, d)
    stored = snaps.withColumn("freshness_seconds", F.when(F.col("event_id") % 2 == 0, F.lit(30).cast("long"))).withColumn(
        "is_fresh", F.when(F.col("event_id") % 2 == 0, F.lit(True))
    )
    r = context.repair_freshness(stored, 300)
    return r.groupBy("is_fresh").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("was_changed").alias("changed"), F.sum("freshness_seconds").alias("total")
    )


def context_change_annotations(spark, d):
    a = context.context_change_annotations(_timeline(spark, d), web_template(spark), DOC)
    return a.select("decision_key", "field", "from_json", "to_json")


def timeline_report(spark, d):
    r = context.timeline_report(_timeline(spark, d), web_template(spark), DOC)
    return r.select("document_uuid", "external_event_key", "field", "change", "is_decision_field")


def event_timeline_report(spark, d):
    r = context.event_timeline_report(_timeline(spark, d), web_template(spark), DOC)
    return r.select("document_uuid", "external_event_key", "step_key", (F.col("ctx").isNotNull()).alias("has_context"), "field", "change", "is_decision_field")


def _tags(spark, d):
    """Parts as tagged documents: size, price, brand and type."""
    p = A.table(spark, d, "part")
    return p.selectExpr(
        "p_partkey AS doc_id",
        "stack(4, 0, 'd-size', 'counters', cast(p_size * 10000 AS string), '',"
        " 1, 'd-price', 'numbers', cast(cast(p_retailprice * 10000 AS bigint) AS string), '',"
        " 2, 'd-name', 'strings', concat(' ', p_name, ' '), '',"
        " 3, 'd-brand', 'selections', '', p_brand) AS (tag_pos, definition_id, tag_type, value, node_id)",
    )


def _definitions(spark):
    return small_table(
        spark,
        [("d-size", "Size"), ("d-price", "Price"), ("d-name", "Name"), ("d-brand", "Brand"), ("d-x", "Twice"), ("d-y", "Twice")],
        "definition_id string, caption string",
    )


def _mapping(spark):
    rows = [("size", "Size"), ("price", "Price "), ("name", "Name"), ("brand", "Brand"), ("two", "Twice"), ("none", "Nowhere")]
    return small_table(spark, rows, "field string, caption string")


def _nodes(spark, d):
    return A.table(spark, d, "part").selectExpr("p_brand AS node_id", "CASE WHEN p_brand LIKE '%1%' THEN concat('Maker ', p_brand) ELSE '' END AS node_value").distinct()


def enrich_from_tags(spark, d):
    utc(spark)
    f = context.tag_field_definitions(_mapping(spark), _definitions(spark))
    return context.enrich_from_tags(_tags(spark, d), f, _nodes(spark, d)).select("doc_id", "field", "value", "n_values")


# ------------------------------------------------------------------ routing and journeys

ROUTED = {
    **{k: v for k, v in WEB.items() if k in ("key", "steps")},
    "routing": [
        {"key": "r_buy", "after_step": "click", "when": {"flag": False}, "expected_process": "billing"},
        {"key": "r_help", "after_step": "view", "when": {"band": "high", "flag": "1"}, "expected_process": "support"},
        {"key": "r_none", "after_step": "click", "when": {"band": "low"}, "expected_process": "archive"},
    ],
}
JOURNEYS = [
    {
        "key": "shopping",
        "steps": [
            {"key": "browse", "process_key": "web"},
            {"key": "pay", "process_key": "billing", "when": {"flag": False}},
            {"key": "help", "process_key": "support", "required": False},
            {"key": "store", "process_key": "archive", "when": {"band": "low"}},
        ],
        "transitions": [{"from": "browse", "to": "pay"}, {"from": "pay", "to": "help"}, {"from": "pay", "to": "gone"}],
    }
]


def _split(spark, d, versions=False):
    """Users with the processes web, billing and support.

    ``versions=False`` files all events of a user under version 1 + user % 2, so that
    the checks reach their rules; otherwise a user has up to five versions."""
    log = A.web_log(utc(spark), d, split_process=True)
    if not versions:
        number = F.regexp_extract("document_uuid", "([0-9]+)$", 1).cast("int")
        late = (F.col("process_key") == "billing") & (number % 5 == 0)
        log = log.withColumn("document_version", F.when(late & (number % 2 == 0), 2).otherwise(1))
    return log


def _source(spark, d, versions=False):
    log = _split(spark, d, versions)
    snaps = A.log_snapshots(log)
    t = cases.attach_snapshots(log, snaps)
    t = cases.numbered(t, ["process_key", "document_uuid"], cases.order_columns())
    return log, snaps, t


def _instances(spark, d, versions=False):
    return cases.build_instances(_split(spark, d, versions))


def _routing(spark, d, versions=False):
    log, snaps, t = _source(spark, d, versions)
    return routing.cross_process_routing(t, snaps, log, _instances(spark, d, versions), TemplateSet(spark, [ROUTED]))


def routing_event(spark, d):
    _, _, t = _source(spark, d)
    steps = small_table(spark, [("web", "r_buy", "click"), ("web", "r_help", "view")], "process_key string, rule_key string, after_step string")
    r = routing.routing_event(t, steps, ["document_uuid"])
    return r.select("document_uuid", "rule_key", "external_event_key", "event_phase")


def as_of_context(spark, d):
    log, snaps, _ = _source(spark, d)
    a = routing.as_of_context(log.select("process_key", "document_uuid", "document_version", "external_event_key", "occurred_at"), snaps, ["process_key", "document_uuid"], F.coalesce("occurred_at", "captured_at"))
    return a.select("external_event_key", "snapshot_context")


def cross_process_routing(spark, d):
    r = _routing(spark, d)
    return r.select("document_uuid", "rule_key", "status", "message", F.unix_seconds("routed_at").alias("routed_at"))


def cross_process_routing_versions(spark, d):
    r = _routing(spark, d, versions=True)
    return r.groupBy("rule_key", "status", "message").agg(F.count(F.lit(1)).alias("cases"))


def rollup_status(spark, d):
    return routing.rollup_status(_routing(spark, d), ["document_uuid"])


def loose_equals(spark, d):
    obj = V.as_object(F.col("context"))
    log = A.web_log(utc(spark), d)
    probes = {"flag_false": ("flag", False), "flag_true": ("flag", True), "k_text": ("k", "50"), "k_one": ("k", 1), "band_low": ("band", "low"), "value_num": ("value", 5)}
    return log.agg(*[F.count_if(V.loose_equal(V.field(obj, f), x)).alias(n) for n, (f, x) in probes.items()])


def _journey(spark, d, versions=False):
    log = _split(spark, d, versions)
    snaps = A.log_snapshots(log)
    t = cases.numbered(cases.attach_snapshots(log, snaps), ["document_uuid"], cases.order_columns())
    return t, snaps, routing.journey_steps(t, snaps, _instances(spark, d, versions), JOURNEYS)


def journey_steps(spark, d):
    return _journey(spark, d)[2].select(
        "document_uuid", "journey_step", "status", "applicable", F.unix_seconds("started_at").alias("started_at")
    )


def journey_steps_versions(spark, d):
    return _journey(spark, d, True)[2].groupBy("journey_step", "status").agg(F.count(F.lit(1)).alias("cases"))


def journey_transitions(spark, d):
    t = routing.journey_transitions(_journey(spark, d)[2], JOURNEYS, spark)
    return t.select("document_uuid", "from_step", "to_step", "status")


def journey_status(spark, d):
    s = _journey(spark, d)[2]
    return routing.journey_status(s, routing.journey_transitions(s, JOURNEYS, spark)).select("document_uuid", "status")


def journey_context(spark, d):
    t, snaps, _ = _journey(spark, d)
    at_event, per_case = routing.journey_context(t, snaps, JOURNEYS)
    flag = lambda c: V.value_text(V.field(V.as_object(F.col(c)), "flag"))
    return at_event.join(per_case, "document_uuid").select(
        "document_uuid", "process_key", flag("context").alias("flag_at_event"), flag("case_context").alias("flag_of_case")
    )


QUERIES = {
    f.__name__: f
    for f in (
        context_history, context_diff_by_event, context_field_changes, context_coverage, capture_snapshot, repair_freshness,
        context_change_annotations, timeline_report, event_timeline_report, enrich_from_tags, routing_event, as_of_context, cross_process_routing,
        cross_process_routing_versions, rollup_status, loose_equals, journey_steps, journey_steps_versions, journey_transitions,
        journey_status, journey_context,
    )
}

# ------------------------------------------------------------------ SQL

WEBS = f"{web_sql()},\n{snaps_sql('web')}"
TIE = "coalesce(external_event_key, '') || '|' || coalesce(context, '')"
HIST = f"hist AS (SELECT *, row_number() OVER (PARTITION BY process_key, document_uuid ORDER BY occurred_at, captured_at, {TIE}) AS seq FROM snaps)"
LONG = "unnest(json_keys({c})) AS field"


def clean(x: str) -> str:
    """JSON text of a value as Spark canonicalises it (5.0 becomes 5, no blanks)."""
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def diff_sql(rows: str, key: str) -> str:
    """rows(document_uuid, seq, context, <key>) -> dif."""
    return f"""lng AS (SELECT document_uuid, seq, {key}, field, {clean("json_extract(context, '$.' || field)")} AS v FROM (SELECT *, {LONG.format(c='context')} FROM {rows}) x),
nx AS (SELECT document_uuid, seq, {key}, lead(seq) OVER (PARTITION BY document_uuid ORDER BY seq) AS nseq, lag(seq) OVER (PARTITION BY document_uuid ORDER BY seq) AS pseq FROM {rows}),
flds AS (SELECT nx.document_uuid, nx.seq, nx.pseq, nx.{key}, l.field FROM nx JOIN lng l ON l.document_uuid = nx.document_uuid AND l.seq IN (nx.seq, nx.pseq) WHERE nx.pseq IS NOT NULL GROUP BY ALL),
dif AS (SELECT f.document_uuid, f.seq, f.{key}, f.field, o.v AS from_json, c.v AS to_json,
    CASE WHEN o.v IS NULL THEN 'added' WHEN c.v IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM flds f LEFT JOIN lng c ON c.document_uuid = f.document_uuid AND c.seq = f.seq AND c.field = f.field
  LEFT JOIN lng o ON o.document_uuid = f.document_uuid AND o.seq = f.pseq AND o.field = f.field WHERE o.v IS DISTINCT FROM c.v)"""


TLC = f"""last_snap AS (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY document_uuid, external_event_key ORDER BY captured_at DESC, loaded_at DESC, context DESC) = 1),
tlc AS (SELECT w.* EXCLUDE (context), s.context, row_number() OVER (PARTITION BY w.document_uuid ORDER BY w.occurred_at, w.received_at, w.event_id) AS seq
  FROM web w LEFT JOIN last_snap s ON s.document_uuid = w.document_uuid AND s.external_event_key = w.external_event_key WHERE w.event_phase = 'after'),
tlx AS (SELECT * FROM tlc WHERE context IS NOT NULL)"""
DIFF_EVENTS = f"WITH {WEBS}, {TLC}, {diff_sql('tlx', 'external_event_key')}"

TAGS_SQL = """tags AS (SELECT p_partkey AS doc_id, unnest([{'f': 'size', 'v': regexp_replace(CAST(CAST(p_size AS DOUBLE) AS VARCHAR), 'x', '')},
  {'f': 'price', 'v': CAST(CAST(CAST(p_retailprice * 10000 AS BIGINT) AS DOUBLE) / 10000 AS VARCHAR)}, {'f': 'name', 'v': nullif(trim(p_name), '')},
  {'f': 'brand', 'v': CASE WHEN p_brand LIKE '%1%' THEN 'Maker ' || p_brand ELSE p_brand END}]) AS t FROM part)"""

SPLIT_SQL = web_sql("web0", split=True) + """,
web AS (SELECT * REPLACE (CASE WHEN process_key = 'billing' AND CAST(regexp_extract(document_uuid, '([0-9]+)$', 1) AS INTEGER) % 10 = 0 THEN 2 ELSE 1 END AS document_version) FROM web0)"""
SPLIT_V_SQL = web_sql("web", split=True)


def routed(split: str) -> str:
    return f"""{split}, {snaps_sql('web')},
last_snap AS (SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY document_uuid, external_event_key ORDER BY captured_at DESC, loaded_at DESC, context DESC) = 1),
evt AS (SELECT w.* EXCLUDE (context), s.context AS ctx FROM web w LEFT JOIN last_snap s ON s.document_uuid = w.document_uuid AND s.external_event_key = w.external_event_key)"""


def as_of(events: str, same_process: bool) -> str:
    cond = " AND s.process_key = e.process_key" if same_process else ""
    return f"""(SELECT e.*, coalesce(
    (SELECT arg_min(s.context, s.captured_at) FROM snaps s WHERE s.document_uuid = e.document_uuid AND s.external_event_key = e.external_event_key{cond}),
    (SELECT arg_max(s.context, (s.occurred_at, CAST(s.captured_at AS VARCHAR) || '|' || s.external_event_key)) FROM snaps s WHERE s.document_uuid = e.document_uuid AND s.document_version = e.document_version{cond} AND s.occurred_at <= e.occurred_at)) AS shot
  FROM {events} e)"""


BOOL = "CASE json_type({c}, '$.flag') WHEN 'BOOLEAN' THEN CAST({c}->>'$.flag' AS BOOLEAN) WHEN 'VARCHAR' THEN CASE lower({c}->>'$.flag') WHEN 'false' THEN FALSE WHEN '0' THEN FALSE WHEN 'true' THEN TRUE WHEN '1' THEN TRUE END END"
RULES = """rules(rule_key, after_step, target) AS (VALUES ('r_buy','click','billing'), ('r_help','view','support'), ('r_none','click','archive')),
docs AS (SELECT document_uuid, min(document_version) <> max(document_version) AS many FROM web WHERE process_key = 'web' GROUP BY ALL),
rev AS (SELECT evt.*, rule_key FROM evt JOIN rules ON after_step = step_key WHERE process_key = 'web'
  QUALIFY row_number() OVER (PARTITION BY document_uuid, rule_key ORDER BY event_phase <> 'after', occurred_at, received_at, event_id) = 1),
"""
ROUTE = f"""{RULES}rctx AS (SELECT *, CAST(coalesce(shot, ctx, '{{}}') AS JSON) AS c FROM {as_of('rev', True)} q),
app AS (SELECT *, coalesce(CASE rule_key WHEN 'r_buy' THEN {BOOL.format(c='c')} = FALSE WHEN 'r_help' THEN c->>'$.band' = 'high' AND {BOOL.format(c='c')} = TRUE ELSE c->>'$.band' = 'low' END, FALSE) AS applies FROM rctx),
tgt AS (SELECT document_uuid, process_key, document_version, min(occurred_at) AS at FROM web GROUP BY ALL),
res AS (SELECT d.document_uuid, r.rule_key, d.many, a.occurred_at AS routed, a.applies, t.at AS started, EXISTS (SELECT 1 FROM tgt o WHERE o.document_uuid = d.document_uuid AND o.process_key = r.target) AS other
  FROM docs d CROSS JOIN rules r LEFT JOIN app a ON a.document_uuid = d.document_uuid AND a.rule_key = r.rule_key
  LEFT JOIN tgt t ON t.document_uuid = d.document_uuid AND t.process_key = r.target AND t.document_version = a.document_version),
rt AS (SELECT document_uuid, rule_key, CASE WHEN many THEN NULL ELSE {sec('routed')} END AS routed_at,
  CASE WHEN many THEN 'WARNING' WHEN routed IS NULL OR NOT applies THEN 'NOT_APPLICABLE' WHEN started < routed THEN 'DEVIATION' WHEN started IS NOT NULL THEN 'SATISFIED' WHEN other THEN 'WARNING' ELSE 'DEVIATION' END AS status,
  CASE WHEN many THEN 'Several source versions found.' WHEN routed IS NULL THEN 'No routing event found.' WHEN NOT applies THEN 'Rule conditions did not match.' WHEN started < routed THEN 'Target starts before the routing event.'
    WHEN started IS NOT NULL THEN 'Target exists for the same version.' WHEN other THEN 'Target exists only for another version.' ELSE 'Target is missing.' END AS message FROM res)"""

MERGE = "SELECT arg_max({x}, (m.occurred_at, m.received_at, m.event_id)) FROM evt m WHERE m.document_uuid = e.document_uuid AND m.ctx IS NOT NULL AND json_exists(m.ctx, '$.{f}')"
JCTX = f"""firsts AS (SELECT * FROM evt QUALIFY row_number() OVER (PARTITION BY document_uuid, process_key ORDER BY occurred_at, received_at, event_id) = 1),
jev AS (SELECT e.document_uuid, e.process_key, CASE WHEN shot IS NOT NULL THEN CAST(json_extract(shot, '$.flag') AS VARCHAR)
    ELSE ({MERGE.format(x="CAST(json_extract(m.ctx, '$.flag') AS VARCHAR)", f='flag')} AND m.document_version = e.document_version AND m.occurred_at <= e.occurred_at) END AS flag_at_event,
  CASE WHEN shot IS NOT NULL THEN shot->>'$.band' ELSE ({MERGE.format(x="m.ctx->>'$.band'", f='band')} AND m.document_version = e.document_version AND m.occurred_at <= e.occurred_at) END AS band
  FROM {as_of('firsts', False)} e),
lasts AS (SELECT document_uuid, arg_max(context, (occurred_at, captured_at)) AS shot FROM snaps GROUP BY ALL),
jcase AS (SELECT e.document_uuid, CASE WHEN l.shot IS NOT NULL THEN CAST(json_extract(l.shot, '$.flag') AS VARCHAR) ELSE ({MERGE.format(x="CAST(json_extract(m.ctx, '$.flag') AS VARCHAR)", f='flag')}) END AS flag_of_case,
  CASE WHEN l.shot IS NOT NULL THEN l.shot->>'$.band' ELSE ({MERGE.format(x="m.ctx->>'$.band'", f='band')}) END AS band
  FROM (SELECT DISTINCT document_uuid FROM evt) e LEFT JOIN lasts l ON l.document_uuid = e.document_uuid)"""
JST = f"""jsteps(pos, step, proc, req) AS (VALUES (0,'browse','web',TRUE), (1,'pay','billing',TRUE), (2,'help','support',FALSE), (3,'store','archive',TRUE)),
jdocs AS (SELECT document_uuid, min(document_version) <> max(document_version) AS many FROM web GROUP BY ALL),
spans AS (SELECT document_uuid, process_key, min(occurred_at) AS began FROM web GROUP BY ALL),
jres AS (SELECT d.document_uuid, j.step AS journey_step, d.many,
    CASE WHEN many THEN 'WARNING' WHEN j.step = 'pay' AND coalesce(coalesce(e.flag_at_event, c.flag_of_case) NOT IN ('false','"false"'), TRUE) THEN 'CONDITION_NOT_APPLICABLE'
      WHEN j.step = 'store' AND coalesce(c.band <> 'low', TRUE) THEN 'CONDITION_NOT_APPLICABLE'
      WHEN s.began IS NOT NULL THEN 'PROCESS_EXISTS' WHEN NOT req THEN 'CONDITION_NOT_APPLICABLE' ELSE 'MISSING_REQUIRED_PROCESS' END AS status, s.began
  FROM jdocs d CROSS JOIN jsteps j LEFT JOIN spans s ON s.document_uuid = d.document_uuid AND s.process_key = j.proc
  LEFT JOIN jev e ON e.document_uuid = d.document_uuid AND e.process_key = j.proc LEFT JOIN jcase c ON c.document_uuid = d.document_uuid),
jst AS (SELECT *, status <> 'CONDITION_NOT_APPLICABLE' AS applicable, CASE WHEN status = 'PROCESS_EXISTS' AND NOT many THEN {sec('began')} END AS started_at FROM jres)"""
JTR = """jedges(f, t) AS (VALUES ('browse','pay'), ('pay','help'), ('pay','gone')),
jtr AS (SELECT d.document_uuid, f AS from_step, t AS to_step, CASE WHEN NOT coalesce(a.status = 'PROCESS_EXISTS' AND b.status = 'PROCESS_EXISTS', FALSE) THEN 'NOT_APPLICABLE'
    WHEN b.began < a.began THEN 'PROCESS_EXISTS_WRONG_ORDER' ELSE 'SATISFIED' END AS status
  FROM jdocs d CROSS JOIN jedges LEFT JOIN jres a ON a.document_uuid = d.document_uuid AND a.journey_step = f LEFT JOIN jres b ON b.document_uuid = d.document_uuid AND b.journey_step = t WHERE NOT d.many)"""
JALL = f"WITH {routed(SPLIT_SQL)}, {JCTX}, {JST}"
JALL_V = f"WITH {routed(SPLIT_V_SQL)}, {JCTX}, {JST}"

ORACLES = {
    "context_history": f"""WITH {WEBS}, {HIST}, x AS (SELECT *, {LONG.format(c='context')} FROM hist)
SELECT x.document_uuid, seq, {sec('x.occurred_at')} AS at, w.step_key, x.document_version, field, {clean("json_extract(x.context, '$.' || field)")} AS value_json
FROM x LEFT JOIN web w ON w.document_uuid = x.document_uuid AND w.external_event_key = x.external_event_key
WHERE field IN ('k','flag','band') AND CAST(json_extract(x.context, '$.' || field) AS VARCHAR) NOT IN ('null','""','[]','{{}}')""",
    "context_diff_by_event": f"{DIFF_EVENTS} SELECT document_uuid, external_event_key, field, change, from_json, to_json FROM dif",
    "context_field_changes": f"""WITH {WEBS}, {HIST}, {diff_sql('hist', 'occurred_at')}
SELECT document_uuid, seq, field, change, from_json, to_json FROM dif
UNION ALL SELECT document_uuid, seq, field, 'unchanged', NULL, v FROM lng l WHERE seq = 1 AND NOT EXISTS (SELECT 1 FROM dif d WHERE d.document_uuid = l.document_uuid AND d.field = l.field)""",
    "context_coverage": f"""WITH {LOG_SQL}, {snaps_sql()}, tot AS (SELECT process_key, count(*) AS n FROM snaps GROUP BY ALL),
l AS (SELECT process_key, captured_at, external_event_key, context, unnest(json_keys(context)) AS field FROM snaps),
v AS (SELECT process_key, captured_at, external_event_key, field, {clean("json_extract(context, '$.' || field)")} AS j,
  CASE json_type(context, '$.' || field) WHEN 'BOOLEAN' THEN 'bool' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'float' WHEN 'ARRAY' THEN 'array' ELSE 'int' END AS ty FROM l
  WHERE json_type(context, '$.' || field) <> 'NULL'),
dis AS (SELECT process_key, field, ty, j, min((captured_at, external_event_key)) AS first_at FROM v GROUP BY ALL),
ex AS (SELECT process_key, field, string_agg(j, ' ' ORDER BY first_at, ty, j) AS examples FROM (SELECT * FROM dis QUALIFY row_number() OVER (PARTITION BY process_key, field ORDER BY first_at, ty, j) <= 3) q GROUP BY ALL)
SELECT process_key, field, {rnd('count(*) * 1.0 / any_value(n)')} AS coverage, count(*) AS present, any_value(n) - count(*) AS missing, list_aggregate(list_sort(list(DISTINCT ty)), 'string_agg', ',') AS types, any_value(examples) AS examples
FROM v JOIN tot USING (process_key) JOIN ex USING (process_key, field) GROUP BY ALL""",
    "capture_snapshot": f"""WITH {web_sql()}, lk AS (SELECT 'user-' || user_id AS document_uuid, '{{"k":' || count(*) || ',"seg":"s' || user_id % 3 || '"}}' AS attributes FROM events WHERE user_id % 2 = 0 GROUP BY user_id),
j AS (SELECT w.*, attributes, attributes IS NULL AND context IS NOT NULL AS own_only FROM web w LEFT JOIN lk USING (document_uuid)),
m AS (SELECT *, coalesce(attributes->>'$.k', context->>'$.k') AS k, CAST(json_extract(context, '$.band') AS VARCHAR) AS band, CAST(json_extract(attributes, '$.seg') AS VARCHAR) AS seg,
  CASE WHEN own_only THEN {sec('occurred_at')} ELSE {int(LOADED.timestamp())} END AS loaded_at FROM j)
SELECT external_event_key, loaded_at, loaded_at - {sec('occurred_at')} AS freshness_seconds, loaded_at - {sec('occurred_at')} BETWEEN 0 AND 86400 AS is_fresh, k, band, seg, CAST(NULL AS VARCHAR) AS value,
  concat_ws(' ', CASE WHEN k IS NULL THEN 'Missing required context field "k".' END, CASE WHEN band IS NULL THEN 'Missing required context field "band".' END, CASE WHEN loaded_at < {sec('occurred_at')} THEN 'Context freshness is negative (' || (loaded_at - {sec('occurred_at')}) || ' seconds).' END) AS warnings FROM m""",
    "repair_freshness": f"""WITH {WEBS}, r AS (SELECT event_id, {sec('loaded_at')} - {sec('occurred_at')} AS f FROM snaps)
SELECT f BETWEEN 0 AND 300 AS is_fresh, count(*) AS checked, count(*) FILTER (WHERE event_id % 2 <> 0 OR f <> 30) AS changed, CAST(sum(f) AS BIGINT) AS total FROM r GROUP BY ALL""",
    "context_change_annotations": f"""{DIFF_EVENTS},
pairs AS (SELECT *, lead(step_key) OVER (PARTITION BY document_uuid ORDER BY seq) AS nxt FROM tlc),
vio AS (SELECT document_uuid, seq, 'after_click' AS decision_key, unnest(CASE WHEN CAST(context->>'$.k' AS DOUBLE) > 80 OR CAST(context->>'$.k' AS DOUBLE) < 20 THEN ['k'] WHEN json_type(context, '$.flag') IN ('BOOLEAN','VARCHAR') THEN ['k','flag'] ELSE ['k'] END) AS field
    FROM pairs WHERE step_key = 'click' AND nxt IS NOT NULL AND context IS NOT NULL AND CASE WHEN CAST(context->>'$.k' AS DOUBLE) > 80 THEN nxt <> 'purchase' WHEN CAST(context->>'$.k' AS DOUBLE) < 20 THEN nxt <> 'view'
      WHEN json_type(context, '$.flag') IN ('BOOLEAN','VARCHAR') THEN nxt NOT IN ('view','click') ELSE nxt <> 'click' END
  UNION ALL SELECT document_uuid, seq, 'after_purchase', CASE WHEN CAST(context->>'$.value' AS DOUBLE) >= 50 THEN 'value' ELSE 'band' END
    FROM pairs WHERE step_key = 'purchase' AND nxt IS NOT NULL AND context IS NOT NULL AND CASE WHEN CAST(context->>'$.value' AS DOUBLE) >= 50 THEN nxt <> 'signup' WHEN context->>'$.band' IN ('low','mid') THEN nxt <> 'view' ELSE FALSE END),
since AS (SELECT document_uuid, decision_key, field, min(seq) AS seq FROM vio GROUP BY ALL)
SELECT DISTINCT s.decision_key, s.field, d.from_json, d.to_json FROM dif d JOIN since s ON s.document_uuid = d.document_uuid AND s.field = d.field AND d.seq > s.seq""",
    "event_timeline_report": f"{DIFF_EVENTS} SELECT t.document_uuid, t.external_event_key, t.step_key, t.context IS NOT NULL AS has_context, field, change, CASE WHEN field IS NOT NULL THEN field IN ('k','flag','value','band') END AS is_decision_field FROM tlc t LEFT JOIN dif USING (document_uuid, external_event_key)",
    "timeline_report": f"{DIFF_EVENTS} SELECT document_uuid, external_event_key, field, change, field IN ('k','flag','value','band') AS is_decision_field FROM dif",
    "enrich_from_tags": f"WITH {TAGS_SQL} SELECT doc_id, t.f AS field, t.v AS value, 1 AS n_values FROM tags WHERE t.v IS NOT NULL",
    "routing_event": f"WITH {routed(SPLIT_SQL)}, r(rule_key, after_step) AS (VALUES ('r_buy','click'), ('r_help','view')) SELECT document_uuid, rule_key, external_event_key, event_phase FROM evt JOIN r ON after_step = step_key WHERE process_key = 'web' QUALIFY row_number() OVER (PARTITION BY document_uuid, rule_key ORDER BY event_phase <> 'after', occurred_at, received_at, event_id) = 1",
    "as_of_context": f"WITH {routed(SPLIT_SQL)} SELECT external_event_key, shot AS snapshot_context FROM {as_of('evt', True)} q",
    "cross_process_routing": f"WITH {routed(SPLIT_SQL)}, {ROUTE} SELECT document_uuid, rule_key, status, message, routed_at FROM rt",
    "cross_process_routing_versions": f"WITH {routed(SPLIT_V_SQL)}, {ROUTE} SELECT rule_key, status, message, count(*) AS cases FROM rt GROUP BY ALL",
    "rollup_status": f"WITH {routed(SPLIT_SQL)}, {ROUTE} SELECT document_uuid, arg_min(status, CASE status WHEN 'DEVIATION' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'SATISFIED' THEN 3 ELSE 4 END) AS status FROM rt GROUP BY ALL",
    "loose_equals": f"""WITH {web_sql()}, b AS (SELECT *, {BOOL.format(c='context')} AS fl FROM web WHERE context IS NOT NULL)
SELECT count(*) FILTER (WHERE fl = FALSE) AS flag_false, count(*) FILTER (WHERE fl = TRUE) AS flag_true, count(*) FILTER (WHERE CAST(context->>'$.k' AS INTEGER) = 50) AS k_text,
  count(*) FILTER (WHERE CAST(context->>'$.k' AS INTEGER) = 1) AS k_one, count(*) FILTER (WHERE context->>'$.band' = 'low') AS band_low, count(*) FILTER (WHERE CAST(context->>'$.value' AS DOUBLE) = 5) AS value_num FROM b""",
    "journey_steps": f"{JALL} SELECT document_uuid, journey_step, status, applicable, started_at FROM jst",
    "journey_steps_versions": f"{JALL_V} SELECT journey_step, status, count(*) AS cases FROM jst GROUP BY ALL",
    "journey_transitions": f"{JALL}, {JTR} SELECT * FROM jtr",
    "journey_status": f"""{JALL}, {JTR} SELECT document_uuid, CASE WHEN bool_or(status IN ('MISSING_REQUIRED_PROCESS','PROCESS_EXISTS_WRONG_ORDER')) THEN 'DEVIATION' WHEN bool_or(status = 'WARNING') THEN 'WARNING' WHEN bool_or(status = 'PROCESS_EXISTS') THEN 'SATISFIED' ELSE 'NOT_APPLICABLE' END AS status
FROM (SELECT document_uuid, status FROM jst UNION ALL SELECT document_uuid, status FROM jtr) q GROUP BY ALL""",
    "journey_context": f"WITH {routed(SPLIT_SQL)}, {JCTX} SELECT document_uuid, process_key, coalesce(flag_at_event) AS flag_at_event, flag_of_case FROM jev JOIN jcase USING (document_uuid)",
}
