"""Expected graph, projection and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.functions import buckets
from casetrail.operators import cases, discovery, graph, kpi
from casetrail.plans.catalog.common import CHAT_SQL, LOG_SQL, attach_sql, rnd, sec, snaps_sql, templates, utc, web_sql
from casetrail.plans.catalog.timelines import KBASE_SQL, NOW, durations_sql
from casetrail.sources import adapters as A
from casetrail.sources.scratch import held, staged


def _projected(spark, d):
    log = A.full_log(utc(spark), d)
    t = cases.case_timeline(log, include_before=False, merge_versions=True, snapshots=A.log_snapshots(log))
    tpl = templates(spark)
    return graph.project_transitions(t, tpl), tpl


def _held_projection(spark, d):
    """For queries that read the projection several times; cases stay together."""
    p, tpl = _projected(spark, d)
    return held(p.select(*cases.CASE, "template_key", "pos", "step_key", "to_step", "occurred_at", "to_at", "classification", "edges")), tpl


def _metrics(spark, d):
    log = A.full_log(utc(spark), d)
    t = cases.case_timeline(log, include_before=False, merge_versions=True, snapshots=A.log_snapshots(log))
    return graph.projection_metrics(t, templates(spark), NOW)


def _durations(spark, d):
    t = cases.case_timeline(A.full_log(utc(spark), d), include_before=False, merge_versions=True)
    tpl = templates(spark)
    return kpi.duration_heatmap(cases.run_starts(t), tpl, NOW), tpl


def expected_graph(spark, d):
    """Edges of the expected graphs with the events seen at their source."""
    _, edges = graph.expected_graph(templates(utc(spark)))
    n = A.full_log(spark, d).groupBy(F.col("process_key").alias("template_key"), F.col("step_key").alias("from_node")).agg(F.count(F.lit(1)).alias("events"))
    return edges.join(n, ["template_key", "from_node"], "left").select(
        "template_key", "from_node", "to_node", "label", "style", F.coalesce("events", F.lit(0)).alias("events")
    )


def project_transition(spark, d):
    p, _ = _projected(spark, d)
    c = graph.transition_classes(p)
    edges = F.array_join(F.transform("edges", lambda e: F.concat(e["from_node"], F.lit(">"), e["to_node"])), " ")
    return c.select("template_key", "from_step", "to_step", "classification", edges.alias("edges"), "observed")


def edge_metrics(spark, d):
    p, tpl = _projected(spark, d)
    return graph.edge_metrics(p, tpl)


def node_flow(spark, d):
    p, tpl = _held_projection(spark, d)
    return graph.node_flow(p, tpl)


def virtual_node_durations(spark, d):
    p, tpl = _held_projection(spark, d)
    s = graph.duration_stats(graph.virtual_node_durations(p, tpl), ["template_key", "node_key", "node_type"])
    return s.select("template_key", "node_key", "node_type", "n", F.round("avg_seconds", 4).alias("avg_seconds"), "median_seconds", F.round("p95_seconds", 4).alias("p95_seconds"), "max_seconds")


def node_metrics(spark, d):
    return _metrics(spark, d).nodes().select("template_key", "node_id", "node_type", "observed", *[F.round(c, 3).alias(c) for c in ("avg_seconds", "median_seconds", "p95_seconds")], "reliable", "flow_count")


def _gaps(spark, d):
    t = cases.case_timeline(A.web_log(utc(spark), d), include_before=False, merge_versions=True)
    return kpi.step_times(cases.run_starts(t), NOW).filter(~F.col("is_open"))


def duration_stats(spark, d):
    s = graph.duration_stats(_gaps(spark, d), ["step_key"])
    return s.select("step_key", "n", F.round("avg_seconds", 4).alias("avg_seconds"), "median_seconds", F.round("p95_seconds", 4).alias("p95_seconds"), "max_seconds")


def relative_buckets(spark, d):
    per_user = _gaps(spark, d).groupBy("document_uuid").agg(F.sum("seconds").alias("seconds"))
    return buckets.relative_buckets(per_user, "seconds", 5, "heat-").select("document_uuid", "seconds", "bucket")


def fixed_dwell_buckets(spark, d):
    g = _gaps(spark, d).withColumn("bucket", buckets.fixed_dwell_bucket(F.col("seconds")))
    return g.groupBy("step_key", "bucket").agg(F.count(F.lit(1)).alias("n"))


def parallel_group_rollup(spark, d):
    dur, tpl = _durations(spark, d)
    return graph.parallel_group_rollup(dur, tpl)


def projection_summary(spark, d):
    p, _ = _projected(spark, d)
    return graph.projection_summary(p)


def skipped_cases(spark, d):
    log = A.web_log(utc(spark), d).unionByName(A.order_log(spark, d))
    used = cases.filter_time_window(cases.filter_phase(log), None, F.to_timestamp(F.lit("1999-01-01 00:00:00")))
    return graph.skipped_cases(log, used, "no_timeline_events")


# ------------------------------------------------------------------ discovery


def _discovery(spark, d, chat=False):
    log = A.chat_log(utc(spark), d) if chat else A.full_log(utc(spark), d)
    return discovery.discovery_timeline(log)


def _entries(spark, d, chat=False):
    return discovery.discovery_entries(_discovery(spark, d, chat))


def normalize_step(spark, d):
    from casetrail.functions.text import normalize_step as norm

    p = A.table(utc(spark), d, "part").select(F.concat(F.lit("  Größe "), "p_name", F.lit("\t ÄÖÜ  "), "p_brand").alias("raw"))
    return p.select("raw", norm(F.col("raw")).alias("step"))


def discover_steps(spark, d):
    return discovery.discover_steps(_entries(spark, d))


def discover_transitions(spark, d):
    return discovery.discover_transitions(_entries(spark, d)).select("process_key", "from_step", "to_step", "observed", "confidence", "from_label")


def discover_transitions_chat(spark, d):
    return discovery.discover_transitions(_entries(spark, d, True)).select("process_key", "from_step", "to_step", "observed", "confidence")


def conflicting_transitions(spark, d):
    return discovery.conflicting_transitions(discovery.discover_transitions(_entries(spark, d)))


def discover_parallel_groups(spark, d):
    """Web visits framed by an arrival and a departure event of each user's last week."""
    log = cases.select_case_version(A.web_log(utc(spark), d)).withColumn("event_phase", F.lit("after"))
    keys = [c for c in log.columns if c not in ("step_key", "event_key", "occurred_at", "received_at", "external_event_key", "event_id", "context")]

    def frame(name, pick, shift):
        at = F.timestamp_add("MINUTE", F.lit(shift), pick("occurred_at"))
        f = log.groupBy(*keys).agg(at.alias("occurred_at"))
        return f.withColumns(
            {
                "step_key": F.lit(name), "event_key": F.lit(name), "received_at": F.col("occurred_at"), "event_id": F.lit(None).cast("long"),
                "external_event_key": F.concat(F.lit(name + "-"), "document_uuid"), "context": F.lit(None).cast("string"),
            }
        )

    framed = log.unionByName(frame("arrive", F.min, -1)).unionByName(frame("leave", F.max, 1))
    e = discovery.discovery_entries(discovery.discovery_timeline(framed))
    return discovery.discover_parallel_groups(e, discovery.discover_transitions(e))


def discover_parallel_fallback(spark, d):
    e = _entries(spark, d)
    names = [*cases.CASE, "block", "entry", "step", "next_step", "step_key", "next_key", "case_rank"]
    e = held(e.select(*[c for c in names if c in e.columns]))
    t = staged(discovery.discover_transitions(e), "transitions")
    return discovery.discover_parallel_fallback(e, t, discovery.discover_parallel_groups(e, t))


def repeated_runs(spark, d):
    return discovery.repeated_runs(discovery.runs(_discovery(spark, d)))


def repeated_run_neighbours(spark, d):
    return discovery.repeated_run_neighbours(discovery.runs(_discovery(spark, d)))


def decision_candidates(spark, d):
    c = discovery.decision_candidates(_entries(spark, d))
    return c.select("process_key", "after_step", F.array_join("next_steps", ",").alias("next_steps"), "cases", "coverage")


def _moves(spark, d):
    """Entries with contexts, held for the queries that read them several times, and the candidates among their steps."""
    log = A.full_log(utc(spark), d)
    e = discovery.discovery_entries(discovery.discovery_timeline(log, snapshots=A.log_snapshots(log)))
    e = held(e.select(*cases.CASE, "step", "next_step", "ctx"))
    return e, staged(discovery.decision_candidates(e), "candidates")


def decision_field_evidence(spark, d):
    return discovery.decision_field_evidence(*_moves(spark, d))


def values_by_next_step(spark, d):
    return discovery.values_by_next_step(*_moves(spark, d))


def expected_nodes(spark, d):
    """Nodes of the expected graphs with the events seen at them."""
    nodes, _ = graph.expected_graph(templates(utc(spark)))
    n = A.full_log(spark, d).groupBy(F.col("process_key").alias("template_key"), F.col("step_key").alias("node_id")).agg(F.count(F.lit(1)).alias("events"))
    return nodes.join(n, ["template_key", "node_id"], "left").withColumn("events", F.coalesce("events", F.lit(0)))


def discover_single_case(spark, d):
    s = discovery.discover_single_case(_discovery(spark, d))
    return s.select("document_uuid", "step_no", "step_key", "next_step_key", "run_length")


QUERIES = {
    f.__name__: f
    for f in (
        expected_graph, project_transition, edge_metrics, node_flow, virtual_node_durations, node_metrics, duration_stats,
        relative_buckets, fixed_dwell_buckets, parallel_group_rollup, projection_summary, skipped_cases, normalize_step,
        discover_steps, discover_transitions, discover_transitions_chat, conflicting_transitions, discover_parallel_groups,
        discover_parallel_fallback, repeated_runs, repeated_run_neighbours, decision_candidates, decision_field_evidence,
        discover_single_case, values_by_next_step, expected_nodes,
    )
}

# ------------------------------------------------------------------ SQL

G_EDGES = """g_edges(template_key, from_node, to_node, label, style) AS (VALUES
  ('web','click','decision:after_click',NULL,'flow'), ('web','decision:after_click','purchase','[1] k > 80','flow'), ('web','decision:after_click','view','[2] k < 20','flow'),
  ('web','decision:after_click','parallel_start:browse','[3] flag = true','flow'), ('web','decision:after_click','click','[else]','flow'),
  ('web','purchase','decision:after_purchase',NULL,'flow'), ('web','decision:after_purchase','signup','[1] value >= 50','flow'), ('web','decision:after_purchase','view','[2] band in ["low","mid"]','flow'), ('web','decision:after_purchase','refund','[else]','flow'),
  ('web','refund','decision:after_refund',NULL,'flow'), ('web','decision:after_refund','view','[1] k exists true','flow'),
  ('web','parallel_start:browse','view',NULL,'flow'), ('web','view','parallel_join:browse',NULL,'flow'), ('web','parallel_start:browse','click',NULL,'flow'), ('web','click','parallel_join:browse',NULL,'flow'), ('web','parallel_join:browse','purchase',NULL,'flow'),
  ('web','purchase','parallel:paid','part of','constraint'), ('web','refund','parallel:paid','part of','constraint'),
  ('web','parallel_start:fixed','view',NULL,'flow'), ('web','view','parallel_join:fixed',NULL,'flow'), ('web','parallel_start:fixed','purchase',NULL,'flow'), ('web','purchase','parallel_join:fixed',NULL,'flow'), ('web','parallel_join:fixed','click',NULL,'flow'),
  ('web','__start','signup',NULL,'flow'), ('web','signup','view',NULL,'flow'), ('web','signup','parallel_start:browse',NULL,'flow'), ('web','view','click',NULL,'flow'), ('web','click','purchase',NULL,'flow'), ('web','click','view',NULL,'flow'),
  ('orders','placed','decision:after_placed',NULL,'flow'), ('orders','decision:after_placed','returned','[1] status = P','flow'), ('orders','decision:after_placed','shipped','[else]','flow'),
  ('orders','__start','placed',NULL,'flow'), ('orders','placed','shipped',NULL,'flow'), ('orders','shipped','returned',NULL,'flow'), ('orders','returned','__end',NULL,'flow'))"""

KPROJ = f"""{LOG_SQL}, {snaps_sql()}, {attach_sql('log')},
ptl AS (SELECT *, row_number() OVER w AS pos, lead(step_key) OVER w AS nxt, lead(occurred_at) OVER w AS nxt_at FROM att WHERE event_phase = 'after'
  WINDOW w AS (PARTITION BY process_key, document_uuid ORDER BY occurred_at, received_at, coalesce(event_id, 9223372036854775807), external_event_key)),
cls AS (SELECT *, CASE WHEN nxt IS NULL THEN NULL
    WHEN process_key = 'orders' THEN CASE WHEN (step_key, nxt) IN (('placed','shipped'), ('shipped','returned')) THEN step_key || '>' || nxt
      WHEN step_key = 'placed' AND nxt = 'returned' AND coalesce(ctx->>'$.status' = 'P', TRUE) THEN 'D placed>decision:after_placed decision:after_placed>returned' ELSE 'U ' || step_key || '>' || nxt END
    WHEN (step_key, nxt) IN (('signup','view'), ('view','click'), ('click','purchase'), ('click','view')) THEN step_key || '>' || nxt
    WHEN step_key = 'click' AND nxt = 'click' AND (ctx IS NULL OR CAST(ctx->>'$.k' AS DOUBLE) BETWEEN 20 AND 80) AND (ctx IS NULL OR json_type(ctx, '$.flag') IN ('BOOLEAN','VARCHAR')) THEN 'D click>decision:after_click decision:after_click>parallel_start:browse parallel_start:browse>click'
    WHEN step_key = 'click' AND nxt = 'click' AND CAST(ctx->>'$.k' AS DOUBLE) BETWEEN 20 AND 80 THEN 'D click>decision:after_click decision:after_click>click'
    WHEN step_key = 'purchase' AND nxt = 'signup' AND (ctx IS NULL OR CAST(ctx->>'$.value' AS DOUBLE) >= 50) THEN 'D purchase>decision:after_purchase decision:after_purchase>signup'
    WHEN step_key = 'purchase' AND nxt = 'view' AND (ctx IS NULL OR CAST(ctx->>'$.value' AS DOUBLE) < 50 AND ctx->>'$.band' IN ('low','mid')) THEN 'D purchase>decision:after_purchase decision:after_purchase>view'
    WHEN step_key = 'signup' AND nxt = 'click' THEN 'G signup>parallel_start:browse parallel_start:browse>click'
    WHEN step_key IN ('view','click') AND nxt IN ('view','click') THEN 'I '
    WHEN step_key = 'purchase' AND nxt = 'purchase' THEN 'I '
    WHEN step_key IN ('view','click') AND nxt = 'purchase' THEN 'C ' || step_key || '>parallel_join:browse parallel_join:browse>purchase'
    WHEN step_key IN ('view','purchase') AND nxt = 'click' THEN 'C ' || step_key || '>parallel_join:fixed parallel_join:fixed>click'
    ELSE 'U ' || step_key || '>' || nxt END AS c FROM ptl),
prj AS (SELECT *, CASE WHEN c IS NULL THEN NULL ELSE CASE left(c, 2) WHEN 'D ' THEN 'EXPECTED_VIA_DECISION' WHEN 'G ' THEN 'EXPECTED_VIA_PARALLEL_GROUP' WHEN 'I ' THEN 'EXPECTED_GROUP_INTERNAL' WHEN 'C ' THEN 'EXPECTED_GROUP_COMPLETE' WHEN 'U ' THEN 'UNEXPECTED' ELSE 'EXPECTED_DIRECT' END END AS classification,
    CASE WHEN left(c, 2) IN ('D ','G ','I ','C ','U ') THEN substr(c, 3) ELSE c END AS edges FROM cls)"""
EDGE_ROWS = "er AS (SELECT process_key, document_uuid, pos, step_key, nxt, occurred_at, classification, unnest(string_split(edges, ' ')) AS edge FROM prj WHERE edges <> '')"
GROUP_DONE = f"""{EDGE_ROWS},
grp(g, step, entry_node) AS (VALUES ('browse','view','parallel_start:browse'), ('browse','click','parallel_start:browse'), ('paid','purchase','parallel:paid'), ('paid','refund','parallel:paid'), ('fixed','view','parallel_start:fixed'), ('fixed','purchase','parallel_start:fixed')),
memb AS (SELECT document_uuid, g, step, min(pos) AS p FROM prj JOIN grp ON step = step_key WHERE process_key = 'web' GROUP BY ALL),
done AS (SELECT document_uuid, g, min(p) AS p0, max(p) AS p1 FROM memb GROUP BY ALL HAVING count(*) = 2),
act AS (SELECT document_uuid, g, min(pos) AS pa FROM er JOIN (SELECT DISTINCT g, entry_node FROM grp) q ON split_part(edge, '>', 2) = entry_node WHERE process_key = 'web' GROUP BY ALL),
gdur AS (SELECT d.document_uuid, d.g, {sec('b.occurred_at')} - {sec('a.occurred_at')} AS seconds FROM done d LEFT JOIN act x ON x.document_uuid = d.document_uuid AND x.g = d.g
  JOIN prj a ON a.process_key = 'web' AND a.document_uuid = d.document_uuid AND a.pos = least(d.p0, coalesce(x.pa, d.p0)) JOIN prj b ON b.process_key = 'web' AND b.document_uuid = d.document_uuid AND b.pos = d.p1)"""
KIND = "CASE WHEN {n} LIKE 'decision:%' THEN 'exclusive_gateway' WHEN {n} LIKE 'parallel_start:%' THEN 'parallel_start' WHEN {n} LIKE 'parallel_join:%' THEN 'parallel_join' WHEN {n} LIKE 'parallel:%' THEN 'parallel_group' ELSE 'task' END"
FLOW_NODES = f"""nf AS (SELECT process_key AS template_key, node_id, {KIND.format(n='node_id')} AS node_type, count(DISTINCT document_uuid) AS flow_count FROM (
  SELECT process_key, document_uuid, step_key AS node_id FROM prj
  UNION ALL SELECT process_key, document_uuid, n FROM (SELECT *, unnest(string_split(edge, '>')) AS n FROM er) q WHERE n <> step_key AND n <> nxt
  UNION ALL SELECT 'web', document_uuid, 'parallel_join:' || g FROM done WHERE g <> 'paid') u GROUP BY ALL)"""
VIRTUAL = f"""vrt AS (SELECT process_key AS template_key, split_part(split_part(edges, ' ', 1), '>', 2) AS node_key, greatest(0, {sec('nxt_at')} - {sec('occurred_at')}) AS seconds FROM prj WHERE classification = 'EXPECTED_VIA_DECISION'
  UNION ALL SELECT 'web', 'parallel_join:' || g, seconds FROM gdur UNION ALL SELECT 'web', CASE g WHEN 'paid' THEN 'parallel:paid' ELSE 'parallel_start:' || g END, seconds FROM gdur),
vst AS (SELECT template_key, node_key, {KIND.format(n='node_key')} AS node_type, count(*) AS n, sum(seconds) * 1.0 / count(*) AS avg_seconds, quantile_cont(seconds, 0.5) AS median_seconds, quantile_cont(seconds, 0.95) AS p95_seconds, CAST(max(seconds) AS DOUBLE) AS max_seconds FROM vrt GROUP BY ALL)"""

DTL = f"""dtl AS (SELECT process_key, document_uuid, step_key, occurred_at, event_id, external_event_key, received_at,
    row_number() OVER (PARTITION BY process_key, document_uuid ORDER BY occurred_at, received_at, coalesce(event_id, 9223372036854775807), external_event_key) AS pos
  FROM (SELECT * FROM {{src}} WHERE event_phase = 'after' QUALIFY document_version = max(document_version) OVER (PARTITION BY process_key, document_uuid)) q),
den AS (SELECT *, lead(step_key) OVER (PARTITION BY process_key, document_uuid ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY process_key, document_uuid ORDER BY pos) AS entry
  FROM (SELECT *, lag(step_key) OVER (PARTITION BY process_key, document_uuid ORDER BY pos) AS prv FROM dtl) q WHERE prv IS NULL OR prv <> step_key),
dtr AS (SELECT process_key, step_key AS from_step, nxt AS to_step, count(*) AS observed, {rnd('count(*) * 1.0 / max(count(*)) OVER (PARTITION BY process_key)')} AS confidence FROM den WHERE nxt IS NOT NULL GROUP BY process_key, step_key, nxt)"""
D_LOG = f"WITH {LOG_SQL}, {DTL.format(src='log')}"
CONF = "con AS (SELECT a.process_key, a.from_step, a.to_step, a.observed, b.observed AS reverse FROM dtr a JOIN dtr b ON a.process_key = b.process_key AND a.from_step = b.to_step AND a.to_step = b.from_step WHERE a.from_step < a.to_step)"
UNIQ = """uq AS (SELECT process_key, document_uuid, step_key, r, lag(step_key) OVER w AS bef, lead(step_key) OVER w AS aft FROM (SELECT process_key, document_uuid, step_key, min(entry) AS r FROM den GROUP BY ALL) q WINDOW w AS (PARTITION BY process_key, document_uuid ORDER BY r)),
ust AS (SELECT process_key, step_key FROM uq GROUP BY ALL HAVING count(*) FILTER (WHERE bef IS NULL) = 0 AND count(*) FILTER (WHERE aft IS NULL) < count(*)),
upr AS (SELECT a.process_key, a.document_uuid, least(a.step_key, b.step_key) AS l, greatest(a.step_key, b.step_key) AS r, a.step_key < b.step_key AS fwd, a.bef AS pred, b.aft AS succ
  FROM uq a JOIN uq b ON a.process_key = b.process_key AND a.document_uuid = b.document_uuid AND a.r < b.r
  WHERE (a.process_key, a.step_key) IN (SELECT * FROM ust) AND (b.process_key, b.step_key) IN (SELECT * FROM ust)),
sp AS (SELECT process_key, l, r, count(*) AS n, min(pred) AS one FROM (SELECT process_key, l, r, pred FROM upr WHERE pred IS NOT NULL GROUP BY ALL HAVING count(DISTINCT fwd) = 2) q GROUP BY ALL),
ss AS (SELECT process_key, l, r, count(*) AS n FROM (SELECT process_key, l, r, succ FROM upr WHERE succ IS NOT NULL GROUP BY ALL HAVING count(DISTINCT fwd) = 2) q GROUP BY ALL),
pg AS (SELECT o.process_key, o.l AS left_step, o.r AS right_step, CASE WHEN sp.n = 1 THEN sp.one END AS after_step, forward, reverse_ AS reverse, """ + rnd("least(forward, reverse_) * 1.0 / (forward + reverse_)") + """ AS confidence, forward + reverse_ AS cases,
    CASE WHEN sp.n IS NOT NULL OR ss.n IS NOT NULL THEN 'both_orders' ELSE 'bidirectional' END AS reason
  FROM (SELECT process_key, l, r, count(*) FILTER (WHERE fwd) AS forward, count(*) FILTER (WHERE NOT fwd) AS reverse_ FROM upr GROUP BY ALL) o
  LEFT JOIN sp USING (process_key, l, r) LEFT JOIN ss USING (process_key, l, r) LEFT JOIN con ON con.process_key = o.process_key AND con.from_step = o.l AND con.to_step = o.r
  WHERE forward > 0 AND reverse_ > 0 AND (sp.n IS NOT NULL OR ss.n IS NOT NULL OR (con.observed >= 2 AND con.reverse >= 2)))"""
FALL = """pc AS (SELECT DISTINCT process_key, document_uuid, least(step_key, nxt) AS l, greatest(step_key, nxt) AS r FROM den WHERE nxt IS NOT NULL),
ends AS (SELECT process_key, document_uuid, arg_min(step_key, r) AS f, arg_max(step_key, r) AS la FROM uq GROUP BY ALL),
fb AS (SELECT c.process_key, c.from_step AS left_step, c.to_step AS right_step, any_value(observed) AS forward, any_value(reverse) AS reverse, count(*) AS cases
  FROM con c JOIN pc ON pc.process_key = c.process_key AND pc.l = c.from_step AND pc.r = c.to_step JOIN ends e ON e.process_key = pc.process_key AND e.document_uuid = pc.document_uuid
  WHERE observed >= 2 AND reverse >= 2 AND NOT EXISTS (SELECT 1 FROM pg WHERE pg.process_key = c.process_key AND pg.left_step = c.from_step AND pg.right_step = c.to_step)
  GROUP BY c.process_key, c.from_step, c.to_step HAVING count(*) >= 2 AND count(*) FILTER (WHERE f IN (c.from_step, c.to_step)) < count(*) AND count(*) FILTER (WHERE la IN (c.from_step, c.to_step)) < count(*))"""
RUNS = """rn AS (SELECT process_key, document_uuid, grp_no, any_value(step_key) AS step, count(*) AS len FROM (
    SELECT *, sum(CASE WHEN prv IS NULL OR prv <> step_key THEN 1 ELSE 0 END) OVER (PARTITION BY process_key, document_uuid ORDER BY pos) AS grp_no
    FROM (SELECT *, lag(step_key) OVER (PARTITION BY process_key, document_uuid ORDER BY pos) AS prv FROM dtl) q) z GROUP BY ALL),
rr AS (SELECT *, lag(step) OVER (PARTITION BY process_key, document_uuid ORDER BY grp_no) AS previous, lead(step) OVER (PARTITION BY process_key, document_uuid ORDER BY grp_no) AS following FROM rn)"""
CAND = f"""cand AS (SELECT d.process_key, d.step_key AS after_step, list_aggregate(list_sort(list(DISTINCT nxt)), 'string_agg', ',') AS next_steps, count(DISTINCT document_uuid) AS cases, {rnd('count(DISTINCT document_uuid) * 1.0 / any_value(t.n)')} AS coverage
  FROM den d JOIN (SELECT process_key, count(DISTINCT document_uuid) AS n FROM den WHERE nxt IS NOT NULL GROUP BY ALL) t USING (process_key) WHERE nxt IS NOT NULL GROUP BY d.process_key, d.step_key HAVING count(DISTINCT nxt) >= 2)"""
GAPS = f"{web_sql()}, gt AS (SELECT *, row_number() OVER (PARTITION BY document_uuid ORDER BY occurred_at, received_at, event_id) AS pos FROM web WHERE event_phase = 'after'), ge AS (SELECT *, lead(occurred_at) OVER (PARTITION BY document_uuid ORDER BY pos) AS nxt_at FROM (SELECT *, lag(step_key) OVER (PARTITION BY document_uuid ORDER BY pos) AS prv FROM gt) q WHERE prv IS NULL OR prv <> step_key), gaps AS (SELECT document_uuid, step_key, greatest(0, {sec('nxt_at')} - {sec('occurred_at')}) AS seconds FROM ge WHERE nxt_at IS NOT NULL)"

ORACLES = {
    "expected_graph": f"WITH {LOG_SQL}, {G_EDGES} SELECT g.template_key, from_node, to_node, label, style, coalesce(n, 0) AS events FROM g_edges g LEFT JOIN (SELECT process_key, step_key, count(*) AS n FROM log GROUP BY ALL) e ON e.process_key = g.template_key AND e.step_key = from_node",
    "project_transition": f"WITH {KPROJ} SELECT process_key AS template_key, step_key AS from_step, nxt AS to_step, classification, edges, count(*) AS observed FROM prj WHERE nxt IS NOT NULL GROUP BY ALL",
    "edge_metrics": f"""WITH {KPROJ}, {EDGE_ROWS}, {G_EDGES}, fe AS (SELECT DISTINCT template_key, from_node, to_node FROM g_edges WHERE style = 'flow'),
obs AS (SELECT process_key AS template_key, split_part(edge, '>', 1) AS from_node, split_part(edge, '>', 2) AS to_node, count(*) AS observed, count(*) FILTER (WHERE classification = 'UNEXPECTED') AS deviations, bool_and(classification = 'UNEXPECTED') AS bad FROM er GROUP BY ALL)
SELECT coalesce(o.template_key, f.template_key) AS template_key, coalesce(o.from_node, f.from_node) AS from_node, coalesce(o.to_node, f.to_node) AS to_node, coalesce(observed, 0) AS observed, coalesce(deviations, 0) AS deviations,
  f.template_key IS NOT NULL OR NOT bad AS is_expected, NOT (f.template_key IS NOT NULL OR NOT bad) AS is_observed_only FROM obs o FULL JOIN fe f ON f.template_key = o.template_key AND f.from_node = o.from_node AND f.to_node = o.to_node""",
    "node_flow": f"WITH {KPROJ}, {GROUP_DONE}, {FLOW_NODES} SELECT * FROM nf",
    "virtual_node_durations": f"WITH {KPROJ}, {GROUP_DONE}, {VIRTUAL} SELECT template_key, node_key, node_type, n, {rnd('avg_seconds')} AS avg_seconds, median_seconds, {rnd('p95_seconds')} AS p95_seconds, max_seconds FROM vst",
    "node_metrics": f"""WITH {KBASE_SQL}, {durations_sql()}, {KPROJ[len(LOG_SQL) + 2:]}, {GROUP_DONE}, {FLOW_NODES}, {VIRTUAL},
tsk AS (SELECT template_key, step_key AS node_id, 'task' AS node_type, completed + open AS observed, avg_minutes * 60 AS avg_seconds, median_minutes * 60 AS median_seconds, max_minutes * 60 AS p95_seconds, CASE WHEN step_key IN ('signup','placed') THEN 0 ELSE completed END AS reliable FROM dur
  UNION ALL SELECT template_key, node_key, node_type, n, avg_seconds, median_seconds, p95_seconds, n FROM vst)
SELECT coalesce(t.template_key, f.template_key) AS template_key, coalesce(t.node_id, f.node_id) AS node_id, coalesce(t.node_type, f.node_type) AS node_type, coalesce(t.observed, f.flow_count) AS observed,
  coalesce({rnd('avg_seconds', 3)}, 0) AS avg_seconds, coalesce({rnd('median_seconds', 3)}, 0) AS median_seconds, coalesce({rnd('p95_seconds', 3)}, 0) AS p95_seconds, reliable, coalesce(f.flow_count, 0) AS flow_count
FROM tsk t FULL JOIN nf f ON f.template_key = t.template_key AND f.node_id = t.node_id""",
    "duration_stats": f"WITH {GAPS} SELECT step_key, count(*) AS n, {rnd('sum(seconds) * 1.0 / count(*)')} AS avg_seconds, quantile_cont(seconds, 0.5) AS median_seconds, {rnd('quantile_cont(seconds, 0.95)')} AS p95_seconds, CAST(max(seconds) AS DOUBLE) AS max_seconds FROM gaps GROUP BY ALL",
    "relative_buckets": f"""WITH {GAPS}, u AS (SELECT document_uuid, CAST(sum(seconds) AS BIGINT) AS seconds FROM gaps GROUP BY ALL), q AS (SELECT quantile_cont(seconds, 0.1) AS lo, quantile_cont(seconds, 0.9) AS hi FROM u)
SELECT document_uuid, seconds, 'heat-' || CAST(CASE WHEN lo = hi THEN 2 ELSE floor((least(greatest(seconds, lo), hi) - lo) / (hi - lo) * 4) END AS INTEGER) AS bucket FROM u CROSS JOIN q""",
    "fixed_dwell_buckets": f"""WITH {GAPS} SELECT step_key, CASE WHEN seconds <= 300 THEN 'dwell-very-low' WHEN seconds <= 900 THEN 'dwell-low' WHEN seconds <= 1800 THEN 'dwell-moderate' WHEN seconds <= 3600 THEN 'dwell-warm' WHEN seconds <= 7200 THEN 'dwell-medium' WHEN seconds <= 14400 THEN 'dwell-high' WHEN seconds <= 28800 THEN 'dwell-very-high' ELSE 'dwell-critical' END AS bucket, count(*) AS n FROM gaps GROUP BY ALL""",
    "parallel_group_rollup": f"""WITH {KBASE_SQL}, {durations_sql()}, m(group_key, step_key) AS (VALUES ('browse','view'), ('browse','click'), ('paid','purchase'), ('paid','refund'), ('fixed','view'), ('fixed','purchase'))
SELECT 'web' AS template_key, group_key, CAST(sum(completed) AS BIGINT) AS completed, {rnd('sum(avg_minutes) / count(*)', 2)} AS avg_minutes, CAST(sum(open) AS BIGINT) AS open, max(greatest(duration_intensity, backlog_age_intensity, backlog_count_intensity)) AS intensity
FROM dur JOIN m USING (step_key) WHERE template_key = 'web' GROUP BY group_key""",
    "projection_summary": f"WITH {KPROJ} SELECT process_key AS template_key, count(DISTINCT document_uuid) AS cases, count(nxt) AS raw_pairs, CAST(sum(CASE WHEN nxt IS NULL OR edges = '' THEN 0 ELSE len(string_split(edges, ' ')) END) AS BIGINT) AS projected_edges, count(*) FILTER (WHERE classification = 'UNEXPECTED') AS unexpected_pairs FROM prj GROUP BY ALL",
    "skipped_cases": f"WITH {LOG_SQL} SELECT process_key, count(*) AS skipped, 'no_timeline_events' AS reason FROM (SELECT process_key, document_uuid FROM log GROUP BY ALL HAVING count(*) FILTER (WHERE event_phase = 'after' AND occurred_at <= TIMESTAMP '1999-01-01') = 0) q GROUP BY ALL",
    "normalize_step": "SELECT raw, lower(replace(replace(replace(replace(replace(replace(replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')) AS step FROM (SELECT '  Größe ' || p_name || chr(9) || ' ÄÖÜ  ' || p_brand AS raw FROM part) q",
    "discover_steps": f"{D_LOG} SELECT process_key, step_key AS step, step_key AS label, count(DISTINCT document_uuid) AS cases FROM den GROUP BY ALL",
    "discover_transitions": f"{D_LOG} SELECT process_key, from_step, to_step, observed, confidence, from_step AS from_label FROM dtr",
    "discover_transitions_chat": f"WITH {CHAT_SQL}, {DTL.format(src='chat')} SELECT process_key, from_step, to_step, observed, confidence FROM dtr",
    "conflicting_transitions": f"{D_LOG}, {CONF} SELECT * FROM con",
    "discover_parallel_groups": f"""WITH {web_sql('w0')}, w1 AS (SELECT * REPLACE ('after' AS event_phase) FROM w0 QUALIFY document_version = max(document_version) OVER (PARTITION BY document_uuid)),
framed AS (SELECT process_key, document_uuid, document_version, step_key, event_phase, occurred_at, received_at, event_id, external_event_key FROM w1
  UNION ALL SELECT 'web', document_uuid, document_version, 'arrive', 'after', min(occurred_at) - INTERVAL 1 MINUTE, min(occurred_at) - INTERVAL 1 MINUTE, NULL, 'arrive-' || document_uuid FROM w1 GROUP BY document_uuid, document_version
  UNION ALL SELECT 'web', document_uuid, document_version, 'leave', 'after', max(occurred_at) + INTERVAL 1 MINUTE, max(occurred_at) + INTERVAL 1 MINUTE, NULL, 'leave-' || document_uuid FROM w1 GROUP BY document_uuid, document_version),
{DTL.format(src='framed')}, {CONF}, {UNIQ} SELECT * FROM pg""",
    "discover_parallel_fallback": f"{D_LOG}, {CONF}, {UNIQ}, {FALL} SELECT process_key, left_step, right_step, forward, reverse, {rnd('least(forward, reverse) * 1.0 / (forward + reverse)')} AS confidence, cases FROM fb",
    "repeated_runs": f"{D_LOG}, {RUNS} SELECT process_key, step, step AS event_key, count(DISTINCT document_uuid) AS affected_cases, min(len) AS min_length, max(len) AS max_length, {rnd('sum(len) * 1.0 / count(*)', 2)} AS avg_length FROM rr WHERE len >= 2 GROUP BY ALL",
    "repeated_run_neighbours": f"{D_LOG}, {RUNS} SELECT process_key, step, 'previous' AS side, previous AS key, count(*) AS n FROM rr WHERE len >= 2 AND previous IS NOT NULL GROUP BY ALL UNION ALL SELECT process_key, step, 'following', following, count(*) FROM rr WHERE len >= 2 AND following IS NOT NULL GROUP BY ALL",
    "decision_candidates": f"{D_LOG}, {CAND} SELECT * FROM cand",
    "decision_field_evidence": f"""{D_LOG}, {snaps_sql()}, {attach_sql('log')}, {CAND},
mv AS (SELECT d.process_key, d.step_key AS step, d.nxt AS next_step, a.ctx FROM den d JOIN cand c ON c.process_key = d.process_key AND c.after_step = d.step_key JOIN att a ON a.document_uuid = d.document_uuid AND a.external_event_key = d.external_event_key AND a.process_key = d.process_key WHERE nxt IS NOT NULL),
fl AS (SELECT process_key, step, next_step, field, CAST(json_extract(ctx, '$.' || field) AS VARCHAR) AS v FROM (SELECT *, unnest(json_keys(ctx)) AS field FROM mv WHERE ctx IS NOT NULL) q WHERE json_type(ctx, '$.' || field) <> 'NULL'),
fs AS (SELECT process_key, step, field, count(*) AS present, count(DISTINCT v) AS distinct_values FROM fl GROUP BY ALL)
SELECT process_key, step, field, next_step, any_value(distinct_values) AS distinct_values, count(DISTINCT v) AS values_at_next, count(*) AS present_at_next, {rnd('any_value(present) * 1.0 / any_value(t.n)')} AS coverage
FROM fl JOIN fs USING (process_key, step, field) JOIN (SELECT process_key, step, count(*) AS n FROM mv GROUP BY ALL) t USING (process_key, step) WHERE distinct_values >= 2 GROUP BY ALL""",
    "values_by_next_step": f"""{D_LOG}, {snaps_sql()}, {attach_sql('log')}, {CAND},
mv AS (SELECT d.process_key, d.step_key AS step, d.nxt AS next_step, a.ctx FROM den d JOIN cand c ON c.process_key = d.process_key AND c.after_step = d.step_key JOIN att a ON a.document_uuid = d.document_uuid AND a.external_event_key = d.external_event_key AND a.process_key = d.process_key WHERE nxt IS NOT NULL),
fl AS (SELECT process_key, step, next_step, field, CAST(json_extract(ctx, '$.' || field) AS VARCHAR) AS v FROM (SELECT *, unnest(json_keys(ctx)) AS field FROM mv WHERE ctx IS NOT NULL) q WHERE json_type(ctx, '$.' || field) <> 'NULL')
SELECT process_key, step, field, next_step, regexp_replace(v, '\\.0$', '') AS value, count(*) AS n FROM fl WHERE (process_key, step, field) IN (SELECT (process_key, step, field) FROM fl GROUP BY process_key, step, field HAVING count(DISTINCT v) >= 2) GROUP BY ALL""",
    "expected_nodes": f"""WITH {LOG_SQL}, {G_EDGES},
ends AS (SELECT template_key, from_node AS node_id FROM g_edges UNION SELECT template_key, to_node FROM g_edges UNION VALUES ('web', '__end')),
own(template_key, node_id, required) AS (VALUES ('web','signup',true),('web','view',true),('web','click',true),('web','purchase',true),('web','refund',false),('orders','placed',true),('orders','shipped',true),('orders','returned',false))
SELECT template_key, node_id, CASE WHEN node_id = '__start' THEN 'start' WHEN node_id = '__end' THEN 'end' WHEN node_id LIKE 'decision:%' THEN 'exclusive_gateway' WHEN node_id LIKE 'parallel_start:%' THEN 'parallel_start' WHEN node_id LIKE 'parallel_join:%' THEN 'parallel_join' WHEN node_id LIKE 'parallel:%' THEN 'parallel_group' ELSE 'task' END AS node_type,
  CASE WHEN own.required IS NOT NULL THEN node_id END AS label, own.required, coalesce(n, 0) AS events
FROM ends LEFT JOIN own USING (template_key, node_id) LEFT JOIN (SELECT process_key AS template_key, step_key AS node_id, count(*) AS n FROM log GROUP BY ALL) c USING (template_key, node_id)""",
    "discover_single_case": f"{D_LOG}, {RUNS} SELECT document_uuid, grp_no AS step_no, step AS step_key, following AS next_step_key, len AS run_length FROM rr",
}
