"""Conformance checks, decisions, sign-off and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.functions import values as V
from casetrail.operators import conformance, decisions, findings, signoff
from casetrail.plans.catalog.common import BASE_SQL, templates, utc
from casetrail.plans.check import case_entries, check_processes, step_entries
from casetrail.sources import adapters as A
from casetrail.sources.scratch import held, staged

KEY = ["template_key", "document_uuid", "document_version"]


def _entries(spark, d):
    log, tpl = A.full_log(utc(spark), d), templates(spark)
    return case_entries(log, A.log_snapshots(log), tpl), tpl


def _steps(spark, d):
    tpl = templates(spark)
    return step_entries(A.full_log(utc(spark), d), tpl), tpl


def _profiles(spark, d):
    e, tpl = _steps(spark, d)
    return conformance.case_profiles(e, tpl)


def _check(spark, d):
    log, tpl = A.full_log(utc(spark), d), templates(spark)
    return check_processes(log, A.log_snapshots(log), tpl), tpl


def _evaluated(spark, d):
    e, tpl = _entries(spark, d)
    e = held(e)  # keeps the cases together, so that what is gathered per case needs no further shuffle
    p = staged(conformance.case_profiles(e, tpl), "profiles")
    return decisions.evaluate_decisions(e, tpl, p), tpl, p


def _groups(spark, d):
    ev, tpl, p = _evaluated(spark, d)
    return conformance.parallel_group_activation(p, decisions.activated_groups(ev))


def missing_steps(spark, d):
    return conformance.missing_steps(_profiles(spark, d)).select(*KEY, "message", "actual_step")


def unexpected_steps(spark, d):
    e, tpl = _steps(spark, d)
    return conformance.unexpected_steps(e, tpl).select(*KEY, "message", "ordinal")


def wrong_order(spark, d):
    return conformance.wrong_order(_profiles(spark, d)).select(*KEY, "message")


def transition_violations(spark, d):
    e, tpl = _steps(spark, d)
    return conformance.transition_violations(e, tpl).select(*KEY, "ordinal", "message", "from_step", "actual_step")


def parallel_group_activation(spark, d):
    return _groups(spark, d).select(*KEY, "group_key", "active", F.array_join("missing", ",").alias("missing"))


def parallel_group_incomplete(spark, d):
    return conformance.parallel_group_incomplete(_groups(spark, d)).select(*KEY, "message")


def parallel_group_next_missing(spark, d):
    return conformance.parallel_group_next_missing(_groups(spark, d)).select(*KEY, "message")


def parallel_group_messages(spark, d):
    return conformance.parallel_group_messages(_groups(spark, d)).select(*KEY, "group_key", "satisfied", "message")


def match_decision_rule(spark, d):
    """Every event with a context against both decision points of the web template."""
    tpl = templates(spark)
    log = A.web_log(utc(spark), d)
    obj = V.as_object(F.col("context"))
    web = next(iter(tpl))
    return log.select(
        "external_event_key",
        *[decisions.match_decision_rule(x, obj).alias(x["key"]) for x in web.decisions],
    )


def decision_rule_violations(spark, d):
    ev, tpl, p = _evaluated(spark, d)
    ev = staged(ev.drop("context", "sum_context"), "decisions")  # read twice, so that no decision is judged twice
    return decisions.decision_rule_violations(ev, tpl, p).select(*KEY, "decision_key", "after_step", "actual_step", "message")


def nearest_complete_context(spark, d):
    e, tpl = _entries(spark, d)
    n = decisions.nearest_complete_context(decisions.decision_entries(e, tpl), e, tpl)
    return n.select(*KEY, "decision_key", "entry", "context_distance")


def missing_decision_context(spark, d):
    return decisions.missing_decision_context(_evaluated(spark, d)[0]).select(*KEY, "decision_key", "message")


def context_freshness_issues(spark, d):
    i = decisions.context_freshness_issues(_evaluated(spark, d)[0])
    return i.select(*KEY, "decision_key", "context_issue", "sum_freshness")


def context_issue_details(spark, d):
    i = decisions.context_freshness_issues(_evaluated(spark, d)[0])
    return i.select(*KEY, "decision_key", "context_issue", "field", "freshness", "max_delay_seconds")


def decision_reasons(spark, d):
    ev, tpl, _ = _evaluated(spark, d)
    return decisions.decision_reasons(ev, tpl).select(*KEY, "decision_key", "rule", "expected", "actual_step", "field", "value_json")


def process_report(spark, d):
    c, _ = _check(spark, d)
    return findings.process_report(c.status, c.findings, c.issues)


def sign_checks(spark, d):
    e, tpl = _entries(spark, d)
    out = signoff.sign_checks(e, tpl)
    names = {c: F.array_join(c, ",") for c in ("missing_context", "missing_names", "unexpected_names")}
    return out.select(
        *KEY, "check_key", "status", "required_count", "actual_count", "matched_count", "missing_count",
        "unexpected_count", *[v.alias(k) for k, v in names.items()],
    )


STATUS = ["status", "report_status", "context_status", "sign_failures"]


def case_status(spark, d):
    return _check(spark, d)[0].status.select(*KEY, *STATUS)


def process_check_rows(spark, d):
    s = _check(spark, d)[0].status
    return s.select(*KEY, "report_status", "warning_count", "deviation_count", "context_issue_count")


def problem_score(spark, d):
    return _check(spark, d)[0].status.select(*KEY, "problem_score")


def problem_summary(spark, d):
    return findings.problem_summary(_check(spark, d)[0].findings)


def top_problem_cases(spark, d):
    top = findings.top_problem_cases(_check(spark, d)[0].status, 25)
    return top.select(*KEY, "problem_score", "deviation_count", "warning_count")


def graph_findings(spark, d):
    c, tpl = _check(spark, d)
    return findings.graph_findings(c.findings, tpl)


QUERIES = {
    "missing_steps": missing_steps,
    "unexpected_steps": unexpected_steps,
    "wrong_order": wrong_order,
    "transition_violations": transition_violations,
    "parallel_group_activation": parallel_group_activation,
    "parallel_group_incomplete": parallel_group_incomplete,
    "parallel_group_next_missing": parallel_group_next_missing,
    "parallel_group_messages": parallel_group_messages,
    "match_decision_rule": match_decision_rule,
    "decision_rule_violations": decision_rule_violations,
    "nearest_complete_context": nearest_complete_context,
    "missing_decision_context": missing_decision_context,
    "context_freshness_issues": context_freshness_issues,
    "sign_checks": sign_checks,
    "case_status": case_status,
    "process_check_rows": process_check_rows,
    "problem_score": problem_score,
    "problem_summary": problem_summary,
    "context_issue_details": context_issue_details,
    "decision_reasons": decision_reasons,
    "process_report": process_report,
    "top_problem_cases": top_problem_cases,
    "graph_findings": graph_findings,
}

# ------------------------------------------------------------------ SQL

K = "process_key AS template_key, document_uuid, document_version"
EXPECTED = "exp(p, i, step) AS (VALUES ('web',1,'signup'), ('web',2,'view'), ('web',3,'click'), ('web',4,'purchase'), ('orders',1,'placed'), ('orders',2,'shipped'))"
KNOWN = "known(p, step) AS (VALUES ('web','signup'), ('web','view'), ('web','click'), ('web','purchase'), ('web','refund'), ('orders','placed'), ('orders','shipped'), ('orders','returned'))"
TARGETS = """targets(p, step, allowed, shown) AS (VALUES ('web','signup',['view','click'],'view, click'), ('web','view',['click'],'click'),
  ('web','click',['purchase','view'],'purchase, view'), ('orders','placed',['shipped'],'shipped'), ('orders','shipped',['returned'],'returned'))"""
FIRST = "first_seen AS (SELECT process_key, document_uuid, document_version, step_key, min(entry) AS at FROM ent GROUP BY ALL)"
CASES = "cases AS (SELECT DISTINCT process_key, document_uuid, document_version FROM ent)"
SIDES = f"{EXPECTED}, {KNOWN}, {TARGETS}, {FIRST}, {CASES}"
HEAD = f"WITH {BASE_SQL}, {SIDES}"
SAME = "USING (process_key, document_uuid, document_version)"

MISS = f"""miss AS (SELECT {K}, 'Missing step: ' || step AS message, step AS actual_step FROM cases JOIN exp ON p = process_key
  WHERE NOT EXISTS (SELECT 1 FROM first_seen f WHERE f.process_key = cases.process_key AND f.document_uuid = cases.document_uuid AND f.document_version = cases.document_version AND f.step_key = step))"""
UNEXP = f"unexp AS (SELECT {K}, 'Unexpected step: ' || step_key AS message, entry AS ordinal FROM ent WHERE (process_key, step_key) NOT IN (SELECT p, step FROM known))"
WRONG = f"""wrong AS (SELECT DISTINCT a.{K.replace(', document', ', a.document')}, 'Wrong order' AS message FROM first_seen a JOIN first_seen b {SAME}
  JOIN exp x ON x.p = process_key AND x.step = a.step_key JOIN exp y ON y.p = process_key AND y.step = b.step_key
  WHERE x.i < y.i AND a.at > b.at AND NOT (a.step_key IN ('view','click') AND b.step_key IN ('view','click')))"""
TRANS = f"""trans AS (SELECT {K}, entry AS ordinal, 'Transition violation: ' || step_key || ' expected one of ' || shown || ' but got ' || nxt AS message, step_key AS from_step, nxt AS actual_step
  FROM (SELECT *, lead(step_key) OVER (PARTITION BY process_key, document_uuid, document_version ORDER BY entry) AS nxt FROM ent) e
  JOIN targets ON p = process_key AND step = step_key WHERE nxt IS NOT NULL AND NOT list_contains(allowed, nxt))"""

DECISIONS = f"""dec(p, dpos, dkey, after_step) AS (VALUES ('web',0,'after_click','click'), ('web',1,'after_purchase','purchase'), ('web',2,'after_refund','refund'), ('orders',0,'after_placed','placed')),
filled AS (SELECT *, lead(step_key) OVER (PARTITION BY process_key, document_uuid, document_version ORDER BY entry) AS nxt,
  coalesce(f_k NOT IN ('null','""','[]','{{}}'), FALSE) AS has_k, coalesce(f_flag NOT IN ('null','""','[]','{{}}'), FALSE) AS has_flag,
  coalesce(f_value NOT IN ('null','""','[]','{{}}'), FALSE) AS has_value, coalesce(f_band NOT IN ('null','""','[]','{{}}'), FALSE) AS has_band,
  coalesce(f_status NOT IN ('null','""','[]','{{}}'), FALSE) AS has_status FROM ent),
at_dec AS (SELECT f.*, dpos, dkey, after_step,
    CASE dkey WHEN 'after_click' THEN has_k AND has_flag WHEN 'after_purchase' THEN has_value AND has_band WHEN 'after_refund' THEN has_k ELSE has_status END AS complete
  FROM filled f JOIN dec ON p = process_key AND after_step = step_key
  QUALIFY row_number() OVER (PARTITION BY process_key, document_uuid, document_version, dkey ORDER BY entry) = 1),
near AS (SELECT a.process_key, a.document_uuid, a.document_version, a.dkey, b.entry - a.entry AS distance, b.f_k, b.f_flag, b.f_value, b.f_band, b.f_status
  FROM at_dec a JOIN filled b ON a.process_key = b.process_key AND a.document_uuid = b.document_uuid AND a.document_version = b.document_version AND b.entry <> a.entry
  WHERE NOT a.complete AND CASE a.dkey WHEN 'after_click' THEN b.has_k AND b.has_flag WHEN 'after_purchase' THEN b.has_value AND b.has_band WHEN 'after_refund' THEN b.has_k ELSE b.has_status END
  QUALIFY row_number() OVER (PARTITION BY a.process_key, a.document_uuid, a.document_version, a.dkey ORDER BY abs(b.entry - a.entry), b.entry > a.entry) = 1),
ctx AS (SELECT a.process_key, a.document_uuid, a.document_version, a.dkey, a.dpos, a.after_step, a.entry, a.nxt, a.sum_context, a.sum_freshness, coalesce(n.distance, 0) AS distance,
    a.has_ctx OR n.dkey IS NOT NULL AS has_ctx,
    CASE WHEN n.dkey IS NULL THEN a.f_k ELSE n.f_k END AS k, CASE WHEN n.dkey IS NULL THEN a.f_flag ELSE n.f_flag END AS flag,
    CASE WHEN n.dkey IS NULL THEN a.f_value ELSE n.f_value END AS value, CASE WHEN n.dkey IS NULL THEN a.f_band ELSE n.f_band END AS band,
    CASE WHEN n.dkey IS NULL THEN a.f_status ELSE n.f_status END AS status
  FROM at_dec a LEFT JOIN near n ON a.process_key = n.process_key AND a.document_uuid = n.document_uuid AND a.document_version = n.document_version AND a.dkey = n.dkey),
lacks AS (SELECT *, CASE dkey WHEN 'after_click' THEN list_filter([CASE WHEN coalesce(k, 'null') IN ('null','""') THEN 'k' END, CASE WHEN coalesce(flag, 'null') IN ('null','""') THEN 'flag' END], lambda x: x IS NOT NULL)
    WHEN 'after_purchase' THEN list_filter([CASE WHEN coalesce(value, 'null') IN ('null','""') THEN 'value' END, CASE WHEN coalesce(band, 'null') IN ('null','""') THEN 'band' END], lambda x: x IS NOT NULL)
    ELSE list_filter([CASE WHEN coalesce(status, 'null') IN ('null','""') THEN 'status' END], lambda x: x IS NOT NULL) END AS missing,
    CASE WHEN dkey <> 'after_click' THEN NULL WHEN sum_context IS NULL OR NOT json_exists(sum_context, '$.k') THEN 'UNCHECKABLE_CONTEXT_MISSING'
      WHEN sum_freshness < 0 THEN 'UNCERTAIN_CONTEXT_TIME_SKEW' WHEN sum_freshness > 300 THEN 'UNCERTAIN_CONTEXT_STALE' END AS issue FROM ctx),
wants AS (SELECT *, CASE WHEN issue IS NOT NULL OR len(missing) > 0 OR NOT has_ctx THEN NULL
    WHEN dkey = 'after_click' THEN CASE WHEN CAST(k AS DOUBLE) > 80 THEN 'purchase' WHEN CAST(k AS DOUBLE) < 20 THEN 'view' WHEN flag NOT IN ('null','false','""','"0"','0') THEN 'browse' ELSE 'click' END
    WHEN dkey = 'after_purchase' THEN CASE WHEN CAST(value AS DOUBLE) >= 50 THEN 'signup' WHEN band IN ('"low"','"mid"') THEN 'view' ELSE 'refund' END
    WHEN dkey = 'after_placed' THEN CASE WHEN status = '"P"' THEN 'returned' ELSE 'shipped' END END AS want FROM lacks),
both_seen AS (SELECT process_key, document_uuid, document_version FROM first_seen WHERE process_key = 'web' AND step_key IN ('view','click') GROUP BY ALL HAVING count(*) = 2),
ev AS (SELECT w.*, CASE WHEN want IS NULL THEN FALSE WHEN want = 'browse' THEN coalesce(nxt NOT IN ('view','click'), TRUE)
    ELSE coalesce(nxt <> want, TRUE) AND NOT coalesce(want IN ('view','click') AND nxt IN ('view','click') AND w.process_key = 'web' AND b.document_uuid IS NOT NULL, FALSE) END AS violated
  FROM wants w LEFT JOIN both_seen b {SAME})"""
DVIOL = f"""dviol AS (
  SELECT {K}, dkey AS decision_key, after_step, nxt AS actual_step, 'Decision rule violation: ' || dkey || ' after ' || after_step || ' expected ' || CASE WHEN want = 'browse' THEN 'parallel group browse' ELSE want END || ' but got ' || coalesce(nxt, 'none') AS message FROM ev WHERE violated
  UNION ALL
  SELECT DISTINCT e.process_key, e.document_uuid, e.document_version, d.dkey, d.after_step, CAST(NULL AS VARCHAR), 'Decision rule violation: ' || d.dkey || ' after step ' || d.after_step || ' not found'
  FROM ev e JOIN dec d ON d.p = e.process_key AND d.dpos > e.dpos AND d.after_step = e.want
  WHERE NOT EXISTS (SELECT 1 FROM first_seen f WHERE f.process_key = e.process_key AND f.document_uuid = e.document_uuid AND f.document_version = e.document_version AND f.step_key = d.after_step))"""
DMISS = f"dmiss AS (SELECT {K}, dkey AS decision_key, 'Missing context for decision point ' || dkey || ': ' || array_to_string(missing, ', ') AS message FROM ev WHERE issue IS NULL AND len(missing) > 0)"
GROUPS = f"""grp AS (
  SELECT c.process_key AS template_key, c.document_uuid, c.document_version, g.gk AS group_key, g.nx, array_to_string(list_filter(g.req, lambda s: NOT list_contains(coalesce(seen, []), s)), ',') AS missing,
    array_to_string(list_filter(g.req, lambda s: NOT list_contains(coalesce(seen, []), s)), ', ') AS missing_shown,
    g.gk = 'paid' OR list_contains(coalesce(seen, []), 'signup') OR chosen.document_uuid IS NOT NULL AS active, coalesce(list_contains(seen, g.nx), FALSE) AS next_seen
  FROM cases c JOIN (VALUES ('browse', ['view','click'], 'purchase'), ('paid', ['purchase','refund'], NULL)) g(gk, req, nx) ON c.process_key = 'web'
  LEFT JOIN (SELECT process_key, document_uuid, document_version, list(step_key) AS seen FROM first_seen GROUP BY ALL) s {SAME}
  LEFT JOIN (SELECT DISTINCT process_key, document_uuid, document_version FROM ev WHERE want = 'browse') chosen ON g.gk = 'browse' AND chosen.process_key = c.process_key AND chosen.document_uuid = c.document_uuid AND chosen.document_version = c.document_version)"""
INCOMPLETE = "'Parallel Group incomplete: ' || group_key || ' (missing: ' || missing_shown || ')'"
GINC = f"ginc AS (SELECT template_key, document_uuid, document_version, {INCOMPLETE} AS message FROM grp WHERE active AND missing <> '')"
GNEXT = "gnext AS (SELECT template_key, document_uuid, document_version, 'Missing next after parallel group: ' || group_key || ' -> ' || nx AS message FROM grp WHERE active AND missing = '' AND nx IS NOT NULL AND NOT next_seen)"
HEAD_D = f"{HEAD}, {DECISIONS}"
HEAD_G = f"{HEAD_D}, {GROUPS}"

SIGN = """sgn_ctx AS (SELECT process_key, document_uuid, document_version, arg_max(sum_context, entry) FILTER (WHERE json_exists(sum_context, '$.req') OR json_exists(sum_context, '$.act')) AS c FROM ent WHERE process_key = 'web' GROUP BY ALL),
sgn_sets AS (SELECT *, json_exists(c, '$.req') AS has_req, json_exists(c, '$.act') AS has_act,
  list_distinct([json_extract_string(c, '$.req[0].name'), json_extract_string(c, '$.req[1].id')]) AS req,
  list_distinct([trim(x) FOR x IN string_split(json_extract_string(c, '$.act'), ';')]) AS act FROM sgn_ctx),
sgn_n AS (SELECT *, coalesce(has_req, FALSE) AND coalesce(has_act, FALSE) AS ok, CASE WHEN has_req AND has_act THEN list_filter(req, lambda x: NOT list_contains(act, x)) ELSE [] END AS mis,
  CASE WHEN has_req AND has_act THEN list_filter(act, lambda x: NOT list_contains(req, x)) ELSE [] END AS extra FROM sgn_sets),
sgn AS (SELECT process_key AS template_key, document_uuid, document_version, 'signoff' AS check_key,
  CASE WHEN NOT ok THEN 'missing_context' WHEN len(mis) = 0 AND len(extra) = 0 THEN 'satisfied' WHEN len(mis) = 0 THEN 'unexpected_signer' WHEN len(mis) = len(req) THEN 'missing_all' ELSE 'partial' END AS status,
  CASE WHEN ok THEN len(req) ELSE 0 END AS required_count, CASE WHEN ok THEN len(act) ELSE 0 END AS actual_count, CASE WHEN ok THEN len(req) - len(mis) ELSE 0 END AS matched_count, len(mis) AS missing_count, len(extra) AS unexpected_count,
  array_to_string(list_filter([CASE WHEN NOT coalesce(has_req, FALSE) THEN 'req' END, CASE WHEN NOT coalesce(has_act, FALSE) THEN 'act' END], lambda x: x IS NOT NULL), ',') AS missing_context, mis, extra FROM sgn_n)"""

ALL_FOUND = """found AS (SELECT template_key, document_uuid, document_version, message, 'process' AS target, 'process' AS target_label FROM miss
  UNION ALL SELECT template_key, document_uuid, document_version, message, 'process', 'process' FROM unexp
  UNION ALL SELECT template_key, document_uuid, document_version, message, 'process', 'process' FROM wrong
  UNION ALL SELECT template_key, document_uuid, document_version, message, 'transition', from_step || ' -> ' || actual_step FROM trans
  UNION ALL SELECT template_key, document_uuid, document_version, message, 'process', 'process' FROM ginc
  UNION ALL SELECT template_key, document_uuid, document_version, message, 'process', 'process' FROM gnext
  UNION ALL SELECT template_key, document_uuid, document_version, message, 'gateway', decision_key FROM dmiss
  UNION ALL SELECT template_key, document_uuid, document_version, message, 'gateway', decision_key FROM dviol)"""
LABEL = "CASE WHEN message LIKE 'Missing context for decision point %' THEN 'Missing context ' || regexp_extract(message, 'point ([^:]+):', 1) ELSE split_part(message, ':', 1) END"
STATUS_SQL = f"""issues AS (SELECT process_key AS template_key, document_uuid, document_version, count(*) AS context_issue_count,
  arg_max(issue, CASE issue WHEN 'UNCHECKABLE_CONTEXT_MISSING' THEN 3 WHEN 'UNCERTAIN_CONTEXT_TIME_SKEW' THEN 2 ELSE 1 END) AS context_status FROM ev WHERE issue IS NOT NULL GROUP BY ALL),
per AS (SELECT template_key, document_uuid, document_version, count(*) AS n, count(*) FILTER (WHERE message NOT LIKE 'Missing context %') AS hard,
  sum(CASE {LABEL} WHEN 'Missing step' THEN 3 WHEN 'Decision rule violation' THEN 2 WHEN 'Parallel Group incomplete' THEN 2 ELSE 1 END) AS score FROM found GROUP BY ALL),
stat AS (SELECT c.process_key AS template_key, c.document_uuid, c.document_version, coalesce(n, 0) AS n, coalesce(hard, 0) AS hard, coalesce(context_issue_count, 0) AS context_issue_count, context_status,
    CASE WHEN s.status IS NOT NULL AND s.status NOT IN ('satisfied','unexpected_signer') THEN 1 ELSE 0 END AS sign_failures, score
  FROM cases c LEFT JOIN per p ON p.template_key = c.process_key AND p.document_uuid = c.document_uuid AND p.document_version = c.document_version
  LEFT JOIN issues i ON i.template_key = c.process_key AND i.document_uuid = c.document_uuid AND i.document_version = c.document_version
  LEFT JOIN sgn s ON s.template_key = c.process_key AND s.document_uuid = c.document_uuid AND s.document_version = c.document_version),
st AS (SELECT *, CASE WHEN n > 0 OR sign_failures > 0 THEN 'DEVIATION' WHEN context_status IS NOT NULL THEN context_status ELSE 'OK' END AS status FROM stat),
rep AS (SELECT *, CASE WHEN status LIKE 'UNC%' THEN status WHEN n = 0 THEN 'OK' WHEN hard > 0 THEN 'DEVIATION' ELSE 'WARNING' END AS report_status FROM st),
rows_ AS (SELECT *, CASE WHEN report_status = 'WARNING' THEN n ELSE 0 END AS warning_count, CASE WHEN report_status = 'DEVIATION' THEN n ELSE 0 END AS deviation_count,
  CAST(CASE WHEN report_status = 'DEVIATION' THEN score ELSE 0 END + CASE WHEN context_issue_count > 0 THEN 1 ELSE 0 END AS BIGINT) AS problem_score FROM rep)"""
FULL = f"{HEAD_G}, {MISS}, {UNEXP}, {WRONG}, {TRANS}, {DVIOL}, {DMISS}, {GINC}, {GNEXT}, {SIGN}, {ALL_FOUND}, {STATUS_SQL}"
KS = "template_key, document_uuid, document_version"

ORACLES = {
    "missing_steps": f"{HEAD}, {MISS} SELECT * FROM miss",
    "unexpected_steps": f"{HEAD}, {UNEXP} SELECT * FROM unexp",
    "wrong_order": f"{HEAD}, {WRONG} SELECT * FROM wrong",
    "transition_violations": f"{HEAD}, {TRANS} SELECT * FROM trans",
    "parallel_group_activation": f"{HEAD_G} SELECT {KS}, group_key, active, missing FROM grp",
    "parallel_group_incomplete": f"{HEAD_G}, {GINC} SELECT * FROM ginc",
    "parallel_group_next_missing": f"{HEAD_G}, {GNEXT} SELECT * FROM gnext",
    "parallel_group_messages": f"{HEAD_G} SELECT {KS}, group_key, missing = '' AS satisfied, CASE WHEN missing <> '' THEN {INCOMPLETE} ELSE 'Parallel Group satisfied: ' || group_key || CASE WHEN nx IS NULL THEN '' ELSE ' (next: ' || nx || ')' END END AS message FROM grp WHERE active",
    "match_decision_rule": f"""WITH {BASE_SQL.split(',' + chr(10) + 'ord AS')[0]}
SELECT external_event_key,
  CASE WHEN CAST(c->>'$.k' AS DOUBLE) > 80 THEN 0 WHEN CAST(c->>'$.k' AS DOUBLE) < 20 THEN 1 WHEN json_type(c, '$.flag') IN ('BOOLEAN', 'VARCHAR') THEN 2 ELSE 3 END AS after_click,
  CASE WHEN CAST(c->>'$.value' AS DOUBLE) >= 50 THEN 0 WHEN c->>'$.band' IN ('low','mid') THEN 1 ELSE 2 END AS after_purchase,
  CASE WHEN c->>'$.k' IS NOT NULL THEN 0 END AS after_refund
FROM (SELECT external_event_key, CAST(context AS JSON) AS c FROM web) x""",
    "decision_rule_violations": f"{HEAD_D}, {DVIOL} SELECT * FROM dviol",
    "nearest_complete_context": f"{HEAD_D} SELECT {K}, dkey AS decision_key, entry, distance AS context_distance FROM ctx",
    "missing_decision_context": f"{HEAD_D}, {DMISS} SELECT * FROM dmiss",
    "context_freshness_issues": f"{HEAD_D} SELECT {K}, dkey AS decision_key, issue AS context_issue, sum_freshness FROM ev WHERE issue IS NOT NULL",
    "sign_checks": f"WITH {BASE_SQL}, {SIGN} SELECT {KS}, check_key, status, required_count, actual_count, matched_count, missing_count, unexpected_count, missing_context, array_to_string(mis, ',') AS missing_names, array_to_string(extra, ',') AS unexpected_names FROM sgn",
    "case_status": f"{FULL} SELECT {KS}, status, report_status, context_status, sign_failures FROM rows_",
    "process_check_rows": f"{FULL} SELECT {KS}, report_status, warning_count, deviation_count, context_issue_count FROM rows_",
    "problem_score": f"{FULL} SELECT {KS}, problem_score FROM rows_",
    "context_issue_details": f"{HEAD_D} SELECT {K}, dkey AS decision_key, issue AS context_issue, 'k' AS field, sum_freshness AS freshness, 300 AS max_delay_seconds FROM ev WHERE issue IS NOT NULL",
    "decision_reasons": f"""{HEAD_D}, why AS (SELECT {K}, dkey AS decision_key, want AS expected, nxt AS actual_step,
    CASE WHEN dkey = 'after_click' THEN CASE want WHEN 'purchase' THEN 'k gt 80' WHEN 'view' THEN 'k lt 20' WHEN 'browse' THEN 'flag eq true' ELSE 'else' END
      WHEN dkey = 'after_purchase' THEN CASE want WHEN 'signup' THEN 'value gte 50' WHEN 'view' THEN 'band in ["low","mid"]' ELSE 'else' END
      ELSE CASE want WHEN 'returned' THEN 'status eq "P"' ELSE 'else' END END AS rule,
    unnest(CASE WHEN dkey = 'after_click' THEN [struct_pack(f := 'k', v := k), struct_pack(f := 'flag', v := flag)]
      WHEN dkey = 'after_purchase' THEN [struct_pack(f := 'value', v := value), struct_pack(f := 'band', v := band)] ELSE [struct_pack(f := 'status', v := status)] END) AS x
  FROM ev WHERE violated) SELECT template_key, document_uuid, document_version, decision_key, rule, expected, actual_step, x.f AS field, x.v AS value_json FROM why""",
    "process_report": f"""{FULL} SELECT template_key, 'documents' AS section, 'total' AS label, count(*) AS n FROM rows_ GROUP BY ALL
  UNION ALL SELECT template_key, 'status', report_status, count(*) FROM rows_ GROUP BY ALL
  UNION ALL SELECT template_key, 'context_status', context_status, count(*) FROM rows_ WHERE context_status IS NOT NULL GROUP BY ALL
  UNION ALL SELECT f.template_key, CASE WHEN report_status = 'DEVIATION' THEN 'deviation_summary' ELSE 'warning_summary' END AS section, {LABEL} AS label, count(*) FROM found f JOIN rows_ r USING (template_key, document_uuid, document_version) WHERE report_status IN ('DEVIATION', 'WARNING') GROUP BY ALL
  UNION ALL SELECT process_key, 'context_issue_summary', CASE issue WHEN 'UNCHECKABLE_CONTEXT_MISSING' THEN 'Uncheckable context missing' WHEN 'UNCERTAIN_CONTEXT_TIME_SKEW' THEN 'Uncertain context time skew' ELSE 'Uncertain context stale' END, count(*) FROM ev WHERE issue IS NOT NULL GROUP BY ALL""",
    "problem_summary": f"{FULL} SELECT template_key, {LABEL} AS problem, count(*) AS findings FROM found GROUP BY ALL",
    "top_problem_cases": f"{FULL} SELECT {KS}, problem_score, deviation_count, warning_count FROM rows_ WHERE problem_score > 0 ORDER BY problem_score DESC, deviation_count + warning_count DESC, document_uuid, template_key LIMIT 25",
    "graph_findings": f"{FULL} SELECT template_key, target, target_label, count(*) AS finding_count, count(DISTINCT document_uuid) AS case_count FROM found GROUP BY ALL",
}
