"""Visibility, findings of cases, tagged documents and sign-off lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.functions import text
from casetrail.operators import cases, documents, findings, signoff, visibility
from casetrail.plans.catalog.checks import FULL
from casetrail.plans.catalog.common import WEB, attach_sql, rnd, sec, snaps_sql, utc, web_sql
from casetrail.plans.catalog.contexts import _nodes, _tags
from casetrail.plans.check import check_processes
from casetrail.plans.templates import TemplateSet, small_table
from casetrail.sources import adapters as A

SEEN = {
    **WEB,
    "steps": [
        {"key": "signup", "visibility": [{"key": "open", "profile": "public"}, {"key": "odd", "profile": "nowhere"}]},
        {"key": "view", "visibility": [{"key": "banded", "resolver": "by_band"}, {"key": "none"}]},
        {"key": "click", "visibility": [{"key": "early", "phase": "before", "profile": "closed"}]},
        {"key": "purchase", "visibility": [{"key": "lost", "resolver": "missing"}]},
        {"key": "refund", "required": False},
    ],
    "access_probes": {"p_even": {}, "p_low": {"max_documents": 30}, "p_all": {"max_documents": 60}},
    "visibility_profiles": {
        "public": {"visible_in": ["p_even", "p_gone"], "hidden_in": ["p_low"]},
        "closed": {"hidden_in": ["p_even", "p_all"]},
    },
    "visibility_resolvers": {"by_band": {"field": "band", "map": {"low": "public", "high": "closed", "mid": "unknown"}}},
}


def _tpl(spark):
    return TemplateSet(spark, [SEEN])


def _members(spark, d):
    u = A.table(utc(spark), d, "events").select("user_id").distinct()
    who = F.concat(F.lit("user-"), F.col("user_id"))
    even = u.filter("user_id % 2 = 0").select(F.lit("p_even").alias("probe_key"), who.alias("document_uuid"), F.col("user_id").alias("member_pos"))
    low = u.filter("user_id < 50").select(F.lit("p_low"), who, F.col("user_id"))
    every = u.select(F.lit("p_all"), who, F.col("user_id"))
    return even.union(low).union(every)


def _probes(spark):
    return small_table(spark, [("p_even", None), ("p_low", 30), ("p_all", 60)], "probe_key string, max_documents int")


def _observed(spark, d):
    u = A.table(spark, d, "events").select(F.concat(F.lit("user-"), F.col("user_id")).alias("document_uuid")).distinct()
    pairs = u.select("document_uuid", F.explode(F.array(*[F.lit(p) for p in ("p_even", "p_low", "p_all")])).alias("probe_key"))
    return visibility.probe_membership(pairs, _members(spark, d), _probes(spark))


def _resolved(spark, d):
    log = A.web_log(utc(spark), d)
    return visibility.resolve_profile(cases.attach_snapshots(log, A.log_snapshots(log)), _tpl(spark))


def _results(spark, d):
    return visibility.evaluate_visibility(_resolved(spark, d), _observed(spark, d), _tpl(spark))


def resolve_profile(spark, d):
    return _resolved(spark, d).select("external_event_key", "check_key", "profile_key", "reason")


def probe_membership(spark, d):
    return _observed(spark, d)


def evaluate_visibility(spark, d):
    return _results(spark, d).select("external_event_key", "check_key", "profile_key", "probe_key", "expected", "actual", "status", "reason")


def visibility_results(spark, d):
    r = visibility.visibility_results(_results(spark, d), "user-8", "web")
    return r.select("check_key", "probe_key", "status", F.unix_seconds("checked_at").alias("checked_at"))


def visibility_timeline(spark, d):
    t = visibility.visibility_timeline(_results(spark, d))
    return t.select("document_uuid", "step_key", "event_phase", "check_key", F.unix_micros("checked_at").alias("checked_at"), "probes", "ok")


# ------------------------------------------------------------------ findings of cases


def _found(spark, d):
    log, tpl = A.web_log(utc(spark), d), _tpl(spark)
    c = check_processes(log, A.log_snapshots(log), tpl)
    return findings.case_findings(c.findings, c.issues, c.status, _results(spark, d)), c, tpl


def case_findings(spark, d):
    f, _, _ = _found(spark, d)
    return findings.case_finding_counts(f, ["document_uuid"])


def findings_of_journey(spark, d):
    f, _, _ = _found(spark, d)
    return findings.case_finding_counts(f, ["document_uuid", "template_key"]).select("document_uuid", "template_key", "findings", "overall")


def step_severity(spark, d):
    f, _, tpl = _found(spark, d)
    return findings.step_severity(f, tpl)


def filter_cases_by_finding(spark, d):
    f, c, _ = _found(spark, d)
    cs = c.profiles.select("document_uuid")
    hit = findings.filter_cases_by_finding(cs, f, decision="after_click", transition=("click", "error"))
    sev = findings.filter_cases_by_finding(cs, f, severity="critical", step="signup")
    return hit.withColumn("filter", F.lit("graph")).unionByName(sev.withColumn("filter", F.lit("severity")))


# ------------------------------------------------------------------ tagged documents


def dedup_documents(spark, d):
    """Line items as deliveries of the same order, some without order id."""
    li = A.table(utc(spark), d, "lineitem").select(
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_orderkey")).alias("doc_id"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        F.col("l_partkey").alias("part"),
    )
    return documents.dedup_documents(li).select("doc_id", "part", "copies")


def document_matrix(spark, d):
    fields = {"size": "d-size", "price": "d-price", "brand": "d-brand"}
    return documents.document_matrix(_tags(utc(spark), d), fields, _nodes(spark, d))


def expand_split_rows(spark, d):
    """Orders as documents: date and status once, line tags once per line."""
    o = A.table(utc(spark), d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("tag_pos"), F.lit("status").alias("definition_id"),
        F.lit("").alias("group_definition"), F.lit("").alias("group_id"), F.col("o_orderstatus").alias("value"),
    )
    li = A.table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").cast("int").alias("q"), F.min("l_suppkey").alias("s"))
    tags = li.select(
        F.col("l_orderkey").alias("doc_id"), F.inline(F.array(
            F.struct((F.col("l_partkey") * 2).cast("int").alias("tag_pos"), F.lit("qty").alias("definition_id"), F.col("q").cast("string").alias("value")),
            F.struct((F.col("l_partkey") * 2 + 1).cast("int").alias("tag_pos"), F.lit("supplier").alias("definition_id"), F.col("s").cast("string").alias("value")),
        )), F.lit("line").alias("group_definition"), F.col("l_partkey").cast("string").alias("group_id"),
    )
    return documents.expand_split_rows(o.unionByName(tags))


def split_by_period(spark, d):
    o = A.table(utc(spark), d, "orders").select("o_totalprice", F.col("o_orderdate").cast("timestamp").alias("at"))
    return documents.split_by_period(o, text.fmt_date(F.col("at"))).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


def format_values(spark, d):
    p = A.table(utc(spark), d, "part")
    cents = F.round(F.col("p_retailprice") * 10000).cast("long")
    return p.select(
        "p_partkey",
        text.fmt_number(cents, 2).alias("price"),
        text.fmt_number(cents, 0, ".").alias("whole"),
        text.fmt_first(F.col("p_name"), 4).alias("first4"),
        text.fmt_slice(F.col("p_name"), 2, 3).alias("slice"),
        text.fmt_prefix(F.col("p_type"), "T-").alias("prefixed"),
        text.fmt_no_blanks(F.col("p_name")).alias("joined"),
    )


def format_if(spark, d):
    p = A.table(utc(spark), d, "part")
    rules = [("STARTSWITH", "red", "R"), ("ENDSWITH", "bolt", "B"), ("E", "hot gear", "HG")]
    size = [("L", "10", "small"), ("LE", "20", "mid"), ("GE", "45", "huge"), ("G", "40", "big")]
    return p.select("p_partkey", text.fmt_if(F.col("p_name"), rules, "-").alias("by_name"), text.fmt_if(F.col("p_size").cast("string"), size, "large").alias("by_size"))


def net_of_tax(spark, d):
    rates = A.table(utc(spark), d, "nation").select(F.col("n_nationkey").alias("tax_code"), (F.col("n_nationkey") % 3 * 6 + 7).cast("double").alias("rate")).filter("tax_code < 20")
    c = A.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return documents.net_of_tax(c, rates, "c_acctbal", "c_nationkey").select("c_custkey", "net")


def map_by_doctype(spark, d):
    texts = A.table(utc(spark), d, "region").select(F.col("r_regionkey").alias("doctype"), F.col("r_name").alias("text")).filter("doctype < 3")
    n = A.table(spark, d, "nation").join(A.table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return documents.map_by_doctype(n.select("c_custkey", "n_name", "n_regionkey"), texts, "n_regionkey", F.col("n_name")).select("c_custkey", "doctype_text")


def row_counter(spark, d):
    o = A.table(utc(spark), d, "orders").select("o_orderkey", "o_orderdate")
    return documents.row_counter(o, ["o_orderdate", "o_orderkey"], 1000).select("o_orderkey", "counter")


def calculated_column(spark, d):
    li = A.table(utc(spark), d, "lineitem")
    c = documents.calculated_column(li, "net", "CASE WHEN l_discount > 0.05 THEN 'D' ELSE concat('N', l_linenumber) END")
    return c.groupBy("net").agg(F.count(F.lit(1)).alias("n"))


def clean_export_text(spark, d):
    t = A.table(utc(spark), d, "conversations")
    return t.select("conv_id", "turn", text.clean_export_text(F.concat(F.lit(" a|b\t"), "text"), 40).alias("clean"))


def _sides(spark, d):
    li = A.table(utc(spark), d, "lineitem")
    name = F.concat(F.lit(" Supplier "), F.col("l_suppkey"))
    req = li.groupBy(F.col("l_orderkey").alias("doc_id"), name.alias("name")).agg(F.min("l_linenumber").alias("pos"))
    act = li.filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("doc_id"), F.upper(name).alias("name")).agg(F.min("l_linenumber").alias("pos"))
    extra = A.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc_id"), F.lit("Guest").alias("name"), F.lit(99).alias("pos"))
    return req, act.unionByName(extra), A.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))


def signature_completeness(spark, d):
    req, act, _ = _sides(spark, d)
    return signoff.signature_completeness(req, act)


def signature_report(spark, d):
    req, act, docs = _sides(spark, d)
    r = signoff.signature_report(signoff.signature_completeness(req, act), docs)
    return r.select("doc_id", "required_count", "confirmed_count", "missing_count", "unexpected_count", "result")


def signature_summary(spark, d):
    req, act, docs = _sides(spark, d)
    return signoff.signature_summary(signoff.signature_report(signoff.signature_completeness(req, act), docs))


def latest_change(spark, d):
    li = A.table(utc(spark), d, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("changed_at"))
    return documents.latest_change(li).select(F.unix_seconds("latest_change").alias("latest_change"))


def extract_tag_values(spark, d):
    return documents.extract_tag_values(_tags(utc(spark), d), "d-brand", _nodes(spark, d)).select("doc_id", "name")


QUERIES = {
    f.__name__: f
    for f in (
        resolve_profile, probe_membership, evaluate_visibility, visibility_results, visibility_timeline, case_findings,
        findings_of_journey, step_severity, filter_cases_by_finding, dedup_documents, document_matrix, expand_split_rows,
        split_by_period, format_values, format_if, net_of_tax, map_by_doctype, row_counter, calculated_column,
        clean_export_text, signature_completeness, signature_report, signature_summary, latest_change, extract_tag_values,
    )
}

VIS = f"""vis_tl AS (SELECT w.* EXCLUDE (context), s.context AS ctx FROM web w LEFT JOIN (SELECT * FROM {{snaps}} QUALIFY row_number() OVER (PARTITION BY document_uuid, external_event_key ORDER BY captured_at DESC, loaded_at DESC, context DESC) = 1) s
  ON s.document_uuid = w.document_uuid AND s.external_event_key = w.external_event_key),
vis_checks(step_key, event_phase, check_key) AS (VALUES ('signup','after','open'), ('signup','after','odd'), ('view','after','banded'), ('view','after','none'), ('click','before','early'), ('purchase','after','lost')),
rsv AS (SELECT t.*, check_key, CASE check_key WHEN 'open' THEN 'public' WHEN 'early' THEN 'closed' WHEN 'banded' THEN CASE ctx->>'$.band' WHEN 'low' THEN 'public' WHEN 'high' THEN 'closed' END END AS profile_key,
  CASE check_key WHEN 'odd' THEN 'unknown_profile' WHEN 'none' THEN 'missing_profile_or_resolver' WHEN 'lost' THEN 'unknown_profile_resolver'
    WHEN 'banded' THEN CASE WHEN ctx IS NULL OR NOT json_exists(ctx, '$.band') THEN 'missing_context_field' WHEN ctx->>'$.band' = 'mid' THEN 'unmapped_context_value' END END AS reason
  FROM vis_tl t JOIN vis_checks USING (step_key, event_phase)),
usr AS (SELECT DISTINCT user_id FROM events),
mem AS (SELECT 'p_even' AS probe_key, user_id FROM usr WHERE user_id % 2 = 0 UNION ALL SELECT 'p_low', user_id FROM usr WHERE user_id < 50 UNION ALL SELECT 'p_all', user_id FROM usr),
prb(probe_key, page, reach) AS (VALUES ('p_even', 50, 500), ('p_low', 30, 30), ('p_all', 50, 100)),
rnk AS (SELECT *, row_number() OVER (PARTITION BY probe_key ORDER BY user_id) AS r FROM mem),
obs AS (SELECT p.probe_key, 'user-' || u.user_id AS document_uuid, CASE WHEN r.r <= reach THEN 'visible' WHEN tot < reach THEN 'hidden' ELSE 'skipped' END AS actual,
    CAST(CASE WHEN r.r <= reach THEN least(tot, ceil(r.r * 1.0 / page) * page) WHEN tot < reach THEN tot ELSE reach END AS BIGINT) AS document_count,
    CASE WHEN NOT coalesce(r.r <= reach, FALSE) AND tot >= reach THEN 'probe_scan_limit_reached' END AS probe_reason
  FROM usr u CROSS JOIN prb p LEFT JOIN rnk r ON r.probe_key = p.probe_key AND r.user_id = u.user_id JOIN (SELECT probe_key, count(*) AS tot FROM mem GROUP BY ALL) c ON c.probe_key = p.probe_key),
exd(profile_key, probe_key, expected, maxd) AS (VALUES ('public','p_even','visible',NULL), ('public','p_gone','visible',NULL), ('public','p_low','hidden',30), ('closed','p_even','hidden',NULL), ('closed','p_all','hidden',60)),
evl AS (SELECT r.document_uuid, r.external_event_key, r.step_key, r.event_phase, r.check_key, r.occurred_at, r.profile_key, e.probe_key, e.expected,
    CASE WHEN e.probe_key = 'p_gone' THEN 'skipped' ELSE coalesce(o.actual, 'unknown') END AS actual,
    CASE WHEN e.probe_key = 'p_gone' THEN 'skipped' WHEN coalesce(document_count > maxd, FALSE) THEN 'technical_warning' WHEN o.actual = 'skipped' THEN 'technical_warning' WHEN o.actual = expected THEN 'ok' WHEN o.actual = 'visible' THEN 'violation' WHEN o.actual = 'hidden' THEN 'warning' ELSE 'unknown' END AS status,
    CASE WHEN e.probe_key = 'p_gone' THEN 'missing_probe' WHEN coalesce(document_count > maxd, FALSE) THEN 'probe_too_large' WHEN o.actual = 'skipped' THEN probe_reason WHEN o.actual = expected THEN NULL WHEN o.actual = 'visible' THEN 'forbidden_visibility' WHEN o.actual = 'hidden' THEN 'missing_expected_visibility' END AS reason
  FROM rsv r JOIN exd e USING (profile_key) LEFT JOIN obs o ON o.probe_key = e.probe_key AND o.document_uuid = r.document_uuid
  UNION ALL SELECT document_uuid, external_event_key, step_key, event_phase, check_key, occurred_at, '', '', '', 'unknown', 'warning', reason FROM rsv WHERE profile_key IS NULL)"""
V_HEAD = f"WITH {web_sql()}, {snaps_sql('web')}, {VIS.format(snaps='snaps')}"
CF = f"""{FULL}, {VIS.format(snaps='snaps')},
cf AS (SELECT document_uuid, 'process' AS category, 'deviation' AS severity, CAST(NULL AS VARCHAR) AS step_key, CASE WHEN target = 'gateway' THEN target_label END AS decision_key, CASE WHEN target = 'transition' THEN target_label END AS edge FROM found WHERE template_key = 'web'
  UNION ALL SELECT document_uuid, 'context', 'warning', NULL, NULL, NULL FROM ev WHERE process_key = 'web' AND issue IS NOT NULL
  UNION ALL SELECT document_uuid, 'process', 'deviation', NULL, NULL, NULL FROM rows_ WHERE template_key = 'web' AND status = 'DEVIATION' AND n = 0
  UNION ALL SELECT document_uuid, CASE WHEN status IN ('violation','warning') THEN 'access' ELSE 'technical' END, CASE status WHEN 'violation' THEN 'critical' WHEN 'warning' THEN 'warning' ELSE 'technical' END, step_key, NULL, NULL FROM evl WHERE status <> 'ok')"""
WORST = "CASE min(CASE severity WHEN 'critical' THEN 1 WHEN 'deviation' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END) WHEN 1 THEN 'critical' WHEN 2 THEN 'deviation' WHEN 3 THEN 'warning' ELSE 'technical' END"
SIDES = """req AS (SELECT l_orderkey AS doc_id, 'supplier ' || l_suppkey AS name_key FROM lineitem GROUP BY ALL),
act AS (SELECT l_orderkey AS doc_id, 'supplier ' || l_suppkey AS name_key FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL UNION ALL SELECT o_orderkey, 'guest' FROM orders WHERE o_orderstatus = 'P'),
cmp AS (SELECT doc_id, name_key, r.k IS NOT NULL AS required, a.k IS NOT NULL AS confirmed FROM (SELECT *, 1 AS k FROM req) r FULL JOIN (SELECT *, 1 AS k FROM act) a USING (doc_id, name_key)),
rpt AS (SELECT o_orderkey AS doc_id, count(*) FILTER (WHERE required) AS required_count, count(*) FILTER (WHERE confirmed) AS confirmed_count, count(*) FILTER (WHERE required AND NOT confirmed) AS missing_count, count(*) FILTER (WHERE confirmed AND NOT required) AS unexpected_count
  FROM orders LEFT JOIN cmp ON doc_id = o_orderkey GROUP BY o_orderkey)"""
BERLIN = "((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin')"

ORACLES = {
    "resolve_profile": f"{V_HEAD} SELECT external_event_key, check_key, profile_key, reason FROM rsv",
    "probe_membership": f"{V_HEAD} SELECT * FROM obs",
    "evaluate_visibility": f"{V_HEAD} SELECT external_event_key, check_key, profile_key, probe_key, expected, actual, status, reason FROM evl",
    "visibility_results": f"{V_HEAD} SELECT check_key, probe_key, status, {sec('occurred_at')} AS checked_at FROM evl WHERE document_uuid = 'user-8'",
    "visibility_timeline": f"{V_HEAD} SELECT document_uuid, step_key, event_phase, check_key, epoch_us(occurred_at) AS checked_at, count(*) AS probes, count(*) FILTER (WHERE status = 'ok') AS ok FROM evl GROUP BY ALL",
    "case_findings": f"""{CF} SELECT document_uuid, count(*) AS findings, {', '.join(f"count(*) FILTER (WHERE category = '{c}') AS cat_{c}" for c in ('process','context','access','technical'))},
  {', '.join(f"count(*) FILTER (WHERE severity = '{c}') AS sev_{c}" for c in ('critical','deviation','warning','technical'))}, {WORST} AS overall FROM cf GROUP BY ALL""",
    "findings_of_journey": f"{CF} SELECT document_uuid, 'web' AS template_key, count(*) AS findings, {WORST} AS overall FROM cf GROUP BY ALL",
    "step_severity": f"""{CF}, sv AS (SELECT s.step_key, count(c.severity) AS total, {', '.join(f"count(*) FILTER (WHERE severity = '{c}') AS {c}" for c in ('critical','deviation','warning','technical'))}
  FROM (VALUES ('signup'), ('view'), ('click'), ('purchase'), ('refund')) s(step_key) LEFT JOIN cf c USING (step_key) GROUP BY ALL)
SELECT 'web' AS template_key, *, CASE WHEN critical > 0 THEN 'critical' WHEN deviation > 0 THEN 'deviation' WHEN warning > 0 THEN 'warning' WHEN technical > 0 THEN 'technical' ELSE 'ok' END AS worst FROM sv""",
    "filter_cases_by_finding": f"""{CF} SELECT document_uuid, 'graph' AS filter FROM cf GROUP BY ALL HAVING count(*) FILTER (WHERE decision_key = 'after_click') > 0 AND count(*) FILTER (WHERE edge = 'click -> error') > 0
UNION ALL SELECT document_uuid, 'severity' FROM cf GROUP BY document_uuid HAVING {WORST} = 'critical' AND count(*) FILTER (WHERE step_key = 'signup') > 0""",
    "dedup_documents": """WITH l AS (SELECT CASE WHEN l_partkey % 50 <> 0 THEN l_orderkey END AS doc_id, * FROM lineitem)
SELECT doc_id, l_partkey AS part, 1 AS copies FROM l WHERE doc_id IS NULL
UNION ALL SELECT doc_id, arg_min(l_partkey, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)), count(*) FROM l WHERE doc_id IS NOT NULL GROUP BY doc_id""",
    "document_matrix": "SELECT p_partkey AS doc_id, CAST(p_size * 10000 AS VARCHAR) AS size, CAST(CAST(p_retailprice * 10000 AS BIGINT) AS VARCHAR) AS price, CASE WHEN p_brand LIKE '%1%' THEN 'Maker ' || p_brand ELSE '' END AS brand FROM part",
    "expand_split_rows": """WITH li AS (SELECT l_orderkey AS doc_id, l_partkey, CAST(max(l_quantity) AS INTEGER) AS q, min(l_suppkey) AS s, count(*) OVER (PARTITION BY l_orderkey) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS r FROM lineitem GROUP BY l_orderkey, l_partkey)
SELECT doc_id, CAST(CASE WHEN c > 1 THEN r ELSE 0 END AS INTEGER) AS row_no, 'qty' AS definition_id, CAST(q AS VARCHAR) AS value FROM li
UNION ALL SELECT doc_id, CAST(CASE WHEN c > 1 THEN r ELSE 0 END AS INTEGER), 'supplier', CAST(s AS VARCHAR) FROM li
UNION ALL SELECT o_orderkey, CAST(unnest(range(coalesce(n, 1))) AS INTEGER), 'status', o_orderstatus FROM orders LEFT JOIN (SELECT doc_id, max(c) AS n FROM li GROUP BY ALL) m ON doc_id = o_orderkey""",
    "split_by_period": "SELECT strftime(o_orderdate, '%d.%m.%Y') AS period, count(*) AS n FROM orders GROUP BY ALL",
    "format_values": """SELECT p_partkey, replace(CAST(CAST(p_retailprice AS DECIMAL(28,2)) AS VARCHAR), '.', ',') AS price, CAST(CAST(round(CAST(p_retailprice AS DECIMAL(28,4)), 0) AS BIGINT) AS VARCHAR) AS whole, substr(p_name, 1, 4) AS first4, substr(p_name, 3, 3) AS slice, 'T-' || p_type AS prefixed, replace(p_name, ' ', '') AS joined FROM part""",
    "format_if": "SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'R' WHEN p_name LIKE '%bolt' THEN 'B' WHEN p_name = 'hot gear' THEN 'HG' ELSE '-' END AS by_name, CASE WHEN p_size < 10 THEN 'small' WHEN p_size <= 20 THEN 'mid' WHEN p_size >= 45 THEN 'huge' WHEN p_size > 40 THEN 'big' ELSE 'large' END AS by_size FROM part",
    "net_of_tax": f"SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN {rnd('c_acctbal / (1 + (c_nationkey % 3 * 6 + 7) / 100.0)', 2)} ELSE c_acctbal END AS net FROM customer",
    "map_by_doctype": "SELECT c_custkey, CASE WHEN n_regionkey < 3 THEN r_name ELSE n_name END AS doctype_text FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    "row_counter": "SELECT o_orderkey, 999 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS counter FROM orders",
    "calculated_column": "SELECT CASE WHEN l_discount > 0.05 THEN 'D' ELSE 'N' || l_linenumber END AS net, count(*) AS n FROM lineitem GROUP BY ALL",
    "clean_export_text": r"SELECT conv_id, turn, substr(regexp_replace(trim(replace(regexp_replace(' a|b' || chr(9) || text, '\r\n|\r|\n|\t', ' ', 'g'), '|', ' / ')), ' {2,}', ' ', 'g'), 1, 40) AS clean FROM conversations",
    "signature_completeness": f"WITH {SIDES} SELECT doc_id, name_key, CASE WHEN required THEN 'Supplier ' || split_part(name_key, ' ', 2) WHEN name_key = 'guest' THEN 'Guest' END AS name, required, confirmed FROM cmp",
    "signature_report": f"WITH {SIDES} SELECT *, CASE WHEN missing_count = 0 AND unexpected_count = 0 THEN 'complete' ELSE 'incomplete' END AS result FROM rpt",
    "signature_summary": f"WITH {SIDES} SELECT count(*) AS documents, count(*) FILTER (WHERE missing_count = 0 AND unexpected_count = 0) AS complete_count, count(*) FILTER (WHERE missing_count > 0 OR unexpected_count > 0) AS incomplete_count FROM rpt",
    "latest_change": f"SELECT {sec('max(l_shipdate)')} AS latest_change FROM lineitem",
    "extract_tag_values": "SELECT p_partkey AS doc_id, 'Maker ' || p_brand AS name FROM part WHERE p_brand LIKE '%1%'",
}
