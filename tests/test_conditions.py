"""Conditions as data give what single Column builders give, and their plan does not grow with the templates."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from casetrail.functions import conditions as C, values as V
from casetrail.operators import cases, conformance, decisions, graph
from casetrail.plans.templates import TemplateSet, small_table
from helpers import make_log, rows, snapshots_of

SEEN = [None, True, False, 0, 1, 2, 1.5, "", "0", "1", "1.0", " 2 ", "a", "A", "true", "false", [], [1], {"x": 1}, 10000, "1e4"]
WANTED = [None, True, False, 0, 1, 2, 1.0, 1.5, "", "0", "1", "01", "2", "a", "true", "False", [], [1], [1, "a", 1.5], 10000, "1e4"]
OPERATORS = ["eq", "neq", "gt", "gte", "lt", "lte", "in", "exists"]


@pytest.fixture(scope="module")
def contexts(spark):
    texts = [json.dumps({"f": x, "g": 1}) for x in SEEN] + ["{}", None, "[1]", "broken"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").withColumn("obj", V.as_object(F.col("c")))


@pytest.mark.parametrize("op", OPERATORS)
def test_rules_as_data_equal_single_conditions(spark, contexts, op):
    table = small_table(spark, [(k, C.rules({"rules": [{"else": False, "when": ("f", op, w)}]})) for k, w in enumerate(WANTED)], f"k int, rules {C.RULES}")
    data = contexts.crossJoin(table).select("i", "k", C.first_rule(C.facts(F.col("obj")), F.col("rules")).isNotNull())
    single = contexts.select("i", *[V.rule_condition(F.col("obj"), "f", op, w).alias(str(k)) for k, w in enumerate(WANTED)]).collect()
    want = {(r["i"], k): r[str(k)] for r, k in itertools.product(single, range(len(WANTED)))}
    assert {(i, k): hit for i, k, hit in data.collect()} == want


def test_loose_conditions_as_data(spark, contexts):
    table = small_table(spark, [(k, C.conditions({"f": w})) for k, w in enumerate(WANTED)], f"k int, wanted {C.CONDITIONS}")
    data = contexts.crossJoin(table).select("i", "k", C.all_hold(C.facts(F.col("obj")), F.col("wanted")))
    single = contexts.select("i", *[V.all_loose_equal(F.col("obj"), {"f": w}).alias(str(k)) for k, w in enumerate(WANTED)]).collect()
    want = {(r["i"], k): r[str(k)] for r, k in itertools.product(single, range(len(WANTED)))}
    assert {(i, k): hit for i, k, hit in data.collect()} == want


def template(n):
    rules = [{"when": {"amount": {"gt": 100 * n}}, "next": "big"}, {"when": {"kind": {"in": ["x", n]}}, "next": "small"}, {"else": True, "next": "rest"}]
    return {
        "key": f"t{n}", "process_key": "p", "steps": [{"key": s} for s in ("ask", "big", "small", "rest")],
        "field_mappings": {"amount": {"stability": "volatile"}, "kind": {"stability": "immutable"}},
        "decision_points": [{"key": "d", "after": "ask", "rules": rules}],
    }


def test_five_hundred_templates(spark):
    steps = [("ask", "08:00"), ("big", "09:00")]
    context = {"a": {"amount": 120, "kind": "x"}, "b": {"amount": 24_950, "kind": "y"}, "c": {"amount": 1, "kind": 7}}
    log = make_log(spark, {k: steps for k in "abc"}, context=context)
    templates = TemplateSet(spark, [template(n) for n in range(500)])
    timeline = cases.case_timeline(cases.attach_snapshots(log, snapshots_of(log)))
    entries = cases.collapse_repeats(timeline, templates.context_fields())
    found = decisions.evaluate_decisions(entries, templates, conformance.case_profiles(entries, templates))
    got = {(r.document_uuid, r.template_key): r.next_step for r in found.select("document_uuid", "template_key", "next_step").collect()}
    for n in range(500):
        assert got["a", f"t{n}"] == ("big" if 120 > 100 * n else "small")
        assert got["b", f"t{n}"] == ("big" if 24_950 > 100 * n else "rest")
        assert got["c", f"t{n}"] == ("big" if n == 0 else "small" if n == 7 else "rest")
    picked = graph.project_transitions(timeline, templates).filter("to_step IS NOT NULL")
    classes = dict(rows(picked.filter("document_uuid = 'a' AND template_key IN ('t1', 't2')"), "template_key", "classification"))
    assert classes == {"t1": graph.VIA_DECISION, "t2": graph.UNEXPECTED}


def test_issues_and_reasons_are_told(spark):
    raw = template(1) | {"key": "p", "context_policy": {"max_delay_seconds": 60}}
    raw["decision_points"][0]["required_fields"] = ["amount", "it's"]
    raw["field_mappings"]["it's"] = {"stability": "volatile"}
    templates = TemplateSet(spark, [raw])
    context = {"a": {"amount": "120", "it's": 1, "kind": "z"}, "b": {"kind": "x"}, "c": {"amount": 5, "it's": 2}, "d": {"amount": 5}}
    log = make_log(spark, {k: [("ask", "08:00"), ("rest", "09:00")] for k in "abcd"}, context=context)
    late = F.when(F.col("document_uuid") == "c", F.expr("occurred_at + INTERVAL 90 SECONDS")).otherwise(F.col("occurred_at"))
    snaps = snapshots_of(log).withColumn("loaded_at", late)
    entries = cases.collapse_repeats(cases.case_timeline(cases.attach_snapshots(log, snaps)), templates.context_fields())
    found = decisions.evaluate_decisions(entries, templates, conformance.case_profiles(entries, templates))
    reasons = rows(decisions.decision_reasons(found, templates), "document_uuid", "rule", "expected", "field", "value_json")
    assert reasons[:2] == [("a", "amount gt 100", "big", "amount", '"120"'), ("a", "amount gt 100", "big", "it's", "1")]
    told = {r.document_uuid: (r.field, r.message) for r in decisions.context_freshness_issues(found).collect()}
    at = "2026-05-31T08:00:00+00:00"
    assert told == {
        "b": ("amount", f"Uncheckable context missing: decision point d field amount requires a snapshot. event occurred_at={at}"),
        "c": ("amount", f"Uncertain context stale: decision point d field amount snapshot freshness_seconds=90 exceeds max_delay_seconds=60. event occurred_at={at} loaded_at=2026-05-31T08:01:30+00:00"),
        "d": ("it's", f"Uncheckable context missing: decision point d field it's requires a snapshot. event occurred_at={at}"),
    }
