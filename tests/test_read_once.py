"""Queries that look at a log in several ways read and order it once; contexts come along in the same shuffle."""

import pytest
from pyspark.sql import functions as F

from casetrail.operators import cases, decisions, documents
from casetrail.plans import catalog, check
from casetrail.plans.catalog import checks
from casetrail.sources import adapters, scratch
from helpers import make_log, rows, snapshots_of

PARCELS = {
    "p-1": [("placed", "08:00"), ("shipped", "08:10"), ("returned", "08:40"), ("shipped", "09:20")],
    "p-2": [("placed", "08:05"), ("returned", "08:15"), ("shipped", "08:45")],
    "p-3": [("placed", "10:00"), ("shipped", "10:01"), ("shipped", "10:02"), ("returned", "11:00")],
    "p-4": [("placed", "12:00")],
}
VISITS = {
    "v-1": [("signup", "08:00"), ("click", "08:10"), ("view", "08:20"), ("click", "08:30"), ("purchase", "08:31")],
    "v-2": [("click", "09:00"), ("purchase", "09:05"), ("view", "09:06")],
    "v-3": [("signup", "09:30"), ("view", "09:35"), ("click", "09:36"), ("refund", "09:50")],
}
CONTEXT = {"p-1": {"status": "P"}, "p-2": {"status": "F"}, "p-3": {"status": "O"}, "v-1": {"k": 90, "flag": True}, "v-2": {"value": 60, "band": "low"}, "v-3": {"k": 10}}


def full_log(spark):
    log = make_log(spark, PARCELS, "orders", CONTEXT).unionByName(make_log(spark, VISITS, "web", CONTEXT))
    return log.withColumn("external_event_key", F.concat("process_key", F.lit("-"), "external_event_key"))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def steps_read(spark, monkeypatch):
    """Runs a query of the catalogue over ``full_log``; how often the query read the step of an event, on average."""

    def run(name):
        seen = spark.sparkContext.accumulator(0)

        def count(step):
            seen.add(1)
            return step

        log = full_log(spark)
        monkeypatch.setattr(adapters, "full_log", lambda *_: log.withColumn("step_key", F.udf(count, "string")("step_key")))
        catalog.queries()[name](spark, "").collect()
        return seen.value / log.count()

    return run


def test_contexts_come_along_in_the_shuffle_of_the_timeline(spark):
    log = full_log(spark)
    late = snapshots_of(log).limit(5).withColumns({"loaded_at": F.col("loaded_at") + F.expr("interval 1 minute"), "captured_at": F.col("captured_at") + F.expr("interval 1 minute"), "context": F.lit('{"late":1}')})
    shots = snapshots_of(log).unionByName(late)
    names = [*cases.CASE, "pos", "external_event_key", "ctx", "ctx_loaded_at", "ctx_occurred_at", "ctx_freshness", "has_snapshot"]
    t = cases.case_timeline(log, snapshots=shots)
    assert shuffles(t) == 1
    assert sorted(map(str, rows(t, *names))) == sorted(map(str, rows(cases.case_timeline(cases.attach_snapshots(log, shots)), *names)))


def test_contexts_of_large_cases_are_the_same(spark, hot):
    log = full_log(spark)
    names = [*cases.CASE, "pos", "external_event_key", "ctx", "has_snapshot"]
    few = sorted(map(str, rows(cases.case_timeline(log, snapshots=snapshots_of(log)), *names)))
    spark.conf.unset("spark.casetrail.hotCaseRows")
    assert sorted(map(str, rows(cases.case_timeline(log, snapshots=snapshots_of(log)), *names))) == few


def test_large_cases_are_found_by_hash(spark, hot):
    log = make_log(spark, {"many": [("s", f"08:{i:02}") for i in range(6)], "few": [("s", f"09:{i:02}") for i in range(5)]})
    assert rows(cases.hot_keys(log, ["document_uuid"]), "document_uuid", "_n") == [("many", 6)]
    assert cases.hot_keys(log.filter("document_uuid = 'few'"), ["document_uuid"]) is None


@pytest.mark.parametrize("name", ["decision_field_evidence", "values_by_next_step", "virtual_node_durations", "node_flow", "discover_parallel_fallback", "heatmap_report"])
def test_the_log_is_read_once(steps_read, name):
    assert steps_read(name) == 1


PARTS = ["parallel_group_next_missing", "parallel_group_messages", "parallel_group_incomplete", "decision_rule_violations"]
WHOLE = ["problem_score", "process_check_rows"]


@pytest.mark.parametrize("name, home", [(n, checks) for n in PARTS] + [(n, check) for n in WHOLE])
def test_entries_of_a_check_are_made_in_one_shuffle_and_kept_where_they_are(spark, monkeypatch, name, home):
    kept = []
    log = full_log(spark)
    monkeypatch.setattr(adapters, "full_log", lambda *_: log)
    monkeypatch.setattr(home, "held", lambda df: kept.append(shuffles(df)) or scratch.held(df))
    catalog.queries()[name](spark, "").collect()
    assert kept == [1]


def test_the_nearest_context_is_looked_for_in_the_same_version_of_the_case(spark):
    log = make_log(spark, {"v-1": [("click", "08:00"), ("view", "08:10"), ("view", "08:20")]}, "web")
    log = log.withColumn("context", F.when(F.col("event_id") > 1, F.format_string('{"k":%d,"flag":true}', "event_id")))
    two = log.unionByName(log.withColumns({"document_version": F.lit(2), "event_id": F.col("event_id") + 10, "external_event_key": F.concat(F.lit("2-"), "external_event_key"), "context": F.when(F.col("event_id") == 3, '{"k":99,"flag":true}')}))
    tpl = checks.templates(spark)
    e = cases.collapse_repeats(cases.case_timeline(two, version="all", snapshots=snapshots_of(two)), tpl.context_fields())
    e = e.withColumn("context", F.coalesce("context", F.lit("{}")))
    near = decisions.nearest_complete_context(decisions.decision_entries(e, tpl), e, tpl)
    assert rows(near.filter("decision_key = 'after_click'"), "document_version", "context", "context_distance") == [(1, '{"k":3,"flag":true}', 1), (2, '{"k":99,"flag":true}', 1)]


def test_violations_judge_a_decision_once(spark, monkeypatch):
    written = []
    log = full_log(spark)
    monkeypatch.setattr(adapters, "full_log", lambda *_: log)
    monkeypatch.setattr(checks, "staged", lambda df, name: written.append(name) or scratch.staged(df, name))
    found = rows(catalog.queries()["decision_rule_violations"](spark, ""), "document_uuid", "decision_key", "actual_step")
    assert written == ["profiles", "decisions"]
    assert ("p-1", "after_placed", "shipped") in found


TAGS = [
    ("d-1", 0, "status", None, None, "open"), ("d-1", 3, "qty", "line", "a", "5"), ("d-1", 4, "price", "line", "a", "9"), ("d-1", 1, "qty", "line", "b", "7"),
    ("d-1", 2, "price", "line", "b", "8"), ("d-2", 0, "status", "", "", "done"), ("d-3", 0, "qty", "line", "a", "1"), (None, 0, "qty", "line", "a", "1"),
]
SPLIT = [("d-1", 0, "price", "8"), ("d-1", 0, "qty", "7"), ("d-1", 0, "status", "open"), ("d-1", 1, "price", "9"), ("d-1", 1, "qty", "5"), ("d-1", 1, "status", "open"), ("d-2", 0, "status", "done"), ("d-3", 0, "qty", "1")]


@pytest.mark.parametrize("limit", ["2000000", "4"])
def test_split_rows_take_one_shuffle_unless_a_document_is_large(spark, limit):
    tags = spark.createDataFrame(TAGS, "doc_id string, tag_pos int, definition_id string, group_definition string, group_id string, value string")
    spark.conf.set("spark.casetrail.hotCaseRows", limit)
    try:
        out = documents.expand_split_rows(tags)
        assert rows(out, "doc_id", "row_no", "definition_id", "value") == SPLIT
        assert shuffles(out) == 1 or limit == "4"
    finally:
        spark.conf.unset("spark.casetrail.hotCaseRows")
