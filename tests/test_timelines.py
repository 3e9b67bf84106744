from datetime import datetime, timezone

import pytest

from casetrail.operators import cases, discovery, kpi
from casetrail.plans.templates import TemplateSet
from helpers import RETURNS, make_log, rows

TPL = {"key": "p", "steps": [{"key": "dry"}, {"key": "fold"}], "transitions": [{"from": "dry", "to": "fold"}]}


def starts(spark, log):
    return cases.run_starts(cases.case_timeline(log))


@pytest.mark.parametrize("split", [False, True])
def test_flow_shares(spark, split):
    if split:
        spark.conf.set(cases.HOT_CONF, "1")
    try:
        log = make_log(spark, {k: [("dry", "05:00"), ("fold", "05:30")] for k in "abc"} | {"z": [("fold", "05:00"), ("dry", "05:12")]})
        got = rows(kpi.flow_heatmap(starts(spark, log), TemplateSet(spark, [TPL])), "from_step", "to_step", "observed", "percentage", "intensity", "is_allowed")
    finally:
        spark.conf.unset(cases.HOT_CONF)
    assert got == [("dry", "fold", 3, 75.0, 1.0, True), ("fold", "dry", 1, 25.0, 0.3333, False)]


def test_durations_and_open_ages(spark):
    log = make_log(spark, {"a": [("dry", "05:00"), ("fold", "05:50")], "b": [("dry", "05:00"), ("fold", "05:10")], "c": [("dry", "05:00"), ("fold", "06:30")]})
    now = datetime(2026, 5, 31, 7, tzinfo=timezone.utc)
    got = {r["step_key"]: r for r in kpi.duration_heatmap(starts(spark, log), TemplateSet(spark, [TPL]), now).collect()}
    assert (got["dry"]["completed"], got["dry"]["avg_minutes"], got["dry"]["median_minutes"], got["dry"]["max_minutes"]) == (3, 50.0, 50.0, 90.0)
    assert (got["fold"]["open"], got["fold"]["avg_open_minutes"], got["fold"]["max_open_minutes"], got["fold"]["backlog_count_intensity"]) == (3, 70.0, 110.0, 1.0)


def test_split_cases_equal_whole_cases(spark, hot):
    steps = [(f"s{i % 3}", f"{8 + i // 60:02d}:{i % 60:02d}") for i in range(40)]
    log = make_log(spark, {"big": steps, "small": steps[:3]})
    t = cases.case_timeline(log)
    assert "block" in t.columns
    assert [r[0] for r in t.filter("document_uuid = 'big'").orderBy("pos").select("step_key").collect()] == [s for s, _ in steps]
    n = cases.with_neighbours(t, next={"nx": "step_key"}, prev={"pv": "step_key"}).filter("document_uuid = 'big'").orderBy("pos").collect()
    assert [r["nx"] for r in n] == [s for s, _ in steps[1:]] + [None]
    assert [r["pv"] for r in n] == [None] + [s for s, _ in steps[:-1]]


def test_order_of_input_does_not_matter(spark):
    log = make_log(spark, RETURNS)
    again = log.repartition(3).orderBy("step_key").unionByName(log.limit(0))
    cols = ("document_uuid", "entry", "step_key", "next_step")
    assert rows(starts(spark, log), *cols) == rows(starts(spark, again), *cols)


def test_parallel_steps_are_found(spark):
    e = discovery.discovery_entries(discovery.discovery_timeline(make_log(spark, RETURNS)))
    g = discovery.discover_parallel_groups(e, discovery.discover_transitions(e))
    assert rows(g, "left_step", "right_step", "forward", "reverse", "cases") == [("inspect", "weigh", 2, 3, 5)]


def test_bad_templates_are_refused(spark):
    with pytest.raises(ValueError):
        TemplateSet(spark, [{"key": "x", "decision_points": [{"key": "d", "after": "a", "rules": [{"when": {"k": {"like": 1}}, "next": "b"}]}]}])
    with pytest.raises(ValueError):
        TemplateSet(spark, [{"key": "x", "decision_points": [{"key": "d", "after": "a", "rules": [{"when": {"k": {"eq": 1}}, "next": "b"}]}]}])
