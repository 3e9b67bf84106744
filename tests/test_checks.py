from casetrail.operators import decisions
from casetrail.plans.check import check_processes
from casetrail.plans.templates import TemplateSet
from helpers import make_log, rows, snapshots_of

REPAIRS = {
    "key": "p",
    "steps": [{"key": k} for k in ("drop_off", "estimate", "repair", "ship_to_maker", "hand_back")],
    "required_steps": ["drop_off", "estimate", "hand_back"],
    "transitions": [
        {"from": "drop_off", "to": "estimate"},
        {"from": "repair", "to": "hand_back"},
        {"from": "ship_to_maker", "to": "hand_back"},
    ],
    "decision_points": [
        {
            "key": "who_repairs",
            "after": "estimate",
            "required_fields": ["brand"],
            "rules": [{"when": {"under_warranty": {"eq": True}}, "next": "ship_to_maker"}, {"else": True, "next": "repair"}],
        }
    ],
    "field_mappings": {"under_warranty": {"stability": "mutable"}, "brand": {"stability": "immutable"}},
    "context_policy": {"max_delay_seconds": 60},
}
LOG = {
    "bike": [("drop_off", "07:30"), ("estimate", "07:47"), ("repair", "09:10"), ("hand_back", "16:00")],
    "lamp": [("drop_off", "08:05"), ("estimate", "08:06"), ("ship_to_maker", "10:00"), ("hand_back", "15:21")],
    "kettle": [("drop_off", "08:40"), ("estimate", "09:02"), ("repair", "09:30"), ("hand_back", "11:11")],
}
CONTEXT = {
    "bike": {"under_warranty": False, "brand": "Norrum"},
    "lamp": {"under_warranty": True, "brand": "Helio"},
    "kettle": {"under_warranty": True, "brand": "Helio"},
}


def test_one_repair_took_the_wrong_way(spark):
    log = make_log(spark, LOG, context=CONTEXT)
    c = check_processes(log, snapshots_of(log), TemplateSet(spark, [REPAIRS]))
    assert rows(c.findings, "document_uuid", "message") == [
        ("kettle", "Decision rule violation: who_repairs after estimate expected ship_to_maker but got repair")
    ]
    why = decisions.decision_reasons(c.evaluated, TemplateSet(spark, [REPAIRS]))
    assert rows(why, "document_uuid", "rule", "expected", "actual_step", "field", "value") == [
        ("kettle", "under_warranty eq true", "ship_to_maker", "repair", "brand", "Helio"),
        ("kettle", "under_warranty eq true", "ship_to_maker", "repair", "under_warranty", "true"),
    ]
    assert rows(c.status, "document_uuid", "status", "problem_score") == [("bike", "OK", 0), ("kettle", "DEVIATION", 2), ("lamp", "OK", 0)]


def test_missing_snapshot_makes_the_decision_uncheckable(spark):
    log = make_log(spark, {"kettle": LOG["kettle"]})
    c = check_processes(log, snapshots_of(log), TemplateSet(spark, [REPAIRS]), stage=False)
    assert rows(c.status, "status", "context_status") == [("UNCHECKABLE_CONTEXT_MISSING", "UNCHECKABLE_CONTEXT_MISSING")]


def test_missing_decision_context_is_a_warning(spark):
    log = make_log(spark, {"bike": LOG["bike"]}, context={"bike": {"under_warranty": False, "brand": ""}})
    c = check_processes(log, snapshots_of(log), TemplateSet(spark, [REPAIRS]), stage=False)
    assert rows(c.findings, "message") == [("Missing context for decision point who_repairs: brand",)]
    assert rows(c.status, "status", "report_status", "problem_score") == [("DEVIATION", "WARNING", 0)]
