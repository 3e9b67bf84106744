"""Decision points: was the next step the one the context called for *then*?"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from casetrail.functions import conditions as C, values as V
from casetrail.operators.cases import CASE
from casetrail.operators.conformance import KEY, findings_frame
from casetrail.plans.templates import TemplateSet, _named, small_table
from casetrail.sources.scratch import held

MISSING = "UNCHECKABLE_CONTEXT_MISSING"
SKEW = "UNCERTAIN_CONTEXT_TIME_SKEW"
STALE = "UNCERTAIN_CONTEXT_STALE"


def match_decision_rule(decision: dict, obj: Column) -> Column:
    """Position of the first matching rule; the first ``else`` when none matches."""
    struct = T.StructType.fromDDL(f"rules {C.RULES}")
    rules = F.from_json(F.lit(json.dumps(_named(C.rules(decision), struct["rules"].dataType))), struct["rules"].dataType)
    return C.first_rule(C.facts(obj), rules)


def with_decision_rules(rows: DataFrame, templates: TemplateSet) -> DataFrame:
    """Add what ``TemplateSet.decision_rules`` knows of each row's decision."""
    return rows.join(templates.decision_rules().drop("decision_key", "after_step"), ["template_key", "decision_pos"], "left")


RULE_COLUMNS = ["names", "required_names", "fresh_names", "max_delay", "rules"]


def matched_rule(obj: Column) -> Column:
    """Rule position for rows that carry ``names`` and ``rules`` of their decision."""
    return C.first_rule(C.facts(obj, F.col("names")), F.col("rules"))


def context_issue(obj: Column) -> Column:
    """Status that makes the decision uncheckable, null when it can be checked.

    ``obj`` is the last snapshot of the entry; uses ``has_snapshot``,
    ``sum_loaded_at``, ``sum_occurred_at``, ``sum_freshness``, ``occurred_at``
    and the rule columns.  Fields that never change need not be fresh.
    """
    shot_at = F.coalesce(F.col("sum_occurred_at"), F.col("occurred_at"))
    fresh = F.coalesce(F.unix_seconds("sum_loaded_at") - F.unix_seconds(shot_at), F.col("sum_freshness"))
    known = F.coalesce(F.map_keys(F.try_variant_get(obj, "$", "map<string,variant>")), F.array().cast("array<string>"))
    names = F.col("fresh_names")

    def absent(name: Column) -> Column:
        return ~F.col("has_snapshot") | ~F.array_contains(known, name)

    return (
        F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, F.lit(None).cast("string"))
        .when(absent(F.get(names, F.lit(0))) | F.col("sum_loaded_at").isNull(), F.lit(MISSING))
        .when(fresh < 0, F.lit(SKEW))
        .when(fresh > F.col("max_delay"), F.lit(STALE))
        .when(F.exists(names, absent), F.lit(MISSING))
    )


def _missing(obj: Column) -> Column:
    """Names of the decision that carry no value: ``conditions.missing`` without the facts that only rules need."""
    fields = F.try_variant_get(obj, "$", "map<string,variant>")
    names = C.let(fields, lambda known: F.filter("names", lambda n: ~C.let(F.try_element_at(known, n), V.is_filled)))
    return F.coalesce(names, F.array().cast("array<string>"))


def decision_entries(entries: DataFrame, templates: TemplateSet) -> DataFrame:
    """First entry at each decision's ``after`` step, with the step that followed."""
    at = F.struct(
        "entry",
        "occurred_at",
        F.col("next_step").alias("next_step_seen"),
        "context",
        "sum_context",
        "sum_loaded_at",
        "sum_occurred_at",
        "sum_freshness",
        "has_snapshot",
    )
    decisions = templates.decisions().withColumn("step_key", F.col("after_step"))
    return (
        templates.expand(entries)
        .join(decisions, ["template_key", "step_key"])
        .groupBy(*KEY, "decision_pos", "decision_key", "after_step")
        .agg(F.min_by(at, F.col("entry")).alias("_at"))
        .select(*KEY, "decision_pos", "decision_key", "after_step", "_at.*")
    )


def nearest_complete_context(decisions: DataFrame, entries: DataFrame, templates: TemplateSet) -> DataFrame:
    """Replace ``context`` of decision rows that lack a field by the context of
    the nearest entry that has all of them: distance 1, 2, ..., earlier first.

    Only incomplete decision rows are joined to the entries of their case.
    """
    def complete(context):
        whole = C.let(V.as_object(context), lambda obj: obj.isNotNull() & (F.size(_missing(obj)) == 0))
        return F.coalesce(whole, F.lit(False)) | F.col("names").isNull()

    marked = with_decision_rules(decisions, templates).withColumn("_ok", complete(F.col("context")))
    marked = held(marked.drop(*RULE_COLUMNS))
    lacking = marked.filter(~F.col("_ok"))
    open_rows = with_decision_rules(lacking, templates).select(
        F.col("document_uuid").alias("_uuid"), F.struct(*KEY, "decision_key").alias("_row"), "names", F.col("entry").alias("_p")
    )
    others = entries.filter(F.col("context").isNotNull()).select(
        *CASE, F.col("entry").alias("_e"), F.col("context").alias("_c")
    )
    # Entries and what came of them lie together by document: joined by that alone, neither moves again.
    same_case = [F.col(c).between(F.col(f"_row.{c}"), F.col(f"_row.{c}")) for c in CASE if c != "document_uuid"]
    gap = F.col("_e") - F.col("_p")
    found = (
        others.join(open_rows, reduce(and_, same_case, F.col("document_uuid") == F.col("_uuid")))
        .filter(gap != 0)
        .filter(complete(F.col("_c")))
        .groupBy(*[F.col(f"_row.{c}").alias(c) for c in [*KEY, "decision_key"]])
        .agg(F.min_by(F.struct("_c", gap.alias("distance")), F.struct(F.abs(gap), gap > 0)).alias("_near"))
    )
    near = lacking.join(found, KEY + ["decision_key"], "left").withColumns(
        {"context": F.coalesce("_near._c", "context"), "context_distance": F.coalesce("_near.distance", F.lit(0))}
    )
    whole = marked.filter("_ok").withColumn("context_distance", F.lit(0))
    return whole.unionByName(near.drop("_near")).drop("_ok")


def evaluate_decisions(entries: DataFrame, templates: TemplateSet, profiles: DataFrame) -> DataFrame:
    """One row per case and reached decision with everything the checks need."""
    rows = nearest_complete_context(decision_entries(entries, templates), entries, templates)
    rows = with_decision_rules(rows, templates)
    # Judged in a generator, as whatever reads these columns would repeat an expression for each use of it.
    judged = C.let(V.as_object(F.col("context")), lambda obj: C.let(C.facts(obj, F.col("names")), lambda known: F.struct(
        C.missing(known, F.col("names")).alias("missing_fields"), C.first_rule(known, F.col("rules")).alias("rule_pos"), obj.isNotNull().alias("_object")
    )))
    issue = F.when(F.size("fresh_names") > 0, C.let(V.as_object(F.col("sum_context")), context_issue))
    rows = rows.select("*", F.inline(F.array(F.struct(issue.alias("context_issue"), judged.alias("_judged")))))
    rows = rows.select("*", "_judged.missing_fields", F.col("_judged.rule_pos").alias("_rule_pos"), "_judged._object")
    checkable = F.col("context_issue").isNull() & (F.size("missing_fields") == 0) & F.col("_object")
    rows = rows.withColumn("rule_pos", F.when(checkable, F.col("_rule_pos")))
    rows = rows.drop("names", "required_names", "rules", "_judged", "_rule_pos", "_object")
    rules = templates.rules().select("template_key", "decision_pos", "rule_pos", "next_step", "next_group")
    steps = profiles.select(*KEY, F.map_keys("first_at").alias("_seen"), "groups")
    rows = rows.join(rules, ["template_key", "decision_pos", "rule_pos"], "left").join(steps, KEY)
    got = F.col("next_step_seen")
    in_group = F.exists(
        "groups", lambda g: (g["group_key"] == F.col("next_group")) & F.array_contains(g["required"], got)
    )
    same_group = F.exists(
        "groups",
        lambda g: F.array_contains(g["required"], F.col("next_step"))
        & F.array_contains(g["required"], got)
        & (F.size(F.array_except(g["required"], F.col("_seen"))) == 0),
    )
    by_group = F.col("next_group").isNotNull()
    violated = (
        F.when(by_group, ~F.coalesce(in_group, F.lit(False)))
        .when(F.col("next_step").isNotNull(), ~F.coalesce(same_group | (got == F.col("next_step")), F.lit(False)))
        .otherwise(F.lit(False))
    )
    return rows.withColumn("violated", violated).drop("_seen", "groups")


def missing_decision_context(evaluated: DataFrame) -> DataFrame:
    d = evaluated.filter(F.col("context_issue").isNull() & (F.size("missing_fields") > 0))
    message = F.concat(
        F.lit("Missing context for decision point "),
        F.col("decision_key"),
        F.lit(": "),
        F.array_join("missing_fields", ", "),
    )
    return findings_frame(
        d,
        "missing_decision_context",
        message,
        ordinal=F.col("decision_pos"),
        expected=F.col("missing_fields"),
        decision_key=F.col("decision_key"),
        after_step=F.col("after_step"),
    )


def decision_rule_violations(evaluated: DataFrame, templates: TemplateSet, profiles: DataFrame) -> DataFrame:
    """Wrong next step, plus ``after`` steps an earlier decision called for that never came."""
    bad = evaluated.filter("violated")
    want = F.coalesce(F.concat(F.lit("parallel group "), F.col("next_group")), F.col("next_step"))
    message = F.concat(
        F.lit("Decision rule violation: "),
        F.col("decision_key"),
        F.lit(" after "),
        F.col("after_step"),
        F.lit(" expected "),
        want,
        F.lit(" but got "),
        F.coalesce("next_step_seen", F.lit("none")),
    )
    wrong = findings_frame(
        bad,
        "decision_rule_violation",
        message,
        ordinal=F.col("decision_pos"),
        actual_step=F.col("next_step_seen"),
        expected=F.array(F.coalesce("next_group", "next_step")),
        decision_key=F.col("decision_key"),
        after_step=F.col("after_step"),
    )
    called = (
        evaluated.filter(F.col("next_step").isNotNull() & F.col("next_group").isNull())
        .select(*KEY, F.col("decision_pos").alias("_by"), F.col("next_step").alias("after_step"))
        .join(templates.decisions(), ["template_key", "after_step"])
        .filter(F.col("decision_pos") > F.col("_by"))
        .select(*KEY, "decision_pos", "decision_key", "after_step")
        .distinct()
    )
    absent = called.join(profiles.select(*KEY, F.map_keys("first_at").alias("_seen")), KEY).filter(
        ~F.array_contains("_seen", F.col("after_step"))
    )
    never = findings_frame(
        absent,
        "decision_rule_violation",
        F.concat(
            F.lit("Decision rule violation: "),
            F.col("decision_key"),
            F.lit(" after step "),
            F.col("after_step"),
            F.lit(" not found"),
        ),
        ordinal=F.col("decision_pos"),
        decision_key=F.col("decision_key"),
        after_step=F.col("after_step"),
    )
    return wrong.unionByName(never)


def decision_reasons(evaluated: DataFrame, templates: TemplateSet) -> DataFrame:
    """Why a followed path is wrong: one row per violated decision and field that it reads, with the field's value in the
    context that was judged (as text, and as JSON, which keeps its type), the rule that applied and what it called for."""
    rules = [
        (t.key, d["key"], j, "else" if r["else"] or not r["when"] else " ".join([r["when"][0], r["when"][1], V.canonical(r["when"][2])]))
        for t in templates for d in t.decisions for j, r in enumerate(d["rules"])
    ]
    reads = [(t.key, d["key"], n) for t in templates for d in t.decisions for n in t.decision_fields(d)]
    rule = small_table(templates.spark, rules, "template_key string, decision_key string, rule_pos int, rule string")
    field = small_table(templates.spark, reads, "template_key string, decision_key string, field string")
    bad = evaluated.filter("violated").select(
        *KEY, "decision_key", "after_step", "rule_pos", "context",
        F.coalesce("next_group", "next_step").alias("expected"), F.col("next_step_seen").alias("actual_step"),
    )
    rows = bad.join(rule, ["template_key", "decision_key", "rule_pos"]).join(field, ["template_key", "decision_key"])
    fields = F.try_variant_get(V.as_object(F.col("context")), "$", "map<string,variant>")
    value = F.try_element_at(fields, F.col("field"))
    return rows.select(
        *KEY, "decision_key", "after_step", "rule", "expected", "actual_step", "field",
        V.plain_text(value).alias("value"), V.value_text(value).alias("value_json"),
    )


# How an issue is worded (decision, field, then what the issue adds).
ISSUE_TEXTS = {
    "no_snapshot": "Uncheckable context missing: decision point %s field %s requires a snapshot. event occurred_at=%s",
    "not_loaded": "Uncheckable context missing: decision point %s field %s snapshot has no loaded_at timestamp. event occurred_at=%s",
    SKEW: "Uncertain context time skew: decision point %s field %s snapshot freshness_seconds=%d is negative. event occurred_at=%s loaded_at=%s",
    STALE: "Uncertain context stale: decision point %s field %s snapshot freshness_seconds=%d exceeds max_delay_seconds=%d. event occurred_at=%s loaded_at=%s",
}


def context_freshness_issues(evaluated: DataFrame) -> DataFrame:
    """Decisions that could not be checked: the status that says why, the field it is about, the limit, and the text.

    An issue is about the first field that must be fresh, unless only a later one is missing."""
    known = F.coalesce(F.map_keys(F.try_variant_get(V.as_object(F.col("sum_context")), "$", "map<string,variant>")), F.array().cast("array<string>"))
    absent = F.filter("fresh_names", lambda n: ~F.col("has_snapshot") | ~F.array_contains(known, n))
    shot_at = F.coalesce("sum_occurred_at", "occurred_at")
    fresh = F.coalesce(F.unix_seconds("sum_loaded_at") - F.unix_seconds(shot_at), F.col("sum_freshness"))
    first, lost = F.get("fresh_names", F.lit(0)), F.get(absent, F.lit(0))
    not_loaded = (F.col("context_issue") == MISSING) & F.col("sum_loaded_at").isNull() & ~F.coalesce(first == lost, F.lit(False))
    rows = evaluated.filter(F.col("context_issue").isNotNull()).withColumns(
        {"_unread": not_loaded, "freshness": fresh, "field": F.when((F.col("context_issue") == MISSING) & ~not_loaded, lost).otherwise(first)}
    )

    def iso(t: Column | str) -> Column:
        return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx")

    head, times = ["decision_key", "field"], [iso(shot_at), iso("sum_loaded_at")]
    message = (
        F.when(F.col("_unread"), F.format_string(ISSUE_TEXTS["not_loaded"], *head, times[0]))
        .when(F.col("context_issue") == SKEW, F.format_string(ISSUE_TEXTS[SKEW], *head, "freshness", *times))
        .when(F.col("context_issue") == STALE, F.format_string(ISSUE_TEXTS[STALE], *head, "freshness", "max_delay", *times))
        .otherwise(F.format_string(ISSUE_TEXTS["no_snapshot"], *head, times[0]))
    )
    return rows.select(
        *KEY, "decision_pos", "decision_key", "after_step", "context_issue", "sum_freshness",
        "field", "freshness", F.col("max_delay").alias("max_delay_seconds"), message.alias("message"),
    )


def context_status(issues: DataFrame) -> DataFrame:
    """Worst issue per case: missing > time skew > stale."""
    rank = F.when(F.col("context_issue") == MISSING, 3).when(F.col("context_issue") == SKEW, 2).otherwise(1)
    return issues.groupBy(*KEY).agg(
        F.max_by("context_issue", rank).alias("context_status"), F.count(F.lit(1)).alias("context_issue_count")
    )


def activated_groups(evaluated: DataFrame) -> DataFrame:
    """Groups a decision chose, whether or not the case then obeyed."""
    return evaluated.filter(F.col("next_group").isNotNull()).select(*KEY, F.col("next_group").alias("group_key"))
