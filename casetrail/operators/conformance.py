"""Does each case follow its template?  One finding row per violation.

Case-level checks work on a *profile*: one row per case and template with the
first position of the template's own steps, so its maps are as small as the
template, however long the case is.  Step-level checks stay on entry rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casetrail.operators.cases import CASE
from casetrail.plans.templates import TemplateSet

KEY = CASE + ["template_key"]
FINDING = KEY + [
    "finding_type",
    "ordinal",
    "message",
    "from_step",
    "actual_step",
    "expected",
    "decision_key",
    "after_step",
]


def findings_frame(df: DataFrame, kind: str, message: Column, **cols: Column) -> DataFrame:
    """Shape ``df`` as findings; columns not given are null (ordinal 0)."""
    types = {"ordinal": "long", "expected": "array<string>"}
    out = []
    for c in FINDING[len(KEY) + 1 :]:
        if c == "message":
            out.append(message.alias("message"))
        elif c in cols:
            out.append(cols[c].cast(types.get(c, "string")).alias(c))
        elif c == "ordinal":
            out.append(F.lit(0).cast("long").alias(c))
        else:
            out.append(F.lit(None).cast(types.get(c, "string")).alias(c))
    return df.select(*KEY, F.lit(kind).alias("finding_type"), *out)


def case_profiles(entries: DataFrame, templates: TemplateSet) -> DataFrame:
    """Per case and template: ``first_at`` map(step -> first entry) over the steps
    the template mentions, number of entries, and the template's arrays."""
    tagged = templates.expand(entries)
    refs = templates.referenced().withColumn("_ref", F.col("step_key"))
    firsts = (
        tagged.join(refs, ["template_key", "step_key"], "left")
        .groupBy(*KEY, "_ref")
        .agg(F.min("entry").alias("_first"), F.count(F.lit(1)).alias("_n"))
    )
    profile = firsts.groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_ref").isNotNull(), F.struct("_ref", "_first")))).alias(
            "first_at"
        ),
        F.sum("_n").alias("entry_count"),
    )
    return profile.join(templates.profiles(), "template_key")


def missing_steps(profiles: DataFrame) -> DataFrame:
    """Expected steps never observed."""
    gone = F.array_except("expected", F.map_keys("first_at"))
    d = profiles.select(*KEY, F.posexplode(gone).alias("_i", "_s"))
    return findings_frame(
        d, "missing_step", F.concat(F.lit("Missing step: "), F.col("_s")), ordinal=F.col("_i"), actual_step=F.col("_s")
    )


def unexpected_steps(entries: DataFrame, templates: TemplateSet) -> DataFrame:
    """Observed entries whose step the template does not know, one row per entry."""
    d = templates.expand(entries).join(templates.known(), ["template_key", "step_key"], "left_anti")
    return findings_frame(
        d,
        "unexpected_step",
        F.concat(F.lit("Unexpected step: "), F.col("step_key")),
        ordinal=F.col("entry"),
        actual_step=F.col("step_key"),
    )


def wrong_order(profiles: DataFrame) -> DataFrame:
    """At most one row per case: some expected pair was first seen the other way round."""
    hit = F.exists("pairs", lambda p: F.coalesce(F.col("first_at")[p["l"]] > F.col("first_at")[p["r"]], F.lit(False)))
    return findings_frame(profiles.filter(hit), "wrong_order", F.lit("Wrong order"))


def transition_violations(entries: DataFrame, templates: TemplateSet) -> DataFrame:
    """Adjacent entries whose target is not among the targets allowed for the source."""
    d = (
        templates.expand(entries.filter(F.col("next_step").isNotNull()))
        .join(templates.targets(), ["template_key", "step_key"])
        .filter(~F.array_contains("allowed", F.col("next_step")))
    )
    message = F.concat(
        F.lit("Transition violation: "),
        F.col("step_key"),
        F.lit(" expected one of "),
        F.array_join("allowed", ", "),
        F.lit(" but got "),
        F.col("next_step"),
    )
    return findings_frame(
        d,
        "transition_violation",
        message,
        ordinal=F.col("entry"),
        from_step=F.col("step_key"),
        actual_step=F.col("next_step"),
        expected=F.col("allowed"),
    )


def parallel_group_activation(profiles: DataFrame, activated: DataFrame | None = None) -> DataFrame:
    """Any-order groups per case with ``active`` and the missing members.

    A group is active when a decision chose it (``activated``: case, template,
    group_key), when no transition points to it, or when a pointing step was
    seen.
    """
    seen = F.map_keys("first_at")
    g = profiles.withColumn("seen", seen).select(*KEY, "seen", F.inline("groups"))
    by_step = (F.size("activators") == 0) | F.arrays_overlap("activators", "seen")
    if activated is not None:
        chosen = activated.select(*KEY, "group_key").distinct().withColumn("_chosen", F.lit(True))
        g = g.join(chosen, KEY + ["group_key"], "left")
        by_step = by_step | F.coalesce("_chosen", F.lit(False))
    return g.select(
        *KEY,
        "group_pos",
        "group_key",
        "next_step",
        by_step.alias("active"),
        F.array_except("required", "seen").alias("missing"),
        F.array_contains("seen", F.col("next_step")).alias("next_seen"),
        "required",
    )


def _incomplete_text() -> Column:
    return F.concat(
        F.lit("Parallel Group incomplete: "),
        F.col("group_key"),
        F.lit(" (missing: "),
        F.array_join("missing", ", "),
        F.lit(")"),
    )


def parallel_group_incomplete(groups: DataFrame) -> DataFrame:
    d = groups.filter(F.col("active") & (F.size("missing") > 0))
    return findings_frame(
        d, "parallel_group_incomplete", _incomplete_text(), ordinal=F.col("group_pos"), expected=F.col("missing")
    )


def parallel_group_next_missing(groups: DataFrame) -> DataFrame:
    d = groups.filter(
        F.col("active") & (F.size("missing") == 0) & F.col("next_step").isNotNull() & ~F.col("next_seen")
    )
    message = F.concat(
        F.lit("Missing next after parallel group: "), F.col("group_key"), F.lit(" -> "), F.col("next_step")
    )
    return findings_frame(
        d,
        "parallel_group_next_missing",
        message,
        ordinal=F.col("group_pos"),
        expected=F.array("next_step"),
    )


def parallel_group_messages(groups: DataFrame) -> DataFrame:
    """Status row of every active group."""
    done = F.concat(F.lit("Parallel Group satisfied: "), F.col("group_key"))
    done = F.when(F.col("next_step").isNull(), done).otherwise(
        F.concat(done, F.lit(" (next: "), F.col("next_step"), F.lit(")"))
    )
    satisfied = F.size("missing") == 0
    return groups.filter("active").select(
        *KEY, "group_key", satisfied.alias("satisfied"), F.when(satisfied, done).otherwise(_incomplete_text()).alias("message")
    )
