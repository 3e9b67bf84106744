"""The whole process check as one plan over all cases and templates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from casetrail.operators import cases, conformance, decisions, findings, signoff
from casetrail.plans.templates import TemplateSet
from casetrail.sources.scratch import held, staged


@dataclass(frozen=True)
class ProcessCheck:
    """Lazy frames of one check; nothing runs until one of them is used."""

    entries: DataFrame
    profiles: DataFrame
    evaluated: DataFrame
    groups: DataFrame
    findings: DataFrame
    issues: DataFrame
    signs: DataFrame | None
    status: DataFrame


def templated(events: DataFrame, templates: TemplateSet) -> DataFrame:
    """Events of processes that have a template; a short list prunes log partitions."""
    names = sorted({t.process_key for t in templates})
    if len(names) <= 1000:
        return events.filter(F.col("process_key").isin(*names))
    return events.join(templates.processes().select("process_key").distinct(), "process_key", "left_semi")


def case_entries(
    events: DataFrame, snapshots: DataFrame, templates: TemplateSet, version="latest", order="occurred-then-received"
) -> DataFrame:
    """Collapsed entries of every case a template exists for."""
    known = templated(events, templates)
    timeline = cases.case_timeline(known, version=version, order=order, snapshots=snapshots)
    return cases.collapse_repeats(timeline, templates.context_fields(), order)


def step_entries(
    events: DataFrame, templates: TemplateSet, version="latest", order="occurred-then-received"
) -> DataFrame:
    """Entries for the checks that look at steps only: no contexts, no aggregation."""
    known = templated(events, templates)
    return cases.run_starts(cases.case_timeline(known, version=version, order=order), order=order)


def check_processes(
    events: DataFrame,
    snapshots: DataFrame,
    templates: TemplateSet,
    version="latest",
    order="occurred-then-received",
    stage: bool = True,
) -> ProcessCheck:
    """All checks of all cases.

    Entries, profiles and evaluated decisions feed many branches; with ``stage``
    profiles and decisions are written once to the shared folder and read back,
    and entries are held where they are made, with the cases together.
    """
    keep = staged if stage else (lambda df, name: df)
    entries = case_entries(events, snapshots, templates, version, order)
    entries = held(entries) if stage else entries
    profiles = keep(conformance.case_profiles(entries, templates), "profiles")
    evaluated = keep(decisions.evaluate_decisions(entries, templates, profiles), "decisions")
    groups = conformance.parallel_group_activation(profiles, decisions.activated_groups(evaluated))
    issues = decisions.context_freshness_issues(evaluated)
    parts = [
        conformance.missing_steps(profiles),
        conformance.unexpected_steps(entries, templates),
        conformance.wrong_order(profiles),
        conformance.transition_violations(entries, templates),
        conformance.parallel_group_incomplete(groups),
        conformance.parallel_group_next_missing(groups),
        decisions.missing_decision_context(evaluated),
        decisions.decision_rule_violations(evaluated, templates, profiles),
    ]
    found = reduce(DataFrame.unionByName, parts)
    signs = signoff.sign_checks(entries, templates) if any(t.sign_checks for t in templates) else None
    status = findings.case_status(profiles, found, decisions.context_status(issues), signs)
    return ProcessCheck(entries, profiles, evaluated, groups, found, issues, signs, status)
