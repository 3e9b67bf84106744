"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from casetrail.plans.catalog import checks, contexts, exports, graphs, intakes, timelines

MODULES = [intakes, timelines, checks, contexts, graphs, exports]


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
