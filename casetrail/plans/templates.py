"""Expected processes: plain dicts in, small dimension tables out.

A template is configuration.  Its tables are broadcast only while they hold
fewer than ``SMALL_ROWS`` rows; larger sets join like any other table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from casetrail.functions import conditions

SMALL_ROWS = 20_000
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "exists")
START, END = "__start", "__end"


def _named(value, kind: T.DataType):
    """Tuples as dicts, as Arrow wants nested records."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_named(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: _named(v, f.dataType) for f, v in zip(kind.fields, value)}
    return value


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Configuration rows as a local table (no job), broadcast while small."""
    struct = T.StructType.fromDDL(schema)
    data = pa.Table.from_pylist([_named(r, struct) for r in rows], schema=to_arrow_schema(struct))
    df = spark.createDataFrame(data)
    return F.broadcast(df) if len(rows) < SMALL_ROWS else df


def _rule(raw: dict) -> dict:
    rule = {
        "next": raw.get("next"),
        "group": raw.get("next_parallel_group"),
        "else": bool(raw.get("else", False)),
        "when": None,
    }
    when = raw.get("when")
    if when:
        name, cond = next(iter(when.items()))
        op, value = next(iter(cond.items()))
        if op not in OPERATORS:
            raise ValueError(f"operator {op!r} of field {name!r} is not one of {OPERATORS}")
        rule["when"] = (name, op, value)
    elif not rule["else"]:
        raise ValueError("a decision rule needs 'when' or 'else'")
    return rule


class Template:
    """Checked copy of one template dict with the defaults filled in."""

    def __init__(self, raw: dict):
        self.key: str = raw["key"]
        self.process_key: str = raw.get("process_key", self.key)
        self.version: str = str(raw.get("version", "draft"))
        self.steps = [
            {
                "key": s["key"],
                "name": s.get("name", s["key"]),
                "required": bool(s.get("required", True)),
                "type": s.get("type", "normal"),
                "process_key": s.get("process_key"),
                "when": s.get("when", {}),
                "visibility": s.get("visibility", []),
            }
            for s in raw.get("steps", [])
        ]
        self.step_keys = [s["key"] for s in self.steps]
        if len(set(self.step_keys)) != len(self.step_keys):
            raise ValueError(f"template {self.key}: repeated step key")
        self.required_steps: list[str] = list(raw.get("required_steps", []))
        self.initial_step: str | None = raw.get("initial_step")
        self.transitions = [
            {"from": t["from"], "to": t.get("to"), "group": t.get("to_parallel_group")}
            for t in raw.get("transitions", [])
        ]
        self.groups = [
            {
                "key": g["key"],
                "required": list(g["required_steps"]),
                "order": g.get("order", "any"),
                "next": g.get("next"),
            }
            for g in raw.get("parallel_groups", [])
            if g.get("required_steps")
        ]
        self.decisions = [
            {
                "key": d["key"],
                "after": d.get("after"),
                "required": list(d.get("required_fields", [])),
                "rules": [_rule(r) for r in d["rules"]],
            }
            for d in raw.get("decision_points", [])
            if d.get("rules")
        ]
        self.fields: dict[str, str | None] = {
            name: m.get("stability") for name, m in raw.get("field_mappings", {}).items()
        }
        self.max_delay: int | None = raw.get("context_policy", {}).get("max_delay_seconds")
        self.sign_checks = [
            {"key": s["key"], "label": s.get("label", s["key"]), "required": s["required_set"], "actual": s["actual_set"]}
            for s in raw.get("sign_checks", [])
        ]
        self.routing = [r for r in raw.get("routing", []) if r.get("when")]
        self.probes: dict[str, dict] = raw.get("access_probes", {})
        self.profiles: dict[str, dict] = raw.get("visibility_profiles", {})
        self.resolvers: dict[str, dict] = raw.get("visibility_resolvers", {})
        for d in self.decisions:
            for name in self.decision_fields(d):
                if self.fields.get(name) is None:
                    raise ValueError(f"template {self.key}: decision field {name!r} has no stability")

    @staticmethod
    def decision_fields(decision: dict) -> list[str]:
        names = list(decision["required"]) + [r["when"][0] for r in decision["rules"] if r["when"]]
        return list(dict.fromkeys(names))

    @property
    def any_groups(self) -> list[dict]:
        return [g for g in self.groups if g["order"] == "any"]

    @property
    def expected_steps(self) -> list[str]:
        return self.required_steps or self.step_keys

    @property
    def known_steps(self) -> list[str]:
        known = self.step_keys + self.required_steps
        for g in self.any_groups:
            known += g["required"] + ([g["next"]] if g["next"] else [])
        return list(dict.fromkeys(known or self.expected_steps))

    @property
    def start_step(self) -> str | None:
        return self.initial_step or (self.step_keys[0] if self.step_keys else None)

    def context_fields(self) -> list[str]:
        names = [n for d in self.decisions for n in self.decision_fields(d)]
        names += [n for s in self.sign_checks for n in (s["required"], s["actual"])]
        return list(dict.fromkeys(names))

    def allowed_targets(self) -> dict[str, list[str]]:
        groups = {}
        for g in self.any_groups:
            groups.setdefault(g["key"], g["required"])
        out: dict[str, list[str]] = {}
        for t in self.transitions:
            targets = [t["to"]] if t["to"] is not None else groups.get(t["group"], [])
            out.setdefault(t["from"], []).extend(targets)
        return {k: list(dict.fromkeys(v)) for k, v in out.items() if v}

    def ordered_pairs(self) -> list[tuple[str, str]]:
        """Expected (earlier, later) pairs, without pairs inside one any-order group."""
        home = {s: g["key"] for g in self.any_groups for s in g["required"]}
        steps = self.expected_steps
        return [
            (a, b)
            for i, a in enumerate(steps)
            for b in steps[i + 1 :]
            if not (a in home and b in home and home[a] == home[b])
        ]

    def referenced_steps(self) -> list[str]:
        refs = list(self.known_steps) + self.expected_steps
        refs += [t["from"] for t in self.transitions]
        refs += [d["after"] for d in self.decisions if d["after"]]
        return list(dict.fromkeys(refs))


class TemplateSet:
    """Several templates as tables keyed by ``template_key``."""

    def __init__(self, spark: SparkSession, templates: list[dict]):
        self.spark = spark
        self.templates = [Template(t) for t in templates]

    def __iter__(self):
        return iter(self.templates)

    def is_small(self) -> bool:
        """Few enough decisions for tables made of them to be broadcast."""
        return sum(len(t.decisions) for t in self) < SMALL_ROWS

    def context_fields(self) -> list[str]:
        return list(dict.fromkeys(n for t in self for n in t.context_fields()))

    def _table(self, rows, schema) -> DataFrame:
        return small_table(self.spark, rows, schema)

    def processes(self) -> DataFrame:
        return self._table(
            [(t.key, t.process_key, t.start_step) for t in self],
            "template_key string, process_key string, start_step string",
        )

    def steps(self) -> DataFrame:
        return self._table(
            [(t.key, i, s["key"]) for t in self for i, s in enumerate(t.steps)],
            "template_key string, step_pos int, step_key string",
        )

    def known(self) -> DataFrame:
        return self._table([(t.key, s) for t in self for s in t.known_steps], "template_key string, step_key string")

    def referenced(self) -> DataFrame:
        return self._table(
            [(t.key, s) for t in self for s in t.referenced_steps()], "template_key string, step_key string"
        )

    def targets(self) -> DataFrame:
        return self._table(
            [(t.key, f, to) for t in self for f, to in t.allowed_targets().items()],
            "template_key string, step_key string, allowed array<string>",
        )

    def direct_edges(self) -> DataFrame:
        rows = {(t.key, e["from"], e["to"]) for t in self for e in t.transitions if e["to"] is not None}
        return self._table(sorted(rows), "template_key string, from_step string, to_step string")

    def profiles(self) -> DataFrame:
        """One row per template: expected steps, ordered pairs, any-order groups."""
        rows = []
        for t in self:
            groups = [
                (
                    i,
                    g["key"],
                    g["required"],
                    g["next"],
                    [e["from"] for e in t.transitions if e["to"] is None and e["group"] == g["key"]],
                )
                for i, g in enumerate(t.any_groups)
            ]
            rows.append((t.key, t.expected_steps, t.ordered_pairs(), groups))
        return self._table(
            rows,
            "template_key string, expected array<string>, pairs array<struct<l:string,r:string>>,"
            " groups array<struct<group_pos:int,group_key:string,required:array<string>,next_step:string,"
            "activators:array<string>>>",
        )

    def groups(self) -> DataFrame:
        return self._table(
            [(t.key, g["key"], g["order"], g["next"], g["required"]) for t in self for g in t.groups],
            "template_key string, group_key string, group_order string, next_step string, required array<string>",
        )

    def decisions(self) -> DataFrame:
        return self._table(
            [(t.key, i, d["key"], d["after"]) for t in self for i, d in enumerate(t.decisions) if d["after"]],
            "template_key string, decision_pos int, decision_key string, after_step string",
        )

    def rules(self) -> DataFrame:
        return self._table(
            [
                (t.key, i, d["key"], d["after"], j, r["next"], r["group"], r["when"][0] if r["when"] else None, r["else"])
                for t in self
                for i, d in enumerate(t.decisions)
                for j, r in enumerate(d["rules"])
            ],
            "template_key string, decision_pos int, decision_key string, after_step string, rule_pos int,"
            " next_step string, next_group string, field string, is_else boolean",
        )

    def decision_rules(self) -> DataFrame:
        """Per decision: the fields it reads, those that must be fresh, the longest delay, and its rules as data."""
        rows = []
        for t in self:
            for i, d in enumerate(t.decisions):
                names = t.decision_fields(d)
                fresh = [n for n in names if t.fields.get(n) != "immutable"]
                rows.append((t.key, i, d["key"], d["after"], names, list(dict.fromkeys(d["required"])), fresh, t.max_delay, conditions.rules(d)))
        return self._table(
            rows,
            "template_key string, decision_pos int, decision_key string, after_step string, names array<string>,"
            f" required_names array<string>, fresh_names array<string>, max_delay long, rules {conditions.RULES}",
        )

    def expand(self, df: DataFrame) -> DataFrame:
        """Tag rows carrying ``process_key`` with every template of that process."""
        return df.join(self.processes(), "process_key").withColumnRenamed("start_step", "_start").drop("_start")
