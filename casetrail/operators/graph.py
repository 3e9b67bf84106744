"""Expected graph of a template and observed transitions laid over it.

The graph comes from the template tables alone: edges are a union of one small query per
kind, sinks an anti-join, classes of step pairs one join per kind and a rank. Templates
are configuration, so these tables are made with pandas on the driver and joined to the
log, which Spark aggregates, as small tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from casetrail.functions import conditions as C, values as V
from casetrail.operators.cases import CASE, order_columns, run_starts, with_neighbours
from casetrail.operators.kpi import durations_of, step_times
from casetrail.operators.quantiles import exact_quantiles, value_counts
from casetrail.plans.templates import END, START, TemplateSet, small_table
from casetrail.sources.scratch import held, staged

DIRECT = "EXPECTED_DIRECT"
VIA_DECISION = "EXPECTED_VIA_DECISION"
VIA_GROUP = "EXPECTED_VIA_PARALLEL_GROUP"
INTERNAL = "EXPECTED_GROUP_INTERNAL"
COMPLETE = "EXPECTED_GROUP_COMPLETE"
UNEXPECTED = "UNEXPECTED"
#: Of several classes of a pair, the first counts.
RANK = {c: i for i, c in enumerate([DIRECT, VIA_DECISION, VIA_GROUP, INTERNAL, COMPLETE])}

# How an operator is written on an edge.
SYMBOLS = {"eq": "=", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "in", "exists": "exists"}

EDGE = ["t", "from_node", "to_node", "label", "condition", "style"]
EDGE_LIST = "array<struct<from_node:string,to_node:string>>"
CANDIDATES = f"array<struct<decision_key:string,rule_pos:int,classification:string,edges:{EDGE_LIST}>>"


def _condition(when: tuple) -> str:
    name, op, value = when
    shown = str(value).lower() if isinstance(value, bool) else value if isinstance(value, str) else V.canonical(value)
    return f"{name} {SYMBOLS[op]} {shown}"


def _frame(rows: list[tuple], columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns.split(), dtype=object)


class _Source:
    """Templates as relations: steps, transitions, members of groups, rules of decisions."""

    def __init__(self, templates: TemplateSet):
        ts = list(templates)
        self.templates = [t.key for t in ts]
        self.steps = _frame([(t.key, i, x["key"], x["name"], x["required"]) for t in ts for i, x in enumerate(t.steps)], "t pos step name required")
        self.starts = _frame([(t.key, t.start_step) for t in ts if t.step_keys], "t step")
        self.transitions = _frame([(t.key, i, e["from"], e["to"], e["group"]) for t in ts for i, e in enumerate(t.transitions)], "t pos step to group")
        groups = _frame([(t.key, i, g["key"], g["order"], g["next"], len(g["required"])) for t in ts for i, g in enumerate(t.groups)], "t gpos group order next size")
        kind = groups["next"].map(lambda n: "parallel:" if n is None else "parallel_start:")
        self.groups = groups.assign(entry=kind + groups["group"], join="parallel_join:" + groups["group"])
        listed = _frame([(t.key, i, m) for t in ts for i, g in enumerate(t.groups) for m in g["required"]], "t gpos member")
        self.members = listed.merge(self.groups, on=["t", "gpos"])
        rules = [
            (t.key, i, d["key"], d["after"], j, r["next"], r["group"], None if r["else"] or not r["when"] else _condition(r["when"]))
            for t in ts for i, d in enumerate(t.decisions) for j, r in enumerate(d["rules"])
        ]
        self.rules = _frame(rules, "t dpos decision after rule next group condition")
        self.rules["gate"] = "decision:" + self.rules["decision"]
        # a key that groups share names the first of them
        self.named = self.groups.drop_duplicates(["t", "group"])[["t", "group", "gpos", "entry"]]

    def entry(self, rows: pd.DataFrame) -> pd.Series:
        """Node that leads into the group of each row; a group that is not declared is drawn as one node."""
        known = rows[["t", "group"]].merge(self.named, how="left", on=["t", "group"])["entry"]
        known.index = rows.index
        return known.where(known.notna(), "parallel:" + rows["group"])


def _edges(src: _Source) -> pd.DataFrame:
    def drawn(rows: pd.DataFrame, start, end, label=None, condition=None, style="flow") -> pd.DataFrame:
        return pd.DataFrame({"t": rows["t"], "from_node": start, "to_node": end, "label": label, "condition": condition, "style": style}, dtype=object)

    r, m, g, tr, st = src.rules, src.members, src.groups, src.transitions, src.steps
    aimed = r.assign(target=r["next"].where(r["group"].isna(), src.entry(r)))
    aimed = aimed[aimed["target"].notna()]
    label = ["[else]" if pd.isna(c) else f"[{n + 1}] {c}" for n, c in zip(aimed["rule"], aimed["condition"], strict=True)]
    open_, closed = m[m["next"].isna()], m[m["next"].notna()]
    left = g[g["next"].notna()]
    direct, grouped = tr[tr["to"].notna()], tr[tr["to"].isna() & tr["group"].notna()]
    following = st.assign(then=st.groupby("t")["step"].shift(-1)).dropna(subset=["then"])
    stays = pd.concat([r[["t", "after"]].rename(columns={"after": "step"}), m[["t", "member"]].rename(columns={"member": "step"})]).drop_duplicates()
    following = following[~following["t"].isin(tr["t"])].merge(stays, how="left", on=["t", "step"], indicator=True)
    following = following[following["_merge"] == "left_only"]
    flows = pd.concat([
        drawn(src.starts, START, src.starts["step"]),
        drawn(direct, direct["step"], direct["to"]),
        drawn(grouped, grouped["step"], src.entry(grouped)),
        drawn(following, following["step"], following["then"], "default order", None, "implicit"),
        drawn(r[r["after"].notna()], r["after"].dropna(), r["gate"]),
        drawn(aimed, aimed["gate"], aimed["target"], label, aimed["condition"]),
        drawn(open_, open_["member"], open_["entry"], "part of", None, "constraint"),
        drawn(closed, closed["entry"], closed["member"]),
        drawn(closed, closed["member"], closed["join"]),
        drawn(left, left["join"], left["next"]),
    ])
    tasks = _nodes(src, flows)
    tasks = tasks[tasks["node_type"] == "task"][["t", "node_id"]]
    sinks = tasks.merge(flows[["t", "from_node"]].drop_duplicates(), how="left", left_on=["t", "node_id"], right_on=["t", "from_node"])
    sinks = sinks[sinks["from_node"].isna()]
    out = pd.concat([flows, drawn(sinks, sinks["node_id"], END)])[EDGE]
    return out.astype(object).where(out.notna(), None).drop_duplicates(ignore_index=True)


def _nodes(src: _Source, edges: pd.DataFrame) -> pd.DataFrame:
    """Every node once: declared kinds before steps, steps before mere ends of edges."""
    def of(rows: pd.DataFrame, node, kind, label=None, required=None) -> pd.DataFrame:
        return pd.DataFrame({"t": rows["t"], "node_id": node, "node_type": kind, "label": label, "required": required}, dtype=object)

    every, g, st = pd.DataFrame({"t": src.templates}, dtype=object), src.groups, src.steps
    left = g[g["next"].notna()]
    out = pd.concat([
        of(every, START, "start"), of(every, END, "end"), of(src.rules, src.rules["gate"], "exclusive_gateway"),
        of(left, left["entry"], "parallel_start"), of(left, left["join"], "parallel_join"),
        of(g[g["next"].isna()], g[g["next"].isna()]["entry"], "parallel_group"),
        of(st, st["step"], "task", st["name"], st["required"]),
        of(edges, edges["from_node"], "task"), of(edges, edges["to_node"], "task"),
    ])
    out = out.drop_duplicates(["t", "node_id"], ignore_index=True)
    return out.astype(object).where(out.notna(), None)


def _pairs(src: _Source, edges: pd.DataFrame) -> pd.DataFrame:
    """Classes that a pair of steps may have, the one that counts first; a class through a decision holds for one rule."""
    def classed(rows: pd.DataFrame, a, b, kind, path, order=(0, 0), decision=None, rule=None) -> pd.DataFrame:
        return pd.DataFrame(
            {"t": rows["t"], "a": a, "b": b, "kind": kind, "path": list(path), "o1": order[0], "o2": order[1], "decision": decision, "rule": rule}, dtype=object
        )

    flow = edges[edges["style"] == "flow"][["t", "from_node", "to_node"]].drop_duplicates()
    r, m, tr = src.rules[src.rules["after"].notna()], src.members, src.transitions
    inside = m.merge(src.named[["t", "group", "gpos"]], on=["t", "group", "gpos"])
    plain, grouped = r[r["next"].notna()], r[r["group"].notna()].merge(inside, on=["t", "group"], suffixes=("", "_g"))
    into = tr[tr["group"].notna()].merge(inside, on=["t", "group"])
    both = m[m["order"] == "any"]
    both = both.merge(both, on=["t", "gpos"], suffixes=("", "_b"))
    done = m[m["next"].notna()]

    def legs(rows: pd.DataFrame, *nodes: str) -> list[list[tuple]]:
        return [list(zip(row, row[1:])) for row in rows[list(nodes)].itertuples(index=False, name=None)]

    def into_group(rows: pd.DataFrame, *nodes: str) -> list[list[tuple]]:
        """The last leg is drawn only out of a start node."""
        whole = legs(rows, *nodes)
        return [w if n is not None else w[:-1] for w, n in zip(whole, rows["next_g" if "next_g" in rows else "next"], strict=True)]

    out = pd.concat([
        classed(flow, flow["from_node"], flow["to_node"], DIRECT, legs(flow, "from_node", "to_node")),
        classed(plain, plain["after"], plain["next"], VIA_DECISION, legs(plain, "after", "gate", "next"), (plain["dpos"], plain["rule"]), plain["decision"], plain["rule"]),
        classed(grouped, grouped["after"], grouped["member"], VIA_DECISION, into_group(grouped, "after", "gate", "entry", "member"), (grouped["dpos"], grouped["rule"]), grouped["decision"], grouped["rule"]),
        classed(into, into["step"], into["member"], VIA_GROUP, into_group(into, "step", "entry", "member"), (into["pos"], 0)),
        classed(both, both["member"], both["member_b"], INTERNAL, [[] for _ in range(len(both))], (both["gpos"], 0)),
        classed(done, done["member"], done["next"], COMPLETE, legs(done, "member", "join", "next"), (done["gpos"], 0)),
    ])
    return out.assign(rank=out["kind"].map(RANK)).sort_values(["t", "a", "b", "rank", "o1", "o2"], kind="stable")


def picked_rules(rows: DataFrame, templates: TemplateSet, obj: Column) -> DataFrame:
    """Add ``_picked``: the decisions after ``step_key`` with the rule that the context matches; null without a context."""
    each = F.struct("decision_pos", "decision_key", "names", "rules")
    here = (
        templates.decision_rules().filter(F.col("after_step").isNotNull())
        .groupBy("template_key", F.col("after_step").alias("step_key"))
        .agg(F.array_sort(F.collect_list(each)).alias("_decisions"), F.flatten(F.collect_set("names")).alias("_names"))
    )
    pairs = C.let(
        C.facts(obj, F.col("_names")),
        lambda seen: F.transform("_decisions", lambda d: F.struct(d["decision_key"].alias("key"), C.first_rule(seen, d["rules"]).alias("rule_pos"))),
    )
    none = F.create_map().cast("map<string,int>")
    picked = F.when(F.col("_decisions").isNull(), none).when(obj.isNotNull(), F.map_from_entries(pairs))
    out = rows.join(F.broadcast(here) if templates.is_small() else here, ["template_key", "step_key"], "left")
    return out.withColumn("_picked", picked).drop("_decisions", "_names")


class GraphTables:
    """Graph of each template as small tables."""

    def __init__(self, templates: TemplateSet):
        self.templates, self.spark = templates, templates.spark
        self.source = _Source(templates)
        self._edge_rows = _edges(self.source)

    def _table(self, rows: pd.DataFrame, columns: list[str], schema: str) -> DataFrame:
        return small_table(self.spark, list(rows[columns].itertuples(index=False, name=None)), schema)

    def nodes(self) -> DataFrame:
        """A step has its name and whether it is required, other nodes neither."""
        rows = _nodes(self.source, self._edge_rows)
        return self._table(rows, ["t", "node_id", "node_type", "label", "required"], "template_key string, node_id string, node_type string, label string, required boolean")

    def edges(self) -> DataFrame:
        schema = "template_key string, from_node string, to_node string, label string, condition string, style string"
        return self._table(self._edge_rows, EDGE, schema)

    def candidates(self) -> DataFrame:
        """Per pair of steps its possible classes, in order."""
        rows = [
            (t, a, b, [(r.decision if pd.notna(r.decision) else None, int(r.rule) if pd.notna(r.rule) else None, r.kind, r.path) for r in g.itertuples()])
            for (t, a, b), g in _pairs(self.source, self._edge_rows).groupby(["t", "a", "b"], sort=False)
        ]
        return small_table(self.spark, rows, f"template_key string, step_key string, to_step string, candidates {CANDIDATES}")

    def members(self) -> DataFrame:
        columns = ["t", "group", "member", "entry", "size"]
        schema = "template_key string, group_key string, step_key string, start_node string, group_size int"
        return self._table(self.source.members, columns, schema)


def expected_graph(templates: TemplateSet) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all templates."""
    g = GraphTables(templates)
    return g.nodes(), g.edges()


def project_transitions(
    timeline: DataFrame, templates: TemplateSet, order: str = "occurred-then-received"
) -> DataFrame:
    """Each event with ``to_step``, ``to_at``, ``classification`` and ``edges``
    (null for the last event of a case).  Needs ``ctx``; ``order`` is the order
    the timeline was numbered by."""
    nxt = with_neighbours(
        timeline, next={"to_step": "step_key", "to_at": "occurred_at"}, order=order_columns(order)
    )
    tagged = templates.expand(nxt)
    tagged = picked_rules(tagged, templates, V.as_object(F.col("ctx")))
    looked = tagged.join(GraphTables(templates).candidates(), ["template_key", "step_key", "to_step"], "left")
    fits = F.filter(
        "candidates",
        lambda c: c["decision_key"].isNull()
        | F.col("_picked").isNull()
        | F.coalesce(F.try_element_at("_picked", c["decision_key"]) == c["rule_pos"], F.lit(False)),
    )
    looked = looked.withColumn("_class", F.get(fits, F.lit(0))).select(
        *tagged.drop("_picked").columns, F.col("_class.edges").alias("edges"), F.col("_class.classification").alias("classification")
    )
    own = F.array(F.struct(F.col("step_key").alias("from_node"), F.col("to_step").alias("to_node"))).cast(EDGE_LIST)
    is_pair = F.col("to_step").isNotNull()
    return looked.withColumns(
        {
            "edges": F.when(is_pair, F.coalesce("edges", own)),
            "classification": F.when(is_pair, F.coalesce("classification", F.lit(UNEXPECTED))),
        }
    )


def transition_classes(projected: DataFrame) -> DataFrame:
    """Observed pairs by class."""
    return (
        projected.filter(F.col("classification").isNotNull())
        .groupBy("template_key", F.col("step_key").alias("from_step"), "to_step", "classification", "edges")
        .agg(F.count(F.lit(1)).alias("observed"))
    )


def edge_metrics(projected: DataFrame, templates: TemplateSet) -> DataFrame:
    """Observed and deviating passages per edge, expected edges included."""
    return edges_of(transition_classes(projected), templates)


def edges_of(pairs: DataFrame, templates: TemplateSet) -> DataFrame:
    """``edge_metrics`` from counted pairs."""
    bad = F.col("classification") == UNEXPECTED
    seen = (
        pairs.select("template_key", "observed", bad.alias("_bad"), F.inline("edges"))
        .groupBy("template_key", "from_node", "to_node")
        .agg(
            F.sum("observed").alias("observed"),
            F.sum(F.when(F.col("_bad"), F.col("observed")).otherwise(0)).alias("deviations"),
            F.min("_bad").alias("_only_bad"),
        )
    )
    flow = (
        GraphTables(templates).edges()
        .filter(F.col("style") == "flow")
        .select("template_key", "from_node", "to_node")
        .distinct()
        .withColumn("_flow", F.lit(True))
    )
    expected = F.coalesce("_flow", F.lit(False)) | ~F.coalesce("_only_bad", F.lit(True))
    return (
        seen.join(flow, ["template_key", "from_node", "to_node"], "full_outer")
        .withColumns({"is_expected": expected, "is_observed_only": ~expected})
        .fillna(0, ["observed", "deviations"])
        .drop("_flow", "_only_bad")
    )


def _completed_groups(projected: DataFrame, templates: TemplateSet) -> DataFrame:
    """Per case and group whose members were all seen: seconds from activation
    (or first member) to the event that completed it."""
    tables = GraphTables(templates)
    members = tables.members()
    at = F.struct("pos", "occurred_at")
    first = (
        projected.join(members, ["template_key", "step_key"])
        .groupBy(*CASE, "template_key", "group_key", "start_node", "group_size", "step_key")
        .agg(F.min(at).alias("_at"))
        .groupBy(*CASE, "template_key", "group_key", "start_node", "group_size")
        .agg(F.count(F.lit(1)).alias("_seen"), F.min("_at").alias("_first"), F.max("_at").alias("_done"))
        .filter(F.col("_seen") == F.col("group_size"))
    )
    starts = members.select("template_key", "group_key", F.col("start_node").alias("to_node")).distinct()
    activation = (
        projected.filter(F.size("edges") > 0)
        .select(*CASE, "template_key", "pos", "occurred_at", F.inline("edges"))
        .join(starts, ["template_key", "to_node"])
        .groupBy(*CASE, "template_key", "group_key")
        .agg(F.min(at).alias("_act"))
    )
    began = F.least("_first", "_act")
    return first.join(activation, CASE + ["template_key", "group_key"], "left").select(
        *CASE,
        "template_key",
        "group_key",
        "start_node",
        F.greatest(
            F.lit(0).cast("long"),
            F.unix_seconds("_done.occurred_at") - F.unix_seconds(F.coalesce(began, F.col("_first"))["occurred_at"]),
        ).alias("seconds"),
    )


def node_flow(projected: DataFrame, templates: TemplateSet) -> DataFrame:
    """Distinct cases touching each node, gateways and completed joins included."""
    return flow_of(touched_nodes(projected, _completed_groups(projected, templates), templates), templates)


def touched_nodes(projected: DataFrame, groups: DataFrame, templates: TemplateSet) -> DataFrame:
    """Cases (``n``) per node. A case counts once, so counts of different cases add up."""
    tables = GraphTables(templates)
    key = ["process_key", "document_uuid", "template_key"]
    own = projected.select(*key, F.col("step_key").alias("node_id"))
    ends = (
        projected.filter(F.size("edges") > 0)
        .select(*key, "step_key", "to_step", F.inline("edges"))
        .select(*key, "step_key", "to_step", F.explode(F.array("from_node", "to_node")).alias("node_id"))
        .filter((F.col("node_id") != F.col("step_key")) & (F.col("node_id") != F.col("to_step")))
        .select(*key, "node_id")
    )
    known = tables.nodes()
    joins = groups.select(
        *key, F.concat(F.lit("parallel_join:"), "group_key").alias("node_id")
    )
    virtual = ends.unionByName(joins).join(known.select("template_key", "node_id"), ["template_key", "node_id"], "left_semi")
    touched = own.unionByName(virtual.select(*key, "node_id")).filter(~F.col("node_id").isin(START, END)).distinct()
    return touched.groupBy("template_key", "node_id").agg(F.count(F.lit(1)).alias("n"))


def flow_of(touched: DataFrame, templates: TemplateSet) -> DataFrame:
    """``node_flow`` from counted cases."""
    known = GraphTables(templates).nodes().drop("label", "required")
    flow = touched.withColumnRenamed("n", "flow_count")
    return flow.join(known, ["template_key", "node_id"], "left").fillna("task", ["node_type"])


def virtual_node_durations(projected: DataFrame, templates: TemplateSet) -> DataFrame:
    """One row per passage: waiting at decisions, time inside parallel groups."""
    return _virtual_durations(projected, _completed_groups(projected, templates), templates)


def _virtual_durations(projected: DataFrame, groups: DataFrame, templates: TemplateSet) -> DataFrame:
    known = GraphTables(templates).nodes().drop("label", "required").withColumnRenamed("node_id", "node_key")
    gate = F.filter("edges", lambda e: e["to_node"].startswith("decision:"))[0]["to_node"]
    waits = projected.filter(F.col("classification") == VIA_DECISION).select(
        "template_key",
        gate.alias("node_key"),
        F.greatest(F.lit(0).cast("long"), F.unix_seconds("to_at") - F.unix_seconds("occurred_at")).alias("seconds"),
    )
    join = groups.select("template_key", F.concat(F.lit("parallel_join:"), "group_key").alias("node_key"), "seconds")
    start = groups.select("template_key", F.col("start_node").alias("node_key"), "seconds").join(
        known.select("template_key", "node_key"), ["template_key", "node_key"], "left_semi"
    )
    rows = waits.unionByName(join).unionByName(start)
    return rows.join(known, ["template_key", "node_key"], "left").withColumn(
        "node_type", F.coalesce("node_type", F.lit("parallel_join"))
    )


#: What a gateway is known by in counted waiting times.
GATE = ["template_key", "node_key", "node_type"]


def duration_stats(rows: DataFrame, keys: list[str], value: str = "seconds") -> DataFrame:
    """Count, average, median, 95th percentile and maximum of whole seconds."""
    return stats_of(held(value_counts(rows, keys, value)), keys, value)


def stats_of(counts: DataFrame, keys: list[str], value: str = "seconds") -> DataFrame:
    """``duration_stats`` from counted values."""
    base = counts.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("avg_seconds"),
        F.max(value).cast("double").alias("max_seconds"),
    )
    return base.join(exact_quantiles(counts, keys, value, {"median_seconds": 0.5, "p95_seconds": 0.95}), keys)


def node_metrics(durations: DataFrame, virtual: DataFrame, flow: DataFrame, templates: TemplateSet) -> DataFrame:
    """Observed count, waiting times and flow of every node.

    ``durations`` is the duration heatmap.  A task's 95th percentile is its
    maximum; start steps have no reliable waiting time.
    """
    return _node_rows(durations, duration_stats(virtual, GATE), flow, templates)


def _node_rows(durations: DataFrame, stats: DataFrame, flow: DataFrame, templates: TemplateSet) -> DataFrame:
    starts = (
        GraphTables(templates).edges()
        .filter(F.col("from_node") == START)
        .select("template_key", F.col("to_node").alias("node_id"))
        .distinct()
        .withColumn("_start", F.lit(True))
    )
    tasks = (
        durations.select(
            "template_key",
            F.col("step_key").alias("node_id"),
            F.lit("task").alias("node_type"),
            (F.col("completed") + F.col("open")).alias("observed"),
            (F.col("avg_minutes") * 60).alias("avg_seconds"),
            (F.col("median_minutes") * 60).alias("median_seconds"),
            (F.col("max_minutes") * 60).alias("p95_seconds"),
            "completed",
        )
        .join(starts, ["template_key", "node_id"], "left")
        .withColumn("reliable", F.when(F.col("_start"), F.lit(0)).otherwise(F.col("completed")))
        .drop("_start", "completed")
    )
    gates = stats.select(
        "template_key",
        F.col("node_key").alias("node_id"),
        "node_type",
        F.col("n").alias("observed"),
        "avg_seconds",
        "median_seconds",
        "p95_seconds",
        F.col("n").alias("reliable"),
    )
    tasks = tasks.join(gates.select("template_key", "node_id"), ["template_key", "node_id"], "left_anti")
    f = flow.select("template_key", "node_id", F.col("node_type").alias("_type"), "flow_count")
    all_nodes = tasks.select(*gates.columns).unionByName(gates).join(f, ["template_key", "node_id"], "full_outer")
    zero = F.lit(0.0)
    return all_nodes.select(
        "template_key",
        "node_id",
        F.coalesce("node_type", "_type").alias("node_type"),
        F.coalesce("observed", "flow_count").alias("observed"),
        F.coalesce("avg_seconds", zero).alias("avg_seconds"),
        F.coalesce("median_seconds", zero).alias("median_seconds"),
        F.coalesce("p95_seconds", zero).alias("p95_seconds"),
        "reliable",
        F.coalesce("flow_count", F.lit(0)).alias("flow_count"),
    )


@dataclass(frozen=True)
class ProjectionMetrics:
    """Everything that is counted about a projection, in one written table: passages per pair of steps, cases per node,
    and waiting times per task and gateway as counts of whole seconds. Tables of different cases may be stacked: the
    frames below only add counts up."""

    counts: DataFrame
    templates: TemplateSet

    def _kind(self, kind: str, *columns: str) -> DataFrame:
        keys = [F.col(c) for c in columns]
        return self.counts.filter(F.col("kind") == kind).groupBy("template_key", *keys).agg(F.sum("n").alias("n"))

    def edges(self) -> DataFrame:
        pairs = self._kind("pair", "node", "other", "classification", "edges").withColumnsRenamed({"node": "from_step", "other": "to_step", "n": "observed"})
        return edges_of(pairs, self.templates)

    def flow(self) -> DataFrame:
        return flow_of(self._kind("case", "node").withColumnRenamed("node", "node_id"), self.templates)

    def gate_stats(self) -> DataFrame:
        waits = self._kind("gate", "node", "other", "seconds").withColumnsRenamed({"node": "node_key", "other": "node_type", "n": "_n"})
        return stats_of(waits, GATE)

    def durations(self) -> DataFrame:
        waits = self._kind("task", "node", "is_open", "seconds").withColumnsRenamed({"node": "step_key", "n": "_n"})
        return durations_of(waits, self.templates)

    def nodes(self) -> DataFrame:
        return _node_rows(self.durations(), self.gate_stats(), self.flow(), self.templates)


METRICS = ["template_key", "kind", "node", "other", "classification", "edges", "is_open", "seconds", "n"]


def projection_metrics(timeline: DataFrame, templates: TemplateSet, now: datetime, order: str = "occurred-then-received") -> ProjectionMetrics:
    """Project a timeline (with ``ctx``) once and count what the graph shows. The timeline and the projection are written
    once each, as the counts read them several times."""
    names = [*CASE, "pos", *order_columns(order), "step_key", "ctx", *[c for c in ("block",) if c in timeline.columns]]
    rows = staged(timeline.select(*dict.fromkeys(names)), "graph-timeline")
    projected = project_transitions(rows, templates, order)
    projected = staged(projected.select(*CASE, "template_key", "pos", "step_key", "to_step", "occurred_at", "to_at", "classification", "edges"), "projected")
    groups = staged(_completed_groups(projected, templates), "completed-groups")
    pairs = transition_classes(projected).withColumnsRenamed({"from_step": "node", "to_step": "other", "observed": "n"}).withColumn("kind", F.lit("pair"))
    touched = touched_nodes(projected, groups, templates).withColumnRenamed("node_id", "node").withColumn("kind", F.lit("case"))
    gates = value_counts(_virtual_durations(projected, groups, templates), GATE, "seconds")
    gates = gates.withColumnsRenamed({"node_key": "node", "node_type": "other", "_n": "n"}).withColumn("kind", F.lit("gate"))
    tasks = templates.expand(value_counts(step_times(run_starts(rows.drop("ctx"), order=order), now), ["process_key", "step_key", "is_open"], "seconds"))
    tasks = tasks.drop("process_key").withColumnsRenamed({"step_key": "node", "_n": "n"}).withColumn("kind", F.lit("task"))
    every = pairs
    for part in (touched, gates, tasks):
        every = every.unionByName(part, allowMissingColumns=True)
    return ProjectionMetrics(staged(every.select(*METRICS), "projection-metrics"), templates)


def parallel_group_rollup(durations: DataFrame, templates: TemplateSet) -> DataFrame:
    """Members of a group taken together: sums, mean of averages, highest intensity."""
    members = GraphTables(templates).members().select("template_key", "group_key", "step_key")
    top = F.greatest("duration_intensity", "backlog_age_intensity", "backlog_count_intensity")
    return (
        durations.join(members, ["template_key", "step_key"])
        .groupBy("template_key", "group_key")
        .agg(
            F.sum("completed").alias("completed"),
            F.round(F.sum("avg_minutes") / F.count(F.lit(1)), 2).alias("avg_minutes"),
            F.sum("open").alias("open"),
            F.max(top).alias("intensity"),
        )
    )


def projection_summary(projected: DataFrame) -> DataFrame:
    """Cases, raw pairs, projected edges and unexpected pairs per template."""
    return projected.groupBy("template_key").agg(
        F.count_if(F.col("pos") == 1).alias("cases"),
        F.count("to_step").alias("raw_pairs"),
        F.sum(F.when(F.col("to_step").isNotNull(), F.size("edges")).otherwise(0)).alias("projected_edges"),
        F.count_if(F.col("classification") == UNEXPECTED).alias("unexpected_pairs"),
    )


def skipped_cases(all_cases: DataFrame, used_cases: DataFrame, reason: str) -> DataFrame:
    """Cases left out of a projection, counted under ``reason``."""
    key = ["process_key", "document_uuid"]
    return (
        all_cases.select(*key).distinct()
        .join(used_cases.select(*key).distinct(), key, "left_anti")
        .groupBy("process_key")
        .agg(F.count(F.lit(1)).alias("skipped"))
        .withColumn("reason", F.lit(reason))
    )
