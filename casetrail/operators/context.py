"""What a case's context was, and when it changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casetrail.functions import values as V
from casetrail.operators import numbering
from casetrail.operators.cases import numbered, with_neighbours
from casetrail.operators.decisions import RULE_COLUMNS, matched_rule, with_decision_rules
from casetrail.plans.templates import TemplateSet

DOC = ["process_key", "document_uuid"]


def snapshot_time() -> Column:
    return F.coalesce("occurred_at", "captured_at", "loaded_at")


def context_entries(snapshots: DataFrame) -> DataFrame:
    """Snapshots of a case and process by time, numbered ``seq``."""
    s = snapshots.withColumn("at", snapshot_time()).withColumn(
        "_tie", F.concat_ws("|", F.coalesce("external_event_key", F.lit("")), F.coalesce("context", F.lit("")))
    )
    return numbering.numbered(s, DOC, ["at", "captured_at", "_tie"], "seq").drop("_tie")


def context_history(
    entries: DataFrame, events: DataFrame, fields: list[str] | None = None, with_empty: bool = False
) -> DataFrame:
    """Long form of the context entries, joined to the events they belong to.

    Empty values (null, '', []) are dropped unless asked for."""
    steps = events.select(*DOC, "external_event_key", "event_key", "step_key")
    e = entries.join(steps, DOC + ["external_event_key"], "left")
    cols = [*DOC, "seq", "at", "external_event_key", "event_key", "step_key", "document_version", "_obj"]
    long = V.explode_fields(e.withColumn("_obj", V.as_object(F.col("context"))).select(*cols), "_obj")
    long = long.filter(F.col("field").isNotNull())
    if fields is not None:
        long = long.filter(F.col("field").isin(*fields))
    return long if with_empty else long.filter(~F.col("value_json").isin("null", '""', "[]", "{}"))


def _diff(rows: DataFrame, keys: list[str], neighbours=with_neighbours) -> DataFrame:
    """Field changes between each row and the next one (``seq`` order).

    Every field value is sent to its own row as *current* and to the following
    row as *previous*; both meet in one aggregation per (row, field), so no row
    is compared with more than its neighbour.  ``neighbours`` belongs to the
    operator that numbered the rows."""
    nxt = neighbours(rows, next={"_next": "_row"}, keys=keys, pos="seq")
    long = V.explode_fields(nxt.select(*keys, "seq", "_row", "_next", "_obj"), "_obj")
    long = long.filter(F.col("field").isNotNull())
    cur = long.select(*keys, F.col("_row").alias("_at"), "field", F.col("value_json").alias("_cur"), F.lit(None).cast("string").alias("_prev"))
    old = long.filter(F.col("_next").isNotNull()).select(
        *keys, F.col("_next").alias("_at"), "field", F.lit(None).cast("string").alias("_cur"), F.col("value_json").alias("_prev")
    )
    both = (
        cur.unionByName(old)
        .groupBy(*keys, "_at", "field")
        .agg(F.max("_cur").alias("to_json"), F.max("_prev").alias("from_json"))
        .withColumn(
            "change",
            F.when(F.col("from_json").isNull(), "added")
            .when(F.col("to_json").isNull(), "removed")
            .when(F.col("from_json") != F.col("to_json"), "changed"),
        )
        .filter(F.col("change").isNotNull() & (F.col("_at.seq") > 1))
    )
    return both.select(*keys, "_at.*", "field", "change", "from_json", "to_json")


def context_diff_by_event(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of each event against the previous event that had a context."""
    t = timeline.withColumn("_obj", V.as_object(F.col("ctx"))).filter(F.col("_obj").isNotNull())
    t = numbered(t.drop("block"), keys, ["pos"], "seq", check="block" in timeline.columns)
    return _diff(t.withColumn("_row", F.struct("seq", "pos", "external_event_key")), keys)


def context_field_changes(entries: DataFrame) -> DataFrame:
    """Added, removed and changed values over a case's history, plus the fields
    that never changed with their first value."""
    e = entries.withColumn("_obj", V.as_object(F.coalesce("context", F.lit("{}"))))
    diffs = _diff(e.withColumn("_row", F.struct("seq", "at")), DOC, numbering.with_neighbours)
    first = V.explode_fields(e.filter(F.col("seq") == 1).select(*DOC, "seq", "at", "_obj"), "_obj")
    first = first.filter(F.col("field").isNotNull())
    same = first.join(diffs.select(*DOC, "field").distinct(), DOC + ["field"], "left_anti").select(
        *DOC,
        "seq",
        "at",
        "field",
        F.lit("unchanged").alias("change"),
        F.lit(None).cast("string").alias("from_json"),
        F.col("value_json").alias("to_json"),
    )
    return diffs.unionByName(same)


def context_coverage(snapshots: DataFrame, examples: int = 3) -> DataFrame:
    """Per process and field: share of snapshots that carry a value, observed
    types and the first few distinct values."""
    total = snapshots.groupBy("process_key").agg(F.count(F.lit(1)).alias("snapshots"))
    rows = snapshots.withColumn("_obj", V.as_object(F.col("context"))).select(
        "process_key", F.struct("captured_at", "external_event_key").alias("_rank"), "_obj"
    )
    long = V.explode_fields(rows, "_obj").filter(
        F.col("field").isNotNull() & (F.col("field") != "") & ~F.col("value_json").isin("null", '""')
    )
    distinct = long.groupBy("process_key", "field", "value_type", "value_json").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_first")
    )
    w = Window.partitionBy("process_key", "field").orderBy("_first", "value_type", "value_json")
    shown = (
        distinct.withColumn("_i", F.row_number().over(w))
        .filter(F.col("_i") <= examples)
        .groupBy("process_key", "field")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "value_json"))), lambda x: x["value_json"]).alias("examples"))
    )
    stats = distinct.groupBy("process_key", "field").agg(
        F.sum("_n").alias("present"), F.array_sort(F.collect_set("value_type")).alias("types")
    )
    return (
        stats.join(shown, ["process_key", "field"])
        .join(total, "process_key")
        .select(
            "process_key",
            "field",
            F.round(F.col("present") / F.col("snapshots"), 4).alias("coverage"),
            "present",
            (F.col("snapshots") - F.col("present")).alias("missing"),
            "types",
            "examples",
        )
    )


def capture_snapshots(
    events: DataFrame, lookup: DataFrame, required: list[str], now: Column, max_delay: int | None = None
) -> DataFrame:
    """Snapshots of events from looked-up attributes and the events' own context.

    ``lookup``: document_uuid, attributes (JSON).  Looked-up values win; own
    values are cut to the required fields.  Loading time is the event's when
    only its own values apply, else ``now``.
    """
    e = events.join(lookup.select("document_uuid", F.col("attributes").alias("_attr")), "document_uuid", "left")

    def as_map(c: Column) -> Column:
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
        return F.coalesce(F.try_variant_get(V.as_object(c), "$", "map<string,variant>"), empty)

    e = e.withColumns({"_own": as_map(F.col("context")), "_found": as_map(F.col("_attr"))})
    if required:
        e = e.withColumn("_own", F.map_filter("_own", lambda k, v: k.isin(*required)))
    rest = F.map_filter("_own", lambda k, v: ~F.map_contains_key("_found", k))
    e = e.withColumns(
        {
            "attributes": F.to_json(F.map_concat(rest, F.col("_found"))),
            "loaded_at": F.when((F.size("_found") == 0) & (F.size("_own") > 0), F.col("occurred_at")).otherwise(now),
        }
    )
    e = e.withColumn("freshness_seconds", F.unix_seconds("loaded_at") - F.unix_seconds("occurred_at"))
    obj = V.as_object(F.col("attributes"))
    absent = [
        F.when(
            F.coalesce(V.value_text(V.field(obj, n)), F.lit("null")).isin("null", '""'),
            F.lit(f'Missing required context field "{n}".'),
        )
        for n in required
    ]
    negative = F.when(
        F.col("freshness_seconds") < 0,
        F.format_string("Context freshness is negative (%d seconds).", F.col("freshness_seconds")),
    )
    fresh = F.lit(None).cast("boolean") if max_delay is None else F.col("freshness_seconds").between(0, max_delay)
    return e.select(
        *DOC,
        "document_version",
        "external_event_key",
        F.col("loaded_at").alias("captured_at"),
        "occurred_at",
        "loaded_at",
        "freshness_seconds",
        fresh.alias("is_fresh"),
        F.col("attributes").alias("context"),
        F.array_compact(F.array(*absent, negative)).alias("warnings"),
    )


def repair_freshness(snapshots: DataFrame, max_delay: int | None) -> DataFrame:
    """Freshness and its flag recomputed from the times; ``was_changed`` marks
    snapshots whose stored values differed."""
    new = F.coalesce(F.unix_seconds("loaded_at") - F.unix_seconds("occurred_at"), F.col("freshness_seconds"))
    flag = F.lit(None).cast("boolean") if max_delay is None else new.between(0, max_delay)
    return (
        snapshots.withColumns({"_new": new, "_flag": flag})
        .withColumn(
            "was_changed",
            ~(F.col("_new").eqNullSafe(F.col("freshness_seconds")) & F.col("_flag").eqNullSafe(F.col("is_fresh"))),
        )
        .withColumns({"freshness_seconds": F.col("_new"), "is_fresh": F.col("_flag")})
        .drop("_new", "_flag")
    )


def context_change_annotations(timeline: DataFrame, templates: TemplateSet, keys: list[str]) -> DataFrame:
    """Fields of violated decisions that changed later in the same case.

    For each case, decision and field only the earliest violation matters:
    every later change is later than that one."""
    nxt = with_neighbours(timeline, next={"_to": "step_key"}, keys=keys)
    rows = templates.expand(nxt.filter(F.col("_to").isNotNull() & V.as_object(F.col("ctx")).isNotNull())).join(
        templates.decisions().withColumnRenamed("after_step", "step_key"), ["template_key", "step_key"]
    )
    rows = with_decision_rules(rows, templates).withColumn("rule_pos", matched_rule(V.as_object(F.col("ctx"))))
    rows = rows.withColumn("_wanted", F.col("required_names")).drop(*RULE_COLUMNS)
    rules = templates.rules().drop("after_step", "decision_key")
    groups = templates.groups().select("template_key", F.col("group_key").alias("next_group"), "required")
    rows = rows.join(rules, ["template_key", "decision_pos", "rule_pos"]).join(groups, ["template_key", "next_group"], "left")
    violated = F.when(F.col("next_step").isNotNull(), F.col("next_step") != F.col("_to")).when(
        F.col("next_group").isNotNull(), ~F.coalesce(F.array_contains("required", F.col("_to")), F.lit(False))
    )
    fields = F.array_distinct(F.array_compact(F.concat("_wanted", F.array("field"))))
    first = (
        rows.filter(violated)
        .select(*keys, "template_key", "decision_key", "pos", F.explode(fields).alias("field"))
        .groupBy(*keys, "template_key", "decision_key", "field")
        .agg(F.min("pos").alias("_since"))
    )
    later = context_diff_by_event(timeline, keys).join(first, keys + ["field"]).filter(F.col("pos") > F.col("_since"))
    return later.select(
        "template_key",
        "decision_key",
        F.concat(F.lit("decision:"), "decision_key").alias("target_node"),
        "field",
        "from_json",
        "to_json",
    ).distinct()


def tag_field_definitions(mapping: DataFrame, definitions: DataFrame) -> DataFrame:
    """Fields with the tag definition their caption names, or a warning when the
    caption is unknown or ambiguous.  ``mapping``: field, caption."""
    found = definitions.groupBy(F.col("caption")).agg(F.count(F.lit(1)).alias("_n"), F.min("definition_id").alias("_id"))
    m = mapping.withColumn("caption", V.trimmed("caption")).join(found, "caption", "left")
    one = F.col("_n") == 1
    return m.select(
        "field",
        "caption",
        F.when(one, F.col("_id")).alias("definition_id"),
        F.when(F.col("_n").isNull(), F.concat(F.lit('Unknown tag_name "'), "caption", F.lit('".')))
        .when(~one, F.concat(F.lit('Ambiguous tag_name "'), "caption", F.lit('".')))
        .alias("warning"),
    )


def enrich_from_tags(tags: DataFrame, fields: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tag values of each document as fields, one row per value.

    ``tags``: doc_id, tag_pos, definition_id, tag_type, value, node_id.
    Numbers and counters are scaled by 10,000; a selection gives its node's
    value, else the node id; blanks are dropped.  ``n_values`` = 1 is a scalar.
    """
    used = fields.filter(F.col("definition_id").isNotNull()).select("field", "definition_id")
    named = tags.join(used, "definition_id").join(
        nodes.select("node_id", F.nullif(V.trimmed("node_value"), F.lit("")).alias("_nv")), "node_id", "left"
    )
    clean = F.nullif(V.trimmed("value"), F.lit(""))
    scaled = (clean.try_cast("decimal(30,4)") / 10000).cast("decimal(22,4)").cast("string")
    number = F.regexp_replace(scaled, "0{1,3}$", "")  # one decimal at least
    value = (
        F.when(F.col("tag_type") == "selections", F.coalesce("_nv", F.nullif("node_id", F.lit(""))))
        .when(F.col("tag_type").isin("numbers", "counters"), F.coalesce(number, clean))
        .otherwise(clean)
    )
    rows = named.select("doc_id", "field", "tag_pos", value.alias("value")).filter(F.col("value").isNotNull())
    n = rows.groupBy("doc_id", "field").agg(F.count(F.lit(1)).alias("n_values"))
    return rows.join(n, ["doc_id", "field"])


def timeline_report(timeline: DataFrame, templates: TemplateSet, keys: list[str]) -> DataFrame:
    """Context changes of every event, marked where a decision rule reads the field."""
    diffs = context_diff_by_event(timeline, keys)
    read = [(t.key, n) for t in templates for d in t.decisions for n in t.decision_fields(d)]
    fields = templates._table(list(dict.fromkeys(read)), "template_key string, field string").withColumn(
        "is_decision_field", F.lit(True)
    )
    tagged = templates.expand(diffs)
    return tagged.join(fields, ["template_key", "field"], "left").fillna(False, ["is_decision_field"])


def event_timeline_report(timeline: DataFrame, templates: TemplateSet, keys: list[str]) -> DataFrame:
    """Every event with its context; events whose context changed have one row per change."""
    events = templates.expand(timeline.select(*dict.fromkeys([*keys, "process_key", "pos", "external_event_key", "step_key", "occurred_at", "ctx"])))
    changes = timeline_report(timeline, templates, keys)
    same = list(dict.fromkeys([*keys, "template_key", "pos"]))
    return events.join(changes.select(*same, "field", "change", "from_json", "to_json", "is_decision_field"), same, "left")
