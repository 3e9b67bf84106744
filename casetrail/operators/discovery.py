"""Draft templates from what was observed.

Everything is counted per transition, per step or per *variant* (cases with the
same first-seen sequence), never per pair of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casetrail.functions import values as V
from casetrail.functions.text import normalize_step
from casetrail.operators.cases import CASE, case_timeline, mark_runs, numbered, order_columns, run_starts, with_case_value, with_neighbours
from casetrail.sources.scratch import held, staged


def discovery_timeline(events: DataFrame, include_before: bool = False, snapshots: DataFrame | None = None) -> DataFrame:
    """Latest version of each case with normalised step names and ``case_rank``
    (newest received first), which decides what counts as seen first; with
    ``ctx`` where ``snapshots`` are given."""
    t = case_timeline(events, include_before=include_before, snapshots=snapshots).withColumn("step", normalize_step(F.col("step_key")))
    t = with_case_value(t, F.max("received_at"), "_last")
    rank = F.struct((-F.unix_micros("_last")).alias("newest"), "document_uuid")
    return t.withColumn("case_rank", rank).drop("_last")


def discovery_entries(timeline: DataFrame) -> DataFrame:
    """Run starts on the normalised step with the step that follows."""
    starts = run_starts(timeline, step="step").drop("next_step", "next_at")
    return with_neighbours(starts, next={"next_step": "step", "next_key": "step_key"}, pos="entry", order=order_columns())


def discover_steps(entries: DataFrame) -> DataFrame:
    """Distinct steps with the spelling seen first."""
    return entries.groupBy("process_key", "step").agg(
        F.min_by("step_key", F.struct("case_rank", "entry")).alias("label"), F.count_distinct("document_uuid").alias("cases")
    )


def discover_transitions(entries: DataFrame) -> DataFrame:
    """Adjacent pairs with counts and confidence = count / highest count."""
    first = F.struct("case_rank", "entry")
    t = (
        entries.filter(F.col("next_step").isNotNull())
        .groupBy("process_key", F.col("step").alias("from_step"), F.col("next_step").alias("to_step"))
        .agg(
            F.count(F.lit(1)).alias("observed"),
            F.min_by("step_key", first).alias("from_label"),
            F.min_by("next_key", first).alias("to_label"),
        )
    )
    top = F.max("observed").over(Window.partitionBy("process_key"))
    return t.withColumn("confidence", F.round(F.col("observed") / top, 4))


def conflicting_transitions(transitions: DataFrame) -> DataFrame:
    """Pairs observed in both directions, once per pair."""
    back = transitions.select(
        "process_key", F.col("from_step").alias("to_step"), F.col("to_step").alias("from_step"), F.col("observed").alias("reverse")
    )
    return (
        transitions.filter(F.col("from_step") < F.col("to_step"))
        .join(back, ["process_key", "from_step", "to_step"])
        .select("process_key", "from_step", "to_step", "observed", "reverse")
    )


def _first_seen(entries: DataFrame, *gathered: Column) -> DataFrame:
    """Distinct steps of each case in first-seen order with their neighbours and what is ``gathered`` at a step."""
    u = entries.groupBy(*CASE, "step").agg(F.min("entry").alias("at"), *gathered)
    u = numbered(u, CASE, ["at"], "rank", check="block" in entries.columns)
    return with_neighbours(u, next={"after": "step"}, prev={"before": "step"}, pos="rank", order=["at"])


def discover_parallel_groups(entries: DataFrame, transitions: DataFrame) -> DataFrame:
    """Pairs of steps seen in both orders in at least two cases.

    A step that ever starts a case, or always ends it, belongs to no group.  The
    pair needs a direct neighbour shared by both orders, or two direct
    transitions each way.
    """
    seen = held(_first_seen(entries))
    steps = seen.groupBy("process_key", "step").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("before").isNull()).alias("starts"),
        F.count_if(F.col("after").isNull()).alias("ends"),
    )
    inner = steps.filter((F.col("starts") == 0) & (F.col("ends") < F.col("n")) & (F.col("n") >= 2))
    inner = staged(inner.select("process_key", "step"), "inner-steps")  # of known size: cases are not dealt out by step
    kept = seen.join(inner, ["process_key", "step"], "left_semi")
    # As long as the number of groupable steps; cases of one variant are counted once.
    variants = (
        kept.groupBy(*CASE)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "step", "before", "after"))), lambda x: F.struct(x["step"], x["before"], x["after"])).alias("variant"))
        .groupBy("process_key", "variant")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    variants = held(variants)
    left = variants.select("process_key", "variant", "n", F.posexplode("variant").alias("i", "a"))
    pairs = left.select("process_key", "n", "a", F.explode(F.slice("variant", F.col("i") + 2, F.size("variant"))).alias("b"))
    fwd = F.col("a.step") < F.col("b.step")
    pairs = pairs.select(
        "process_key",
        F.least("a.step", "b.step").alias("left_step"),
        F.greatest("a.step", "b.step").alias("right_step"),
        fwd.alias("fwd"),
        "n",
        F.col("a.before").alias("pred"),
        F.col("b.after").alias("succ"),
    )
    key = ["process_key", "left_step", "right_step"]
    orders = pairs.groupBy(*key).agg(
        F.sum(F.when(F.col("fwd"), F.col("n")).otherwise(0)).alias("forward"),
        F.sum(F.when(~F.col("fwd"), F.col("n")).otherwise(0)).alias("reverse"),
    )
    orders = orders.filter((F.col("forward") > 0) & (F.col("reverse") > 0))

    def shared(side: str) -> DataFrame:
        return (
            pairs.filter(F.col(side).isNotNull())
            .groupBy(*key, side)
            .agg((F.max("fwd") & ~F.min("fwd")).alias("both"))
            .filter("both")
            .groupBy(*key)
            .agg(F.count(F.lit(1)).alias(f"{side}_n"), F.min(side).alias(f"{side}_one"))
        )

    direct = conflicting_transitions(transitions).select(
        "process_key",
        F.col("from_step").alias("left_step"),
        F.col("to_step").alias("right_step"),
        (F.least("observed", "reverse") >= 2).alias("direct"),
    )
    out = orders.join(shared("pred"), key, "left").join(shared("succ"), key, "left").join(direct, key, "left")
    boundary = F.col("pred_n").isNotNull() | F.col("succ_n").isNotNull()
    return out.filter(boundary | F.coalesce("direct", F.lit(False))).select(
        *key,
        F.when(F.col("pred_n") == 1, F.col("pred_one")).alias("after_step"),
        "forward",
        "reverse",
        F.round(F.least("forward", "reverse") / (F.col("forward") + F.col("reverse")), 4).alias("confidence"),
        (F.col("forward") + F.col("reverse")).alias("cases"),
        F.when(boundary, F.lit("both_orders")).otherwise(F.lit("bidirectional")).alias("reason"),
    )


def discover_parallel_fallback(entries: DataFrame, transitions: DataFrame, groups: DataFrame) -> DataFrame:
    """Remaining pairs with two direct transitions each way in two or more cases,
    unless all those cases begin, or all end, with one of the two steps."""
    key = ["process_key", "left_step", "right_step"]
    both = conflicting_transitions(transitions).filter((F.col("observed") >= 2) & (F.col("reverse") >= 2))
    both = both.select(
        "process_key", F.col("from_step").alias("left_step"), F.col("to_step").alias("right_step"), "observed", "reverse"
    ).join(groups.select(*key), key, "left_anti")
    both = staged(both, "both-ways")  # of known size: entries are not dealt out by pair
    pair = [F.least("step", "next_step").alias("left_step"), F.greatest("step", "next_step").alias("right_step")]
    names = [c for c in [*CASE, "block", "entry", "step"] if c in entries.columns]
    marked = entries.select(*names, F.col("next_step").isNotNull().alias("_moves"), *pair).join(
        both.select(*key, F.lit(True).alias("_both")), key, "left"
    )
    found = F.collect_set(F.when(F.col("_moves") & F.col("_both"), F.struct("left_step", "right_step")))
    ends = _first_seen(marked, found.alias("_pairs")).groupBy(*CASE).agg(
        F.max(F.when(F.col("before").isNull(), F.col("step"))).alias("first"),
        F.max(F.when(F.col("after").isNull(), F.col("step"))).alias("last"),
        F.array_distinct(F.flatten(F.collect_list("_pairs"))).alias("_pairs"),
    )
    inside = lambda c: (F.col(c) == F.col("left_step")) | (F.col(c) == F.col("right_step"))
    counted = ends.select("process_key", "first", "last", F.inline("_pairs")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(inside("first")).alias("_f"), F.count_if(inside("last")).alias("_l")
    )
    return (
        both.join(counted, key)
        .filter((F.col("cases") >= 2) & (F.col("_f") < F.col("cases")) & (F.col("_l") < F.col("cases")))
        .select(
            *key,
            F.col("observed").alias("forward"),
            "reverse",
            F.round(F.least("observed", "reverse") / (F.col("observed") + F.col("reverse")), 4).alias("confidence"),
            "cases",
        )
    )


def runs(timeline: DataFrame) -> DataFrame:
    """Every run of equal adjacent steps with its length and the steps around it."""
    m = mark_runs(timeline, step="step")
    r = m.groupBy(*CASE, "run").agg(
        F.min_by("step", "pos").alias("step"),
        F.min_by("step_key", "pos").alias("first_key"),
        F.max_by("step_key", "pos").alias("last_key"),
        F.min("case_rank").alias("case_rank"),
        F.count(F.lit(1)).alias("length"),
    )
    r = numbered(r, CASE, ["run"], "rank", check="block" in timeline.columns)
    return with_neighbours(r, next={"following": "first_key"}, prev={"previous": "last_key"}, pos="rank", order=["run"])


def repeated_runs(all_runs: DataFrame) -> DataFrame:
    """Steps repeated directly: affected cases and run lengths."""
    r = all_runs.filter(F.col("length") >= 2)
    per_case = r.groupBy(*CASE, "step").agg(
        F.count(F.lit(1)).alias("_runs"),
        F.sum("length").alias("_sum"),
        F.min("length").alias("_min"),
        F.max("length").alias("_max"),
        F.min(F.struct("case_rank", "run", "first_key")).alias("_first"),
    )
    return per_case.groupBy("process_key", "step").agg(
        F.min("_first")["first_key"].alias("event_key"),
        F.count(F.lit(1)).alias("affected_cases"),
        F.min("_min").alias("min_length"),
        F.max("_max").alias("max_length"),
        F.round(F.sum("_sum") / F.sum("_runs"), 2).alias("avg_length"),
    )


def repeated_run_neighbours(all_runs: DataFrame) -> DataFrame:
    """How often which step comes directly before and after repeated runs."""
    r = all_runs.filter(F.col("length") >= 2)
    sides = F.array(
        F.struct(F.lit("previous").alias("side"), F.col("previous").alias("key")),
        F.struct(F.lit("following").alias("side"), F.col("following").alias("key")),
    )
    return (
        r.select("process_key", "step", F.inline(sides))
        .filter(F.col("key").isNotNull())
        .groupBy("process_key", "step", "side", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def decision_candidates(entries: DataFrame) -> DataFrame:
    """Steps followed by two or more different steps, with case coverage."""
    moves = entries.filter(F.col("next_step").isNotNull())
    total = moves.groupBy("process_key").agg(F.count_distinct("document_uuid").alias("_total"))
    per_case = moves.groupBy(*CASE, "step").agg(F.count(F.lit(1)).alias("_n"))
    cases = per_case.groupBy("process_key", "step").agg(F.count(F.lit(1)).alias("cases"))
    targets = moves.groupBy("process_key", "step", "next_step").agg(F.count(F.lit(1)).alias("_n"))
    wide = targets.groupBy("process_key", "step").agg(
        F.array_sort(F.collect_set("next_step")).alias("next_steps")
    ).filter(F.size("next_steps") >= 2)
    return (
        wide.join(cases, ["process_key", "step"])
        .join(total, "process_key")
        .select("process_key", F.col("step").alias("after_step"), "next_steps", "cases", F.round(F.col("cases") / F.col("_total"), 4).alias("coverage"))
    )


def _candidate_values(entries: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves out of candidates, their known context values as rows)."""
    moves = entries.filter(F.col("next_step").isNotNull()).join(
        candidates.select("process_key", F.col("after_step").alias("step")), ["process_key", "step"], "left_semi"
    )
    rows = moves.filter(F.col("ctx").isNotNull()).withColumn("_obj", V.as_object(F.col("ctx"))).select("process_key", "step", "next_step", "_obj")
    known = F.col("field").isNotNull() & (F.col("field") != "") & (F.col("value_json") != "null")
    return moves, V.explode_fields(rows, "_obj").filter(known)


def values_by_next_step(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """How often each value of a context field stood before each next step, for fields with two or more values."""
    long = _candidate_values(entries, candidates)[1]
    key = ["process_key", "step", "field"]
    values = held(long.groupBy(*key, "next_step", "value_type", "value_json").agg(F.count(F.lit(1)).alias("n")))
    several = values.groupBy(*key).agg(F.min("value_json").alias("_lo"), F.max("value_json").alias("_hi")).filter("_lo <> _hi")
    several = staged(several.select(*key), "fields")  # of known size: the values of a field are not dealt out by field
    return values.join(several, key, "left_semi").select(*key, "next_step", F.col("value_json").alias("value"), "n")


def decision_field_evidence(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Context fields with two or more values at a candidate, one row per field and
    next step.  ``entries`` carry ``ctx``."""
    moves, long = _candidate_values(entries, candidates)
    total = moves.groupBy("process_key", "step").agg(F.count(F.lit(1)).alias("transitions"))
    key = ["process_key", "step", "field"]
    distinct = held(long.groupBy(*key, "next_step", "value_type", "value_json").agg(F.count(F.lit(1)).alias("_n")))
    per_value = distinct.groupBy(*key, "value_type", "value_json").agg(F.sum("_n").alias("_n"))
    stats = per_value.groupBy(*key).agg(F.sum("_n").alias("present"), F.count(F.lit(1)).alias("distinct_values"))
    by_next = distinct.groupBy(*key, "next_step").agg(F.count(F.lit(1)).alias("values_at_next"), F.sum("_n").alias("present_at_next"))
    return (
        stats.filter(F.col("distinct_values") >= 2)
        .join(by_next, key)
        .join(total, ["process_key", "step"])
        .select(*key, "next_step", "distinct_values", "values_at_next", "present_at_next", F.round(F.col("present") / F.col("transitions"), 4).alias("coverage"))
    )


def discover_single_case(timeline: DataFrame) -> DataFrame:
    """Linear draft of each case: its collapsed steps with the next step and the
    number of repeats in the run."""
    return runs(timeline).select(
        *CASE, F.col("rank").alias("step_no"), F.col("first_key").alias("step_key"), F.col("following").alias("next_step_key"), F.col("length").alias("run_length")
    )
