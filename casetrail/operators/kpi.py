"""Which cases may count for key figures, and how cases flow and wait."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from casetrail.functions import values as V
from casetrail.functions.buckets import ratio
from casetrail.operators.cases import CASE, order_columns, with_neighbours
from casetrail.operators.numbering import null_safe_join
from casetrail.operators.quantiles import exact_quantiles, value_counts
from casetrail.plans.templates import SMALL_ROWS, TemplateSet
from casetrail.sources.scratch import held


def broadcast_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint only after counting no more than ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def process_version_latest(versions: DataFrame) -> DataFrame:
    """Latest version per process by (valid_from, id)."""
    return versions.groupBy("process_key").agg(
        F.max_by(F.struct("version", "valid_from", "version_id"), F.struct("valid_from", "version_id")).alias("_v")
    ).select("process_key", "_v.*")


def versions_for_filter(versions: DataFrame, wanted: str | None = None) -> DataFrame:
    """All versions, one named version, or ``latest``."""
    if wanted is None or not wanted.strip():
        return versions
    if wanted.strip() == "latest":
        return process_version_latest(versions)
    return versions.filter(F.col("version") == wanted.strip())


def kpi_eligibility(timeline: DataFrame, versions: DataFrame, templates: TemplateSet) -> DataFrame:
    """One row per case: eligible or the first exclusion reason that applies.

    Order of reasons: no_process_version_defined, before_first_baseline,
    started_mid_process, crossed_version_boundary.  ``timeline``: all events, or
    run starts with the time of the last event of their case as ``last_at``.
    """
    per_case = timeline.groupBy(*CASE).agg(
        F.min_by(F.struct("occurred_at", "step_key"), F.col("pos")).alias("_first"),
        F.max("last_at" if "last_at" in timeline.columns else "occurred_at").alias("last_event_at"),
    )
    per_case = templates.expand(per_case).select(
        *CASE,
        "template_key",
        F.col("_first.occurred_at").alias("first_event_at"),
        F.col("_first.step_key").alias("first_step"),
        "last_event_at",
    )
    w = Window.partitionBy("process_key").orderBy("valid_from", "version_id")
    spans = versions.select(
        "process_key",
        "version",
        "valid_from",
        F.lead("valid_from").over(w).alias("valid_until"),
        F.min("valid_from").over(Window.partitionBy("process_key")).alias("_baseline"),
    )
    spans = broadcast_if_small(spans)
    base = spans.select("process_key", "_baseline").distinct()
    at = F.col("first_event_at")
    inside = (at >= F.col("valid_from")) & (F.col("valid_until").isNull() | (at < F.col("valid_until")))
    c = per_case.join(broadcast_if_small(base), "process_key", "left").alias("c")
    s = spans.drop("_baseline").withColumnRenamed("process_key", "_p").alias("s")
    starts = templates.processes().select("template_key", "start_step")
    joined = c.join(s, (F.col("process_key") == F.col("_p")) & inside, "left").drop("_p").join(starts, "template_key")
    reason = (
        F.when(F.col("_baseline").isNull(), "no_process_version_defined")
        .when((at < F.col("_baseline")) | F.col("version").isNull(), "before_first_baseline")
        .when(
            (F.coalesce("start_step", F.lit("")) != "") & (F.col("first_step") != F.col("start_step")),
            "started_mid_process",
        )
        .when(F.col("last_event_at") >= F.col("valid_until"), "crossed_version_boundary")
    )
    return joined.select(
        *CASE,
        "template_key",
        reason.isNull().alias("is_eligible"),
        reason.alias("exclusion_reason"),
        "version",
        "first_event_at",
        "last_event_at",
        "first_step",
    )


def kpi_summary(eligibility: DataFrame) -> DataFrame:
    """Included and excluded cases per template, one row per reason (null = included)."""
    by_reason = eligibility.groupBy("template_key", "exclusion_reason").agg(F.count(F.lit(1)).alias("cases"))
    w = Window.partitionBy("template_key")
    return by_reason.withColumns(
        {
            "included": F.coalesce(F.sum(F.when(F.col("exclusion_reason").isNull(), F.col("cases"))).over(w), F.lit(0)),
            "excluded": F.coalesce(F.sum(F.when(F.col("exclusion_reason").isNotNull(), F.col("cases"))).over(w), F.lit(0)),
        }
    )


def keep_eligible(timeline: DataFrame, eligibility: DataFrame, include_excluded: bool = False) -> DataFrame:
    if include_excluded:
        return timeline
    known = eligibility.filter("is_eligible").select(*[F.col(c).alias(f"_{c}") for c in CASE])
    # Joined by what cases are dealt out by, so that a timeline that is still laid out so does not move again.
    same = (F.col("process_key") == F.col("_process_key")) & (F.col("document_uuid") == F.col("_document_uuid"))
    return timeline.join(known, same & F.col("document_version").between(F.col("_document_version"), F.col("_document_version")), "left_semi")


def case_filter_by_status(cases: DataFrame, status: DataFrame, keep: str) -> DataFrame:
    """Keep ``ok`` or ``deviating`` cases; a case is ok without findings, context
    issues and failed sign checks."""
    ok = (F.col("status") == "OK") & (F.col("context_issue_count") == 0)
    wanted = status.filter(ok if keep == "ok" else ~ok).select("process_key", "document_uuid").distinct()
    return cases.join(wanted, ["process_key", "document_uuid"], "left_semi")


def _pair_counts(rows: DataFrame, pos: str) -> DataFrame:
    """Counts per (from, to) and cases per process, in one aggregation.

    ``cases`` counts rows with position 1, so it needs no distinct."""
    if "next_step" not in rows.columns:
        rows = with_neighbours(rows, next={"next_step": "step_key"}, pos=pos, order=order_columns())
    to = F.col("next_step").alias("to_step")
    counts = rows.groupBy("process_key", F.col("step_key").alias("from_step"), to).agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(F.col(pos) == 1).alias("_cases")
    )
    cases = F.sum("_cases").over(Window.partitionBy("process_key"))
    return counts.withColumn("cases", cases).filter(F.col("to_step").isNotNull()).drop("_cases")


def _shares(counts: DataFrame) -> DataFrame:
    top = F.max("observed").over(Window.partitionBy("process_key"))
    return counts.withColumns(
        {
            "percentage": ratio(F.col("observed") * 100, F.col("cases"), 2),
            "intensity": ratio(F.col("observed"), top),
        }
    )


def flow_heatmap(entries: DataFrame, templates: TemplateSet) -> DataFrame:
    """Adjacent pairs with count, percentage of cases, intensity and whether the
    template has that edge.  ``entries``: run starts, or the raw timeline."""
    pos = "entry" if "entry" in entries.columns else "pos"
    counts = templates.expand(_shares(_pair_counts(entries, pos)))
    edges = templates.direct_edges().withColumn("_edge", F.lit(True))
    return counts.join(edges, ["template_key", "from_step", "to_step"], "left").select(
        "template_key",
        "from_step",
        "to_step",
        "observed",
        "percentage",
        "intensity",
        F.coalesce("_edge", F.lit(False)).alias("is_allowed"),
    )


def flow_by_context(timeline: DataFrame) -> DataFrame:
    """Pairs of the raw timeline grouped by the canonical context (``context_key``) of the first event.

    Contexts are nearly as many as events: pairs are counted by a digest of the text, every text is stored once and joined
    to its counts at the end, and totals of a process are sums over the counts, not windows over its contexts. An unknown
    process is a process of its own; an event without an object as its context has the key ``null``.
    """
    text = F.coalesce(V.value_text(V.as_object(F.col("ctx"))), F.lit("null"))
    t = timeline.withColumns({"context_key": text, "_context": F.unhex(F.sha2(text, 256))})
    t = with_neighbours(t, next={"next_step": "step_key"}, pos="pos", order=order_columns())
    to = F.col("next_step").alias("to_step")
    counts = t.groupBy("process_key", F.col("step_key").alias("from_step"), to, "_context").agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(F.col("pos") == 1).alias("_cases")
    )
    counts = held(counts)
    texts = timeline.select(text.alias("context_key")).withColumn("_context", F.unhex(F.sha2("context_key", 256))).dropDuplicates(["_context"])
    seen = F.col("to_step").isNotNull()
    totals = counts.groupBy("process_key").agg(F.sum("_cases").alias("_n"), F.max(F.when(seen, F.col("observed"))).alias("_top"))
    shares = null_safe_join(counts.filter(seen), totals, ["process_key"]).join(texts, "_context")
    return shares.select(
        "process_key",
        "from_step",
        "to_step",
        "context_key",
        "observed",
        ratio(F.col("observed") * 100, F.col("_n"), 2).alias("percentage"),
        ratio(F.col("observed"), F.col("_top")).alias("intensity"),
    )


def step_times(entries: DataFrame, now: datetime) -> DataFrame:
    """``seconds`` from each run start to the next; for the last one its age at
    ``now``, marked ``is_open``."""
    until = F.coalesce(F.unix_seconds("next_at"), F.lit(int(now.timestamp())).cast("long"))
    return entries.withColumns(
        {
            "is_open": F.col("next_at").isNull(),
            "seconds": F.greatest(F.lit(0).cast("long"), until - F.unix_seconds("occurred_at")),
        }
    )


def duration_heatmap(entries: DataFrame, templates: TemplateSet, now: datetime) -> DataFrame:
    """Per step: time to the next step, age of cases resting there, intensities.

    Averages are rounded to 2 before intensities are taken; steps of the
    template without events are listed with zeros.
    """
    counts = value_counts(step_times(entries, now), ["process_key", "step_key", "is_open"], "seconds")
    return durations_of(templates.expand(counts).drop("process_key"), templates)


def durations_of(counts: DataFrame, templates: TemplateSet) -> DataFrame:
    """``duration_heatmap`` from counted seconds (``_n``) per template, step and ``is_open``."""
    keys = ["template_key", "step_key"]
    done, n, total = ~F.col("is_open"), F.col("_n"), F.col("seconds") * F.col("_n")
    agg = counts.groupBy(*keys).agg(
        F.sum(F.when(done, n)).alias("completed"),
        F.sum(F.when(done, total)).alias("_sum"),
        F.max(F.when(done, F.col("seconds"))).alias("_max"),
        F.sum(F.when(~done, n)).alias("open"),
        F.sum(F.when(~done, total)).alias("_asum"),
        F.max(F.when(~done, F.col("seconds"))).alias("_amax"),
    )
    median = exact_quantiles(counts, keys + ["is_open"], "seconds", {"_median": 0.5})
    median = median.filter(~F.col("is_open")).drop("is_open")
    seen = agg.join(median, keys, "left")
    steps = templates.steps().select("template_key", "step_key")
    rows = seen.join(steps, ["template_key", "step_key"], "full_outer").fillna(
        0, ["completed", "open"]
    )

    def mean(total, n):
        return F.when(F.col(n) == 0, F.lit(0.0)).otherwise(F.round(F.col(total) / F.col(n) / 60, 2))

    w = Window.partitionBy("template_key")
    minutes = rows.select(
        "template_key",
        "step_key",
        "completed",
        mean("_sum", "completed").alias("avg_minutes"),
        F.coalesce(F.col("_median") / 60, F.lit(0.0)).alias("median_minutes"),
        F.coalesce(F.col("_max") / 60, F.lit(0.0)).alias("max_minutes"),
        "open",
        mean("_asum", "open").alias("avg_open_minutes"),
        F.coalesce(F.col("_amax") / 60, F.lit(0.0)).alias("max_open_minutes"),
    )
    return minutes.withColumns(
        {
            "duration_intensity": ratio(F.col("avg_minutes"), F.max("avg_minutes").over(w)),
            "backlog_age_intensity": ratio(F.col("avg_open_minutes"), F.max("avg_open_minutes").over(w)),
            "backlog_count_intensity": ratio(F.col("open"), F.max("open").over(w)),
        }
    )


def heatmap_report(entries: DataFrame, eligibility: DataFrame, templates: TemplateSet, now: datetime) -> dict[str, DataFrame]:
    """Flow, durations and eligibility of the same entries (eligible cases only)."""
    used = held(keep_eligible(entries, eligibility))
    docs = used.filter(F.col("entry") == 1).groupBy("process_key").agg(F.count(F.lit(1)).alias("documents_used"))
    return {
        "flow": flow_heatmap(used, templates),
        "durations": duration_heatmap(used, templates, now),
        "eligibility": kpi_summary(eligibility),
        "documents_used": templates.expand(docs).select("template_key", "documents_used"),
    }
