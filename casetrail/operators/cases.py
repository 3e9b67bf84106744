"""Case timelines: ordering, neighbours, versions, runs, instances.

Rows stay rows: a case is never collected into a list.  A case that holds more
rows than ``spark.casetrail.hotCaseRows`` (default 2,000,000) would make one
window partition too large, so its rows are numbered piecewise and carry a
``block`` column; later windows run per (case, block) and pass values over
the block borders.  Without such a case no ``block`` column exists and every
window needs one shuffle by case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casetrail.functions import values as V
from casetrail.operators import numbering
from casetrail.operators.numbering import HOT_CONF, LAST_ID, hot_limit, null_safe_join, sort_by
from casetrail.sources.scratch import staged

CASE = ["process_key", "document_uuid", "document_version"]
#: Hashes that rows are counted by before groups are: a count of them is small for any log.
KEY_HASHES = 8192

ORDERS = {
    "occurred-then-received": ["occurred_at", "received_at"],
    "occurred-at": ["occurred_at"],
    "received-at": ["received_at"],
}


def order_columns(order: str = "occurred-then-received") -> list[str]:
    """Total order of a case's events; unknown ids come last, the event key decides ties."""
    return ORDERS[order] + ["event_id", "external_event_key"]


# ---------------------------------------------------------------- hot cases


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Groups above the limit, or None.  At most rows/limit groups can qualify,
    which is what allows broadcasting them.  Rows are counted per hash of their
    key, which takes no list of all groups; only groups whose hash is above the
    limit are counted themselves."""
    limit = hot_limit(df.sparkSession)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_HASHES))
    many = df.groupBy(bucket.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).collect()
    if not many:
        return None
    large = df.filter(bucket.isin(*[r["_h"] for r in many]))
    sizes = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    return None if sizes.isEmpty() else sizes


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "pos", check: bool = True) -> DataFrame:
    """``row_number`` per group that also works when one group is huge.

    Where a group is, rows are numbered range by range (``numbering``) and written
    once with the ``block`` that later steps work in.
    """
    if check and hot_keys(df, keys) is not None:
        out = numbering.numbered(df, keys, order, name)
        block = F.floor((F.col(name) - 1) / hot_limit(df.sparkSession)).cast("int")
        return staged(out.withColumn("block", block), "hot-numbered")
    w = Window.partitionBy(*keys).orderBy(*sort_by(order))
    return df.withColumn(name, F.row_number().over(w).cast("long"))


def is_split(df: DataFrame) -> bool:
    return "block" in df.columns


def group_keys(df: DataFrame, keys: list[str]) -> list[str]:
    return keys + ["block"] if is_split(df) else list(keys)


def with_neighbours(
    df: DataFrame,
    next: dict[str, str] | None = None,
    prev: dict[str, str] | None = None,
    keys: list[str] = CASE,
    pos: str = "pos",
    order: list[str] | None = None,
) -> DataFrame:
    """Add columns of the following / preceding row: {new name: source column}.

    ``pos`` numbers the rows of a group from 1 without gaps.  In split groups
    the first and last row of each block are also shown to the block next to it.
    ``order`` names the columns ``pos`` was numbered by, so that rows still in
    that order are not sorted again.
    """
    next, prev = next or {}, prev or {}
    split = is_split(df)
    if split:
        size = F.lit(hot_limit(df.sparkSession))
        b = F.col("block")
        homes = F.array_compact(
            F.array(
                F.struct(b.alias("b"), F.lit(False).alias("guest")),
                F.when(
                    (F.pmod(F.col(pos) - 1, size) == 0) & (b > 0),
                    F.struct((b - 1).alias("b"), F.lit(True).alias("guest")),
                ),
                F.when(F.pmod(F.col(pos), size) == 0, F.struct((b + 1).alias("b"), F.lit(True).alias("guest"))),
            )
        )
        df = df.withColumn("_home", F.explode(homes)).withColumn("block", F.col("_home.b"))
    w = Window.partitionBy(*group_keys(df, keys)).orderBy(*sort_by(order or [pos]))
    df = df.withColumns(
        {**{k: F.lead(c).over(w) for k, c in next.items()}, **{k: F.lag(c).over(w) for k, c in prev.items()}}
    )
    return df.filter(~F.col("_home.guest")).drop("_home") if split else df


def with_last_known(
    df: DataFrame,
    value: Column,
    name: str,
    keys: list[str] = CASE,
    pos: str = "pos",
    include_current: bool = True,
    order: list[str] | None = None,
) -> DataFrame:
    """Last non-null ``value`` at or before (or strictly before) each row."""
    end = 0 if include_current else -1
    w = Window.partitionBy(*group_keys(df, keys)).orderBy(*sort_by(order or [pos]))
    w = w.rowsBetween(Window.unboundedPreceding, end)
    out = df.withColumn("_v", value)
    local = F.last("_v", ignorenulls=True).over(w)
    if not is_split(df):
        return out.withColumn(name, local).drop("_v")
    over_blocks = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        out.groupBy(*keys, "block")
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(pos))).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(over_blocks))
        .drop("_last")
    )
    return (
        null_safe_join(out.withColumn("_local", local), carried, keys + ["block"], "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_v", "_local", "_carried")
    )


def with_case_value(df: DataFrame, aggregate: Column, name: str, keys: list[str] = CASE) -> DataFrame:
    """Add an aggregate of the whole group to each of its rows."""
    if not is_split(df):
        return df.withColumn(name, aggregate.over(Window.partitionBy(*keys)))
    per_block = (
        df.groupBy(*keys)
        .agg(aggregate.alias(name), F.max("block").alias("_b"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_b"))))
        .drop("_b")
    )
    return null_safe_join(df, per_block, keys + ["block"])


# ---------------------------------------------------------------- timelines


def filter_phase(events: DataFrame, include_before: bool = False) -> DataFrame:
    return events if include_before else events.filter(F.col("event_phase") == "after")


def filter_time_window(events: DataFrame, start=None, end=None) -> DataFrame:
    """``start`` matches the occurred or received time, ``end`` the occurred time only."""
    if start is not None:
        events = events.filter((F.col("occurred_at") >= F.lit(start)) | (F.col("received_at") >= F.lit(start)))
    if end is not None:
        events = events.filter(F.col("occurred_at") <= F.lit(end))
    return events


def _latest_version(events: DataFrame, hot: DataFrame | None, order: list[str]) -> DataFrame:
    keys = ["process_key", "document_uuid"]

    def cold(df: DataFrame) -> DataFrame:
        # Ordered like the timeline windows that follow, so they need no further sort.
        w = Window.partitionBy(*keys).orderBy("document_version", *sort_by(order))
        top = F.max("document_version").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return df.withColumn("_top", top).filter(F.col("document_version") == F.col("_top")).drop("_top")

    if hot is None:
        return cold(events)
    hot = F.broadcast(hot.select(*keys))
    top = events.join(hot, keys, "left_semi").groupBy(*keys).agg(F.max("document_version").alias("document_version"))
    return cold(events.join(hot, keys, "left_anti")).unionByName(
        events.join(F.broadcast(top), CASE, "left_semi").select(*events.columns)
    )


def select_case_version(events: DataFrame, version: int | str = "latest") -> DataFrame:
    """Keep one version per process and case: a number, ``latest`` or ``all``."""
    if version == "all":
        return events
    if version == "latest":
        return _latest_version(events, hot_keys(events, ["process_key", "document_uuid"]), order_columns())
    return events.filter(F.col("document_version") == int(version))


def case_timeline(
    events: DataFrame,
    version: int | str = "latest",
    order: str = "occurred-then-received",
    include_before: bool = True,
    merge_versions: bool = False,
    sized_by: DataFrame | None = None,
    snapshots: DataFrame | None = None,
) -> DataFrame:
    """Events of each case in order, numbered ``pos`` = 1, 2, ...

    ``merge_versions`` numbers all versions of a case as one timeline; the
    ``document_version`` of its rows is then replaced by 0 and kept in
    ``event_version``.  ``sized_by``: the log before anything was joined to it,
    which shows more cheaply whether a case is large.  ``snapshots`` are attached
    (``attach_snapshots``) in the shuffle that the timeline needs anyway, unless
    a case is large.
    """
    known = F.col("document_uuid").isNotNull()
    events = filter_phase(events, include_before).filter(known)
    sizes = events if sized_by is None else filter_phase(sized_by, include_before).filter(known)
    hot = hot_keys(sizes, ["process_key", "document_uuid"])
    if snapshots is not None:
        events = _attached_in_place(events, snapshots) if hot is None else attach_snapshots(events, snapshots)
    if version == "latest" and not merge_versions:
        events = _latest_version(events, hot, order_columns(order))
    elif version not in ("all", "latest"):
        events = events.filter(F.col("document_version") == int(version))
    if merge_versions:
        events = events.withColumn("event_version", F.col("document_version")).withColumn(
            "document_version", F.lit(0)
        )
    return numbered(events, CASE, order_columns(order), check=hot is not None)


def order_timeline(events: DataFrame, order: str = "occurred-then-received") -> DataFrame:
    """All events of each (process, case, version), numbered in the given order."""
    known = events.filter(F.col("document_uuid").isNotNull())
    return numbering.numbered(known, CASE, order_columns(order)).drop("block")


def attach_snapshots(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Join each event with the snapshot of its key that was captured last.

    Adds ``ctx`` (JSON), ``ctx_loaded_at``, ``ctx_occurred_at``,
    ``ctx_freshness`` and ``has_snapshot``.  Freshness is recomputed from the
    times where both exist.
    """
    summary = F.struct("context", "loaded_at", "occurred_at", "freshness_seconds")
    rank = F.struct("captured_at", "loaded_at", "context")
    latest = (
        snapshots.filter(F.col("external_event_key").isNotNull())
        .groupBy("document_uuid", "external_event_key")
        .agg(F.max_by(summary, rank).alias("_s"))
    )
    s = F.col("_s")
    return (
        events.join(latest, ["document_uuid", "external_event_key"], "left")
        .withColumns(
            {
                "ctx": s["context"],
                "ctx_loaded_at": s["loaded_at"],
                "ctx_occurred_at": s["occurred_at"],
                "ctx_freshness": F.coalesce(
                    F.unix_seconds(s["loaded_at"]) - F.unix_seconds(s["occurred_at"]), s["freshness_seconds"]
                ),
                "has_snapshot": s.isNotNull(),
            }
        )
        .drop("_s")
    )


def _attached_in_place(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``attach_snapshots`` for events that all have a document: events and snapshots of a document
    go to one partition, once, where later windows and aggregations of a case find them."""
    key = ["document_uuid", "external_event_key"]
    shots = snapshots.filter(F.col(key[0]).isNotNull() & F.col(key[1]).isNotNull()).select(
        *key,
        F.col("captured_at").alias("_captured_at"),
        F.col("loaded_at").alias("_loaded_at"),
        F.col("occurred_at").alias("_occurred_at"),
        F.col("freshness_seconds").alias("_freshness"),
        F.col("context").alias("_context"),
        F.lit(True).alias("_shot"),
    )
    rows = events.withColumn("_shot", F.lit(False)).unionByName(shots, allowMissingColumns=True).repartition(key[0])
    # The snapshot that counts is sorted to the front; a group without one begins with an event, whose columns are null.
    newest = [F.col(c).desc() for c in ("_shot", "_captured_at", "_loaded_at", "_context")]
    w = Window.partitionBy(*key).orderBy(*newest).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {f"_last{c}": F.first(c).over(w) for c in ("_shot", "_loaded_at", "_occurred_at", "_freshness", "_context")}
    rows = rows.withColumns(last).filter(~F.col("_shot"))
    age = F.unix_seconds("_last_loaded_at") - F.unix_seconds("_last_occurred_at")
    return rows.select(
        *events.columns,
        F.col("_last_context").alias("ctx"),
        F.col("_last_loaded_at").alias("ctx_loaded_at"),
        F.col("_last_occurred_at").alias("ctx_occurred_at"),
        F.coalesce(age, "_last_freshness").alias("ctx_freshness"),
        F.col("_last_shot").alias("has_snapshot"),
    )


def mark_runs(
    timeline: DataFrame, step: Column | str = "step_key", order: str = "occurred-then-received"
) -> DataFrame:
    """Add ``run`` = position of the first row of the run of equal adjacent steps.

    ``order`` is the order the timeline was numbered by."""
    by = order_columns(order)
    tl = timeline.withColumn("_step", F.col(step) if isinstance(step, str) else step)
    tl = with_neighbours(tl, prev={"_before": "_step"}, order=by)
    start = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("_step")), F.col("pos"))
    return with_last_known(tl, start, "run", order=by).drop("_before", "_step")


def run_starts(
    timeline: DataFrame, step: Column | str = "step_key", order: str = "occurred-then-received"
) -> DataFrame:
    """Only the first row of each run, renumbered as ``entry`` = 1, 2, ..., with
    ``next_step`` and ``next_at`` of the run that follows."""
    by = order_columns(order)
    tl = timeline.withColumn("_step", F.col(step) if isinstance(step, str) else step)
    tl = with_neighbours(tl, prev={"_before": "_step"}, order=by)
    first = tl.filter(F.col("_before").isNull() | (F.col("_before") != F.col("_step"))).drop("_before", "_step")
    first = numbered(first.drop("block"), CASE, by, "entry", check=is_split(first))
    return with_neighbours(first, next={"next_step": "step_key", "next_at": "occurred_at"}, pos="entry", order=by)


def merge_fields(obj: Column, names: list[str], pos: Column) -> Column:
    """Aggregate: JSON object with the latest value of each listed field, null
    when no row of the group has a context."""
    parts = []
    for n in names:
        v = V.field(obj, n)
        latest = F.max_by(V.value_text(v), F.when(v.isNotNull(), pos))
        parts.append(F.concat(F.lit(V.canonical(n) + ":"), latest))
    body = F.concat_ws(",", *parts) if parts else F.lit("")
    return F.when(F.max(obj.isNotNull()), F.concat(F.lit("{"), body, F.lit("}")))


def collapse_repeats(
    timeline: DataFrame, fields: list[str], order: str = "occurred-then-received"
) -> DataFrame:
    """One row per run of equal adjacent steps, with the step that follows.

    The first row gives step and time.  Contexts (column ``ctx``) merge later
    over earlier for the listed ``fields``; ``sum_*`` columns hold the last
    context of the run and its times.
    """
    runs = mark_runs(timeline.withColumn("_obj", V.as_object(F.col("ctx"))), order=order)
    obj, pos = F.col("_obj"), F.col("pos")
    with_ctx = F.when(obj.isNotNull(), pos)
    first = F.min_by(F.struct("step_key", "occurred_at", "external_event_key"), pos)
    last = F.max_by(F.struct("ctx", "ctx_loaded_at", "ctx_occurred_at", "ctx_freshness", "has_snapshot"), with_ctx)
    out = (
        runs.groupBy(*CASE, "run")
        .agg(
            first.alias("_f"),
            F.count(F.lit(1)).alias("n_events"),
            merge_fields(obj, fields, pos).alias("context"),
            last.alias("_l"),
        )
        .select(
            *CASE,
            F.col("run").alias("pos"),
            "_f.*",
            "n_events",
            "context",
            F.col("_l.ctx").alias("sum_context"),
            F.col("_l.ctx_loaded_at").alias("sum_loaded_at"),
            F.col("_l.ctx_occurred_at").alias("sum_occurred_at"),
            F.col("_l.ctx_freshness").alias("sum_freshness"),
            F.coalesce(F.col("_l.has_snapshot"), F.lit(False)).alias("has_snapshot"),
        )
    )
    out = numbered(out, CASE, ["pos"], "entry", check=is_split(runs))
    return with_neighbours(out, next={"next_step": "step_key"}, pos="entry", order=["pos"])


# ---------------------------------------------------------------- instances and overviews

IDENTITY = ["source_system", "case_identity", "document_version", "process_key", "template_version"]


def instance_state(events: DataFrame, template_version: str = "draft") -> DataFrame:
    """What is known of each identity from these events alone: first and last arrival, last arrival of phase ``after``,
    count.  States of parts of a log merge (``merged_state``) in any order and grouping."""
    arrival = F.struct("received_at", F.coalesce("event_id", F.lit(LAST_ID)).alias("event_id"), "external_event_key")
    uuid = F.nullif(F.col("document_uuid"), F.lit(""))
    identity = F.when(uuid.isNotNull(), F.concat(F.lit("uuid:"), uuid)).otherwise(
        F.concat(F.lit("external:"), F.coalesce("document_external_id", F.lit("")))
    )
    first = F.struct(arrival.alias("arrival"), "document_uuid", "document_external_id", "occurred_at")
    last = F.struct(arrival.alias("arrival"), "occurred_at")
    after = F.when(F.col("event_phase") == "after", F.struct(arrival.alias("arrival"), "step_key"))
    return (
        events.withColumns({"case_identity": identity, "template_version": F.lit(template_version)})
        .groupBy(*IDENTITY)
        .agg(F.min(first).alias("first"), F.max(last).alias("last"), F.max(after).alias("after"), F.count(F.lit(1)).alias("event_count"))
    )


def merged_state(states: DataFrame) -> DataFrame:
    """One state per identity."""
    return states.groupBy(*IDENTITY).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("after").alias("after"), F.sum("event_count").alias("event_count")
    )


def instances_of(states: DataFrame) -> DataFrame:
    """Instances from merged states."""
    return states.select(
        *IDENTITY,
        F.col("first.document_uuid").alias("document_uuid"),
        F.col("first.document_external_id").alias("document_external_id"),
        F.col("first.occurred_at").alias("started_at"),
        F.col("last.occurred_at").alias("last_event_at"),
        F.coalesce("after.step_key", F.lit("unknown")).alias("current_step_key"),
        "event_count",
        F.lit("running").alias("status"),
    )


def build_instances(events: DataFrame, template_version: str = "draft") -> DataFrame:
    """One row per identity: start of the first arrival, last event, current step.

    Arrival order is (received, id); a case without uuid is known by its
    external id.  Instances never end.
    """
    return instances_of(instance_state(events, template_version))


def journey_overview(events: DataFrame, instances: DataFrame) -> DataFrame:
    """Per case and process: event and instance counts, versions, first and last time."""
    e = (
        events.filter(F.col("document_uuid").isNotNull())
        .groupBy("document_uuid", "process_key")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.collect_set("document_version").alias("_ev"),
            F.min("occurred_at").alias("first_at"),
            F.max("occurred_at").alias("last_at"),
        )
    )
    i = (
        instances.filter(F.col("document_uuid").isNotNull())
        .groupBy("document_uuid", "process_key")
        .agg(F.count(F.lit(1)).alias("instance_count"), F.collect_set("document_version").alias("_iv"))
    )
    none = F.array().cast("array<int>")
    return e.join(i, ["document_uuid", "process_key"], "full_outer").select(
        "document_uuid",
        "process_key",
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.coalesce("instance_count", F.lit(0)).alias("instance_count"),
        F.array_sort(F.array_union(F.coalesce("_ev", none), F.coalesce("_iv", none))).alias("versions"),
        "first_at",
        "last_at",
    )
