"""Lists and overviews of cases, processes and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _with_case(events: DataFrame) -> DataFrame:
    return events.filter(F.col("document_uuid").isNotNull())


def case_list(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Cases of each process, newest arrival first when a limit is given."""
    out = (
        _with_case(events)
        .groupBy("process_key", "document_uuid")
        .agg(
            F.max("document_external_id").alias("document_external_id"),
            F.max("document_version").alias("document_version"),
            F.count(F.lit(1)).alias("event_count"),
            F.max("received_at").alias("last_event_at"),
        )
    )
    return out if limit is None else out.orderBy(F.desc("last_event_at"), "process_key", "document_uuid").limit(limit)


def case_refs_since(events: DataFrame, since, limit: int | None = None) -> DataFrame:
    """Case references with an event received or occurred since a time."""
    recent = events.filter((F.col("received_at") >= F.lit(since)) | (F.col("occurred_at") >= F.lit(since)))
    return case_list(recent, limit).select(
        "process_key",
        "document_uuid",
        F.nullif("document_external_id", F.lit("")).alias("document_external_id"),
        "document_version",
        "last_event_at",
    )


def process_overview(events: DataFrame) -> DataFrame:
    return (
        _with_case(events)
        .groupBy("process_key")
        .agg(F.count(F.lit(1)).alias("event_count"), F.count_distinct("document_uuid").alias("case_count"))
    )


def case_version_overview(events: DataFrame) -> DataFrame:
    return (
        _with_case(events)
        .groupBy("process_key", "document_uuid", "document_version")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.min("occurred_at").alias("first_at"),
            F.max("occurred_at").alias("last_at"),
        )
    )


def process_status(instances: DataFrame) -> DataFrame:
    """Instances per process and current step; every instance is open."""
    return instances.groupBy("process_key", "current_step_key").agg(
        F.count(F.lit(1)).alias("instance_count"),
        F.count_if(F.col("status") == "running").alias("open_count"),
        F.max("last_event_at").alias("last_event_at"),
    )


def latest_events(events: DataFrame, process_key: str, k: int = 10) -> DataFrame:
    return (
        events.filter(F.col("process_key") == process_key)
        .orderBy(F.desc("occurred_at"), "external_event_key")
        .limit(k)
        .select("external_event_key", "document_uuid", "document_version", "step_key", "occurred_at")
    )


def event_list(
    events: DataFrame,
    process_key: str | None = None,
    document_uuid: str | None = None,
    document_external_id: str | None = None,
    since=None,
    limit: int | None = None,
) -> DataFrame:
    """Filtered events, newest received first when limited."""
    for name, wanted in (
        ("process_key", process_key),
        ("document_uuid", document_uuid),
        ("document_external_id", document_external_id),
    ):
        if wanted is not None:
            events = events.filter(F.col(name) == wanted)
    if since is not None:
        events = events.filter((F.col("received_at") >= F.lit(since)) | (F.col("occurred_at") >= F.lit(since)))
    if limit is None:
        return events
    return events.orderBy(F.desc("received_at"), F.desc_nulls_last("event_id"), "external_event_key").limit(limit)


def event_details(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events with each of their snapshots: one row per snapshot, in capture order,
    or one row without snapshot."""
    s = snapshots.select(
        "document_uuid",
        "external_event_key",
        "captured_at",
        F.col("context").alias("snapshot_context"),
        F.col("loaded_at").alias("snapshot_loaded_at"),
    )
    return events.join(s, ["document_uuid", "external_event_key"], "left")
