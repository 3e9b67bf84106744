"""Small logs typed as rows: {case: [(step, 'HH:MM'), ...]}."""

from __future__ import annotations

import json

LOG_SCHEMA = (
    "external_event_key string, source_system string, process_key string, event_key string, step_key string,"
    " event_phase string, document_external_id string, document_uuid string, document_version int, actor_ref string,"
    " occurred_at timestamp, received_at timestamp, event_id long, context string"
)


def make_log(spark, cases, process="p", context=None, day="2026-05-31"):
    rows, n = [], 0
    for case, steps in cases.items():
        for step, clock in steps:
            n += 1
            at = f"{day} {clock}:00"
            ctx = context.get(case) if context else None
            rows.append(
                (f"e{n}", "src", process, step, step, "after", case, case, 1, None, at, at, n, json.dumps(ctx) if ctx is not None else None)
            )
    schema = LOG_SCHEMA.replace("occurred_at timestamp, received_at timestamp", "occurred_at string, received_at string")
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: df[c].cast("timestamp") for c in ("occurred_at", "received_at")})


def snapshots_of(log):
    return log.filter("context IS NOT NULL").selectExpr(
        "document_uuid", "document_version", "process_key", "external_event_key", "occurred_at AS captured_at", "occurred_at",
        "occurred_at AS loaded_at", "cast(null AS long) AS freshness_seconds", "context",
    )


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# Returns desk: goods come back, are weighed and looked at in either order, then paid for or scrapped.
RETURNS = {
    "r-a": [("arrive", "06:10"), ("weigh", "06:31"), ("inspect", "06:52"), ("refund", "07:40")],
    "r-b": [("arrive", "06:15"), ("inspect", "06:44"), ("weigh", "07:02"), ("refund", "07:05")],
    "r-c": [("arrive", "07:20"), ("label", "07:21"), ("weigh", "07:50"), ("inspect", "08:33"), ("scrap", "09:14")],
    "r-d": [("arrive", "07:45"), ("label", "07:58"), ("inspect", "08:01"), ("weigh", "08:12"), ("scrap", "11:00")],
    "r-e": [("arrive", "12:00"), ("label", "12:09"), ("arrive", "12:30")],
    "r-f": [("arrive", "13:37"), ("weigh", "13:59"), ("inspect", "14:20"), ("scrap", "14:21")],
}
