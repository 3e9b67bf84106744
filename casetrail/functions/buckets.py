"""Numeric classes and rounded ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Upper bounds in seconds (inclusive) of the waiting-time classes.
DWELL_BOUNDS = [
    (300, "dwell-very-low"),
    (900, "dwell-low"),
    (1800, "dwell-moderate"),
    (3600, "dwell-warm"),
    (7200, "dwell-medium"),
    (14400, "dwell-high"),
    (28800, "dwell-very-high"),
]
DWELL_TOP = "dwell-critical"


def fixed_dwell_bucket(seconds: Column) -> Column:
    bound, name = DWELL_BOUNDS[0]
    out = F.when(seconds <= bound, F.lit(name))
    for bound, name in DWELL_BOUNDS[1:]:
        out = out.when(seconds <= bound, F.lit(name))
    return out.otherwise(F.lit(DWELL_TOP))


def relative_buckets(df: DataFrame, value: str, count: int, prefix: str, within: list[str] | None = None) -> DataFrame:
    """Clip ``value`` to its 10th..90th percentile and cut into ``count`` classes.

    Percentiles come from one aggregate row per ``within`` group, joined back by
    broadcast (the groups are processes: one row each).
    """
    within = within or []
    top = max(0, count - 1)
    q = df.groupBy(*within).agg(F.percentile(value, F.array(F.lit(0.1), F.lit(0.9))).alias("_q"))
    joined = df.join(F.broadcast(q), within) if within else df.crossJoin(F.broadcast(q))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    clipped = F.least(F.greatest(F.col(value).cast("double"), lo), hi)
    bucket = F.when(lo == hi, F.lit(top // 2)).otherwise(F.floor((clipped - lo) / (hi - lo) * top)).cast("int")
    return joined.withColumn("bucket", F.concat(F.lit(prefix), bucket.cast("string"))).drop("_q")


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded share, 0 when the whole is 0 or missing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(part / whole, digits)).cast("double")
