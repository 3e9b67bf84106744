"""Row numbers, neighbours and carried values inside groups of any size.

A group is one window partition, unless it holds more rows than ``spark.casetrail.hotCaseRows`` (default 2,000,000). The
rows of such groups are range-partitioned by group and full order (text, unknown values and copies included); each range
is a ``block`` of its group, and what a block needs of its neighbours (rows before it, border rows, last known value) is
added up over one row per block. Other groups are block 0. Windows run per (group, block), so both kinds share one plan
and one shuffle, and nothing runs while the plan is built. As the plan of each step reads the frame before it twice,
long chains of steps (``cases``) decide about large groups beforehand instead.

The list of large groups holds the ``HOT_GROUPS`` largest at most, so it may be broadcast; a group that is not on a full
list holds less than one part in ``HOT_GROUPS`` of all rows. Tables of one row per block hold at most a row per range and
large group. The ranges are kept on disk while a query reads them several times (``held``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casetrail.sources.scratch import held

HOT_CONF = "spark.casetrail.hotCaseRows"
HOT_DEFAULT = 2_000_000
#: Groups that can be cut, the largest first.
HOT_GROUPS = 10_000
LAST_ID = 2**63 - 1


def hot_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_CONF, str(HOT_DEFAULT)))


def sort_by(names: list[str]) -> list[Column]:
    """Plain columns only, so that windows in the same order share one sort."""
    return [F.col(c).asc_nulls_last() if c == "event_id" else F.col(c) for c in names]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal keys, where unknown equals unknown; ``small`` broadcasts the right side."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    out = left.join(F.broadcast(other) if small else other, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def hot_groups(df: DataFrame, group: list[str]) -> DataFrame:
    """The largest groups above the limit."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > hot_limit(df.sparkSession))
    return held(large.orderBy(F.desc("_n"), *group).limit(HOT_GROUPS).drop("_n"))


def cut(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``block``, and ``_before``: the rows of earlier blocks of the same keys."""
    hot = hot_groups(df, keys)
    cold = null_safe_join(df, hot, keys, "left_anti", small=True)
    many = null_safe_join(df, hot, keys, "left_semi", small=True)
    many = many.withColumn("_copy", F.monotonically_increasing_id())  # spreads rows that are equal in the whole order
    ranges = many.repartitionByRange(*[F.col(k) for k in keys], *sort_by(order), "_copy")
    ranges = held(ranges.drop("_copy").withColumn("block", F.spark_partition_id() + 1))
    n = ranges.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_n"))
    before = n.select(*keys, "block", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_before"))
    whole = cold.withColumns({"block": F.lit(0), "_before": F.lit(0).cast("long")})
    return whole.unionByName(null_safe_join(ranges, before, keys + ["block"], small=True))


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def in_order(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "block").orderBy(*sort_by(order))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """``row_number`` per group, however large; adds ``block``."""
    rows = cut(df, keys, order)
    return rows.withColumn(name, F.row_number().over(in_order(keys, order)) + F.col("_before")).drop("_before")


def with_neighbours(
    df: DataFrame,
    next: dict[str, str] | None = None,
    prev: dict[str, str] | None = None,
    *,
    keys: list[str],
    pos: str = "pos",
    order: list[str] | None = None,
) -> DataFrame:
    """Add columns of the following / preceding row: {new name: source column}.

    ``pos`` grows along the group. ``order`` names the columns ``pos`` was numbered by, so that rows still in that order
    are not sorted again."""
    next, prev = next or {}, prev or {}
    w = in_order(keys, order or [pos])
    out = df.withColumns({**{k: F.lead(c).over(w) for k, c in next.items()}, **{k: F.lag(c).over(w) for k, c in prev.items()}})
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([*next.values(), *prev.values()])])
    along = Window.partitionBy(*keys).orderBy("block")
    borders = (
        df.filter(F.col("block") > 0)
        .groupBy(*keys, "block")
        .agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"), F.min_by(row, pos).alias("_first"), F.max_by(row, pos).alias("_last"))
        .select(*keys, "block", "_lo", "_hi", F.lead("_first").over(along).alias("_after"), F.lag("_last").over(along).alias("_ahead"))
    )
    out = null_safe_join(out, borders, keys + ["block"], "left", small=True)
    at, n = F.col(pos), len(next)
    fixed = {k: F.when(at == F.col("_hi"), F.col(f"_after.c{i}")).otherwise(F.col(k)) for i, k in enumerate(next)}
    fixed |= {k: F.when(at == F.col("_lo"), F.col(f"_ahead.c{n + i}")).otherwise(F.col(k)) for i, k in enumerate(prev)}
    return out.withColumns(fixed).drop("_lo", "_hi", "_after", "_ahead")


def with_last_known(
    df: DataFrame,
    value: Column,
    name: str,
    *,
    keys: list[str],
    pos: str = "pos",
    include_current: bool = True,
    order: list[str] | None = None,
) -> DataFrame:
    """Last non-null ``value`` at or before (or strictly before) each row."""
    w = in_order(keys, order or [pos]).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    out = df.withColumn("_v", value)
    local = out.withColumn(name, F.last("_v", ignorenulls=True).over(w)).drop("_v")
    carried = (
        out.filter(F.col("block") > 0)
        .groupBy(*keys, "block")
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(pos))).alias("_last"))
        .select(*keys, "block", F.last("_last", ignorenulls=True).over(_earlier(keys)).alias("_carried"))
    )
    out = null_safe_join(local, carried, keys + ["block"], "left", small=True)
    return out.withColumn(name, F.coalesce(name, "_carried")).drop("_carried")
