"""Exact interpolated quantiles of whole numbers, without gathering a group.

Values are counted first, then located through coarse buckets, so the widest
window holds one row per bucket (or per value inside one bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WIDTH = 4096


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows per distinct value; nulls are left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))


def exact_quantiles(counts: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per ``keys`` with a DOUBLE column per entry of ``probs``.

    ``counts`` comes from ``value_counts``; ``value`` is a BIGINT column.
    Rank = p * (n - 1), linear between the neighbouring values.
    """
    hist = counts.withColumn("_b", F.floor(F.col(value) / WIDTH))
    per_key = Window.partitionBy(*keys)
    coarse = (
        hist.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_upto", F.sum("_bn").over(per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_bn").over(per_key))
        .withColumn("_base", F.col("_upto") - F.col("_bn"))
    )
    ranks = {n: F.lit(p) * (F.col("_total") - 1) for n, p in probs.items()}

    def holds(rank, start, end):
        return (start <= rank) & (rank < end)

    wanted = F.lit(False)
    for r in ranks.values():
        for edge in (F.floor(r), F.ceil(r)):
            wanted = wanted | holds(edge, F.col("_base"), F.col("_upto"))
    fine = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    located = (
        hist.join(coarse.filter(wanted).select(*keys, "_b", "_base", "_total"), keys + ["_b"])
        .withColumn("_end", F.col("_base") + F.sum("_n").over(fine))
        .withColumn("_from", F.col("_end") - F.col("_n"))
    )
    aggs = []
    for n, r in ranks.items():
        for side, edge in (("lo", F.floor(r)), ("hi", F.ceil(r))):
            aggs.append(F.max(F.when(holds(edge, F.col("_from"), F.col("_end")), F.col(value))).alias(f"_{n}_{side}"))
    out = located.groupBy(*keys).agg(*aggs, F.max("_total").alias("_total"))
    return out.select(
        *keys,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * (r - F.floor(r))).cast("double").alias(n)
            for n, r in ranks.items()
        ],
    )
