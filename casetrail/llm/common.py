"""Pieces shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from casetrail.sources.scratch import scratch_path, staged

__all__ = ["batches", "plain", "ranked_total", "read", "running_total", "scratch_path", "spread", "staged", "text_of", "uniform", "unused"]

#: Resolution of ``uniform``.
UNIFORM = 1 << 40


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that further ones (whatever their names) cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(column: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``make`` on every Arrow batch; it sees whole rows, never more than a batch of them."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = make(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def spread(n: Column) -> Column:
    """How many parts a group of ``n`` rows is cut into: parts and rows of a part both grow with the root of n."""
    return F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("long")


def uniform(*columns: Column, seed: int = 0) -> Column:
    """A whole number in [0, UNIFORM) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 24)


def running_total(df: DataFrame, keys: list[str], u: str, parts: str, amount: str, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the earlier rows of the same keys, in order of ``u``, then ``order``.

    ``u`` is uniform below UNIFORM and ``parts`` (the same for all rows of the keys) says into how many ranges of
    ``u`` a group is cut: sums of ranges are added up first, then rows inside each range. No window holds more than a
    range or the list of ranges, so one key may hold any share of all rows. Rows equal in every column may change places.
    ``df`` is read twice; stage it if it is costly.
    """
    cut = df.withColumn("_range", F.floor(F.col(u) * F.col(parts) / F.lit(UNIFORM)).cast("long"))
    by = [*keys, "_range"]
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        cut.groupBy(*by)
        .agg(F.sum(amount).alias("_sum"))
        .select(*by, F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*by).orderBy(u, *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(base, by)
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_range", "_base")
    )


def ranked_total(df: DataFrame, order: list[str], amounts: dict[str, str], name: str) -> DataFrame:
    """For every entry of ``amounts`` (new column: summed column), the sum over all earlier rows in ``order``.

    Ranges of the order are sorted each by itself; their sums (one row per range) are then added up.
    """
    cut = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_part").agg(*[F.sum(c).alias(f"_{o}") for o, c in amounts.items()])
    base = sums.select("_part", *[F.coalesce(F.sum(f"_{o}").over(upto), F.lit(0)).alias(f"_{o}") for o in amounts])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(base), "_part")  # as many rows as shuffle partitions
    for o, c in amounts.items():
        out = out.withColumn(o, F.col(f"_{o}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).drop(f"_{o}")
    return out.drop("_part")
