"""Working tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

FOLDER_CONF = "spark.checkpoint.dir"


def _base(spark: SparkSession) -> str:
    base = spark.conf.get(FOLDER_CONF, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {FOLDER_CONF} to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="casetrail-")  # one machine only: driver and executors are one process
    spark.conf.set(FOLDER_CONF, base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; raises on a cluster where that is unset."""
    return f"{_base(spark)}/casetrail/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """Kept on the executors' disks from its first use on, so that a plan may read it several times; nothing runs now.

    What a lost executor held is computed again by the same stages, so rows keep their partitions. The mark sets the frame
    apart from equal ones of earlier calls, whose files may have changed since."""
    mark = f"_held_{uuid.uuid4().hex}"
    out = df.withColumn(mark, F.lit(True)).persist(StorageLevel.DISK_ONLY)
    _held.append(out)
    return out.drop(mark)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every working table of this application; call it when no result is read any more."""
    while _held:
        _held.pop().unpersist()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_base(spark)}/casetrail/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
