"""Event files in, event log and export files out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from casetrail.functions.values import trimmed
from casetrail.sources import commits

ENCODINGS = {"utf-8": "UTF-8", "ansi": "windows-1252"}


def read_event_files(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """Payloads of files that each hold one JSON array of events.  A file that holds none
    gives one row without payload and the error ``invalid_json``.

    A file is one task (an array cannot be split); many files read in parallel."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    if schema is None:
        text = spark.read.option("wholetext", True).text(pattern).withColumn("file", F.input_file_name())
        whole = F.try_parse_json("value")
        items = F.try_variant_get(whole, "$", "array<variant>")
        error = F.when(items.isNull(), F.lit("invalid_json"))
        # an empty array holds no events, which is no error
        return (
            text.select("file", items.alias("_items"), error.alias("error"))
            .filter(F.col("error").isNotNull() | (F.size("_items") > 0))
            .select("file", F.posexplode_outer("_items").alias("file_pos", "_v"), "error")
            .select("file", "file_pos", F.to_json("_v").alias("payload"), "error")
        )
    return reader.schema(schema).json(pattern)


def read_event_log_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of JSON-lines files, blank lines skipped; bad lines stay for the checks."""
    return spark.read.text(path).filter(trimmed("value") != "").select(F.col("value").alias("payload"))


def append_event_log(events: DataFrame, path: str) -> None:
    """Append to the log, one folder per process; the rows count once all are written (``commits``)."""
    spark = events.sparkSession
    load = commits.write_load(events, path)
    commits.commit(spark, path, lambda now: commits.with_load(now, load, events.schema))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the log's latest version, or of any folder of Parquet files that has no versions."""
    version = commits.latest(spark, path)
    return spark.read.parquet(path) if version is None else commits.rows_of(spark, path, version).drop(commits.LOAD)


def delete_process_data(rows: DataFrame, process_key: str, document_uuid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, count of rows to remove) of events, instances or snapshots.

    The caller overwrites the process's partition with what stays, or only reads
    the count (dry run)."""
    hit = F.col("process_key") == process_key
    if document_uuid is not None:
        hit = hit & F.coalesce(F.col("document_uuid") == document_uuid, F.lit(False))
    return rows.filter(~F.coalesce(hit, F.lit(False))), rows.agg(F.count_if(hit).alias("removed"))


def rewrite_process(kept: DataFrame, path: str) -> None:
    """Write what stays to a new log folder."""
    kept.write.mode("overwrite").partitionBy("process_key").parquet(path)


def remove_from_log(spark: SparkSession, path: str, process_key: str, document_uuid: str | None = None) -> int:
    """Remove a process or one of its cases from the log of ``append_event_log``.  Only that process's folders are read;
    what stays of them is a new load.  Returns the number of rows removed.

    The rows are gone in one step, with the new version of the log: whoever dies before leaves the log as it was, whoever
    dies after it leaves folders that nobody reads and the next removal (or ``commits.purge``) deletes.  Rows that others
    append meanwhile stay; a removal from the same process in between makes this one start anew."""
    while True:
        version = commits.latest(spark, path)
        if version is None:
            raise ValueError(f"{path} is no log of append_event_log")
        log = commits.rows_of(spark, path, version).filter(F.col("process_key") == process_key)
        kept, count = delete_process_data(log, process_key, document_uuid)
        removed = count.first()["removed"]
        if removed:
            replaced = {f"{r[0]}/{process_key}" for r in log.select(commits.LOAD).distinct().collect()}  # one per load
            load = commits.write_load(kept.drop(commits.LOAD), path) if document_uuid is not None else None

            def change(now: commits.Version) -> commits.Version | None:
                if replaced & set(now.gone):
                    return None
                out = replace(now, gone=(*now.gone, *sorted(replaced)))
                return commits.with_load(out, load, now.schema) if load else out

            if commits.commit(spark, path, change) is None:
                continue
        commits.purge(spark, path)
        return removed


def export_delimited(rows: DataFrame, path: str, sep: str = ";", encoding: str = "utf-8", by: str | None = "period") -> None:
    """Delimited text files, one folder per period; ``ansi`` writes windows-1252."""
    if encoding == "ansi":
        allow_ansi(rows.sparkSession)
    w = rows.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", ENCODINGS[encoding])
    (w.partitionBy(by) if by else w).csv(path)


def allow_ansi(spark: SparkSession) -> None:
    """Spark 4 accepts charsets beyond UTF and Latin-1 only with this setting."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def export_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, mode: str = "append") -> None:
    """Columns into a database table through the driver the cluster provides."""
    rows.write.jdbc(url, table, mode=mode, properties=properties or {})
