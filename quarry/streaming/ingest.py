"""Structured Streaming ingest of rule-violation reports arriving in a folder.

The reference ingests reports as its workers produce them. Here a file
stream source picks up new ``<ruleset>/<id>.xml`` reports. Each micro-batch
is flattened with the same code as the batch reader and appended to a
Parquet table partitioned by report set. Progress lives in the query's
checkpoint, so a restarted query (or a lost executor) neither skips nor
re-appends a report. There is no state, watermark or window: every report
is complete when it lands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.reports import VIOLATION_SCHEMA, XML_GLOB, violations_from_xml_rows


def violation_stream(spark: SparkSession, source_dir: str, report_set: str = "main",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of violations from reports written under ``source_dir``."""
    reader = (spark.readStream.format("xml").option("rowTag", "file")
              .option("recursiveFileLookup", "true").option("pathGlobFilter", XML_GLOB)
              .schema(VIOLATION_SCHEMA))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(source_dir).withColumn("report", F.col("_metadata.file_path"))
    return violations_from_xml_rows(raw, report_set)


def start_violation_ingest(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_dir: str,
                           report_set: str = "main", available_now: bool = False) -> StreamingQuery:
    """Append every new report's violations to ``table_dir`` (Parquet, partitioned by report_set).

    ``checkpoint_dir`` must be on shared storage. ``available_now=True`` processes
    what is there and stops (a catch-up run); otherwise the query keeps running.
    """
    stream = violation_stream(spark, source_dir, report_set)
    writer = (stream.writeStream.format("parquet").option("path", table_dir)
              .option("checkpointLocation", checkpoint_dir).partitionBy("report_set")
              .outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _append(stream: DataFrame, table_dir: str, checkpoint_dir: str, available_now: bool,
            partition_by: str | None = None) -> StreamingQuery:
    writer = (stream.writeStream.format("parquet").option("path", table_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_clone_ingest(spark: SparkSession, source_dir: str, dups_dir: str, occs_dir: str,
                       checkpoint_dir: str, available_now: bool = False) -> tuple[StreamingQuery, StreamingQuery]:
    """Append new clone reports as duplications and occurrences (two sinks, two checkpoints).

    Both tables are keyed by the same content hash, so they join back even though
    their queries commit independently.
    """
    from quarry.sources.reports import CLONE_SCHEMA, clones_from_xml_rows

    raw = (spark.readStream.format("xml").option("rowTag", "duplication")
           .option("recursiveFileLookup", "true").option("pathGlobFilter", XML_GLOB)
           .schema(CLONE_SCHEMA).load(source_dir).withColumn("report", F.col("_metadata.file_name")))
    dups, occs = clones_from_xml_rows(raw)
    return (_append(dups, dups_dir, f"{checkpoint_dir}/dups", available_now),
            _append(occs, occs_dir, f"{checkpoint_dir}/occs", available_now))


def start_sloc_ingest(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_dir: str,
                      per_file: bool = False, available_now: bool = False) -> StreamingQuery:
    """Append the line count of each new line-count report (whole file per row)."""
    from quarry.sources.reports import sloc_from_text_rows

    raw = (spark.readStream.option("recursiveFileLookup", "true").text(source_dir, wholetext=True)
           .withColumn("report", F.col("_metadata.file_path")))
    return _append(sloc_from_text_rows(raw, per_file), table_dir, checkpoint_dir, available_now)
