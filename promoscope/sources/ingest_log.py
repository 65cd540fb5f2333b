"""The ingest log, one row per file and ingest, appended by batch loads, manifest loads and streams.

The log is a folder of Parquet files partitioned by ``batch``, the name of an ingest.  Writing an ingest's
entries replaces those of the same name and no others (dynamic partition overwrite), so a load that is
repeated under its name, or a micro-batch that is replayed after a failure, leaves one set of entries.
``logged_at`` is the time of the ingest; the log is read newest first.

Files that gave no rows at all are ``rejected``.  A file's latest entry decides: ``dead_letters`` are the
files whose latest entry is a rejection, whoever wrote it.  ``mended`` compares them with the files as they
are now; those that have changed since (or could not be opened and now exist) are offered again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.sources.files import ANY_GLOB, exists, list_files, literal_path

ENTRY = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("logged_at", T.TimestampType()),
    T.StructField("file", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("file_name", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("modified", T.LongType()), T.StructField("file_order", T.LongType()),
    T.StructField("records", T.LongType()), T.StructField("skipped", T.LongType()),
    T.StructField("warnings", T.IntegerType()), T.StructField("status", T.StringType()),
    T.StructField("errors", T.StringType()), T.StructField("rejected", T.BooleanType()),
    T.StructField("place", T.IntegerType()), T.StructField("batch", T.StringType()),
])


def append_log(report: DataFrame, log_path: str, batch: str, kind: str = "batch",
               logged_at: dt.datetime | None = None) -> None:
    """Write the entries of the ingest ``batch`` (an ``ingest_report``), in place of earlier ones of that name."""
    at = logged_at or dt.datetime.now(dt.timezone.utc)
    entries = report.select(
        F.lit(kind).alias("kind"), F.lit(at).cast("timestamp").alias("logged_at"),
        "file", "path", "file_name", "size", "modified", "file_order", "records", "skipped", "warnings", "status",
        "errors", "rejected", F.col("log_rank").alias("place"), F.lit(batch).alias("batch"))
    # an entry per file: a few files of entries, not one per task
    (entries.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(log_path))


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """All entries, newest first by ``log_rank``; empty if nothing was logged yet."""
    found = (spark.read.schema(ENTRY).parquet(log_path) if exists(spark, log_path)
             else spark.createDataFrame([], ENTRY))
    # one row per file and ingest
    order = Window.orderBy(F.col("logged_at").desc(), F.col("batch").desc(), "place")
    return found.withColumn("log_rank", F.row_number().over(order))


def latest_entries(spark: SparkSession, log_path: str) -> DataFrame:
    """The newest entry of every file."""
    log = read_log(spark, log_path)
    columns = [c for c in log.columns if c != "file"]
    # in batches of the same time, the later name; within a batch, the last place
    order = F.struct("logged_at", "batch", "file_order")
    return log.groupBy("file").agg(F.max_by(F.struct(*columns), order).alias("e")).select("file", "e.*")


def dead_letters(spark: SparkSession, log_path: str) -> DataFrame:
    """Files that were rejected when they were last looked at: file, path, size, modified, errors, ..."""
    return latest_entries(spark, log_path).filter("rejected").drop("log_rank", "place")


def mended(spark: SparkSession, log_path: str) -> DataFrame | None:
    """The listing (path, uri, size, modified) of dead letters that are there and not what they were."""
    dead = dead_letters(spark, log_path).select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
    paths = sorted(r.path for r in dead.collect())  # one row per rejected file
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return None
    now = list_files(spark, [literal_path(p) for p in there], ANY_GLOB)
    changed = (F.col("old_size") != F.col("size")) | (F.col("old_modified") != F.col("modified"))
    return now.join(dead, "path").filter(changed).select("path", "uri", "size", "modified")
