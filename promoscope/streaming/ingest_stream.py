"""Incremental CSV ingest with Structured Streaming and an upsert sink.

* R1: the stream's rows are files, not lines: one file source over the landing folder (all layouts,
  now and later) yields path, size and modification time of every new CSV file; contents are not read
  by the source.  So there is one source whatever layouts exist, and every file's own header decides
  how its columns are mapped (Q25: a positional streaming CSV schema would apply one header to all).
* R2: ``foreachBatch`` ingests the micro-batch's files like a batch load (``csv_ingest.ingest_files``)
  and merges them into the partitioned survey table (touched sprints only).  Last-wins order: batch,
  file time, path, place in the file; a new batch always beats what the table has, also with a fresh
  checkpoint.  Re-running a batch after a failure merges the same rows again, so the sink is idempotent.
* R3: a late re-send of an old sprint rewrites only that sprint's partition (the key contains
  ``sprint_id``); no watermark is needed because no state is kept outside the table.

Every micro-batch logs its files (S9, ``sources.ingest_log``) under its own name, after the merge and
before the stream's commit.  Files that gave no rows stay in the log as dead letters: the source has seen
their paths and never offers them again, so each trigger first looks at them, and those that were mended
in place are ingested like a new arrival.

A file without a byte gives a scan no row, so a stream neither loads nor logs it (a batch load logs it).

``max_files`` bounds a micro-batch's file list, which is all that the driver holds.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from promoscope.operators.clean import CLEAN_SCHEMA
from promoscope.operators.upsert import upsert_into
from promoscope.sources.csv_ingest import CsvFile, ingest_files, with_heads
from promoscope.sources.files import CSV_GLOB, exists, file_columns
from promoscope.sources.ingest_log import append_log, mended
from promoscope.sources.versions import VersionedTable

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ensure_table(spark: SparkSession, path: str) -> None:
    """Create an empty partitioned survey table if none exists yet."""
    if not exists(spark, path):
        spark.createDataFrame([], CLEAN_SCHEMA).write.mode("overwrite").partitionBy("sprint_part").parquet(path)


def new_files(spark: SparkSession, landing: str, max_files: int = 1000) -> DataFrame:
    """The CSV files that arrive at or below ``landing`` (which may be a glob), as a stream."""
    found = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
             .option("pathGlobFilter", CSV_GLOB).option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", str(max_files)).load(landing))
    return file_columns(found)


def log_of(table_path: str) -> str:
    """Where a table's ingest log is unless another place is named."""
    return table_path.rstrip("/") + "_ingest_log"


def _apply(spark: SparkSession, files: list[CsvFile], name: str, table_path: str, log_path: str,
           rollup_path: str | None, versioned: bool) -> None:
    clean, report = ingest_files(spark, files)
    if clean is not None and versioned:
        VersionedTable(spark, table_path).upsert(clean)
    elif clean is not None:
        upsert_into(spark, table_path, clean, rollup_path=rollup_path)
    append_log(report, log_path, name, "stream")


def _upsert_batch(table_path: str, log_path: str, stream: str, rollup_path: str | None, versioned: bool):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = with_heads(spark, batch)
        if files:
            _apply(spark, files, f"{stream}-{batch_id:09d}", table_path, log_path, rollup_path, versioned)
    return run


def retry_dead_letters(spark: SparkSession, table_path: str, log_path: str | None = None,
                       rollup_path: str | None = None, versioned: bool = False) -> int:
    """Ingest the rejected files that were mended in place; how many there were.

    The name of the ingest comes from the files and their times, so a retry that is cut off between merge
    and log is repeated under the same name.
    """
    log_path = log_path or log_of(table_path)
    listing = mended(spark, log_path)
    files = with_heads(spark, listing) if listing is not None else []
    if files:
        state = repr([(f.path, f.size, f.modified) for f in files])
        _apply(spark, files, "retry-" + hashlib.sha256(state.encode()).hexdigest()[:16], table_path, log_path, rollup_path, versioned)
    return len(files)


def run_available(spark: SparkSession, landing: str, table_path: str, checkpoint_dir: str,
                  max_files: int = 1000, rollup_path: str | None = None, log_path: str | None = None,
                  versioned: bool = False) -> None:
    """Process every file now present at or below ``landing`` (availableNow), mended dead letters first.

    ``versioned``: the table is one of ``sources.versions``, so each micro-batch appears at once and other
    writers may write to it at the same time; otherwise its touched sprints are replaced in place.
    """
    if versioned and rollup_path is not None:
        raise ValueError("a rollup is kept next to a table that is replaced in place only")
    if not versioned:
        ensure_table(spark, table_path)
    log_path = log_path or log_of(table_path)
    retry_dead_letters(spark, table_path, log_path, rollup_path, versioned)
    # a fresh checkpoint counts its batches anew, so the name has the checkpoint's
    stream = "stream-" + hashlib.sha256(checkpoint_dir.encode()).hexdigest()[:12]
    q = (new_files(spark, landing, max_files).writeStream
         .foreachBatch(_upsert_batch(table_path, log_path, stream, rollup_path, versioned))
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
