"""Files as the executors and Spark's readers see them.

Listing goes through Spark's own file index, so any file system Spark can read works and large
folders are listed in parallel.  Bytes of single files (header records) are opened on the executors
with Arrow's file systems: local, HDFS, S3 (``s3``, ``s3a``, ``s3n``), GCS and ABFS.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_GLOB = "*.[cC][sS][vV]"  # S8, the same for batch and stream
ANY_GLOB = "*"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path and the path within it (S3 has other scheme names in Hadoop)."""
    path = re.sub(r"^file:/*", "/", re.sub(r"^s3[an]://", "s3://", path))
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def literal_path(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def list_files(spark: SparkSession, paths: Iterable[str], glob: str = CSV_GLOB) -> DataFrame:
    """(path, uri, size, modified) of the matching files at or below ``paths``; contents are not read.

    ``uri`` is the encoded form that ``_metadata.file_path`` has in every scan, so it is the key that
    rows and files share; ``modified`` is in microseconds.  Files without a byte have no row.
    """
    return file_columns(_found(spark, paths, glob))


def all_files(spark: SparkSession, paths: Iterable[str], glob: str = CSV_GLOB) -> set[str]:
    """The ``uri`` of every matching file, empty ones too."""
    return set(_found(spark, paths, glob).inputFiles())


def _found(spark: SparkSession, paths: Iterable[str], glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load([*paths]))


def file_columns(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("_metadata.file_path").alias("uri"), F.col("length").alias("size"),
                        F.unix_micros("modificationTime").alias("modified"))
