"""The survey table store: clean rows and the additive rollup, materialised once.

Dashboards issue many queries over the same responses, so the clean table is
written once, partitioned by ``sprint_part`` (period filters prune
directories), and every query reads it; the additive rollup is written next to
it.  Both live below the session's ``spark.checkpoint.dir`` (see
``promoscope.session``), so a lost executor never loses them and the lineage
back to the raw inputs is cut.

The cache is per Spark application and input directory; a new application
re-materialises.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.operators.clean import CLEAN_SCHEMA, clean_survey
from promoscope.operators.rollup import ROLLUP_SCHEMA, as_counts, build_rollup
from promoscope.session import scratch_path
from promoscope.sources.driver_tables import survey_raw, survey_raw_counted

_LOCK = threading.Lock()
_PATHS: dict[tuple[str, str, str], str] = {}


def _key(spark: SparkSession, sf_dir: str, kind: str) -> tuple[str, str, str]:
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), kind)


def write_clean(df: DataFrame, path: str, mode: str = "overwrite", dynamic: bool = False) -> None:
    """Write a clean table partitioned by sprint.

    Every task writes its rows into the folders of their sprints, so the wide rows
    with their comments are not shuffled once more for the write.  A task behind a
    shuffle has the advisory partition size of AQE, so the number of files grows with
    the rows, and a large sprint is dealt over all tasks.  Comments are most of the
    bytes; zstd takes less of the disk than the default codec.
    """
    w = df.select(*CLEAN_SCHEMA.fieldNames()).write.mode(mode).option("compression", "zstd")
    if dynamic:  # replace only the partitions present in ``df``
        w = w.option("partitionOverwriteMode", "dynamic")
    w.partitionBy("sprint_part").parquet(path)


def write_rollup(rollup: DataFrame, path: str, dynamic: bool = False) -> None:
    """Write a rollup partitioned by sprint; ``dynamic`` replaces only the sprints it has."""
    w = rollup.hint("rebalance", "sprint_part").write.mode("overwrite")
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.partitionBy("sprint_part").parquet(path)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROLLUP_SCHEMA).parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLEAN_SCHEMA).parquet(path)


_FRAMES: dict[tuple[str, str, str], DataFrame] = {}


def survey_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean survey table derived from the driver tables under ``sf_dir``.

    The stored table never changes once written, so one DataFrame (with its
    file listing and schema) serves every query of the application.
    """
    key = _key(spark, sf_dir, "clean")
    with _LOCK:
        df = _FRAMES.get(key)
        if df is None:
            path = scratch_path(spark, "survey_clean")
            write_clean(clean_survey(survey_raw(spark, sf_dir)), path)
            _PATHS[key] = path
            df = _FRAMES[key] = read_clean(spark, path)
    return df


def survey_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``survey_table`` to be read once, for a table of the caller's own: those of the stored
    table if the application has it, otherwise derived and cleaned here, so that they are written once."""
    with _LOCK:
        df = _FRAMES.get(_key(spark, sf_dir, "clean"))
    return clean_survey(survey_raw(spark, sf_dir)) if df is None else df


#: A rollup is used when it has at most this share of the rows it sums up.
ROLLUP_PAYS = 0.5


def survey_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the count queries read: the additive rollup of ``survey_table`` where it is
    much smaller than the rows, else the rows' unit counts (the same columns, kept as narrow rows, so
    that comments are read once).  Either is written once and partitioned by sprint.

    The rows are those of the stored table if the application has it; otherwise they are derived and
    cleaned here, without the table and with a mark for each comment, as counts need no text.
    """
    key = _key(spark, sf_dir, "rollup")
    with _LOCK:
        df = _FRAMES.get(key)
        if df is None:
            clean = _FRAMES.get(_key(spark, sf_dir, "clean"))
            if clean is None:
                clean = clean_survey(survey_raw_counted(spark, sf_dir))
            path = scratch_path(spark, "survey_rollup")
            write_rollup(build_rollup(clean), path)
            df = read_rollup(spark, path)
            combinations, rows = df.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            if combinations > ROLLUP_PAYS * rows:
                path = scratch_path(spark, "survey_counts")
                write_rollup(as_counts(clean), path)
                df = read_rollup(spark, path)
            _PATHS[key] = path
            _FRAMES[key] = df
    return df


def survey_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most evocative comments of every (sprint, band, theme) of ``survey_table``, written once."""
    from promoscope.operators import topk

    key = _key(spark, sf_dir, "topk")
    clean = survey_table(spark, sf_dir)
    with _LOCK:
        df = _FRAMES.get(key)
        if df is None:
            path = scratch_path(spark, "survey_topk")
            topk.build(clean, path)
            _PATHS[key] = path
            df = _FRAMES[key] = topk.read(spark, path)
    return df
