"""Upsert of re-sent survey files on (sprint_id, respondent_id), last wins.

``latest_per_key`` keeps, per key, the last row by (ingest_batch, file_order, src_file, row_seq); the
four together are different for all rows of a table.  Only the keys and these order columns are
aggregated (partially on the map side, so a hot key - a third of all rows with a blank respondent id -
is one row per task), and only keys with more than one row come out.  The wide rows are then joined
with that short list, which Spark broadcasts where it is small; they are never sorted or aggregated.

``merge`` ranks new rows before all base rows, whatever their order columns say, so a new row always beats
an old one; base and new rows go through one such aggregation.

``upsert_into`` stages the new rows once in the shared folder, rewrites only the sprint partitions
they touch (static partition filter, dynamic partition overwrite), and rebuilds the same sprints of
the rollup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.operators.clean import CLEAN_COLUMNS, CLEAN_SCHEMA

KEYS = ("sprint_id", "respondent_id")
ORDER = ("ingest_batch", "file_order", "src_file", "row_seq")


def last_places(df: DataFrame, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(keys, _last): the place of the last row of every key that has more than one."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*order)).alias("_last"))
              .filter("_n > 1").select(*keys, "_last"))


def latest_per_key(df: DataFrame, keys: tuple[str, ...] = KEYS,
                   order: tuple[str, ...] = ORDER) -> DataFrame:
    """The last row per key by ``order`` (key columns without nulls)."""
    return (df.join(last_places(df, keys, order), list(keys), "left")
              .filter(F.col("_last").isNull() | (F.struct(*order) == F.col("_last"))).select(*df.columns))


def merge(base: DataFrame, new: DataFrame, full: bool = False, touched: list[str] | None = None,
          staged: bool = False) -> DataFrame:
    """Rows of ``base`` and ``new`` merged last-wins; a new row beats any base row of its key.

    ``full=True`` dedups the whole table (what the survey programme does on its first upload, Q11);
    otherwise only the sprints of ``new`` are merged and the result holds just those sprints.
    ``touched``: their ``sprint_part`` values, if the caller knows them.  New rows are read twice, so they
    are written to the shared folder first unless they are ``staged`` already.
    """
    cols = list(CLEAN_COLUMNS)
    if not staged:
        new = stage(new)
    if not full:
        # one value per partition directory that a write of the result replaces
        parts = touched_parts(new) if touched is None else touched
        base = base.filter(F.col("sprint_part").isin(*parts))
    both = base.select(*cols, F.lit(0).alias("_new")).unionByName(new.select(*cols, F.lit(1).alias("_new")))
    return latest_per_key(both, KEYS, ("_new", *ORDER)).select(*cols)


def stage(rows: DataFrame) -> DataFrame:
    """Clean rows, written once to the shared folder."""
    from promoscope.session import scratch_path

    spark = rows.sparkSession
    path = scratch_path(spark, "upsert")
    rows.select(*CLEAN_COLUMNS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(CLEAN_SCHEMA).parquet(path)


def touched_parts(new: DataFrame) -> list[str]:
    return sorted(r[0] for r in new.select("sprint_part").distinct().collect())


def upsert_into(spark: SparkSession, table_path: str, new: DataFrame, full: bool = False,
                rollup_path: str | None = None, topk_path: str | None = None) -> list[str]:
    """Apply ``new`` clean rows to the partitioned table at ``table_path``; returns the touched sprints.

    Dynamic partition overwrite replaces only the sprint partitions present in the merged result.  The
    write tasks read the old files before the driver-side commit swaps the touched partitions in, so a
    retried task (lost executor) still reads the original data; a failure before the commit leaves the
    table unchanged, and applying the same rows again gives the same table.  The rows get the batch
    number after the largest one in the sprints they touch.
    """
    from promoscope.operators.rollup import build_rollup
    from promoscope.sources.store import read_clean, write_clean, write_rollup

    new = stage(new)
    base = read_clean(spark, table_path)
    parts = touched_parts(new)
    of_parts = F.col("sprint_part").isin(*parts)
    last = base.filter(of_parts).agg(F.max("ingest_batch")).first()[0]
    new = new.withColumn("ingest_batch", F.lit(0 if last is None else last + 1).cast("bigint"))
    if topk_path is not None and full:
        raise ValueError("a table of top comments is kept by upserts of sprints; build it again after a full one")
    if topk_path is not None:
        # the rows before, without their comments, for what the stored rows lose
        before = stage(base.filter(of_parts).withColumn("feedback", F.lit("")))
    write_clean(merge(base, new, full, parts, staged=True), table_path, mode="overwrite", dynamic=True)
    if topk_path is not None:
        from promoscope.operators import topk

        topk.update(spark, topk_path, before, new, read_clean(spark, table_path), parts)
    if rollup_path is not None:
        rows = read_clean(spark, table_path)
        write_rollup(build_rollup(rows if full else rows.filter(of_parts)), rollup_path, dynamic=True)
    return parts
