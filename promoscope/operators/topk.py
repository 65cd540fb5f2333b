"""The most evocative comments of every (sprint, band, theme), kept in a table.

A cell's rows are its first ``k`` comments by (evocativeness, place), so the top of any union of cells -
some periods, one band, one theme, all of them - is the top of their stored rows, as long as no more than
``k`` are asked for.  Verbatim queries read k rows a cell instead of all comments.

``update`` keeps the table when rows are upserted.  What a cell has stored and not lost, merged with the new
rows, is its new top if the cell held all of its comments, or if enough of them still stand at or before its
old last place: comments that were never stored come after that.  Only the cells for which neither holds
are read again from the table.

Every sprint that was written has a row of rank 0 that stands for it, so a sprint without comments replaces
its old rows, too; readers leave it out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.functions.columns import utf16_len_gt
from promoscope.operators.clean import CLEAN_COLUMNS, CLEAN_SCHEMA
from promoscope.operators.filters import FilterSpec
from promoscope.operators.upsert import KEYS, ORDER, last_places, latest_per_key
from promoscope.operators.verbatims import evoc_score, verbatims

CELL = ["sprint_part", "score_band", "theme"]
K = 100
SCHEMA = T.StructType([f for f in CLEAN_SCHEMA.fields if f.name != "sprint_part"] + [
    T.StructField("evoc", T.IntegerType()), T.StructField("cell_rank", T.IntegerType()),
    T.StructField("sprint_part", T.StringType())])


def _order():
    """The order of ``verbatims``, made unique by the rows' places."""
    return [F.col("evoc").desc(), "row_seq", *(c for c in ORDER if c != "row_seq")]


def commented(rows: DataFrame) -> DataFrame:
    return (rows.select(*CLEAN_COLUMNS).filter(utf16_len_gt(F.col("feedback"), 5))
            .withColumn("evoc", evoc_score().cast("int")))


def first_of_cells(rows: DataFrame, k: int) -> DataFrame:
    """The first k of every cell, with their ``cell_rank`` (a partial limit runs before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy(*_order()))
    return rows.withColumn("cell_rank", rank).filter(F.col("cell_rank") <= k)


def _write(top: DataFrame, parts: DataFrame, path: str, dynamic: bool) -> None:
    stand_in = parts.select("sprint_part").distinct().withColumn("cell_rank", F.lit(0))
    out = top.select(*SCHEMA.fieldNames()).unionByName(stand_in, allowMissingColumns=True)
    w = out.hint("rebalance", "sprint_part").write.mode("overwrite")
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.partitionBy("sprint_part").parquet(path)


def build(rows: DataFrame, path: str, k: int = K) -> None:
    """Write the table of ``rows`` (a clean table)."""
    _write(first_of_cells(commented(rows), k), rows, path, dynamic=False)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).filter("cell_rank > 0")


def update(spark: SparkSession, path: str, base: DataFrame, new: DataFrame, merged: DataFrame,
           parts: list[str], k: int = K) -> DataFrame:
    """Bring the sprints ``parts`` of the table up to date; the cells that were read again.

    ``base``: the sprints' rows before, ``new``: the staged new rows, ``merged``: the clean table after.
    """
    of_parts = F.col("sprint_part").isin(*parts)
    stored = read(spark, path).filter(of_parts)
    # rows that were replaced or dropped as older ones of their key: the short list of keys that repeat
    both = base.select(*CLEAN_COLUMNS, F.lit(0).alias("_new")).unionByName(new.select(*CLEAN_COLUMNS, F.lit(1).alias("_new")))
    last = last_places(both, KEYS, ("_new", *ORDER))
    place = F.struct(F.lit(0).alias("_new"), *ORDER)
    stands = F.col("_last").isNull() | (place == F.col("_last"))
    old = stored.join(last, list(KEYS), "left").withColumn("stands", stands).drop("_last")
    # new rows rank before all base rows of their key, so the last of each key among them stands
    added = commented(latest_per_key(new.select(*CLEAN_COLUMNS)))
    # places in a cell, to compare with that of its last stored row; evoc is counted down
    spot = F.struct((-F.col("evoc")).alias("e"), "row_seq", *(c for c in ORDER if c != "row_seq"))
    ends = old.groupBy(*CELL).agg(F.count(F.lit(1)).alias("had"), F.max(spot).alias("end"),
                                  F.count_if("stands").alias("left"))
    gains = (added.withColumn("spot", spot).join(ends.select(*CELL, "end"), CELL)
             .groupBy(*CELL).agg(F.count_if(F.col("spot") <= F.col("end")).alias("gained")))
    again = (ends.join(gains, CELL, "left")
             .filter((F.col("had") >= k) & (F.col("left") + F.coalesce("gained", F.lit(0)) < k)).select(*CELL))
    again.write.parquet(cells := _scratch(spark))
    again = spark.read.schema(again.schema).parquet(cells)
    kept = old.filter("stands").select(*CLEAN_COLUMNS, "evoc").unionByName(added.select(*CLEAN_COLUMNS, "evoc"))
    kept = kept.join(again, CELL, "left_anti")
    refilled = commented(merged.filter(of_parts)).join(again, CELL, "left_semi")
    top = first_of_cells(kept.unionByName(refilled.select(*CLEAN_COLUMNS, "evoc")), k)
    _write(top, spark.createDataFrame([(p,) for p in parts], "sprint_part string"), path, dynamic=True)
    return again


def _scratch(spark: SparkSession) -> str:
    from promoscope.session import scratch_path

    return scratch_path(spark, "topk-cells")


def top_verbatims(top: DataFrame, spec: FilterSpec | None = None, limit: int = K, k: int = K,
                  classified_only: bool = True, search_text: str | None = None) -> DataFrame:
    """``verbatims`` from the stored rows; selections by period, band and theme."""
    if limit > k:
        raise ValueError(f"the table has {k} comments a cell")
    if spec is not None and (spec.channels or spec.tenures):
        raise ValueError("cells are of sprint, band and theme: channels and tenures need the whole table")
    return verbatims(top, spec, limit, classified_only, search_text)
