"""A7 theme statistics, A8 themes split by band, J3 + P18 theme changes.

All three aggregate the additive counts per (period, theme) first; the
remaining work (shares, full outer merge of period pairs, ranks) runs on frames
of at most #periods x #themes rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promoscope.functions.columns import js_round, js_round1
from promoscope.operators.ordering import GRAIN_KEY, period_kept, period_sort_keys
from promoscope.operators.dimensions import Dimensions, look_up
from promoscope.operators.rollup import as_counts
from promoscope.sources import dims


def _pct1(count: Column, total: Column) -> Column:
    """``Math.round(count / total * 1000) / 10`` (0 when total is 0)."""
    return F.when(total > 0, js_round(count / total * F.lit(1000)) / F.lit(10)).otherwise(F.lit(0.0))


def theme_stats(df: DataFrame, top_k: int | None = None, tables: Dimensions | None = None) -> DataFrame:
    """Per non-blank theme: count, mean score (1 dp), % of *all* responses; labels of ``tables`` if given."""
    c = as_counts(df)
    agg = c.groupBy("theme").agg(F.sum("n").cast("bigint").alias("count"),
                                 F.sum("score_sum").cast("bigint").alias("score_sum"))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    agg = agg.withColumn("_total", total).filter(F.col("theme") != "")
    w = Window.orderBy(F.col("count").desc(), F.col("theme"))
    label = dims.theme_label(F.col("theme"))
    if tables is not None and tables.theme_label is not None:
        agg = look_up(agg, F.col("theme"), tables.theme_label, "theme", {"_label": "label"})
        label = F.coalesce("_label", "theme")
    out = (agg.withColumn("avg_score", js_round1(F.col("score_sum") / F.col("count")))
              .withColumn("pct", _pct1(F.col("count"), F.col("_total")))
              .withColumn("label", label)
              .withColumn("rank", F.row_number().over(w))
              .select("theme", "label", "count", "avg_score", "pct", "rank"))
    return out if top_k is None else out.filter(F.col("rank") <= top_k)


def themes_by_band(df: DataFrame, top_k: int | None = 5) -> DataFrame:
    """Themes leaning promoter (positive list) or detractor (negative list).

    Share base = band members *with feedback*, themed or not (Q10); zero base
    counts as 1; ties (pro = det) go to the positive list.
    """
    c = as_counts(df)
    agg = c.groupBy("theme").agg(F.sum("promoters").cast("bigint").alias("pro"),
                                 F.sum("detractors").cast("bigint").alias("det"),
                                 F.sum("fb_promoters").cast("bigint").alias("pro_fb"),
                                 F.sum("fb_detractors").cast("bigint").alias("det_fb"))
    allw = Window.partitionBy(F.lit(1))
    agg = (agg.withColumn("_pro_base", F.sum("pro_fb").over(allw))
              .withColumn("_det_base", F.sum("det_fb").over(allw))
              .filter(F.col("theme") != ""))
    pro_base = F.when(F.col("_pro_base") > 0, F.col("_pro_base")).otherwise(F.lit(1))
    det_base = F.when(F.col("_det_base") > 0, F.col("_det_base")).otherwise(F.lit(1))
    pro, det = F.col("pro"), F.col("det")
    # the two lists are disjoint: pro >= det > ... excludes det > pro, and pro > 0 excludes pro = 0
    positive = (pro >= det) & (pro > 0)
    negative = (det > pro) | ((det > 0) & (pro == 0))
    side = F.when(positive, F.lit("positive")).when(negative, F.lit("negative"))
    out = agg.select(
        side.alias("side"), "theme",
        F.when(positive, pro).otherwise(det).alias("count"),
        F.when(positive, js_round(pro / pro_base * F.lit(100)))
         .otherwise(js_round(det / det_base * F.lit(100))).alias("pct"),
    ).filter(F.col("side").isNotNull())
    w = Window.partitionBy("side").orderBy(F.col("pct").desc(), F.col("count").desc(), F.col("theme"))
    out = (out.withColumn("label", dims.theme_label(F.col("theme")))
              .withColumn("side_rank", F.row_number().over(w)))
    return out if top_k is None else out.filter(F.col("side_rank") <= top_k)


def _status(count_prev: Column, count_curr: Column, delta: Column) -> Column:
    """P18."""
    return (F.when((count_prev == 0) & (count_curr > 0), F.lit("Emerging"))
            .when((count_prev > 0) & (count_curr == 0), F.lit("Resolved"))
            .when(F.abs(delta) > 2, F.when(delta > 0, F.lit("Growing")).otherwise(F.lit("Shrinking")))
            .otherwise(F.lit("Stable")))


def _changes(m: DataFrame, top_k: int | None) -> DataFrame:
    """P18 columns, labels and ranks of (prev_period, period, theme) rows with counts and shares."""
    m = m.withColumn("pct_delta", js_round1(F.col("pct_curr") - F.col("pct_prev")))
    rw = Window.partitionBy("period").orderBy(F.abs(F.col("pct_delta")).desc(), F.col("theme"))
    out = (m.withColumn("status", _status(F.col("count_prev"), F.col("count_curr"), F.col("pct_delta")))
            .withColumn("label", dims.theme_label(F.col("theme")))
            .withColumn("change_rank", F.row_number().over(rw)))
    return out if top_k is None else out.filter(F.col("change_rank") <= top_k)


_CHANGE_COLS = ["theme", "label", "count_prev", "count_curr", "pct_prev", "pct_curr", "pct_delta",
                "status", "change_rank"]


def theme_changes(df: DataFrame, grain: str = "quarter", top_k: int | None = 10) -> DataFrame:
    """J3 + P18 for every pair of consecutive periods at once.

    Per period: theme counts and % of the period's responses.  Each (period, theme) row is emitted
    twice - as the current side of the pair ending at its period and as the previous side of the pair
    ending at the next one - and one aggregation per (pair, theme) merges both sides: a full outer join
    (missing side = 0) without a self join.  The names of the neighbouring periods come from a range
    frame over the periods' order.
    """
    key = GRAIN_KEY[grain]
    c = as_counts(df).filter(period_kept(grain, F.col(key)))
    agg = c.groupBy(F.col(key).alias("period"), "theme").agg(F.sum("n").cast("bigint").alias("count"))
    ordw = Window.orderBy(*period_sort_keys(grain, F.col("period")))
    at = Window.orderBy("pord")
    x = (agg.withColumn("_total", F.sum("count").over(Window.partitionBy("period")))
            .withColumn("pord", F.dense_rank().over(ordw))
            .withColumn("_before", F.max("period").over(at.rangeBetween(-1, -1)))
            .withColumn("_after", F.max("period").over(at.rangeBetween(1, 1))))
    x = x.filter(F.col("theme") != "").withColumn("pct", _pct1(F.col("count"), F.col("_total")))
    # each row plays both roles; one explode keeps a single reference to x
    x = x.withColumn("_role", F.explode(F.array(F.lit("curr"), F.lit("prev"))))
    curr = F.col("_role") == "curr"
    both = x.select(
        F.when(curr, F.col("pord")).otherwise(F.col("pord") + 1).alias("period_ord"), "theme",
        F.when(curr, F.col("count")).alias("count_curr"), F.when(curr, F.col("pct")).alias("pct_curr"),
        F.when(~curr, F.col("count")).alias("count_prev"), F.when(~curr, F.col("pct")).alias("pct_prev"),
        F.when(curr, F.col("period")).otherwise(F.col("_after")).alias("period"),
        F.when(curr, F.col("_before")).otherwise(F.col("period")).alias("prev_period"))
    m = (both.filter(F.col("period").isNotNull() & F.col("prev_period").isNotNull())
         .groupBy("period_ord", "period", "prev_period", "theme")
         .agg(F.coalesce(F.max("count_prev"), F.lit(0).cast("bigint")).alias("count_prev"),
              F.coalesce(F.max("count_curr"), F.lit(0).cast("bigint")).alias("count_curr"),
              F.coalesce(F.max("pct_prev"), F.lit(0.0)).alias("pct_prev"),
              F.coalesce(F.max("pct_curr"), F.lit(0.0)).alias("pct_curr")))
    return _changes(m, top_k).select("prev_period", "period", F.col("period_ord").cast("int").alias("period_ord"),
                                     *_CHANGE_COLS)


def theme_changes_pair(df: DataFrame, prev_period: str, period: str, grain: str = "quarter",
                       top_k: int | None = 10) -> DataFrame:
    """J3 + P18 between any two chosen periods of a grain (a full outer merge on the theme).

    Both periods are filtered at the scan and aggregated in one pass; totals count all responses of a
    period, themed or not.
    """
    key = GRAIN_KEY[grain]
    c = as_counts(df).filter(F.col(key).isin(prev_period, period))
    if key == "sprint_id":
        c = c.filter(F.col("sprint_part").isin(*(p or "_blank" for p in (prev_period, period))))
    agg = c.groupBy("theme").agg(*[
        F.coalesce(F.sum(F.when(F.col(key) == p, F.col("n"))), F.lit(0)).cast("bigint").alias(f"count_{side}")
        for side, p in (("prev", prev_period), ("curr", period))])
    every = Window.partitionBy(F.lit(1))  # one row per theme
    for side in ("prev", "curr"):
        agg = agg.withColumn(f"pct_{side}", _pct1(F.col(f"count_{side}"), F.sum(f"count_{side}").over(every)))
    m = agg.filter((F.col("theme") != "") & (F.col("count_prev") + F.col("count_curr") > 0)).select(
        F.lit(prev_period).alias("prev_period"), F.lit(period).alias("period"), "*")
    return _changes(m, top_k).select("prev_period", "period", *_CHANGE_COLS)
