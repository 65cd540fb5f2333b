"""T3 verbatim ranking, F8 search, W3 grouping by theme, T8 paging.

The ranking is a global top-k (``orderBy(...).limit(k)``), planned as
``TakeOrderedAndProject``: every task keeps its own k best rows and only
k x #tasks rows reach the final merge, so long comment texts never shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promoscope.functions.columns import utf16_len_capped, utf16_len_gt
from promoscope.operators.filters import FilterSpec, apply_filters
from promoscope.sources import dims

PAGE_SIZE = 30
GROUP_SHOW = 8

VERBATIM_COLS = ["rank", "row_seq", "respondent_id", "sprint_id", "score", "score_band", "theme",
                 "evoc_score", "feedback"]


def evoc_score():
    """``min(len, 300) + 20 * |score - 5|`` (UTF-16 length)."""
    return utf16_len_capped(F.col("feedback"), 300) + F.abs(F.col("score") - 5) * 20


def verbatims(df: DataFrame, spec: FilterSpec | None = None, limit: int = 100,
              classified_only: bool = True, search_text: str | None = None,
              search_before_limit: bool = False) -> DataFrame:
    """The ``limit`` most evocative comments (> 5 characters).

    ``classified_only`` keeps rows with a non-blank theme; the theme
    'unclassified' is non-blank and stays (Q8).  Ties break on ``row_seq``.
    ``search_text`` (F8) filters after the limit, as the dashboard does (Q20),
    or before it with ``search_before_limit=True``.
    """
    base = df
    if classified_only:
        base = base.filter(F.col("theme") != "")
    if spec is not None:
        base = apply_filters(base, spec, df)
    base = base.filter(utf16_len_gt(F.col("feedback"), 5)).withColumn("evoc_score", evoc_score())
    if search_text and search_before_limit:
        base = search(base, search_text)
    top = base.orderBy(F.col("evoc_score").desc(), F.col("row_seq")).limit(limit)
    w = Window.orderBy(F.col("evoc_score").desc(), F.col("row_seq"))
    out = top.withColumn("rank", F.row_number().over(w)).select(*VERBATIM_COLS)
    out = out.withColumn("page", ((F.col("rank") - 1) / PAGE_SIZE).cast("int") + 1)
    if search_text and not search_before_limit:
        out = search(out, search_text)
    return out


def search(top: DataFrame, text: str) -> DataFrame:
    """F8: case-insensitive substring search on the comment text."""
    needle = text.strip().lower()
    if not needle:
        return top
    return top.filter(F.lower(F.col("feedback")).contains(needle))


def grouped(top: DataFrame, show: int = GROUP_SHOW) -> DataFrame:
    """The ranked list grouped by theme: group size desc, ``show`` per group,
    and the number of further comments in the group (windows over the <= limit
    ranked rows; the ranked list is computed once)."""
    gw = Window.partitionBy("theme")
    iw = Window.partitionBy("theme").orderBy("rank")
    g = (top.withColumn("group_size", F.count(F.lit(1)).over(gw))
            .withColumn("_first", F.min("rank").over(gw))
            .withColumn("item_rank", F.row_number().over(iw)))
    ow = Window.orderBy(F.col("group_size").desc(), F.col("_first"))
    g = g.withColumn("group_rank", F.dense_rank().over(ow))
    out = g.filter(F.col("item_rank") <= show)
    return out.select(
        "theme", dims.theme_label(F.col("theme")).alias("label"), "group_rank", "group_size",
        F.greatest(F.col("group_size") - F.lit(show), F.lit(0)).cast("bigint").alias("more_in_group"),
        "item_rank", "rank", "row_seq", "respondent_id", "score", "feedback")
