"""First-time versus repeat users; T4 cohort verbatims.

The cohort split is a conditional aggregation (``sum(when(first_time_user = 'Yes'))``
and ``... = 'No'``) inside one ``groupBy``, i.e. a pivot without a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promoscope.functions.columns import js_round, js_round1, utf16_len_gt
from promoscope.functions.nps import count_aggs, suppress, with_nps, with_z_test
from promoscope.operators.filters import apply_period
from promoscope.operators.ordering import (GRAIN_KEY, member_sort_keys, period_kept, period_sort_keys,
                                           sprint_sort_keys)
from promoscope.operators.rollup import as_counts
from promoscope.sources import dims



def _yes() -> Column:
    return F.col("first_time_user") == "Yes"


def _no() -> Column:
    return F.col("first_time_user") == "No"


def known_cohort(df: DataFrame) -> DataFrame:
    """rows with a known first-time flag."""
    return df.filter(F.col("first_time_user").isin("Yes", "No"))


YES_SQL, NO_SQL = "first_time_user = 'Yes'", "first_time_user = 'No'"


def _split_aggs() -> list[Column]:
    return count_aggs("ft_", YES_SQL) + count_aggs("rep_", NO_SQL)


def _with_split_stats(df: DataFrame, min_n: int | None = None) -> DataFrame:
    df = with_nps(with_nps(df, "ft_"), "rep_")
    if min_n is not None:
        both = (F.col("ft_n") >= min_n) & (F.col("rep_n") >= min_n)
        df = df.withColumn("nps_delta", F.when(both, js_round1(F.col("ft_nps") - F.col("rep_nps"))))
    return df


def cohort_kpis(df: DataFrame, grain: str = "sprint", period: str | None = None) -> DataFrame:
    """NPS of all known / first-time / repeat responses and the difference."""
    c = apply_period(known_cohort(as_counts(df)), grain, period)
    agg = c.agg(*count_aggs("all_"), *_split_aggs())
    out = with_nps(with_nps(with_nps(agg, "all_"), "ft_"), "rep_")
    return out.withColumn("nps_delta", js_round1(F.col("ft_nps") - F.col("rep_nps"))).select(
        *[f"{p}{m}" for p in ("all_", "ft_", "rep_")
          for m in ("n", "promoters", "passives", "detractors", "nps", "ci_lower", "ci_upper", "confidence")],
        "nps_delta")


def cohort_trend(df: DataFrame, grain: str = "sprint", min_n: int = dims.MIN_N) -> DataFrame:
    """First-time vs repeat NPS per period (n < min_n -> NULL)."""
    key = GRAIN_KEY[grain]
    c = known_cohort(as_counts(df)).filter(period_kept(grain, F.col(key)))
    agg = c.groupBy(F.col(key).alias("period")).agg(*_split_aggs())
    w = Window.orderBy(*period_sort_keys(grain, F.col("period")))
    out = with_nps(with_nps(agg, "ft_"), "rep_").withColumn("period_ord", F.row_number().over(w))
    return out.select("period", "period_ord", "ft_n", suppress(F.col("ft_nps"), F.col("ft_n"), min_n).alias("ft_nps"),
                      "rep_n", suppress(F.col("rep_nps"), F.col("rep_n"), min_n).alias("rep_nps"))


def cohort_by(df: DataFrame, dim: str, grain: str = "sprint", period: str | None = None,
              min_n: int = dims.MIN_N) -> DataFrame:
    """A13 (tenure) and the general per-member first-time / repeat split."""
    c = apply_period(known_cohort(as_counts(df)), grain, period)
    agg = c.groupBy(F.col(dim).alias("member")).agg(*_split_aggs())
    if dim == "tenure_cut":
        agg = agg.filter(F.col("member").isin(*dims.TENURE_ORDER))
    out = _with_split_stats(agg, min_n)
    w = Window.orderBy(*member_sort_keys(dim, F.col("member")), F.col("member"))
    return out.withColumn("member_ord", F.row_number().over(w)).select(
        "member", "member_ord", "ft_n", "ft_nps", "ft_confidence", "rep_n", "rep_nps",
        "rep_confidence", "nps_delta")


def cohort_city(df: DataFrame, grain: str = "sprint", period: str | None = None,
                min_total: int = 10, top_k: int = 8, min_n: int = dims.MIN_N) -> DataFrame:
    """Cities with >= min_total known responses, top_k by total."""
    c = apply_period(known_cohort(as_counts(df)), grain, period).filter(F.col("city") != "")
    agg = c.groupBy("city").agg(*_split_aggs())
    out = _with_split_stats(agg, min_n).withColumn("total", F.col("ft_n") + F.col("rep_n"))
    out = out.filter(F.col("total") >= min_total)
    w = Window.orderBy(F.col("total").desc(), F.col("city"))
    return (out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
               .select("city", "rank", "total", "ft_n", "ft_nps", "rep_n", "rep_nps", "nps_delta"))


def cohort_theme(df: DataFrame, grain: str = "sprint", period: str | None = None,
                 min_total: int = 3, top_k: int = 8) -> DataFrame:
    """Share of each cohort mentioning a theme (per-cohort denominators)."""
    c = apply_period(known_cohort(as_counts(df)), grain, period)
    agg = c.groupBy("theme").agg(
        F.sum(F.when(_yes(), F.col("n")).otherwise(0)).cast("bigint").alias("ft_count"),
        F.sum(F.when(_no(), F.col("n")).otherwise(0)).cast("bigint").alias("rep_count"))
    allw = Window.partitionBy(F.lit(1))
    agg = (agg.withColumn("_ft_total", F.sum("ft_count").over(allw))
              .withColumn("_rep_total", F.sum("rep_count").over(allw))
              .filter(F.col("theme") != ""))

    def share(cnt: str, tot: str) -> Column:
        return F.when(F.col(tot) > 0, js_round(F.col(cnt) / F.col(tot) * F.lit(100))).otherwise(F.lit(0.0))

    out = (agg.withColumn("ft_pct", share("ft_count", "_ft_total"))
              .withColumn("rep_pct", share("rep_count", "_rep_total"))
              .withColumn("total", F.col("ft_count") + F.col("rep_count"))
              .filter(F.col("total") >= min_total))
    w = Window.orderBy(F.col("total").desc(), F.col("theme"))
    return (out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
               .withColumn("label", dims.theme_label(F.col("theme")))
               .select("theme", "label", "rank", "total", "ft_count", "rep_count", "ft_pct", "rep_pct"))


def cohort_verbatims(df: DataFrame, grain: str = "sprint", period: str | None = None,
                     k: int = 8, min_len: int = 10) -> DataFrame:
    """T4: per cohort, the k comments (> min_len chars) furthest from a neutral 5.

    The ``rank <= k`` filter sits directly on ``row_number()`` so Spark plans a
    partial WindowGroupLimit before the shuffle: at most k rows per cohort per
    input partition move.
    """
    c = apply_period(known_cohort(df), grain, period).filter(utf16_len_gt(F.col("feedback"), min_len))
    w = Window.partitionBy("first_time_user").orderBy(F.abs(F.col("score") - 5).desc(), F.col("row_seq"))
    out = c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select(F.when(_yes(), F.lit("first_time")).otherwise(F.lit("repeat")).alias("cohort"),
                      "rank", "row_seq", "respondent_id", "sprint_id", "score", "score_band", "theme",
                      "feedback")


def cohort_significance(df: DataFrame) -> DataFrame:
    """Z3 on a segment pair: first-time minus repeat NPS, per sprint and overall.

    One GROUPING SETS ((sprint_id), ()) pass with the cohort split as
    conditional sums; the test runs on the (#sprints + 1)-row result.
    """
    c = known_cohort(as_counts(df))
    agg = c.groupingSets([["sprint_id"], []], "sprint_id").agg(*_split_aggs(), F.grouping_id().alias("_gid"))
    is_all = F.col("_gid") == 1
    a = agg.filter(is_all | (F.col("sprint_id") != ""))
    g, num = sprint_sort_keys(F.col("sprint_id"))
    w = Window.partitionBy("_gid").orderBy(g, num, F.col("sprint_id"))
    a = a.withColumns({
        "period": F.when(is_all, F.lit("All")).otherwise(F.col("sprint_id")),
        "period_ord": F.when(is_all, F.lit(0)).otherwise(F.row_number().over(w)).cast("int")})
    a = with_z_test(with_nps(with_nps(a, "ft_"), "rep_"), before="rep_", after="ft_")
    return a.select("period", "period_ord", "rep_n", "ft_n", "rep_nps", "ft_nps", "delta", "z_score",
                    "p_value", "significant", "interpretation")
