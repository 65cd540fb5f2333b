"""Additive counts: the unit-count view of a clean table and the NPS rollup (§4).

Every aggregate except verbatims is a sum of these counts, so analytics run
unchanged on the row-level clean table (unit counts per row) or on the
materialised rollup (pre-summed per dimension combination).  Because all
measures are additive, grouping is exact under partial (map-side)
aggregation and a hot key is collapsed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.functions.columns import utf16_len_gt

# dimensions kept by the rollup (all filter / group keys of the analytics)
ROLLUP_DIMS: list[str] = [
    "sprint_id", "month", "quarter", "source", "tenure_cut", "city", "plan_type",
    "first_time_user", "theme",
]

# additive measures
MEASURES: list[str] = [
    "n", "promoters", "passives", "detractors", "score_sum",
    "fb_n", "fb_promoters", "fb_passives", "fb_detractors",
]

ROLLUP_SCHEMA = T.StructType(
    [T.StructField(d, T.StringType(), True) for d in ROLLUP_DIMS]
    + [T.StructField(m, T.LongType(), True) for m in MEASURES]
    + [T.StructField("sprint_part", T.StringType(), True)])

FEEDBACK_MIN_LEN = 5  # "has feedback" = trimmed length > 5 (F7)


def has_feedback(comment: Column | str = "feedback", min_len: int = FEEDBACK_MIN_LEN) -> Column:
    """F7 of a trimmed comment."""
    return utf16_len_gt(comment, min_len)


def as_counts(df: DataFrame) -> DataFrame:
    """Unit counts for a row-level clean table; a rollup passes through."""
    if "n" in df.columns:
        return df
    s = F.col("score")
    fb = has_feedback()
    pro, pas, det = s >= 9, (s >= 7) & (s <= 8), s <= 6
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return df.select(
        *ROLLUP_DIMS, "sprint_part",
        one.alias("n"),
        F.when(pro, one).otherwise(zero).alias("promoters"),
        F.when(pas, one).otherwise(zero).alias("passives"),
        F.when(det, one).otherwise(zero).alias("detractors"),
        s.cast("bigint").alias("score_sum"),
        F.when(fb, one).otherwise(zero).alias("fb_n"),
        F.when(fb & pro, one).otherwise(zero).alias("fb_promoters"),
        F.when(fb & pas, one).otherwise(zero).alias("fb_passives"),
        F.when(fb & det, one).otherwise(zero).alias("fb_detractors"),
    )


def build_rollup(clean: DataFrame) -> DataFrame:
    """nps_rollup: measures summed per dimension combination (and sprint partition)."""
    return as_counts(clean).groupBy("sprint_part", *ROLLUP_DIMS).agg(
        *[F.sum(m).cast("bigint").alias(m) for m in MEASURES])
