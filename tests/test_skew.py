"""A third of all rows on one key: results stay exact and whole."""

from pyspark.sql import functions as F

from promoscope.operators import matrix, metrics
from promoscope.operators.upsert import latest_per_key


def skewed(spark, n=30000):
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.when(hot, F.lit("Sprint 3")).otherwise(F.concat(F.lit("Sprint "), (F.col("id") % 14 + 1).cast("string")))
         .alias("sprint_id"),
        F.when(hot, F.lit("")).otherwise(F.col("id").cast("string")).alias("respondent_id"),
        F.lit(0).cast("bigint").alias("ingest_batch"), F.lit(0).cast("bigint").alias("file_order"),
        F.lit("f").alias("src_file"), F.col("id").alias("row_seq"),
        (F.col("id") % 11).cast("int").alias("score"),
        F.when(hot, F.lit("HotCity")).otherwise(F.concat(F.lit("C"), (F.col("id") % 20).cast("string"))).alias("city"),
        F.lit("Mid (3-6 mo)").alias("tenure_cut"), F.lit("Call").alias("source"), F.lit("").alias("theme"),
        F.lit("").alias("month"), F.lit("").alias("quarter"), F.lit("").alias("plan_type"),
        F.lit("Yes").alias("first_time_user"), F.lit("").alias("feedback"), F.lit("x").alias("sprint_part"))


def test_hot_key_upsert_is_exact(spark):
    df = skewed(spark)
    out = latest_per_key(df)
    hot = out.filter((F.col("sprint_id") == "Sprint 3") & (F.col("respondent_id") == ""))
    rows = hot.collect()
    assert len(rows) == 1 and rows[0].row_seq == 29997          # the last hot row wins
    assert out.count() == 1 + 20000                               # every other key kept


def test_hot_city_matrix_totals_whole(spark):
    df = skewed(spark)
    m = matrix.nps_matrix(df, "city", "sprint_id", city_cap=None)
    hot_total = m.filter((F.col("cell_type") == "row_total") & (F.col("row_member") == "HotCity")).first()
    assert hot_total.n == 10000
    grand = m.filter(F.col("cell_type") == "grand_total").first()
    assert grand.n == 30000 and grand.promoters + grand.passives + grand.detractors == 30000


def test_city_rank_by_count(spark):
    df = skewed(spark)
    top = matrix.row_summary(df, "city", city_cap=1, city_rank="count").collect()
    assert [r.row_member for r in top] == ["HotCity"]
    alpha = matrix.row_summary(df, "city", city_cap=1).collect()
    assert [r.row_member for r in alpha] == ["C0"]


def test_trend_with_hot_period(spark):
    t = {r.period: r.n for r in metrics.trend(skewed(spark), "sprint").collect()}
    assert sum(t.values()) == 30000 and t["Sprint 3"] > 10000
