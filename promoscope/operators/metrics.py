"""NPS metrics over a counts frame (row-level clean table or the rollup).

A1 overall, A2 by group, A3 trends, A4 band shares, A5/A6 comment rates,
A16/A17 dataset summary and members, A18 period health, W1 period deltas,
Z3 period-over-period significance, F2/W2 recent sprints, S12 sprint counts.

Every function aggregates first (one partial + final hash aggregation, map-side
combine, skew-safe because all measures are additive) and only then applies
windows / ordering to the small aggregated frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promoscope.functions.columns import JS_WHITESPACE_CLASS, js_number_str, js_round, js_round1
from promoscope.functions.nps import (count_aggs, direction, with_band_pcts, with_nps,
                                      with_z_test)
from promoscope.operators.dimensions import Dimensions, look_up
from promoscope.operators.filters import drop_unknown
from promoscope.operators.ordering import (GRAIN_KEY, period_kept, period_labels,
                                           period_sort_keys, sprint_sort_keys)
from promoscope.operators.rollup import as_counts
from promoscope.sources import dims

GRAINS = ("sprint", "month", "quarter")


def nps_overall(df: DataFrame) -> DataFrame:
    """A1: one row of NPS statistics (empty input -> zeros and 'none')."""
    agg = as_counts(df).agg(*count_aggs())
    return with_nps(agg)


def nps_by_group(df: DataFrame, key: str) -> DataFrame:
    """A2: NPS per member of ``key``; blank / 'Unknown' dropped; rank by n desc."""
    agg = as_counts(df).groupBy(F.col(key).alias("member")).agg(*count_aggs())
    agg = drop_unknown(agg, "member")
    w = Window.orderBy(F.col("n").desc(), F.col("member"))
    return with_nps(agg).withColumn("rank", F.row_number().over(w))


def nps_by_dimensions(df: DataFrame, keys: list[str]) -> DataFrame:
    """A2 for several dimensions in one pass (GROUPING SETS, one shuffle)."""
    c = as_counts(df)
    agg = c.groupingSets([[k] for k in keys], *keys).agg(
        *count_aggs(), F.grouping_id().alias("_gid"))
    n = len(keys)
    dim = F.lit(None).cast("string")
    member = F.lit(None).cast("string")
    for i, k in enumerate(keys):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))  # only key i grouped
        dim = F.when(F.col("_gid") == gid, F.lit(k)).otherwise(dim)
        member = F.when(F.col("_gid") == gid, F.col(k)).otherwise(member)
    out = agg.select(dim.alias("dimension"), member.alias("member"), *[F.col(x) for x in
                                                                       ["n", "promoters", "passives", "detractors"]])
    out = drop_unknown(out, "member")
    w = Window.partitionBy("dimension").orderBy(F.col("n").desc(), F.col("member"))
    return with_nps(out).withColumn("rank", F.row_number().over(w))


def _ordered(agg: DataFrame, grain: str) -> DataFrame:
    label, full = period_labels(grain, F.col("period"))
    w = Window.orderBy(*period_sort_keys(grain, F.col("period")))
    return (agg.withColumn("label", label).withColumn("full_label", full)
               .withColumn("period_ord", F.row_number().over(w)))


def trend(df: DataFrame, grain: str = "sprint", tables: Dimensions | None = None) -> DataFrame:
    """A3 (+P13, J2, T1): NPS per period in period order, by the calendar of ``tables`` if it has one."""
    key = GRAIN_KEY[grain]
    own = None if tables is None else tables.sprint_calendar if grain == "sprint" else tables.period_order(grain)
    counts = as_counts(df)
    if own is None:
        agg = counts.filter(period_kept(grain, F.col(key))).groupBy(F.col(key).alias("period")).agg(*count_aggs())
        return with_nps(_ordered(agg, grain))
    # one row per period meets the table
    agg = counts.filter(F.col(key) != "").groupBy(F.col(key).alias("period")).agg(*count_aggs())
    period = F.col("period")
    if grain == "sprint":
        agg = look_up(agg, period, own, "sprint_id", {"label": "short_label", "full_label": "full_label"})
        agg = agg.withColumns({c: F.coalesce(c, period) for c in ("label", "full_label")})
        return with_nps(agg.withColumn("period_ord", F.row_number().over(Window.orderBy(*period_sort_keys(grain, period)))))
    label, full = period_labels(grain, period)
    agg = look_up(agg, period, own, grain, {"_ord": "ord"}, "inner").withColumn("label", label).withColumn("full_label", full)
    return with_nps(agg.withColumn("period_ord", F.row_number().over(Window.orderBy("_ord", "period"))).drop("_ord"))


def trend_all_grains(df: DataFrame) -> DataFrame:
    """A3 for sprint, month and quarter in one pass (GROUPING SETS, one reference)."""
    c = as_counts(df)
    agg = c.groupingSets([["sprint_id"], ["month"], ["quarter"]], "sprint_id", "month", "quarter") \
           .agg(*count_aggs(), F.grouping_id().alias("_gid"))
    gid = F.col("_gid")
    grain = F.when(gid == 3, F.lit("sprint")).when(gid == 5, F.lit("month")).otherwise(F.lit("quarter"))
    period = (F.when(gid == 3, F.col("sprint_id")).when(gid == 5, F.col("month"))
              .otherwise(F.col("quarter")))
    g = agg.select(grain.alias("grain"), period.alias("period"), "n", "promoters", "passives", "detractors")
    p = F.col("period")
    kept = F.when(F.col("grain") == "sprint", period_kept("sprint", p)) \
            .when(F.col("grain") == "month", period_kept("month", p)).otherwise(period_kept("quarter", p))
    g = g.filter(kept)
    labels = {gr: period_labels(gr, p) for gr in GRAINS}
    keys = {gr: period_sort_keys(gr, p) for gr in GRAINS}

    def by_grain(pick) -> Column:
        return (F.when(F.col("grain") == "sprint", pick("sprint"))
                .when(F.col("grain") == "month", pick("month")).otherwise(pick("quarter")))

    g = (g.withColumn("label", by_grain(lambda gr: labels[gr][0]))
          .withColumn("full_label", by_grain(lambda gr: labels[gr][1]))
          .withColumn("_k1", by_grain(lambda gr: keys[gr][0].cast("double")))
          .withColumn("_k2", by_grain(lambda gr: (keys[gr][1] if len(keys[gr]) > 1 else F.lit(0)).cast("double"))))
    w = Window.partitionBy("grain").orderBy("_k1", "_k2", "period")
    return with_nps(g.withColumn("period_ord", F.row_number().over(w)).drop("_k1", "_k2"))


def band_distribution(df: DataFrame) -> DataFrame:
    """A4: band shares (integer %) per period for every grain."""
    t = trend_all_grains(df)
    return with_band_pcts(t).select("grain", "period", "period_ord", "label", "n",
                                    "promoter_pct", "passive_pct", "detractor_pct")


def period_delta(df: DataFrame) -> DataFrame:
    """W1 + P17: change of NPS against the previous period, every grain."""
    t = trend_all_grains(df)
    w = Window.partitionBy("grain").orderBy("period_ord")
    out = (t.withColumn("prev_period", F.lag("period").over(w))
            .withColumn("prev_nps", F.lag("nps").over(w)))
    delta = F.when(F.col("prev_nps").isNotNull(), js_round1(F.col("nps") - F.col("prev_nps")))
    return (out.withColumn("delta", delta)
               .withColumn("direction", direction(F.col("delta")))
               .select("grain", "period", "period_ord", "full_label", "n", "nps", "prev_period",
                       "prev_nps", "delta", "direction"))


def period_direction(df: DataFrame) -> DataFrame:
    """W1 + P17 for the latest period of every grain (the "latest change" card):
    latest vs previous period, rounded delta and its direction class."""
    d = period_delta(df)
    last = F.max("period_ord").over(Window.partitionBy("grain"))
    return (d.withColumn("_last", last).filter(F.col("period_ord") == F.col("_last"))
             .filter(F.col("prev_period").isNotNull())
             .select("grain", "period", "prev_period", "nps", "prev_nps", "delta", "direction"))


def period_significance(df: DataFrame, grain: str = "sprint") -> DataFrame:
    """Z3 + Z4 over every pair of consecutive periods."""
    t = trend(df, grain)
    w = Window.orderBy("period_ord")
    for c in ["period", "n", "promoters", "passives", "detractors", "nps"]:
        t = t.withColumn("prev_" + c, F.lag(c).over(w))
    t = t.filter(F.col("prev_period").isNotNull())
    out = with_z_test(t, before="prev_", after="")
    return out.select("period", "period_ord", "prev_period", "prev_n", "n", "prev_nps", "nps",
                      "delta", "z_score", "p_value", "significant", "interpretation")


def _health_level(nps: Column) -> Column:
    return (F.when(nps > 20, F.lit("strong"))
            .when(nps > 0, F.lit("slightly_positive"))
            .when(nps > -15, F.lit("negative"))
            .otherwise(F.lit("significant_dissatisfaction")))


def _health_text(nps: Column, pro_pct: Column, det_pct: Column, delta: Column) -> Column:
    s, change = js_number_str(nps), js_number_str(delta)
    first = (F.when(nps > 20, dims.sentence(dims.HEALTH_STRONG, s))
             .when(nps > 0, dims.sentence(dims.HEALTH_SLIGHT, s))
             .when(nps > -15, dims.sentence(dims.HEALTH_NEGATIVE, s))
             .otherwise(dims.sentence(dims.HEALTH_BAD, s)))
    second = dims.sentence(dims.HEALTH_BANDS, js_number_str(pro_pct), js_number_str(det_pct))
    third = (F.when(delta.isNull(), F.lit(None).cast("string"))
             .when(delta > 0, dims.sentence(dims.HEALTH_RISE, change))
             .when(delta < 0, dims.sentence(dims.HEALTH_DROP, change))
             .otherwise(dims.sentence(dims.HEALTH_FLAT)))
    return F.concat_ws(" ", first, second, third)


def period_health(df: DataFrame) -> DataFrame:
    """Health summary per sprint (as if that sprint closed the trend) and
    for the whole table ('All', using the latest sprint-over-sprint change).

    One pass: GROUPING SETS ((sprint_id), ()) gives the sprints and the total
    together; deltas and the latest delta are windows over that small frame.
    """
    c = as_counts(df)
    agg = c.groupingSets([["sprint_id"], []], "sprint_id").agg(
        *count_aggs(), F.grouping_id().alias("_gid"))
    is_all = F.col("_gid") == 1
    a = agg.filter(is_all | period_kept("sprint", F.col("sprint_id")))
    g, num = sprint_sort_keys(F.col("sprint_id"))
    side = Window.partitionBy("_gid").orderBy(g, num, F.col("sprint_id"))
    a = a.withColumn("period_ord", F.when(is_all, F.lit(0)).otherwise(F.row_number().over(side)))
    a = with_nps(a)
    prev = F.lag("nps").over(side)
    a = a.withColumn("delta", F.when(~is_all & prev.isNotNull(), js_round1(F.col("nps") - prev)))
    latest = F.max_by(F.when(~is_all, F.col("delta")), F.when(~is_all, F.col("period_ord"))).over(
        Window.partitionBy(F.lit(1)))
    a = a.withColumn("delta", F.when(is_all, latest).otherwise(F.col("delta")))
    u = a.select(F.when(is_all, F.lit("All")).otherwise(F.col("sprint_id")).alias("period"),
                 F.col("period_ord").cast("int").alias("period_ord"), "n", "promoters", "detractors",
                 "nps", "delta").filter(F.col("n") > 0)
    pro_pct = js_round(F.col("promoters") / F.col("n") * F.lit(100))
    det_pct = js_round(F.col("detractors") / F.col("n") * F.lit(100))
    return (u.withColumn("promoter_pct", pro_pct).withColumn("detractor_pct", det_pct)
             .withColumn("health_level", _health_level(F.col("nps")))
             .withColumn("change", F.when(F.col("delta") > 0, F.lit("rise"))
                         .when(F.col("delta") < 0, F.lit("drop"))
                         .when(F.col("delta") == 0, F.lit("flat")))
             .withColumn("summary", _health_text(F.col("nps"), F.col("promoter_pct"),
                                                 F.col("detractor_pct"), F.col("delta")))
             .select("period", "period_ord", "n", "nps", "promoter_pct", "detractor_pct",
                     "delta", "health_level", "change", "summary"))


def recent_sprints(df: DataFrame, k: int = 3) -> DataFrame:
    """The last ``k`` sprints in sprint order, with their NPS."""
    t = trend(df, "sprint")
    w = Window.orderBy(F.col("period_ord").desc())
    return (t.withColumn("recent_rank", F.row_number().over(w))
             .filter(F.col("recent_rank") <= k)
             .select(F.col("period").alias("sprint_id"), "recent_rank", "period_ord", "n", "nps",
                     "ci_lower", "ci_upper", "confidence"))


def recent_filter(df: DataFrame, k: int = 3, sprints_from: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``k`` sprints (the themes / verbatims default period).

    The join is on the partition column and its other side has ``k`` rows at most (hence the broadcast),
    so the scan prunes the other sprints' directories at run time.
    """
    src = df if sprints_from is None else sprints_from
    sprint = F.col("sprint_id")
    last = (recent_sprints(src, k).orderBy("recent_rank").limit(k)
            .select(F.when(sprint == "", F.lit("_blank")).otherwise(sprint).alias("_part")))
    return df.join(F.broadcast(last), df["sprint_part"] == last["_part"], "left_semi")


def feedback_rate(df: DataFrame) -> DataFrame:
    """A5: share of responses with a comment longer than 5 characters."""
    c = as_counts(df)
    agg = c.agg(F.sum("n").cast("bigint").alias("n"), F.sum("fb_n").cast("bigint").alias("with_feedback"))
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    fb = F.coalesce(F.col("with_feedback"), F.lit(0).cast("bigint"))
    return agg.select(n.alias("n"), fb.alias("with_feedback"),
                      F.when(n > 0, js_round(fb / n * F.lit(100))).otherwise(F.lit(0.0))
                      .alias("feedback_pct"))


def comment_rates(df: DataFrame) -> DataFrame:
    """Comment counts and rates overall and per band."""
    c = as_counts(df)
    sums = ["n", "fb_n", "promoters", "fb_promoters", "detractors", "fb_detractors",
            "passives", "fb_passives"]
    agg = c.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(x) for x in sums])

    def pct(num: str, den: str) -> Column:
        return F.when(F.col(den) > 0, js_round(F.col(num) / F.col(den) * F.lit(100))).otherwise(F.lit(0.0))

    return agg.select(
        F.col("n").alias("total"), F.col("fb_n").alias("with_feedback"),
        pct("fb_n", "n").alias("feedback_pct"),
        F.col("promoters").alias("promoter_count"), F.col("fb_promoters").alias("promoter_fb"),
        pct("fb_promoters", "promoters").alias("promoter_fb_pct"),
        F.col("detractors").alias("detractor_count"), F.col("fb_detractors").alias("detractor_fb"),
        pct("fb_detractors", "detractors").alias("detractor_fb_pct"),
        F.col("passives").alias("passive_count"), F.col("fb_passives").alias("passive_fb"),
        pct("fb_passives", "passives").alias("passive_fb_pct"),
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """Responses, distinct non-blank sprints and sources."""
    c = as_counts(df)
    return c.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("responses"),
        F.count_distinct(F.when(F.col("sprint_id") != "", F.col("sprint_id"))).cast("bigint").alias("sprints"),
        F.count_distinct(F.when(F.col("source") != "", F.col("source"))).cast("bigint").alias("sources"),
    )


_MEMBER_DIMS = ["sprint_id", "source", "theme", "month", "quarter", "tenure_cut"]


def dim_members(df: DataFrame) -> DataFrame:
    """Sorted distinct members of the selectable dimensions.

    sprint (T1 order), source (sorted), theme (non-blank, sorted), channel
    (the default channels first, then the others sorted), month / quarter /
    tenure (fixed order, only members present).  One GROUPING SETS pass; the
    channel list is the source list emitted twice.
    """
    c = as_counts(df)
    keys = _MEMBER_DIMS
    agg = c.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("_gid"))
    gid = F.col("_gid")
    nk = len(keys)
    names = {"sprint_id": ["sprint"], "source": ["source", "channel"], "theme": ["theme"],
             "month": ["month"], "quarter": ["quarter"], "tenure_cut": ["tenure"]}
    dim = F.lit(None)
    member = F.lit(None).cast("string")
    for i, k in enumerate(keys):
        g = (1 << nk) - 1 - (1 << (nk - 1 - i))
        dim = F.when(gid == g, F.array(*[F.lit(x) for x in names[k]])).otherwise(dim)
        member = F.when(gid == g, F.col(k)).otherwise(member)
    u = agg.select(F.explode(dim).alias("dimension"), member.alias("member")).filter(F.col("member") != "")
    m = F.col("member")
    fixed = {"month": dims.MONTH_ORDER, "quarter": dims.QUARTER_ORDER, "tenure": dims.TENURE_ORDER}
    fixed_pos = None
    for d, order in fixed.items():
        pos = dims.order_index(order, m)
        fixed_pos = F.when(F.col("dimension") == d, pos) if fixed_pos is None else \
            fixed_pos.when(F.col("dimension") == d, pos)
    u = u.withColumn("_fixed", fixed_pos)
    u = u.filter(~F.col("dimension").isin(*fixed) | F.col("_fixed").isNotNull())
    g, num = sprint_sort_keys(m)
    chan_pos = dims.order_index(dims.DEFAULT_CHANNELS, m)
    is_sprint, is_chan = F.col("dimension") == "sprint", F.col("dimension") == "channel"
    k1 = (F.when(is_sprint, g.cast("double"))
           .when(is_chan, F.when(chan_pos.isNotNull(), F.lit(0.0)).otherwise(F.lit(1.0)))
           .when(F.col("_fixed").isNotNull(), F.col("_fixed").cast("double"))
           .otherwise(F.lit(0.0)))
    k2 = (F.when(is_sprint, num.cast("double"))
           .when(is_chan, F.coalesce(chan_pos.cast("double"), F.lit(0.0)))
           .otherwise(F.lit(0.0)))
    w = Window.partitionBy("dimension").orderBy(k1, k2, m)
    return u.withColumn("member_ord", F.row_number().over(w)).drop("_fixed")


def comment_rates_recent(df: DataFrame, k: int = 3) -> DataFrame:
    """A6 over the last ``k`` sprints in one pass: per-sprint sums, then the
    sprint ranks and the final sum run on the (#sprints-row) aggregate."""
    c = as_counts(df).filter(F.col("sprint_id") != "")
    sums = ["n", "fb_n", "promoters", "fb_promoters", "detractors", "fb_detractors",
            "passives", "fb_passives"]
    per = c.groupBy("sprint_id").agg(*[F.sum(x).cast("bigint").alias(x) for x in sums])
    g, num = sprint_sort_keys(F.col("sprint_id"))
    per = per.withColumn("_r", F.row_number().over(Window.orderBy(g.desc(), num.desc(), F.col("sprint_id").desc())))
    return comment_rates(per.filter(F.col("_r") <= k).drop("_r"))


def sprint_counts(df: DataFrame) -> DataFrame:
    """Response count per normalised sprint key (lower case, spaces -> '_')."""
    c = as_counts(df)
    key = F.regexp_replace(F.lower(F.col("sprint_id")), JS_WHITESPACE_CLASS + "+", "_")
    return c.groupBy(key.alias("sprint_key")).agg(F.sum("n").cast("bigint").alias("responses"))
