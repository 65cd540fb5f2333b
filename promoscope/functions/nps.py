"""NPS statistics as Column expressions over additive counts.

Every NPS result is a function of four additive counts
(``n, promoters, passives, detractors``), so partial/final hash aggregation,
roll-ups and incremental merges are exact.  The helpers here turn those counts
into the published statistics:

* Z1: NPS (one decimal), multinomial variance, standard error, 95% interval
* Z2: confidence class
* Z3: two-sample z-test on NPS differences
* Z4: erf (Abramowitz-Stegun 7.1.26); Spark has no built-in erf
* A4: band shares, P15 sentiment class, P17 direction class
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoscope.functions.columns import js_number_str, js_round, js_round1, js_round_to
from promoscope.sources import dims

COUNT_COLS = ["n", "promoters", "passives", "detractors"]

Z95 = 1.96
SQRT2 = math.sqrt(2.0)

# FIXED VALUES: Abramowitz & Stegun 7.1.26 coefficients.
ERF_A1 = 0.254829592
ERF_A2 = -0.284496736
ERF_A3 = 1.421413741
ERF_A4 = -1.453152027
ERF_A5 = 1.061405429
ERF_P = 0.3275911


def score_band(score: Column) -> Column:
    return (F.when(score >= 9, F.lit("promoter"))
            .when(score >= 7, F.lit("passive"))
            .otherwise(F.lit("detractor")))


def count_aggs(prefix: str = "", cond: str | None = None) -> list[Column]:
    """Sum the unit count columns (optionally only where the SQL predicate ``cond`` holds).

    Built as SQL expressions: one JVM call per aggregate instead of one per
    Column operator.
    """
    out = []
    for c in COUNT_COLS:
        v = f"`{c}`" if cond is None else f"CASE WHEN {cond} THEN `{c}` ELSE 0 END"
        out.append(F.expr(f"CAST(COALESCE(SUM({v}), 0) AS BIGINT)").alias(prefix + c))
    return out


def _c(prefix: str, name: str) -> Column:
    return F.col(prefix + name)


def _share(num: Column, n: Column) -> Column:
    return F.when(n > 0, num / n).otherwise(F.lit(0.0))


def nps_value(prefix: str = "") -> Column:
    n = _c(prefix, "n")
    p_pro = _share(_c(prefix, "promoters"), n)
    p_det = _share(_c(prefix, "detractors"), n)
    return F.when(n > 0, js_round((p_pro - p_det) * F.lit(1000)) / F.lit(10)).otherwise(F.lit(0.0))


def nps_variance(prefix: str = "") -> Column:
    n = _c(prefix, "n")
    p_pro = _share(_c(prefix, "promoters"), n)
    p_det = _share(_c(prefix, "detractors"), n)
    var = (p_pro * (F.lit(1) - p_pro) + p_det * (F.lit(1) - p_det) + F.lit(2) * p_pro * p_det)
    return F.when(n > 0, var / n).otherwise(F.lit(0.0))


def _sql_stats(prefix: str) -> dict[str, str]:
    """Spark SQL text of Z1 / Z2 over prefixed counts (same operation order as the
    Column helpers above: ``floor(x + 0.5)`` rounding, guarded ratios)."""
    n, pro, det = f"`{prefix}n`", f"`{prefix}promoters`", f"`{prefix}detractors`"
    pp = f"(CASE WHEN {n} > 0 THEN {pro} / {n} ELSE 0.0D END)"
    pd = f"(CASE WHEN {n} > 0 THEN {det} / {n} ELSE 0.0D END)"
    nps = f"(CASE WHEN {n} > 0 THEN CAST(FLOOR(({pp} - {pd}) * 1000 + 0.5D) AS DOUBLE) / 10 ELSE 0.0D END)"
    var = f"(CASE WHEN {n} > 0 THEN ({pp} * (1 - {pp}) + {pd} * (1 - {pd}) + 2 * {pp} * {pd}) / {n} ELSE 0.0D END)"
    se = f"(SQRT({var}) * 100)"
    lower = f"(CASE WHEN {n} > 0 THEN CAST(FLOOR(({nps} - {Z95!r}D * {se}) * 10 + 0.5D) AS DOUBLE) / 10 ELSE 0.0D END)"
    upper = f"(CASE WHEN {n} > 0 THEN CAST(FLOOR(({nps} + {Z95!r}D * {se}) * 10 + 0.5D) AS DOUBLE) / 10 ELSE 0.0D END)"
    width = f"({upper} - {lower})"
    conf = (f"CASE WHEN {n} = 0 THEN 'none' WHEN {n} >= 100 AND {width} < 15 THEN 'high' "
            f"WHEN {n} >= 30 AND {width} < 25 THEN 'medium' ELSE 'low' END")
    return {"nps": nps, "ci_lower": lower, "ci_upper": upper, "confidence": conf}


def nps_stats(prefix: str = "") -> dict[str, Column]:
    """nps, ci_lower, ci_upper, confidence as independent expressions of the counts
    (shared sub-expressions are computed once by subexpression elimination)."""
    return {k: F.expr(v) for k, v in _sql_stats(prefix).items()}


def with_nps(df: DataFrame, prefix: str = "", out_prefix: str | None = None) -> DataFrame:
    """Add nps, ci_lower, ci_upper, confidence computed from prefixed counts."""
    op = prefix if out_prefix is None else out_prefix
    return df.withColumns({op + k: v for k, v in nps_stats(prefix).items()})


def band_pct(num: Column, n: Column) -> Column:
    """``n > 0 ? Math.round(num / n * 100) : 0`` as DOUBLE."""
    return F.when(n > 0, js_round(num / n * F.lit(100))).otherwise(F.lit(0.0))


def with_band_pcts(df: DataFrame, prefix: str = "") -> DataFrame:
    n = _c(prefix, "n")
    return df.withColumns({prefix + "promoter_pct": band_pct(_c(prefix, "promoters"), n),
                           prefix + "passive_pct": band_pct(_c(prefix, "passives"), n),
                           prefix + "detractor_pct": band_pct(_c(prefix, "detractors"), n)})


def sentiment(nps: Column) -> Column:
    """>5 positive, < -5 negative, else neutral."""
    return (F.when(nps > 5, F.lit("positive"))
            .when(nps < -5, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def direction(delta: Column) -> Column:
    """>2 improving, < -2 declining, else stable (NULL stays NULL)."""
    return (F.when(delta.isNull(), F.lit(None).cast("string"))
            .when(delta > 2, F.lit("improving"))
            .when(delta < -2, F.lit("declining"))
            .otherwise(F.lit("stable")))


def suppress(value: Column, n: Column, min_n: int = 5) -> Column:
    """Hide a value computed from fewer than ``min_n`` responses."""
    return F.when(n >= min_n, value)


def erf(x: Column) -> Column:
    """erf(x) by the Abramowitz-Stegun 7.1.26 polynomial."""
    sign = F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    t = F.lit(1) / (F.lit(1) + F.lit(ERF_P) * F.abs(x))
    poly = ((((F.lit(ERF_A5) * t + F.lit(ERF_A4)) * t + F.lit(ERF_A3)) * t + F.lit(ERF_A2)) * t
            + F.lit(ERF_A1))
    y = F.lit(1) - poly * t * F.exp(-x * x)
    return sign * y


def with_z_test(df: DataFrame, before: str, after: str) -> DataFrame:
    """Z3: z-test of NPS(after) - NPS(before) from prefixed counts and nps columns.

    Adds delta, z_score (2 dp), p_value (4 dp), significant, interpretation.
    """
    n1, n2 = _c(before, "n"), _c(after, "n")
    insufficient = (n1 == 0) | (n2 == 0)
    df = df.withColumns({
        "_delta": js_round1(_c(after, "nps") - _c(before, "nps")),
        "_se": F.sqrt(nps_variance(before) + nps_variance(after)) * F.lit(100),
    })
    no_var = F.col("_se") == 0
    ok = ~insufficient & ~no_var
    z = F.abs(F.col("_delta")) / F.col("_se")
    p = F.lit(2) * (F.lit(1) - F.lit(0.5) * (F.lit(1) + erf(z / F.lit(SQRT2))))
    df = df.withColumns({"_z": F.when(ok, z), "_p": F.when(ok, p)})
    sig = F.coalesce(F.col("_p") < 0.05, F.lit(False))
    p_txt = F.format_string("%.3f", F.col("_p"))
    size = js_number_str(F.abs(F.col("_delta")))
    interp = (F.when(insufficient, F.lit(dims.TEST_NO_DATA))
              .when(no_var, F.lit(dims.TEST_NO_VARIANCE))
              .when(sig & (F.col("_delta") > 0), dims.sentence(dims.TEST_IMPROVED, size, p_txt))
              .when(sig, dims.sentence(dims.TEST_DECLINED, size, p_txt))
              .otherwise(dims.sentence(dims.TEST_CHANGED, js_number_str(F.col("_delta")), p_txt)))
    return df.withColumns({
        "delta": F.when(insufficient, F.lit(0.0)).otherwise(F.col("_delta")),
        "z_score": js_round_to(F.col("_z"), 2),
        "p_value": js_round_to(F.col("_p"), 4),
        "significant": sig,
        "interpretation": interp,
    }).drop("_delta", "_se", "_z", "_p")
