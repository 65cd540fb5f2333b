"""Golden NPS statistics, computed from the published formulas."""

import pytest
from pyspark.sql import functions as F

from promoscope.functions.nps import with_nps, with_z_test

GOLDEN = [
    # promoters, passives, detractors, n, nps, lower, upper, confidence
    (0, 0, 0, 0, 0.0, 0.0, 0.0, "none"),
    (1, 0, 0, 1, 100.0, 100.0, 100.0, "low"),
    (100, 0, 0, 100, 100.0, 100.0, 100.0, "high"),
    (50, 20, 30, 100, 20.0, 2.9, 37.1, "low"),
    (500, 200, 300, 1000, 20.0, 14.6, 25.4, "high"),
    (3, 77, 4, 84, -1.2, -7.4, 5.0, "medium"),
    (1, 0, 2, 3, -33.3, -140.0, 73.4, "low"),
    (7, 1, 8, 16, -6.2, -53.5, 41.1, "low"),
]


@pytest.mark.parametrize("pro,pas,det,n,nps,lo,hi,conf", GOLDEN)
def test_nps_golden(spark, pro, pas, det, n, nps, lo, hi, conf):
    df = spark.createDataFrame([(n, pro, pas, det)], "n bigint, promoters bigint, passives bigint, detractors bigint")
    r = with_nps(df).first()
    assert (r.nps, r.ci_lower, r.ci_upper, r.confidence) == (nps, lo, hi, conf)


ZGOLDEN = [
    # before, after, delta, z, p, significant, interpretation prefix
    ((100, 50, 20, 30), (100, 60, 20, 20), 20.0, 1.69, 0.091, False, "NPS changed by 20 pts"),
    ((1000, 500, 200, 300), (1000, 600, 200, 200), 20.0, 5.35, 0.0, True, "NPS improved by 20 pts"),
    ((100, 50, 20, 30), (100, 50, 20, 30), 0.0, 0.0, 1.0, False, "NPS changed by 0 pts"),
    ((10, 10, 0, 0), (5, 5, 0, 0), 0.0, None, None, False, "No variance"),
    ((0, 0, 0, 0), (5, 5, 0, 0), 0.0, None, None, False, "Insufficient data"),
]


@pytest.mark.parametrize("before,after,delta,z,p,sig,text", ZGOLDEN)
def test_z_test_golden(spark, before, after, delta, z, p, sig, text):
    cols = ["n", "promoters", "passives", "detractors"]
    df = spark.createDataFrame([before + after],
                               ", ".join(f"b_{c} bigint" for c in cols) + ", " + ", ".join(f"{c} bigint" for c in cols))
    df = with_nps(df, "b_")
    df = with_nps(df, "")
    r = with_z_test(df, "b_", "").first()
    assert r.delta == delta
    assert r.z_score == z
    if p is None:
        assert r.p_value is None
    else:
        assert abs(r.p_value - p) < 0.0006
    assert r.significant is sig
    assert r.interpretation.startswith(text)


def test_js_rounding_ties_go_up(spark):
    from promoscope.functions.columns import js_round, js_round1

    r = spark.range(1).select(js_round(F.lit(-2.5)).alias("a"), js_round(F.lit(2.5)).alias("b"),
                              js_round1(F.lit(-0.25)).alias("c")).first()
    assert (r.a, r.b, r.c) == (-2.0, 3.0, -0.2)
