"""Two-dimension NPS matrix with row, column and grand totals.

One pass: ``GROUPING SETS ((r, c), (r), (c), ())`` over the (filtered) counts,
so the matrix costs one scan and one shuffle of at most
(#distinct combinations x #partitions) partial rows, instead of one scan per
cell.  Totals are aggregated before blank / 'Unknown' members are dropped
(Q12), members are ordered per T2 and city axes are capped (T5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promoscope.functions.nps import count_aggs, sentiment, suppress, with_band_pcts, with_nps
from promoscope.operators.filters import FilterSpec, apply_filters
from promoscope.operators.ordering import member_kept, member_sort_keys
from promoscope.operators.rollup import as_counts
from promoscope.sources import dims

CITY_CAP = 12


def _kept(dim: str, member: Column) -> Column:
    """Non-blank, not 'Unknown', and inside the fixed order for ordered dimensions."""
    return member.isNotNull() & ~member.isin("", "Unknown") & member_kept(dim, member)


def _sort_pair(dim: str, member: Column) -> tuple[Column, Column]:
    """T2 as a number and a text, so that the members of both axes can be ranked by one window."""
    keys = member_sort_keys(dim, member)
    number = F.lit(0) if len(keys) == 1 and dim not in ("month", "quarter", "tenure_cut") else keys[0].cast("int")
    return number, member


def _ordinals(a: DataFrame, row_dim: str, col_dim: str, city_cap: int | None, city_rank: str) -> DataFrame:
    """``row_ord`` and ``col_ord``, the display positions of the members (T2), with the city cap (T5).

    The total rows of each axis (one per member) are ranked together, both axes by one window; all other
    rows are spread over partitions of their own by a hash, where the rank means nothing.  Then each
    member's rows get the position of its total row.
    """
    gid, r, k = F.col("_gid"), F.col(row_dim), F.col(col_dim)
    apart = F.when(gid == 1, F.lit(-1)).when(gid == 2, F.lit(-2)).otherwise(
        F.pmod(F.hash("_gid", r, k), F.lit(1 << 20)))
    (rn, rt), (cn, ct) = _sort_pair(row_dim, r), _sort_pair(col_dim, k)
    of_axis = lambda x, y: F.when(gid == 1, x).when(gid == 2, y)
    axis = Window.partitionBy(apart)
    a = a.withColumn("_at", F.row_number().over(axis.orderBy(of_axis(rn, cn), of_axis(rt, ct))))
    capped = city_cap is not None and "city" in (row_dim, col_dim)
    if capped and city_rank == "count":
        a = a.withColumn("_cap", F.row_number().over(axis.orderBy(F.col("n").desc(), of_axis(rt, ct))))
    else:  # the reference cuts the alphabetical list (Q7)
        a = a.withColumn("_cap", F.col("_at"))
    for name, dim, total in (("row_ord", row_dim, 1), ("col_ord", col_dim, 2)):
        member = Window.partitionBy(dim)
        spread = lambda c: F.when(gid.isin(0, total), F.max(F.when(gid == total, F.col(c))).over(member))  # noqa: E731, B023
        a = a.withColumn(name, spread("_at").cast("int"))
        if capped and dim == "city":
            a = a.withColumn("_of", spread("_cap")).filter(F.col("_of").isNull() | (F.col("_of") <= city_cap))
    return a


def nps_matrix(df: DataFrame, row_dim: str, col_dim: str, spec: FilterSpec | None = None,
               city_cap: int | None = CITY_CAP, city_rank: str = "alpha",
               min_n: int = dims.MIN_N) -> DataFrame:
    """Long-form matrix: one row per cell / row total / column total / grand total.

    The grouping-sets aggregate is referenced exactly once, so the input is scanned once: member
    orders are ranks of the total rows, spread to the cells by windows over one member each.
    """
    if row_dim == col_dim:
        raise ValueError("row and column dimensions must differ")
    c = as_counts(df)
    f = apply_filters(c, spec) if spec is not None else c
    agg = (f.groupingSets([[row_dim, col_dim], [row_dim], [col_dim], []], row_dim, col_dim)
            .agg(*count_aggs(), F.grouping_id().alias("_gid")))
    r, k = F.col(row_dim), F.col(col_dim)
    gid = F.col("_gid")
    keep = (F.when(gid == 0, _kept(row_dim, r) & _kept(col_dim, k))
            .when(gid == 1, _kept(row_dim, r))
            .when(gid == 2, _kept(col_dim, k))
            .otherwise(F.lit(True)))
    a = agg.filter(keep)
    a = _ordinals(a, row_dim, col_dim, city_cap, city_rank)
    cell_type = (F.when(gid == 0, F.lit("cell")).when(gid == 1, F.lit("row_total"))
                 .when(gid == 2, F.lit("col_total")).otherwise(F.lit("grand_total")))
    u = a.select(cell_type.alias("cell_type"), r.cast("string").alias("row_member"),
                 k.cast("string").alias("col_member"), "row_ord", "col_ord",
                 "n", "promoters", "passives", "detractors")
    out = with_nps(u)
    return (out.withColumn("suppressed", F.col("n") < min_n)
               .withColumn("nps", suppress(F.col("nps"), F.col("n"), min_n))
               .withColumn("ci_lower", suppress(F.col("ci_lower"), F.col("n"), min_n))
               .withColumn("ci_upper", suppress(F.col("ci_upper"), F.col("n"), min_n)))


def row_summary(df: DataFrame, row_dim: str, spec: FilterSpec | None = None,
                sort: str = "natural", city_cap: int | None = CITY_CAP,
                city_rank: str = "alpha") -> DataFrame:
    """A10 + P15 + T6: per-row NPS, n, band shares, confidence, sentiment, sort rank.

    ``sort``: natural (T2), nps_desc or nps_asc; an NPS of exactly 0 sorts as
    -99 (Q5) and ties keep the natural order.
    """
    c = as_counts(df)
    f = apply_filters(c, spec) if spec is not None else c
    agg = f.groupBy(F.col(row_dim)).agg(*count_aggs())
    r = F.col(row_dim)
    a = agg.filter(_kept(row_dim, r))
    a = a.withColumn("row_ord", F.row_number().over(
        Window.orderBy(*member_sort_keys(row_dim, r), r)))
    if row_dim == "city" and city_cap is not None:
        if city_rank == "count":
            a = a.withColumn("_cap", F.row_number().over(Window.orderBy(F.col("n").desc(), r)))
            a = a.filter(F.col("_cap") <= city_cap).drop("_cap")
        else:
            a = a.filter(F.col("row_ord") <= city_cap)
    stats = a.select(r.alias("row_member"), "n", "promoters", "passives", "detractors", "row_ord")
    out = with_band_pcts(with_nps(stats))
    out = out.withColumn("sentiment", sentiment(F.col("nps")))
    key = F.when(F.col("nps") == 0, F.lit(-99.0)).otherwise(F.col("nps"))
    if sort == "nps_desc":
        w = Window.orderBy(key.desc(), F.col("row_ord"))
    elif sort == "nps_asc":
        w = Window.orderBy(key.asc(), F.col("row_ord"))
    else:
        w = Window.orderBy(F.col("row_ord"))
    return out.withColumn("sort_rank", F.row_number().over(w))
