"""Named queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]``.

Inputs: the survey rows derived from the driver tables under ``sf_dir``
(``promoscope.sources.driver_tables``), cleaned and materialised once per
application (``promoscope.sources.store``).  Count-based queries read the
additive rollup; row-level queries (cleaning, verbatims, upsert, ingest) read
the clean table or the raw derivation.

Every computed column is aliased identically in the Spark result and in the
oracle SQL; rank columns make order-dependent results comparable as sets.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promoscope.functions import nps as _nps
from promoscope.operators import cohorts, matrix, metrics, themes, topk, verbatims
from promoscope.operators.clean import CLEAN_COLUMNS, clean_survey
from promoscope.operators.dimensions import Dimensions
from promoscope.operators.filters import FilterSpec
from promoscope.operators.rollup import build_rollup
from promoscope.operators.upsert import merge, upsert_into
from promoscope.plans import oracle as O
from promoscope.session import scratch_path
from promoscope.sources import csv_ingest, survey_files
from promoscope.sources.driver_tables import RESENT_SPRINTS, survey_raw, survey_resend
from promoscope.sources.files import list_files
from promoscope.sources.ingest_log import append_log, dead_letters, read_log
from promoscope.sources.store import (
    read_clean, read_rollup, survey_rollup, survey_rows, survey_table, survey_topk, write_clean, write_rollup)
from promoscope.sources.versions import VersionedTable
from promoscope.streaming import ingest_stream

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey_rollup(spark, sf_dir)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey_table(spark, sf_dir)


def _trend_inner(grain: str) -> str:
    """Per-period counts with labels and period_ord (no statistics yet)."""
    if grain == "sprint":
        g, k = O.sprint_keys("period")
        inner = f"SELECT sprint_id AS period, {O.COUNTS} FROM survey WHERE sprint_id <> '' GROUP BY sprint_id"
        label, full = O.label_case("period", 1), O.label_case("period", 2)
        order = f"{g}, {k}, period"
    elif grain == "month":
        inner = (f"SELECT month AS period, {O.COUNTS} FROM survey "
                 f"WHERE {O.order_case('month', metrics.dims.MONTH_ORDER)} IS NOT NULL GROUP BY month")
        label, full = "regexp_replace(period, ' ''2[0-9]', '')", "period"
        order = O.order_case("period", metrics.dims.MONTH_ORDER)
    else:
        inner = (f"SELECT quarter AS period, {O.COUNTS} FROM survey "
                 f"WHERE {O.order_case('quarter', metrics.dims.QUARTER_ORDER)} IS NOT NULL GROUP BY quarter")
        label, full = "split_part(period, ' (', 1)", "period"
        order = O.order_case("period", metrics.dims.QUARTER_ORDER)
    return (f"SELECT *, {label} AS label, {full} AS full_label, "
            f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS period_ord FROM ({inner})")


# ---------------------------------------------------------------------------
# P1-P12 cleaning
# ---------------------------------------------------------------------------

@register("clean_survey", O.with_survey(
    f"SELECT {', '.join(CLEAN_COLUMNS)} FROM survey"))
def q_clean_survey(spark, sf_dir):
    return clean_survey(survey_raw(spark, sf_dir)).select(*CLEAN_COLUMNS)


# A user's own tables (J1): half-years for quarters and a sprint more, a changed and a new theme, other aliases.
_OWN_CALENDAR = [("Pilot", "Pilot", "Pilot, June '25", "Jun '25", "Pilot phase")] + [
    (sid, short, full, month, "2025, second half" if "'25" in month else "2026, first half")
    for sid, short, full, month, _ in metrics.dims.SPRINT_CALENDAR]
_OWN_THEMES = [(reason, "network" if theme == "speed_quality" else theme) for reason, theme in metrics.dims.REASON_THEME
               ] + [("Some unmapped reason", "other_reasons")]
_OWN_LABELS = [("network", "Network quality"), ("other_reasons", "Other reasons")]
_OWN_ALIASES = [("WA", "WhatsApp"), ("ct", "Campaign tool"), ("Email", "E-mail")]


def _own_tables(spark) -> Dimensions:
    calendar = [(*row, i) for i, row in enumerate(_OWN_CALENDAR)]
    return Dimensions(
        spark.createDataFrame(calendar, "sprint_id string, short_label string, full_label string, month string, "
                                        "quarter string, sprint_ord int"),
        spark.createDataFrame(_OWN_THEMES, "reason string, theme string"),
        spark.createDataFrame(_OWN_LABELS, "theme string, label string"),
        spark.createDataFrame(_OWN_ALIASES, "alias string, canonical string"))


def _with_own_tables_sql(body: str) -> str:
    aliases = [(a.lower(), c) for a, c in _OWN_ALIASES]
    return O.with_survey(body, [O.clean_cte("own", "survey_raw", 0, "survey_raw", _OWN_THEMES, _OWN_CALENDAR, aliases)])


@register("clean_custom_dims", _with_own_tables_sql(f"SELECT {', '.join(CLEAN_COLUMNS)} FROM own"))
def q_clean_custom_dims(spark, sf_dir):
    return clean_survey(survey_raw(spark, sf_dir), _own_tables(spark)).select(*CLEAN_COLUMNS)


def _own_trend_sql(grain: str, label: str) -> str:
    key = metrics.GRAIN_KEY[grain]
    table = O.values([(*row, i) for i, row in enumerate(_OWN_CALENDAR)],
                     ["sprint_id", "short_label", "full_label", "month", "quarter", "sprint_ord"])
    return _with_own_tables_sql(O.with_nps_sql(
        f"SELECT period, n, promoters, passives, detractors, {label} AS label, period AS full_label, "
        "CAST(row_number() OVER (ORDER BY ord, period) AS INTEGER) AS period_ord FROM "
        f"(SELECT {key} AS period, {O.COUNTS} FROM own WHERE {key} <> '' GROUP BY {key}) "
        f"JOIN (SELECT {grain} AS member, min(sprint_ord) AS ord FROM {table} GROUP BY 1) ON member = period"))


@register("trend_custom_quarter", _own_trend_sql("quarter", "split_part(period, ' (', 1)"))
def q_trend_custom_quarter(spark, sf_dir):
    tables = _own_tables(spark)
    return metrics.trend(clean_survey(survey_raw(spark, sf_dir), tables), "quarter", tables)


@register("theme_stats_custom", _with_own_tables_sql(
    "SELECT theme, COALESCE(own_label, theme) AS label, count, avg_score, pct, rank FROM ("
    "SELECT theme, CAST(count(*) AS BIGINT) AS count, "
    "CAST(floor((CAST(sum(score) AS DOUBLE) / count(*)) * 10 + 0.5) AS DOUBLE) / 10 AS avg_score, "
    "CAST(floor((CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM own)) * 1000 + 0.5) AS DOUBLE) / 10 AS pct, "
    "CAST(row_number() OVER (ORDER BY count(*) DESC, theme) AS INTEGER) AS rank "
    "FROM own WHERE theme <> '' GROUP BY theme) "
    f"LEFT JOIN (SELECT * FROM {O.values(_OWN_LABELS, ['own_theme', 'own_label'])}) ON own_theme = theme"))
def q_theme_stats_custom(spark, sf_dir):
    tables = _own_tables(spark)
    return themes.theme_stats(clean_survey(survey_raw(spark, sf_dir), tables), tables=tables)


# ---------------------------------------------------------------------------
# A1 / A2
# ---------------------------------------------------------------------------

@register("nps_overall", O.with_survey(O.with_nps_sql(f"SELECT {O.COUNTS} FROM survey")))
def q_nps_overall(spark, sf_dir):
    return metrics.nps_overall(rollup(spark, sf_dir))


_BY_SOURCE_SQL = O.with_survey(
    "SELECT *, CAST(row_number() OVER (ORDER BY n DESC, member) AS INTEGER) AS rank FROM ("
    + O.with_nps_sql(f"SELECT source AS member, {O.COUNTS} FROM survey GROUP BY source "
                     "HAVING source NOT IN ('', 'Unknown')") + ")")


@register("nps_by_source", _BY_SOURCE_SQL)
def q_nps_by_source(spark, sf_dir):
    return metrics.nps_by_group(rollup(spark, sf_dir), "source")


_DIMENSIONS = ["source", "city", "plan_type", "tenure_cut", "first_time_user", "sprint_id",
               "month", "quarter"]


def _by_dims_sql() -> str:
    parts = [f"SELECT '{d}' AS dimension, {d} AS member, {O.COUNTS} FROM survey GROUP BY {d}"
             for d in _DIMENSIONS]
    inner = "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE member NOT IN ('', 'Unknown')"
    return O.with_survey(
        "SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, member) AS INTEGER) "
        "AS rank FROM (" + O.with_nps_sql(inner) + ")")


@register("nps_by_dimension", _by_dims_sql())
def q_nps_by_dimension(spark, sf_dir):
    return metrics.nps_by_dimensions(rollup(spark, sf_dir), _DIMENSIONS)


# ---------------------------------------------------------------------------
# A3 trends
# ---------------------------------------------------------------------------

def _trend_sql(grain: str) -> str:
    return O.with_survey(O.with_nps_sql(_trend_inner(grain)))


for _g in metrics.GRAINS:
    def _mk(grain):
        def fn(spark, sf_dir):
            return metrics.trend(rollup(spark, sf_dir), grain)
        return fn
    register(f"trend_{_g}", _trend_sql(_g))(_mk(_g))


# ---------------------------------------------------------------------------
# shared SQL pieces
# ---------------------------------------------------------------------------

def _all_grains_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{g}' AS grain, * FROM ({O.with_nps_sql(_trend_inner(g))})" for g in metrics.GRAINS)


_G, _K = O.sprint_keys("sprint_id")
RECENT_CTE = f"""
recent AS (
  SELECT sprint_id FROM (
    SELECT sprint_id, row_number() OVER (ORDER BY {_G} DESC, {_K} DESC, sprint_id DESC) AS rr
    FROM (SELECT DISTINCT sprint_id FROM survey WHERE sprint_id <> '')
  ) WHERE rr <= 3
)"""


O_ERF = [repr(_nps.ERF_A1), repr(_nps.ERF_A2), repr(_nps.ERF_A3), repr(_nps.ERF_A4), repr(_nps.ERF_A5)]
O_ERF = [f"CAST({v} AS DOUBLE)" for v in O_ERF]
O_ERF_P = f"CAST({_nps.ERF_P!r} AS DOUBLE)"


def _erf_sql(x: str) -> str:
    t = f"(1 / (1 + {O_ERF_P} * abs({x})))"
    poly = (f"(((({O_ERF[4]} * {t} + {O_ERF[3]}) * {t} + {O_ERF[2]}) * {t} + {O_ERF[1]}) * {t} "
            f"+ {O_ERF[0]})")
    return f"((CASE WHEN {x} < 0 THEN -1.0 ELSE 1.0 END) * (1 - {poly} * {t} * exp(-{x} * {x})))"


# ---------------------------------------------------------------------------
# A4, W1 + P17, Z3 + Z4, A18, F2 / W2
# ---------------------------------------------------------------------------

@register("band_distribution", O.with_survey(
    "SELECT grain, period, period_ord, label, n, "
    f"{O.pct('promoters', 'n')} AS promoter_pct, {O.pct('passives', 'n')} AS passive_pct, "
    f"{O.pct('detractors', 'n')} AS detractor_pct FROM ({_all_grains_sql()})"))
def q_band_distribution(spark, sf_dir):
    return metrics.band_distribution(rollup(spark, sf_dir))


@register("period_delta", O.with_survey(
    "SELECT *, CASE WHEN delta IS NULL THEN NULL WHEN delta > 2 THEN 'improving' "
    "WHEN delta < -2 THEN 'declining' ELSE 'stable' END AS direction FROM ("
    "SELECT grain, period, period_ord, full_label, n, nps, prev_period, prev_nps, "
    f"CASE WHEN prev_nps IS NOT NULL THEN {O.js_round1('(nps - prev_nps)')} END AS delta FROM ("
    "SELECT *, lag(period) OVER (PARTITION BY grain ORDER BY period_ord) AS prev_period, "
    "lag(nps) OVER (PARTITION BY grain ORDER BY period_ord) AS prev_nps "
    f"FROM ({_all_grains_sql()})))"))
def q_period_delta(spark, sf_dir):
    return metrics.period_delta(rollup(spark, sf_dir))


@register("period_direction", O.with_survey(
    "SELECT grain, period, prev_period, nps, prev_nps, delta, "
    "CASE WHEN delta > 2 THEN 'improving' WHEN delta < -2 THEN 'declining' ELSE 'stable' END AS direction "
    f"FROM (SELECT *, {O.js_round1('(nps - prev_nps)')} AS delta "
    "FROM (SELECT *, max(period_ord) OVER (PARTITION BY grain) AS last_ord, "
    "lag(period) OVER (PARTITION BY grain ORDER BY period_ord) AS prev_period, "
    "lag(nps) OVER (PARTITION BY grain ORDER BY period_ord) AS prev_nps "
    f"FROM ({_all_grains_sql()}))) "
    "WHERE period_ord = last_ord AND prev_period IS NOT NULL"))
def q_period_direction(spark, sf_dir):
    return metrics.period_direction(rollup(spark, sf_dir))


def _ztest_sql(relation: str, before: str, after: str, keep: str) -> str:
    """SQL of the z-test of NPS(after) - NPS(before) over a relation with prefixed counts and nps."""
    z1 = (f"SELECT *, {O.js_round1(f'({after}nps - {before}nps)')} AS d0, "
          f"sqrt({O.var_expr(before)} + {O.var_expr(after)}) * 100 AS se, "
          f"({before}n = 0 OR {after}n = 0) AS insufficient FROM ({relation})")
    z2 = ("SELECT *, CASE WHEN NOT insufficient AND se <> 0 THEN abs(d0) / se END AS z FROM (" + z1 + ")")
    z3 = (f"SELECT *, 2 * (1 - 0.5 * (1 + {_erf_sql('(z / sqrt(2.0))')})) AS p FROM (" + z2 + ")")
    sig = "COALESCE(p < 0.05, false)"
    ptxt = "printf('%.3f', p)"
    d = metrics.dims
    size = O.js_num("abs(d0)")
    interp = (f"CASE WHEN insufficient THEN {O.q(d.TEST_NO_DATA)} WHEN se = 0 THEN {O.q(d.TEST_NO_VARIANCE)} "
              f"WHEN {sig} AND d0 > 0 THEN {O.sentence(d.TEST_IMPROVED, size, ptxt)} "
              f"WHEN {sig} THEN {O.sentence(d.TEST_DECLINED, size, ptxt)} "
              f"ELSE {O.sentence(d.TEST_CHANGED, O.js_num('d0'), ptxt)} END")
    return (f"SELECT {keep}, CASE WHEN insufficient THEN 0.0 ELSE d0 END AS delta, "
            "CAST(floor(z * 100 + 0.5) AS DOUBLE) / 100 AS z_score, "
            "CAST(floor(p * 10000 + 0.5) AS DOUBLE) / 10000 AS p_value, "
            f"{sig} AS significant, {interp} AS interpretation FROM ({z3})")


def _significance_sql() -> str:
    lagged = ("SELECT period, period_ord, n, promoters, passives, detractors, nps, "
              + ", ".join(f"lag({c}) OVER (ORDER BY period_ord) AS prev_{c}"
                          for c in ["period", "n", "promoters", "passives", "detractors", "nps"])
              + f" FROM ({O.with_nps_sql(_trend_inner('sprint'))})")
    rel = f"SELECT * FROM ({lagged}) WHERE prev_period IS NOT NULL"
    return O.with_survey(_ztest_sql(rel, "prev_", "", "period, period_ord, prev_period, prev_n, n, prev_nps, nps"))


@register("period_significance", _significance_sql())
def q_period_significance(spark, sf_dir):
    return metrics.period_significance(rollup(spark, sf_dir))


def _health_sql() -> str:
    t = O.with_nps_sql(_trend_inner("sprint"))
    d = (f"SELECT *, CASE WHEN lag(nps) OVER (ORDER BY period_ord) IS NOT NULL "
         f"THEN {O.js_round1('(nps - lag(nps) OVER (ORDER BY period_ord))')} END AS delta FROM ({t})")
    overall = O.with_nps_sql(f"SELECT {O.COUNTS} FROM survey")
    u = (f"SELECT period, period_ord, n, promoters, detractors, nps, delta FROM d "
         f"UNION ALL SELECT 'All' AS period, CAST(0 AS INTEGER) AS period_ord, n, promoters, detractors, nps, "
         f"(SELECT delta FROM d ORDER BY period_ord DESC LIMIT 1) AS delta FROM ({overall})")
    pcts = (f"SELECT *, {O.js_round('promoters / n * 100')} AS promoter_pct, "
            f"{O.js_round('detractors / n * 100')} AS detractor_pct FROM (SELECT * FROM ({u}) WHERE n > 0)")
    s = O.js_num("nps")
    say, change = metrics.dims, O.js_num("delta")
    first = (f"CASE WHEN nps > 20 THEN {O.sentence(say.HEALTH_STRONG, s)} "
             f"WHEN nps > 0 THEN {O.sentence(say.HEALTH_SLIGHT, s)} "
             f"WHEN nps > -15 THEN {O.sentence(say.HEALTH_NEGATIVE, s)} "
             f"ELSE {O.sentence(say.HEALTH_BAD, s)} END")
    second = O.sentence(say.HEALTH_BANDS, O.js_num("promoter_pct"), O.js_num("detractor_pct"))
    third = (f"CASE WHEN delta IS NULL THEN NULL WHEN delta > 0 THEN {O.sentence(say.HEALTH_RISE, change)} "
             f"WHEN delta < 0 THEN {O.sentence(say.HEALTH_DROP, change)} ELSE {O.sentence(say.HEALTH_FLAT)} END")
    body = (f"SELECT period, period_ord, n, nps, promoter_pct, detractor_pct, delta, "
            f"CASE WHEN nps > 20 THEN 'strong' WHEN nps > 0 THEN 'slightly_positive' "
            f"WHEN nps > -15 THEN 'negative' ELSE 'significant_dissatisfaction' END AS health_level, "
            f"CASE WHEN delta > 0 THEN 'rise' WHEN delta < 0 THEN 'drop' WHEN delta = 0 THEN 'flat' END AS change, "
            f"concat_ws(' ', {first}, {second}, {third}) AS summary FROM ({pcts})")
    return O.with_survey(body, [f"\nd AS ({d})"])


@register("period_health", _health_sql())
def q_period_health(spark, sf_dir):
    return metrics.period_health(rollup(spark, sf_dir))


@register("recent_sprints", O.with_survey(
    "SELECT period AS sprint_id, recent_rank, period_ord, n, nps, ci_lower, ci_upper, confidence FROM ("
    "SELECT *, CAST(row_number() OVER (ORDER BY period_ord DESC) AS INTEGER) AS recent_rank FROM ("
    + O.with_nps_sql(_trend_inner("sprint")) + ")) WHERE recent_rank <= 3"))
def q_recent_sprints(spark, sf_dir):
    return metrics.recent_sprints(rollup(spark, sf_dir))


# ---------------------------------------------------------------------------
# A5, A6, A16, A17, S12
# ---------------------------------------------------------------------------

@register("feedback_rate", O.with_survey(
    f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE {O.fb_gt(5)}) AS BIGINT) AS with_feedback, "
    f"{O.pct(f'count(*) FILTER (WHERE {O.fb_gt(5)})', 'count(*)')} AS feedback_pct FROM survey"))
def q_feedback_rate(spark, sf_dir):
    return metrics.feedback_rate(rollup(spark, sf_dir))


def _comment_rates_sql() -> str:
    fb = O.fb_gt(5)
    cnt = {
        "total": "count(*)", "with_feedback": f"count(*) FILTER (WHERE {fb})",
        "promoter_count": "count(*) FILTER (WHERE score >= 9)",
        "promoter_fb": f"count(*) FILTER (WHERE score >= 9 AND {fb})",
        "detractor_count": "count(*) FILTER (WHERE score <= 6)",
        "detractor_fb": f"count(*) FILTER (WHERE score <= 6 AND {fb})",
        "passive_count": "count(*) FILTER (WHERE score BETWEEN 7 AND 8)",
        "passive_fb": f"count(*) FILTER (WHERE score BETWEEN 7 AND 8 AND {fb})",
    }
    inner = ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in cnt.items())
    outer = ("*, " + O.pct("with_feedback", "total") + " AS feedback_pct, "
             + O.pct("promoter_fb", "promoter_count") + " AS promoter_fb_pct, "
             + O.pct("detractor_fb", "detractor_count") + " AS detractor_fb_pct, "
             + O.pct("passive_fb", "passive_count") + " AS passive_fb_pct")
    return O.with_survey(
        f"SELECT {outer} FROM (SELECT {inner} FROM survey WHERE sprint_id IN (SELECT sprint_id FROM recent))",
        [RECENT_CTE])


@register("comment_rates", _comment_rates_sql())
def q_comment_rates(spark, sf_dir):
    return metrics.comment_rates_recent(rollup(spark, sf_dir))


@register("dataset_summary", O.with_survey(
    "SELECT CAST(count(*) AS BIGINT) AS responses, "
    "CAST(count(DISTINCT CASE WHEN sprint_id <> '' THEN sprint_id END) AS BIGINT) AS sprints, "
    "CAST(count(DISTINCT CASE WHEN source <> '' THEN source END) AS BIGINT) AS sources FROM survey"))
def q_dataset_summary(spark, sf_dir):
    return metrics.dataset_summary(rollup(spark, sf_dir))


def _dim_members_sql() -> str:
    g, k = O.sprint_keys("member")
    pos = O.order_case("member", metrics.dims.DEFAULT_CHANNELS)
    return O.with_survey(
        "SELECT 'sprint' AS dimension, member, CAST(row_number() OVER (ORDER BY "
        f"{g}, {k}, member) AS INTEGER) AS member_ord FROM (SELECT DISTINCT sprint_id AS member FROM survey "
        "WHERE sprint_id <> '') UNION ALL "
        "SELECT 'source', member, CAST(row_number() OVER (ORDER BY member) AS INTEGER) FROM "
        "(SELECT DISTINCT source AS member FROM survey WHERE source <> '') UNION ALL "
        "SELECT 'theme', member, CAST(row_number() OVER (ORDER BY member) AS INTEGER) FROM "
        "(SELECT DISTINCT theme AS member FROM survey WHERE theme <> '') UNION ALL "
        f"SELECT 'channel', member, CAST(row_number() OVER (ORDER BY CASE WHEN {pos} IS NULL THEN 1 ELSE 0 END, "
        f"COALESCE({pos}, 0), member) AS INTEGER) FROM "
        "(SELECT DISTINCT source AS member FROM survey WHERE source <> '') UNION ALL "
        + " UNION ALL ".join(
            f"SELECT '{name}', member, CAST(row_number() OVER (ORDER BY {O.order_case('member', order)}) "
            f"AS INTEGER) FROM (SELECT DISTINCT {col} AS member FROM survey "
            f"WHERE {O.order_case(col, order)} IS NOT NULL)"
            for name, col, order in (("month", "month", metrics.dims.MONTH_ORDER),
                                     ("quarter", "quarter", metrics.dims.QUARTER_ORDER),
                                     ("tenure", "tenure_cut", metrics.dims.TENURE_ORDER))))


@register("dim_members", _dim_members_sql())
def q_dim_members(spark, sf_dir):
    return metrics.dim_members(rollup(spark, sf_dir))


@register("sprint_counts", O.with_survey(
    f"SELECT regexp_replace(lower(sprint_id), '{O.WS_CLASS}+', '_', 'g') AS sprint_key, "
    "CAST(count(*) AS BIGINT) AS responses FROM survey GROUP BY 1"))
def q_sprint_counts(spark, sf_dir):
    return metrics.sprint_counts(rollup(spark, sf_dir))


# ---------------------------------------------------------------------------
# A9 / A10 matrices
# ---------------------------------------------------------------------------


_ORDERED = {"month": metrics.dims.MONTH_ORDER, "quarter": metrics.dims.QUARTER_ORDER,
            "tenure_cut": metrics.dims.TENURE_ORDER}


def _member_order_sql(dim: str, c: str) -> str:
    if dim == "sprint_id":
        return f"{O.cal_index(c)}, {c}"
    if dim in _ORDERED:
        return f"{O.order_case(c, _ORDERED[dim])}, {c}"
    return f"{c}, {c}"


def _member_kept_sql(dim: str, c: str) -> str:
    if dim in _ORDERED:
        return f"{O.order_case(c, _ORDERED[dim])} IS NOT NULL"
    return "TRUE"


def _filter_sql(spec: FilterSpec | None) -> str:
    if spec is None:
        return "TRUE"
    conds = ["TRUE"]
    if spec.period is not None:
        conds.append(f"{ {'sprint': 'sprint_id', 'month': 'month', 'quarter': 'quarter'}[spec.grain]} = {O.q(spec.period)}")
    if spec.channels:
        lst = ", ".join(O.q(c) for c in spec.channels)
        conds.append(f"(source IN ({lst}) OR {len(spec.channels)} >= "
                     "(SELECT count(DISTINCT source) FROM survey WHERE source <> ''))")
    if spec.tenures:
        wanted = [t for t in metrics.dims.TENURE_ORDER if t in spec.tenures]
        if wanted:
            allt = ", ".join(O.q(t) for t in metrics.dims.TENURE_ORDER)
            lst = ", ".join(O.q(t) for t in wanted)
            n_avail = f"(SELECT count(DISTINCT tenure_cut) FILTER (WHERE tenure_cut IN ({allt})) FROM survey)"
            n_valid = f"(SELECT count(DISTINCT tenure_cut) FILTER (WHERE tenure_cut IN ({lst})) FROM survey)"
            conds.append(f"(tenure_cut IN ({lst}) OR {n_valid} >= {n_avail} OR {n_valid} = 0)")
    return " AND ".join(conds)


def _matrix_sql(r: str, c: str, spec: FilterSpec | None = None, cap: int = matrix.CITY_CAP) -> str:
    agg = (f"SELECT {r} AS row_member, {c} AS col_member, GROUPING({r}, {c}) AS gid, {O.COUNTS} "
           f"FROM survey WHERE {_filter_sql(spec)} GROUP BY GROUPING SETS (({r}, {c}), ({r}), ({c}), ())")

    def members(gid: int, dim: str, col: str, ordcol: str) -> str:
        m = (f"SELECT {col}, CAST(row_number() OVER (ORDER BY {_member_order_sql(dim, col)}) AS INTEGER) "
             f"AS {ordcol} FROM agg WHERE gid = {gid} AND {col} NOT IN ('', 'Unknown') "
             f"AND {_member_kept_sql(dim, col)}")
        if dim == "city":
            m = f"SELECT * FROM ({m}) WHERE {ordcol} <= {cap}"
        return m

    cols = "n, promoters, passives, detractors"
    u = (f"SELECT 'cell' AS cell_type, a.row_member, a.col_member, r.row_ord, c.col_ord, {cols} "
         f"FROM agg a JOIN rws r ON r.row_member = a.row_member JOIN cls c ON c.col_member = a.col_member "
         f"WHERE gid = 0 UNION ALL "
         f"SELECT 'row_total', a.row_member, NULL, r.row_ord, NULL, {cols} FROM agg a "
         f"JOIN rws r ON r.row_member = a.row_member WHERE gid = 1 UNION ALL "
         f"SELECT 'col_total', NULL, a.col_member, NULL, c.col_ord, {cols} FROM agg a "
         f"JOIN cls c ON c.col_member = a.col_member WHERE gid = 2 UNION ALL "
         f"SELECT 'grand_total', NULL, NULL, NULL, NULL, {cols} FROM agg WHERE gid = 3")
    body = (f"SELECT cell_type, CAST(row_member AS VARCHAR) AS row_member, CAST(col_member AS VARCHAR) AS col_member, "
            f"CAST(row_ord AS INTEGER) AS row_ord, CAST(col_ord AS INTEGER) AS col_ord, {cols}, "
            "CASE WHEN n >= 5 THEN nps END AS nps, CASE WHEN n >= 5 THEN ci_lower END AS ci_lower, "
            "CASE WHEN n >= 5 THEN ci_upper END AS ci_upper, confidence, n < 5 AS suppressed "
            f"FROM ({O.with_nps_sql(u)})")
    return O.with_survey(body, [f"\nagg AS ({agg})", f"\nrws AS ({members(1, r, 'row_member', 'row_ord')})",
                                f"\ncls AS ({members(2, c, 'col_member', 'col_ord')})"])


_MATRICES = {
    # default axes of the segment view
    "matrix_tenure_sprint": ("tenure_cut", "sprint_id", None),
    # one sprint selected (F1; prunes to a single sprint partition)
    "matrix_city_source": ("city", "source", FilterSpec(grain="sprint", period="Sprint 13")),
    "matrix_plan_quarter": ("plan_type", "quarter", None),
    # channel and tenure selections (F3, F4); many cells fall below n = 5
    "matrix_filtered": ("city", "sprint_id", FilterSpec(channels=("Call",),
                                                        tenures=("Early (1-2 mo)", "Mid (3-6 mo)"))),
}

for _name, (_r, _c, _spec) in _MATRICES.items():
    def _mk_matrix(r, c, spec):
        def fn(spark, sf_dir):
            return matrix.nps_matrix(rollup(spark, sf_dir), r, c, spec)
        return fn
    register(_name, _matrix_sql(_r, _c, _spec))(_mk_matrix(_r, _c, _spec))


def _row_summary_sql(dim: str, cap: int = matrix.CITY_CAP, way: str = "DESC") -> str:
    agg = f"SELECT {dim} AS row_member, {O.COUNTS} FROM survey GROUP BY {dim}"
    rws = (f"SELECT row_member, CAST(row_number() OVER (ORDER BY {_member_order_sql(dim, 'row_member')}) "
           f"AS INTEGER) AS row_ord FROM agg WHERE row_member NOT IN ('', 'Unknown') AND "
           f"{_member_kept_sql(dim, 'row_member')}")
    if dim == "city":
        rws = f"SELECT * FROM ({rws}) WHERE row_ord <= {cap}"
    stats = O.with_nps_sql("SELECT a.*, r.row_ord FROM agg a JOIN rws r ON r.row_member = a.row_member")
    body = (f"SELECT *, {O.pct('promoters', 'n')} AS promoter_pct, {O.pct('passives', 'n')} AS passive_pct, "
            f"{O.pct('detractors', 'n')} AS detractor_pct, "
            "CASE WHEN nps > 5 THEN 'positive' WHEN nps < -5 THEN 'negative' ELSE 'neutral' END AS sentiment, "
            f"CAST(row_number() OVER (ORDER BY CASE WHEN nps = 0 THEN -99.0 ELSE nps END {way}, row_ord) AS INTEGER) "
            f"AS sort_rank FROM ({stats})")
    return O.with_survey(body, [f"\nagg AS ({agg})", f"\nrws AS ({rws})"])


@register("row_summary_sorted", _row_summary_sql("city"))
def q_row_summary_sorted(spark, sf_dir):
    return matrix.row_summary(rollup(spark, sf_dir), "city", sort="nps_desc")


@register("row_summary_ascending", _row_summary_sql("city", way="ASC"))
def q_row_summary_ascending(spark, sf_dir):
    return matrix.row_summary(rollup(spark, sf_dir), "city", sort="nps_asc")


# ---------------------------------------------------------------------------
# A7, A8, J3 + P18 themes
# ---------------------------------------------------------------------------

def _pct1_sql(cnt: str, tot: str) -> str:
    return f"CASE WHEN {tot} > 0 THEN CAST(floor({cnt} / {tot} * 1000 + 0.5) AS DOUBLE) / 10 ELSE 0.0 END"


@register("theme_stats", O.with_survey(
    "SELECT theme, label, count, avg_score, pct, rank FROM ("
    f"SELECT theme, {O.theme_label_sql('theme')} AS label, CAST(count(*) AS BIGINT) AS count, "
    f"{O.js_round1('(sum(score) / count(*))')} AS avg_score, "
    f"{_pct1_sql('count(*)', '(SELECT count(*) FROM survey)')} AS pct, "
    "CAST(row_number() OVER (ORDER BY count(*) DESC, theme) AS INTEGER) AS rank "
    "FROM survey WHERE theme <> '' GROUP BY theme)"))
def q_theme_stats(spark, sf_dir):
    return themes.theme_stats(rollup(spark, sf_dir))


def _themes_by_band_sql(top_k: int = 5, recent: bool = False) -> str:
    only = "sprint_id IN (SELECT sprint_id FROM recent)" if recent else "TRUE"
    agg = ("SELECT theme, count(*) FILTER (WHERE score >= 9) AS pro, count(*) FILTER (WHERE score <= 6) AS det "
           f"FROM survey WHERE theme <> '' AND {only} GROUP BY theme")
    base = (f"SELECT count(*) FILTER (WHERE score >= 9 AND {O.fb_gt(5)}) AS pb, "
            f"count(*) FILTER (WHERE score <= 6 AND {O.fb_gt(5)}) AS db FROM survey WHERE {only}")
    pos = (f"SELECT 'positive' AS side, theme, CAST(pro AS BIGINT) AS count, "
           f"{O.js_round('pro / (CASE WHEN pb > 0 THEN pb ELSE 1 END) * 100')} AS pct "
           f"FROM ({agg}) a, ({base}) b WHERE pro >= det AND pro > 0")
    neg = (f"SELECT 'negative' AS side, theme, CAST(det AS BIGINT) AS count, "
           f"{O.js_round('det / (CASE WHEN db > 0 THEN db ELSE 1 END) * 100')} AS pct "
           f"FROM ({agg}) a, ({base}) b WHERE det > pro OR (det > 0 AND pro = 0)")
    ranked = (f"SELECT *, {O.theme_label_sql('theme')} AS label, CAST(row_number() OVER (PARTITION BY side "
              f"ORDER BY pct DESC, count DESC, theme) AS INTEGER) AS side_rank FROM ({pos} UNION ALL {neg})")
    return O.with_survey(f"SELECT * FROM ({ranked}) WHERE side_rank <= {top_k}", [RECENT_CTE] if recent else [])


@register("themes_by_band", _themes_by_band_sql())
def q_themes_by_band(spark, sf_dir):
    return themes.themes_by_band(rollup(spark, sf_dir), top_k=5)


@register("themes_by_band_recent", _themes_by_band_sql(10, recent=True))
def q_themes_by_band_recent(spark, sf_dir):
    """A8 over the recent sprints, ten themes a list, as the themes view shows it."""
    r = rollup(spark, sf_dir)
    return themes.themes_by_band(metrics.recent_filter(r), top_k=10)


def _theme_changes_sql(top_k: int = 10) -> str:
    order = O.order_case("period", metrics.dims.QUARTER_ORDER)
    ctes = [
        f"\nagg AS (SELECT quarter AS period, theme, count(*) AS count FROM survey "
        f"WHERE {O.order_case('quarter', metrics.dims.QUARTER_ORDER)} IS NOT NULL GROUP BY quarter, theme)",
        "\nper AS (SELECT period, sum(count) AS total FROM agg GROUP BY period)",
        f"\npairs AS (SELECT * FROM (SELECT period, lag(period) OVER (ORDER BY {order}) AS prev_period, "
        f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS period_ord FROM per) "
        "WHERE prev_period IS NOT NULL)",
        f"\nstats AS (SELECT a.period, a.theme, a.count, {_pct1_sql('a.count', 'p.total')} AS pct "
        "FROM agg a JOIN per p ON p.period = a.period WHERE a.theme <> '')",
        "\ncurr AS (SELECT pr.period, pr.prev_period, pr.period_ord, s.theme, s.count AS count_curr, "
        "s.pct AS pct_curr FROM stats s JOIN pairs pr ON pr.period = s.period)",
        "\nprv AS (SELECT pr.period, pr.prev_period, pr.period_ord, s.theme, s.count AS count_prev, "
        "s.pct AS pct_prev FROM stats s JOIN pairs pr ON pr.prev_period = s.period)",
        "\nm AS (SELECT COALESCE(c.period, p.period) AS period, COALESCE(c.prev_period, p.prev_period) AS prev_period, "
        "COALESCE(c.period_ord, p.period_ord) AS period_ord, COALESCE(c.theme, p.theme) AS theme, "
        "CAST(COALESCE(p.count_prev, 0) AS BIGINT) AS count_prev, CAST(COALESCE(c.count_curr, 0) AS BIGINT) AS count_curr, "
        "COALESCE(p.pct_prev, 0.0) AS pct_prev, COALESCE(c.pct_curr, 0.0) AS pct_curr "
        "FROM curr c FULL OUTER JOIN prv p ON c.period = p.period AND c.theme = p.theme)",
    ]
    d = f"SELECT *, {O.js_round1('(pct_curr - pct_prev)')} AS pct_delta FROM m"
    body = (f"SELECT prev_period, period, period_ord, theme, {O.theme_label_sql('theme')} AS label, count_prev, "
            "count_curr, pct_prev, pct_curr, pct_delta, "
            "CASE WHEN count_prev = 0 AND count_curr > 0 THEN 'Emerging' "
            "WHEN count_prev > 0 AND count_curr = 0 THEN 'Resolved' "
            "WHEN abs(pct_delta) > 2 THEN CASE WHEN pct_delta > 0 THEN 'Growing' ELSE 'Shrinking' END "
            "ELSE 'Stable' END AS status, "
            "CAST(row_number() OVER (PARTITION BY period ORDER BY abs(pct_delta) DESC, theme) AS INTEGER) AS change_rank "
            f"FROM ({d})")
    return O.with_survey(f"SELECT * FROM ({body}) WHERE change_rank <= {top_k}", ctes)


@register("theme_changes", _theme_changes_sql())
def q_theme_changes(spark, sf_dir):
    return themes.theme_changes(rollup(spark, sf_dir), "quarter", top_k=10)


def _theme_pair_sql(a: str, b: str, top_k: int = 10) -> str:
    side = lambda p: f"count(*) FILTER (WHERE quarter = {O.q(p)})"
    ctes = [
        f"\nagg AS (SELECT theme, {side(a)} AS cp, {side(b)} AS cc FROM survey WHERE quarter IN ({O.q(a)}, {O.q(b)}) "
        "GROUP BY theme)",
        "\ntot AS (SELECT sum(cp) AS tp, sum(cc) AS tc FROM agg)",
        f"\nm AS (SELECT {O.q(a)} AS prev_period, {O.q(b)} AS period, theme, CAST(cp AS BIGINT) AS count_prev, "
        f"CAST(cc AS BIGINT) AS count_curr, {_pct1_sql('cp', 'tp')} AS pct_prev, {_pct1_sql('cc', 'tc')} AS pct_curr "
        "FROM agg, tot WHERE theme <> '')",
    ]
    d = f"SELECT *, {O.js_round1('(pct_curr - pct_prev)')} AS pct_delta FROM m"
    body = (f"SELECT *, {O.theme_label_sql('theme')} AS label, "
            "CASE WHEN count_prev = 0 AND count_curr > 0 THEN 'Emerging' "
            "WHEN count_prev > 0 AND count_curr = 0 THEN 'Resolved' "
            "WHEN abs(pct_delta) > 2 THEN CASE WHEN pct_delta > 0 THEN 'Growing' ELSE 'Shrinking' END "
            "ELSE 'Stable' END AS status, "
            "CAST(row_number() OVER (ORDER BY abs(pct_delta) DESC, theme) AS INTEGER) AS change_rank "
            f"FROM ({d})")
    return O.with_survey(f"SELECT * FROM ({body}) WHERE change_rank <= {top_k}", ctes)


_PAIR = (metrics.dims.QUARTER_ORDER[0], metrics.dims.QUARTER_ORDER[-1])


@register("theme_changes_pair", _theme_pair_sql(*_PAIR))
def q_theme_changes_pair(spark, sf_dir):
    """J3 between two chosen periods that do not follow each other."""
    return themes.theme_changes_pair(rollup(spark, sf_dir), *_PAIR)


# ---------------------------------------------------------------------------
# A11-A15, T4 cohorts
# ---------------------------------------------------------------------------

_KNOWN = "first_time_user IN ('Yes', 'No')"
_FT, _REP = "first_time_user = 'Yes'", "first_time_user = 'No'"


def _cohort_kpis_sql() -> str:
    inner = (f"SELECT {O.counts_if('TRUE', 'all_')}, {O.counts_if(_FT, 'ft_')}, {O.counts_if(_REP, 'rep_')} "
             f"FROM survey WHERE {_KNOWN}")
    s = O.with_nps_sql(O.with_nps_sql(O.with_nps_sql(inner, "all_"), "ft_"), "rep_")
    cols = ", ".join(f"{p}{m}" for p in ("all_", "ft_", "rep_")
                     for m in ("n", "promoters", "passives", "detractors", "nps", "ci_lower", "ci_upper",
                               "confidence"))
    return O.with_survey(f"SELECT {cols}, {O.js_round1('(ft_nps - rep_nps)')} AS nps_delta FROM ({s})")


@register("cohort_kpis", _cohort_kpis_sql())
def q_cohort_kpis(spark, sf_dir):
    return cohorts.cohort_kpis(rollup(spark, sf_dir))


def _cohort_trend_sql() -> str:
    g, k = O.sprint_keys("period")
    inner = (f"SELECT sprint_id AS period, {O.counts_if(_FT, 'ft_')}, {O.counts_if(_REP, 'rep_')} "
             f"FROM survey WHERE {_KNOWN} AND sprint_id <> '' GROUP BY sprint_id")
    s = O.with_nps_sql(O.with_nps_sql(inner, "ft_"), "rep_")
    return O.with_survey(
        f"SELECT period, CAST(row_number() OVER (ORDER BY {g}, {k}, period) AS INTEGER) AS period_ord, "
        "ft_n, CASE WHEN ft_n >= 5 THEN ft_nps END AS ft_nps, rep_n, "
        f"CASE WHEN rep_n >= 5 THEN rep_nps END AS rep_nps FROM ({s})")


def _cohort_trend_quarter_sql() -> str:
    order = O.order_case("period", metrics.dims.QUARTER_ORDER)
    inner = (f"SELECT quarter AS period, {O.counts_if(_FT, 'ft_')}, {O.counts_if(_REP, 'rep_')} "
             f"FROM survey WHERE {_KNOWN} AND {O.order_case('quarter', metrics.dims.QUARTER_ORDER)} "
             "IS NOT NULL GROUP BY quarter")
    s = O.with_nps_sql(O.with_nps_sql(inner, "ft_"), "rep_")
    return O.with_survey(
        f"SELECT period, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS period_ord, "
        "ft_n, CASE WHEN ft_n >= 5 THEN ft_nps END AS ft_nps, rep_n, "
        f"CASE WHEN rep_n >= 5 THEN rep_nps END AS rep_nps FROM ({s})")


@register("cohort_trend_quarter", _cohort_trend_quarter_sql())
def q_cohort_trend_quarter(spark, sf_dir):
    return cohorts.cohort_trend(rollup(spark, sf_dir), "quarter")


@register("cohort_trend", _cohort_trend_sql())
def q_cohort_trend(spark, sf_dir):
    return cohorts.cohort_trend(rollup(spark, sf_dir))


def _split_stats_sql(inner: str) -> str:
    s = O.with_nps_sql(O.with_nps_sql(inner, "ft_"), "rep_")
    return (f"SELECT *, CASE WHEN ft_n >= 5 AND rep_n >= 5 THEN {O.js_round1('(ft_nps - rep_nps)')} END "
            f"AS nps_delta FROM ({s})")


def _cohort_tenure_sql() -> str:
    allt = ", ".join(O.q(t) for t in metrics.dims.TENURE_ORDER)
    inner = (f"SELECT tenure_cut AS member, {O.counts_if(_FT, 'ft_')}, {O.counts_if(_REP, 'rep_')} "
             f"FROM survey WHERE {_KNOWN} AND tenure_cut IN ({allt}) GROUP BY tenure_cut")
    order = O.order_case("member", metrics.dims.TENURE_ORDER)
    return O.with_survey(
        f"SELECT member, CAST(row_number() OVER (ORDER BY {order}, member) AS INTEGER) AS member_ord, "
        "ft_n, ft_nps, ft_confidence, rep_n, rep_nps, rep_confidence, nps_delta "
        f"FROM ({_split_stats_sql(inner)})")


@register("cohort_tenure", _cohort_tenure_sql())
def q_cohort_tenure(spark, sf_dir):
    return cohorts.cohort_by(rollup(spark, sf_dir), "tenure_cut")


def _cohort_city_sql() -> str:
    inner = (f"SELECT city, {O.counts_if(_FT, 'ft_')}, {O.counts_if(_REP, 'rep_')} "
             f"FROM survey WHERE {_KNOWN} AND city <> '' GROUP BY city")
    ranked = (f"SELECT city, CAST(row_number() OVER (ORDER BY ft_n + rep_n DESC, city) AS INTEGER) AS rank, "
              "ft_n + rep_n AS total, ft_n, ft_nps, rep_n, rep_nps, nps_delta "
              f"FROM ({_split_stats_sql(inner)}) WHERE ft_n + rep_n >= 10")
    return O.with_survey(f"SELECT * FROM ({ranked}) WHERE rank <= 8")


@register("cohort_city", _cohort_city_sql())
def q_cohort_city(spark, sf_dir):
    return cohorts.cohort_city(rollup(spark, sf_dir))


def _cohort_theme_sql() -> str:
    inner = (f"SELECT theme, CAST(count(*) FILTER (WHERE {_FT}) AS BIGINT) AS ft_count, "
             f"CAST(count(*) FILTER (WHERE {_REP}) AS BIGINT) AS rep_count FROM survey WHERE {_KNOWN} "
             "GROUP BY theme")
    tot = (f"SELECT count(*) FILTER (WHERE {_FT}) AS ftt, count(*) FILTER (WHERE {_REP}) AS rpt "
           f"FROM survey WHERE {_KNOWN}")
    body = (f"SELECT theme, {O.theme_label_sql('theme')} AS label, "
            "CAST(row_number() OVER (ORDER BY ft_count + rep_count DESC, theme) AS INTEGER) AS rank, "
            "ft_count + rep_count AS total, ft_count, rep_count, "
            f"{O.pct('ft_count', 'ftt')} AS ft_pct, {O.pct('rep_count', 'rpt')} AS rep_pct "
            f"FROM ({inner}) a, ({tot}) b WHERE theme <> '' AND ft_count + rep_count >= 3")
    return O.with_survey(f"SELECT * FROM ({body}) WHERE rank <= 8")


@register("cohort_theme", _cohort_theme_sql())
def q_cohort_theme(spark, sf_dir):
    return cohorts.cohort_theme(rollup(spark, sf_dir))


@register("cohort_verbatims", O.with_survey(
    "SELECT * FROM (SELECT CASE WHEN first_time_user = 'Yes' THEN 'first_time' ELSE 'repeat' END AS cohort, "
    "CAST(row_number() OVER (PARTITION BY first_time_user ORDER BY abs(score - 5) DESC, row_seq) AS INTEGER) AS rank, "
    "row_seq, respondent_id, sprint_id, score, score_band, theme, feedback "
    f"FROM survey WHERE {_KNOWN} AND {O.fb_gt(10)}) WHERE rank <= 8"))
def q_cohort_verbatims(spark, sf_dir):
    return cohorts.cohort_verbatims(rows(spark, sf_dir))


def _cohort_significance_sql() -> str:
    g, k = O.sprint_keys("sprint_id")
    per = (f"SELECT sprint_id AS period, CAST(row_number() OVER (ORDER BY {g}, {k}, sprint_id) AS INTEGER) "
           f"AS period_ord, {O.counts_if(_FT, 'ft_')}, {O.counts_if(_REP, 'rep_')} FROM survey "
           f"WHERE {_KNOWN} AND sprint_id <> '' GROUP BY sprint_id")
    tot = (f"SELECT 'All' AS period, CAST(0 AS INTEGER) AS period_ord, {O.counts_if(_FT, 'ft_')}, "
           f"{O.counts_if(_REP, 'rep_')} FROM survey WHERE {_KNOWN}")
    rel = O.with_nps_sql(O.with_nps_sql(f"{per} UNION ALL {tot}", "ft_"), "rep_")
    return O.with_survey(_ztest_sql(rel, "rep_", "ft_", "period, period_ord, rep_n, ft_n, rep_nps, ft_nps"))


@register("cohort_significance", _cohort_significance_sql())
def q_cohort_significance(spark, sf_dir):
    return cohorts.cohort_significance(rollup(spark, sf_dir))


# ---------------------------------------------------------------------------
# T3, F8, W3, T8 verbatims (default period: the last three sprints)
# ---------------------------------------------------------------------------

SEARCH_TEXT = "ation"

_TOP_SQL = (
    "SELECT *, CAST((rank - 1) // 30 + 1 AS INTEGER) AS page FROM ("
    "SELECT CAST(row_number() OVER (ORDER BY evoc_score DESC, row_seq) AS INTEGER) AS rank, row_seq, "
    "respondent_id, sprint_id, score, score_band, theme, evoc_score, feedback FROM ("
    "SELECT *, CAST(least(length(feedback), 300) + abs(score - 5) * 20 AS INTEGER) AS evoc_score FROM survey "
    f"WHERE sprint_id IN (SELECT sprint_id FROM recent) AND theme <> '' AND {O.fb_gt(5)})) WHERE rank <= 100")


def _top(spark, sf_dir) -> DataFrame:
    return topk.top_verbatims(metrics.recent_filter(survey_topk(spark, sf_dir), sprints_from=rollup(spark, sf_dir)))


@register("verbatims_top", O.with_survey(_TOP_SQL, [RECENT_CTE]))
def q_verbatims_top(spark, sf_dir):
    return _top(spark, sf_dir)


@register("verbatims_search", O.with_survey(
    f"SELECT * FROM ({_TOP_SQL}) WHERE contains(lower(feedback), {O.q(SEARCH_TEXT)})", [RECENT_CTE]))
def q_verbatims_search(spark, sf_dir):
    return verbatims.search(_top(spark, sf_dir), SEARCH_TEXT)


@register("verbatims_grouped", O.with_survey(
    f"SELECT g.theme, {O.theme_label_sql('g.theme')} AS label, gr.group_rank, g.group_size, "
    "CAST(greatest(g.group_size - 8, 0) AS BIGINT) AS more_in_group, g.item_rank, g.rank, g.row_seq, "
    "g.respondent_id, g.score, g.feedback FROM g JOIN gr ON gr.theme = g.theme WHERE g.item_rank <= 8",
    [RECENT_CTE, f"\ntop AS ({_TOP_SQL})",
     "\ng AS (SELECT *, count(*) OVER (PARTITION BY theme) AS group_size, min(rank) OVER (PARTITION BY theme) "
     "AS first_rank, CAST(row_number() OVER (PARTITION BY theme ORDER BY rank) AS INTEGER) AS item_rank FROM top)",
     "\ngr AS (SELECT theme, CAST(row_number() OVER (ORDER BY group_size DESC, first_rank) AS INTEGER) AS group_rank "
     "FROM (SELECT DISTINCT theme, group_size, first_rank FROM g))"]))
def q_verbatims_grouped(spark, sf_dir):
    return verbatims.grouped(_top(spark, sf_dir))


# ---------------------------------------------------------------------------
# S10 / W4 upsert, §4 rollup
# ---------------------------------------------------------------------------


def _clean_resend(spark, sf_dir) -> DataFrame:
    return clean_survey(survey_resend(spark, sf_dir), ingest_batch=1, src_file="survey_resend")


_UPSERT_SQL = O.with_survey(
    f"SELECT {', '.join(CLEAN_COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY sprint_id, respondent_id "
    "ORDER BY ingest_batch DESC, row_seq DESC) AS rn FROM (SELECT * FROM survey UNION ALL SELECT * FROM resend)) "
    "WHERE rn = 1",
    [O.SURVEY_RESEND, O.clean_cte("resend", "survey_resend", 1, "survey_resend")])


@register("upsert_latest", _UPSERT_SQL)
def q_upsert_latest(spark, sf_dir):
    return merge(rows(spark, sf_dir), _clean_resend(spark, sf_dir), full=True)


@register("rollup_nps", O.with_survey(O.with_nps_sql(
    f"SELECT quarter, source, first_time_user, {O.COUNTS} FROM survey GROUP BY quarter, source, first_time_user")))
def q_rollup_nps(spark, sf_dir):
    r = rollup(spark, sf_dir)
    agg = r.groupBy("quarter", "source", "first_time_user").agg(*_nps.count_aggs())
    return _nps.with_nps(agg)


# ---------------------------------------------------------------------------
# S1-S9, S11, S13 files; R1-R3 streaming
# ---------------------------------------------------------------------------


_NO_ENGINE = [c for c in CLEAN_COLUMNS if c not in ("row_seq", "ingest_batch", "file_order", "src_file")]
_CAL = [s[0] for s in metrics.dims.SPRINT_CALENDAR]
_WITH_SCORE_SQL = "sprint_id IN (" + ", ".join(O.q(s) for s in _CAL) + ")"
_LAYOUT_SQL = "CASE " + " ".join(
    f"WHEN sprint_id IN ({', '.join(O.q(s) for s in sprints)}) THEN '{layout}'"
    for layout, sprints in (("A", _CAL[0:7]), ("B", _CAL[7:14]), ("E", _CAL[14:18]), ("C", _CAL[18:]))) + " ELSE 'D' END"


def _file_key_sql(respondent: str) -> str:
    """The file that a survey row is written to: layout, sprint and range of respondents."""
    return (f"{_LAYOUT_SQL} || '_' || CASE WHEN sprint_id = '' THEN '_blank' "
            "ELSE replace(lower(sprint_id), ' ', '_') END || '_' || "
            f"CAST(CAST(regexp_extract({respondent}, '^([0-9]+)', 1) AS BIGINT) // "
            f"{survey_files.RESPONDENTS_PER_FILE} AS VARCHAR)")


def _with_lineage(clean: DataFrame, folder: str) -> DataFrame:
    """The survey columns, the folder value of each row's file, and whether the row knows its place:
    batch, file time, file and place in the file."""
    ordered = (F.col("ingest_batch").isNotNull() & (F.col("file_order") > 0) & (F.col("src_file") != "")
               & F.col("row_seq").isNotNull())
    return clean.select(*_NO_ENGINE, _folder_value(folder).alias("file_key"), ordered.alias("ordered"))


def _folder_value(folder: str) -> Column:
    return F.url_decode(F.regexp_extract("src_file", f"{folder}=([^/]+)/", 1))


@register("csv_ingest", O.with_survey(
    f"SELECT {', '.join(_NO_ENGINE)}, {_file_key_sql('respondent_id')} AS file_key, TRUE AS ordered "
    f"FROM survey WHERE {_WITH_SCORE_SQL}"))
def q_csv_ingest(spark, sf_dir):
    clean, _ = csv_ingest.ingest_csv(spark, survey_files.survey_csv_dir(spark, sf_dir))
    return _with_lineage(clean, "file_key")


def _file_reports_sql() -> str:
    """file_key, layout, records, skipped, warnings, status, errors of every file; rejected if it has no score."""
    ok = f"TRY_CAST(NULLIF(regexp_extract(trim(score, {O.WS}), '^([+-]?[0-9]+)', 1), '') AS DOUBLE) IS NOT NULL"
    d_err = "No score column found in headers: " + ", ".join(h for h, _ in survey_files.LAYOUTS["D"])
    per = (f"SELECT {_file_key_sql('respondent_id')} AS file_key, {_LAYOUT_SQL} AS layout, "
           f"CAST(count(*) FILTER (WHERE {ok}) AS BIGINT) AS ok_rows, "
           f"CAST(count(*) FILTER (WHERE NOT ({ok})) AS BIGINT) AS bad_rows FROM survey_raw GROUP BY 1, 2")
    body = (f"SELECT file_key, layout, CASE WHEN layout = 'D' THEN CAST(0 AS BIGINT) ELSE ok_rows END AS records, "
            f"CASE WHEN layout = 'D' THEN CAST(0 AS BIGINT) ELSE bad_rows END AS skipped, "
            f"CASE WHEN layout = 'D' THEN {O.q(d_err)} END AS header_error FROM ({per})")
    out = ("SELECT file_key, layout, records, skipped, header_error IS NOT NULL AS rejected, "
           "CAST((CASE WHEN header_error IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN skipped > 0 THEN 1 ELSE 0 END) "
           "AS INTEGER) AS warnings, "
           "concat_ws('; ', header_error, CASE WHEN skipped > 0 THEN 'Skipped ' || CAST(skipped AS VARCHAR) "
           "|| ' rows with invalid/missing scores' END) AS errors "
           f"FROM ({body})")
    return ("SELECT *, CASE WHEN warnings = 0 THEN 'OK' ELSE CAST(warnings AS VARCHAR) || ' warning(s)' END AS status "
            f"FROM ({out})")


def _ingest_report_sql() -> str:
    return O.with_survey(
        "SELECT file_key, records, skipped, warnings, status, errors, "
        f"CAST(count(*) OVER () AS BIGINT) AS log_length, TRUE AS newest_first FROM ({_file_reports_sql()})")


@register("ingest_report", _ingest_report_sql())
def q_ingest_report(spark, sf_dir):
    """The report's own columns; the log's order is checked as ranks 1..n that follow the file times."""
    _, report = csv_ingest.ingest_csv(spark, survey_files.survey_csv_dir(spark, sf_dir))
    log = Window.orderBy("log_rank")  # one row per file
    in_order = (F.row_number().over(log) == F.col("log_rank")) & (
        F.coalesce(F.lag("file_order").over(log), F.col("file_order")) >= F.col("file_order"))
    return report.select(
        F.regexp_extract("file", "file_key=([^/]+)/", 1).alias("file_key"), "records", "skipped", "warnings",
        "status", "errors", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("log_length"),
        in_order.alias("newest_first"))


@register("file_catalogue", O.with_survey(
    "SELECT k.file_key, CAST(COALESCE(c.responses, 0) AS BIGINT) AS responses, "
    f"CAST({O.cal_index('c.sprint_id')} AS INTEGER) AS sprint_ord, "
    "TRUE AS has_size, TRUE AS total_is_sum "
    f"FROM (SELECT DISTINCT {_file_key_sql('respondent_id')} AS file_key FROM survey_raw) k LEFT JOIN "
    f"(SELECT {_file_key_sql('respondent_id')} AS file_key, min(sprint_id) AS sprint_id, count(*) AS responses "
    f"FROM survey WHERE {_WITH_SCORE_SQL} GROUP BY 1) c ON c.file_key = k.file_key"))
def q_file_catalogue(spark, sf_dir):
    files = csv_ingest.csv_files(spark, survey_files.survey_csv_dir(spark, sf_dir))
    clean, _ = csv_ingest.ingest_files(spark, files)
    cat = survey_files.file_catalogue(spark, files, clean)
    total = F.sum("size").over(Window.partitionBy(F.lit(1)))  # one row per file
    return cat.select(
        F.regexp_extract("file", "file_key=([^/]+)/", 1).alias("file_key"), "responses",
        F.col("sprint_ord").cast("int").alias("sprint_ord"), (F.col("size") > 0).alias("has_size"),
        (total == F.col("total_size")).alias("total_is_sum"))


_MANIFEST_FILES_SQL = (
    f"SELECT {', '.join(_NO_ENGINE)}, file_key, CAST(dense_rank() OVER (ORDER BY file_key DESC) AS BIGINT) AS place "
    f"FROM (SELECT *, {_file_key_sql('respondent_id')} AS file_key FROM survey WHERE {_WITH_SCORE_SQL} "
    f"AND {_LAYOUT_SQL} <> 'A')")


@register("manifest_ingest", O.with_survey(
    f"SELECT * FROM ({_MANIFEST_FILES_SQL}) UNION ALL "
    f"SELECT {', '.join(_NO_ENGINE)}, file_key, last + 1 AS place FROM "
    f"(SELECT *, max(place) OVER () AS last FROM ({_MANIFEST_FILES_SQL})) WHERE place = 1"))
def q_manifest_ingest(spark, sf_dir):
    """A manifest of some of the survey's files, last file key first and that file again at the end,
    with one that does not exist."""
    keys = _csv_files_by_key(spark, sf_dir)
    chosen = [keys[k] for k in sorted(keys, reverse=True) if k[0] in "BCE"]
    manifest = _write_manifest(spark, lambda folder: [folder + "/gone.csv", *chosen, *chosen[:1]])
    clean, _ = csv_ingest.ingest_manifest(spark, manifest)
    return clean.select(*_NO_ENGINE, _folder_value("file_key").alias("file_key"), F.col("file_order").alias("place"))


def _csv_files_by_key(spark, sf_dir) -> dict[str, str]:
    """file_key -> path; one entry per file."""
    listing = list_files(spark, [survey_files.survey_csv_dir(spark, sf_dir)]).select("path").collect()
    return {r.path.split("file_key=")[1].split("/")[0]: r.path for r in listing}


def _write_manifest(spark, entries) -> str:
    manifest = scratch_path(spark, "manifest")
    spark.createDataFrame([(json.dumps(entries(manifest)),)], "value string").coalesce(1).write.text(manifest)
    return manifest


_LOG_KINDS = (("batch", "AD"), ("manifest", "B"), ("stream", "CE"))


def _ingest_log_sql() -> str:
    kind = "CASE " + " ".join(f"WHEN layout IN ({', '.join(O.q(x) for x in layouts)}) THEN '{name}'"
                              for name, layouts in _LOG_KINDS) + " END"
    return O.with_survey(
        "SELECT *, CAST(count(*) OVER () AS BIGINT) AS log_length, TRUE AS newest_first FROM ("
        f"SELECT {kind} AS kind, file_key, records, skipped, warnings, status, errors, rejected, rejected AS dead "
        f"FROM ({_file_reports_sql()}) UNION ALL "
        "SELECT 'manifest', 'gone.csv', 0, 0, 1, '1 warning(s)', 'File not found', TRUE, TRUE)")


@register("ingest_log", _ingest_log_sql())
def q_ingest_log(spark, sf_dir):
    """One log of a batch load, a manifest load and a stream, newest first; the batch load is logged
    twice under its name.  ``dead`` marks files that the next trigger would look at again."""
    log, folder = scratch_path(spark, "ingest_log"), survey_files.survey_csv_dir(spark, sf_dir)
    keys = _csv_files_by_key(spark, sf_dir)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    _, loaded = csv_ingest.ingest_csv(spark, [f"{folder}/{layout}" for layout in _LOG_KINDS[0][1]])
    append_log(loaded, log, "load-1", "batch", start)
    manifest = _write_manifest(spark, lambda at: [at + "/gone.csv", *(p for k, p in sorted(keys.items()) if k[0] == "B")])
    append_log(csv_ingest.ingest_manifest(spark, manifest)[1], log, "load-2", "manifest", start + dt.timedelta(hours=1))
    ingest_stream.run_available(spark, f"{folder}/[{_LOG_KINDS[2][1]}]", scratch_path(spark, "log_table"),
                                scratch_path(spark, "log_ckpt"), log_path=log)
    append_log(loaded, log, "load-1", "batch", start)  # the same load again
    order = Window.orderBy("log_rank")  # one row per file and ingest
    newest = F.coalesce(F.lag("logged_at").over(order), F.col("logged_at")) >= F.col("logged_at")
    dead = dead_letters(spark, log).select("file", F.lit(True).alias("dead"))
    return read_log(spark, log).withColumn("newest_first", newest).join(dead, "file", "left").select(
        "kind", F.coalesce(F.nullif(F.regexp_extract("file", "file_key=([^/]+)/", 1), F.lit("")), "file_name").alias("file_key"),
        "records", "skipped", "warnings", "status", F.regexp_replace("errors", "^(File not found): .*", "$1").alias("errors"),
        "rejected", F.coalesce("dead", F.lit(False)).alias("dead"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("log_length"), "newest_first")


@register("csv_roundtrip", O.with_survey(
    f"SELECT {', '.join(_NO_ENGINE)}, sprint_part AS file_key, TRUE AS ordered FROM survey"))
def q_csv_roundtrip(spark, sf_dir):
    out = scratch_path(spark, "export")
    survey_files.export_csv(rows(spark, sf_dir), out)
    clean, _ = csv_ingest.ingest_csv(spark, out)
    return _with_lineage(clean, "sprint_part")


@register("export_one_sprint", O.with_survey(
    f"SELECT {', '.join(_NO_ENGINE)}, sprint_part AS file_key, TRUE AS ordered FROM survey "
    "WHERE sprint_id = 'Sprint 13'"))
def q_export_one_sprint(spark, sf_dir):
    out = scratch_path(spark, "export")
    survey_files.export_csv(rows(spark, sf_dir), out, sprint="Sprint 13")
    clean, _ = csv_ingest.ingest_csv(spark, out)
    return _with_lineage(clean, "sprint_part")


_RESEND_CTES = [O.SURVEY_RESEND, O.clean_cte("resend", "survey_resend", 1, "survey_resend")]


@register("stream_upsert", O.with_survey(
    f"SELECT {', '.join(_NO_ENGINE)} FROM (SELECT *, row_number() OVER (PARTITION BY sprint_id, respondent_id "
    "ORDER BY ingest_batch DESC, row_seq DESC) AS rn FROM (SELECT * FROM survey UNION ALL SELECT * FROM resend)) "
    f"WHERE rn = 1 AND {_WITH_SCORE_SQL}", _RESEND_CTES))
def q_stream_upsert(spark, sf_dir):
    """Three arrivals: the survey's files with most layouts, then the layout left out, then a re-send."""
    landing = scratch_path(spark, "landing")
    table, ckpt = scratch_path(spark, "stream_table"), scratch_path(spark, "stream_ckpt")
    layouts = list(survey_files.LAYOUTS)
    for number, (raw, chosen) in enumerate((
            (survey_raw(spark, sf_dir), layouts[1:]), (survey_raw(spark, sf_dir), layouts[:1]),
            (survey_resend(spark, sf_dir), survey_files.layouts_for(RESENT_SPRINTS)))):
        survey_files.write_survey_csvs(raw, f"{landing}/arrival {number}", layouts=chosen)
        ingest_stream.run_available(spark, landing, table, ckpt)
    return read_clean(spark, table).select(*_NO_ENGINE)


@register("upsert_rollup", O.with_survey(O.with_nps_sql(
    f"SELECT quarter, source, first_time_user, {O.COUNTS} FROM (SELECT * FROM survey "
    f"WHERE sprint_id NOT IN ({', '.join(O.q(s) for s in RESENT_SPRINTS)}) UNION ALL "
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sprint_id, respondent_id "
    "ORDER BY ingest_batch DESC, row_seq DESC) AS rn FROM (SELECT * FROM survey WHERE sprint_id IN "
    f"({', '.join(O.q(s) for s in RESENT_SPRINTS)}) UNION ALL SELECT * FROM resend)) WHERE rn = 1) "
    "GROUP BY quarter, source, first_time_user"), _RESEND_CTES))
def q_upsert_rollup(spark, sf_dir):
    """Section 4: an upsert rebuilds the touched sprints of the rollup; NPS is read from the rollup."""
    table, kept = scratch_path(spark, "upsert_table"), scratch_path(spark, "upsert_rollup")
    write_clean(survey_rows(spark, sf_dir), table)
    write_rollup(build_rollup(read_clean(spark, table)), kept)
    upsert_into(spark, table, _clean_resend(spark, sf_dir), rollup_path=kept)
    agg = read_rollup(spark, kept).groupBy("quarter", "source", "first_time_user").agg(*_nps.count_aggs())
    return _nps.with_nps(agg)


_TOUCHED_SQL = f"sprint_id IN ({', '.join(O.q(s) for s in RESENT_SPRINTS)})"


@register("upsert_versions", O.with_survey(
    f"SELECT {', '.join(_NO_ENGINE)}, FALSE AS resent FROM survey WHERE NOT {_TOUCHED_SQL} UNION ALL "
    f"SELECT {', '.join(_NO_ENGINE)}, ingest_batch = 1 AS resent FROM (SELECT *, row_number() OVER (PARTITION BY sprint_id, "
    "respondent_id ORDER BY ingest_batch DESC, row_seq DESC) AS rn "
    f"FROM (SELECT * FROM survey WHERE {_TOUCHED_SQL} UNION ALL SELECT * FROM resend)) WHERE rn = 1", _RESEND_CTES))
def q_upsert_versions(spark, sf_dir):
    """The re-sent sprints merged into a versioned table; the version before stays as it was."""
    table = VersionedTable(spark, scratch_path(spark, "versions"))
    first = table.replace(survey_rows(spark, sf_dir))
    table.upsert(_clean_resend(spark, sf_dir))
    if table.version(first.number).parts != first.parts:
        raise RuntimeError("an earlier version has changed")
    return table.read().select(*_NO_ENGINE, (F.col("ingest_batch") == 1).alias("resent"))


_FILTERED_TOP_SQL = (
    "SELECT *, CAST((rank - 1) // 30 + 1 AS INTEGER) AS page FROM ("
    "SELECT CAST(row_number() OVER (ORDER BY evoc_score DESC, row_seq) AS INTEGER) AS rank, row_seq, "
    "respondent_id, sprint_id, score, score_band, theme, evoc_score, feedback FROM ("
    "SELECT *, CAST(least(length(feedback), 300) + abs(score - 5) * 20 AS INTEGER) AS evoc_score FROM survey "
    f"WHERE theme <> '' AND score_band = 'detractor' AND theme = 'reliability' AND {O.fb_gt(5)})) "
    "WHERE rank <= 100")


@register("verbatims_filtered", O.with_survey(_FILTERED_TOP_SQL))
def q_verbatims_filtered(spark, sf_dir):
    """T3 with the band (F5) and theme (F6) selections over all periods."""
    return topk.top_verbatims(survey_topk(spark, sf_dir), FilterSpec(band="detractor", theme="reliability"))


@register("verbatims_after_upsert", O.with_survey(
    "SELECT *, CAST((rank - 1) // 30 + 1 AS INTEGER) AS page FROM ("
    "SELECT CAST(row_number() OVER (ORDER BY evoc_score DESC, row_seq) AS INTEGER) AS rank, row_seq, "
    "respondent_id, sprint_id, score, score_band, theme, evoc_score, feedback FROM ("
    "SELECT *, CAST(least(length(feedback), 300) + abs(score - 5) * 20 AS INTEGER) AS evoc_score FROM ("
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sprint_id, respondent_id "
    "ORDER BY ingest_batch DESC, row_seq DESC) AS rn "
    f"FROM (SELECT * FROM survey WHERE {_TOUCHED_SQL} UNION ALL SELECT * FROM resend)) WHERE rn = 1) "
    f"WHERE theme <> '' AND score_band = 'promoter' AND sprint_id = {O.q(RESENT_SPRINTS[0])} AND {O.fb_gt(5)})) "
    "WHERE rank <= 20", _RESEND_CTES))
def q_verbatims_after_upsert(spark, sf_dir):
    """T3 from the stored top comments after an upsert that replaced some of them."""
    table, kept = scratch_path(spark, "topk_survey"), scratch_path(spark, "topk_kept")
    write_clean(rows(spark, sf_dir).filter(F.col("sprint_id").isin(*RESENT_SPRINTS)), table)
    topk.build(read_clean(spark, table), kept)
    upsert_into(spark, table, _clean_resend(spark, sf_dir), topk_path=kept)
    spec = FilterSpec(grain="sprint", period=RESENT_SPRINTS[0], band="promoter")
    return topk.top_verbatims(topk.read(spark, kept), spec, limit=20)


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
