"""DuckDB oracle SQL for the registered queries.

Each oracle re-derives the survey rows from the driver's tables and re-applies
the cleaning rules in plain SQL, then computes the query.  Fixed values
(calendar, orders, labels, sentences) and the fixture's constants come from the
same tables as the engine's; the logic is written again.  Rounding is written as ``floor(x + 0.5)`` (JavaScript
half-up) and every ratio is guarded, as in the engine.
"""

from __future__ import annotations

from promoscope.functions.columns import JS_WHITESPACE
from promoscope.sources import dims
from promoscope.sources.driver_tables import DERIVED_REASONS, RESENT_SPRINTS

WS = "(" + " || ".join(f"chr({ord(c)})" for c in JS_WHITESPACE) + ")"
WS_CLASS = "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in JS_WHITESPACE) + "]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], names: list[str]) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")"
                     for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"


SURVEY_RAW = f"""
survey_raw AS (
  SELECT
    o.o_orderkey AS row_seq,
    CAST(o.o_custkey AS VARCHAR) || CASE WHEN o.o_orderkey % 7 = 0 THEN '.0' ELSE '' END AS respondent_id,
    CASE WHEN o.o_orderkey % 101 = 0 THEN 'n/a'
         ELSE CAST(CAST(floor(o.o_totalprice / 45000) AS BIGINT) + c.c_nationkey % 3 - 1 AS VARCHAR)
              || CASE WHEN o.o_orderkey % 53 = 0 THEN '.5' ELSE '' END END AS score,
    COALESCE(d.text, '') AS feedback,
    COALESCE(t.reason, '') AS nps_reason_primary,
    c.c_mktsegment AS plan_type,
    CASE c.c_nationkey WHEN 24 THEN '#REF!' WHEN 23 THEN 'Unknown' ELSE n.n_name END AS city,
    CAST(o.o_orderkey % 400 - 20 AS VARCHAR) AS tenure_days,
    CASE o.o_orderkey % 17 WHEN 0 THEN 'Early (1-2 mo)' WHEN 1 THEN 'Unknown' ELSE '' END AS tenure_cut,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Call' WHEN '2-HIGH' THEN ' wa ' WHEN '3-MEDIUM' THEN 'CT'
         WHEN '4-NOT SPECIFIED' THEN '' ELSE 'Email' END AS source,
    CASE WHEN s.k <= 13 THEN 'Sprint ' || CAST(s.k + 1 AS VARCHAR)
         WHEN s.k <= 20 THEN 'Sprint RSP' || CAST(s.k - 13 AS VARCHAR)
         WHEN s.k = 21 THEN 'Pilot' ELSE '' END AS sprint_id,
    CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AS sprint_start,
    CASE o.o_custkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No, had wifi' WHEN 2 THEN 'First time'
         WHEN 3 THEN 'नहीं' WHEN 4 THEN '' ELSE 'पहले वाई-फाई' END AS first_time_user
  FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN (SELECT o_orderkey AS ok,
               (year(o_orderdate) * 24 + (month(o_orderdate) - 1) * 2
                + CASE WHEN day(o_orderdate) > 15 THEN 1 ELSE 0 END) % 23 AS k
        FROM orders) s ON s.ok = o.o_orderkey
  LEFT JOIN documents d ON d.doc_id = o.o_orderkey
  LEFT JOIN {values([(i, r) for i, r in enumerate(DERIVED_REASONS)], ['k', 'reason'])}
    ON t.k = o.o_orderkey % 26
)"""

SURVEY_RESEND = f"""
survey_resend AS (
  SELECT row_seq + 1000000000 AS row_seq, respondent_id, CAST((row_seq + 3) % 11 AS VARCHAR) AS score,
         feedback, nps_reason_primary, plan_type, city, tenure_days, tenure_cut, source,
         sprint_id, sprint_start, first_time_user
  FROM survey_raw WHERE sprint_id IN ({', '.join(q(s) for s in RESENT_SPRINTS)})
)"""


def clean_cte(name: str, src: str, ingest_batch: int, src_file: str, reason_theme=None, calendar=None,
              source_alias=None) -> str:
    """SQL cleaning of a raw survey relation (P1-P12); tables given as rows replace the built-in ones."""
    def tr(c: str) -> str:
        return f"trim(COALESCE({c}, ''), {WS})"

    def num(c: str) -> str:
        return f"TRY_CAST(NULLIF(regexp_extract({c}, '^([+-]?[0-9]+)', 1), '') AS DOUBLE)"

    themes = values(reason_theme or dims.REASON_THEME, ["t_reason", "theme"])
    cal = values([(s[0], s[3], s[4]) for s in calendar or dims.SPRINT_CALENDAR], ["c_sid", "month", "quarter"])
    src_alias = values(source_alias or dims.SOURCE_ALIAS, ["alias", "canonical"])
    return f"""
{name}_t AS (
  SELECT row_seq, {tr('respondent_id')} AS rid, {tr('score')} AS sc, {tr('feedback')} AS fb,
         {tr('nps_reason_primary')} AS reason, '' AS reason2, {tr('plan_type')} AS plan,
         {tr('city')} AS city0, {tr('tenure_days')} AS td0, {tr('tenure_cut')} AS tc0,
         {tr('source')} AS src0, {tr('sprint_id')} AS sid, {tr('sprint_start')} AS sstart,
         lower({tr('first_time_user')}) AS ft0
  FROM {src}
),
{name}_p AS (
  SELECT *, {num('sc')} AS score_num, {num('td0')} AS td_num FROM {name}_t
),
{name}_q AS (
  SELECT p.*,
    CAST(least(greatest(score_num, 0), 10) AS INTEGER) AS score_i,
    CAST(CASE WHEN td_num IS NULL OR td_num < 0 THEN 0 ELSE least(td_num, 2147483647) END AS INTEGER) AS td
  FROM {name}_p p WHERE score_num IS NOT NULL
),
{name} AS (
  SELECT CAST(row_seq AS BIGINT) AS row_seq, CAST({ingest_batch} AS BIGINT) AS ingest_batch,
    CAST(0 AS BIGINT) AS file_order,
    {q(src_file)} AS src_file,
    regexp_replace(rid, '\\.0$', '') AS respondent_id,
    score_i AS score,
    CASE WHEN score_i >= 9 THEN 'promoter' WHEN score_i >= 7 THEN 'passive' ELSE 'detractor' END AS score_band,
    fb AS feedback, reason AS nps_reason_primary, reason2 AS nps_reason_secondary,
    plan AS plan_type,
    CASE WHEN lower(city0) IN ('#ref!', 'unknown', 'nan', '') THEN '' ELSE city0 END AS city,
    td AS tenure_days,
    CASE WHEN tc0 <> '' AND tc0 <> 'Unknown' THEN tc0
         WHEN td <= 0 THEN 'Unknown' WHEN td <= 60 THEN 'Early (1-2 mo)'
         WHEN td <= 180 THEN 'Mid (3-6 mo)' ELSE 'Long (6+ mo)' END AS tenure_cut,
    CASE WHEN src0 = '' THEN 'Unknown' ELSE COALESCE(sa.canonical, src0) END AS source,
    sid AS sprint_id, sstart AS sprint_start,
    CASE WHEN starts_with(ft0, 'yes') OR contains(ft0, 'first') OR contains(ft0, 'पहले वाई') THEN 'Yes'
         WHEN starts_with(ft0, 'no') OR starts_with(ft0, 'नहीं') OR contains(ft0, 'had') THEN 'No'
         ELSE '' END AS first_time_user,
    COALESCE(th.theme, '') AS theme,
    COALESCE(cal.month, '') AS month, COALESCE(cal.quarter, '') AS quarter,
    CASE WHEN sid = '' THEN '_blank' ELSE sid END AS sprint_part
  FROM {name}_q
  LEFT JOIN (SELECT * FROM {themes}) th ON th.t_reason = {name}_q.reason
  LEFT JOIN (SELECT * FROM {cal}) cal ON cal.c_sid = {name}_q.sid
  LEFT JOIN (SELECT * FROM {src_alias}) sa ON sa.alias = lower({name}_q.src0)
)"""


def sentence(text: str, *values_: str) -> str:
    """SQL of a fixed sentence with its numbers put in."""
    first, *rest = text.split("{}")
    return " || ".join([q(first), *(x for v, after in zip(values_, rest) for x in (v, q(after)))])


def with_survey(body: str, extra_ctes: list[str] | None = None) -> str:
    ctes = [SURVEY_RAW, clean_cte("survey", "survey_raw", 0, "survey_raw")]
    ctes += extra_ctes or []
    return "WITH " + ",".join(ctes) + "\n" + body


# ---------------------------------------------------------------------------
# SQL snippets for NPS statistics over count columns
# ---------------------------------------------------------------------------

def nps_expr(p: str = "") -> str:
    n, pro, det = f"{p}n", f"{p}promoters", f"{p}detractors"
    return (f"CASE WHEN {n} > 0 THEN CAST(floor(({pro} / {n} - {det} / {n}) * 1000 + 0.5) AS DOUBLE) / 10 "
            f"ELSE 0.0 END")


def var_expr(p: str = "") -> str:
    n, pro, det = f"{p}n", f"{p}promoters", f"{p}detractors"
    pp = f"(CASE WHEN {n} > 0 THEN {pro} / {n} ELSE 0.0 END)"
    pd = f"(CASE WHEN {n} > 0 THEN {det} / {n} ELSE 0.0 END)"
    return (f"(CASE WHEN {n} > 0 THEN ({pp} * (1 - {pp}) + {pd} * (1 - {pd}) + 2 * {pp} * {pd}) / {n} "
            f"ELSE 0.0 END)")


def with_nps_sql(inner: str, p: str = "") -> str:
    """Wrap a relation having {p}n/{p}promoters/{p}detractors with nps, CI, confidence."""
    se = f"(sqrt({var_expr(p)}) * 100)"
    n = f"{p}n"
    step1 = f"SELECT *, {nps_expr(p)} AS {p}nps, {se} AS {p}_se FROM ({inner})"
    step2 = (f"SELECT * EXCLUDE ({p}_se), "
             f"CASE WHEN {n} > 0 THEN CAST(floor(({p}nps - 1.96 * {p}_se) * 10 + 0.5) AS DOUBLE) / 10 ELSE 0.0 END AS {p}ci_lower, "
             f"CASE WHEN {n} > 0 THEN CAST(floor(({p}nps + 1.96 * {p}_se) * 10 + 0.5) AS DOUBLE) / 10 ELSE 0.0 END AS {p}ci_upper "
             f"FROM ({step1})")
    w = f"({p}ci_upper - {p}ci_lower)"
    step3 = (f"SELECT *, CASE WHEN {n} = 0 THEN 'none' WHEN {n} >= 100 AND {w} < 15 THEN 'high' "
             f"WHEN {n} >= 30 AND {w} < 25 THEN 'medium' ELSE 'low' END AS {p}confidence FROM ({step2})")
    return step3


COUNTS = ("CAST(count(*) AS BIGINT) AS n, "
          "CAST(count(*) FILTER (WHERE score >= 9) AS BIGINT) AS promoters, "
          "CAST(count(*) FILTER (WHERE score BETWEEN 7 AND 8) AS BIGINT) AS passives, "
          "CAST(count(*) FILTER (WHERE score <= 6) AS BIGINT) AS detractors")


def counts_if(cond: str, p: str) -> str:
    return (f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS {p}n, "
            f"CAST(count(*) FILTER (WHERE {cond} AND score >= 9) AS BIGINT) AS {p}promoters, "
            f"CAST(count(*) FILTER (WHERE {cond} AND score BETWEEN 7 AND 8) AS BIGINT) AS {p}passives, "
            f"CAST(count(*) FILTER (WHERE {cond} AND score <= 6) AS BIGINT) AS {p}detractors")


def js_round(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS DOUBLE)"


def js_round1(x: str) -> str:
    return f"(CAST(floor({x} * 10 + 0.5) AS DOUBLE) / 10)"


def pct(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST(floor({num} / {den} * 100 + 0.5) AS DOUBLE) ELSE 0.0 END"


def fb_gt(k: int, c: str = "feedback") -> str:
    """Trimmed comment longer than k characters (no text beyond the BMP in the inputs)."""
    return f"length({c}) > {k}"


def js_num(x: str) -> str:
    return (f"CASE WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({x} AS VARCHAR) END")


def int_prefix(c: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract(ltrim({c}, {WS}), '^([+-]?[0-9]+)', 1), '') AS DOUBLE)"


def sprint_keys(c: str) -> tuple[str, str]:
    """(group, number) of the sprint sort key."""
    s = f"regexp_replace({c}, 'Sprint ', '')"
    is_rsp = f"starts_with(upper({s}), 'RSP')"
    rsp_num = f"COALESCE({int_prefix(f'substr({s}, 4)')}, 99.0)"
    num = int_prefix(s)
    g = f"(CASE WHEN {is_rsp} THEN 2 WHEN {num} IS NOT NULL THEN 1 ELSE 3 END)"
    k = f"(CASE WHEN {is_rsp} THEN {rsp_num} WHEN {num} IS NOT NULL THEN {num} ELSE 0.0 END)"
    return g, k


def order_case(c: str, values_: list[str]) -> str:
    whens = " ".join(f"WHEN {q(v)} THEN {i}" for i, v in enumerate(values_))
    return f"(CASE {c} {whens} END)"


def cal_index(c: str) -> str:
    whens = " ".join(f"WHEN {q(s[0])} THEN {i}" for i, s in enumerate(dims.SPRINT_CALENDAR))
    return f"(CASE {c} {whens} ELSE 999 END)"


def label_case(c: str, idx: int) -> str:
    whens = " ".join(f"WHEN {q(s[0])} THEN {q(s[idx])}" for s in dims.SPRINT_CALENDAR)
    return f"COALESCE((CASE {c} {whens} END), {c})"


def theme_label_sql(c: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in dims.THEME_LABEL)
    return f"COALESCE((CASE {c} {whens} END), {c})"
