"""Period and dimension orderings as sort-key columns.

Orderings are computed on *aggregated* frames (one row per member), so a
global window or sort over them is tiny.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promoscope.functions.columns import JS_WHITESPACE, js_int_prefix, replace_first
from promoscope.sources import dims

GRAIN_KEY = {"sprint": "sprint_id", "month": "month", "quarter": "quarter"}


def _parse_int_lenient(c: Column) -> Column:
    """parseInt skips leading white space."""
    return js_int_prefix(F.ltrim(c, F.lit(JS_WHITESPACE)))


def sprint_sort_keys(sprint_id: Column) -> tuple[Column, Column]:
    """(group, number): numbered sprints, then RSP sprints, then others."""
    s = replace_first(sprint_id, "Sprint ")
    is_rsp = F.upper(s).startswith("RSP")
    rsp_num = F.coalesce(_parse_int_lenient(F.substring(s, 4, 1 << 30)), F.lit(99.0))
    num = _parse_int_lenient(s)
    group = F.when(is_rsp, F.lit(2)).when(num.isNotNull(), F.lit(1)).otherwise(F.lit(3))
    number = F.when(is_rsp, rsp_num).when(num.isNotNull(), num).otherwise(F.lit(0.0))
    return group, number


def member_sort_keys(dim: str, member: Column) -> list[Column]:
    """Sort keys for the members of a matrix / summary axis.

    Sprints follow the calendar (unknown ones last, 999); month, quarter and
    tenure follow their fixed order (members outside it are dropped by the
    caller, see ``member_kept``); everything else is lexicographic.
    """
    if dim == "sprint_id":
        return [dims.calendar_index(member), member]
    if dim == "month":
        return [dims.order_index(dims.MONTH_ORDER, member)]
    if dim == "quarter":
        return [dims.order_index(dims.QUARTER_ORDER, member)]
    if dim == "tenure_cut":
        return [dims.order_index(dims.TENURE_ORDER, member)]
    return [member]


def member_kept(dim: str, member: Column) -> Column:
    """Members of ordered dimensions outside the fixed order vanish (Q13)."""
    if dim == "month":
        return dims.order_index(dims.MONTH_ORDER, member).isNotNull()
    if dim == "quarter":
        return dims.order_index(dims.QUARTER_ORDER, member).isNotNull()
    if dim == "tenure_cut":
        return dims.order_index(dims.TENURE_ORDER, member).isNotNull()
    return F.lit(True)


def period_sort_keys(grain: str, period: Column) -> list[Column]:
    """Order of trend periods: sprint key (T1) or the fixed month / quarter order."""
    if grain == "sprint":
        g, num = sprint_sort_keys(period)
        return [g, num, period]
    if grain == "month":
        return [dims.order_index(dims.MONTH_ORDER, period)]
    return [dims.order_index(dims.QUARTER_ORDER, period)]


def period_kept(grain: str, period: Column) -> Column:
    """Trend periods: non-blank sprints; months / quarters of the fixed order."""
    if grain == "sprint":
        return period != ""
    return member_kept(GRAIN_KEY[grain], period)


def period_labels(grain: str, period: Column) -> tuple[Column, Column]:
    """(label, full_label) of a trend period."""
    if grain == "sprint":
        return (F.coalesce(dims.sprint_short_map()[period], period),
                F.coalesce(dims.sprint_full_map()[period], period))
    if grain == "month":
        return F.regexp_replace(period, "^(.*?) '2[0-9]", "$1"), period
    return F.substring_index(period, " (", 1), period
