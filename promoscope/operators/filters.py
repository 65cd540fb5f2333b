"""The filter spec shared by every view.

A ``FilterSpec`` is applied as plain ``filter`` predicates, so Catalyst pushes
them into the parquet scan (sprint filters prune ``sprint_part`` directories;
month / quarter filters become row-group predicates).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoscope.operators.ordering import GRAIN_KEY
from promoscope.sources import dims


@dataclass(frozen=True)
class FilterSpec:
    """Selections of the dashboard views.

    grain / period: F1 period equality (``period=None`` = all periods).
    channels:       F3 channel IN-list (None = all).  The reference applies the
                    list only when it is a proper non-empty subset of the
                    channels present; ``guard_channels`` reproduces that.
    tenures:        F4 tenure IN-list, same guard over the ordered tenures present.
    band / theme:   F5 / F6 equality.
    """

    grain: str = "sprint"
    period: str | None = None
    channels: tuple[str, ...] | None = None
    tenures: tuple[str, ...] | None = None
    band: str | None = None
    theme: str | None = None
    guard_channels: bool = True


def apply_period(df: DataFrame, grain: str, period: str | None) -> DataFrame:
    if period is None:
        return df
    key = GRAIN_KEY[grain]
    if key == "sprint_id":
        # prune partition directories as well as rows
        part = "_blank" if period == "" else period
        if "sprint_part" in df.columns:
            df = df.filter(F.col("sprint_part") == part)
    return df.filter(F.col(key) == period)


def apply_filters(df: DataFrame, spec: FilterSpec, base: DataFrame | None = None) -> DataFrame:
    """Apply F1, F3, F4, F5, F6 in the reference's order (period, channel, tenure).

    The channel / tenure guards compare the selection with the members present
    in ``base`` (default: ``df`` before filtering).
    """
    base = df if base is None else base
    df = apply_period(df, spec.grain, spec.period)
    wanted = [t for t in dims.TENURE_ORDER if t in (spec.tenures or ())]
    channel = F.col("source").isin(*(spec.channels or ()))
    tenure = F.col("tenure_cut").isin(*wanted)
    if wanted or (spec.channels and spec.guard_channels):
        # which of the two selections hold, by number: both, the tenures, the channels, none
        held = [channel & tenure, tenure, channel, F.lit(True)]
        df = df.filter(F.element_at(F.array(*held), _guards(base, spec, wanted)))
    elif spec.channels:
        df = df.filter(channel)
    if spec.band is not None:
        df = df.filter(F.col("score_band") == spec.band)
    if spec.theme is not None:
        df = df.filter(F.col("theme") == spec.theme)
    return df


def _guards(base: DataFrame, spec: FilterSpec, wanted: list[str]) -> Column:
    """The number (from 1) of the selections that hold, by the members that the whole table has.

    One scalar subquery, run with the query itself: the channel list counts where it is shorter than the
    list of channels present, the tenures where they are some but not all of the ones present.
    """
    t = F.col("tenure_cut")
    there = lambda ts: sum((F.coalesce(F.max((t == x).cast("int")), F.lit(0)) for x in ts), F.lit(0))
    any_channel, any_tenure = F.lit(not spec.channels), F.lit(not wanted)
    if spec.channels and spec.guard_channels:
        any_channel = F.count_distinct(F.when(F.col("source") != "", F.col("source"))) <= len(set(spec.channels))
    if wanted:
        any_tenure = (there(wanted) == 0) | (there(wanted) >= there(dims.TENURE_ORDER))
    return base.agg((F.lit(1) + any_channel.cast("int") + 2 * any_tenure.cast("int")).alias("g")).scalar()


def drop_unknown(df: DataFrame, col: str) -> DataFrame:
    """drop blank / 'Unknown' members (after totals are computed)."""
    return df.filter(~F.col(col).isin("", "Unknown"))
