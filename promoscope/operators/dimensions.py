"""Dimension tables that a user brings along, in place of the built-in ones.

``Dimensions`` holds DataFrames; a table that is not given stays the built-in literal map (no join).  A
given table is looked up by a left join.  It is reduced to a row per key first, so it can never multiply
rows: a key that is repeated with other values is an error when the lookup runs, equal repeats are one,
and null keys match nothing.  Nothing is hinted: Spark broadcasts a table whose size it knows to be small
and shuffles a larger one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimensions:
    """User tables: sprint_calendar (sprint_id, full_label, short_label, month, quarter, sprint_ord),
    reason_theme (reason, theme), theme_label (theme, label), source_alias (alias, canonical; aliases in
    any case), month_order (month, ord), quarter_order (quarter, ord).

    Without an order table of its own, a calendar orders its months and quarters by their first sprint.
    """

    sprint_calendar: DataFrame | None = None
    reason_theme: DataFrame | None = None
    theme_label: DataFrame | None = None
    source_alias: DataFrame | None = None
    month_order: DataFrame | None = None
    quarter_order: DataFrame | None = None

    def period_order(self, grain: str) -> DataFrame | None:
        """(month or quarter, ord), or None if the built-in order holds."""
        table = {"month": self.month_order, "quarter": self.quarter_order}[grain]
        if table is not None or self.sprint_calendar is None:
            return table
        return (self.sprint_calendar.filter(F.col(grain) != "")
                .groupBy(grain).agg(F.min("sprint_ord").alias("ord")))


def one_row_per_key(table: DataFrame, key: Column, values: dict[str, str]) -> DataFrame:
    """(_key, and each value under its new name); a key with different values is an error."""
    row = F.struct(*(F.col(c).alias(name) for name, c in values.items()))
    per = (table.select(key.alias("_key"), row.alias("_row")).filter(F.col("_key").isNotNull())
           .groupBy("_key").agg(F.min("_row").alias("_row"), F.max("_row").alias("_last")))
    said = F.concat(F.lit("repeated key in a dimension table: "), F.col("_key").cast("string"))
    once = F.when(F.col("_row").eqNullSafe(F.col("_last")), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    return per.filter(once).select("_key", *(F.col(f"_row.{name}").alias(name) for name in values))


def look_up(df: DataFrame, on: Column, table: DataFrame, key: str | Column, values: dict[str, str],
            how: str = "left") -> DataFrame:
    """``df`` with the columns ``values`` (new name -> column of ``table``) of the row whose key is ``on``."""
    found = one_row_per_key(table, F.col(key) if isinstance(key, str) else key, values)
    return df.join(found, on == F.col("_key"), how).drop("_key")
