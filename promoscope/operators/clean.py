"""Turn raw all-string survey rows into the fixed clean schema.

One narrow projection plus one filter; every lookup in a built-in table is a literal map
expression, so the whole step is a single whole-stage-codegen stage with no
shuffle and no join.  Tables that a user brings along (``Dimensions``) are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.functions.columns import INT_MAX, js_int_prefix, js_trim
from promoscope.functions.nps import score_band
from promoscope.operators.dimensions import Dimensions, look_up
from promoscope.sources import dims

CLEAN_COLUMNS: list[str] = [
    "row_seq", "ingest_batch", "file_order", "src_file", "respondent_id", "score", "score_band", "feedback",
    "nps_reason_primary", "nps_reason_secondary", "plan_type", "city", "tenure_days",
    "tenure_cut", "source", "sprint_id", "sprint_start", "first_time_user", "theme", "month",
    "quarter", "sprint_part",
]

_INT_COLS = {"score": T.IntegerType(), "tenure_days": T.IntegerType(),
             "row_seq": T.LongType(), "ingest_batch": T.LongType(), "file_order": T.LongType()}
_ORDER_COLS = ("row_seq", "ingest_batch", "file_order")

CLEAN_SCHEMA = T.StructType([
    T.StructField(c, _INT_COLS.get(c, T.StringType()), c not in _ORDER_COLS)
    for c in CLEAN_COLUMNS
])

BLANK_PART = "_blank"


def tenure_bucket(days: Column) -> Column:
    """P7 bucket for a tenure in days (install date = day 1)."""
    return (F.when(days <= 0, F.lit("Unknown"))
            .when(days <= 60, F.lit(dims.TENURE_ORDER[0]))
            .when(days <= 180, F.lit(dims.TENURE_ORDER[1]))
            .otherwise(F.lit(dims.TENURE_ORDER[2])))


def first_time_flag(raw: Column) -> Column:
    """Normalise a first-time-user answer to 'Yes' / 'No' / ''."""
    v = F.lower(raw)
    yes = v.startswith(dims.FIRST_TIME_YES_PREFIX)
    for s in dims.FIRST_TIME_YES_CONTAINS:
        yes = yes | v.contains(s)
    no = F.lit(False)
    for s in dims.FIRST_TIME_NO_PREFIXES:
        no = no | v.startswith(s)
    for s in dims.FIRST_TIME_NO_CONTAINS:
        no = no | v.contains(s)
    return F.when(yes, F.lit("Yes")).when(no, F.lit("No")).otherwise(F.lit(""))


def sprint_part(sprint_id: Column) -> Column:
    """Partition value: a blank sprint would become the Hive default partition."""
    return F.when(sprint_id == "", F.lit(BLANK_PART)).otherwise(sprint_id)


def clean_survey(raw: DataFrame, tables: Dimensions | None = None, ingest_batch: int | Column = 0,
                 src_file: str | Column = "survey_raw") -> DataFrame:
    """Clean raw survey rows, with the lookups in ``tables`` where given.

    ``raw`` has string columns named by canonical field (missing fields read as
    ''), optionally ``row_seq`` / ``ingest_batch`` / ``file_order`` / ``src_file``.  Rows whose
    score has no integer prefix are dropped (P2).
    """
    have = set(raw.columns)
    fields = list(dims.HEADER_ALIASES)
    tables = tables or Dimensions()

    def engine_col(name: str, default, dtype: str) -> Column:
        if name in have:
            return F.col(name).cast(dtype)
        return (default if isinstance(default, Column) else F.lit(default)).cast(dtype)

    # Three narrow projections instead of one wide one: each trimmed / parsed
    # value is computed once and referenced by name, which keeps every
    # operator's generated code small enough for the JIT (a single fused
    # projection of all rules compiles into one huge, interpreted method).
    trimmed = raw.select(
        engine_col("row_seq", F.monotonically_increasing_id(), "bigint").alias("row_seq"),
        engine_col("ingest_batch", ingest_batch, "bigint").alias("ingest_batch"),
        engine_col("file_order", 0, "bigint").alias("file_order"),
        engine_col("src_file", src_file, "string").alias("src_file"),
        *[(js_trim(F.col(f)) if f in have else F.lit("")).alias("_t_" + f) for f in fields],
    )
    parsed = trimmed.select(
        "*",
        js_int_prefix(F.col("_t_score")).alias("_score_num"),
        js_int_prefix(F.col("_t_tenure_days")).alias("_tenure_num"),
    ).filter(F.col("_score_num").isNotNull())

    tenure_num = F.col("_tenure_num")
    staged = parsed.select(
        "row_seq", "ingest_batch", "file_order", "src_file",
        F.regexp_replace(F.col("_t_respondent_id"), r"\.0$", "").alias("respondent_id"),
        F.least(F.greatest(F.col("_score_num"), F.lit(0.0)), F.lit(10.0)).cast("int").alias("score"),
        F.col("_t_feedback").alias("feedback"),
        F.col("_t_nps_reason_primary").alias("nps_reason_primary"),
        F.col("_t_nps_reason_secondary").alias("nps_reason_secondary"),
        F.col("_t_plan_type").alias("plan_type"),
        F.when(F.lower(F.col("_t_city")).isin(*dims.JUNK_CITIES), F.lit(""))
         .otherwise(F.col("_t_city")).alias("city"),
        (F.when(tenure_num.isNull() | (tenure_num < 0), F.lit(0.0))
         .otherwise(F.least(tenure_num, F.lit(float(INT_MAX))))).cast("int").alias("tenure_days"),
        F.col("_t_tenure_cut").alias("_raw_tc"),
        F.col("_t_source").alias("source"),
        F.col("_t_sprint_id").alias("sprint_id"),
        F.col("_t_sprint_start").alias("sprint_start"),
        first_time_flag(F.col("_t_first_time_user")).alias("first_time_user"),
    )

    source = F.lower(F.col("source"))
    if tables.source_alias is None:
        canonical = dims.source_alias_map()[source]
    else:
        staged = look_up(staged, source, tables.source_alias, F.lower(F.trim("alias")), {"_canonical": "canonical"})
        canonical = F.col("_canonical")
    if tables.reason_theme is None:
        theme = dims.reason_theme_map()[F.col("nps_reason_primary")]
    else:
        staged = look_up(staged, F.col("nps_reason_primary"), tables.reason_theme, "reason", {"_theme": "theme"})
        theme = F.col("_theme")
    if tables.sprint_calendar is None:
        month, quarter = (m[F.col("sprint_id")] for m in (dims.sprint_month_map(), dims.sprint_quarter_map()))
    else:
        staged = look_up(staged, F.col("sprint_id"), tables.sprint_calendar, "sprint_id",
                         {"_month": "month", "_quarter": "quarter"})
        month, quarter = F.col("_month"), F.col("_quarter")

    return staged.select(
        "row_seq", "ingest_batch", "file_order", "src_file", "respondent_id", "score",
        score_band(F.col("score")).alias("score_band"),
        "feedback", "nps_reason_primary", "nps_reason_secondary", "plan_type", "city",
        "tenure_days",
        F.when((F.col("_raw_tc") != "") & (F.col("_raw_tc") != "Unknown"), F.col("_raw_tc"))
         .otherwise(tenure_bucket(F.col("tenure_days"))).alias("tenure_cut"),
        F.when(F.col("source") == "", F.lit("Unknown")).otherwise(F.coalesce(canonical, F.col("source"))).alias("source"),
        "sprint_id", "sprint_start", "first_time_user",
        F.coalesce(theme, F.lit("")).alias("theme"), F.coalesce(month, F.lit("")).alias("month"),
        F.coalesce(quarter, F.lit("")).alias("quarter"),
        sprint_part(F.col("sprint_id")).alias("sprint_part"),
    )
