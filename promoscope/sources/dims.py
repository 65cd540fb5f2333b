"""Dimension tables of the survey model.

Every table is a small, fixed list that ships with the engine.  Lookups and
orderings become literal map expressions (no join, no broadcast, evaluated
inside the projection that needs them).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES - these must equal the survey programme's own definitions.
# ---------------------------------------------------------------------------

# sprint calendar, in calendar order:
# (sprint_id, short label, full label, month, quarter)
SPRINT_CALENDAR: list[tuple[str, str, str, str, str]] = [
    ("Sprint 1", "Jul-1H", "Jul-1H '25", "Jul '25", "Q1 FY26 (Jul-Sep '25)"),
    ("Sprint 2", "Jul-2H", "Jul-2H '25", "Jul '25", "Q1 FY26 (Jul-Sep '25)"),
    ("Sprint 3", "Aug-1H", "Aug-1H '25", "Aug '25", "Q1 FY26 (Jul-Sep '25)"),
    ("Sprint 4", "Aug-2H", "Aug-2H '25", "Aug '25", "Q1 FY26 (Jul-Sep '25)"),
    ("Sprint 5", "Sep-1H", "Sep-1H '25", "Sep '25", "Q1 FY26 (Jul-Sep '25)"),
    ("Sprint 6", "Sep-2H", "Sep-2H '25", "Sep '25", "Q1 FY26 (Jul-Sep '25)"),
    ("Sprint 7", "Oct-1H", "Oct-1H '25", "Oct '25", "Q2 FY26 (Oct-Dec '25)"),
    ("Sprint 8", "Oct-2H", "Oct-2H '25", "Oct '25", "Q2 FY26 (Oct-Dec '25)"),
    ("Sprint 9", "Nov-1H", "Nov-1H '25", "Nov '25", "Q2 FY26 (Oct-Dec '25)"),
    ("Sprint 10", "Nov-2H", "Nov-2H '25", "Nov '25", "Q2 FY26 (Oct-Dec '25)"),
    ("Sprint 11", "Dec-1H", "Dec-1H '25", "Dec '25", "Q2 FY26 (Oct-Dec '25)"),
    ("Sprint 12", "Dec-2H", "Dec-2H '25", "Dec '25", "Q2 FY26 (Oct-Dec '25)"),
    ("Sprint 13", "Jan-1H", "Jan-1H '26", "Jan '26", "Q3 FY26 (Jan-Mar '26)"),
    ("Sprint 14", "Jan-2H", "Jan-2H '26", "Jan '26", "Q3 FY26 (Jan-Mar '26)"),
    ("Sprint RSP1", "Feb-1H", "Feb-1H '26", "Feb '26", "Q3 FY26 (Jan-Mar '26)"),
    ("Sprint RSP2", "Feb-2H", "Feb-2H '26", "Feb '26", "Q3 FY26 (Jan-Mar '26)"),
    ("Sprint RSP3", "Mar-1H", "Mar-1H '26", "Mar '26", "Q3 FY26 (Jan-Mar '26)"),
    ("Sprint RSP4", "Mar-2H", "Mar-2H '26", "Mar '26", "Q3 FY26 (Jan-Mar '26)"),
    ("Sprint RSP5", "Apr-1H", "Apr-1H '26", "Apr '26", "Q1 FY27 (Apr '26+)"),
    ("Sprint RSP6", "Apr-2H", "Apr-2H '26", "Apr '26", "Q1 FY27 (Apr '26+)"),
    ("Sprint RSP7", "May-1H", "May-1H '26", "May '26", "Q1 FY27 (Apr '26+)"),
]

# month order
MONTH_ORDER: list[str] = [
    "Jul '25", "Aug '25", "Sep '25", "Oct '25", "Nov '25", "Dec '25",
    "Jan '26", "Feb '26", "Mar '26", "Apr '26", "May '26",
]

# quarter order (fiscal quarters; the last one is open-ended)
QUARTER_ORDER: list[str] = [
    "Q1 FY26 (Jul-Sep '25)", "Q2 FY26 (Oct-Dec '25)", "Q3 FY26 (Jan-Mar '26)",
    "Q1 FY27 (Apr '26+)",
]

# tenure bucket order
TENURE_ORDER: list[str] = ["Early (1-2 mo)", "Mid (3-6 mo)", "Long (6+ mo)"]

# primary reason (exact, case-sensitive) -> theme
REASON_THEME: list[tuple[str, str]] = [
    ("Slow Speed", "speed_quality"),
    ("Good Speed", "speed_quality"),
    ("Frequent Disconnections", "reliability"),
    ("Internet Down", "reliability"),
    ("RDNI (Recharge Done, No Internet)", "reliability"),
    ("Affordable", "pricing_value"),
    ("Expensive", "pricing_value"),
    ("28-Day Plan Issue", "pricing_value"),
    ("Flexibility", "pricing_value"),
    ("FLEXIBILITY", "pricing_value"),
    ("No/Late Complaint Resolution", "customer_support"),
    ("Fast Complaint Resolution", "customer_support"),
    ("Bad Customer Support - Call Centre", "customer_support"),
    ("Good customer Support - call centre", "customer_support"),
    ("Bad Customer Support - Technician", "technician_service"),
    ("Good Partner/ Techinician Support", "technician_service"),
    ("Range Issue", "network_coverage"),
    ("General Good Service", "general_satisfaction"),
    ("General Bad Service", "general_satisfaction"),
    ("Bad Application", "content_usage"),
    ("OTT Request, No OTT complaint", "content_usage"),
    ("Shifting not Feasible", "installation"),
    ("Quick Installation", "installation"),
    ("N/A", "unclassified"),
]

# theme -> display label
THEME_LABEL: list[tuple[str, str]] = [
    ("speed_quality", "Speed & Quality"),
    ("reliability", "Reliability & Uptime"),
    ("pricing_value", "Pricing & Value"),
    ("customer_support", "Customer Support"),
    ("technician_service", "Technician Service"),
    ("network_coverage", "Network Coverage"),
    ("general_satisfaction", "General Satisfaction"),
    ("content_usage", "Content & Usage"),
    ("installation", "Installation"),
    ("billing_recharge", "Billing & Recharge"),
    ("churn_risk", "Churn & Competitor"),
    ("recommendation", "Recommendation"),
]

# lower-cased, trimmed channel alias -> canonical channel
SOURCE_ALIAS: list[tuple[str, str]] = [
    ("wa", "WhatsApp"),
    ("whatsapp", "WhatsApp"),
    ("in - wa", "WhatsApp"),
    ("g- form in wa", "WhatsApp"),
    ("ct", "CleverTap"),
    ("clevertap", "CleverTap"),
    ("call", "Call"),
]

# the channels the segment view pre-selects
DEFAULT_CHANNELS: list[str] = ["Call", "CleverTap", "WhatsApp"]

# canonical field -> accepted CSV headers, first match wins (compared lower-cased, trimmed)
HEADER_ALIASES: dict[str, list[str]] = {
    "score": ["score", "nps_score", "nps", "rating", "nps_rating", "user_rating"],
    "feedback": ["feedback", "open_text", "comment", "comments", "verbatim", "text",
                 "response", "open_ended", "why", "oe"],
    "respondent_id": ["respondent_id", "id", "user_id", "customer_id", "phone", "mobile",
                      "phone number"],
    "nps_reason_primary": ["nps_reason_primary", "nps reason - primary", "primary_reason", "reason"],
    "nps_reason_secondary": ["nps_reason_secondary", "nps reason - secondary", "secondary_reason"],
    "plan_type": ["plan_type", "plan", "segment", "product"],
    "city": ["city", "location", "geography", "region"],
    "tenure_days": ["tenure_days", "tenure", "days_since_activation"],
    "source": ["source", "channel", "survey_channel", "acquisition_source"],
    "sprint_id": ["sprint_id", "sprint", "cycle"],
    "sprint_start": ["sprint_start", "date", "timestamp", "created_at", "response_date"],
    "tenure_cut": ["tenure_cut", "tenure_bucket", "tenure_segment"],
    "first_time_user": ["first_time_user", "is_first_time_user", "first time user?", "first_time",
                        "new_to_wifi"],
}

# city values that mean "no city" (compared lower-cased)
JUNK_CITIES: list[str] = ["#ref!", "unknown", "nan", ""]

# first-time-user answer markers (compared lower-cased); the "yes" test runs first
FIRST_TIME_YES_PREFIX = "yes"
FIRST_TIME_YES_CONTAINS = ["first", "पहले वाई"]
FIRST_TIME_NO_PREFIXES = ["no", "नहीं"]
FIRST_TIME_NO_CONTAINS = ["had"]

# small-sample threshold for suppressing an NPS value
MIN_N = 5

# ---------------------------------------------------------------------------

_MAPS: dict[tuple, Column] = {}


def literal_map(pairs: list[tuple[str, str]]) -> Column:
    """A literal MAP<STRING,STRING> column: lookups stay JVM-side, no join.

    Built once per Spark context (a Column is reusable across DataFrames).
    """
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    key = (id(sc), tuple(pairs))
    m = _MAPS.get(key)
    if m is None:
        kv: list[Column] = []
        for k, v in pairs:
            kv += [F.lit(k), F.lit(v)]
        m = _MAPS[key] = F.create_map(*kv)
    return m


def sprint_month_map() -> Column:
    return literal_map([(s[0], s[3]) for s in SPRINT_CALENDAR])


def sprint_quarter_map() -> Column:
    return literal_map([(s[0], s[4]) for s in SPRINT_CALENDAR])


def sprint_short_map() -> Column:
    return literal_map([(s[0], s[1]) for s in SPRINT_CALENDAR])


def sprint_full_map() -> Column:
    return literal_map([(s[0], s[2]) for s in SPRINT_CALENDAR])


def reason_theme_map() -> Column:
    return literal_map(REASON_THEME)


def theme_label_map() -> Column:
    return literal_map(THEME_LABEL)


def source_alias_map() -> Column:
    return literal_map(SOURCE_ALIAS)


def theme_label(theme: Column) -> Column:
    """Display label of a theme key, falling back to the key itself."""
    return F.coalesce(theme_label_map()[theme], theme)


def calendar_index(sprint_id: Column) -> Column:
    """0-based position of a sprint in the calendar; 999 for unknown sprints."""
    m = literal_map([(s[0], str(i)) for i, s in enumerate(SPRINT_CALENDAR)])
    return F.coalesce(m[sprint_id].cast("int"), F.lit(999))


def order_index(values: list[str], c: Column) -> Column:
    """0-based position of ``c`` in a fixed order list; NULL when absent."""
    return literal_map([(v, str(i)) for i, v in enumerate(values)])[c].cast("int")


# FIXED VALUES: the sentences of the health summary and of the significance test; {} is a number.
HEALTH_STRONG = "Overall NPS of +{} signals strong customer satisfaction."
HEALTH_SLIGHT = "Overall NPS of +{} is slightly positive but has room to grow."
HEALTH_NEGATIVE = "Overall NPS of {} is in negative territory — more detractors than promoters."
HEALTH_BAD = "Overall NPS of {} indicates significant dissatisfaction among respondents."
HEALTH_BANDS = "{}% are promoters (9–10) and {}% are detractors (0–6)."
HEALTH_RISE = "The most recent period saw NPS rise by +{} pts vs the previous one."
HEALTH_DROP = "The most recent period saw NPS drop by {} pts vs the previous one."
HEALTH_FLAT = "NPS was flat compared to the previous period."
TEST_NO_DATA = "Insufficient data"
TEST_NO_VARIANCE = "No variance"
TEST_IMPROVED = "NPS improved by {} pts (p={}) — statistically significant"
TEST_DECLINED = "NPS declined by {} pts (p={}) — statistically significant"
TEST_CHANGED = "NPS changed by {} pts (p={}) — not statistically significant"


def sentence(text: str, *values: Column) -> Column:
    """A fixed sentence with its numbers put in."""
    first, *rest = text.split("{}")
    parts = [F.lit(first)]
    for value, after in zip(values, rest):
        parts += [value, F.lit(after)]
    return F.concat(*parts)
