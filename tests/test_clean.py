"""P1-P12 cleaning rules on hand-written raw rows."""

import pytest

from promoscope.operators.clean import CLEAN_COLUMNS, clean_survey
from promoscope.operators.dimensions import Dimensions

FIELDS = ["score", "respondent_id", "city", "tenure_days", "tenure_cut", "source", "first_time_user",
          "nps_reason_primary", "sprint_id", "feedback"]


def run(spark, rows):
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in FIELDS))
    return {r.respondent_id: r for r in clean_survey(df).collect()}


def row(rid, score="9", city="Pune", td="10", tc="", src="wa", ft="Yes", reason="Slow Speed",
        sprint="Sprint 3", fb=""):
    return (score, rid, city, td, tc, src, ft, reason, sprint, fb)


def test_score_parse_and_clamp(spark):
    out = run(spark, [row("a", "9.7"), row("b", "8abc"), row("c", "-3"), row("d", "15"),
                      row("e", "n/a"), row("f", ""), row("g", " 7 "), row("h", "+6")])
    assert {k: v.score for k, v in out.items()} == {"a": 9, "b": 8, "c": 0, "d": 10, "g": 7, "h": 6}
    assert out["a"].score_band == "promoter" and out["g"].score_band == "passive"
    assert out["c"].score_band == "detractor"


def test_trim_js_whitespace(spark):
    out = run(spark, [row(" x﻿", fb="　 hello "), row("  y  ", city=" Delhi ")])
    assert "x" in out and out["x"].feedback == "hello"
    assert out["y"].city == "Delhi"


def test_respondent_id_trailing_dot_zero(spark):
    out = run(spark, [row("123.0"), row("45.05"), row("7.0.0")])
    assert set(out) == {"123", "45.05", "7.0"}


def test_junk_cities(spark):
    out = run(spark, [row("a", city="#REF!"), row("b", city="unknown"), row("c", city="NaN"),
                      row("d", city=""), row("e", city="Mumbai")])
    assert [out[k].city for k in "abcde"] == ["", "", "", "", "Mumbai"]


def test_tenure_days_and_buckets(spark):
    out = run(spark, [row("a", td="0"), row("b", td="1"), row("c", td="60"), row("d", td="61"),
                      row("e", td="180"), row("f", td="181"), row("g", td="-5"), row("h", td="x"),
                      row("i", td="30", tc="Unknown"), row("j", td="30", tc="Custom bucket"),
                      row("k", td="30", tc="unknown")])
    assert [out[k].tenure_days for k in "abcdefgh"] == [0, 1, 60, 61, 180, 181, 0, 0]
    assert [out[k].tenure_cut for k in "abcdefgh"] == [
        "Unknown", "Early (1-2 mo)", "Early (1-2 mo)", "Mid (3-6 mo)", "Mid (3-6 mo)", "Long (6+ mo)",
        "Unknown", "Unknown"]
    assert out["i"].tenure_cut == "Early (1-2 mo)"   # exactly 'Unknown' is recomputed
    assert out["j"].tenure_cut == "Custom bucket"    # any other label passes through (Q16)
    assert out["k"].tenure_cut == "unknown"


def test_source_aliases(spark):
    out = run(spark, [row("a", src="wa"), row("b", src=" WA "), row("c", src="IN - WA"),
                      row("d", src="G- form in wa"), row("e", src="CT"), row("f", src="call"),
                      row("g", src="Email"), row("h", src="")])
    assert [out[k].source for k in "abcdefgh"] == [
        "WhatsApp", "WhatsApp", "WhatsApp", "WhatsApp", "CleverTap", "Call", "Email", "Unknown"]


def test_first_time_flags(spark):
    vals = {"a": "Yes", "b": "First time", "c": "not first time", "d": "No", "e": "I had wifi",
            "f": "नहीं", "g": "पहले वाई-फाई", "h": "", "i": "north", "j": "none", "k": "maybe"}
    out = run(spark, [row(k, ft=v) for k, v in vals.items()])
    assert {k: out[k].first_time_user for k in vals} == {
        "a": "Yes", "b": "Yes", "c": "Yes", "d": "No", "e": "No", "f": "No", "g": "Yes", "h": "",
        "i": "No", "j": "No", "k": ""}


def test_theme_and_calendar(spark):
    out = run(spark, [row("a", reason="N/A", sprint="Sprint RSP5"), row("b", reason="slow speed"),
                      row("c", reason="", sprint="Pilot"), row("d", sprint="")])
    assert out["a"].theme == "unclassified"
    assert out["a"].month == "Apr '26" and out["a"].quarter == "Q1 FY27 (Apr '26+)"
    assert out["b"].theme == ""            # exact, case-sensitive lookup
    assert out["c"].month == "" and out["c"].quarter == ""
    assert out["d"].sprint_part == "_blank" and out["c"].sprint_part == "Pilot"


def test_missing_columns_read_as_blank(spark):
    df = spark.createDataFrame([("8", "S1")], "score string, sprint_id string")
    r = clean_survey(df).first()
    assert r.feedback == "" and r.respondent_id == "" and r.source == "Unknown"
    assert r.tenure_cut == "Unknown" and r.first_time_user == ""
    assert list(clean_survey(df).columns) == CLEAN_COLUMNS


def raw_rows(spark, rows):
    return spark.createDataFrame(rows, "respondent_id string, score string, nps_reason_primary string, source string, sprint_id string")


def test_own_dimension_tables(spark):
    raw = raw_rows(spark, [("a", "9", "Slow Speed", "WA", "Sprint 99"), ("b", "8", "New reason", " mail ", "Sprint 1"),
                           ("c", "7", "Gone", "Call", ""), ("d", "6", None, None, None)])
    tables = Dimensions(
        sprint_calendar=spark.createDataFrame([("Sprint 99", "m99", "q99"), (None, "x", "y")], "sprint_id string, month string, quarter string"),
        reason_theme=spark.createDataFrame([("New reason", "new_theme"), ("New reason", "new_theme"), ("Slow Speed", None)], "reason string, theme string"),
        source_alias=spark.createDataFrame([(" MAIL", "E-mail")], "alias string, canonical string"))
    got = {r.respondent_id: (r.theme, r.source, r.month, r.quarter, r.sprint_part) for r in clean_survey(raw, tables).collect()}
    assert got == {"a": ("", "WA", "m99", "q99", "Sprint 99"), "b": ("new_theme", "E-mail", "", "", "Sprint 1"),
                   "c": ("", "Call", "", "", "_blank"), "d": ("", "Unknown", "", "", "_blank")}
    assert clean_survey(raw, tables).schema.names == clean_survey(raw).schema.names
    one = {r.respondent_id: (r.theme, r.source) for r in clean_survey(raw, Dimensions(reason_theme=tables.reason_theme)).collect()}
    assert one["b"] == ("new_theme", "mail") and one["a"] == ("", "WhatsApp")  # the other tables are the built-in ones


def test_a_repeated_key_is_refused_and_cannot_multiply_rows(spark):
    raw = raw_rows(spark, [(str(i), "9", "R", "x", "S") for i in range(10)])
    for name, rows, schema in (("reason_theme", [("R", "a"), ("R", "b")], "reason string, theme string"),
                               ("reason_theme", [("R", "a"), ("R", None)], "reason string, theme string"),
                               ("source_alias", [("X", "a"), ("x", "b")], "alias string, canonical string"),
                               ("sprint_calendar", [("S", "m", "q"), ("S", "m", "p")], "sprint_id string, month string, quarter string")):
        with pytest.raises(Exception, match="repeated key in a dimension table: "):
            clean_survey(raw, Dimensions(**{name: spark.createDataFrame(rows, schema)})).collect()
    same = spark.createDataFrame([("R", "a")] * 50, "reason string, theme string")
    assert clean_survey(raw, Dimensions(reason_theme=same)).filter("theme = 'a'").count() == 10


def test_no_join_without_own_tables(spark):
    plan = clean_survey(raw_rows(spark, [("a", "9", "R", "x", "S")]))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
