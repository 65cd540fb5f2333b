"""Invariants over the survey derived from the driver tables (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE_DIR
from promoscope.operators import matrix, metrics
from promoscope.operators.clean import clean_survey
from promoscope.operators.rollup import MEASURES, ROLLUP_DIMS, as_counts, build_rollup, has_feedback
from promoscope.sources import driver_tables
from promoscope.sources.store import survey_rollup, survey_table


def test_band_counts_add_up_and_ci_brackets(spark):
    t = metrics.trend(survey_rollup(spark, SMOKE_DIR), "sprint").collect()
    assert t
    for r in t:
        assert r.promoters + r.passives + r.detractors == r.n
        assert r.ci_lower - 0.1 <= r.nps <= r.ci_upper + 0.1


def test_rollup_equals_direct(spark):
    rows = survey_table(spark, SMOKE_DIR)
    rol = survey_rollup(spark, SMOKE_DIR)
    for grain in ("sprint", "month", "quarter"):
        a = sorted(tuple(r) for r in metrics.trend(rows, grain).collect())
        b = sorted(tuple(r) for r in metrics.trend(rol, grain).collect())
        assert a == b
    a = sorted(tuple(r) for r in matrix.nps_matrix(rows, "city", "sprint_id").collect())
    b = sorted(tuple(r) for r in matrix.nps_matrix(rol, "city", "sprint_id").collect())
    assert a == b


def test_no_nulls_in_string_columns(spark):
    rows = survey_table(spark, SMOKE_DIR)
    strings = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    nulls = rows.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in strings]).first()
    assert all(v == 0 for v in nulls)


def test_partitioning_does_not_change_results(spark):
    rows = survey_table(spark, SMOKE_DIR)
    a = sorted(tuple(r) for r in metrics.nps_by_group(rows, "city").collect())
    b = sorted(tuple(r) for r in metrics.nps_by_group(rows.repartition(3), "city").collect())
    assert a == b


def test_matrix_totals_include_unknown_members(spark):
    rows = survey_table(spark, SMOKE_DIR)
    m = matrix.nps_matrix(rows, "city", "source")
    grand = m.filter(F.col("cell_type") == "grand_total").first().n
    assert grand == rows.count()
    cells = m.filter(F.col("cell_type") == "cell").agg(F.sum("n")).first()[0]
    assert cells < grand          # blank / Unknown members are dropped after totals (Q12)


def test_counts_view_is_additive(spark):
    rows = survey_table(spark, SMOKE_DIR)
    c = as_counts(rows).agg(F.sum("n"), F.sum("promoters"), F.sum("passives"), F.sum("detractors")).first()
    assert c[0] == c[1] + c[2] + c[3] == rows.count()


def test_rollup_needs_no_table(spark, monkeypatch):
    """Counts of a new application: the rollup needs neither the table nor the texts, and counts comments alike."""
    from promoscope.sources import store

    table = survey_table(spark, SMOKE_DIR)  # stored under its own path
    want = sorted(tuple(r) for r in build_rollup(table).collect())
    monkeypatch.setattr(store, "_FRAMES", {})
    monkeypatch.setattr(store, "write_clean", lambda *a, **k: pytest.fail("the table was written"))
    got = survey_rollup(spark, SMOKE_DIR).groupBy("sprint_part", *ROLLUP_DIMS).agg(*[F.sum(m) for m in MEASURES])
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(r[-4] for r in want) > 0  # some comments count


def test_marks_count_as_their_comments(spark, tmpdir_fresh):
    """Comments around the least length, white space around and inside them, characters of two UTF-16 units."""
    texts = [None, "", "     x     ", "12345", "123456", "  12345 ", "abcd  ", "abcde f", "abcde  ", "　123456﻿",
             "\U0001f600\U0001f600", "\U0001f600\U0001f600\U0001f600", "1234\U0001f600", "a" * 5000]
    at = lambda name: f"{tmpdir_fresh}/{name}.parquet"
    for name in ("customer", "nation", "orders"):
        driver_tables.table(spark, SMOKE_DIR, name).write.parquet(at(name))
    keys = [r[0] for r in driver_tables.table(spark, SMOKE_DIR, "orders").select("o_orderkey").orderBy("o_orderkey")
            .limit(len(texts)).collect()]
    spark.createDataFrame(list(zip(keys, texts)), "doc_id bigint, text string").write.parquet(at("documents"))
    whole, marked = (clean_survey(f(spark, tmpdir_fresh))
                     for f in (driver_tables.survey_raw, driver_tables.survey_raw_counted))
    rows = sorted(tuple(r) for r in build_rollup(whole).collect())
    assert sorted(tuple(r) for r in build_rollup(marked).collect()) == rows
    assert sum(r[-4] for r in rows) == whole.filter(has_feedback()).count() > 3
