"""The stored top comments: any selection of cells, and upserts against building the table again."""

import os
import random

import pytest

from promoscope.operators import topk
from promoscope.operators.clean import clean_survey
from promoscope.operators.filters import FilterSpec
from promoscope.operators.upsert import upsert_into
from promoscope.operators.verbatims import verbatims
from promoscope.sources.store import read_clean, write_clean

REASONS = ["Slow Speed", "No issue, all good", "Some unmapped reason", ""]


def rows(rng, n, first=0, ids=400, long=60):
    return [(str(rng.randrange(ids)), str(rng.randrange(11)), "x" * rng.randrange(long), rng.choice(REASONS),
             rng.choice(["Sprint 3", "Sprint 4", ""]), first + i) for i in range(n)]


def clean(spark, made, batch=0):
    df = spark.createDataFrame(made, "respondent_id string, score string, feedback string, nps_reason_primary string, "
                                     "sprint_id string, row_seq long")
    return clean_survey(df, ingest_batch=batch)


def stored(spark, path):
    return sorted((r.sprint_part, r.score_band, r.theme, r.cell_rank, r.row_seq, r.ingest_batch) for r in topk.read(spark, path).collect())


def test_any_selection_of_cells(spark, tmpdir_fresh):
    table = clean(spark, rows(random.Random(1), 900))
    path = os.path.join(tmpdir_fresh, "top")
    topk.build(table, path, k=10)
    top = topk.read(spark, path)
    for spec in (None, FilterSpec(band="detractor"), FilterSpec(period="Sprint 3"), FilterSpec(period="", band="promoter"),
                 FilterSpec(theme="speed_quality", band="passive")):
        for limit in (1, 10):
            want = [tuple(r) for r in verbatims(table, spec, limit).orderBy("rank").collect()]
            assert [tuple(r) for r in topk.top_verbatims(top, spec, limit, k=10).orderBy("rank").collect()] == want
    with pytest.raises(ValueError):
        topk.top_verbatims(top, None, 11, k=10)
    with pytest.raises(ValueError):
        topk.top_verbatims(top, FilterSpec(channels=("Call",)))


@pytest.mark.parametrize("ids,n,k", [(400, 80, 5), (60, 300, 5), (40, 40, 100), (2000, 30, 3)])
def test_upserts_against_building_again(spark, tmpdir_fresh, monkeypatch, ids, n, k):
    rng = random.Random(ids)
    table, path, again = (os.path.join(tmpdir_fresh, x) for x in ("table", "top", "again"))
    write_clean(clean(spark, rows(rng, 700, ids=ids)), table)
    topk.build(read_clean(spark, table), path, k)
    real, refilled = topk.update, []
    monkeypatch.setattr(topk, "update", lambda *a: refilled.append(real(*a, k=k).count()))
    for number in range(3):
        # few long comments replace others by short ones, so stored rows are lost
        upsert_into(spark, table, clean(spark, rows(rng, n, 10_000 * (number + 1), ids, long=(8, 90, 30)[number])), topk_path=path)
        topk.build(read_clean(spark, table), again + str(number), k)
        assert stored(spark, path) == stored(spark, again + str(number))
    assert len(refilled) == 3 and (k == 100) == (sum(refilled) == 0)


def test_a_sprint_that_loses_all_comments(spark, tmpdir_fresh):
    table, path = (os.path.join(tmpdir_fresh, x) for x in ("table", "top"))
    write_clean(clean(spark, [("a", "9", "a long comment", "Slow Speed", "Sprint 3", 1)]), table)
    topk.build(read_clean(spark, table), path)
    assert len(stored(spark, path)) == 1
    upsert_into(spark, table, clean(spark, [("a", "9", "short", "Slow Speed", "Sprint 3", 2)]), topk_path=path)
    assert stored(spark, path) == []
