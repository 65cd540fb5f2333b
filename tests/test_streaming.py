"""Streaming CSV ingest into the partitioned table with an upsert sink."""

import os

from promoscope.sources.csv_ingest import ingest_csv
from promoscope.sources.ingest_log import append_log, dead_letters, read_log
from promoscope.sources.store import read_clean
from promoscope.streaming.ingest_stream import log_of, run_available


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def part_files(table, sprint):
    d = os.path.join(table, f"sprint_part={sprint}")
    return sorted(f for f in os.listdir(d) if f.endswith(".parquet"))


def test_late_resend_rewrites_only_its_sprint(spark, tmpdir_fresh):
    landing = os.path.join(tmpdir_fresh, "landing")
    table = os.path.join(tmpdir_fresh, "table")
    ckpt = os.path.join(tmpdir_fresh, "ckpt")
    write(os.path.join(landing, "A", "s3.csv"), "score,respondent_id,sprint_id\n1,a,Sprint 3\n2,b,Sprint 3\n")
    write(os.path.join(landing, "B", "s4.csv"), "cycle,id,rating\nSprint 4,c,10\n")
    run_available(spark, landing, table, ckpt)
    first = sorted((r.sprint_id, r.respondent_id, r.score) for r in read_clean(spark, table).collect())
    assert first == [("Sprint 3", "a", 1), ("Sprint 3", "b", 2), ("Sprint 4", "c", 10)]
    s4_before = part_files(table, "Sprint 4")

    write(os.path.join(landing, "A", "s3_resend.csv"), "score,respondent_id,sprint_id\n9,a,Sprint 3\n")
    run_available(spark, landing, table, ckpt)
    second = sorted((r.sprint_id, r.respondent_id, r.score) for r in read_clean(spark, table).collect())
    assert second == [("Sprint 3", "a", 9), ("Sprint 3", "b", 2), ("Sprint 4", "c", 10)]
    assert part_files(table, "Sprint 4") == s4_before          # untouched partition kept as is

    run_available(spark, landing, table, ckpt)     # nothing new: no change
    third = sorted((r.sprint_id, r.respondent_id, r.score) for r in read_clean(spark, table).collect())
    assert third == second


def test_replayed_batch_after_crash_is_idempotent(spark, tmpdir_fresh, monkeypatch):
    import pytest

    from promoscope.streaming import ingest_stream

    landing = os.path.join(tmpdir_fresh, "landing")
    table = os.path.join(tmpdir_fresh, "table")
    ckpt = os.path.join(tmpdir_fresh, "ckpt")
    write(os.path.join(landing, "A", "s3.csv"),
          "score,respondent_id,sprint_id\n1,a,Sprint 3\n5,a,Sprint 3\n2,b,Sprint 4\n")
    real = ingest_stream.upsert_into
    calls = []

    def crash_after_write(*args, **kwargs):
        real(*args, **kwargs)
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("simulated failure before the batch commit")

    monkeypatch.setattr(ingest_stream, "upsert_into", crash_after_write)
    from pyspark.errors import StreamingQueryException

    with pytest.raises((StreamingQueryException, RuntimeError)):
        run_available(spark, landing, table, ckpt)
    run_available(spark, landing, table, ckpt)          # restart: the batch is replayed
    assert len(calls) == 2
    got = sorted((r.sprint_id, r.respondent_id, r.score) for r in read_clean(spark, table).collect())
    assert got == [("Sprint 3", "a", 5), ("Sprint 4", "b", 2)]


def scores(spark, table):
    return {(r.sprint_id, r.respondent_id): r.score for r in read_clean(spark, table).collect()}


def paths(root):
    return [os.path.join(root, x) for x in ("landing", "table", "ckpt")]


def test_every_file_has_its_own_header(spark, tmpdir_fresh):
    landing, table, ckpt = paths(tmpdir_fresh)
    write(os.path.join(landing, "A", "x.csv"), "respondent_id,score,sprint_id\n7,4,S\n")
    write(os.path.join(landing, "A", "y.CSV"), "score,sprint_id,respondent_id\n3,S,8\n")
    write(os.path.join(landing, "A", "z.csv"), "respondent_id,comment\n9,no score\n")
    run_available(spark, landing, table, ckpt)
    assert scores(spark, table) == {("S", "7"): 4, ("S", "8"): 3}


def test_a_layout_may_arrive_later(spark, tmpdir_fresh):
    landing, table, ckpt = paths(tmpdir_fresh)
    os.makedirs(os.path.join(landing, "B"))
    write(os.path.join(landing, "A", "x.csv"), "respondent_id,score,sprint_id\n1,4,S\n")
    run_available(spark, landing, table, ckpt)
    write(os.path.join(landing, "B", "y.csv"), "cycle,Rating,ID\nT,9,2\n")
    run_available(spark, landing, table, ckpt)
    assert scores(spark, table) == {("S", "1"): 4, ("T", "2"): 9}


def test_a_fresh_checkpoint_does_not_lose_to_the_table(spark, tmpdir_fresh):
    landing, table, ckpt = paths(tmpdir_fresh)
    write(os.path.join(landing, "a.csv"), "respondent_id,score,sprint_id\n1,4,S\n")
    run_available(spark, landing, table, ckpt)
    write(os.path.join(landing, "b.csv"), "respondent_id,score,sprint_id\n1,5,S\n")
    run_available(spark, landing, table, ckpt)
    other = os.path.join(tmpdir_fresh, "other")
    write(os.path.join(other, "c.csv"), "respondent_id,score,sprint_id\n1,9,S\n")
    run_available(spark, other, table, ckpt + "-fresh")
    assert scores(spark, table) == {("S", "1"): 9}


def test_file_time_decides_within_a_batch(spark, tmpdir_fresh):
    landing, table, ckpt = paths(tmpdir_fresh)
    for name, score, time in (("resend_9.csv", 1, 1000), ("resend_10.csv", 7, 2000)):
        write(os.path.join(landing, name), f"respondent_id,score,sprint_id\n1,{score},S\n")
        os.utime(os.path.join(landing, name), (time, time))
    run_available(spark, landing, table, ckpt)
    assert scores(spark, table) == {("S", "1"): 7}


def test_rejected_files_are_logged_and_loaded_once_mended(spark, tmpdir_fresh):
    landing, table, ckpt = paths(tmpdir_fresh)
    good, bad = os.path.join(landing, "good.csv"), os.path.join(landing, "bad.csv")
    write(good, "respondent_id,score,sprint_id\n1,4,S\n")
    write(bad, "respondent_id,comment\n2,no score\n")
    with open(os.path.join(landing, "binary.csv"), "wb") as f:
        f.write(b"score\x00\n\x01\n")
    run_available(spark, landing, table, ckpt)
    log = log_of(table)
    assert scores(spark, table) == {("S", "1"): 4}
    assert {(r.file_name, r.records, r.rejected) for r in read_log(spark, log).collect()} == {
        ("good.csv", 1, False), ("bad.csv", 0, True), ("binary.csv", 0, True)}
    assert {r.file_name: r.errors for r in dead_letters(spark, log).collect()}["bad.csv"] == (
        "No score column found in headers: respondent_id, comment")

    run_available(spark, landing, table, ckpt)  # nothing has changed: nothing is offered again
    assert read_log(spark, log).count() == 3

    write(bad, "respondent_id,score,sprint_id\n2,9,S\n1,5,S\n")  # mended in place: the source has seen its path
    run_available(spark, landing, table, ckpt)
    assert scores(spark, table) == {("S", "1"): 5, ("S", "2"): 9}
    assert [(r.file_name, r.records) for r in read_log(spark, log).orderBy("log_rank").limit(1).collect()] == [("bad.csv", 2)]
    assert [r.file_name for r in dead_letters(spark, log).collect()] == ["binary.csv"]
    run_available(spark, landing, table, ckpt)
    assert read_log(spark, log).count() == 4


def test_an_unreadable_file_is_offered_again(spark, tmpdir_fresh, monkeypatch):
    from promoscope.sources import csv_ingest

    landing, table, ckpt = paths(tmpdir_fresh)
    write(os.path.join(landing, "a.csv"), "respondent_id,score,sprint_id\n1,4,S\n")
    real = csv_ingest.read_heads
    monkeypatch.setattr(csv_ingest, "read_heads", lambda spark, paths: {p: csv_ingest.Head(None, "OSError: no access") for p in paths})
    run_available(spark, landing, table, ckpt)
    assert scores(spark, table) == {} and [r.errors for r in dead_letters(spark, log_of(table)).collect()] == ["OSError: no access"]
    monkeypatch.setattr(csv_ingest, "read_heads", real)
    os.utime(os.path.join(landing, "a.csv"), (10, 10))
    run_available(spark, landing, table, ckpt)
    assert scores(spark, table) == {("S", "1"): 4} and dead_letters(spark, log_of(table)).count() == 0


def test_a_replayed_batch_adds_no_log_entry(spark, tmpdir_fresh, monkeypatch):
    import pytest
    from pyspark.errors import StreamingQueryException

    from promoscope.streaming import ingest_stream

    landing, table, ckpt = paths(tmpdir_fresh)
    write(os.path.join(landing, "a.csv"), "respondent_id,score,sprint_id\n1,4,S\nx,n/a,S\n")
    write(os.path.join(landing, "bad.csv"), "nothing\n1\n")
    real, calls = ingest_stream.append_log, []

    def crash_after_log(*args, **kwargs):
        real(*args, **kwargs)
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("simulated failure before the batch commit")

    monkeypatch.setattr(ingest_stream, "append_log", crash_after_log)
    with pytest.raises((StreamingQueryException, RuntimeError)):
        run_available(spark, landing, table, ckpt)
    run_available(spark, landing, table, ckpt)
    assert len(calls) == 2
    assert sorted((r.file_name, r.records, r.skipped) for r in read_log(spark, log_of(table)).collect()) == [
        ("a.csv", 1, 1), ("bad.csv", 0, 0)]


def test_log_over_several_ingests_newest_first(spark, tmpdir_fresh):
    import datetime as dt

    log = os.path.join(tmpdir_fresh, "log")
    assert read_log(spark, log).count() == 0 and dead_letters(spark, log).count() == 0
    for i, kind in enumerate(("batch", "manifest", "batch")):
        folder = os.path.join(tmpdir_fresh, f"in{i}")
        for k in range(2):
            write(os.path.join(folder, f"f{i}{k}.csv"), f"score,id\n{i},a\n")
            os.utime(os.path.join(folder, f"f{i}{k}.csv"), (100 + k, 100 + k))
        _, report = ingest_csv(spark, folder)
        for _ in range(2):  # the same ingest twice
            append_log(report, log, f"ingest {i}", kind, dt.datetime(2024, 1, 1 + i, tzinfo=dt.timezone.utc))
    got = [(r.batch, r.kind, r.file_name, r.log_rank) for r in read_log(spark, log).orderBy("log_rank").collect()]
    assert got == [("ingest 2", "batch", "f21.csv", 1), ("ingest 2", "batch", "f20.csv", 2), ("ingest 1", "manifest", "f11.csv", 3),
                   ("ingest 1", "manifest", "f10.csv", 4), ("ingest 0", "batch", "f01.csv", 5), ("ingest 0", "batch", "f00.csv", 6)]


def test_a_stream_into_a_versioned_table(spark, tmpdir_fresh):
    from promoscope.sources.versions import VersionedTable

    landing, table, ckpt = paths(tmpdir_fresh)
    write(os.path.join(landing, "a.csv"), "respondent_id,score,sprint_id\n1,4,S\n2,5,S\n")
    write(os.path.join(landing, "bad.csv"), "nothing\n1\n")
    run_available(spark, landing, table, ckpt, versioned=True)
    write(os.path.join(landing, "b.csv"), "respondent_id;score;sprint_id\r\n1;9;S\r\n3;7;T\r\n")
    write(os.path.join(landing, "bad.csv"), "respondent_id,score,sprint_id\n4,1,T\n")
    run_available(spark, landing, table, ckpt, versioned=True)
    got = VersionedTable(spark, table)
    assert {(r.sprint_id, r.respondent_id): r.score for r in got.read().collect()} == {
        ("S", "1"): 9, ("S", "2"): 5, ("T", "3"): 7, ("T", "4"): 1}
    assert got.version().number == 3 and dead_letters(spark, log_of(table)).count() == 0
