"""S1-S10 with hand-written CSV files (BOM, aliases, missing score column, bad scores, re-sends)."""

import csv
import io
import os

import pytest
from pyspark.sql import functions as F

from promoscope.operators.clean import clean_survey
from promoscope.operators.upsert import latest_per_key, merge, upsert_into
from promoscope.sources.csv_ingest import (
    csv_files, ingest_csv, ingest_files, ingest_manifest, read_heads, resolve_columns)
from promoscope.sources.dialect import Dialect, read_head
from promoscope.sources.store import read_clean, write_clean
from promoscope.sources.survey_files import export_csv, file_catalogue, of_sprint
from promoscope.sources.versions import VersionedTable

FILES = {
    "a_bom.csv": "﻿ score , feedback ,respondent_id,sprint_id,source\n\n"
                 '9,"great\nservice",101.0,Sprint 3,wa\n'
                 '\n'
                 '3,"slow, ""very"" slow",102,Sprint 3,call\n',
    "b_alias.csv": "cycle,id,Rating,comment,Channel\n"
                   "Sprint 4,201,8,ok,CT\n"
                   "Sprint 4,202,10,best,\n",
    "c_noscore.csv": "id,cycle,comment\n301,Sprint 4,no score here\n",
    "d_badscores.csv": "score,respondent_id,sprint_id\nn/a,401,Sprint 5\n,402,Sprint 5\n7,403,Sprint 5\n",
    "e_partial.csv": "score,sprint_id\n6,Sprint 6\n",
    "notes.txt": "score\n10\n",
}


def write_files(root, files):
    for name, text in files.items():
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write(text)


def test_header_resolution():
    assert resolve_columns(("cycle", "ID", "Rating", "comment")) == {
        "score": 2, "feedback": 3, "respondent_id": 1, "sprint_id": 0}
    # first alias in alias order wins, not first header
    assert resolve_columns(("rating", "score"))["score"] == 1


def test_ingest_and_report(spark, tmpdir_fresh):
    write_files(tmpdir_fresh, FILES)
    files = csv_files(spark, tmpdir_fresh)
    assert next(f.headers for f in files if f.path.endswith("a_bom.csv")) == (
        "score", "feedback", "respondent_id", "sprint_id", "source")
    clean, report = ingest_files(spark, files)
    rows = {r.respondent_id: r for r in clean.collect()}
    assert set(rows) == {"101", "102", "201", "202", "403", ""}
    assert rows["101"].feedback == "great\nservice" and rows["101"].source == "WhatsApp"
    assert rows["102"].feedback == 'slow, "very" slow' and rows["102"].source == "Call"
    assert rows["201"].score == 8 and rows["201"].source == "CleverTap" and rows["201"].sprint_id == "Sprint 4"
    assert rows["202"].source == "Unknown"
    rep = {r.file_name: r for r in report.collect()}
    assert "notes.txt" not in rep                                   # S8 filter
    assert rep["a_bom.csv"].records == 2 and rep["a_bom.csv"].status == "OK"
    assert rep["c_noscore.csv"].records == 0
    assert rep["c_noscore.csv"].errors == "No score column found in headers: id, cycle, comment"
    assert rep["d_badscores.csv"].skipped == 2 and rep["d_badscores.csv"].status == "1 warning(s)"
    assert rep["d_badscores.csv"].errors == "Skipped 2 rows with invalid/missing scores"
    cat = {r.file_name: r for r in file_catalogue(spark, files, clean).collect()}
    assert cat["a_bom.csv"].size == os.path.getsize(os.path.join(tmpdir_fresh, "a_bom.csv"))
    assert cat["a_bom.csv"].responses == 2 and cat["c_noscore.csv"].responses == 0
    assert len({r.total_size for r in cat.values()}) == 1


def test_mixed_headers_do_not_map_by_position(spark, tmpdir_fresh):
    write_files(tmpdir_fresh, {"x.csv": "score,sprint_id\n9,S\n", "y.csv": "sprint_id,score\nT,2\n"})
    clean, _ = ingest_csv(spark, tmpdir_fresh)
    assert sorted((r.sprint_id, r.score) for r in clean.collect()) == [("S", 9), ("T", 2)]


def test_upsert_last_wins_and_touched_sprints(spark, tmpdir_fresh):
    base_dir = os.path.join(tmpdir_fresh, "base")
    os.makedirs(base_dir)
    write_files(base_dir, {"s3.csv": "score,respondent_id,sprint_id\n1,a,Sprint 3\n2,a,Sprint 3\n3,b,Sprint 3\n",
                           "s4.csv": "score,respondent_id,sprint_id\n4,a,Sprint 4\n4,a,Sprint 4\n"})
    clean, _ = ingest_csv(spark, base_dir)
    table = os.path.join(tmpdir_fresh, "table")
    write_clean(clean, table)
    assert read_clean(spark, table).count() == 5                      # load keeps duplicates
    new_dir = os.path.join(tmpdir_fresh, "new")
    os.makedirs(new_dir)
    write_files(new_dir, {"f_resend.csv": "score,respondent_id,sprint_id\n9,a,Sprint 3\n8,c,Sprint 3\n"})
    new, _ = ingest_csv(spark, new_dir)
    upsert_into(spark, table, new)
    got = sorted((r.sprint_id, r.respondent_id, r.score) for r in read_clean(spark, table).collect())
    assert got == [("Sprint 3", "a", 9), ("Sprint 3", "b", 3), ("Sprint 3", "c", 8),
                   ("Sprint 4", "a", 4), ("Sprint 4", "a", 4)]           # untouched sprint kept as is
    upsert_into(spark, table, new)                                       # idempotent
    again = sorted((r.sprint_id, r.respondent_id, r.score) for r in read_clean(spark, table).collect())
    assert again == got
    full = merge(read_clean(spark, table), new, full=True)
    assert full.count() == 4


def test_latest_per_key_blank_ids_collapse(spark):
    df = spark.createDataFrame(
        [("S", "", 0, 0, "f", i, i % 11) for i in range(50)],
        "sprint_id string, respondent_id string, ingest_batch long, file_order long, src_file string, "
        "row_seq long, score int")
    r = latest_per_key(df).collect()
    assert len(r) == 1 and r[0].row_seq == 49


def test_export_roundtrip(spark, tmpdir_fresh):
    write_files(tmpdir_fresh, FILES)
    clean, _ = ingest_csv(spark, tmpdir_fresh)
    out = os.path.join(tmpdir_fresh, "export")
    export_csv(clean, out)
    back, _ = ingest_csv(spark, out)
    cols = ["respondent_id", "score", "feedback", "city", "source", "sprint_id", "theme", "tenure_cut"]
    a = sorted(tuple(r) for r in clean.select(*cols).collect())
    b = sorted(tuple(r) for r in back.select(*cols).collect())
    assert a == b
    assert any(d.startswith("sprint_part=") for d in os.listdir(out))
    assert back.filter(F.col("sprint_id") == "Sprint 3").count() == 2


def test_manifest_load_keeps_going_past_missing_files(spark, tmpdir_fresh):
    write_files(tmpdir_fresh, {"s1.csv": "score,respondent_id,sprint_id\n9,a,Sprint 3\n9,a,Sprint 3\n",
                               "s2.csv": "score,respondent_id,sprint_id\n2,b,Sprint 4\n",
                               "manifest.json": '["s2.csv", "gone.csv", "s1.csv"]'})
    clean, report = ingest_manifest(spark, os.path.join(tmpdir_fresh, "manifest.json"))
    assert clean.count() == 3                                    # no dedup on load
    rep = {r.file_name: r for r in report.collect()}
    assert rep["gone.csv"].records == 0 and rep["gone.csv"].errors.startswith("File not found")
    seq = {r.respondent_id: r.file_order for r in clean.collect()}
    assert seq["b"] < seq["a"]                                   # manifest order


def test_export_one_sprint(spark, tmpdir_fresh):
    write_files(tmpdir_fresh, FILES)
    clean, _ = ingest_csv(spark, tmpdir_fresh)
    out = os.path.join(tmpdir_fresh, "one")
    export_csv(clean, out, sprint="Sprint 4")
    assert sorted(d for d in os.listdir(out) if d.startswith("sprint_part=")) == ["sprint_part=Sprint 4"]


def test_single_line_mode_splits_but_keeps_rows(spark, tmpdir_fresh):
    write_files(tmpdir_fresh, {"big.csv": "score,respondent_id,sprint_id\n" + "".join(
        f"{i % 11},{i},Sprint 3\n" for i in range(5000))})
    a, _ = ingest_csv(spark, tmpdir_fresh)
    b, _ = ingest_csv(spark, tmpdir_fresh, multiline=False)
    assert a.count() == b.count() == 5000


def test_paths_with_spaces_and_odd_characters_keep_their_lineage(spark, tmpdir_fresh):
    folder = os.path.join(tmpdir_fresh, "my surveys [1]", "50% é")
    os.makedirs(folder)
    write_files(folder, {"my survey 1.csv": "score,sprint_id\n9,Sprint 3\n8,Sprint 3\n", "a+b{c}*.CSV": "score\n3\n"})
    files = csv_files(spark, tmpdir_fresh)
    clean, report = ingest_files(spark, files)
    assert {r.file_name: (r.records, r.status) for r in report.collect()} == {
        "my survey 1.csv": (2, "OK"), "a+b{c}*.CSV": (1, "OK")}
    assert {r.file_name: r.responses for r in file_catalogue(spark, files, clean).collect()} == {
        "my survey 1.csv": 2, "a+b{c}*.CSV": 1}
    assert clean.filter("ingest_batch is null or file_order is null or src_file is null").count() == 0


def test_reread_export_keeps_lineage(spark, tmpdir_fresh):
    write_files(tmpdir_fresh, {"s.csv": "score,respondent_id,sprint_id\n1,a,Sprint 13\n2,b,Sprint 13\n3,c,\n"})
    clean, _ = ingest_csv(spark, tmpdir_fresh)
    out = os.path.join(tmpdir_fresh, "out")
    export_csv(clean, out)
    back, report = ingest_csv(spark, out)
    assert sum(r.records for r in report.collect()) == back.count() == 3
    assert back.filter("file_order is null or file_order = 0").count() == 0


def test_new_rows_beat_old_ones_with_default_arguments(spark, tmpdir_fresh):
    base_dir, new_dir = os.path.join(tmpdir_fresh, "base"), os.path.join(tmpdir_fresh, "new")
    os.makedirs(base_dir)
    os.makedirs(new_dir)
    write_files(base_dir, {f"f{i:03d}.csv": f"score,respondent_id,sprint_id\n2,r{i},Sprint 3\n" for i in range(12)})
    write_files(new_dir, {"a.csv": "score,respondent_id,sprint_id\n10,r11,Sprint 3\n"})
    os.utime(os.path.join(new_dir, "a.csv"), (1, 1))            # an old file, sent late
    table = os.path.join(tmpdir_fresh, "table")
    write_clean(ingest_csv(spark, base_dir)[0], table)
    upsert_into(spark, table, ingest_csv(spark, new_dir)[0])
    got = {r.respondent_id: (r.score, r.ingest_batch) for r in read_clean(spark, table).collect()}
    assert got["r11"] == (10, 1) and got["r0"] == (2, 0) and len(got) == 12


def test_within_a_batch_the_newer_file_wins(spark, tmpdir_fresh):
    write_files(tmpdir_fresh, {"resend_9.csv": "score,respondent_id,sprint_id\n1,a,Sprint 3\n",
                               "resend_10.csv": "score,respondent_id,sprint_id\n7,a,Sprint 3\n"})
    os.utime(os.path.join(tmpdir_fresh, "resend_9.csv"), (1000, 1000))
    os.utime(os.path.join(tmpdir_fresh, "resend_10.csv"), (2000, 2000))
    clean, report = ingest_csv(spark, tmpdir_fresh)
    assert [r.score for r in latest_per_key(clean).collect()] == [7]
    assert [r.file_name for r in report.orderBy("log_rank").collect()] == ["resend_10.csv", "resend_9.csv"]


def test_byte_order_mark_before_a_quoted_header(spark, tmpdir_fresh):
    write_files(tmpdir_fresh, {
        "a.csv": "\ufeff\"respondent_id\",\"score\",\"sprint_id\"\r\n\"a\",\"1\",\"S\"\r\n\"b\",\"2\",\"S\"\r\n",
        "b.csv": "\ufeff\"score\",\"id\"\n5,c\n"})
    clean, report = ingest_csv(spark, tmpdir_fresh)
    assert sorted((r.respondent_id, r.score) for r in clean.collect()) == [("a", 1), ("b", 2), ("c", 5)]
    assert {r.status for r in report.collect()} == {"OK"}


def test_line_ends_inside_quotes_stay(spark, tmpdir_fresh):
    with open(os.path.join(tmpdir_fresh, "crlf.csv"), "wb") as f:
        f.write(b'score,feedback,city\r\n9,"two\r\nlines",X\r\n8,"three\nlines\r\nhere",Y \r\n')
    clean, _ = ingest_csv(spark, tmpdir_fresh)
    assert sorted((r.feedback, r.city) for r in clean.collect()) == [
        ("three\nlines\r\nhere", "Y"), ("two\r\nlines", "X")]


def test_headers_of_any_length_are_read_to_their_end(spark, tmpdir_fresh):
    long = "x" * (1 << 20)
    quoted = ",".join(f'"column\n{i}"' for i in range(3000))
    write_files(tmpdir_fresh, {"long.csv": f"{long},{quoted},score\n" + "," * 3001 + "7\n"})
    clean, _ = ingest_csv(spark, tmpdir_fresh)
    assert [r.score for r in clean.collect()] == [7]


def test_head_of_a_file():
    for text, names, dialect, more in (
            (b"", (), Dialect(), False), (b"a,b", ("a", "b"), Dialect(), False),
            (b"\xef\xbb\xbf\n\na,b\nc", ("a", "b"), Dialect(), True),
            (b'"a\nb",c\r\nd,e\r\n', ("a\nb", "c"), Dialect(",", "\r\n"), True),
            (b'"a""\n",b\n', ('a"', "b"), Dialect(), False),
            (b"\r\n\r\na;b;c\r\n1;2,5;3\r\n", ("a", "b", "c"), Dialect(";", "\r\n"), True),
            (b"a|b\rc|d\r", ("a", "b"), Dialect("|", "\r"), True),
            (b"a\tb, c\td\n1\t2, 3\t4\n", ("a", "b, c", "d"), Dialect("\t"), True),
            (b'a;"x;y\r\nz"\n1;2\n', ("a", "x;y\r\nz"), Dialect(";"), True),
            (b"score\n1\n2\n", ("score",), Dialect(), True), (b"score\n\n\n", ("score",), Dialect(), False),
            (b"a\x1eb\n1\x1e2\n", ("a", "b"), Dialect("\x1e"), True), (b"a\x1fb\n1\x1f2\n", ("a", "b"), Dialect("\x1f"), True),
            # commas of the comments do not make more steady fields than the tabs do
            (b"id\tcomment\n1\tone, two, three\n2\tfour\n", ("id", "comment"), Dialect("\t"), True)):
        for chunk in (1, 2, 3, 1000):
            assert read_head(io.BytesIO(text), chunk) == (names, dialect, more), (text, chunk)


def test_an_unreadable_file_is_an_error_row(spark, tmpdir_fresh):
    got = read_heads(spark, [os.path.join(tmpdir_fresh, "gone.csv"), "nosuch://host/x.csv"])
    assert all(h.headers is None and h.error for h in got.values()) and len(got) == 2


COLUMNS = ["respondent_id", "score", "feedback", "sprint_id"]


def in_dialect(rows, delimiter, line_end, blank=""):
    out = io.StringIO()
    lines = csv.writer(out, delimiter=delimiter, lineterminator=line_end)
    lines.writerow(COLUMNS)
    for r in rows:
        out.write(blank)
        lines.writerow(r)
    return (blank + out.getvalue() + blank).encode()


def test_every_delimiter_and_line_end_in_one_folder(spark, tmpdir_fresh):
    want = set()
    for d, delimiter in enumerate([",", ";", "\t", "|"]):
        for e, end in enumerate(["\n", "\r\n", "\r"]):
            rows = [(f"{d}{e}{i}", str(i), f"a, b; c\td | e \"{i}\"" + ("\nnext line\r\nlast" if i % 2 else ""), "Sprint 3") for i in range(4)]
            rows.append((f"{d}{e}x", "n/a", "no score", "Sprint 3"))
            want |= {r for r in rows if r[1] != "n/a"}
            for blank in ("", end):  # with and without empty lines, a first one among them
                with open(os.path.join(tmpdir_fresh, f"{d}{e}{len(blank)}.csv"), "wb") as f:
                    f.write(in_dialect(rows, delimiter, end, blank))
    clean, report = ingest_csv(spark, tmpdir_fresh)
    got = [(r.respondent_id, str(r.score), r.feedback, r.sprint_id) for r in clean.collect()]
    assert set(got) == want and len(got) == 2 * len(want)
    rep = report.collect()
    assert len(rep) == 24 and {(r.records, r.skipped, r.status, r.errors) for r in rep} == {
        (4, 1, "1 warning(s)", "Skipped 1 rows with invalid/missing scores")}
    assert not any(r.rejected for r in rep)


def test_split_files_of_every_line_end(spark, tmpdir_fresh):
    for e, end in enumerate(["\n", "\r\n", "\r"]):
        with open(os.path.join(tmpdir_fresh, f"{e}.csv"), "wb") as f:
            f.write(in_dialect([(f"{e}{i}", str(i % 11), "ok", "S") for i in range(2000)], ";", end, end))
    clean, report = ingest_csv(spark, tmpdir_fresh, multiline=False)
    assert clean.count() == clean.select("respondent_id").distinct().count() == 6000
    assert {(r.records, r.status) for r in report.collect()} == {(2000, "OK")}


def test_header_alone_is_fine_and_lost_rows_are_a_warning(spark, tmpdir_fresh):
    write_files(tmpdir_fresh, {"empty.csv": "", "header.csv": "score,id\n", "blank.csv": "score,id\r\n\r\n\r\n"})
    files = csv_files(spark, tmpdir_fresh)
    rep = {r.file_name: r for r in ingest_files(spark, files)[1].collect()}
    assert rep["header.csv"].status == rep["blank.csv"].status == "OK"
    assert rep["empty.csv"].rejected and not rep["header.csv"].rejected
    assert rep["empty.csv"].errors == "No score column found in headers: " and rep["empty.csv"].size == 0
    from dataclasses import replace

    from promoscope.sources.csv_ingest import ingest_report
    lost = ingest_report(spark, None, [replace(f, has_rows=True) for f in files if f.path.endswith("header.csv")]).collect()
    assert [(r.status, r.errors) for r in lost] == [("1 warning(s)", "No rows found after the header")]


def test_manifest_loads_repeated_entries_and_opens_only_listed_files(spark, tmpdir_fresh, monkeypatch):
    write_files(tmpdir_fresh, {f"s{i}.csv": f"score,respondent_id,sprint_id\n{i},r{i},Sprint 3\n" for i in range(5)} | {
        "manifest.json": '["s1.csv", "s3.csv", "gone.csv", "s1.csv", "s1.csv"]'})
    from promoscope.sources import csv_ingest

    asked = []
    monkeypatch.setattr(csv_ingest, "read_heads", lambda spark, paths: asked.extend(paths) or read_heads(spark, paths))
    clean, report = ingest_manifest(spark, os.path.join(tmpdir_fresh, "manifest.json"))
    assert sorted((r.respondent_id, r.file_order) for r in clean.collect()) == [("r1", 0), ("r1", 3), ("r1", 4), ("r3", 1)]
    assert [(r.file_name, r.file_order, r.records) for r in report.orderBy("file_order").collect()] == [
        ("s1.csv", 0, 1), ("s3.csv", 1, 1), ("gone.csv", 2, 0), ("s1.csv", 3, 1), ("s1.csv", 4, 1)]
    assert sorted(os.path.basename(p) for p in asked) == ["gone.csv", "s1.csv", "s3.csv"]


def test_files_of_other_names_are_taken_by_content_on_request(spark, tmpdir_fresh):
    write_files(tmpdir_fresh, {"a.csv": "score,id\n1,a\n", "b.txt": "score;id\n2;b\n", "notes.md": "nothing here\n"})
    with open(os.path.join(tmpdir_fresh, "picture.bin"), "wb") as f:
        f.write(bytes(range(256)) * 10)
    assert ingest_csv(spark, tmpdir_fresh)[0].count() == 1
    clean, report = ingest_csv(spark, tmpdir_fresh, by_content=True)
    assert sorted(r.respondent_id for r in clean.collect()) == ["a", "b"]
    rep = {r.file_name: (r.rejected, r.errors) for r in report.collect()}
    assert rep["b.txt"] == (False, "") and "binary content" in rep["picture.bin"][1]
    assert rep["notes.md"] == (True, "No score column found in headers: nothing here")


def test_a_table_is_written_without_a_shuffle(spark, tmpdir_fresh):
    """Wide rows go from the tasks that have them into the folders of their sprints: one stage."""
    n = 400
    made = [(f"Sprint {1 + i % 3}" if i % 4 else "", str(i), "9", "long comment " * 20) for i in range(n)]
    raw = spark.createDataFrame(made, "sprint_id string, respondent_id string, score string, feedback string").repartition(4)
    raw.write.parquet(os.path.join(tmpdir_fresh, "raw"))
    rows = clean_survey(spark.read.parquet(os.path.join(tmpdir_fresh, "raw")))
    tracker = spark.sparkContext.statusTracker()
    for name, write in (("table", lambda path: write_clean(rows, path)),
                        ("versions", lambda path: VersionedTable(spark, path).add_snapshot(rows))):
        spark.sparkContext.setJobGroup(name, name)
        try:
            write(os.path.join(tmpdir_fresh, name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = [s for job in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(job).stageIds]
        assert len(stages) == 1
    stored = read_clean(spark, os.path.join(tmpdir_fresh, "table"))
    assert sorted(map(tuple, stored.select("sprint_id", "respondent_id", "feedback").collect())) == sorted(
        (s, r, t.strip()) for s, r, _, t in made)
    assert {r.sprint_part for r in stored.select("sprint_part").distinct().collect()} == {
        "_blank", "Sprint 1", "Sprint 2", "Sprint 3"}


@pytest.mark.parametrize("sprint,part,n", [("Sprint 2", "Sprint 2", 1), ("", "_blank", 2), ("gone", "gone", 0)])
def test_one_sprint_is_read_from_its_partition(spark, tmpdir_fresh, sprint, part, n):
    rows = spark.createDataFrame([("Sprint 2", "1"), ("Sprint 3", "2"), ("", "3"), (" ", "4")], "sprint_id string, score string")
    write_clean(clean_survey(rows), tmpdir_fresh)
    one = of_sprint(read_clean(spark, tmpdir_fresh), sprint)
    assert one.count() == n
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert f" = {part})" in scan.split("PartitionFilters: [")[1].split("], ")[0]
