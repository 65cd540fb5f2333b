"""WARC archives: round trips, framing, digests and damage."""

import base64
import gzip
import hashlib
import io
import random
from urllib.parse import quote

import pytest

from promoscope.llm.queries import warc_pages
from promoscope.llm.warc import BLOCK, archive_records, file_system, member, read_warc, record, write_warc
from promoscope.session import scratch_path

DATE = "2020-01-01T00:00:00Z"


def pages(spark, rows):
    path = scratch_path(spark, "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_round_trip(spark):
    rows = [
        (1, "http://a/1", "one"), (2, "http://a/2", "two"), (3, None, "one"), (4, "http://a/\r\nX: y", None),
        (5, "http://a/5", ""), (6, "http://a/é", "ü" * 700_000), (7, "u", "one"), (2, "http://a/2", "two"), (None, "n", "two"),
    ]
    folder = scratch_path(spark, "warc")
    manifest = write_warc(pages(spark, rows), folder, archive_bytes=200)
    got = read_warc(spark, manifest, with_payload=True).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    firsts = {"one": 1, "two": 2, "": 4, "ü" * 700_000: 6}
    seen = []
    for r in got:
        page = None if r["page"] is None else int(r["page"])
        payload = next((h or "") for i, _, h in rows if i == page)
        digest = base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload.encode()), digest)
        first = firsts[payload]
        assert r["record_type"] == ("response" if page == first else "revisit")
        assert r["refers_to_page"] == (None if page == first else str(first))
        if page == first:
            assert bytes(r["payload"]) == payload.encode()
            seen.append(r["record_id"])
    assert {r["refers_to_record"] for r in got if r["record_type"] == "revisit"} <= set(seen)
    paths = [r["path"] for r in manifest.collect()]
    assert len(paths) > 2  # archives roll over
    where, name = file_system(paths[0])
    with where.open_input_stream(name) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")


def test_short_payloads_are_all_responses(spark):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")]
    manifest = write_warc(pages(spark, rows), scratch_path(spark, "warc"), min_revisit_bytes=3)
    got = {int(r["page"]): r["record_type"] for r in read_warc(spark, manifest).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def archive(*payloads):
    return b"".join(member(record(str(i), f"http://x/{i}", p, None, DATE)) for i, p in enumerate(payloads))


def read(data):
    return list(archive_records(io.BytesIO(data), with_payload=True))


def test_members_are_read_one_by_one():
    payloads = [b"a", b"", b"\r\n\r\n", b"x" * 3_000_000, b"last"]
    got = read(archive(*payloads))
    assert [r["payload"] for r in got] == payloads
    assert [r["offset"] for r in got] == sorted({r["offset"] for r in got})
    data = archive(*payloads)
    for r in got:  # every offset is the start of a member
        assert data[r["offset"]:r["offset"] + 2] == b"\x1f\x8b"


def test_header_lines_have_no_longest_length():
    rng = random.Random(3)
    urls = ["u" * 3_000_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1_500_000)), "é" * 600_000, "v"]
    for shift in range(3):
        urls.append("w" * (BLOCK - 300 + shift))
    got = read(b"".join(member(record(str(i), u, b"body", None, DATE)) for i, u in enumerate(urls)))
    assert [r["target_uri"] for r in got] == [quote(u) for u in urls]
    assert all(r["error"] is None for r in got)


def test_a_line_end_may_fall_between_two_blocks():
    head = len(record("1", "", b"body", None, DATE).split(b"\r\nWARC-Payload-Digest")[0])
    for length in range(BLOCK - head - 3, BLOCK - head + 4):
        got = read(member(record("1", "w" * length, b"body", None, DATE)))
        assert [(r["target_uri"], r["error"]) for r in got] == [("w" * length, None)]


def test_the_query_raises_on_damage(spark):
    folder = scratch_path(spark, "warc")
    manifest = write_warc(pages(spark, [(1, "http://a/1", "one"), (2, "http://a/2", "two")]), folder)
    assert warc_pages(read_warc(spark, manifest)).count() == 2
    for r in manifest.collect():
        where, name = file_system(r["path"])
        with where.open_input_stream(name) as f:
            data = f.read()
        with where.open_output_stream(name) as f:
            f.write(data[:-20])
    with pytest.raises(Exception, match="damaged archive"):
        warc_pages(read_warc(spark, manifest)).collect()


@pytest.mark.parametrize("cut", [1, 10, 100, 150])
def test_a_cut_archive_ends_with_an_error(cut):
    data = archive(b"first", b"second" * 50)
    got = read(data[:-cut])
    assert got[0]["payload"] == b"first" and got[0]["error"] is None
    assert len(got) == 2 and got[1]["error"]


def test_wrong_digest_and_framing_are_errors():
    good = record("1", "u", b"payload", None, DATE)
    assert read(member(good))[0]["error"] is None
    assert "digest" in read(member(good.replace(b"payload", b"pAyload")))[0]["error"]
    assert read(member(good[:-1]))[0]["error"]
    assert read(member(good + b"x"))[0]["error"]
    assert read(b"not gzip at all")[0]["error"]
    assert read(b"") == []
