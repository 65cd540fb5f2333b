"""WARC archives: one gzip member per record, written and read sequentially.

``write_warc`` writes a record for every page.  Of the pages whose payloads are equal (by SHA-1) and
of ``min_revisit_bytes`` bytes or more, the one with the smallest id is a ``response`` record and the
others are ``revisit`` records without a payload that refer to it.  Tasks write archive files of
bounded size into a folder of the shared file system and return a manifest row per file; the manifest
is written by Spark's own commit, so the files of a task that was lost or ran twice are never listed.

``read_warc`` reads the archives of a manifest, a file per task.  A file is read from front to back
in blocks: members are decompressed incrementally, the record's length frames its content, SHA-1
digests of block and payload are taken while the content streams by and compared with the record's
headers.  Memory does not grow with the file or, unless payloads are asked for, with the record.

Defined cases: a null payload is empty; a null url writes no target header; a null id sorts last (a
group of null ids only is all ``response``); rows repeated under the smallest id are all ``response``;
an empty table writes no record and reads none; a damaged record gives a row with ``error`` and ends
its archive, all other rows have a null ``error``; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import parts, ship
from promoscope.sources.files import file_system

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
BLOCK = 1 << 18


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page: str | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}').urn}>"


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None,
           date: str) -> bytes:
    """An uncompressed WARC record."""
    digest = base32_sha1(hashlib.sha1(payload).digest())
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + CRLF + CRLF)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]|")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block).digest())}"),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to, digest)),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("X-Page-ID", page),
        ("X-Refers-To-Page-ID", refers_to),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()
    return VERSION + CRLF + head + CRLF + block + CRLF + CRLF


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(Exception):
    pass


class Members:
    """The gzip members of a stream, one after the other, decompressed as they are read."""

    def __init__(self, stream):
        self.stream, self.raw, self.place = stream, b"", 0
        self.inflate = None
        self.ready = b""

    def start(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        if not self.raw:
            self.raw = self.stream.read(BLOCK)
        if not self.raw:
            return False
        self.inflate, self.ready = zlib.decompressobj(31), b""
        return True

    def more(self) -> bool:
        """Decompress some more of this member; False at its end."""
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(BLOCK)
            if not self.raw:
                raise Damaged("the archive ends within a record")
        given = self.raw
        try:
            self.ready += self.inflate.decompress(given, BLOCK)
        except zlib.error as e:
            raise Damaged(f"not a gzip member: {e}") from e
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.place += len(given) - len(self.raw)
        return True

    def line(self) -> bytes:
        """A header line, however long: only the end of the member bounds it."""
        found: list[bytes] = []
        while (end := self.ready.find(CRLF)) < 0:
            # a last CR may be half of the line's end
            keep = len(self.ready) - self.ready.endswith(b"\r")
            found.append(self.ready[:keep])
            self.ready = self.ready[keep:]
            if not self.more():
                raise Damaged("a header line does not end")
        found.append(self.ready[:end])
        self.ready = self.ready[end + 2:]
        return b"".join(found)

    def content(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self.more():
                raise Damaged("the content is shorter than its length")
            out, self.ready = self.ready[:size], self.ready[size:]
            size -= len(out)
            if out:
                yield out

    def finish(self) -> None:
        while self.more():
            pass
        if self.ready != CRLF + CRLF:
            raise Damaged("the record does not end where its length says")


def one_record(members: Members, with_payload: bool) -> dict:
    if members.line() != VERSION:
        raise Damaged("not a WARC record")
    fields: dict[str, str] = {}
    while line := members.line():
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("a header without a name")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    http = fields.get("content-type", "").startswith("application/http")
    block, payload, size = hashlib.sha1(), hashlib.sha1(), 0
    head, kept = b"" if http else None, []
    for piece in members.content(int(fields["content-length"])):
        block.update(piece)
        if head is not None:  # still within the HTTP head
            head += piece
            end = head.find(CRLF + CRLF)
            if end < 0:
                continue
            piece, head = head[end + 4:], None
        payload.update(piece)
        size += len(piece)
        if with_payload:
            kept.append(piece)
    members.finish()
    revisit = fields.get("warc-type") == "revisit"
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    found = said if revisit else base32_sha1(payload.digest())
    if said and said != found:
        raise Damaged("the payload does not have its digest")
    if (b := fields.get("warc-block-digest")) and b != f"sha1:{base32_sha1(block.digest())}":
        raise Damaged("the block does not have its digest")
    length = fields.get("x-payload-length", "") if revisit else ""
    return {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"), "page": fields.get("x-page-id"),
        "refers_to_record": fields.get("warc-refers-to"),
        "refers_to_page": fields.get("x-refers-to-page-id"),
        "payload_bytes": int(length) if length.isdigit() else None if revisit else size,
        "payload_digest": found, "error": None,
        "payload": b"".join(kept) if with_payload and not revisit else None,
    }


def archive_records(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive stream, with the place of each one's member."""
    members = Members(stream)
    try:
        while members.start():
            at = members.place
            yield one_record(members, with_payload) | {"offset": at}
    except Damaged as e:
        yield dict.fromkeys(RECORD.names) | {"offset": members.place, "error": str(e)}


RECORD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()),
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("page", T.StringType()),
    T.StructField("refers_to_record", T.StringType()),
    T.StructField("refers_to_page", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])
MANIFEST = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
])


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None,
                  min_revisit_bytes: int) -> DataFrame:
    """(page, url, payload, refers_to): the ids as text, refers_to null for responses."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    src = pages.select(
        F.col(id_col).alias("id"), payload.alias("payload"), F.sha1(payload).alias("digest"),
        (F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")).alias("url"))
    firsts = (
        src.filter(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    )
    # a hash join with the small rows as its table: pages are dealt out, but not sorted
    both = src.join(firsts.hint("shuffle_hash"), "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return both.select(F.col("id").cast("string").alias("page"), "url", "payload",
                       F.when(other, F.col("first").cast("string")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html",
               url_col: str | None = "url", min_revisit_bytes: int = 0,
               archive_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write archives below ``folder`` (shared by all executors) and return their manifest."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pages.sparkSession
    ship(spark)
    schema = to_arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = file_system(f"{folder}/archives")
        where.create_dir(base, recursive=True)
        task, made, out = TaskContext.get(), [], None
        name = f"{task.partitionId():06d}-{uuid.uuid4().hex[:12]}"  # of this attempt alone
        for batch in batches:
            for part in parts(batch):
                for page, url, payload, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    if out is None or made[-1][2] >= archive_bytes:
                        if out is not None:
                            out.close()
                        file = f"archives/{name}-{len(made):04d}.warc.gz"
                        out = where.open_output_stream(f"{base.removesuffix('/archives')}/{file}")
                        made.append([f"{folder}/{file}", 0, 0])
                    data = member(record(page, url, payload, refers_to, date))
                    out.write(data)
                    made[-1][1] += 1
                    made[-1][2] += len(data)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[i] for m in made], f.type) for i, f in enumerate(schema)], schema=schema)

    src = with_revisits(pages, id_col, payload_col, url_col, min_revisit_bytes)
    src.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_warc(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all archives that ``manifest`` (a column ``path``) lists."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(spark)
    schema = RECORD if with_payload else T.StructType(RECORD.fields[:-1])
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = file_system(path)
                rows, size = [], 0
                with where.open_input_stream(name) as stream:
                    for r in archive_records(stream, with_payload):
                        rows.append(r | {"path": path})
                        size += 200 + len(r.get("payload") or b"")
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(run, schema)
