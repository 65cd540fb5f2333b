"""Survey CSV ingest with flexible headers, and the per-file ingest report.

Plan:
1. List the CSV files (S8) through Spark's file index (``files.list_files``); on request also files of
   other names, which are taken as CSV by their content.
2. Read the head of every file in one Spark job over the file list: its dialect (delimiter and line end,
   ``sources.dialect``) and its header record - the first non-blank one, however long.  A file that
   cannot be opened, or has binary content, becomes an error row of the report.
3. Group files by header and dialect (Q9: one CSV scan over files with different column orders would map
   columns by position using one header); resolve each canonical field to the first matching alias
   (S2); a header without a score column yields error rows only (S3).
4. One distributed scan per group (all-string positional schema, its own delimiter and line end,
   ``multiLine`` quoting, RFC-4180 escapes), projected to canonical names and combined with
   ``unionByName`` (S5).  Empty lines are no rows, whatever the line end.
5. Cleaning is ``operators.clean.clean_survey``; the report counts kept and skipped rows per file
   (S4, S9) in the same pass structure.

Order for last-wins upserts: ``ingest_batch``, then ``file_order`` (the file's modification time, or
its place in a manifest), then ``src_file`` and ``row_seq`` (place in the file).  All of them come from
the scan itself (``_metadata``), so no row is ever joined with a file list to get them; ``src_file`` is
``_metadata.file_path`` in scans and listings alike.

The driver holds one row per file (path, size, time, header), as Spark's own file index does.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.functions.columns import js_int_prefix, js_trim
from promoscope.operators.clean import clean_survey
from promoscope.operators.dimensions import Dimensions
from promoscope.session import ship_package
from promoscope.sources import dims
from promoscope.sources.dialect import COMMA, Dialect, read_head
from promoscope.sources.files import ANY_GLOB, CSV_GLOB, all_files, exists, file_system, list_files, literal_path

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "sep": ",",
    # a given line end keeps others inside quotes as they are
    "lineSep": "\n",
    "escape": '"',
    "quote": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "mode": "PERMISSIVE",
    "encoding": "UTF-8",
}

FILES_PER_TASK = 64  # header reads of one task


@dataclass(frozen=True)
class CsvFile:
    path: str
    uri: str
    size: int
    order: int
    headers: tuple[str, ...] | None
    error: str | None
    dialect: Dialect = COMMA
    has_rows: bool = False  # whether there is anything but line ends after the header
    modified: int = 0


@dataclass(frozen=True)
class Head:
    """What the head of a file says."""

    headers: tuple[str, ...] | None
    error: str | None
    dialect: Dialect = COMMA
    has_rows: bool = False


def _heads_of(batches):
    """mapInPandas body: path -> its head as JSON, or the reason why it could not be read."""
    import pandas as pd

    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            try:
                where, name = file_system(path)
                with where.open_input_stream(name) as stream:
                    headers, dialect, has_rows = read_head(stream)
                rows.append((path, json.dumps([headers, dialect.delimiter, dialect.line_end, has_rows]), None))
            except Exception as e:  # noqa: BLE001 - whatever keeps a file from being read is reported with it
                rows.append((path, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "head", "error"])


def read_heads(spark: SparkSession, paths: list[str]) -> dict[str, Head]:
    """path -> head, read on the executors; only these files are opened."""
    if not paths:
        return {}
    ship_package(spark)
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(-(-len(paths) // FILES_PER_TASK))
    got = files.mapInPandas(_heads_of, "path string, head string, error string").collect()
    out = {}
    for r in got:
        if r.head is None:
            out[r.path] = Head(None, r.error)
        else:
            headers, delimiter, line_end, has_rows = json.loads(r.head)
            out[r.path] = Head(tuple(headers), None, Dialect(delimiter, line_end), has_rows)
    return out


def resolve_columns(headers: tuple[str, ...]) -> dict[str, int]:
    """Canonical field -> header position (first alias in alias order wins)."""
    lower = [h.lower().strip() for h in headers]
    out: dict[str, int] = {}
    for field, aliases in dims.HEADER_ALIASES.items():
        for alias in aliases:
            if alias.lower() in lower:
                out[field] = lower.index(alias.lower())
                break
    return out


def csv_files(spark: SparkSession, paths: list[str] | str, by_content: bool = False) -> list[CsvFile]:
    """The CSV files at or below the paths (missing ones are left out), with their heads.

    CSV files are known by their names; ``by_content`` takes all files, and those that are no text become
    error rows.
    """
    wanted = [p for p in ([paths] if isinstance(paths, str) else paths) if exists(spark, p)]
    if not wanted:
        return []
    found = [literal_path(p) for p in wanted]
    glob = ANY_GLOB if by_content else CSV_GLOB
    files = with_heads(spark, list_files(spark, found, glob))
    # a scan gives no row for a file without a byte
    known = {_plain(f.path) for f in files}
    empty = sorted(u for u in all_files(spark, found, glob) if _plain(unquote(u)) not in known)
    return [CsvFile(unquote(u), u, 0, 0, (), None) for u in empty] + files


def with_heads(spark: SparkSession, listing: DataFrame, heads: dict[str, Head] | None = None) -> list[CsvFile]:
    """Files of a listing (path, uri, size, modified), by time and path."""
    rows = sorted({tuple(r) for r in listing.select("modified", "path", "uri", "size").collect()})
    heads = read_heads(spark, [path for _, path, _, _ in rows]) if heads is None else heads
    return [CsvFile(path, uri, size, modified, h.headers, h.error, h.dialect, h.has_rows, modified)
            for modified, path, uri, size in rows for h in [heads[path]]]


def scan_files(spark: SparkSession, files: list[CsvFile], ingest_batch: int = 0,
               multiline: bool = True) -> DataFrame | None:
    """Raw canonical-string rows of all readable files with a score column; None if there is none.

    ``multiline=True`` accepts quoted newlines but reads each file in one task; for large inputs known
    to have none, ``multiline=False`` lets Spark split files into ``spark.sql.files.maxPartitionBytes``
    chunks.  (Row order inside a file - the last-wins order - is then kept per split.)

    The union of one scan per header and dialect: the canonical fields present in any of them, and
    ``ingest_batch``, ``file_order``, ``src_file``, ``row_seq``.
    """
    groups: dict[tuple, dict[str, CsvFile]] = {}
    for f in files:
        if rejection(f) is None:
            groups.setdefault((f.headers, f.dialect), {})[f.path] = f
    raw = None
    for (headers, dialect), members in groups.items():
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType(), True) for i in range(len(headers))])
        df = (spark.read.schema(schema).options(**CSV_OPTIONS)
              .option("multiLine", "true" if multiline else "false")
              .option("sep", dialect.delimiter).option("lineSep", dialect.line_end)
              .option("maxColumns", str(max(20480, len(headers) + 1)))
              .csv([literal_path(p) for p in members]))
        df = df.select(*[F.col(f"_c{i}").alias(field) for field, i in resolve_columns(headers).items()],
                       F.unix_micros("_metadata.file_modification_time").alias("file_order"),
                       F.col("_metadata.file_path").alias("src_file"))
        raw = df if raw is None else raw.unionByName(df, allowMissingColumns=True)
    if raw is None:
        return None
    return raw.withColumn("ingest_batch", F.lit(ingest_batch).cast("bigint")).withColumn(
        "row_seq", F.monotonically_increasing_id())


def rejection(f: CsvFile) -> str | None:
    """S3: why a file gives no rows at all, if so."""
    if f.error is None and "score" not in resolve_columns(f.headers or ()):
        return "No score column found in headers: " + ", ".join(f.headers or ())
    return f.error


def ingest_csv(spark: SparkSession, paths: list[str] | str, ingest_batch: int = 0, multiline: bool = True,
               by_content: bool = False, tables: Dimensions | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(clean rows, ingest report) for the CSV files under ``paths``."""
    return ingest_files(spark, csv_files(spark, paths, by_content), ingest_batch, multiline, tables)


def ingest_files(spark: SparkSession, files: list[CsvFile], ingest_batch: int = 0, multiline: bool = True,
                 tables: Dimensions | None = None) -> tuple[DataFrame | None, DataFrame]:
    raw = scan_files(spark, files, ingest_batch, multiline)
    return clean_survey(raw, tables) if raw is not None else None, ingest_report(spark, raw, files)


def ingest_report(spark: SparkSession, raw: DataFrame | None, files: list[CsvFile]) -> DataFrame:
    """Per file: records kept, rows skipped, warnings, status; newest first.

    A file that is listed more than once (with other orders) has a row for each time.  ``rejected`` files
    gave no rows at all.
    """
    meta = [(f.uri, f.path.rsplit("/", 1)[-1], f.size, f.modified, f.order, rejection(f), f.has_rows, f.path) for f in files]
    m = spark.createDataFrame(meta, "file string, file_name string, size bigint, modified bigint, file_order bigint, "
                                    "header_error string, has_rows boolean, path string")
    if raw is not None:
        ok = js_int_prefix(js_trim(F.col("score"))).isNotNull()
        counts = raw.groupBy(F.col("src_file").alias("file"), "file_order").agg(
            F.count_if(ok).cast("bigint").alias("records"),
            F.count_if(~ok).cast("bigint").alias("skipped"))
        m = m.join(counts, ["file", "file_order"], "left")
    else:
        m = m.withColumn("records", F.lit(None).cast("bigint")).withColumn("skipped", F.lit(None).cast("bigint"))
    m = (m.withColumn("records", F.coalesce("records", F.lit(0).cast("bigint")))
          .withColumn("skipped", F.coalesce("skipped", F.lit(0).cast("bigint"))))
    skipped_msg = F.when(F.col("skipped") > 0, F.concat(F.lit("Skipped "), F.col("skipped").cast("string"),
                                                          F.lit(" rows with invalid/missing scores")))
    # there is something after the header, but none of it was read as a row
    unread = F.col("header_error").isNull() & F.col("has_rows") & (F.col("records") + F.col("skipped") == 0)
    errors = F.concat_ws("; ", F.col("header_error"), skipped_msg,
                         F.when(unread, F.lit("No rows found after the header")))
    warnings = (F.when(F.col("header_error").isNotNull(), 1).otherwise(0)
                + F.when(F.col("skipped") > 0, 1).otherwise(0) + F.when(unread, 1).otherwise(0))
    return (m.withColumn("errors", errors).withColumn("warnings", warnings)
             .withColumn("status", F.when(F.col("warnings") == 0, F.lit("OK"))
                         .otherwise(F.concat(F.col("warnings").cast("string"), F.lit(" warning(s)"))))
             .withColumn("rejected", F.col("header_error").isNotNull())
             # newest first, as the ingest log shows it (one row per file, as many as the driver listed)
             .withColumn("log_rank", F.row_number().over(
                 Window.orderBy(F.col("file_order").desc(), F.col("file").desc())))
             .select("file", "file_name", "size", "file_order", "records", "skipped", "warnings",
                     "status", "errors", "log_rank", "path", "modified", "rejected"))


def read_manifest(spark: SparkSession, manifest_path: str) -> list[str]:
    """The JSON array of file names in a manifest, resolved against its folder."""
    text = spark.read.option("wholetext", "true").text(literal_path(manifest_path)).first()[0]
    base = manifest_path.rsplit("/", 1)[0]
    return [n if "://" in n or n.startswith(("/", "file:")) else f"{base}/{n}" for n in json.loads(text)]


def ingest_manifest(spark: SparkSession, manifest_path: str, ingest_batch: int = 0,
                    tables: Dimensions | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Load every file a manifest lists, in manifest order; a missing or unreadable file becomes a
    report row with 0 records and does not stop the rest.  A file that is listed twice is loaded twice
    (no dedup, Q11).  Only the listed files are opened and looked up, not the folders they are in.
    """
    listed = read_manifest(spark, manifest_path)
    places: dict[str, list[int]] = {}
    for i, p in enumerate(listed):
        places.setdefault(_plain(p), []).append(i)
    heads = read_heads(spark, sorted(places))
    there = [p for p in places if heads[p].error is None]
    found = {}
    if there:
        listing = list_files(spark, [literal_path(p) for p in there], ANY_GLOB)
        by_path = {_plain(r.path): r.path for r in listing.select("path").distinct().collect()}
        found = {_plain(f.path): f for f in with_heads(spark, listing, {q: heads[p] for p, q in by_path.items()})}
    files = [replace(found[p], order=i) if p in found else CsvFile(listed[i], listed[i], 0, i, None, missing(heads[p], listed[i]))
             for p, at in places.items() for i in at]
    files.sort(key=lambda f: f.order)
    raw = scan_files(spark, files, ingest_batch)
    if raw is not None:
        # the place in the manifest takes the file time's part, and a file listed twice gives its rows twice
        order = spark.createDataFrame([(f.uri, f.order) for f in files], "src_file string, file_order bigint")
        raw = raw.drop("file_order").join(order, "src_file")
    return clean_survey(raw, tables) if raw is not None else None, ingest_report(spark, raw, files)


def missing(head: Head, path: str) -> str:
    if head.error is None or "FileNotFoundError" in head.error:
        return "File not found: " + path
    return head.error


def _plain(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)
