"""Survey CSV files derived from the driver tables, plus CSV export (S13) and the file catalogue.

``write_survey_csvs`` writes the raw survey rows as CSV files the way survey exports arrive: one file
per sprint and range of respondents, in five header layouts and dialects (canonical names behind a byte
order mark with quoted headers and CRLF ends; alias layouts with other column orders, delimited by
semicolons, by tabs with CRLF ends and empty lines, and by bars with CR ends; and one layout without a
score column).  Ranges of respondents are of a fixed width, so the number of files grows with the rows and
their size does not, and all rows of a respondent and sprint are in one file, in their order.
"""

from __future__ import annotations

import csv
import io
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.operators.clean import sprint_part
from promoscope.session import scratch_path, ship_package
from promoscope.sources.csv_ingest import CSV_OPTIONS, CsvFile
from promoscope.sources.dialect import BOM
from promoscope.sources.dims import SPRINT_CALENDAR, calendar_index
from promoscope.sources.driver_tables import survey_raw, survey_resend
from promoscope.sources.files import file_system

# header layouts: (header as written, canonical field); None = extra column
LAYOUTS: dict[str, list[tuple[str, str | None]]] = {
    "A": [("respondent_id", "respondent_id"), (" score ", "score"), ("feedback", "feedback"),
          ("nps_reason_primary", "nps_reason_primary"), ("plan_type", "plan_type"), ("city", "city"),
          ("tenure_days", "tenure_days"), ("tenure_cut", "tenure_cut"), ("source", "source"),
          ("sprint_id", "sprint_id"), ("sprint_start", "sprint_start"),
          ("first_time_user", "first_time_user")],
    "B": [("cycle", "sprint_id"), ("Rating", "score"), ("comment", "feedback"), ("ID", "respondent_id"),
          ("Reason", "nps_reason_primary"), ("Plan", "plan_type"), ("Location", "city"),
          ("Tenure", "tenure_days"), ("tenure_bucket", "tenure_cut"), ("Channel", "source"),
          ("date", "sprint_start"), ("First Time User?", "first_time_user")],
    "C": [("nps_score", "score"), ("notes", None), ("verbatim", "feedback"), ("user_id", "respondent_id"),
          ("primary_reason", "nps_reason_primary"), ("segment", "plan_type"), ("geography", "city"),
          ("days_since_activation", "tenure_days"), ("tenure_segment", "tenure_cut"),
          ("survey_channel", "source"), ("sprint", "sprint_id"), ("created_at", "sprint_start"),
          ("new_to_wifi", "first_time_user")],
    "D": [("id", "respondent_id"), ("cycle", "sprint_id"), ("comment", "feedback")],
    "E": [("acquisition_source", "source"), ("nps_rating", "score"), ("open_text", "feedback"),
          ("customer_id", "respondent_id"), ("primary_reason", "nps_reason_primary"), ("product", "plan_type"),
          ("region", "city"), ("tenure", "tenure_days"), ("tenure_segment", "tenure_cut"), ("sprint", "sprint_id"),
          ("timestamp", "sprint_start"), ("is_first_time_user", "first_time_user")],
}


@dataclass(frozen=True)
class Style:
    """How the files of a layout are written; Spark's own writer does those with plain line ends."""

    delimiter: str = ","
    line_end: str = "\n"
    mark: bool = False  # a byte order mark
    quote_all: bool = False
    empty_lines: int = 0  # an empty line before the header, at the end, and after every so many rows


STYLES = {"A": Style(line_end="\r\n", mark=True, quote_all=True), "B": Style(delimiter=";"),
          "C": Style(delimiter="\t", line_end="\r\n", empty_lines=7), "D": Style(),
          "E": Style(delimiter="|", line_end="\r", empty_lines=5)}


# layout of each calendar sprint: Sprint 1-7 -> A, 8-14 -> B, RSP 1-4 -> E, RSP 5-7 -> C; others -> D
_CAL = [s[0] for s in SPRINT_CALENDAR]
LAYOUT_SPRINTS = {"A": _CAL[0:7], "B": _CAL[7:14], "E": _CAL[14:18], "C": _CAL[18:]}


def layout_of(sprint_id: Column) -> Column:
    """The header layout a sprint's file is written in (D: no score column)."""
    out = F.lit("D")
    for name in LAYOUT_SPRINTS:
        out = F.when(sprint_id.isin(*LAYOUT_SPRINTS[name]), F.lit(name)).otherwise(out)
    return out


def layouts_for(sprints: list[str]) -> list[str]:
    """The layouts files of the given sprints are written in."""
    return sorted({next((k for k, v in LAYOUT_SPRINTS.items() if s in v), "D") for s in sprints})


RESPONDENTS_PER_FILE = 50_000


def file_key(sprint_id: Column, respondent_id: Column) -> Column:
    key = F.when(sprint_id == "", F.lit("_blank")).otherwise(
        F.regexp_replace(F.lower(sprint_id), " ", "_"))
    number = F.coalesce(F.regexp_extract(respondent_id, r"^([0-9]+)", 1).try_cast("bigint"), F.lit(0))
    part = F.floor(number / RESPONDENTS_PER_FILE).cast("string")
    return F.concat(layout_of(sprint_id), F.lit("_"), key, F.lit("_"), part)


def write_survey_csvs(raw: DataFrame, out: str, mode: str = "overwrite",
                      layouts: list[str] | None = None) -> None:
    """Write raw survey rows as CSV files, one directory with one file per ``file_key``.

    ``mode="append"`` adds a later arrival of files next to the existing ones.  The rows are derived
    once, into the shared folder by layout; every layout's write reads its own part of that.
    """
    spark = raw.sparkSession
    staged = scratch_path(spark, "survey_rows")
    (raw.withColumn("file_key", file_key(F.col("sprint_id"), F.col("respondent_id")))
        .withColumn("layout", layout_of(F.col("sprint_id"))).write.partitionBy("layout").parquet(staged))
    rows = spark.read.option("basePath", staged).parquet(staged)
    for layout in layouts or list(LAYOUTS):
        fields = LAYOUTS[layout]
        style = STYLES[layout]
        part = (rows.filter(F.col("layout") == layout).repartition("file_key")
                    .sortWithinPartitions("file_key", "row_seq").select(*[(F.col(f) if f is not None else F.lit("")).alias(h) for h, f in fields], "file_key"))
        if style == Style(delimiter=style.delimiter):
            (part.write.mode(mode).partitionBy("file_key").options(**CSV_OPTIONS)
             .option("sep", style.delimiter).csv(f"{out}/{layout}"))
        else:
            _write_styled(part, f"{out}/{layout}", style)


def _write_styled(rows: DataFrame, out: str, style: Style) -> None:
    """Files as some exporters write them and Spark's writer cannot.  A task writes its files one after
    the other as their rows come in; one that runs again writes them again."""
    ship_package(rows.sparkSession)
    arrival = uuid.uuid4().hex[:12]
    names = [c for c in rows.columns if c != "file_key"]

    def write(batches):
        import pandas as pd

        now, stream, where, text, lines, written = None, None, None, io.StringIO(), None, {}

        def flush() -> None:
            stream.write(text.getvalue().encode())
            text.seek(0)
            text.truncate()

        def close() -> None:
            if style.empty_lines:
                text.write(style.line_end)
            flush()
            stream.close()
            folder = file_system(f"{out}/file_key={now}")[1]
            where.move(f"{folder}/_{arrival}", f"{folder}/survey-{arrival}.csv")

        for pdf in batches:
            for row in pdf[names + ["file_key"]].fillna("").itertuples(index=False):
                *values, key = row
                if key != now:
                    if now is not None:
                        close()
                    now = key
                    where, folder = file_system(f"{out}/file_key={key}")
                    where.create_dir(folder, recursive=True)
                    stream = where.open_output_stream(f"{folder}/_{arrival}")
                    text.write((BOM if style.mark else "") + style.line_end * bool(style.empty_lines))
                    lines = csv.writer(text, delimiter=style.delimiter, lineterminator=style.line_end,
                                       quoting=csv.QUOTE_ALL if style.quote_all else csv.QUOTE_MINIMAL)
                    lines.writerow(names)
                    written[key] = 0
                written[key] += 1
                if style.empty_lines and written[key] % style.empty_lines == 0:
                    text.write(style.line_end)
                lines.writerow(values)
            if now is not None:
                flush()
        if now is not None:
            close()
        yield pd.DataFrame({"file_key": list(written), "n": list(written.values())})

    rows.mapInPandas(write, "file_key string, n bigint").agg(F.sum("n")).collect()


_LOCK = threading.Lock()
_DIRS: dict[tuple[str, str, str], str] = {}


def survey_csv_dir(spark: SparkSession, sf_dir: str, kind: str = "base") -> str:
    """CSV files of the survey (``base``) or of the re-sent sprints (``resend``),
    written once per application below the checkpoint dir."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), kind)
    with _LOCK:
        d = _DIRS.get(key)
        if d is None:
            d = scratch_path(spark, f"survey_csv_{kind}")
            raw = survey_raw(spark, sf_dir) if kind == "base" else survey_resend(spark, sf_dir)
            write_survey_csvs(raw, d)
            _DIRS[key] = d
    return d


# ---------------------------------------------------------------------------
# S13 export, S11 catalogue
# ---------------------------------------------------------------------------

EXPORT_FIELDS = ["respondent_id", "score", "feedback", "nps_reason_primary", "nps_reason_secondary",
                 "plan_type", "city", "tenure_days", "tenure_cut", "source", "sprint_id",
                 "sprint_start", "first_time_user", "theme", "month", "quarter"]


def export_csv(clean: DataFrame, out: str, sprint: str | None = None) -> None:
    """CSV per sprint (one sprint or all), partitioned on the ``sprint_part``
    copy so ``sprint_id`` stays in the files (Q24) and re-ingest works."""
    df = clean if sprint is None else of_sprint(clean, sprint)
    (df.select(*[F.col(c).cast("string") for c in EXPORT_FIELDS], "sprint_part")
       .write.mode("overwrite").partitionBy("sprint_part").options(**CSV_OPTIONS).csv(out))


def of_sprint(clean: DataFrame, sprint: str) -> DataFrame:
    """The rows of one sprint; only its partition of a stored table is listed and read."""
    return clean.filter((F.col("sprint_part") == sprint_part(F.lit(sprint))) & (F.col("sprint_id") == sprint))


def file_catalogue(spark: SparkSession, files: list[CsvFile], clean: DataFrame) -> DataFrame:
    """File name, byte size, response count, total size; sprint order.

    Counts join on the file each response came from (``src_file``, the same encoded path in listing and
    scan), not on a name pattern (Q19).
    """
    fdf = spark.createDataFrame([(f.uri, f.path.rsplit("/", 1)[-1], f.size) for f in files],
                                "file string, file_name string, size bigint")
    counts = clean.groupBy(F.col("src_file").alias("file")).agg(
        F.count(F.lit(1)).cast("bigint").alias("responses"),
        F.min(calendar_index(F.col("sprint_id"))).alias("sprint_ord"))
    cat = fdf.join(counts, "file", "left").withColumn(
        "responses", F.coalesce("responses", F.lit(0).cast("bigint")))
    total = sum(f.size for f in files)
    return cat.select("file", "file_name", "size", "responses",
                      F.coalesce("sprint_ord", F.lit(999)).alias("sprint_ord"),
                      F.lit(total).cast("bigint").alias("total_size"))


__all__ = ["LAYOUTS", "write_survey_csvs", "survey_csv_dir", "export_csv", "file_catalogue"]
