"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.session import ship_package as ship

# Fixed values of the contracts: white space and word, as regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` is the same on text that is all ASCII, and faster."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[list], list[tuple]], schema: T.StructType) -> DataFrame:
    """``fn`` gets the rows of a part of an Arrow batch as tuples and returns rows of ``schema``.

    Parts hold some MB of data, so a batch of long texts is not turned into Python objects at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                rows = fn(list(zip(*(c.to_pylist() for c in part.columns))))
                columns = list(zip(*rows)) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, part_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``part_bytes`` each (a longer row is a slice of its own)."""
    rows = max(1, int(batch.num_rows * part_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
