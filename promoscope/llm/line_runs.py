"""Line dedup by levelled sorted runs of line hashes.

``LineRuns`` is a store of (line hash, number of documents) runs in the shared folder.  Documents
come in batches.  A batch's distinct (line, document) pairs are counted per line; lines that the
runs already show to be frequent are merge-anti-joined away (they are decided and need no further
count), and the rest is added as a sorted run of level 0.  When a level has ``fanout`` runs they are
compacted into one run of the next level (counts summed), so a store of n batches keeps about
``fanout * log(n)`` runs.  A line is frequent when its counts over all runs reach ``min_docs``;
``min_docs`` = 2 with ``keep_first`` left to the caller is the plain "seen before" test.

Only DataFrame operations are used.  Hashes are pairs of 64-bit hashes.  Counting is pre-aggregated
before each shuffle, so a line found in a third of all rows is one row per task and batch.  The frequent
lines of a text are known by their places, and each text loses its own in time linear in its lines.

Defined cases of ``drop_frequent_lines``: a null or empty text is one empty line and stays; empty
keys are never dropped; a document is a ``doc_id``, so rows repeated under one id count once, and
each of them is cleaned alike; rows with a null id count as one document; an empty table gives an
empty result; other columns are passed through by the caller, none of them is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.llm.common import SPACE_CHARS, lower_ascii, text_or_empty
from promoscope.session import scratch_path

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs) below one folder."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int, fanout: int = 3):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder, min_docs, fanout
        self.levels: dict[int, list[str]] = {}
        self.written = 0

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/run-{self.written:05d}-level-{level}"
        self.written += 1
        # the counts come out partitioned by the (uniform) hash, so a sort is all that is left
        run.sortWithinPartitions(*HASH).write.parquet(path)
        self.levels.setdefault(level, []).append(path)

    def totals(self, paths: list[str] | None = None) -> DataFrame | None:
        """(h1, h2, n_docs) summed over the given runs, all of them if None."""
        paths = [p for ps in self.levels.values() for p in ps] if paths is None else paths
        if not paths:
            return None
        return self.spark.read.parquet(*paths).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"))

    def frequent(self) -> DataFrame | None:
        got = self.totals()
        return None if got is None else got.filter(F.col("n_docs") >= self.min_docs).select(*HASH)

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, n_docs) counts of new documents."""
        known = self.frequent()
        if known is not None:
            batch = batch.join(known.hint("merge"), HASH, "left_anti")
        self._write(batch, 0)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            paths = self.levels.pop(level)
            self._write(self.totals(paths), level + 1)
            level += 1


TEXT = ["t1", "t2"]


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def frequent_lines(docs: DataFrame, min_docs: int, id_col: str, text_col: str, batches: int,
                   fanout: int) -> DataFrame:
    """(__id, t1, t2, __drop): the places of the frequent lines in each text; no row without one.

    A text is known by its id and hash, so rows repeated under one id are spread by their texts.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "line-runs")
    text = text_or_empty(F.col(text_col))
    pairs = f"{folder}/pairs"
    lines = (
        # the text's hash is taken before its lines are
        docs.select(F.col(id_col).alias("__id"), *text_key(text), F.split(text, "\n", -1).alias("__lines"))
        .select("__id", *TEXT, F.posexplode("__lines").alias("pos", "__line"))
        .select("__id", *TEXT, "pos", line_key(F.col("__line")).alias("__key"))
        .filter(F.col("__key") != "")
        .select("__id", *TEXT, "pos", *hashed(F.col("__key")))
        .withColumn("batch", F.pmod(F.xxhash64("__id"), F.lit(batches)).cast("int"))
    )
    # the lines of a batch lie together in each file, so its readers skip most of the others' row groups
    lines.sortWithinPartitions("batch").write.parquet(pairs)
    runs = LineRuns(spark, folder, min_docs, fanout)
    stored = spark.read.schema(lines.schema).parquet(pairs)
    for b in range(batches):
        # the documents of a line are distinct ids: a pair is counted once
        batch = stored.filter(F.col("batch") == b).select(*HASH, "__id").distinct()
        runs.add(batch.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs")))
    return (
        stored.select("__id", *TEXT, "pos", *HASH).join(runs.frequent(), HASH, "left_semi")
        .groupBy("__id", *TEXT).agg(F.collect_set("pos").alias("__drop"))
    )


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id",
                        text_col: str = "text", batches: int = 4, fanout: int = 3) -> DataFrame:
    """``row`` (the row of ``docs``), ``n_lines``, ``n_dropped`` and ``kept`` (the remaining text)."""
    drops = frequent_lines(docs, min_docs, id_col, text_col, batches, fanout)
    drops = drops.select(F.col("__id").alias("__of"), *(F.col(c).alias(f"__{c}") for c in TEXT), "__drop")
    text = text_or_empty(F.col(f"row.`{text_col}`"))
    src = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    src = src.select("row", text.alias("__text"), F.col(f"row.`{id_col}`").alias("__id"), *text_key(text))
    same = F.col("__id").eqNullSafe(F.col("__of")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2"))
    # a hash join with the short side as its table: texts are dealt out, but not sorted
    joined = src.join(drops.hint("shuffle_hash"), same, "left")
    split = joined.withColumn("__lines", F.split("__text", "\n", -1))
    # places that stay, found by one hash set for all lines of a text
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.transform(stay, lambda p: F.col("__lines")[p])
    cut = F.col("__drop").isNotNull()
    return split.select(
        "row", F.size("__lines").cast("long").alias("n_lines"),
        F.when(cut, F.size("__drop")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
        F.when(cut, F.array_join(kept, "\n")).otherwise(F.col("__text")).alias("kept"))


def deduped_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with ``text`` without its frequent lines, and ``n_chars`` its length."""
    out = drop_frequent_lines(docs, **options)
    made = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType)}
    return out.select(*(made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
