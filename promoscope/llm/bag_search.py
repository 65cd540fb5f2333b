"""Ranked lexical search over bags: documents that look alike to all queries are scored once.

Items (the query set) are taken in blocks of bounded size.  A block's distinct terms are its vocabulary.  One
pass over the documents counts their terms and keeps each one's bag: the term frequencies of the vocabulary's
terms, and the whole number of terms.  Texts are not shuffled.  Document frequencies are summed from the bags.

A document's score depends on its bag and on ``m`` (its length against the mean) alone, so documents are put
into classes of equal (bag, m): dealt out by a hash of both, and told apart within by the whole bag, so equal
hashes of different bags do no harm.  Copies, cut-offs of copies without query terms and all documents with
the same few terms are one class.  Every class is scored once against all items that hold one of its terms;
every task keeps, for each item, the best classes by (score, smallest id) only, as many as documents are
wanted: later classes cannot add a document, since every class has one of its own in front.  The chosen
classes are expanded by ascending id, at most as many members as documents are wanted.

Defined cases: a null or empty text has no term and is not counted; an item without terms has no result;
documents with score 0 are left out; rows repeated under one id are documents of their own, and so are rows
with a null id (last among equal scores); repeated or null item ids are items of their own; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import parts, ship
from promoscope.session import scratch_path

# A-Z in lower case; all other ASCII but digits and letters is a gap; bytes of other characters stay
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(FOLD).split()


def bag_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("id", id_type), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType(), False)),
        T.StructField("tfs", T.ArrayType(T.IntegerType(), False))])


def bags(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) per document: its number of terms, and the vocabulary's terms that it has."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = bag_schema(docs.schema[id_col].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            for part in parts(batch):
                n, sizes, terms, tfs = [], [0], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    words = terms_of(text or b"")
                    count = Counter(map(number, words))
                    count.pop(None, None)
                    n.append(len(words))
                    known = sorted(count)
                    terms += known
                    tfs += [count[t] for t in known]
                    sizes.append(len(terms))
                columns = [part.column(0), pa.array(n, pa.int64())] + [
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, schema)


class Scorer:
    """Scores of bags against a block of items."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        self.weights, self.n_items = weights, len(items)
        pairs = sorted((t, i) for i, terms in enumerate(items) for t in terms)
        self.items = np.array([i for _, i in pairs], np.int64)
        of = np.array([t for t, _ in pairs], np.int64)
        self.first = np.searchsorted(of, np.arange(len(weights)))
        self.many = np.searchsorted(of, np.arange(len(weights)), "right") - self.first

    def score(self, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """A row per bag, a column per item.  All whole numbers; sums stay below 2^53."""
        bag = np.repeat(np.arange(len(m)), sizes)
        worth = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[bag]))
        n = self.many[terms]
        at = np.repeat(self.first[terms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat(bag, n) * self.n_items + self.items[at]
        out = np.bincount(cell, np.repeat(worth, n).astype(np.float64), len(m) * self.n_items)
        return out.reshape(len(m), self.n_items)


def best_classes(classes: DataFrame, numbers: list[int], items: list[list[int]], weights: np.ndarray,
                 top: int) -> DataFrame:
    """(item, score, and the class's columns): the best ``top`` classes of every item and task.

    ``numbers`` and ``items``: the items' numbers and terms.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.LongType()),
                           *classes.schema.fields])
    arrow = to_arrow_schema(schema)
    at = {name: i for i, name in enumerate(classes.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(items, weights)
        best: list[list[tuple]] = [[] for _ in items]  # (-score, no id, id, the row), in order
        floor = np.full(len(items), 1.0)
        step = max(64, (4 << 20) // max(1, len(items)))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                rows = batch.slice(begin, step)
                terms, tfs = (rows.column(at[c]) for c in ("terms", "tfs"))
                sizes = np.diff(terms.offsets.to_numpy())
                scores = scorer.score(rows.column(at["m"]).to_numpy(), sizes,
                                      *(x.flatten().to_numpy().astype(np.int64) for x in (terms, tfs)))
                hits, cols = np.nonzero(scores >= floor)
                if not len(hits):
                    continue
                kept = {r: rows.slice(r, 1).to_pylist()[0] for r in np.unique(hits).tolist()}
                by_item = np.argsort(cols, kind="stable")
                cuts = np.flatnonzero(np.diff(cols[by_item])) + 1
                for group in np.split(by_item, cuts):
                    i = int(cols[group[0]])
                    for r in hits[group].tolist():
                        row = kept[r]
                        best[i].append((-int(scores[r, i]), row["first"] is None, row["first"] or 0, row))
                    best[i].sort(key=lambda x: x[:3])
                    del best[i][top:]
                    if len(best[i]) == top:
                        floor[i] = -best[i][-1][0]
        out = [{"item": i, "score": -b[0], **b[3]} for i, found in zip(numbers, best) for b in found]
        for begin in range(0, len(out), 2000):
            yield pa.RecordBatch.from_pylist(out[begin:begin + 2000], schema=arrow)

    return classes.mapInArrow(run, schema)


CLASS = ["h", "m", "terms", "tfs"]


def class_hash() -> Column:
    return F.xxhash64("m", "terms", "tfs")


def search_block(docs: DataFrame, texts: list[tuple], top: int, id_col: str, text_col: str, folder: str) -> DataFrame:
    """(item, rank, id, score) for the items (number, text) of a block; item is the number."""
    spark = docs.sparkSession
    item_terms = [sorted(set(terms_of((t or "").encode()))) for _, t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*item_terms)))}
    items = [[vocabulary[t] for t in ts] for ts in item_terms]
    found = bags(docs, vocabulary, id_col, text_col)
    found.write.parquet(f"{folder}/bags")
    stored = spark.read.schema(found.schema).parquet(f"{folder}/bags")
    n_docs, n_terms = stored.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    # as many rows as the vocabulary has terms
    for t, n in stored.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    m = F.expr(f"50L + (50L * n * {n_docs}L) div {max(n_terms, 1)}L")
    keyed = (stored.filter(F.size("terms") > 0).withColumn("m", m)
             .withColumn("h", class_hash()).select("id", *CLASS))
    classes = keyed.groupBy(*CLASS).agg(F.min("id").alias("first"))
    best = best_classes(classes, [number for number, _ in texts], items, weights, top)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("first").asc_nulls_last())
    chosen = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    chosen.drop("place").write.parquet(f"{folder}/classes")
    chosen = spark.read.parquet(f"{folder}/classes")
    by_id = Window.partitionBy(*CLASS).orderBy(F.col("id").asc_nulls_last())
    members = (keyed.join(chosen.select(*CLASS).distinct(), CLASS, "left_semi")
               .withColumn("member", F.row_number().over(by_id)).filter(F.col("member") <= top))
    final = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return (chosen.join(members, CLASS).select("item", "id", "score")
            .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= top))


def item_blocks(items: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The items with their block: consecutive ones of ``block_bytes`` together (a longer one alone)."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 64
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    cut = items.select("number", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / block_bytes).alias("block"))
    return cut, (cut.agg(F.max("block")).first()[0] or 0) + 1


def search(items: DataFrame, docs: DataFrame, top: int = 50, item_col: str = "item_id", id_col: str = "doc_id",
           text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item.  One pass over the documents for
    ``block_bytes`` of items."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    folder = scratch_path(spark, "bag-search")
    items.select(F.monotonically_increasing_id().alias("number"), F.col(item_col).alias("item_id"),
                 F.col(text_col).cast("string").alias("text")).write.parquet(f"{folder}/items")
    stored = spark.read.parquet(f"{folder}/items")
    cut, blocks = item_blocks(stored, block_bytes)
    cut.write.parquet(f"{folder}/blocks")
    numbered = stored.join(spark.read.parquet(f"{folder}/blocks"), "number")
    out = []
    for block in range(blocks):
        texts = sorted((r.number, r.text) for r in numbered.filter(F.col("block") == block).select("number", "text").collect())
        out.append(search_block(docs, texts, top, id_col, text_col, f"{folder}/{block}"))
    found = reduce(DataFrame.unionByName, out).withColumnRenamed("item", "number")
    return found.join(stored.select("number", F.col("item_id").alias("__item")), "number").select(
        F.col("__item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
