"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a weight.  All sources together keep the total size (in words); a source's target
is its share by weight, but never more than ``cap`` times its own size, and what exceeds that is
shared again by weight.  (So target = min(cap * size, level * weight) for one common level.)

A document of a source is wanted ``rate`` = target / source size times: ``floor(rate)`` copies for
sure and one more with probability ``frac``.  The fractions are rounded together: of two documents
one passes probability mass to the other, at random in the one way or the other, so that each keeps
its expectation, their expected words together stay the same, and one of the two becomes 0 or 1.
Blocks of some thousand documents of a source are reduced side by side until each has one fraction
left; these residuals form the blocks of the next level, up to one per source, which is drawn alone.
So a source's words miss its target by less than one document's size.

The blocks and the draws come from hashes of the rows' contents, with a running number for rows that are
equal in every column, so reruns agree however the rows are dealt out, and neither an id with a third of
all rows nor a group of equal rows meets in one block.

Defined cases: a null text has size 0; a null source is a source of its own (last in order); sources
of size 0 have target 0; documents of size 0 take no part in the rounding and get the certain copies
only; rows repeated under one id or with a null id are drawn one by one; an empty table gives an empty
result; no column but id, source and text is needed, others only take part in telling rows apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promoscope.llm.common import WORD, ship, text_or_empty
from promoscope.session import scratch_path

ROW = ["c1", "c2", "number"]  # the hash of a row's content, and which of the equal rows it is


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, n, target) from (source, size) rows; a row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1) % len(weights) + 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number))
    per = per.withColumn("ratio", cap * F.col("source_size") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level if all sources with a smaller ratio are full; the true one is the largest of these
    level = (F.sum("source_size").over(everything)
             - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("w").over(rest)
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", "n", F.least(
        cap * F.col("source_size"), F.col("level") * F.col("w")).cast("double").alias("target"))


def round_block(p: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round fractions pairwise until one is left at most; sum(p * weight) and E(p) stay."""
    p = p.copy()
    draw = rng.random(len(p))
    i = -1  # the one that is still a fraction
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if i < 0:
            i = j
            continue
        a, b, wa, wb = p[i], p[j], weight[i], weight[j]
        up = min(1 - a, b * wb / wa)  # i gains this much, j loses up * wa / wb
        down = min(a, (1 - b) * wb / wa)
        if draw[j] * (up + down) < down:
            a, b = a + up, b - up * wa / wb
        else:
            a, b = a - down, b + down * wa / wb
        p[i], p[j] = snap(a), snap(b)
        if not 0 < p[i] < 1:
            i = j if 0 < p[j] < 1 else -1
    return p


def snap(x: float) -> float:
    """Rounding errors next to 0 and 1 go."""
    return 0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else float(x)


def reduce_tree(items: DataFrame, largest: int, seed: int, block: int, folder: str) -> DataFrame:
    """The ``ROW`` of the items that get the extra copy.  ``items``: ROW, source, weight, p, key, n.

    ``n`` is the number of rows of the item's source, ``largest`` the largest n.
    """
    spark = items.sparkSession

    def level_of(number: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key", *ROW], kind="stable")
            rng = np.random.default_rng([seed, number, int(pdf["key"].iloc[0]) & (2**63 - 1)])
            p = round_block(pdf["p"].to_numpy(), pdf["weight"].to_numpy(np.float64), rng)
            if last:
                left = (p > 0) & (p < 1)
                p[left] = rng.random(int(left.sum())) < p[left]
            return pdf.assign(p=p)

        return run

    taken = None
    width = float(block)
    number = 0
    while True:
        last = width >= largest
        groups = F.greatest(F.ceil(F.col("n") / F.lit(width)), F.lit(1))
        dealt = items.withColumn("group", F.lit(0).cast("long") if last else F.pmod("key", groups))
        path = f"{folder}/level-{number}"
        (dealt.groupBy("source", "group").applyInPandas(level_of(number, last), dealt.schema)
         .filter("p > 0").drop("group").write.parquet(path))
        done = spark.read.schema(items.schema).parquet(path)
        here = done.filter("p = 1").select(*ROW)
        taken = here if taken is None else taken.unionByName(here)
        if last:
            return taken
        items, width, number = done.filter("p < 1"), width * block, number + 1


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0,
                seed: int = 0, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text", block: int = 4096) -> DataFrame:
    """Per row: the id, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words)."""
    out, _ = _mix(docs, weights, cap, seed, id_col, source_col, text_col, block, False)
    return out.select(F.col("__id").alias(id_col), "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0,
                    seed: int = 0, id_col: str = "doc_id", source_col: str = "source",
                    text_col: str = "text", block: int = 4096) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    mixed, staged = _mix(docs, weights, cap, seed, id_col, source_col, text_col, block, True)
    # ``rid`` is one of the equal rows, which stands for them all
    copies = mixed.filter("copies > 0").select(
        "rid", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    return staged.select("rid", "carry").join(copies, "rid").select("carry.*")


def content_hash(docs: DataFrame) -> list[Column]:
    """Two hashes of all columns of a row; nulls count by their places."""
    columns = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        columns.append(F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c)
    nulls = F.concat(*(c.isNull().cast("int").cast("string") for c in columns))
    return [F.xxhash64(nulls, *columns).alias("c1"), F.xxhash64(F.lit(1), nulls, *columns).alias("c2")]


def _mix(docs: DataFrame, weights: tuple[float, ...], cap: float, seed: int, id_col: str,
         source_col: str, text_col: str, block: int, carry: bool) -> tuple[DataFrame, DataFrame]:
    """The mix, a row per document, and the staged rows (whole ones if ``carry``)."""
    spark = docs.sparkSession
    ship(spark)
    folder = scratch_path(spark, "mix")
    staged = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), *content_hash(docs), F.monotonically_increasing_id().alias("rid"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carry")] if carry else []),
    )
    staged.write.parquet(f"{folder}/staged")
    stored = spark.read.schema(staged.schema).parquet(f"{folder}/staged")
    targets(stored.select("source", "size"), weights, cap).write.parquet(f"{folder}/targets")
    per = spark.read.parquet(f"{folder}/targets").withColumnRenamed("source", "__source")
    # equal rows are one row with their number, dealt out again one by one
    rows = stored.groupBy("c1", "c2", "__id", "source", "size").agg(
        F.min("rid").alias("rid"), F.count(F.lit(1)).alias("rows"))
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = (
        rows.join(per, rows["source"].eqNullSafe(per["__source"])).drop("__source")
        .withColumn("whole", F.floor(rate + 1e-12)).withColumn("p", rate - F.col("whole"))
    )
    items = rated.filter("p > 1e-12 and size > 0").select(
        *ROW, "source", F.col("size").alias("weight"), "p",
        F.xxhash64(F.lit(seed), *ROW).alias("key"), "n")
    largest = per.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    extra = reduce_tree(items, int(largest), seed, block, folder).withColumn("extra", F.lit(1))
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long")
    return rated.join(extra, ROW, "left").withColumn("copies", copies), stored
