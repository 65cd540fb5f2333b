"""Near duplicates by ProbMinHash over weighted word shingles, banding and verification.

A text's shingles are its windows of ``width`` words (a shorter text with words is one shingle), each
weighted by how often it occurs.  A shingle sends out the points of a Poisson process whose rate is
its weight; every point falls into one of ``bands * rows`` slots and a slot keeps the shingle whose
point comes first.  A text stops when all its slots are filled and the next points of all shingles lie
behind the last slot's, so long texts take little more than one point per shingle.  Two texts agree in
a slot with probability equal to the probability Jaccard similarity of their weighted shingles.

Links are decided by the Jaccard similarity of the plain sets, which repeated passages do not change,
but weights do.  So every text is also banded with all weights 1, where slots agree with just that
probability; a text without a repeated shingle has the same bands both ways and is banded once.

Texts that agree in all slots of a band share a bucket.  Equal texts are one node from the start.
Before anything is compared, texts that cannot have a partner leave their buckets, by exact bounds: two
sets of n and m shingles with similarity t have t / (1 + t) * (n + m) shingles in common or more, all of
which are shared ones (found in two candidates or more).  A family of texts that are all a bit alike,
with many edits of their own, shrinks to its core by that.

Buckets are not expanded into pairs.  First every bucket's pivot (the member with the largest part of
shared shingles) is compared with its other members, exactly, by the Jaccard similarity of the sets of
shingles; links join classes.  Then, in each round, a few leaders of every bucket that still has several
classes (1, then 2, 4, ...; members of the smallest classes first) are compared with the members after
them that are in another class.  What a pair can have in common is bounded by what each has in common
with the pivot and by its other shared shingles; pairs whose bound is too small are not compared.  A
bucket closes when all its members are in one class or all have been leaders, so no pair of a bucket
that could still join two classes is left out.

Defined cases: a null text is empty; texts without a word are alike only if equal; the class id is the
smallest id of the class (null if all are null); repeated rows are in one class; an empty table gives
an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import parts, ship, text_or_empty
from promoscope.llm.components import components, tasks
from promoscope.session import scratch_path

U64 = np.uint64
GOLD, BASE, STEP = U64(0x9E3779B97F4A7C15), U64(0x5851F42D4C957F2D), U64(0xD1342543DE82EF95)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
HASH_BITS = 48  # of a shingle; the number of a text in its batch takes the other 16
LOW = U64((1 << HASH_BITS) - 1)
PART_BYTES = 1 << 20  # text worked on at once; the arrays take some 60 times as much
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64) * GOLD)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, and where each text starts (and the last one ends)."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, BASE_INVERSE)
    up[:1] = down[:1] = U64(1)
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word."""
    space = IS_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    before = np.append(True, space[:-1]) if len(raw) else space
    starts = np.flatnonzero(~space & (before | first[:-1]))
    after = np.append(space[1:], True) if len(raw) else space
    ends = np.flatnonzero(~space & (after | first[1:])) + 1
    up, down = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE[raw] * up[:-1], dtype=U64)])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
    return hashes, np.searchsorted(at, starts, side="right") - 1


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 48-bit hash and weight of every distinct shingle of up to 2^16 texts, in order."""
    words, doc = word_hashes(*buffers(column))
    count = np.bincount(doc, minlength=len(column))
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    n = len(words)
    found, owner = [], []
    if n >= width:
        h = words[:n - width + 1].copy()
        for k in range(1, width):
            h = h * STEP + words[k:n - width + 1 + k]
        whole = doc[:n - width + 1] == doc[width - 1:]
        found.append(h[whole])
        owner.append(doc[:n - width + 1][whole])
    for d in np.flatnonzero((count > 0) & (count < width)):
        h = count[d:d + 1].astype(U64)
        for k in range(begin[d], begin[d] + count[d]):
            h = h * STEP + words[k:k + 1]
        found.append(h)
        owner.append(np.asarray([d]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    h = mix(np.concatenate(found)) & LOW
    key, weight = np.unique(np.concatenate(owner).astype(U64) << U64(HASH_BITS) | h, return_counts=True)
    return (key >> U64(HASH_BITS)).astype(np.int64), key & LOW, weight


def signatures(n: int, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """The first shingle in each of the m slots of n texts (0 in all slots of a text without one)."""
    first = np.full(n * m, np.inf)
    who = np.zeros(n * m, U64)
    time, rate, seen = np.zeros(len(h)), weight.astype(np.float64), 0
    while len(h):
        # points per shingle in this step: more of them when few shingles are left
        k = max(1, min(64, 20_000 // len(h)))
        number = np.arange(seen + 1, seen + k + 1, dtype=U64)
        seed = h[:, None] + (U64(2) * number)[None, :] * GOLD
        gap = -np.log1p(-(mix(seed) >> U64(11)).astype(np.float64) * 2.0**-53) / rate[:, None]
        gap[:, 0] += time
        points = np.cumsum(gap, axis=1)
        slot = (mix(seed + GOLD) % U64(m)).astype(np.int64) + doc[:, None] * m
        flat, at = slot.ravel(), points.ravel()
        np.minimum.at(first, flat, at)
        won = at == first[flat]
        who[flat[won]] = np.repeat(h, k)[won]
        last = first.reshape(n, m).max(axis=1)
        time, seen = points[:, -1], seen + k
        live = time < last[doc]
        doc, h, rate, time = doc[live], h[live], rate[live], time[live]
    return who.reshape(n, m)


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    n, m = signature.shape
    by = signature.reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(1, m // rows + 1, dtype=U64) * GOLD, by.shape[:2])
    for k in range(rows):
        out = mix(out ^ by[:, :, k]) * STEP
    return out.view(np.int64)


def both_bands(n: int, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, bands: int,
               rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of n texts, by sets and then by weights, and which of them count (each once a text)."""
    hashes = np.zeros((n, 2 * bands), np.int64)
    own = np.zeros(hashes.shape, bool)
    own[np.unique(doc), :bands] = True
    hashes[:, :bands] = band_hashes(signatures(n, doc, h, np.ones(len(h)), bands * rows), rows)
    again = np.unique(doc[weight > 1])  # the others' weights are all 1
    inside = np.isin(doc, again)
    signed = signatures(len(again), np.searchsorted(again, doc[inside]), h[inside], weight[inside], bands * rows)
    hashes[again, bands:] = band_hashes(signed, rows)
    own[again, bands:] = hashes[again, bands:] != hashes[again, :bands]
    return hashes, own


def list_column(values: np.ndarray, lengths: np.ndarray, empty_is_null: bool = False) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    mask = pa.array(lengths == 0) if empty_is_null else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def with_bands(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``docs`` (its last column a text) with ``bands`` (null without words) in the text's place."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = docs.schema.fields[:-1]
    schema = T.StructType([*fields, T.StructField("bands", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, PART_BYTES):
                doc, h, weight = shingles(part.column(len(fields)), width)
                hashes, own = both_bands(part.num_rows, doc, h, weight, bands, rows)
                lists = list_column(hashes[own], own.sum(axis=1), empty_is_null=True)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(fields))), lists.cast(arrow.field("bands").type)],
                    schema=arrow)

    return docs.mapInArrow(run, schema)


def with_shingles(docs: DataFrame, width: int) -> DataFrame:
    """(node, text) to (node, set): the hashes of the distinct shingles."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("node", T.LongType()),
                           T.StructField("set", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, PART_BYTES):
                doc, h, _ = shingles(part.column(1), width)
                lists = list_column(h.astype(np.int64), np.bincount(doc, minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists.cast(arrow.field("set").type)], schema=arrow)

    return docs.mapInArrow(run, schema)


class Stored:
    """Tables written to one new folder of the shared file system, each read again."""

    def __init__(self, spark, name: str):
        self.spark, self.folder = spark, scratch_path(spark, name)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    threshold: float = 0.8, bands: int = 16, rows: int = 4) -> DataFrame:
    """One row per row of ``docs``: the id, its ``class_id``, and the two hashes of its text."""
    return classified(docs, id_col, text_col, width, threshold, bands, rows).drop("class")


def classified(docs: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8,
               bands: int = 16, rows: int = 4) -> DataFrame:
    """``near_duplicates`` with the number ``class`` of the class, as several classes may have one id."""
    spark = docs.sparkSession
    store = Stored(spark, "near-duplicates")
    text = text_or_empty(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("x1"),
                        F.xxhash64(F.lit(1), text).alias("x2"), text.alias("text"))
    signed = store(with_bands(keyed, width, bands, rows), "signed")
    nodes = store(
        signed.groupBy("x1", "x2").agg(F.min("id").alias("first"), F.any_value("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = store(member.join(shared, "bucket", "left_semi"), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("x1").alias("y1"), F.col("x2").alias("y2"), "first")
    texts = keyed.join(wanted, (F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2"))
                       & F.col("id").eqNullSafe(F.col("first"))).select("node", "text")
    sets = store(with_shingles(texts, width).dropDuplicates(["node"]), "sets")
    labels = link_rounds(spark, possible(members, sets, threshold, store), sets, threshold, store)
    classed = nodes.join(labels, "node", "left").select(
        "x1", "x2", "first", F.coalesce("class", "node").alias("class"))
    ids = classed.groupBy("class").agg(F.min("first").alias("class_id"))
    per_text = classed.join(ids, "class").select("x1", "x2", "class_id", "class")
    return signed.select("id", "x1", "x2").join(per_text, ["x1", "x2"]).select(
        F.col("id").alias(id_col), "class_id", "x1", "x2", "class")


def possible(members: DataFrame, sets: DataFrame, threshold: float, store: Stored) -> DataFrame:
    """(bucket, node, n, shared) of the members that can have a partner in their bucket.

    ``n``: the node's shingles; ``shared``: those that another candidate has, too.
    """
    one = (sets.select("node", F.explode("set").alias("h"))
           .groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node"))
           .filter("df = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own")))
    n = F.col("n")
    sized = store(sets.select("node", F.size("set").cast("long").alias("n")).join(one, "node", "left")
                  .select("node", "n", (n - F.coalesce("own", F.lit(0))).alias("shared"))
                  .filter(F.col("shared") / n >= threshold), "sized")
    both = members.join(sized, "node")
    # the smallest partner that the size alone allows
    least = both.groupBy("bucket").agg(F.min("n").alias("least"))
    smallest = F.greatest(F.col("least"), threshold * n)
    # rounding must not drop a pair that is just similar enough
    need = threshold / (1 + threshold) * (n + smallest) - 1e-6
    return both.join(least, "bucket").filter(F.col("shared") >= need).select("bucket", "node", "n", "shared")


class Links:
    """The classes of nodes, joined by the links that are found among pairs of them."""

    def __init__(self, spark, nodes: DataFrame, sets: DataFrame, threshold: float, store: Stored, few: int):
        self.spark, self.sets, self.threshold, self.store, self.few = spark, sets, threshold, store, few
        self.number = 0
        self.classes = store(nodes.withColumn("class", F.col("node")), "classes-0")

    def enough(self, n: str, m: str) -> Column:
        """Common shingles that sets of n and m need; rounding must not drop a pair that just has them."""
        return self.threshold / (1 + self.threshold) * (F.col(n) + F.col(m)) - 1e-6

    def judge(self, pairs: DataFrame) -> DataFrame:
        """(u, v, both, link) of the pairs (u, v): common shingles, and whether they are similar enough."""
        a = self.sets.select(F.col("node").alias("u"), F.col("set").alias("set_u"))
        b = self.sets.select(F.col("node").alias("v"), F.col("set").alias("set_v"))
        either = F.size("set_u") + F.size("set_v") - F.col("both")
        self.number += 1
        return self.store(
            pairs.join(a, "u").join(b, "v").withColumn("both", F.size(F.array_intersect("set_u", "set_v")))
            .select("u", "v", "both", (F.col("both") / either >= self.threshold).alias("link"))
            .coalesce(8 * self.few), f"judged-{self.number}")

    def join(self, judged: DataFrame) -> None:
        if not judged.filter("link").limit(1).count():
            return
        few, of = self.few, self.classes.withColumnRenamed("class", "c")
        links = (judged.filter("link")
                 .join(of.withColumnRenamed("node", "u").withColumnRenamed("c", "cu"), "u").coalesce(few)
                 .join(of.withColumnRenamed("node", "v").withColumnRenamed("c", "cv"), "v").coalesce(few)
                 .select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct().coalesce(few))
        roots = components(self.spark, links).withColumnRenamed("node", "class")
        self.classes = self.store(self.classes.join(roots, "class", "left").coalesce(few).select(
            "node", F.coalesce("root", "class").alias("class")), f"classes-{self.number}")


def link_rounds(spark, members: DataFrame, sets: DataFrame, threshold: float, store: Stored) -> DataFrame:
    """(node, class) of the nodes in ``members``, joined by all links of their buckets."""
    central = Window.partitionBy("bucket").orderBy(F.desc(F.col("shared") / F.col("n")), "node")
    placed = store(members.withColumn("place", F.row_number().over(central)), "placed")
    few = tasks(placed.count())
    links = Links(spark, placed.select("node").distinct().coalesce(few), sets, threshold, store, few)

    pivots = placed.filter("place = 1").select(
        "bucket", F.col("node").alias("pivot"), F.col("n").alias("n_pivot"), F.col("shared").alias("shared_pivot"))
    others = placed.filter("place > 1").drop("place").join(pivots, "bucket").coalesce(few)
    found = links.judge(others.filter(F.least("shared", "shared_pivot", "n", "n_pivot") >= links.enough("n", "n_pivot"))
                        .select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct().coalesce(few))
    links.join(found)

    # what a member has in common with its bucket's pivot, and what else others may have in common with it
    common = found.select(F.col("u").alias("pivot"), F.col("v").alias("node"), F.col("both").cast("long").alias("with_pivot"))
    known = others.join(common, ["pivot", "node"], "left").coalesce(few).select(
        "bucket", "node", "n", "shared", F.coalesce("with_pivot", F.least("shared", "shared_pivot")).alias("with_pivot"),
        F.when(F.col("with_pivot").isNull(), F.col("shared")).otherwise(F.col("shared") - F.col("with_pivot")).alias("beside"))
    rare = Window.partitionBy("bucket").orderBy("size", "class", "node")
    left = store(open_buckets(known.join(links.classes, "node").coalesce(few), few)
                 .withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("bucket", "class"))).coalesce(few)
                 .withColumn("place", F.row_number().over(rare)).drop("size", "class").coalesce(few), "left")
    apart, start, leaders = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), 0, 1
    while True:
        now = left.filter(F.col("place") > start).join(links.classes, "node").coalesce(few)
        rest = store(open_buckets(now, few), f"rest-{links.number}")
        if not rest.limit(1).count():
            return links.classes
        lead = rest.filter(F.col("place") <= start + leaders).select(
            "bucket", *(F.col(c).alias(f"{c}_u") for c in rest.columns if c != "bucket"))
        both = F.least("with_pivot", "with_pivot_u") + F.least("beside", "beside_u")
        pairs = (rest.join(lead, "bucket")
                 .filter((F.col("place") > F.col("place_u")) & (F.col("class") != F.col("class_u"))
                         & (F.least("shared", "shared_u", "n", "n_u", both) >= links.enough("n", "n_u")))
                 .select(F.least("node_u", "node").alias("u"), F.greatest("node_u", "node").alias("v"))
                 .distinct().coalesce(few))
        judged = links.judge(pairs.join(apart, ["u", "v"], "left_anti").coalesce(few))
        links.join(judged)
        apart = apart.unionByName(judged.filter("not link").select("u", "v"))
        start, leaders = start + leaders, leaders * 2


def open_buckets(now: DataFrame, few: int) -> DataFrame:
    """The rows (bucket, class, ...) of buckets with more than one class."""
    several = (now.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("b")).coalesce(few)
               .filter(F.col("a") < F.col("b")).select("bucket"))
    return now.join(several, "bucket", "left_semi").coalesce(few)


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class: it has the class's id and, of the texts with that id, the smallest hash."""
    found = classified(docs, id_col, text_col, **options)
    keep = found.filter(F.col(id_col).eqNullSafe(F.col("class_id"))).groupBy("class").agg(
        F.min(F.struct("x1", "x2")).alias("x"), F.any_value("class_id").alias("id")).select(
        "id", F.col("x.x1").alias("y1"), F.col("x.x2").alias("y2"))
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.xxhash64(text).alias("x1"), F.xxhash64(F.lit(1), text).alias("x2"))
    kept = rows.join(keep, (F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2"))
                     & F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")))
    one = Window.partitionBy("x1", "x2").orderBy("x1", "x2")
    return kept.withColumn("n", F.row_number().over(one)).filter("n = 1").select("row.*")
