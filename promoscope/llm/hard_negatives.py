"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

A vector's components become integers (``floor(scale * x)``), so scores are exact inner products.  For
every anchor, its positives are the rows of its own label with the highest scores, and its negatives for
a positive are the highest-scoring rows of other labels within a window of the positive's score.

All rows are dealt into slabs of some thousand by a hash of their number, the anchors (the stated query
set) into groups, and every (slab, group) meets in one task of bounded size: each row crosses the network
once per group of anchors, each anchor once per slab.  Within a slab every dimension has its rows sorted by
their component.  For an anchor, all lists are read in step, from the top where its component is positive
and from the bottom where it is negative; every row met for the first time is scored by random access.  The
threshold, the inner product of the anchor with the components last read, bounds all rows not met yet, so
the search stops once it falls strictly below the k-th score of every window (equal scores may still
belong in front, by their ids) or, in windows with fewer rows, below the window's lower end.  The slabs'
results are merged per anchor and window.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part, nor
do those with a component beyond ``LARGEST`` after scaling (64-bit scores could overflow); shorter vectors
count as ended by zeros; rows repeated under one id are rows of their own, and an anchor's other rows are
all but that row itself; rows with a null id are no anchors and come last among equal scores; an empty
table gives an empty result; other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import ship
from promoscope.session import scratch_path

LARGEST = 1 << 24
EXACT = float(1 << 53)


def usable(vector: Column, label: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


class Slab:
    """Rows with a sorted list of row numbers for every dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.rows, self.labels = ids, rows, labels
        self.values = values.astype(np.float64)  # exact: see score()
        self.n, self.dims = values.shape
        kind = np.uint16 if self.n <= 1 << 16 else np.int32
        self.lists = np.argsort(values.T, axis=1, kind="stable").astype(kind)  # ascending, by dimension
        self.sorted = np.take_along_axis(np.ascontiguousarray(values.T), self.lists.astype(np.int64), axis=1)
        self.largest = np.abs(values).max(axis=0) if self.n else np.zeros(self.dims)

    def score(self, which: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products: in doubles where their sums stay below 2^53, else in 64-bit integers."""
        if float(self.largest @ np.abs(anchor)) < EXACT:
            return (self.values[which] @ anchor.astype(np.float64)).astype(np.int64)
        return self.values[which].astype(np.int64) @ anchor

    def search(self, anchor: np.ndarray, wanted: np.ndarray, windows: list[tuple[int, int]], k: int,
               step: int = 32) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the first k wanted rows with such scores: (row numbers, scores)."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        live = [i for i, (low, high) in enumerate(windows) if low <= high]
        used = np.flatnonzero(anchor)
        a = anchor[used].astype(np.int64)
        down = a > 0
        lists, heights = self.lists[used], self.sorted[used]
        met = ~wanted  # rows that take no part need no score
        depth = 0
        if not len(used) and live:  # all scores are 0, and no list is of use
            self._take(np.flatnonzero(wanted), np.zeros(int(wanted.sum()), np.int64), windows, live, k, found)
            return found
        while live and depth < self.n:
            to = min(self.n, depth + step)
            here = np.zeros(self.n, bool)
            here[lists[down, self.n - to:self.n - depth]] = True
            here[lists[~down, depth:to]] = True
            here &= ~met
            met |= here
            fresh = np.flatnonzero(here)
            if len(fresh):
                self._take(fresh, self.score(fresh, anchor), windows, live, k, found)
            last = np.where(down, heights[:, self.n - to], heights[:, to - 1])
            threshold = int(a @ last)
            live = [i for i in live if threshold >= (
                found[i][1][-1] if len(found[i][1]) == k else windows[i][0])]
            depth, step = to, step * 2
        return found

    def _take(self, fresh, scores, windows, live, k, found) -> None:
        for i in live:
            low, high = windows[i]
            rows, best = found[i]
            floor = best[-1] if len(best) == k else low
            fit = (scores >= max(floor, low)) & (scores <= high)
            if not fit.any():
                continue
            rows = np.concatenate([rows, fresh[fit]])
            best = np.concatenate([best, scores[fit]])
            order = np.lexsort((self.ids[rows], -best))[:k]
            found[i] = (rows[order], best[order])


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of ``dims`` components, shorter ones ended by zeros."""
    if not dims:
        return np.zeros((len(column), 0), np.int64)
    lists = pa.concat_arrays(column.chunks)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy()
    sizes = np.diff(offsets)
    if (sizes == dims).all():
        return flat.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


FOUND = T.StructType([
    T.StructField("anchor", T.LongType()), T.StructField("place", T.IntegerType()),
    T.StructField("id", T.LongType()), T.StructField("score", T.LongType()),
])
NO_ID = np.iinfo(np.int64).max  # null ids come last


def searched(vectors: DataFrame, anchors: DataFrame, slabs: int, groups: int, dims: int, same: bool,
             k: int) -> DataFrame:
    """Candidates (anchor, place of the window, id, score) of every slab: at most k for each window.

    ``anchors``: anchor, anchor_label, anchor_v, group, and unless ``same`` (one window without ends, rows of the anchor's own
    label) the arrays low and high.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(FOUND)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids = np.array([NO_ID if x is None else x for x in left["id"].to_pylist()], np.int64)
            slab = Slab(ids, left["row"].to_numpy(), left["label"].to_numpy(), matrix(left["v"], dims))
            vectors_ = matrix(right["anchor_v"], dims)
            for i, (row, label) in enumerate(zip(right["anchor"].to_pylist(), right["anchor_label"].to_pylist())):
                own = slab.labels == label
                if same:
                    windows = [(np.iinfo(np.int64).min, np.iinfo(np.int64).max)]
                    wanted = own & (slab.rows != row)
                else:
                    windows = list(zip(right["low"][i].as_py(), right["high"][i].as_py()))
                    wanted = ~own
                for place, (rows, scores) in enumerate(slab.search(vectors_[i], wanted, windows, k)):
                    out[0] += [row] * len(rows)
                    out[1] += [place] * len(rows)
                    out[2] += [None if x == NO_ID else x for x in slab.ids[rows].tolist()]
                    out[3] += scores.tolist()
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.withColumn("group", each(groups))
    queries = anchors.withColumn("slab", each(slabs))
    return rows.groupBy("slab", "group").cogroup(queries.groupBy("slab", "group")).applyInArrow(run, FOUND)


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The first k of every (anchor, place), with their ``rank``."""
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, slab_rows: int = 8192, group_rows: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score is between ``low`` and ``high`` percent of its positive's score.  ``is_anchor`` is a
    condition on the columns of ``rows``.
    """
    spark = rows.sparkSession
    ship(spark)
    folder = scratch_path(spark, "hard-negatives")
    label, vector = F.col(label_col), F.col(vector_col)
    staged = (
        rows.filter(usable(vector, label))
        .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                label.cast("long").alias("label"), scaled(vector, scale).alias("v"),
                F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
        .filter(~F.exists("v", lambda x: F.abs(x) > LARGEST))
        .withColumn("v", F.col("v").cast("array<int>")))
    staged.write.parquet(f"{folder}/rows")
    stored = spark.read.schema(staged.schema).parquet(f"{folder}/rows")
    n, n_anchors, dims = stored.agg(
        F.count(F.lit(1)), F.count_if("is_anchor"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    slabs, groups = max(1, -(-n // slab_rows)), max(1, -(-n_anchors // group_rows))
    vectors = stored.drop("is_anchor").withColumn("slab", F.pmod(F.xxhash64("row"), F.lit(slabs)).cast("int"))
    anchors = stored.filter("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    queries = stored.filter("is_anchor").select(
        F.col("row").alias("anchor"), F.col("label").alias("anchor_label"), F.col("v").alias("anchor_v"),
        F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(groups)).cast("int").alias("group"))

    best = first_k(searched(vectors, queries, slabs, groups, dims, True, positives), positives)
    best.select("anchor", "rank", "id", "score").write.parquet(f"{folder}/positives")
    best = spark.read.parquet(f"{folder}/positives")
    # 100 * score is between low * s and high * s: whole numbers from ceil(low * s / 100) to floor(high * s / 100)
    per_anchor = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    windows = per_anchor.select(
        "anchor",
        F.expr(f"transform(p, x -> -((-{low} * x.score - pmod(-{low} * x.score, 100L)) div 100L))").alias("low"),
        F.expr(f"transform(p, x -> ({high} * x.score - pmod({high} * x.score, 100L)) div 100L)").alias("high"))
    asked = queries.join(windows, "anchor")
    found = first_k(searched(vectors, asked, slabs, groups, dims, False, negatives), negatives)
    pairs = best.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"),
                        F.col("score").alias("positive_score")).join(anchors, "anchor")
    return found.join(pairs, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
