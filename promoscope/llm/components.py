"""Connected components of a distributed graph: large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.session import scratch_path


#: Rows that one task of these steps handles at least; small graphs need few tasks, not a cluster's worth.
ROWS_PER_TASK = 100_000


def tasks(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_TASK))


def _neighbours_to_min(edges: DataFrame, n: int) -> DataFrame:
    """(u, v, m) for both directions of every edge, m the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).coalesce(n)
    return edges.join(least, "u").coalesce(n).select("u", "v", F.least("u", "least").alias("m"))


def large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    got = _neighbours_to_min(both, n).filter("v > u")
    return got.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct().coalesce(n)


def small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    got = _neighbours_to_min(down, n)
    out = got.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        got.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct().coalesce(n)


def all_stars(edges: DataFrame, n: int) -> bool:
    """Whether every edge leads to a root: no node has two edges up, or edges both up and down."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).coalesce(n)
    return per.filter("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long) but the roots: the smallest node it is linked with.

    Every step is written to the shared folder, which cuts the lineage.
    """
    folder = scratch_path(spark, "components")
    step = 0
    path = f"{folder}/step-{step}"
    links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").write.parquet(path)
    edges = spark.read.parquet(path)
    while True:
        n = tasks(edges.count())
        if all_stars(edges, n):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        step += 1
        path = f"{folder}/step-{step}"
        small_star(large_star(edges, n), n).write.parquet(path)
        edges = spark.read.parquet(path)
