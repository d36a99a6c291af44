"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.llm.shared import drop_table, write_table

MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    """Number of edges and sums of two hashes of them: equal only for equal tables."""
    return tuple(edges.agg(F.count("*"), *[F.sum(F.xxhash64("a", "b", F.lit(k)).cast("decimal(38,0)"))
                                           for k in range(2)]).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the edges (a, b); root is the smallest node of the component.

    In turns, every node hands its smallest neighbour to its larger neighbours and then to all its smaller ones, until
    the edges are stars. Each round is a group-by of edges; only a count and two hash sums reach the driver. A node
    with very many edges is first reduced to its smallest neighbour per task by the partial aggregate.
    """
    spark = edges.sparkSession
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = write_table(now, "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        # large star: neighbours of v that are larger than v go to the smallest of v and its neighbours
        both = now.union(now.select("b", "a")).toDF("v", "u")
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # small star: smaller neighbours of v, and v itself, go to the smallest of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            small_least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        new, new_path = write_table(after, "edges")
        drop_table(spark, path)
        now, path = new, new_path
        seen, before = _digest(now), seen
        if seen == before:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(roots.select("root", "root").distinct())
    raise RuntimeError("components did not settle")
