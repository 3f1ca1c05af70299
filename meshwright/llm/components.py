"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.storage import cut

#: Edges that one task reads at least, so that small graphs don't pay for a cluster's number of partitions.
EDGES_A_TASK = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that isn't its own root; root is the smallest node reachable.

    Loops, repeated edges and both directions are allowed; edges with a null
    end are ignored. No neighbourhood is gathered: each round takes minima per
    node, which Spark combines before its shuffle, and joins them back to the
    edges. Both sides of these joins are checkpointed, so that each has a shuffle
    of its own, and adaptive execution can split a node with very many edges.
    """
    spark = edges.sparkSession
    edges = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before, now = None, _state(edges)
    while now != before:
        tasks = max(spark.sparkContext.defaultParallelism, now[0] // EDGES_A_TASK)
        both = edges.union(edges.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = cut(large.coalesce(tasks))
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(down.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
