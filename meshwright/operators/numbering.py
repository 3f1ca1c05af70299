"""Contiguous numbers, ownership arithmetic, sorted unique keys, stacked blocks and ragged lists."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reliable(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the session's shared folder; a folder of our own only in local mode."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="meshwright-"))
    return df.checkpoint(eager=True)


def dense_ids(df: DataFrame, *keys: str, name: str = "id") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of the keys, which should be unique.

    Rows are range-partitioned and numbered within partitions; the partitions'
    sizes give the offsets. No task sees more than its own range.
    """
    placed = reliable(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").count()
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    rank = F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    return placed.withColumn("__rank", rank).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + F.col("__rank") - 1).drop("__part", "__rank", "__offset")


def local_range(part: Column, n: int, parts: int) -> tuple[Column, Column]:
    """First and end of a part's share of 0..n-1; the first n mod parts parts have one more."""
    size, more = divmod(n, parts)
    first = part * size + F.least(part, F.lit(more))
    return first, first + size + F.when(part < more, 1).otherwise(0)


def index_owner(index: Column, n: int, parts: int) -> Column:
    """The part whose share holds an index: the inverse of local_range()."""
    size, more = divmod(n, parts)
    long_ones = more * (size + 1)
    return F.when(index < long_ones, F.floor(index / (size + 1))).otherwise(F.lit(more) + F.floor((index - long_ones) / max(size, 1))).cast("int")


def sort_unique(df: DataFrame, index: str, value: str) -> DataFrame:
    """One row per index with its smallest value. Rows have no order; whoever writes them may sort within partitions."""
    return df.groupBy(index).agg(F.min(value).alias(value))


def stacked(frames: list[DataFrame], sizes: list[int], *columns: str) -> DataFrame:
    """Blocks below each other: the n-th block's id columns are shifted by the sizes before it."""
    out, offset = None, 0
    for df, size in zip(frames, sizes, strict=True):
        moved = df.withColumns({c: F.col(c) + F.lit(offset) for c in columns})
        out, offset = moved if out is None else out.unionByName(moved), offset + size
    return out


def to_edges(lists: DataFrame, node: str, links: str) -> DataFrame:
    """(src, pos, dst) of a ragged list."""
    return lists.select(F.col(node).alias("src"), F.posexplode(links).alias("pos", "dst"))


def to_lists(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, links in order) of an edge list."""
    return edges.groupBy(F.col(src).alias("node")).agg(F.array_sort(F.collect_list(dst)).alias("links"))


def degrees(edges: DataFrame, src: str = "src") -> DataFrame:
    """(node, degree): counts of links, which no list is made for."""
    return edges.groupBy(F.col(src).alias("node")).agg(F.count("*").alias("degree"))


def transposed(edges: DataFrame) -> DataFrame:
    """The edges turned round, positions anew by source."""
    at = F.row_number().over(W.partitionBy("dst").orderBy("src", "pos")) - 1
    return edges.select(F.col("dst").alias("src"), at.alias("pos"), F.col("src").alias("dst"))


def mapped(df: DataFrame, column: str, table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Ids through a table of pairs, -1 where it has none."""
    pairs = table.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return df.join(pairs, F.col(column) == F.col("__k"), "left").withColumn(name, F.coalesce("__v", F.lit(-1))).drop("__k", "__v")


def table_reduce(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Average, least and greatest of a value by row and column."""
    return rows.groupBy(*by).agg(F.avg(value).alias("average"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def block_counts(edges: DataFrame, src_part: Column, dst_part: Column) -> DataFrame:
    """The weighted graph of parts: how many edges go from one to another."""
    return edges.select(src_part.alias("src_part"), dst_part.alias("dst_part")).groupBy("src_part", "dst_part").agg(F.count("*").alias("weight"))
