"""Parts, owners and ghosts as columns, orderings of graphs, and what goes between parts.

A part is a number beside an id; nothing is moved by hand. What processes
exchange elsewhere are joins here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwright.operators import topology
from meshwright.operators.numbering import dense_ids, reliable
from meshwright.sources.generate import Mesh

#: Bits of each coordinate in the key that orders points along a curve.
CURVE_BITS = 16


def curve_key(axes: list[Column]) -> Column:
    """The place of a point (coordinates from 0 to 1) on a curve that visits near points after each other: its bits, taken in turn."""
    n = len(axes)
    whole = [F.least(F.floor(a * (1 << CURVE_BITS)), F.lit((1 << CURVE_BITS) - 1)).cast("bigint") for a in axes]
    out = F.lit(0).cast("bigint")
    for bit in range(CURVE_BITS):
        for k, a in enumerate(whole):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(a, bit).bitwiseAND(1), n * bit + k))
    return out


def partition_cells(mesh: Mesh, parts: int, by: Column | None = None) -> DataFrame:
    """(cell, part): runs of equal length along a curve through the cells' middles, or along an order of one's own (`by`, a column in x, y, z)."""
    middles = mesh.cells.select("cell", F.explode("vertices").alias("node")).join(mesh.nodes, "node").groupBy("cell").agg(*(F.avg(c).alias(c) for c in "xyz"))
    if by is None:
        span = middles.agg(*(f(c).alias(f"{k}{c}") for c in "xyz" for k, f in (("a", F.min), ("b", F.max))))  # one row
        middles = middles.join(F.broadcast(span))
        by = curve_key([(F.col(c) - F.col(f"a{c}")) / F.greatest(F.col(f"b{c}") - F.col(f"a{c}"), F.lit(1e-300)) for c in "xyz"[: mesh.gdim]])
    placed = dense_ids(middles.select("cell", by.alias("__by")), "__by", "cell", name="__at")
    size = mesh.cells.count()
    return placed.select("cell", F.floor(F.col("__at") * parts / max(size, 1)).cast("int").alias("part"))


def partition_graph(edges: DataFrame, parts: int) -> DataFrame:
    """(node, part) of a graph (src, dst): runs of equal length in the order of a breadth-first search."""
    order = reverse_cuthill_mckee(edges)
    size = order.count()
    return order.select("node", F.floor(F.col("position") * parts / max(size, 1)).cast("int").alias("part"))


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(src_part, dst_part, weight): edges between parts; what comm_graph gives."""
    a, b = (parts.select(F.col("node").alias(k), F.col("part").alias(f"{k}_part")) for k in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").groupBy("src_part", "dst_part").agg(F.count("*").alias("weight"))


def graph_json(weights: DataFrame) -> DataFrame:
    """(src_part, json): each part's links as JSON."""
    links = F.sort_array(F.collect_list(F.struct(F.col("dst_part").alias("target"), "weight")))  # parts are few
    return weights.groupBy("src_part").agg(F.to_json(F.struct(links.alias("links"))).alias("json"))


def destinations(graph: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, part, ghost): each node in its own part, and as a ghost in those of its neighbours in a graph (src, dst)."""
    own = parts.select("node", "part", F.lit(False).alias("ghost"))
    to = parts.select(F.col("node").alias("dst"), F.col("part").alias("there"))
    beside = graph.join(to, "dst").select(F.col("src").alias("node"), F.col("there").alias("part")).distinct()
    return own.unionByName(beside.join(parts.select("node", "part"), ["node", "part"], "left_anti").withColumn("ghost", F.lit(True)))


def distribute(rows: DataFrame, node: str, where: DataFrame) -> DataFrame:
    """Rows, once for each part that their node goes to (node, part, ghost), laid out by part."""
    return rows.join(where.withColumnRenamed("node", node), node).repartition("part")


def numbered_by_part(parts: DataFrame) -> DataFrame:
    """(node, part, id): numbers that run through part 0, then part 1, and so on."""
    return dense_ids(parts.select("node", "part"), "part", "node", name="id")


def ghost_ids(where: DataFrame, numbered: DataFrame) -> DataFrame:
    """(part, node, id, owner) of each part's ghosts, by the numbers of their owners."""
    return where.where("ghost").select("node", "part").join(numbered.select("node", "id", F.col("part").alias("owner")), "node").select("part", "node", "id", "owner")


def shared_ids(where: DataFrame, numbered: DataFrame) -> DataFrame:
    """(id, part, destinations): owned numbers that other parts have as ghosts, and which."""
    return ghost_ids(where, numbered).groupBy("id", F.col("owner").alias("part")).agg(F.sort_array(F.collect_set(F.col("part"))).alias("destinations"))


def owned(indices: DataFrame, numbered: DataFrame) -> DataFrame:
    """(part, id): of numbers that any part names (part, id), once for the part that owns them."""
    return indices.select("id").distinct().join(numbered.select("id", "part"), "id").select("part", "id")


def sub_numbering(numbered: DataFrame, some: DataFrame) -> DataFrame:
    """(id, part, sub): a subset of numbers, renumbered in the same order."""
    return dense_ids(numbered.join(some.select("id").distinct(), "id", "left_semi").select("id", "part"), "id", name="sub")


def adjusted(ids: DataFrame, added: DataFrame) -> DataFrame:
    """Numbers moved up by the rows that parts before theirs add: (id, part), (part, n) to (id, part, moved)."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per part
    offsets = added.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
    return ids.join(F.broadcast(offsets), "part").select("id", "part", (F.col("id") + F.col("__o")).alias("moved"))


def _search(edges: DataFrame, degrees: DataFrame, root: int) -> tuple[DataFrame, int]:
    """(node, level, at): a breadth-first search in which a level is in the order of first neighbours, then of degrees; and the last level."""
    spark = edges.sparkSession
    front = reliable(spark.createDataFrame([(root, 0, 0)], "node bigint, level int, at bigint"))
    reached, level, size = front, 0, 1
    while True:
        new = edges.join(front.select(F.col("node").alias("src"), "at"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("at").alias("by"))
        new = new.join(reached, "node", "left_anti").join(degrees, "node")
        placed = dense_ids(new, "by", "degree", "node", name="k")
        front = reliable(placed.select("node", F.lit(level + 1).alias("level"), (F.col("k") + size).alias("at")))
        n = front.count()
        if not n:
            return reached, level
        level, size = level + 1, size + n
        reached = reliable(reached.unionByName(front))


def reverse_cuthill_mckee(edges: DataFrame) -> DataFrame:
    """(node, position) of a symmetric graph (src, dst): breadth-first from a far node of least degree, turned round; a component after another.

    Each level is a join, so the search takes as many rounds as the graph is
    wide, and the components follow one another.
    """
    edges = reliable(edges.where("src != dst").select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).distinct())
    degrees = reliable(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")))
    left, done, out = degrees, 0, None
    while (start := left.orderBy("degree", "node").first()) is not None:
        root, depth = start["node"], -1
        while True:  # a far node: one of least degree in the last level, as long as that goes further
            found, last = _search(edges, degrees, root)
            if last <= depth:
                break
            depth, kept = last, found
            root = found.where(F.col("level") == last).join(degrees, "node").orderBy("degree", "node").first()["node"]
        size = kept.count()
        own = kept.select("node", (F.col("at") + done).alias("position"))
        out, done = own if out is None else out.unionByName(own), done + size
        left = reliable(left.join(kept.select("node"), "node", "left_anti"))
    if out is None:
        return degrees.select("node", F.lit(0).cast("bigint").alias("position"))
    return out.select("node", (F.lit(done - 1) - F.col("position")).alias("position"))


def reordered(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """A graph (src, dst) under the numbers of an ordering (node, position)."""
    a, b = (positions.select(F.col("node").alias(k), F.col("position").alias(f"{k}_at")) for k in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("src_at").alias("src"), F.col("dst_at").alias("dst"))


def bandwidth(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.max(F.abs(F.col("src") - F.col("dst"))), F.lit(0)).alias("bandwidth"))


def cell_graph(mesh: Mesh) -> DataFrame:
    """The graph that cells are partitioned by: (src, dst) across facets."""
    return topology.dual_graph(mesh)
