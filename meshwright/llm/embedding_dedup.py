"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least c lie within epsilon = sqrt(2 - 2c) of
each other. They are sorted by the cells, epsilon wide, of a grid on their
leading principal dimensions; the sorted sequence is cut into blocks, and
pairs of sequence intervals are joined recursively: a pair goes on to its
parts only if the boxes around the two intervals come within epsilon. Pairs of
blocks that remain are compared in double precision.

Equal vectors are one entry with a count. A pair of blocks returns link counts
and a star per connected group, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwright.llm.components import components
from meshwright.llm.storage import cut

#: Vectors of a block, intervals that one of the next level up holds, grid dimensions, vectors that the axes are fitted to.
BLOCK, FANOUT, GRID_DIMS, FIT_SAMPLE = 1024, 8, 6, 4096
#: Blocks that a task packs, and pairs of blocks that it compares, at least; small tables don't pay for a cluster's number of partitions.
BLOCKS_A_TASK, PAIRS_A_TASK = 16, 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def principal_axes(sample: list[list[float]], dims: int = GRID_DIMS) -> dict[int, np.ndarray]:
    """For each vector length the leading principal axes of a sample; they decide on speed alone, not on results."""
    by_length: dict[int, list] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for length, rows in by_length.items():
        units = unit(np.array(rows, np.float64))
        _, _, axes = np.linalg.svd(units - units.mean(axis=0), full_matrices=False)
        out[length] = axes[:dims].T
    return out


def _projected(units: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    found = units @ axes[units.shape[1]] if units.shape[1] in axes else units[:, :GRID_DIMS]
    return np.pad(found, ((0, 0), (0, GRID_DIMS - found.shape[1])))


def _lists(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def star(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected groups of a bipartite link matrix: a label for each row and column, equal within a group."""
    n, m = linked.shape
    rows, columns = np.arange(n), np.arange(n, n + m)
    while True:
        near = np.where(linked, rows[:, None], n + m).min(axis=0)
        new_columns = np.minimum(columns, near)
        near = np.where(linked, new_columns[None, :], n + m).min(axis=1)
        new_rows = np.minimum(rows, near)
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def compare(a: np.ndarray, b: np.ndarray | None, counts_a: np.ndarray, counts_b: np.ndarray, nodes_a: np.ndarray, nodes_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, vectors it links with, a node of its group) for each entry of two blocks of unit vectors (b None: of one) that links."""
    other = a if b is None else b
    linked = a @ other.T >= least
    if b is None:
        np.fill_diagonal(linked, False)
    links_a = linked @ counts_b
    some_a, some_b = links_a > 0, linked.any(axis=0)
    own_a, own_b = nodes_a[some_a], nodes_b[some_b]
    if not len(own_a):
        return own_a, links_a[some_a], own_a
    group_a, group_b = star(linked[some_a][:, some_b])
    centre_a = own_a[group_a]  # a group's label is its first row, for every column has one
    if b is None:
        # a group may show as two, by rows and by columns: tie each entry to both
        return np.concatenate((own_a, own_b)), np.concatenate((links_a[some_a], np.zeros(len(own_b), np.int64))), np.concatenate((centre_a, own_a[group_b]))
    return np.concatenate((own_a, own_b)), np.concatenate((links_a[some_a], (counts_a @ linked)[some_b])), np.concatenate((centre_a, own_a[group_b]))


def _box_columns(kind: str) -> list[str]:
    return [f"{kind}{k}" for k in range(GRID_DIMS)]


def _blocks(entries: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """Entries in grid order, packed into blocks with the box around each."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                place = _projected(unit(_lists(part.column(2))), axes)
                cells = np.floor(place / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(part), length, np.int32)), pa.array(list(cells), pa.list_(pa.int32()))], names=[*part.schema.names, "length", "cells"])

    columns = ["node", "label", "embedding", "copies"]
    kinds = dict(entries.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", length int, cells array<int>"
    ordered = entries.select(*columns).mapInArrow(placed, schema)
    ordered = ordered.repartitionByRange("label", "length", "cells", "node").sortWithinPartitions("label", "length", "cells", "node").coalesce(_tasks(entries, BLOCKS_A_TASK * BLOCK))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def block(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal made
            vectors = _lists(rows.column(2))
            place = _projected(unit(vectors), axes)
            made += 1
            box = [pa.array([float(x)]) for x in (*place.min(axis=0), *place.max(axis=0))]
            data = [[base + made], [rows.column(1)[0].as_py()], [rows.column(4)[0].as_py()], [rows.column(0).to_pylist()], [rows.column(3).to_pylist()], [vectors.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, (pa.int64(), rows.schema.field(1).type, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)] + box, names=names)

        for batch in batches:
            label, length = batch.column(1).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            bounds = [0, *(np.flatnonzero((label[1:] != label[:-1]) | (length[1:] != length[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and (held[0].column(1)[0] != part.column(1)[0] or held[0].column(4)[0] != part.column(4)[0]):
                    yield block(pa.concat_batches(held))
                    held = []
                while part.num_rows:
                    room = BLOCK - sum(x.num_rows for x in held)
                    held.append(part.slice(0, room))
                    part = part.slice(room)
                    if sum(x.num_rows for x in held) == BLOCK:
                        yield block(pa.concat_batches(held))
                        held = []
        if held:
            yield block(pa.concat_batches(held))

    names = ["block", "label", "length", "nodes", "copies", "vectors", *_box_columns("lo"), *_box_columns("hi")]
    boxes = ", ".join(f"{c} double" for c in names[6:])
    return ordered.mapInArrow(packed, f"block long, label {kinds['label']}, length int, nodes array<long>, copies array<long>, vectors binary, {boxes}")


def _tasks(rows: DataFrame, each: int) -> int:
    """Tasks for a checkpointed table: one for so many rows, and no fewer than run at a time."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // each)


def _near_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a, b) of blocks whose boxes come within epsilon, a <= b, found from pairs of ever shorter intervals."""
    lo, hi = _box_columns("lo"), _box_columns("hi")
    order = W.partitionBy("label", "length").orderBy("block")
    tasks = _tasks(blocks, 1000)
    level = cut(blocks.select("block", "label", "length", *lo, *hi).withColumn("at", (F.row_number().over(order) - 1).cast("long")).coalesce(tasks))
    levels = [level.select("label", "length", "at", *lo, *hi)]
    while levels[-1].where("at > 0").limit(1).count():
        up = levels[-1].withColumn("at", F.floor(F.col("at") / FANOUT)).groupBy("label", "length", "at")
        levels.append(cut(up.agg(*(F.min(c).alias(c) for c in lo), *(F.max(c).alias(c) for c in hi)).coalesce(tasks)))
    pairs = levels[-1].selectExpr("label", "length", "at as i", "at as j")
    gap = " + ".join(f"pow(greatest(0D, y.{a} - x.{b}, x.{a} - y.{b}), 2)" for a, b in zip(lo, hi, strict=True))
    for below in reversed(levels[:-1]):
        part = below.withColumn("up", F.floor(F.col("at") / FANOUT))
        same = "p.label = {0}.label and p.length = {0}.length and p.{1} = {0}.up"
        found = pairs.alias("p").join(part.alias("x"), F.expr(same.format("x", "i"))).join(part.alias("y"), F.expr(same.format("y", "j")))
        pairs = cut(found.where(f"x.at <= y.at and {gap} <= {epsilon * epsilon!r}").selectExpr("p.label", "p.length", "x.at as i", "y.at as j").coalesce(tasks))
    numbered = level.select("label", "length", "at", "block")
    first = pairs.join(numbered.withColumnsRenamed({"at": "i", "block": "a"}), ["label", "length", "i"])
    return first.join(numbered.withColumnsRenamed({"at": "j", "block": "b"}), ["label", "length", "j"]).select("a", "b")


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """One row per row of `vectors`: id, n_links, component_id and kept (id equals component_id).

    Only vectors of equal, non-null labels and of equal length are compared.
    A vector that is null, empty or zero, or holds null or non-finite numbers,
    links with nothing. Equal vectors link with each other; n_links counts
    rows. component_id is the smallest non-null id reachable; a row whose id
    and component_id are both null is kept. An empty table gives an empty table.
    """
    epsilon = sqrt(2 - 2 * least) + 1e-9
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    fit = F.expr("label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x != 0)")
    rows = rows.withColumn("ok", F.coalesce(fit, F.lit(False)))
    groups = rows.where("ok").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("id").alias("least_id"))
    entries = cut(groups.withColumn("node", F.monotonically_increasing_id()))
    sample = entries.orderBy(F.xxhash64("node")).select("embedding").limit(FIT_SAMPLE).collect()
    blocks = cut(_blocks(entries, principal_axes([r.embedding for r in sample]), epsilon))
    kind = np.float32 if dict(entries.dtypes)["embedding"] == "array<float>" else np.float64
    body = ["length", "nodes", "copies", "vectors"]
    near = cut(_near_pairs(blocks, epsilon))
    met = near.join(blocks.select(F.col("block").alias("a"), *body), "a").join(blocks.select(F.col("block").alias("b"), *(F.col(c).alias(f"{c}_b") for c in body)), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(data: bytes, length: int) -> np.ndarray:
            return unit(np.frombuffer(data, kind).reshape(-1, length).astype(np.float64))

        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(i)[r] for i, c in enumerate(batch.schema.names)}
                length, alone = x["length"].as_py(), x["a"] == x["b"]
                nodes_a, nodes_b, copies_a, copies_b = (x[c].values.to_numpy() for c in ("nodes", "nodes_b", "copies", "copies_b"))
                a = matrix(x["vectors"].as_py(), length)
                found = compare(a, None if alone else matrix(x["vectors_b"].as_py(), length), copies_a, copies_b, nodes_a, nodes_b, least)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["node", "links", "centre"])

    wanted = met.select("a", "b", "length", "nodes", "copies", "vectors", "nodes_b", "copies_b", "vectors_b")
    wanted = wanted.coalesce(_tasks(near, PAIRS_A_TASK))
    links = cut(wanted.mapInArrow(linked, "node long, links long, centre long").groupBy("node", "centre").agg(F.sum("links").alias("links")))
    found = components(links, "node", "centre")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = entries.join(found, "node", "left").join(counted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = rooted.join(ids, "root").select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    good = rows.where("ok").join(known, ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("id").eqNullSafe(F.col("component_id")), F.lit(False)))
