"""Boxes, points and distances: range joins by a grid of buckets instead of trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwright.operators.numbering import reliable

RTOL = 1e-14
#: Squared distance up to which a cell holds a point: near it, or up to rounding of coordinates about 1.
NEAR, ROUNDING = 1e-12, 1e-28
AXES = ("x", "y", "z")


def boxes(points: DataFrame, entity: str, padding: float = 0.0) -> DataFrame:
    """(entity, lo_x, hi_x, ...) around the points (x, y, z) of each entity."""
    return points.groupBy(F.col(entity).alias("entity")).agg(*(e for c in AXES for e in ((F.min(c) - padding).alias(f"lo_{c}"), (F.max(c) + padding).alias(f"hi_{c}"))))


def overlap(a: str, b: str) -> Column:
    """Closed boxes meet, with a relative tolerance of their extents."""
    tests = [f"{p}.lo_{c} - {RTOL} * ({p}.hi_{c} - {p}.lo_{c}) <= {q}.hi_{c} and {p}.hi_{c} + {RTOL} * ({p}.hi_{c} - {p}.lo_{c}) >= {q}.lo_{c}" for c in AXES for p, q in ((a, b),)]
    return F.expr(" and ".join(tests))


def point_in_box(b: str, p: str, rtol: float = RTOL) -> Column:
    """A closed box holds a point, with a tolerance relative to its extents; with 0 by comparison alone."""
    return F.expr(" and ".join(f"{p}.{c} between {b}.lo_{c} - {rtol}D * ({b}.hi_{c} - {b}.lo_{c}) and {b}.hi_{c} + {rtol}D * ({b}.hi_{c} - {b}.lo_{c})" for c in AXES))


def squared_distance_to_box(b: str, p: str) -> Column:
    """0 inside."""
    return F.expr(" + ".join(f"pow(greatest(0D, {b}.lo_{c} - {p}.{c}, {p}.{c} - {b}.hi_{c}), 2)" for c in AXES))


def _bucketed(frame: DataFrame, lo: str, hi: str, size: dict[str, float]) -> DataFrame:
    """A row for each grid bucket that a box reaches."""
    out = frame
    for c in AXES:
        first, last = (F.floor(F.col(f"{k}{c}") / F.lit(size[c])).cast("bigint") for k in (lo, hi))
        out = out.withColumn(f"g_{c}", F.explode(F.sequence(first, last)) if lo != hi else first)
    return out


def bucket_sizes(frame: DataFrame) -> dict[str, float]:
    """The smallest buckets, by axis: twice the mean extent of boxes."""
    row = frame.agg(*(F.avg(F.col(f"hi_{c}") - F.col(f"lo_{c}")).alias(c) for c in AXES)).first()
    return {c: 2 * row[c] if row[c] else 1.0 for c in AXES}


def _level(size: dict[str, float]) -> Column:
    """How often buckets are doubled until they are as wide as a box; so a box reaches 8 buckets of its level at most."""
    over = F.greatest(*((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / size[c] for c in AXES))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(over, F.lit(1.0))))).cast("int")


def _entered(frame: DataFrame, lo: str, hi: str, size: dict[str, float], levels: Column) -> DataFrame:
    """A row for each bucket that a box reaches, on each of the levels."""
    out = frame.withColumn("g_level", F.explode(levels)).withColumn("__w", F.expr("pow(2D, g_level)"))
    for c in AXES:
        first, last = (F.floor(F.col(f"{k}{c}") / (F.lit(size[c]) * F.col("__w"))).cast("bigint") for k in (lo, hi))
        out = out.withColumn(f"g_{c}", F.explode(F.sequence(first, last)) if lo != hi else first)
    return out


def _levels_of(frame: DataFrame) -> list[int]:
    return sorted(r[0] for r in frame.select("__level").distinct().collect())  # a few tens at most: powers of two of an extent


def box_collisions(a: DataFrame, b: DataFrame, sizes: dict[str, float] | None = None) -> DataFrame:
    """(e0, e1) of boxes that meet.

    Buckets come in sizes that double. A box stands in those of its own size;
    of two boxes the smaller one looks for the larger one on that one's level.
    A pair that shares several buckets counts in the one where both begin.
    """
    size = sizes or bucket_sizes(a)
    a, b = a.withColumn("__level", _level(size)), b.withColumn("__level", _level(size))
    of_a, of_b = _levels_of(a), _levels_of(b)
    own = F.array("__level")
    above = lambda levels, least: F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col("__level") + least)

    def met(p: DataFrame, q: DataFrame) -> DataFrame:
        same = F.expr(" and ".join(f"p.g_{c} = q.g_{c}" for c in ("level", *AXES)))
        first = " and ".join(f"p.g_{c} = greatest(floor(p.lo_{c} / ({size[c]!r}D * p.__w)), floor(q.lo_{c} / ({size[c]!r}D * q.__w)))" for c in AXES)
        return p.alias("p").join(q.alias("q"), same).where(overlap("p", "q") & F.expr(first)).selectExpr("p.entity as e0", "q.entity as e1")

    small_a = met(_entered(a, "lo_", "hi_", size, above(of_b, 0)), _entered(b, "lo_", "hi_", size, own))
    small_b = met(_entered(a, "lo_", "hi_", size, own), _entered(b, "lo_", "hi_", size, above(of_a, 1)))
    return small_a.union(small_b)


def points_in_boxes(frame: DataFrame, points: DataFrame, sizes: dict[str, float] | None = None, rtol: float = RTOL) -> DataFrame:
    """(point, entity) for each box that holds a point (point, x, y, z), as point_in_box() tells; a point looks on every level that has boxes.

    Points ask for joins by sorting, here and below: read from files they count
    as what they take there, so Spark would send millions through the driver.
    """
    size = sizes or bucket_sizes(frame)
    boxes_ = frame.withColumn("__level", _level(size))
    levels = F.array(*map(F.lit, _levels_of(boxes_))).cast("array<int>")
    # a box is entered a little larger, for the tolerance of the test
    wide = boxes_
    for c in AXES:
        margin = (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * rtol
        wide = wide.withColumn(f"w_{c}", F.col(f"lo_{c}") - margin).withColumn(f"x_{c}", F.col(f"hi_{c}") + margin)
    b, p = _entered(wide, "w_", "x_", size, F.array("__level")).alias("b"), _entered(points, "", "", size, levels).hint("merge").alias("p")
    return b.join(p, F.expr(" and ".join(f"b.g_{c} = p.g_{c}" for c in ("level", *AXES)))).where(point_in_box("b", "p", rtol)).selectExpr("p.point", "b.entity")


def _earlier(across: np.ndarray, along: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each item the weights of those before it in both orders, which are permutations of 0..n-1.

    Blocks of the first order are halved level by level, their items kept in
    the second order; items of a right half add up the left half before them.
    """
    n, found = len(weight), np.zeros(len(weight), np.int64)
    item, place = np.argsort(along), np.arange(len(weight))
    size = 1 << max(n - 1, 0).bit_length()
    while size > 1:
        half, at = size >> 1, across[item]
        right, start = (at & half) > 0, at // size * size
        sums, lefts = (np.concatenate([[0], np.cumsum(np.where(right, 0, v))]) for v in (weight[item], 1))
        found[item[right]] += (sums[:-1] - sums[start])[right]
        left = lefts[:-1] - lefts[start]
        item[np.where(right, half + place - left, start + left)] = item.copy()
        size = half
    return found


def _order(*keys: np.ndarray) -> np.ndarray:
    """Each item's place in the order of the keys, the first one foremost."""
    out = np.empty(len(keys[0]), np.int64)
    out[np.lexsort(keys[::-1])] = np.arange(len(out))
    return out


def counts_in_boxes(frame: DataFrame, points: DataFrame) -> DataFrame:
    """(point, n): how many boxes hold a point (point, x, y) in the plane, by comparison alone; points in none are left out.

    No row is made for a pair. Boxes that begin before a point on both axes hold
    it, except those that end before it on one; so each stands as four weighted
    corners, and a point adds up those before it on both axes. Ranges of x are
    strips and ranges of y are slabs: a task adds up what a strip has before a
    point of it, another what a slab has in the strips before; strips before
    in slabs before are sums in a table with a row for each strip and slab.
    """
    ends = lambda c: ((f"lo_{c}", 0, 1), (f"hi_{c}", 2, -1))  # noqa: E731  a box begins at a place before points there, and ends after them
    corners = F.array(*(F.struct(F.col(x).alias("x"), F.lit(kx).alias("kx"), F.col(y).alias("y"), F.lit(ky).alias("ky"), F.lit(wx * wy).cast("bigint").alias("w")) for x, kx, wx in ends("x") for y, ky, wy in ends("y")))
    each = frame.where("lo_x <= hi_x and lo_y <= hi_y").select(F.explode(corners).alias("c")).groupBy("c.x", "c.kx", "c.y", "c.ky").agg(F.sum("c.w").alias("w")).where("w != 0")
    places = points.where("x is not null and y is not null").select("x", F.lit(1).alias("kx"), "y", F.lit(1).alias("ky"), F.lit(0).cast("bigint").alias("w")).distinct()

    def in_strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            table = pa.Table.from_batches(got)
            x, kx, y, ky, w = (table[c].to_numpy() for c in ("x", "kx", "y", "ky", "w"))
            n = np.where(ky == 1, _earlier(_order(x, kx), _order(y, ky), w), w)
            yield from table.select(["strip", "x", "y", "ky"]).append_column("n", pa.array(n)).to_batches(65536)

    placed = each.union(places).repartitionByRange("x", "kx", "y", "ky").withColumn("strip", F.spark_partition_id())
    strips = reliable(placed.mapInArrow(in_strips, "strip int, x double, y double, ky int, n bigint"))
    most = (strips.agg(F.max("strip")).first()[0] or 0) + 1

    def in_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            table = pa.Table.from_batches(got)
            strip, slab, y, ky, n = (table[c].to_numpy() for c in ("strip", "slab", "y", "ky", "n"))
            is_point = ky == 1
            w = np.where(is_point, 0, n)
            n = (n + _earlier(_order(strip, ~is_point), _order(y, ky), w))[is_point]
            kept = table.filter(pa.array(is_point))
            names = ["slab", "strip", "x", "y", "n"]
            yield from pa.Table.from_arrays([*(kept[c] for c in names[:4]), pa.array(n)], names).to_batches(65536)
            before = np.zeros(most + 1, np.int64)
            np.add.at(before, strip + 1, w)
            own = [pa.array(np.full(most, slab[0], np.int32)), pa.array(np.arange(most, dtype=np.int32)), pa.nulls(most, pa.float64()), pa.nulls(most, pa.float64()), pa.array(np.cumsum(before)[:-1])]
            yield pa.RecordBatch.from_arrays(own, names)

    rest = strips.where("ky != 1").groupBy("strip", "y", "ky").agg(F.sum("n").alias("n")).selectExpr("strip", "cast(null as double) as x", "y", "ky", "n").where("n != 0")
    placed = strips.where("ky = 1").union(rest).repartitionByRange("y", "ky", "strip", "x").withColumn("slab", F.spark_partition_id())
    slabs = reliable(placed.mapInArrow(in_slabs, "slab int, strip int, x double, y double, n bigint"))
    below = F.sum("n").over(W.partitionBy("strip").orderBy("slab").rowsBetween(W.unboundedPreceding, -1))
    sums = slabs.where("x is null").select("slab", "strip", F.coalesce(below, F.lit(0)).alias("below"))
    held = slabs.where("x is not null").hint("merge").join(sums, ["slab", "strip"]).select("x", "y", (F.col("n") + F.col("below")).alias("n")).where("n > 0")
    return points.hint("merge").join(held, ["x", "y"]).groupBy("point").agg(F.sum("n").alias("n"))


def global_boxes(frame: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, lo_x, hi_x, ...): one box around all boxes (entity, ...) of each part (entity, part)."""
    ends = [f(f"{k}_{c}").alias(f"{k}_{c}") for c in AXES for k, f in (("lo", F.min), ("hi", F.max))]
    return frame.join(parts, "entity").groupBy("part").agg(*ends)


def first_radius(entities: DataFrame, radius: float, most: int = 32) -> float:
    """The radius, or a quarter of it as often as needed until no bucket of that width has more than `most` places."""
    for _ in range(20):
        full = _bucketed(entities, "", "", dict.fromkeys(AXES, radius)).groupBy(*(f"g_{c}" for c in AXES)).count().agg(F.max("count")).first()[0]
        if (full or 0) <= most:
            return radius
        radius /= 4
    return radius


def closest(entities: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(point, entity, d2): the nearest entity (entity, x, y, z) of each point, the smallest id of several; -1 and null without entities.

    Of entities at one place only the smallest id is searched for. Points
    search the 27 buckets around them, at first as first_radius() says; those
    that find nothing within the radius search again with twice the radius.
    Points far from a crowd of entities meet all of it.
    """
    left = points.select("point", *AXES)
    entities = reliable(entities.groupBy(*AXES).agg(F.min("entity").alias("entity")))
    found = None
    span = entities.agg(*(F.max(F.abs(c)) for c in AXES)).first()
    if span[0] is None:
        return left.select("point", F.lit(-1).cast("bigint").alias("entity"), F.lit(None).cast("double").alias("d2"))
    far = left.agg(*(F.max(F.abs(c)) for c in AXES)).first()
    most = 2 * sum(x or 0.0 for x in (*span, *far)) + radius
    radius = first_radius(entities, radius)
    while True:
        size = dict.fromkeys(AXES, radius)
        e = _bucketed(entities, "", "", size).alias("e")
        near = F.explode(F.expr("array(-1L, 0L, 1L)"))
        p = _bucketed(left, "", "", size)
        for c in AXES:
            p = p.withColumn("__s", near).withColumn(f"g_{c}", F.col(f"g_{c}") + F.col("__s")).drop("__s")
        met = e.join(p.alias("p"), F.expr(" and ".join(f"e.g_{c} = p.g_{c}" for c in AXES)))
        d2 = F.expr(" + ".join(f"pow(e.{c} - p.{c}, 2)" for c in AXES))
        best = met.select("p.point", F.struct(d2.alias("d2"), F.col("e.entity")).alias("b")).groupBy("point").agg(F.min("b").alias("b"))
        near_enough = best if radius > most else best.where(F.col("b.d2") <= radius * radius * (1 - 1e-9))  # at the very bound rounding may part buckets
        hit = reliable(near_enough.select("point", "b.entity", "b.d2"))
        found = hit if found is None else found.unionByName(hit)
        left = reliable(left.join(hit, "point", "left_anti"))
        if left.isEmpty() or radius > most:
            return found
        radius *= 2


def nearest_point_of_hull(points: np.ndarray, tol: float = 1e-15, most: int = 200) -> np.ndarray:
    """The point of least norm of a convex hull, by Wolfe's corral method: an affine minimum within a growing set of vertices."""
    start = int((points**2).sum(axis=1).argmin())
    corral, weight = [start], np.ones(1)
    x = points[start].copy()
    for _ in range(most):
        ahead = points @ x
        new = int(ahead.argmin())
        if ahead[new] > x @ x - tol * max(1.0, (points**2).sum(axis=1).max()) or new in corral:
            return x
        corral.append(new)
        weight = np.append(weight, 0.0)
        while True:
            own = points[corral]
            n = len(corral)
            system = np.block([[own @ own.T, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
            flat = np.linalg.lstsq(system, np.append(np.zeros(n), 1.0), rcond=None)[0][:n]
            if (flat > 1e-14).all():
                weight = flat
                break
            below = flat < weight
            part = min(1.0, (weight[below] / np.maximum(weight[below] - flat[below], 1e-300)).min()) if below.any() else 1.0
            weight = (1 - part) * weight + part * flat
            stay = weight > 1e-14
            if stay.all():
                stay[int(weight.argmin())] = False
            corral, weight = [c for c, s in zip(corral, stay, strict=True) if s], weight[stay] / weight[stay].sum()
        x = weight @ points[corral]
    return x


def nearest_in_simplices(points: np.ndarray) -> np.ndarray:
    """For each simplex (n, k, 3) the point of least norm: the least of all faces' that lies inside its face, all simplices at once."""
    n, k, _ = points.shape
    best, size = points[:, 0].copy(), (points[:, 0] ** 2).sum(axis=1)
    for m in range(1, k + 1):
        for some in combinations(range(k), m):
            own = points[:, some]
            if m == 1:
                found, inside = own[:, 0], np.ones(n, bool)
            else:
                edges = own[:, 1:] - own[:, :1]
                gram = edges @ edges.transpose(0, 2, 1)
                flat = np.linalg.det(gram) <= 1e-28 * np.einsum("nii->n", gram) ** (m - 1)
                gram[flat] = np.eye(m - 1)
                t = np.linalg.solve(gram, -(edges @ own[:, 0, :, None]))[:, :, 0]
                inside = ~flat & (t >= -1e-14).all(axis=1) & (t.sum(axis=1) <= 1 + 1e-14)
                found = own[:, 0] + (t[:, :, None] * edges).sum(axis=1)
            d2 = (found**2).sum(axis=1)
            better = inside & (d2 < size)
            best[better], size[better] = found[better], d2[better]
    return best


def hull_distances(pairs: DataFrame) -> DataFrame:
    """(id, dx, dy, dz, d2): the shortest vector between two convex hulls, given (id, p, q) with arrays of points.

    Where their differences are up to four points, all pairs of a batch are
    solved at once; others one by one.
    """

    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            p, q = (_points(batch.column(k)) for k in (1, 2))
            sizes = np.array([len(a) * len(b) if len(a) and len(b) else 0 for a, b in zip(p, q, strict=True)])
            out = np.full((n, 3), np.nan)
            for k in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == k)
                apart = np.stack([(p[i][:, None, :] - q[i][None, :, :]).reshape(-1, 3) for i in own])
                out[own] = nearest_in_simplices(apart) if k <= 4 else np.stack([nearest_point_of_hull(x) for x in apart])
            columns = [batch.column(0), *(pa.array(out[:, c]) for c in range(3)), pa.array((out * out).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "dx", "dy", "dz", "d2"])

    flat = lambda c: F.flatten(F.transform(c, lambda v: v.cast("array<double>")))
    return pairs.select("id", flat("p").alias("p"), flat("q").alias("q")).mapInArrow(shortest, f"id {dict(pairs.dtypes)['id']}, dx double, dy double, dz double, d2 double")


def _points(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    return [values[a:b].reshape(-1, 3) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def entity_distances(mesh_points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(point, entity, dx, dy, dz, d2): the shortest vector from points to entities (entity, points), for pairs (point, entity, x, y, z)."""
    both = pairs.join(mesh_points.select("entity", "points").hint("merge"), "entity")
    rows = both.select(F.struct("point", "entity").alias("id"), F.transform("points", lambda v: F.array(v["x"], v["y"], v["z"])).alias("p"), F.array(F.array("x", "y", "z")).alias("q"))
    return hull_distances(rows).select("id.point", "id.entity", "dx", "dy", "dz", "d2")


def colliding_cells(cells: DataFrame, candidates: DataFrame, points: DataFrame, most: float = NEAR) -> DataFrame:
    """(point, cell) of candidates (point, entity) whose hull of `points` is within sqrt(most) of the point; with ROUNDING, none that only passes by."""
    pairs = candidates.join(points.hint("merge"), "point")
    found = entity_distances(cells.select(F.col("cell").alias("entity"), "points"), pairs)
    return found.where(F.col("d2") < most).select("point", F.col("entity").alias("cell"))


def point_ownership(cells: DataFrame, points: DataFrame, padding: float = 1e-4, parts: DataFrame | None = None, most: float = NEAR) -> DataFrame:
    """(point, cell, d2[, part]): for each point the least cell (cell, points) that holds it, else the nearest one of those within padding of its box, else -1.

    parts: (cell, part), whose part comes along. most: the squared distance
    below which a cell holds a point; a cell of a lower number that is that
    near takes points that another one holds, unless it is ROUNDING.
    """
    points = points.hint("merge")
    flat = cells.select(F.col("cell").alias("entity"), F.explode("points").alias("p")).select("entity", "p.x", "p.y", "p.z")
    frame = boxes(flat, "entity", padding)
    near = points_in_boxes(frame, points).join(points, "point")
    found = entity_distances(cells.select(F.col("cell").alias("entity"), "points"), near)
    held = F.when(F.col("d2") < most, F.lit(0.0)).otherwise(F.col("d2"))
    best = found.groupBy("point").agg(F.min(F.struct(held.alias("d2"), F.col("entity").alias("cell"))).alias("b")).select("point", "b.cell", "b.d2")
    out = points.select("point").join(best, "point", "left").select("point", F.coalesce("cell", F.lit(-1)).alias("cell"), "d2")
    return out if parts is None else out.join(parts, "cell", "left")


def first_colliding_cell(hits: DataFrame, points: DataFrame) -> DataFrame:
    """(point, cell): the smallest cell that holds each point, -1 for none."""
    return points.select("point").hint("merge").join(hits.groupBy("point").agg(F.min("cell").alias("cell")), "point", "left").select("point", F.coalesce("cell", F.lit(-1)).alias("cell"))
