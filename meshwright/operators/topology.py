"""Entities, incidence, markers and tags of meshes by keyed joins. An entity's key is its sorted vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import cells as meta
from meshwright.operators.numbering import dense_ids, mapped, reliable
from meshwright.sources.generate import Mesh


def cell_entities(mesh: Mesh, dim: int) -> DataFrame:
    """(cell, local, vertices, key) for every sub-entity of every cell."""
    patterns = meta.entity_vertices(mesh.cell_type, dim)
    listed = F.array(*(F.array(*(F.col("vertices")[v] for v in p)) for p in patterns))
    each = mesh.cells.select("cell", F.posexplode(listed).alias("local", "vertices"))
    return each.withColumn("key", F.array_sort("vertices"))


def entities(mesh: Mesh, dim: int) -> DataFrame:
    """(entity, key): each distinct sub-entity, numbered in the order of keys."""
    return dense_ids(cell_entities(mesh, dim).select("key").distinct(), "key", name="entity")


def incidence(mesh: Mesh, dim: int) -> DataFrame:
    """(cell, local, entity, key)."""
    return cell_entities(mesh, dim).select("cell", "local", "key").join(entities(mesh, dim), "key").select("cell", "local", "entity", "key")


def connectivity(mesh: Mesh, d0: int, d1: int) -> DataFrame:
    """(e0, e1) pairs: entities of d1 in those of d0, or the transpose; of equal dimension, itself."""
    if d0 == d1:
        return entities(mesh, d0).select(F.col("entity").alias("e0"), F.col("entity").alias("e1"))
    low, high = min(d0, d1), max(d0, d1)
    inner, outer = reliable(incidence(mesh, low)), reliable(incidence(mesh, high))
    closure = [(i, j) for i, js in enumerate(meta.sub_entities(mesh.cell_type, high, low)) for j in js]
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in closure)))
    wide = outer.select("cell", "local", F.col("entity").alias("e0"), pairs.alias("p")).where("local = p.i")
    found = wide.join(inner.select("cell", F.col("local").alias("l1"), F.col("entity").alias("e1")), "cell").where("l1 = p.j").select("e0", "e1").distinct()
    return found if d0 > d1 else found.select(F.col("e1").alias("e0"), F.col("e0").alias("e1"))


def facet_counts(mesh: Mesh) -> DataFrame:
    """(key, n, cell, local): facets by key, the cells at each, and the first of these."""
    facets = cell_entities(mesh, meta.DIM[mesh.cell_type] - 1)
    first = F.min(F.struct("cell", "local"))
    return facets.groupBy("key").agg(F.count("*").alias("n"), first.alias("f")).select("key", "n", "f.cell", "f.local")


def exterior_facets(mesh: Mesh) -> DataFrame:
    """(key, cell, local) of facets of exactly one cell."""
    return facet_counts(mesh).where("n = 1").select("key", "cell", "local")


def interior_facets(mesh: Mesh) -> DataFrame:
    """(key, cell0, local0, cell1, local1) of facets of exactly two cells."""
    facets = cell_entities(mesh, meta.DIM[mesh.cell_type] - 1)
    both = facets.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("cell", "local")).alias("a"), F.max(F.struct("cell", "local")).alias("b"))
    return both.where("n = 2").selectExpr("key", "a.cell as cell0", "a.local as local0", "b.cell as cell1", "b.local as local1")


def shared_key_pairs(rows: DataFrame, key: str, node: str) -> DataFrame:
    """(src, dst) both ways for every two different nodes of a key, once for each key they share."""
    a, b = rows.select(key, F.col(node).alias("src")), rows.select(key, F.col(node).alias("dst"))
    return a.join(b, key).where("src != dst").select("src", "dst")


def dual_graph(mesh: Mesh) -> DataFrame:
    """Cells that share a facet, both ways, once for each facet; a facet of k cells gives all their pairs."""
    return shared_key_pairs(cell_entities(mesh, meta.DIM[mesh.cell_type] - 1).select("key", "cell"), "key", "cell")


def incident(pairs: DataFrame, some: DataFrame) -> DataFrame:
    """Distinct e1 of (e0, e1) pairs whose e0 is in `some`."""
    return pairs.join(some.select("e0").distinct(), "e0", "left_semi").select("e1").distinct()


def with_points(keys: DataFrame, vertices: str, nodes: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """Rows by `by` with their vertices' coordinates, in order, as an array of structs `points`.

    With a known number n of vertices, the coordinates are columns of a hash
    aggregate, and expressions on `points` read these columns directly.
    """
    each = keys.select(*by, F.posexplode(vertices).alias("pos", "node")).join(nodes, "node")
    if n:
        placed = each.groupBy(*by).agg(*(F.max(F.when(F.col("pos") == k, F.col(c))).alias(f"__{c}{k}") for k in range(n) for c in "xyz"))
        return placed.select(*by, F.array(*(F.struct(*(F.col(f"__{c}{k}").alias(c) for c in "xyz")) for k in range(n))).alias("points"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("points"))


def vertex_coordinates(mesh: Mesh, keys: DataFrame | None = None) -> DataFrame:
    """(node, x, y, z) of the vertices of cells, or of given entities (key) only, such as boundary facets."""
    some = mesh.cells.select(F.explode("vertices").alias("node")) if keys is None else keys.select(F.explode("key").alias("node"))
    return mesh.nodes.join(some.distinct(), "node", "left_semi")


def entity_geometry(mesh: Mesh, dim: int, keys: DataFrame) -> DataFrame:
    """(key, cell, nodes): the nodes that shape each entity, those of its closure in the first of its cells."""
    from meshwright.functions.elements import FiniteElement

    basis = FiniteElement("Lagrange", mesh.cell_type, mesh.degree)
    first = cell_entities(mesh, dim).join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(F.struct("cell", "local")).alias("f")).select("key", "f.cell", "f.local")
    closure = F.array(*(F.array(*map(F.lit, basis.entity_closure_dofs(dim, i))).cast("array<int>") for i in range(meta.n_entities(mesh.cell_type, dim))))
    return first.join(mesh.cells.select("cell", F.col(mesh.geometry).alias("__n")), "cell").select("key", "cell", F.transform(F.element_at(closure, F.col("local") + 1), lambda p: F.get("__n", p)).alias("nodes"))


def tagged(tags: DataFrame, value: int) -> DataFrame:
    """The entities of a tag."""
    return tags.where(F.col("value") == value).drop("value")


def tags_to_submesh(tags: DataFrame, parent_nodes: DataFrame, sub: Mesh, dim: int) -> DataFrame:
    """Tags (key, value) of a mesh for a sub-mesh's entities, given its nodes' numbers (sub, parent); entities that it hasn't go."""
    each = tags.select("key", "value", F.explode("key").alias("parent")).join(parent_nodes, "parent")
    moved = each.groupBy("key", "value").agg(F.array_sort(F.collect_list("sub")).alias("own")).where(F.size("own") == F.size("key"))
    known = cell_entities(sub, dim).select("key").distinct()
    return moved.select(F.col("own").alias("key"), "value").join(known, "key", "left_semi").groupBy("key").agg(F.min("value").alias("value"))


def cell_permutation_info(mesh: Mesh) -> DataFrame:
    """(cell, info): faces' rotations and reflections, three bits a face, then edges' reflections, a bit an edge."""
    dim = meta.DIM[mesh.cell_type]
    n_faces = meta.n_entities(mesh.cell_type, 2) if dim == 3 else 0
    bits = edge_reflections(mesh).select("cell", F.expr(f"shiftleft(cast(reflected as bigint), local + {3 * n_faces})").alias("bit")) if dim > 1 else mesh.cells.select("cell", F.lit(0).cast("bigint").alias("bit"))
    if dim == 3:
        face = F.expr("shiftleft(cast(rotations * 2 + cast(reflected as int) as bigint), 3 * local)")
        bits = bits.unionByName(face_permutations(mesh).select("cell", face.alias("bit")))
    return bits.groupBy("cell").agg(F.bit_or("bit").alias("info"))


def facet_permutations(mesh: Mesh) -> DataFrame:
    """(cell, local, code): how each facet lies in its cell, twice its turns plus whether it is reflected."""
    if meta.DIM[mesh.cell_type] == 3:
        return face_permutations(mesh).select("cell", "local", (F.col("rotations") * 2 + F.col("reflected").cast("int")).alias("code"))
    if meta.DIM[mesh.cell_type] == 2:
        return edge_reflections(mesh).select("cell", "local", F.col("reflected").cast("int").alias("code"))
    return cell_entities(mesh, 0).select("cell", "local", F.lit(0).alias("code"))


def fingerprint(mesh: Mesh) -> DataFrame:
    """One row with a hash of all cells and nodes, whatever their order; a hash of each part of it can be added up."""
    cells = mesh.cells.agg(F.bit_xor(F.xxhash64("cell", "vertices")).alias("cells"))
    nodes = mesh.nodes.agg(F.bit_xor(F.xxhash64("node", "x", "y", "z")).alias("nodes"))
    return cells.join(nodes).select(F.xxhash64("cells", "nodes").alias("hash"))


def locate_entities(mesh: Mesh, dim: int, marker: Column) -> DataFrame:
    """(key) of entities all of whose vertices satisfy a predicate on x, y, z."""
    keys = cell_entities(mesh, dim).select("key").distinct()
    marked = mesh.nodes.select("node", marker.alias("ok"))
    each = keys.select("key", F.explode("key").alias("node")).join(marked, "node")
    return each.groupBy("key").agg(F.bool_and("ok").alias("ok")).where("ok").select("key")


def locate_entities_boundary(mesh: Mesh, dim: int, marker: Column) -> DataFrame:
    """As locate_entities(), among entities in the closure of exterior facets."""
    tdim = meta.DIM[mesh.cell_type]
    if dim >= tdim:
        raise ValueError("boundary entities are of lower dimension than cells")
    outer = exterior_facets(mesh).select(F.col("key").alias("facet"), "cell")
    inside = cell_entities(mesh, dim).select("cell", "key").join(outer, "cell").where(F.size(F.array_except("key", "facet")) == 0)
    return locate_entities(mesh, dim, marker).join(inside.select("key").distinct(), "key", "left_semi")


def midpoints(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, x, y, z): the mean of each entity's vertices."""
    return keys.select("key", F.explode("key").alias("node")).join(nodes, "node").groupBy("key").agg(*(F.avg(c).alias(c) for c in "xyz"))


def diameters(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, h): the greatest distance of two vertices; 0 for a vertex."""
    placed = with_points(keys, "key", nodes, ["key"])
    far = "transform(points, p -> array_max(transform(points, q -> sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)))))"
    return placed.select("key", F.expr(f"array_max({far})").alias("h"))


def normals(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, nx, ny, nz) of edges in the plane, or of triangles and quadrilaterals in space."""
    from meshwright.functions.linear import cross, norm

    placed = with_points(keys, "key", nodes, ["key"])
    p = [[F.col("points")[k][c] for c in "xyz"] for k in range(3)]
    along = [b - a for a, b in zip(p[0], p[1], strict=True)]
    flat = [-along[1], along[0], F.lit(0.0)]
    solid = cross(along, [b - a for a, b in zip(p[0], p[2], strict=True)])
    n = [F.when(F.size("key") == 2, a).otherwise(b) for a, b in zip(flat, solid, strict=True)]
    return placed.select("key", *((c / norm(n)).alias(f"n{x}") for c, x in zip(n, "xyz", strict=True)))


def entities_to_index(numbered: DataFrame, tuples: DataFrame) -> DataFrame:
    """Adds the entity of each vertex tuple in `vertices`, -1 for none."""
    asked = tuples.withColumn("__key", F.array_sort("vertices"))
    return mapped(asked, "__key", numbered, "key", "entity", "entity").drop("__key")


def meshtags(numbered: DataFrame, tuples: DataFrame) -> DataFrame:
    """(entity, value) of vertex tuples with values; those of no entity go; of several values the smallest stays."""
    found = tuples.select(F.array_sort("vertices").alias("key"), "value").join(numbered, "key")
    return found.groupBy("entity").agg(F.min("value").alias("value"))


def submesh(mesh: Mesh, keys: DataFrame, cell_type: str) -> tuple[Mesh, DataFrame, DataFrame]:
    """Entities as cells of a mesh of their own, with (sub, parent key) and (sub, parent node) maps."""
    cells = dense_ids(keys.select("key").distinct(), "key", name="cell")
    vertices = dense_ids(cells.select(F.explode("key").alias("node")).distinct(), "node", name="sub")
    each = cells.select("cell", F.posexplode("key").alias("pos", "node")).join(vertices, "node")
    own = each.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub"))), lambda p: p["sub"]).alias("vertices"))
    nodes = mesh.nodes.join(vertices, "node").select(F.col("sub").alias("node"), "x", "y", "z")
    return Mesh(cell_type, mesh.gdim, own, nodes), cells.select(F.col("cell").alias("sub"), F.col("key").alias("parent")), vertices.select("sub", F.col("node").alias("parent"))


def transfer_tags(tags: DataFrame, parents: DataFrame) -> DataFrame:
    """Tags (entity, value) to children, given (child, parent); children of untagged parents have none."""
    return parents.join(tags, parents["parent"] == tags["entity"]).select("child", "value")


def edge_reflections(mesh: Mesh) -> DataFrame:
    """(cell, local, reflected): edges whose first vertex has the greater number."""
    return cell_entities(mesh, 1).select("cell", "local", (F.col("vertices")[0] > F.col("vertices")[1]).alias("reflected"))


def face_permutations(mesh: Mesh) -> DataFrame:
    """(cell, local, rotations, reflected) of faces: turns that bring the least vertex first, then whether the next two are in falling order."""
    faces = cell_entities(mesh, 2).withColumn("n", F.size("vertices"))
    # around the face, so that a turn is a shift
    around = faces.withColumn("ring", F.when(F.col("n") == 4, F.array(*(F.col("vertices")[k] for k in (0, 1, 3, 2)))).otherwise(F.col("vertices")))
    turned = around.withColumn("rotations", F.array_position("ring", F.array_min("ring")) - 1)
    at = lambda k: F.col("ring")[((F.col("rotations") + k) % F.col("n")).cast("int")]
    return turned.select("cell", "local", F.col("rotations").cast("int").alias("rotations"), (at(F.lit(1)) > at(F.col("n") - 1)).alias("reflected"))


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, level) by breadth-first search over (src, dst), a join a level."""
    reached = reliable(roots.select("node", F.lit(0).alias("level")).distinct())
    front, level = reached, 0
    while not front.isEmpty():
        level += 1
        new = edges.join(front, edges["src"] == front["node"]).select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti")
        front = reliable(new.withColumn("level", F.lit(level)))
        reached = reliable(reached.unionByName(front))
    return reached
