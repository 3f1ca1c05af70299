"""Uniform refinement and longest-edge (Plaza) refinement of simplices by joins on edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import cells as meta
from meshwright.functions.elements import corners
from meshwright.operators.numbering import dense_ids, reliable
from meshwright.operators.topology import cell_entities
from meshwright.sources.generate import Mesh

#: Fixed choices: how what is left inside a simplex or pyramid is cut when its corners are cut off. v are vertices, e midpoints of edges, f middles of faces.
INNER = {"triangle": ["e0 e1 e2"], "tetrahedron": ["e0 e5 e3 e4", "e0 e5 e4 e2", "e0 e5 e2 e1", "e0 e5 e1 e3"]}


def _named(cell: str) -> dict[tuple[float, ...], str]:
    """The points of a cell of half its size, by place: vertices, midpoints of edges, middles of quadrilaterals, of a hexahedron."""
    x, out = corners(cell), {}
    for d, letter in ((0, "v"), (1, "e"), (2, "f"), (3, "m")):
        for i, v in enumerate(meta.entity_vertices(cell, d) if d <= meta.DIM[cell] else []):
            if meta.entity_type(cell, d, i) in ("point", "interval", "quadrilateral", "hexahedron"):
                out.setdefault(tuple(x[list(v)].mean(axis=0).tolist()), f"{letter}{i}")
    return out


def children_of(cell: str) -> dict[str, list[str]]:
    """The children of a cell by type. Each vertex has one: the cell at half its size about the vertex; a prism's layers and what is inside follow."""
    x, names = corners(cell), _named(cell)
    at = lambda q: names[tuple(q.tolist())]
    if cell == "prism":
        flat, base = children_of("triangle")["triangle"], _named("triangle")
        place = {n: q for q, n in base.items()}
        return {cell: [" ".join(names[(*place[t], z)] for z in (low, low + 0.5) for t in child.split()) for low in (0.0, 0.5) for child in flat]}
    out = {cell: [" ".join(at((v + w) / 2) for w in x) for v in x] + INNER.get(cell, [])}
    if cell == "pyramid":
        ring = [at((x[k] + x[4]) / 2) for k in range(4)]
        out[cell].append(" ".join([*ring, at(x[:4].mean(axis=0))]))
        out["tetrahedron"] = [" ".join([at((x[a] + x[b]) / 2), at(x[:4].mean(axis=0)), ring[a], ring[b]]) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]
    return out


def mark_maximum(markers: DataFrame, theta: float, value: str = "v") -> DataFrame:
    """Rows whose value is above theta times the greatest."""
    if not 0 < theta < 1:
        raise ValueError("theta must be between 0 and 1")
    top = markers.agg(F.max(value).alias("__top"))  # one row
    return markers.join(F.broadcast(top), F.col(value) > F.lit(theta) * F.col("__top")).drop("__top")


def edge_lengths(mesh: Mesh) -> DataFrame:
    """(key, d2)."""
    keys = cell_entities(mesh, 1).select("key").distinct()
    a = mesh.nodes.select(*(F.col(c).alias(f"a{c}") for c in ("node", "x", "y", "z")))
    b = mesh.nodes.select(*(F.col(c).alias(f"b{c}") for c in ("node", "x", "y", "z")))
    both = keys.join(a, F.col("key")[0] == F.col("anode")).join(b, F.col("key")[1] == F.col("bnode"))
    return both.select("key", F.expr("pow(ax - bx, 2) + pow(ay - by, 2) + pow(az - bz, 2)").alias("d2"))


def new_vertices(mesh: Mesh, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node) of a midpoint for each edge, numbered after the mesh's nodes; and all nodes."""
    last = mesh.nodes.agg((F.max("node") + 1).alias("first"))  # one row
    numbered = dense_ids(edges.select("key").distinct(), "key", name="k").join(F.broadcast(last)).select("key", (F.col("first") + F.col("k")).alias("node"))
    numbered = reliable(numbered)
    ends = numbered.select("node", F.explode("key").alias("end")).join(mesh.nodes.withColumnRenamed("node", "end"), "end")
    return numbered, mesh.nodes.union(ends.groupBy("node").agg(*(F.avg(c).alias(c) for c in "xyz")))


def _halved(mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    """(cell, vertices, a column for each name of children_of()), and all nodes: midpoints of edges, quadrilaterals and hexahedra are new ones."""
    names = [n for n in _named(mesh.cell_type).values() if n[0] != "v"]
    rows = None
    for d in {"e": 1, "f": 2, "m": 3}.items():
        own = {int(n[1:]): n for n in names if n[0] == d[0]}
        if own:
            each = cell_entities(mesh, d[1]).where(F.col("local").isin(list(own)))
            each = each.select("cell", F.concat(F.lit(d[0]), F.col("local").cast("string")).alias("name"), "key")
            rows = each if rows is None else rows.unionByName(each)
    rows = reliable(rows)
    numbered, nodes = new_vertices(mesh, rows)
    placed = rows.join(numbered, "key").groupBy("cell").agg(*(F.max(F.when(F.col("name") == n, F.col("node"))).alias(n) for n in names))
    return mesh.cells.join(placed, "cell"), nodes


def uniform_parts(mesh: Mesh) -> dict[str, tuple[Mesh, DataFrame]]:
    """Every cell divided: by cell type the mesh of children and (child, parent). Pyramids give pyramids and tetrahedra, the others their own type."""
    if meta.DIM[mesh.cell_type] == 0:
        raise ValueError("points can't be divided")
    cells, nodes = _halved(mesh)
    cells, out = reliable(cells), {}
    for kind, children in children_of(mesh.cell_type).items():
        column = lambda n: f"vertices[{n[1:]}]" if n[0] == "v" else n
        listed = "array(" + ", ".join("array(" + ", ".join(map(column, c.split())) + ")" for c in children) + ")"
        each = cells.select(F.col("cell").alias("parent"), F.posexplode(F.expr(listed)).alias("k", "vertices"))
        made = reliable(dense_ids(each, "parent", "k", name="cell"))
        out[kind] = (Mesh(kind, mesh.gdim, made.select("cell", "vertices"), nodes), made.select(F.col("cell").alias("child"), "parent"))
    return out


def uniform(mesh: Mesh) -> tuple[Mesh, DataFrame]:
    """Every cell divided, and (child, parent); for pyramids, which give two types of cells, see uniform_parts()."""
    found = uniform_parts(mesh)
    if len(found) > 1:
        raise ValueError("children are of several types; use uniform_parts()")
    return found[mesh.cell_type]


def longest_edges(mesh: Mesh) -> DataFrame:
    """(face, key): the longest edge of each triangle, of several the one of greatest key; a mesh of triangles' faces are its cells."""
    faces = cell_entities(mesh, 2).select(F.col("key").alias("face")).distinct()
    ends = F.array(*(F.array(F.col("face")[a], F.col("face")[b]) for a, b in ((0, 1), (0, 2), (1, 2))))
    sides = faces.select("face", F.explode(ends).alias("key")).join(edge_lengths(mesh), "key")
    return sides.groupBy("face").agg(F.max(F.struct("d2", "key")).alias("top")).select("face", F.col("top.key").alias("key"))


def closed_marks(mesh: Mesh, marked: DataFrame) -> DataFrame:
    """Marked edges (key) and those that the rule adds: where an edge of a triangle is marked, its longest one is."""
    now = reliable(marked.select("key").distinct())
    if meta.DIM[mesh.cell_type] < 2:
        return now
    longest = reliable(longest_edges(mesh))
    ends = F.array(*(F.array(F.col("face")[a], F.col("face")[b]) for a, b in ((0, 1), (0, 2), (1, 2))))
    sides = reliable(longest.select("face", F.explode(ends).alias("key")))
    front = now
    while not front.isEmpty():  # only what a round adds can add more
        touched = sides.join(front, "key", "left_semi").select("face").distinct()
        front = reliable(longest.join(touched, "face", "left_semi").select("key").distinct().join(now, "key", "left_anti"))
        now = reliable(now.union(front))
    return now


def plaza(mesh: Mesh, marked: DataFrame) -> tuple[Mesh, DataFrame]:
    """Simplices divided at marked edges (key); and (child, parent, parent_facets).

    A cell is cut at its marked edges one after another, the longest first, so
    that faces are cut alike from both sides. parent_facets has for each local
    facet of a child the parent's local facet that it lies in, -1 for none.
    """
    if not meta.is_simplex(mesh.cell_type) or meta.DIM[mesh.cell_type] < 1:
        raise ValueError("refinement by marks is for simplices; use uniform_parts() for others")
    numbered, nodes = new_vertices(mesh, closed_marks(mesh, marked))
    sides = cell_entities(mesh, 1).select("cell", "key").join(numbered, "key").join(edge_lengths(mesh), "key")
    cuts = sides.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("d2", "key", "node")), asc=False).alias("cuts"))  # a cell's edges: 6 at most
    cells = mesh.cells.join(cuts, "cell", "left").withColumn("cuts", F.coalesce("cuts", F.expr("array()").cast(cuts.schema["cuts"].dataType)))
    moved = lambda end: f"transform(t, x -> if(x = c.key[{end}], c.node, x))"
    split = f"if(array_contains(t, c.key[0]) and array_contains(t, c.key[1]), array({moved(1)}, {moved(0)}), array(t))"
    listed = f"aggregate(cuts, array(vertices), (ts, c) -> flatten(transform(ts, t -> {split})))"
    facets = meta.entity_vertices(mesh.cell_type, meta.DIM[mesh.cell_type] - 1)
    # the parent's vertices that the children's vertices at a facet depend on; the facet of a simplex is opposite the vertex that none depends on
    ends = "flatten(transform(filter(cuts, c -> c.node = x), c -> c.key))"
    depends = lambda f: "flatten(array(" + ", ".join(f"transform(array(w[{k}]), x -> if(array_contains(vertices, x), array(x), {ends}))" for k in f) + "))"
    opposite = [next(v for v in range(meta.N_VERTICES[mesh.cell_type]) if v not in f) for f in facets]
    local = "array(" + ", ".join(map(str, opposite)) + ")"
    each = cells.select("cell", "vertices", "cuts", F.posexplode(F.expr(listed)).alias("k", "w"))
    found = [f"coalesce(get(filter(sequence(0, {len(facets) - 1}), f -> not array_contains(flatten({depends(f)}), vertices[{local}[f]])), 0), -1)" for f in facets]
    each = each.select(F.col("cell").alias("parent"), "k", F.col("w").alias("vertices"), F.expr("array(" + ", ".join(found) + ")").alias("parent_facets"))
    children = reliable(dense_ids(each, "parent", "k", name="cell"))
    return Mesh(mesh.cell_type, mesh.gdim, children.select("cell", "vertices"), nodes), children.select(F.col("cell").alias("child"), "parent", "parent_facets")


def refine(mesh: Mesh, marked: DataFrame | None = None) -> tuple[Mesh, DataFrame]:
    """Simplices divided at marked edges, or all of them in the same way; and (child, parent, parent_facets)."""
    return plaza(mesh, marked if marked is not None else cell_entities(mesh, 1).select("key"))


def transfer_facet_tags(tags: DataFrame, coarse: Mesh, fine: Mesh, parents: DataFrame) -> DataFrame:
    """(key, value) of fine facets that lie in tagged facets (key, value) of the coarse mesh, given (child, parent, parent_facets)."""
    dim = meta.DIM[coarse.cell_type] - 1
    above = cell_entities(coarse, dim).join(tags.select("key", "value"), "key").select(F.col("cell").alias("parent"), F.col("local").alias("facet"), "value")
    below = parents.select("child", "parent", F.posexplode("parent_facets").alias("own", "facet")).where("facet >= 0").join(above, ["parent", "facet"])
    own = cell_entities(fine, dim).select(F.col("cell").alias("child"), F.col("local").alias("own"), "key")
    return own.join(below, ["child", "own"]).groupBy("key").agg(F.min("value").alias("value"))


def identity_partition(parts: DataFrame, parents: DataFrame) -> DataFrame:
    """(cell, part) of children: each stays in its parent's part (cell, part)."""
    return parents.join(parts.withColumnRenamed("cell", "parent"), "parent").select(F.col("child").alias("cell"), "part")
