"""Element tensors of first-order simplices as column expressions, assembled by grouped sums; boundary conditions and lifting.

Other cells and other elements are integrated by quadrature, in plans.weak.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import cells as meta
from meshwright.functions.linear import dot, inv, jacobian, matmul, measure, pinv, transposed
from meshwright.operators.sparse import assembled
from meshwright.operators.topology import exterior_facets, with_points
from meshwright.sources.generate import Mesh


def placed_cells(mesh: Mesh) -> DataFrame:
    """(cell, vertices, points) of simplices; the formulas here hold for no other cells."""
    if not meta.is_simplex(mesh.cell_type) or mesh.degree > 1:
        raise ValueError(f"a {mesh.cell_type} of degree {mesh.degree} isn't affine: use plans.weak")
    return with_points(mesh.cells, "vertices", mesh.nodes, ["cell", "vertices"], meta.N_VERTICES[mesh.cell_type])


def placed_facets(mesh: Mesh, facets: DataFrame) -> DataFrame:
    """(key, points) of facets by key."""
    if not meta.is_simplex(mesh.cell_type):
        raise ValueError(f"facets of a {mesh.cell_type} aren't affine: use plans.weak")
    return with_points(facets.select("key"), "key", mesh.nodes, ["key"], meta.DIM[mesh.cell_type]).withColumnRenamed("key", "vertices")


def volume(tdim: int, gdim: int) -> Column:
    """Of a simplex given by a column `points`."""
    if tdim == 0:
        return F.lit(1.0)
    return measure(jacobian("points", tdim, gdim)) / factorial(tdim)


def gradients(tdim: int, gdim: int) -> list[list[Column]]:
    """Of the barycentric coordinates, constant on a cell."""
    j = jacobian("points", tdim, gdim)
    rows = inv(j) if tdim == gdim else pinv(j)
    first = [-sum((r[c] for r in rows[1:]), rows[0][c]) for c in range(gdim)]
    return [first, *rows]


def _matrix_entries(placed: DataFrame, element: list[list[Column]]) -> DataFrame:
    n = len(element)
    each = F.array(*(F.struct(F.col("vertices")[a].alias("i"), F.col("vertices")[b].alias("j"), element[a][b].alias("v")) for a in range(n) for b in range(n)))
    return placed.select(F.explode(each).alias("e")).select("e.i", "e.j", "e.v")


def _vector_entries(placed: DataFrame, element: list[Column]) -> DataFrame:
    each = F.array(*(F.struct(F.col("vertices")[a].alias("i"), v.alias("v")) for a, v in enumerate(element)))
    return placed.select(F.explode(each).alias("e")).select("e.i", "e.v")


def _mass(tdim: int, gdim: int, weight: Column) -> list[list[Column]]:
    scale = volume(tdim, gdim) * weight / ((tdim + 1) * (tdim + 2))
    return [[scale * (2 if a == b else 1) for b in range(tdim + 1)] for a in range(tdim + 1)]


def stiffness_entries(mesh: Mesh, weight: Column | float = 1.0) -> DataFrame:
    tdim = meta.DIM[mesh.cell_type]
    # gradients and volume are columns, worked out once a cell; the entries are products of them
    names = [[f"__g{a}{c}" for c in range(mesh.gdim)] for a in range(tdim + 1)]
    columns = [g.alias(n) for line, own in zip(gradients(tdim, mesh.gdim), names, strict=True) for g, n in zip(line, own, strict=True)]
    cells = placed_cells(mesh).select("vertices", "points", (volume(tdim, mesh.gdim) * weight).alias("__vol"), *columns)
    g = [[F.col(n) for n in line] for line in names]
    return _matrix_entries(cells, [[F.col("__vol") * dot(a, b) for b in g] for a in g])


def mass_entries(mesh: Mesh, weight: Column | float = 1.0) -> DataFrame:
    return _matrix_entries(placed_cells(mesh), _mass(meta.DIM[mesh.cell_type], mesh.gdim, weight))


def boundary_mass_entries(mesh: Mesh, facets: DataFrame | None = None, weight: Column | float = 1.0) -> DataFrame:
    tdim = meta.DIM[mesh.cell_type] - 1
    return _matrix_entries(placed_facets(mesh, facets if facets is not None else exterior_facets(mesh)), _mass(tdim, mesh.gdim, weight))


def load_entries(mesh: Mesh, value: Column | float = 1.0) -> DataFrame:
    """Of a source that is constant on each cell."""
    tdim = meta.DIM[mesh.cell_type]
    return _vector_entries(placed_cells(mesh), [volume(tdim, mesh.gdim) * value / (tdim + 1)] * (tdim + 1))


def boundary_load_entries(mesh: Mesh, facets: DataFrame | None = None, value: Column | float = 1.0) -> DataFrame:
    tdim = meta.DIM[mesh.cell_type] - 1
    return _vector_entries(placed_facets(mesh, facets if facets is not None else exterior_facets(mesh)), [volume(tdim, mesh.gdim) * value / (tdim + 1)] * (tdim + 1))


def assemble_vector(entries: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Entries added up, on top of what b holds."""
    rows = entries if b is None else entries.union(b.select("i", "v"))
    return rows.groupBy("i").agg(F.sum("v").alias("v"))


def assemble_matrix(entries: DataFrame, bc: DataFrame | None = None, diagonal: float = 1.0) -> DataFrame:
    """Entries added up; rows and columns of constrained dofs (dof, g) are zeroed but for the diagonal."""
    a = assembled(entries)
    if bc is None:
        return a
    dofs = bc.select("dof").distinct()
    free = a.join(dofs.withColumnRenamed("dof", "i"), "i", "left_anti").join(dofs.withColumnRenamed("dof", "j"), "j", "left_anti")
    return free.select("i", "j", "v").union(dofs.select(F.col("dof").alias("i"), F.col("dof").alias("j"), F.lit(diagonal).alias("v")))


def apply_lifting(b: DataFrame, a: DataFrame, bc: DataFrame, x0: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """b - alpha A (g - x0), with the matrix before boundary conditions."""
    g = bc.select(F.col("dof").alias("j"), F.col("g"))
    if x0 is not None:
        g = g.join(x0.select(F.col("i").alias("j"), F.col("v").alias("__x")), "j", "left").select("j", (F.col("g") - F.coalesce("__x", F.lit(0.0))).alias("g"))
    lift = a.join(g, "j").groupBy("i").agg((F.lit(-alpha) * F.sum(F.col("v") * F.col("g"))).alias("v"))
    return b.select("i", "v").union(lift).groupBy("i").agg(F.sum("v").alias("v"))


def set_bc(b: DataFrame, bc: DataFrame, x0: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """b with alpha (g - x0) at constrained dofs."""
    g = bc.select(F.col("dof").alias("i"), F.col("g").alias("__g"))
    if x0 is not None:
        g = g.join(x0.select("i", F.col("v").alias("__x")), "i", "left").select("i", (F.col("__g") - F.coalesce("__x", F.lit(0.0))).alias("__g"))
    return b.join(g, "i", "full").select("i", F.coalesce(F.lit(alpha) * F.col("__g"), "v").alias("v"))


def total(mesh: Mesh, value: Column | float = 1.0) -> DataFrame:
    """The integral over cells of a value that is constant on each."""
    return placed_cells(mesh).agg(F.sum(volume(meta.DIM[mesh.cell_type], mesh.gdim) * value).alias("value"))


def interpolate(mesh: Mesh, value: Column) -> DataFrame:
    """(i, v) of an expression in x, y, z at the nodes."""
    return mesh.nodes.select(F.col("node").alias("i"), value.cast("double").alias("v"))


def evaluate(mesh: Mesh, field: DataFrame, points: DataFrame) -> DataFrame:
    """(point, v) of a first-order field at points (point, cell, x, y, z); 0 where the cell is negative."""
    tdim = meta.DIM[mesh.cell_type]
    at = placed_cells(mesh).join(points.where("cell >= 0"), "cell")
    g = gradients(tdim, mesh.gdim)
    offset = [F.col(c) - F.col("points")[0][c] for c in "xyz"[: mesh.gdim]]
    phi = [dot(row, offset) for row in g]
    phi[0] = 1 + phi[0]
    each = at.select("point", F.explode(F.array(*(F.struct(F.col("vertices")[k].alias("i"), p.alias("phi")) for k, p in enumerate(phi)))).alias("e")).select("point", "e.i", "e.phi")
    found = each.join(field, "i").groupBy("point").agg(F.sum(F.col("phi") * F.col("v")).alias("v"))
    return points.select("point").join(found, "point", "left").select("point", F.coalesce("v", F.lit(0.0)).alias("v"))


def discrete_gradient(edges: DataFrame) -> DataFrame:
    """Rows (edge, vertex, -1 or +1) of edges (entity, key), from the lesser vertex to the greater."""
    each = F.array(F.struct(F.col("key")[0].alias("j"), F.lit(-1.0).alias("v")), F.struct(F.col("key")[1].alias("j"), F.lit(1.0).alias("v")))
    return edges.select(F.col("entity").alias("i"), F.explode(each).alias("e")).select("i", "e.j", "e.v")


def discrete_curl(faces: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (face, edge, sign) of triangles a < b < c: bc - ac + ab."""
    each = F.array(*(F.struct(F.array(F.col("key")[a], F.col("key")[b]).alias("key"), F.lit(s).alias("v")) for a, b, s in ((1, 2, 1.0), (0, 2, -1.0), (0, 1, 1.0))))
    listed = faces.select(F.col("entity").alias("i"), F.explode(each).alias("e")).select("i", "e.key", "e.v")
    return listed.join(edges, "key").select("i", F.col("entity").alias("j"), "v")


def gram(tdim: int, gdim: int) -> list[list[Column]]:
    """The metric of a cell: the Jacobian's transpose times itself."""
    j = jacobian("points", tdim, gdim)
    return matmul(transposed(j), j)
