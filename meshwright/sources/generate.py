"""Structured meshes from spark.range(): no row is made on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import cells as meta


@dataclass(frozen=True)
class Mesh:
    """cells(cell bigint, vertices array<bigint>) and nodes(node bigint, x, y, z double) of one cell type.

    Where the geometry's degree is above 1, cells have a column geometry of all their nodes too.
    Both ask for joins by sorting: estimated sizes leave out the rows that an explode makes, and by
    them Spark would send tables of millions of rows through the driver.
    """

    cell_type: str
    gdim: int
    cells: DataFrame
    nodes: DataFrame
    degree: int = 1

    def __post_init__(self) -> None:
        for table in ("cells", "nodes"):
            object.__setattr__(self, table, getattr(self, table).hint("merge"))

    @property
    def geometry(self) -> str:
        """The column of the nodes that give a cell its shape."""
        return "vertices" if self.degree == 1 else "geometry"


def _grid(spark: SparkSession, lo: list[float], hi: list[float], n: list[int]) -> DataFrame:
    """Grid points, x fastest. A place is its share k / n of the way, so the middle is the middle: k steps of 1 / n may miss it by a rounding error."""
    if any(k < 1 for k in n):
        raise ValueError("a mesh needs at least one cell in each direction")
    total, stride, out = 1, 1, {}
    for k in n:
        total *= k + 1
    for axis, a, b, k in zip("xyz", lo, hi, n, strict=False):
        out[axis] = F.lit(float(a)) + (F.floor(F.col("node") / stride) % (k + 1)) / F.lit(float(k)) * F.lit(float(b - a))
        stride *= k + 1
    zero = F.lit(0.0)
    return spark.range(total).select(F.col("id").alias("node")).select("node", *(out.get(c, zero).cast("double").alias(c) for c in "xyz"))


def _listed(box: DataFrame, patterns: list[list[str]], when: str | None = None, other: list[list[str]] | None = None) -> DataFrame:
    """A cell for each pattern of vertex expressions in each box; `other` patterns where `when` is false."""
    literal = lambda ps: "array(" + ", ".join("array(" + ", ".join(p) + ")" for p in ps) + ")"
    chosen = literal(patterns) if when is None else f"if({when}, {literal(patterns)}, {literal(other or [])})"
    each = box.select("id", F.posexplode(F.expr(chosen)).alias("k", "vertices"))
    return each.select((F.col("id") * len(patterns) + F.col("k")).alias("cell"), "vertices")


def interval(spark: SparkSession, n: int, a: float = 0.0, b: float = 1.0) -> Mesh:
    cells = spark.range(n).select(F.col("id").alias("cell"), F.array("id", F.col("id") + 1).alias("vertices"))
    return Mesh("interval", 1, cells, _grid(spark, [a], [b], [n]))


def rectangle(spark: SparkSession, nx: int, ny: int, cell_type: str = "triangle", diagonal: str = "right", lo: tuple[float, float] = (0.0, 0.0), hi: tuple[float, float] = (1.0, 1.0)) -> Mesh:
    """Triangles (y-major vertices; diagonal left, right, crossed, left_right or right_left) or quadrilaterals (x-major vertices)."""
    box = spark.range(nx * ny)
    if cell_type == "quadrilateral":
        box = box.selectExpr("id", f"(id div {ny}) * {ny + 1} + id % {ny} as v")
        nodes = _grid(spark, [lo[1], lo[0]], [hi[1], hi[0]], [ny, nx]).select("node", F.col("y").alias("x"), F.col("x").alias("y"), "z")
        return Mesh("quadrilateral", 2, _listed(box, [["v", f"v + {ny + 1}", "v + 1", f"v + {ny + 2}"]]), nodes)
    box = box.selectExpr("id", f"(id div {nx}) * {nx + 1} + id % {nx} as a", f"id div {nx} as iy", f"id % {nx} as ix")
    a, b, c, d = "a", "a + 1", f"a + {nx + 1}", f"a + {nx + 2}"
    nodes = _grid(spark, list(lo), list(hi), [nx, ny])
    left, right = [[a, b, c], [b, c, d]], [[a, b, d], [a, c, d]]
    if diagonal == "crossed":
        corners = (nx + 1) * (ny + 1)
        mid = f"{corners} + id"
        wx, wy = float(hi[0] - lo[0]), float(hi[1] - lo[1])
        middles = spark.range(nx * ny).selectExpr(f"{corners} + id as node", f"double({lo[0]}) + (id % {nx} + 0.5D) / {nx} * double({wx!r}) as x", f"double({lo[1]}) + (id div {nx} + 0.5D) / {ny} * double({wy!r}) as y", "0D as z")
        return Mesh("triangle", 2, _listed(box, [[a, b, mid], [a, c, mid], [b, d, mid], [c, d, mid]]), nodes.union(middles))
    if diagonal in ("left", "right"):
        return Mesh("triangle", 2, _listed(box, left if diagonal == "left" else right), nodes)
    first = {"right_left": 0, "left_right": 1}[diagonal]  # parity of the boxes that are cut to the left
    return Mesh("triangle", 2, _listed(box, left, f"(ix + iy) % 2 = {first}", right), nodes)


def box(spark: SparkSession, nx: int, ny: int, nz: int, cell_type: str = "tetrahedron", lo: tuple[float, float, float] = (0.0, 0.0, 0.0), hi: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Mesh:
    """Tetrahedra (six a box, around one diagonal), hexahedra, or prisms (two a box)."""
    if any(a >= b for a, b in zip(lo, hi, strict=True)):
        raise ValueError("the lower corner must be below the upper one")
    at = spark.range(nx * ny * nz).selectExpr("id", f"((id div {nx * ny}) * {ny + 1} + (id div {nx}) % {ny}) * {nx + 1} + id % {nx} as v")
    step, up = nx + 1, (nx + 1) * (ny + 1)
    v = [f"v + {(k & 1) + (k >> 1 & 1) * step + (k >> 2) * up}" for k in range(8)]
    # Tetrahedra around the diagonal from corner 0 to corner 7, and two prisms, which fix the numbers of cells.
    tets = [(0, 1, 3, 7), (0, 1, 7, 5), (0, 5, 7, 4), (0, 3, 2, 7), (0, 6, 4, 7), (0, 2, 6, 7)]
    patterns = {"tetrahedron": tets, "hexahedron": [tuple(range(8))], "prism": [(0, 1, 2, 4, 5, 6), (1, 2, 3, 5, 6, 7)]}[cell_type]
    return Mesh(cell_type, 3, _listed(at, [[v[k] for k in p] for p in patterns]), _grid(spark, list(lo), list(hi), [nx, ny, nz]))


def points(spark: SparkSession, rows: list[tuple[float, ...]]) -> Mesh:
    """A mesh of points."""
    nodes = spark.createDataFrame([(i, *(float(x) for x in r), *([0.0] * (3 - len(r)))) for i, r in enumerate(rows)], "node bigint, x double, y double, z double")
    return Mesh("point", 3, nodes.select(F.col("node").alias("cell"), F.array("node").alias("vertices")), nodes)


def from_arrays(cell_type: str, gdim: int, cells: DataFrame, nodes: DataFrame, degree: int = 1) -> Mesh:
    """A mesh of given cells (cell, vertices) and nodes; nodes that no cell has go.

    With a degree above 1, `vertices` has all nodes of a cell, corners first.
    """
    n = meta.N_VERTICES[cell_type]
    used = cells.select(F.explode("vertices").alias("node")).distinct()
    cells = cells.select("cell", "vertices") if degree == 1 else cells.select("cell", F.slice("vertices", 1, n).alias("vertices"), F.col("vertices").alias("geometry"))
    return Mesh(cell_type, gdim, cells, nodes.join(used, "node", "left_semi").select("node", "x", "y", "z"), degree)


def extract_topology(cell_type: str, cells: DataFrame) -> DataFrame:
    """(cell, vertices) of cells given by all their nodes."""
    return cells.select("cell", F.slice("vertices", 1, meta.N_VERTICES[cell_type]).alias("vertices"))
