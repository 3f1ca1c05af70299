"""Function spaces: dofs numbered by entity, their coordinates, fields, constants and boundary conditions as tables.

A dof map is a table (cell, dofs): for each cell the blocks of its local dofs
in order. A block d of a blocked element holds the dofs bs * d + component;
tables of values (i, v) are over these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import cells as meta
from meshwright.functions.elements import CoordinateElement, FiniteElement, MixedElement, element, mixed, orders, quadrature
from meshwright.operators import topology
from meshwright.operators.numbering import dense_ids, reliable
from meshwright.sources.generate import Mesh


def placed(mesh: Mesh) -> DataFrame:
    """(cell, vertices, x): cells with the coordinates of their nodes, three to a node, in one array."""
    n = CoordinateElement(mesh.cell_type, mesh.degree).basis.size
    by = ["cell", "vertices"]
    points = topology.with_points(mesh.cells, mesh.geometry, mesh.nodes, by, n)
    return points.select(*by, F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("x"))


def _entity_rows(mesh: Mesh, e: FiniteElement) -> DataFrame:
    """(cell, kind, key, k, pos): each cell's dofs, by the entity they stand on and their place among its dofs as all its cells see them."""
    dim, out = meta.DIM[e.cell], None
    for d in range(dim + 1):
        if not any(e.entity_dofs[d]):
            continue
        if d == dim:
            listed = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(pos).alias("pos")) for k, pos in enumerate(e.entity_dofs[d][0])))
            rows = mesh.cells.select("cell", F.lit(10 * d).alias("kind"), F.array("cell").alias("key"), F.explode(listed).alias("e")).select("cell", "kind", "key", "e.k", "e.pos")
            out = rows if out is None else out.unionByName(rows)
            continue
        each = topology.cell_entities(mesh, d)
        for sides in sorted({meta.N_VERTICES[meta.entity_type(e.cell, d, i)] for i in range(meta.n_entities(e.cell, d))}):
            local = [i for i in range(meta.n_entities(e.cell, d)) if meta.N_VERTICES[meta.entity_type(e.cell, d, i)] == sides]
            n = len(e.entity_dofs[d][local[0]])
            if not n:
                continue
            own = each.where(F.col("local").isin(local)) if len(local) < meta.n_entities(e.cell, d) else each
            at = F.create_map(*(F.lit(x) for i in local for x in (i, list(e.entity_dofs[d][i]))))
            if n == 1:
                place = F.array(F.lit(0))
            else:
                ranks = F.concat_ws("", F.transform("vertices", lambda v: (F.array_position("key", v) - 1).cast("string")))
                table = orders(meta.entity_type(e.cell, d, local[0]), e.degree)
                place = F.element_at(F.create_map(*(F.lit(x) for code, ks in table.items() for x in (code, ks))), ranks)
            rows = own.select("cell", F.lit(10 * d + sides).alias("kind"), "key", F.explode(F.arrays_zip(place.alias("k"), F.element_at(at, F.col("local")).alias("pos"))).alias("e"))
            rows = rows.select("cell", "kind", "key", F.col("e.k").alias("k"), F.col("e.pos").alias("pos"))
            out = rows if out is None else out.unionByName(rows)
    return out


def create_dofmap(mesh: Mesh, e: FiniteElement) -> DataFrame:
    """(cell, dofs): dofs numbered densely by kind of entity, entity (its sorted vertices) and place on it."""
    if e.family == "Real":
        return mesh.cells.select("cell", F.array(F.lit(0).cast("bigint")).alias("dofs"))
    rows = reliable(_entity_rows(mesh, e)).hint("merge")  # as a mesh's tables; a checkpoint drops what they asked for
    numbered = dense_ids(rows.select("kind", "key", "k").distinct(), "kind", "key", "k", name="dof")
    each = rows.join(numbered, ["kind", "key", "k"])
    dofs = F.array(*(F.max(F.when(F.col("pos") == p, F.col("dof"))) for p in range(e.size)))
    return reliable(each.groupBy("cell").agg(dofs.alias("dofs"))).hint("merge")


def transposed_dofmap(dofmap: DataFrame) -> DataFrame:
    """(dof, cell, pos): where each dof occurs in the cells' lists."""
    return dofmap.select("cell", F.posexplode("dofs").alias("pos", "dof")).select("dof", "cell", "pos")


@dataclass
class FunctionSpace:
    """An element on a mesh. Of a mixed element, `parts` are spaces whose dofs follow one another."""

    mesh: Mesh
    element: FiniteElement | MixedElement
    dofmap: DataFrame | None
    parts: tuple[FunctionSpace, ...] = ()
    parent: FunctionSpace | None = None
    component: int | None = None

    @property
    def block_size(self) -> int:
        return 1 if self.parts else self.element.block_size

    @cached_property
    def blocks(self) -> int:
        """The number of blocks."""
        return (self.dofmap.select(F.explode("dofs").alias("d")).agg(F.max("d")).first()[0] or 0) + 1

    @cached_property
    def size(self) -> int:
        """The number of dofs."""
        return sum(p.size for p in self.parts) if self.parts else self.blocks * self.block_size

    @cached_property
    def offsets(self) -> list[int]:
        """Where each part's dofs begin."""
        out = [0]
        for p in self.parts[:-1]:
            out.append(out[-1] + p.size)
        return out

    def unrolled(self) -> DataFrame:
        """(cell, dofs) with every dof of a block."""
        if self.parts:
            out = None
            for k, (p, first) in enumerate(zip(self.parts, self.offsets, strict=True)):
                own = p.unrolled().select("cell", F.transform("dofs", lambda d, first=first: d + F.lit(first).cast("bigint")).alias(f"__{k}"))
                out = own if out is None else out.join(own, "cell")
            return out.select("cell", F.concat(*(f"__{k}" for k in range(len(self.parts)))).alias("dofs"))
        return self.dofmap.select("cell", unroll(F.col("dofs"), self.block_size).alias("dofs"))

    def sub(self, component: int) -> FunctionSpace:
        """A view of a part of a mixed space, or of one component of a blocked one."""
        if self.parts:
            return FunctionSpace(self.mesh, self.parts[component].element, self.parts[component].dofmap, self.parts[component].parts, self, component)
        if not 0 <= component < self.block_size or self.block_size == 1:
            raise ValueError(f"the space has no component {component}")
        return FunctionSpace(self.mesh, FiniteElement(self.element.family, self.element.cell, self.element.degree), self.dofmap, (), self, component)

    def in_parent(self, dof: Column) -> Column:
        """The parent's number of a dof of this view."""
        if self.parent is None:
            return dof
        inside = dof + F.lit(self.parent.offsets[self.component]).cast("bigint") if self.parent.parts else dof * self.parent.block_size + self.component
        return self.parent.in_parent(inside)

    def collapse(self) -> tuple[FunctionSpace, DataFrame]:
        """The view as a space of its own, and (dof, parent): its dofs' numbers in the space it is a view of."""
        own = FunctionSpace(self.mesh, self.element, self.dofmap, self.parts)
        dofs = own.unrolled().select(F.explode("dofs").alias("dof")).distinct()
        return own, dofs.select("dof", self.in_parent(F.col("dof")).alias("parent"))

    def contains(self, other: FunctionSpace) -> bool:
        """Whether `other` is this space or a view into it."""
        while other is not None:
            if other is self or (other.parent is self.parent is not None and other.component == self.component):
                return True
            other = other.parent
        return False

    def tabulate_dof_coordinates(self) -> DataFrame:
        """(dof, x, y, z) of the blocks of an element that is given by point values."""
        if self.parts or self.element.family in ("N1curl", "RT", "Real"):
            raise ValueError("dofs of this element aren't values at points")
        weights = CoordinateElement(self.mesh.cell_type, self.mesh.degree).tabulate(self.element.points)[0]

        def coordinate(k: int, axis: int) -> Column:
            some = [(n, w) for n, w in enumerate(weights[k].tolist()) if abs(w) > 1e-14]
            return sum((F.col("x")[3 * n + axis] * w for n, w in some[1:]), F.col("x")[3 * some[0][0] + axis] * some[0][1])

        cells = placed(self.mesh).join(self.dofmap, "cell")
        each = F.array(*(F.struct(F.col("dofs")[k].alias("dof"), *(coordinate(k, a).alias(c) for a, c in enumerate("xyz"))) for k in range(self.element.size)))
        return cells.select(F.explode(each).alias("e")).groupBy("e.dof").agg(*(F.min(f"e.{c}").alias(c) for c in "xyz"))


def unroll(dofs: Column, block_size: int) -> Column:
    """An array of blocks as the array of their dofs."""
    if block_size == 1:
        return dofs
    return F.flatten(F.transform(dofs, lambda d: F.transform(F.sequence(F.lit(0), F.lit(block_size - 1)), lambda k: d * block_size + k)))


def functionspace(mesh: Mesh, e: FiniteElement | MixedElement | tuple) -> FunctionSpace:
    """A space by an element, or by (family, degree[, shape[, symmetry]])."""
    if isinstance(e, tuple):
        e = element(e[0], mesh.cell_type, *e[1:])
    if e.cell != mesh.cell_type:
        raise ValueError("the element is for another cell type")
    if isinstance(e, MixedElement):
        return FunctionSpace(mesh, e, None, tuple(functionspace(mesh, p) for p in e.parts))
    return FunctionSpace(mesh, e, create_dofmap(mesh, e))


def mixed_space(*spaces: FunctionSpace) -> FunctionSpace:
    return FunctionSpace(spaces[0].mesh, mixed(*(s.element for s in spaces)), None, spaces)


def common_function_spaces(blocks: list[list[tuple[FunctionSpace, FunctionSpace] | None]]) -> tuple[list[FunctionSpace], list[FunctionSpace]]:
    """The spaces of the rows and of the columns of an array of forms' spaces, None for empty blocks; differing ones are an error."""
    rows: list = [None] * len(blocks)
    columns: list = [None] * len(blocks[0])
    for i, line in enumerate(blocks):
        for j, pair in enumerate(line):
            if pair is None:
                continue
            for known, k, space in ((rows, i, pair[0]), (columns, j, pair[1])):
                if known[k] is not None and known[k] is not space:
                    raise ValueError("the blocks of a row or column have different spaces")
                known[k] = space
    return rows, columns


@dataclass
class Function:
    """A field: values (i, v) of a space's dofs."""

    space: FunctionSpace
    values: DataFrame

    def sub(self, component: int) -> Function:
        """A component's values under its own numbers."""
        view = self.space.sub(component)
        _, table = view.collapse()
        own = self.values.join(table, self.values["i"] == table["parent"]).select(F.col("dof").alias("i"), "v")
        return Function(FunctionSpace(view.mesh, view.element, view.dofmap, view.parts), own)

    def split(self) -> list[Function]:
        n = len(self.space.parts) or self.space.block_size
        return [self.sub(k) for k in range(n)]

    def packed(self) -> DataFrame:
        """(cell, w): each cell's values in the order of its dofs."""
        return pack_coefficient(self.space, self.values)

    def eval(self, points: DataFrame) -> DataFrame:
        """(point, v array) at points (point, cell, x, y, z); zeros where the cell is negative."""
        return evaluate(self, points)


@dataclass(frozen=True)
class Constant:
    """A scalar, vector or tensor, as numpy values."""

    value: np.ndarray

    @staticmethod
    def of(value) -> Constant:
        return Constant(np.asarray(value, float))


def pack_constants(constants: list[Constant]) -> list[float]:
    """All values one after another, row by row."""
    return [float(x) for c in constants for x in c.value.ravel()]


def n_local(space: FunctionSpace) -> int:
    return space.element.space_dimension


def pack_coefficient(space: FunctionSpace, values: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(cell, w) of all cells, or of those given: a join of dofs to values, and a hash aggregate a cell."""
    dofs = space.unrolled() if cells is None else space.unrolled().join(cells.select("cell"), "cell", "left_semi")
    each = dofs.select("cell", F.posexplode("dofs").alias("pos", "i")).join(values.select("i", "v"), "i")
    w = F.array(*(F.coalesce(F.max(F.when(F.col("pos") == k, F.col("v"))), F.lit(0.0)) for k in range(n_local(space))))
    return each.groupBy("cell").agg(w.alias("w"))


def zeros(space: FunctionSpace) -> DataFrame:
    """(i, 0.0) for every dof: a vector of a space."""
    return space.mesh.cells.sparkSession.range(space.size).select(F.col("id").alias("i"), F.lit(0.0).alias("v"))


def interpolate(space: FunctionSpace, values: Column | list[Column]) -> Function:
    """The field of an expression in x, y, z (one a component).

    Elements by point values take it there; N1curl takes its integral along
    edges, RT its flux through facets, both by two-point Gauss rules.
    """
    columns = values if isinstance(values, list) else [values]
    if space.parts:
        raise ValueError("interpolate into the parts of a mixed space one by one")
    if space.element.family in ("N1curl", "RT"):
        return Function(space, _moments(space, columns))
    if len(columns) != space.block_size:
        raise ValueError(f"the space has {space.block_size} components")
    each = space.tabulate_dof_coordinates().select("dof", F.posexplode(F.array(*(c.cast("double") for c in columns))).alias("k", "v"))
    return Function(space, each.select((F.col("dof") * space.block_size + F.col("k")).alias("i"), "v"))


def _moments(space: FunctionSpace, columns: list[Column]) -> DataFrame:
    mesh, e = space.mesh, space.element
    d = 1 if e.family == "N1curl" else meta.DIM[mesh.cell_type] - 1
    n, gdim = d + 1, mesh.gdim
    keyed = topology.cell_entities(mesh, d).select("cell", "local", "key")
    dof = space.dofmap.select("cell", F.posexplode("dofs").alias("local", "dof"))
    keys = keyed.join(dof, ["cell", "local"]).groupBy("key").agg(F.min("dof").alias("dof"))
    at = topology.with_points(keys, "key", mesh.nodes, ["key", "dof"], n)
    p = [[F.col("points")[k][c] for c in "xyz"] for k in range(n)]
    along = [[p[k][a] - p[0][a] for a in range(3)] for k in range(1, n)]
    if e.family == "N1curl" or d == 1:
        t = along[0]
        direction = t if e.family == "N1curl" else [t[1], -t[0], F.lit(0.0)]
    else:
        from meshwright.functions.linear import cross

        direction = [c / 2 for c in cross(*along)]
    points, weights = quadrature({1: "interval", 2: "triangle"}[d], 3)
    size = weights.sum()
    each = F.array(*(F.struct(F.lit(float(w / size)).alias("w"), *((p[0][a] + sum((along[k][a] * float(q[k]) for k in range(d)), F.lit(0.0))).alias(c) for a, c in enumerate("xyz"))) for q, w in zip(points, weights, strict=True)))
    rows = at.select("dof", *(c.alias(f"__{k}") for k, c in enumerate(direction)), F.explode(each).alias("q")).select("dof", *(f"__{k}" for k in range(3)), "q.*")
    along_it = sum((columns[k] * F.col(f"__{k}") for k in range(1, gdim)), columns[0] * F.col("__0"))
    return rows.groupBy(F.col("dof").alias("i")).agg(F.sum(F.col("w") * along_it).alias("v"))


def interpolate_function(space: FunctionSpace, source: Function, cells: DataFrame | None = None) -> Function:
    """Another field of the same mesh in this space, or in the cells given only: values of its basis at this element's points, cell by cell."""
    a, b = space.element, source.space.element
    if space.mesh.cell_type != source.space.mesh.cell_type or a.block_size != b.block_size:
        raise ValueError("the fields differ in cell type or in components")
    matrix, bs = a.interpolation_matrix(b), a.block_size
    w = pack_coefficient(source.space, source.values, cells).join(space.dofmap, "cell")

    def value(k: int, c: int) -> Column:
        some = [(n, x) for n, x in enumerate(matrix[k].tolist()) if abs(x) > 1e-14]
        return sum((F.col("w")[n * bs + c] * x for n, x in some), F.lit(0.0))

    each = F.array(*(F.struct((F.col("dofs")[k] * bs + c).alias("i"), value(k, c).alias("v")) for k in range(a.size) for c in range(bs)))
    return Function(space, w.select(F.explode(each).alias("e")).groupBy("e.i").agg(F.max("e.v").alias("v")))


def interpolate_nonmatching(space: FunctionSpace, source: Function, padding: float = 1e-4) -> Function:
    """A field of another mesh in this space of point values: dofs are points, which find their cells there; 0 where they find none."""
    from meshwright.operators import geometry

    points = reliable(space.tabulate_dof_coordinates().withColumnRenamed("dof", "point"))
    mesh = source.space.mesh
    cells = topology.with_points(mesh.cells, "vertices", mesh.nodes, ["cell"], meta.N_VERTICES[mesh.cell_type])
    owned = geometry.point_ownership(cells, points, padding).select("point", "cell")
    values = evaluate(source, points.join(owned, "point"))
    return Function(space, values.select("point", F.posexplode("v").alias("k", "v")).select((F.col("point") * space.block_size + F.col("k")).alias("i"), "v"))


def interpolation_matrix(space: FunctionSpace, source: FunctionSpace) -> DataFrame:
    """(i, j, v) of the map from a source space's dofs to this one's; entries that several cells give are alike and stand once."""
    matrix, bs = space.element.interpolation_matrix(source.element), space.element.block_size
    both = space.dofmap.join(source.dofmap.select("cell", F.col("dofs").alias("from")), "cell")
    some = [(a, b, float(matrix[a, b])) for a in range(matrix.shape[0]) for b in range(matrix.shape[1]) if abs(matrix[a, b]) > 1e-14]
    each = F.array(*(F.struct((F.col("dofs")[a] * bs + c).alias("i"), (F.col("from")[b] * bs + c).alias("j"), F.lit(x).alias("v")) for a, b, x in some for c in range(bs)))
    return both.select(F.explode(each).alias("e")).groupBy("e.i", "e.j").agg(F.max("e.v").alias("v"))


def batches_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = batch.column(batch.schema.names.index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def basis_values(e: FiniteElement, table: np.ndarray) -> np.ndarray:
    """The blocked basis (points, dofs, *shape) of a table of the scalar basis (points, scalar dofs)."""
    if not e.shape:
        return table
    n, bs = table.shape[1], e.block_size
    out = np.zeros((len(table), n, bs, int(np.prod(e.shape))))
    if e.symmetry:
        side = e.shape[0]
        for c, (i, j) in enumerate((i, j) for i in range(side) for j in range(i, side)):
            out[:, :, c, i * side + j] = table
            out[:, :, c, j * side + i] = table
    else:
        for c in range(bs):
            out[:, :, c, c] = table
    return out.reshape(len(table), n * bs, *e.shape)


def evaluate(f: Function, points: DataFrame) -> DataFrame:
    """(point, v) of a field at points (point, cell, x, y, z), each pulled back to its cell; zeros where the cell is negative."""
    space, mesh = f.space, f.space.mesh
    e, gdim, points = space.element, space.mesh.gdim, points.hint("merge")  # as in geometry.points_in_boxes()
    width = int(np.prod(e.value_shape, dtype=int))
    cells = placed(mesh).withColumnRenamed("x", "nodes").join(f.packed().hint("merge"), "cell")
    at = points.where("cell >= 0").select("point", "cell", F.array("x", "y", "z").alias("at")).join(cells, "cell").select("point", "at", "vertices", "nodes", "w")
    geometry = CoordinateElement(mesh.cell_type, mesh.degree)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batches_of(batch, "nodes").reshape(batch.num_rows, -1, 3)[:, :, :gdim]
            x = geometry.pull_back(nodes, batches_of(batch, "at")[:, :gdim])
            w = batches_of(batch, "w")
            if e.family in ("N1curl", "RT"):
                k = geometry.inverse(geometry.jacobian(nodes, x[:1]))
                basis = np.concatenate([whitney(e, x[i : i + 1], k[i : i + 1], batches_of(batch, "vertices")[i : i + 1])[0][0] for i in range(len(x))])
            else:
                basis = basis_values(e, e.tabulate(x)[0])
            found = np.einsum("cn...,cn->c...", basis, w).reshape(len(x), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(found.ravel()))], names=["point", "v"])

    found = at.mapInArrow(values, f"point {dict(points.dtypes)['point']}, v array<double>")
    none = F.array(*([F.lit(0.0)] * width))
    return points.select("point").join(found, "point", "left").select("point", F.coalesce("v", none).alias("v"))


def whitney(e: FiniteElement, x: np.ndarray, inverse: np.ndarray, vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Basis (cells, points, dofs, gdim) of N1curl or RT, and its curl or divergence; inverse: of the cells' affine Jacobians (cells, points, tdim, gdim).

    Edges point from the lesser vertex to the greater, faces turn from the
    least one on; so neighbours agree without signs.
    """
    tdim, gdim = inverse.shape[2:]
    bary = np.concatenate([1 - x.sum(axis=1, keepdims=True), x], axis=1)  # (points, vertices)
    grad = np.concatenate([-inverse.sum(axis=2, keepdims=True), inverse], axis=2)  # (cells, points, vertices, gdim)
    n, rows = len(inverse), np.arange(len(inverse))
    d = 1 if e.family == "N1curl" else tdim - 1
    values, derived = [], []
    for local in meta.entity_vertices(e.cell, d):
        order = np.argsort(vertices[:, list(local)], axis=1)
        v = np.array(local)[order]  # (cells, d + 1)
        lam = [bary[:, v[:, k]].T for k in range(d + 1)]  # (cells, points)
        g = [grad[rows, :, v[:, k]] for k in range(d + 1)]  # (cells, points, gdim)
        if d == 1:
            one = lam[0][..., None] * g[1] - lam[1][..., None] * g[0]
            turn = 2 * np.cross(g[0], g[1]) if gdim == 3 else 2 * (g[0][..., 0] * g[1][..., 1] - g[0][..., 1] * g[1][..., 0])
            if e.family == "RT":
                one = np.stack([one[..., 1], -one[..., 0]], axis=-1)
            values.append(one)
            derived.append(np.broadcast_to(turn, (n, len(x), *turn.shape[2:])))
        else:
            around = sum(lam[k][..., None] * np.cross(g[(k + 1) % 3], g[(k + 2) % 3]) for k in range(3))
            values.append(2 * around)
            derived.append(6 * np.einsum("cqd,cqd->cq", g[0], np.cross(g[1], g[2])))
    return np.stack(values, axis=2), np.stack(derived, axis=2)


def locate_dofs_geometrical(space: FunctionSpace, marker: Column) -> DataFrame:
    """(dof) of blocks whose coordinates satisfy a predicate in x, y, z; of a view, its parent's dofs beside: (dof, own)."""
    found = space.tabulate_dof_coordinates().where(marker)
    if space.parent is None:
        return found.select("dof")
    return found.select(space.in_parent(F.col("dof")).alias("dof"), F.col("dof").alias("own"))


def locate_dofs_topological(space: FunctionSpace, dim: int, keys: DataFrame) -> DataFrame:
    """(dof) of blocks in the closure of entities (key: sorted vertices; or cell); of a view, its parent's dofs beside: (dof, own)."""
    e, tdim = space.element, meta.DIM[space.mesh.cell_type]
    if dim == tdim and "key" not in keys.columns:
        at = keys.select("cell", F.lit(0).alias("local")).distinct()
    else:
        at = topology.cell_entities(space.mesh, dim).select("cell", "local", "key").join(keys.select("key").distinct(), "key", "left_semi").select("cell", "local")
    closure = F.array(*(F.array(*map(F.lit, e.entity_closure_dofs(dim, i))).cast("array<int>") for i in range(meta.n_entities(e.cell, dim))))
    found = at.join(space.dofmap, "cell").select(F.explode(F.transform(F.element_at(closure, F.col("local") + 1), lambda p: F.get("dofs", p))).alias("dof")).distinct()
    if space.parent is None:
        return found
    return found.select(space.in_parent(F.col("dof")).alias("dof"), F.col("dof").alias("own"))


def dirichletbc(value: Column | float | list | Function, dofs: DataFrame, space: FunctionSpace) -> DataFrame:
    """(dof, g) over single dofs: a constant (one a component), an expression in x, y, z, or a field's values at blocks `dofs`.

    Of a view, `dofs` has its parent's numbers and its own: (dof, own).
    """
    if space.parent is not None:
        own = dofs.select("dof", "own")
        if isinstance(value, Function):
            return own.join(value.values.withColumnRenamed("i", "own"), "own").select("dof", F.col("v").alias("g"))
        if isinstance(value, Column):
            at = space.tabulate_dof_coordinates().withColumnRenamed("dof", "own")
            return own.join(at, "own").select("dof", value.cast("double").alias("g"))
        return own.select("dof", F.lit(float(value)).alias("g"))
    bs = space.block_size
    if isinstance(value, Function):
        each = dofs.select(F.explode(unroll(F.array("dof"), bs)).alias("i"))
        return each.join(value.values, "i").select(F.col("i").alias("dof"), F.col("v").alias("g"))
    at = dofs if not isinstance(value, Column) and not (isinstance(value, list) and any(isinstance(v, Column) for v in value)) else dofs.join(space.tabulate_dof_coordinates(), "dof")
    listed = value if isinstance(value, list) else [value] * bs
    columns = [v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in listed]
    each = at.select("dof", F.posexplode(F.array(*columns)).alias("k", "g"))
    return each.select((F.col("dof") * bs + F.col("k")).alias("dof"), "g")


def mark_dofs(space: FunctionSpace, bc: DataFrame) -> DataFrame:
    """(dof, marked) for every dof."""
    every = zeros(space).select(F.col("i").alias("dof"))
    return every.join(bc.select("dof", F.lit(True).alias("__m")).distinct(), "dof", "left").select("dof", F.coalesce("__m", F.lit(False)).alias("marked"))


def bcs_by_block(spaces: list[FunctionSpace], bcs: list[tuple[FunctionSpace, DataFrame]]) -> list[list[DataFrame]]:
    """The conditions of each space, given with the space they are for."""
    return [[bc for own, bc in bcs if space.contains(own)] for space in spaces]


def interpolate_geometry(mesh: Mesh, degree: int) -> Mesh:
    """The same cells with nodes of a Lagrange element of a higher degree; the corners keep their numbers only by place."""
    space = functionspace(mesh, ("Lagrange", degree))
    nodes = reliable(space.tabulate_dof_coordinates().withColumnRenamed("dof", "node"))
    cells = space.dofmap.select("cell", F.slice("dofs", 1, meta.N_VERTICES[mesh.cell_type]).alias("vertices"), F.col("dofs").alias("geometry"))
    return Mesh(mesh.cell_type, mesh.gdim, cells if degree > 1 else cells.drop("geometry"), nodes, degree)
