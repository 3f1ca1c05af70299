"""Weak forms: expressions in test and trial functions, fields and constants, integrated by quadrature.

A form is a plan: cells (or facets) joined with their nodes, dofs and packed
field values, whose batches go through one numpy kernel each that evaluates
the expression at all quadrature points, and the entries that come out are
added up by a grouped sum. In a kernel a value has the axes (cells, points,
test dofs, trial dofs, *shape), of length 1 where it doesn't depend on one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from dataclasses import replace as changed

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import cells as meta
from meshwright.functions.elements import CoordinateElement, FiniteElement, entity_order, facet_points, outward, quadrature
from meshwright.operators import spaces as sp
from meshwright.operators import topology
from meshwright.operators.spaces import Constant, Function, FunctionSpace, batches_of
from meshwright.sources.generate import Mesh

#: Numbers of a batch's element tensors that a kernel holds at a time.
KERNEL_NUMBERS = 4_000_000


class Expr:
    """Anything that has a value at a point."""

    def __add__(self, other):
        return Sum(self, lift(other))

    __radd__ = __add__

    def __sub__(self, other):
        return Sum(self, Product(lift(-1.0), lift(other)))

    def __rsub__(self, other):
        return Sum(lift(other), -self)

    def __neg__(self):
        return Product(lift(-1.0), self)

    def __mul__(self, other):
        if isinstance(other, Measure):
            return NotImplemented
        return Product(self, lift(other))

    def __rmul__(self, other):
        return Product(lift(other), self)

    def __truediv__(self, other):
        return Product(self, Power(lift(other), -1.0))

    def __pow__(self, n):
        return Power(self, float(n))

    def __getitem__(self, index):
        return Index(self, index if isinstance(index, tuple) else (index,))

    def __call__(self, side: str):
        return Side(self, side)

    def parts(self) -> tuple[Expr, ...]:
        return ()

    def rebuilt(self, parts: list[Expr]) -> Expr:
        return self


def lift(x) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, Function):
        return Field(x)
    return Value(x if isinstance(x, Constant) else Constant.of(x))


@dataclass(eq=False)
class Value(Expr):
    constant: Constant


@dataclass(eq=False)
class Position(Expr):
    """The coordinates of a point."""


@dataclass(eq=False)
class Normal(Expr):
    """The unit normal of a facet, out of the cell."""


@dataclass(eq=False)
class Diameter(Expr):
    """The greatest distance of two vertices of a cell."""


@dataclass(eq=False)
class Argument(Expr):
    """A test function (number 0) or trial function (1); part: of a mixed space."""

    space: FunctionSpace
    number: int
    part: int | None = None

    @property
    def element(self) -> FiniteElement:
        return self.space.element if self.part is None else self.space.parts[self.part].element


@dataclass(eq=False)
class Field(Expr):
    """A field's value; part: of a mixed space's field."""

    function: Function
    part: int | None = None

    @property
    def space(self) -> FunctionSpace:
        return self.function.space

    @property
    def element(self) -> FiniteElement:
        return self.space.element if self.part is None else self.space.parts[self.part].element


@dataclass(eq=False)
class _One(Expr):
    """A node of one operand; slope() gives the derivative of a function of numbers as an expression."""

    of: Expr

    def parts(self):
        return (self.of,)

    def rebuilt(self, parts):
        return type(self)(*parts)


class Sin(_One):
    apply = staticmethod(np.sin)

    def slope(self) -> Expr:
        return Cos(self.of)


class Cos(_One):
    apply = staticmethod(np.cos)

    def slope(self) -> Expr:
        return -Sin(self.of)


class Exp(_One):
    apply = staticmethod(np.exp)

    def slope(self) -> Expr:
        return self


class Log(_One):
    apply = staticmethod(np.log)

    def slope(self) -> Expr:
        return Power(self.of, -1.0)


class Abs(_One):
    apply = staticmethod(np.abs)

    def slope(self) -> Expr:
        return self / self.of


class Transposed(_One):
    @staticmethod
    def apply(a: np.ndarray) -> np.ndarray:
        return np.swapaxes(a, -1, -2)


class Trace(_One):
    @staticmethod
    def apply(a: np.ndarray) -> np.ndarray:
        return np.trace(a, axis1=-2, axis2=-1)


class Grad(_One):
    pass


class Div(_One):
    pass


class Curl(_One):
    pass


LINEAR = (Transposed, Trace, Grad, Div, Curl)


class _Two(Expr):
    def parts(self):
        return (self.a, self.b)

    def rebuilt(self, parts):
        return type(self)(*parts)


@dataclass(eq=False)
class Sum(_Two):
    a: Expr
    b: Expr


@dataclass(eq=False)
class Product(_Two):
    """At least one factor is a number."""

    a: Expr
    b: Expr


@dataclass(eq=False)
class Inner(_Two):
    """The sum over all components."""

    a: Expr
    b: Expr


@dataclass(eq=False)
class Dot(_Two):
    """The sum over the last axis of one and the first of the other."""

    a: Expr
    b: Expr


@dataclass(eq=False)
class Outer(_Two):
    a: Expr
    b: Expr


@dataclass(eq=False)
class Power(Expr):
    of: Expr
    n: float

    def parts(self):
        return (self.of,)

    def rebuilt(self, parts):
        return Power(parts[0], self.n)


@dataclass(eq=False)
class Index(Expr):
    of: Expr
    index: tuple[int, ...]

    def parts(self):
        return (self.of,)

    def rebuilt(self, parts):
        return Index(parts[0], self.index)


@dataclass(eq=False)
class Side(Expr):
    """The value from one side ("+" or "-") of an interior facet."""

    of: Expr
    side: str

    def parts(self):
        return (self.of,)

    def rebuilt(self, parts):
        return Side(parts[0], self.side)


def grad(x) -> Expr:
    return Grad(lift(x))


def div(x) -> Expr:
    return Div(lift(x))


def curl(x) -> Expr:
    return Curl(lift(x))


def inner(a, b) -> Expr:
    return Inner(lift(a), lift(b))


def dot(a, b) -> Expr:
    return Dot(lift(a), lift(b))


def outer(a, b) -> Expr:
    return Outer(lift(a), lift(b))


def sym(x) -> Expr:
    return (lift(x) + Transposed(lift(x))) * 0.5


def tr(x) -> Expr:
    return Trace(lift(x))


def jump(x) -> Expr:
    return lift(x)("+") - lift(x)("-")


def avg(x) -> Expr:
    return (lift(x)("+") + lift(x)("-")) * 0.5


def TestFunction(space: FunctionSpace) -> Argument:
    return Argument(space, 0)


def TrialFunction(space: FunctionSpace) -> Argument:
    return Argument(space, 1)


def TestFunctions(space: FunctionSpace) -> list[Argument]:
    return [Argument(space, 0, k) for k in range(len(space.parts))]


def TrialFunctions(space: FunctionSpace) -> list[Argument]:
    return [Argument(space, 1, k) for k in range(len(space.parts))]


def split(f: Function) -> list[Field]:
    return [Field(f, k) for k in range(len(f.space.parts))]


def leaves(x: Expr) -> Iterator[Expr]:
    below = x.parts()
    if not below:
        yield x
    for p in below:
        yield from leaves(p)


def degree(x: Expr) -> int:
    """An estimate of the polynomial degree."""
    if isinstance(x, (Argument, Field)):
        return 1 if x.element.family in ("N1curl", "RT") else 0 if x.element.family == "Real" else x.element.degree
    if isinstance(x, Position):
        return 1
    if isinstance(x, (Product, Inner, Dot, Outer)):
        return degree(x.a) + degree(x.b)
    if isinstance(x, Sum):
        return max(degree(x.a), degree(x.b))
    if isinstance(x, Power):
        return int(abs(x.n) * degree(x.of)) if x.n == int(x.n) and x.n > 0 else degree(x.of) + 2
    if isinstance(x, (Grad, Div, Curl)):
        return max(0, degree(x.of) - 1)
    if isinstance(x, (Sin, Cos, Exp, Log, Abs)):
        return degree(x.of) + 2
    return max((degree(p) for p in x.parts()), default=0)


def derivative(x: Expr, u: Function, du: Expr) -> Expr:
    """The Gateaux derivative of an expression with respect to a field, in the direction du."""
    if isinstance(x, Field):
        if x.function is not u:
            return lift(0.0)
        return du if x.part is None else Argument(du.space, du.number, x.part)
    if not any(isinstance(y, Field) and y.function is u for y in leaves(x)):
        return lift(0.0)
    if isinstance(x, Sum):
        found = [derivative(p, u, du) for p in x.parts()]
        some = [p for p in found if not _is_zero(p)]
        return Sum(*some) if len(some) == 2 else some[0] if some else lift(0.0)
    if isinstance(x, (Product, Inner, Dot, Outer)):
        a, b = derivative(x.a, u, du), derivative(x.b, u, du)
        some = [type(x)(*p) for p, d in (((a, x.b), a), ((x.a, b), b)) if not _is_zero(d)]
        return some[0] if len(some) == 1 else Sum(*some)
    if isinstance(x, Power):
        return Product(Product(lift(x.n), Power(x.of, x.n - 1)), derivative(x.of, u, du))
    if isinstance(x, (Index, Side, *LINEAR)):
        return x.rebuilt([derivative(x.of, u, du)])
    if hasattr(x, "slope"):
        return Product(x.slope(), derivative(x.of, u, du))
    raise ValueError(f"no derivative of {type(x).__name__}")


def _is_zero(x: Expr) -> bool:
    return isinstance(x, Value) and not x.constant.value.any()


def replaced(x: Expr, what: Function, by: Function) -> Expr:
    """The expression with one field in place of another."""
    if isinstance(x, Field):
        return Field(by, x.part) if x.function is what else x
    below = x.parts()
    return x.rebuilt([replaced(p, what, by) for p in below]) if below else x


@dataclass(frozen=True)
class Measure:
    """Integration over cells (dx), exterior facets (ds), interior facets (dS) or vertices (dP); with tags, over those of a value.

    tags: (cell, value), or (key, value) for facets, or (node, value) for vertices; tag: one value or several.
    """

    kind: str
    tags: DataFrame | None = None
    tag: int | tuple[int, ...] | None = None
    degree: int | None = None

    def __call__(self, tag=None, tags: DataFrame | None = None, degree: int | None = None) -> Measure:
        return changed(self, tag=tag if tag is not None else self.tag, tags=tags if tags is not None else self.tags, degree=degree if degree is not None else self.degree)

    def __rmul__(self, integrand) -> Form:
        return Form((Integral(lift(integrand), self),))


dx, ds, dS, dP = (Measure(k) for k in ("cell", "exterior_facet", "interior_facet", "vertex"))


@dataclass(frozen=True, eq=False)
class Integral:
    integrand: Expr
    measure: Measure

    def arguments(self) -> list[FunctionSpace]:
        found = {a.number: a.space for a in leaves(self.integrand) if isinstance(a, Argument)}
        return [found[k] for k in sorted(found)]


@dataclass(frozen=True, eq=False)
class Form:
    """A sum of integrals; rank 2, 1 or 0 by its arguments."""

    integrals: tuple[Integral, ...]
    mesh_of: Mesh | None = field(default=None)

    def __add__(self, other: Form) -> Form:
        if other == 0:
            return self
        if self.rank != other.rank:
            raise ValueError("forms of different rank can't be added")
        return Form(self.integrals + other.integrals, self.mesh_of or other.mesh_of)

    __radd__ = __add__

    def __neg__(self) -> Form:
        return Form(tuple(Integral(-i.integrand, i.measure) for i in self.integrals), self.mesh_of)

    def __sub__(self, other: Form) -> Form:
        return self + (-other)

    def on(self, mesh: Mesh) -> Form:
        """The form bound to a mesh, needed where it has neither arguments nor fields."""
        return Form(self.integrals, mesh)

    @property
    def rank(self) -> int:
        return max(len(i.arguments()) for i in self.integrals)

    @property
    def function_spaces(self) -> list[FunctionSpace]:
        return max((i.arguments() for i in self.integrals), key=len)

    @property
    def coefficients(self) -> list[Function]:
        out: list[Function] = []
        for i in self.integrals:
            out += [x.function for x in leaves(i.integrand) if isinstance(x, Field) and not any(x.function is f for f in out)]
        return out

    @property
    def constants(self) -> list[Constant]:
        return [x.constant for i in self.integrals for x in leaves(i.integrand) if isinstance(x, Value)]

    @property
    def mesh(self) -> Mesh:
        if self.mesh_of is not None:
            return self.mesh_of
        for i in self.integrals:
            for x in leaves(i.integrand):
                if isinstance(x, (Argument, Field)):
                    return x.space.mesh
        raise ValueError("bind the form to a mesh with on()")

    def replaced(self, what: Function, by: Function) -> Form:
        return Form(tuple(Integral(replaced(i.integrand, what, by), i.measure) for i in self.integrals), self.mesh_of)

    def derivative(self, u: Function, du: Argument | None = None) -> Form:
        """The Gateaux derivative with respect to a field; by default toward the next argument."""
        du = du or Argument(u.space, self.rank)
        some = [Integral(derivative(i.integrand, u, du), i.measure) for i in self.integrals]
        return Form(tuple(i for i in some if not _is_zero(i.integrand)), self.mesh_of)


def derivative_block(forms: list[Form], fields: list[Function], directions: list[Argument] | None = None) -> list[list[Form | None]]:
    """The derivative of each form with respect to each field, None where it doesn't depend on it."""
    out = []
    for form in forms:
        row = []
        for k, u in enumerate(fields):
            d = form.derivative(u, directions[k] if directions else None)
            row.append(d if d.integrals else None)
        out.append(row)
    return out


def extract_function_spaces(forms: list[list[Form | None]], index: int = 0) -> list[FunctionSpace | None]:
    """The spaces of the rows (index 0) or columns (1) of an array of forms."""
    lines = forms if index == 0 else [list(c) for c in zip(*forms, strict=True)]
    out = []
    for line in lines:
        found = [f.function_spaces[index] for f in line if f is not None]
        if any(s is not found[0] for s in found):
            raise ValueError("the forms of a row or column have different spaces")
        out.append(found[0] if found else None)
    return out


@dataclass
class _View:
    """What a kernel knows of one side of its points."""

    cell: str
    gdim: int
    points: np.ndarray  # on the reference cell
    nodes: np.ndarray
    vertices: np.ndarray
    fields: list[np.ndarray]
    normal: np.ndarray | None = None
    known: dict = field(default_factory=dict)

    def geometry(self, map_: CoordinateElement) -> None:
        table = map_.tabulate(self.points, 1)
        self.x = np.einsum("qn,cnd->cqd", table[0], self.nodes)
        self.j = np.einsum("tqn,cnd->cqdt", table[1:], self.nodes) if len(table) > 1 else np.zeros((*self.x.shape, 0))
        self.k = map_.inverse(self.j) if self.j.shape[-1] else np.zeros((*self.x.shape[:2], 0, self.gdim))

    def basis(self, e: FiniteElement) -> tuple[np.ndarray, np.ndarray]:
        """(values, gradients) of the blocked basis: (cells or 1, points, dofs, *shape) and with gdim last; of vector elements curl or divergence instead."""
        if e not in self.known:
            if e.family in ("N1curl", "RT"):
                self.known[e] = sp.whitney(e, self.points, np.broadcast_to(self.k[:, :1], (len(self.nodes), len(self.points), *self.k.shape[2:])), self.vertices)
            else:
                table = e.tabulate(self.points, 1)
                gradient = np.einsum("tqn,cqtd->cqnd", table[1:], self.k)
                if e.shape:
                    wide = [sp.basis_values(e, g.reshape(-1, g.shape[-1])).reshape(*g.shape[:2], -1, *e.shape) for g in np.moveaxis(gradient, -1, 0)]
                    gradient = np.stack(wide, axis=-1)
                self.known[e] = (sp.basis_values(e, table[0])[None], gradient)
        return self.known[e]


class _Kernel:
    """Evaluates an expression on a batch; views: one side's, or both sides'."""

    def __init__(self, views: dict[str, _View], coefficients: list[Function]):
        self.views, self.coefficients = views, coefficients

    def view(self, side: str | None) -> _View:
        if len(self.views) == 1:
            return next(iter(self.views.values()))
        if side is None:
            raise ValueError("on interior facets a value needs a side: x('+'), x('-'), jump(x) or avg(x)")
        return self.views[side]

    def _slot(self, space: FunctionSpace, part: int | None) -> tuple[int, int]:
        """First dof of a part among a cell's dofs, and the number of all."""
        sizes = [p.element.space_dimension for p in space.parts] or [space.element.space_dimension]
        return sum(sizes[: part or 0]) if space.parts else 0, sum(sizes)

    def _argument(self, x: Argument, values: np.ndarray, side: str | None) -> np.ndarray:
        first, total = self._slot(x.space, x.part)
        n = values.shape[2]
        sides = len(self.views)
        at = first + (total if side == "-" else 0)
        if total * sides != n:
            wide = np.zeros((*values.shape[:2], total * sides, *values.shape[3:]))
            wide[:, :, at : at + n] = values
            values = wide
        return np.expand_dims(values, 3 if x.number == 0 else 2)

    def _field(self, x: Field, values: np.ndarray, view: _View) -> np.ndarray:
        k = next(k for k, f in enumerate(self.coefficients) if f is x.function)
        first, _ = self._slot(x.space, x.part)
        w = view.fields[k][:, first : first + values.shape[2]]
        values = np.broadcast_to(values, (len(w), *values.shape[1:]))
        found = np.einsum("cqn...,cn->cq...", values, w)
        return found[:, :, None, None]

    def terminal(self, x: Expr, side: str | None, derived: bool) -> np.ndarray:
        view = self.view(side)
        values = view.basis(x.element)[1 if derived else 0]
        return self._argument(x, values, side) if isinstance(x, Argument) else self._field(x, values, view)

    def at(self, x: Expr, side: str | None = None) -> np.ndarray:
        if isinstance(x, Side):
            return self.at(x.of, x.side)
        if isinstance(x, Value):
            return x.constant.value[None, None, None, None]
        if isinstance(x, Position):
            return (self.view(side) if side else next(iter(self.views.values()))).x[:, :, None, None]
        if isinstance(x, Normal):
            return self.view(side).normal[:, :, None, None]
        if isinstance(x, Diameter):
            v = self.view(side)
            corner = v.nodes[:, : meta.N_VERTICES[v.cell]]
            return np.sqrt(((corner[:, :, None] - corner[:, None]) ** 2).sum(axis=-1)).max(axis=(1, 2))[:, None, None, None]
        if isinstance(x, (Argument, Field)):
            return self.terminal(x, side, False)
        if isinstance(x, (Grad, Div, Curl)):
            return self._derived(x, side)
        if isinstance(x, Sum):
            return self.at(x.a, side) + self.at(x.b, side)
        if isinstance(x, (Product, Inner, Dot, Outer)):
            return self._product(x, self.at(x.a, side), self.at(x.b, side))
        if isinstance(x, Power):
            return self.at(x.of, side) ** x.n
        if isinstance(x, Index):
            return self.at(x.of, side)[(Ellipsis, *x.index)] if len(x.index) == self.at(x.of, side).ndim - 4 else self.at(x.of, side)[(slice(None),) * 4 + x.index]
        return type(x).apply(self.at(x.of, side))

    def _derived(self, x: Expr, side: str | None) -> np.ndarray:
        of, side = (x.of.of, x.of.side) if isinstance(x.of, Side) else (x.of, side)
        if isinstance(of, Sum):
            return self.at(type(x)(of.a), side) + self.at(type(x)(of.b), side)
        if isinstance(of, Product) and isinstance(of.a, Value):
            return self._product(x, self.at(of.a, side), self.at(type(x)(of.b), side), Product)
        if isinstance(of, Value):
            return np.zeros((1, 1, 1, 1))
        if isinstance(of, Index) and isinstance(x, Grad):
            return self.at(Index(Grad(of.of), of.index), side)
        if isinstance(of, Position):
            n = self.view(side or next(iter(self.views))).gdim
            return np.eye(n)[None, None, None, None] if isinstance(x, Grad) else np.full((1, 1, 1, 1), float(n))
        if not isinstance(of, (Argument, Field)):
            raise ValueError("derivatives are of arguments, fields, their sums and multiples")
        vector = of.element.family in ("N1curl", "RT")
        if vector and isinstance(x, Curl if of.element.family == "N1curl" else Div):
            return self.terminal(of, side, True)
        if vector:
            raise ValueError(f"no {type(x).__name__.lower()} of {of.element.family}")
        found = self.terminal(of, side, True)
        if isinstance(x, Grad):
            return found
        if isinstance(x, Div):
            return np.trace(found, axis1=-2, axis2=-1)
        if found.shape[-1] == 2:
            return found[..., 1, 0] - found[..., 0, 1]
        return np.stack([found[..., 2, 1] - found[..., 1, 2], found[..., 0, 2] - found[..., 2, 0], found[..., 1, 0] - found[..., 0, 1]], axis=-1)

    @staticmethod
    def _product(x: Expr, a: np.ndarray, b: np.ndarray, kind: type | None = None) -> np.ndarray:
        kind, ra, rb = kind or type(x), a.ndim - 4, b.ndim - 4
        if kind is Inner:
            if ra != rb:
                raise ValueError("inner() needs equal shapes")
            return np.einsum("...i,...i->...", a.reshape(*a.shape[:4], -1), b.reshape(*b.shape[:4], -1))
        if kind is Dot and ra and rb:
            s, t = "ijk"[:ra], "ijk"[ra - 1] + "lmn"[: rb - 1]
            return np.einsum(f"...{s},...{t}->...{s[:-1]}{t[1:]}", a, b)
        if kind is Outer:
            return a.reshape(*a.shape, *([1] * rb)) * b.reshape(*b.shape[:4], *([1] * ra), *b.shape[4:])
        if ra and rb:
            raise ValueError("a product needs a number on one side; use inner(), dot() or outer()")
        a, b = a.reshape(*a.shape, *([1] * rb)), b.reshape(*b.shape, *([1] * ra))
        return a * b


def integration_domain(kind: str, mesh: Mesh, tags: DataFrame | None = None, tag: int | tuple[int, ...] | None = None) -> DataFrame:
    """Where to integrate: (cell); (cell, local) of facets of one cell or of vertices, a first cell each; (cell0, local0, cell1, local1) of facets of two.

    Tagged facets that aren't of the kind asked for are left out.
    """
    some = None
    if tag is not None:
        if tags is None:
            raise ValueError("a tag needs tags")
        some = tags.where(F.col("value").isin(*(tag if isinstance(tag, tuple) else (tag,)))).drop("value").distinct()
    if kind == "cell":
        every = mesh.cells.select("cell")
        return every if some is None else every.join(some, "cell", "left_semi")
    if kind == "vertex":
        every = mesh.cells.select("cell", F.posexplode("vertices").alias("local", "node")).groupBy("node").agg(F.min(F.struct("cell", "local")).alias("f"))
        every = every if some is None else every.join(some, "node", "left_semi")
        return every.select("f.cell", "f.local")
    every = topology.exterior_facets(mesh) if kind == "exterior_facet" else topology.interior_facets(mesh)
    every = every if some is None else every.join(some, "key", "left_semi")
    return every.drop("key")


def _packed(mesh: Mesh, form_fields: list[Function], spaces: list[FunctionSpace], cells: DataFrame) -> DataFrame:
    """(cell, vertices, x, d0, d1, w0, w1, ...): all that a kernel needs of the given cells."""
    out = sp.placed(mesh).join(cells, "cell", "left_semi") if cells is not None else sp.placed(mesh)
    for k, s in enumerate(spaces):
        out = out.join(s.unrolled().withColumnRenamed("dofs", f"d{k}"), "cell")
    for k, f in enumerate(form_fields):
        out = out.join(f.packed().withColumnRenamed("w", f"w{k}"), "cell")
    return out


def _groups(cell: str, batch: pa.RecordBatch, sides: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[int, tuple[int, ...]]]]]:
    """Rows of a batch whose facets lie alike in their cells: local numbers and orders of vertices."""
    dim = meta.DIM[cell]
    columns = []
    for s in sides:
        local = batch.column(batch.schema.names.index(f"local{s}")).to_numpy()
        vertices = batches_of(batch, f"vertices{s}")
        order = np.zeros((len(local), 4), np.int64)
        for k in np.unique(local):
            own = local == k
            at = list(meta.entity_vertices(cell, dim - 1)[k])
            found = entity_order(meta.facet_type(cell, int(k)), vertices[own][:, at])
            order[own, : found.shape[1]] = found
            order[own, found.shape[1] :] = -1
        columns += [local[:, None], order]
    table = np.concatenate(columns, axis=1)
    kinds, which = np.unique(table, axis=0, return_inverse=True)
    for k, kind in enumerate(kinds):
        yield np.flatnonzero(which.ravel() == k), [(int(kind[5 * s]), tuple(int(x) for x in kind[5 * s + 1 : 5 * s + 5] if x >= 0)) for s in range(len(sides))]


def integral_entries(integral: Integral, mesh: Mesh) -> DataFrame:
    """The entries (i, j, v), (i, v) or (v) of an integral."""
    e, measure, kind_of = integral.integrand, integral.measure, integral.measure.kind
    spaces, rank = integral.arguments(), len(integral.arguments())
    coefficients = Form((integral,)).coefficients
    map_ = CoordinateElement(mesh.cell_type, mesh.degree)
    q = measure.degree if measure.degree is not None else degree(e) + (0 if map_.is_affine else 2 * map_.degree)
    domain = integration_domain(measure.kind, mesh, measure.tags, measure.tag)
    two = measure.kind == "interior_facet"
    sides = ["0", "1"] if two else [""]
    packed = _packed(mesh, coefficients, spaces, domain.select("cell") if measure.kind == "cell" and measure.tag is not None else None)
    if two:
        rows = domain
        for s in sides:
            rows = rows.join(packed.select(*(F.col(c).alias(f"{c}{s}") for c in packed.columns)), f"cell{s}")
    else:
        rows = packed if measure.kind == "cell" else domain.join(packed, "cell")
    names, cell, gdim, dim = ["i", "j"][:rank] + ["v"], mesh.cell_type, mesh.gdim, meta.DIM[mesh.cell_type]
    numbers = [sum(p.element.space_dimension for p in s.parts) if s.parts else s.element.space_dimension for s in spaces]
    per_row = max(1, int(np.prod([n * len(sides) for n in numbers])) * 8)
    fields, n_spaces = len(coefficients), len(spaces)
    shells = [Function(FunctionSpace(None, f.space.element, None, tuple(FunctionSpace(None, p.element, None) for p in f.space.parts)), None) for f in coefficients]
    e = _without_tables(e, coefficients, shells)

    def tensors(batch: pa.RecordBatch, points: list[np.ndarray], weights: np.ndarray, axes: list[np.ndarray] | None, locals_: list[int]) -> Iterator[pa.RecordBatch]:
        views = {}
        for k, s in enumerate(sides):
            nodes = batches_of(batch, f"x{s}").reshape(batch.num_rows, -1, 3)[:, :, :gdim]
            view = _View(cell, gdim, points[k], nodes, batches_of(batch, f"vertices{s}"), [batches_of(batch, f"w{c}{s}") for c in range(fields)])
            view.geometry(map_)
            if axes is not None and dim:
                n = np.einsum("cqtd,t->cqd", view.k, outward(cell, locals_[k]))
                view.normal = n / np.linalg.norm(n, axis=-1, keepdims=True)
            views["+-"[k]] = view
        kernel, first = _Kernel(views, shells), views["+"]
        if axes is None:
            scale = np.abs(map_.determinant(first.j)) if dim and kind_of == "cell" else np.ones(first.x.shape[:2])
        else:
            along = first.j @ axes[0]
            scale = np.sqrt(np.abs(np.linalg.det(np.swapaxes(along, -1, -2) @ along))) if along.shape[-1] else np.ones(first.x.shape[:2])
        value = kernel.at(e)
        if value.ndim != 4:
            raise ValueError("an integrand is a number")
        found = np.einsum("cqij,cq->cij", np.broadcast_to(value, (batch.num_rows, len(weights), *value.shape[2:])), scale * weights)
        shape = [n * len(sides) for n in numbers] + [1] * (2 - rank)
        found = np.broadcast_to(found, (batch.num_rows, *shape))
        dofs = [np.concatenate([batches_of(batch, f"d{k}{s}") for s in sides], axis=1) for k in range(n_spaces)]
        out = [pa.array(np.ascontiguousarray(found).ravel())]
        if rank == 2:
            out = [pa.array(np.repeat(dofs[0], shape[1], axis=1).ravel()), pa.array(np.tile(dofs[1], (1, shape[0])).ravel()), *out]
        elif rank == 1:
            out = [pa.array(dofs[0].ravel()), *out]
        else:
            out = [pa.array([float(found.sum())])]
        yield pa.RecordBatch.from_arrays(out, names=names)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            most = max(1, KERNEL_NUMBERS // per_row)
            for k in range(0, whole.num_rows, most):
                batch = whole.slice(k, most)
                if kind_of == "cell":
                    points, weights = quadrature(cell, q)
                    yield from tensors(batch, [points], weights, None, [])
                elif kind_of == "vertex":
                    local = batch.column(batch.schema.names.index("local")).to_numpy()
                    for v in np.unique(local):
                        yield from tensors(batch.filter(pa.array(local == v)), [np.array([_corner(cell, int(v))])], np.ones(1), None, [])
                else:
                    for own, lie in _groups(cell, batch, sides):
                        kind = meta.facet_type(cell, lie[0][0])
                        x, weights = quadrature(kind, q)
                        placed = [facet_points(cell, local, order, x) for local, order in lie]
                        yield from tensors(batch.take(pa.array(own)), [p for p, _ in placed], weights, [a for _, a in placed], [local for local, _ in lie])

    schema = ", ".join([*(f"{c} bigint" for c in names[:-1]), "v double"])
    return rows.mapInArrow(entries, schema)


def _corner(cell: str, v: int) -> tuple[float, ...]:
    from meshwright.functions.elements import CORNERS

    return CORNERS[cell][v]


def _without_tables(x: Expr, coefficients: list[Function], shells: list[Function]) -> Expr:
    """The expression with elements in place of spaces, which is what goes to executors."""
    if isinstance(x, Field):
        return Field(next(s for f, s in zip(coefficients, shells, strict=True) if f is x.function), x.part)
    if isinstance(x, Argument):
        shell = FunctionSpace(None, x.space.element, None, tuple(FunctionSpace(None, p.element, None) for p in x.space.parts))
        return Argument(shell, x.number, x.part)
    below = x.parts()
    return x.rebuilt([_without_tables(p, coefficients, shells) for p in below]) if below else x


def entries(form: Form) -> DataFrame:
    """All entries of a form, not yet added up."""
    out = None
    for i in form.integrals:
        if len(i.arguments()) != form.rank:
            raise ValueError("the integrals of a form have different arguments")
        rows = integral_entries(i, form.mesh)
        out = rows if out is None else out.unionByName(rows)
    return out


def assemble(form: Form, bc: DataFrame | None = None, diagonal: float = 1.0) -> DataFrame:
    """A matrix (i, j, v), a vector (i, v), or a row with the total v."""
    from meshwright.operators import assembly

    rows = entries(form)
    if form.rank == 2:
        return assembly.assemble_matrix(rows, bc, diagonal)
    return assembly.assemble_vector(rows) if form.rank == 1 else rows.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def sparsity(form: Form) -> DataFrame:
    """(i, j) of every two dofs that share a cell, or a facet's two cells, of one of the form's integrals."""
    out = None
    for i in form.integrals:
        rows, columns = i.arguments()
        domain = integration_domain(i.measure.kind, form.mesh, i.measure.tags, i.measure.tag)
        if i.measure.kind == "interior_facet":
            domain = domain.select(F.struct("cell0", "local0").alias("at"), F.explode(F.array("cell0", "cell1")).alias("cell"))
        else:
            domain = domain.select(F.struct("cell").alias("at"), "cell")
        a = domain.join(rows.unrolled(), "cell").select("at", F.explode("dofs").alias("i"))
        b = domain.join(columns.unrolled(), "cell").select("at", F.explode("dofs").alias("j"))
        found = a.join(b, "at").select("i", "j")
        out = found if out is None else out.union(found)
    return out.distinct()


def pack_coefficients(form: Form) -> list[DataFrame]:
    """(cell, w) for each field of a form."""
    return [f.packed() for f in form.coefficients]


def tabulate(expression: Expr, points: np.ndarray, mesh: Mesh, cells: DataFrame | None = None) -> DataFrame:
    """(cell, v): an expression without arguments at reference points of cells, point by point."""
    expression = lift(expression)
    coefficients = Form((Integral(expression, dx),)).coefficients
    shells = [Function(FunctionSpace(None, f.space.element, None, tuple(FunctionSpace(None, p.element, None) for p in f.space.parts)), None) for f in coefficients]
    e, cell, gdim, n = _without_tables(expression, coefficients, shells), mesh.cell_type, mesh.gdim, len(coefficients)
    map_, at = CoordinateElement(mesh.cell_type, mesh.degree), np.asarray(points, float).reshape(-1, meta.DIM[mesh.cell_type])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batches_of(batch, "x").reshape(batch.num_rows, -1, 3)[:, :, :gdim]
            view = _View(cell, gdim, at, nodes, batches_of(batch, "vertices"), [batches_of(batch, f"w{k}") for k in range(n)])
            view.geometry(map_)
            found = _Kernel({"+": view}, shells).at(e)[:, :, 0, 0]
            found = np.ascontiguousarray(np.broadcast_to(found, (batch.num_rows, len(at), *found.shape[2:]))).reshape(batch.num_rows, -1)
            ends = pa.array(np.arange(batch.num_rows + 1) * found.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("cell")), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=["cell", "v"])

    return _packed(mesh, coefficients, [], cells).mapInArrow(values, "cell bigint, v array<double>")


def interpolate_expression(space: FunctionSpace, expression: Expr) -> Function:
    """An expression's field in a space of point values."""
    found = tabulate(expression, space.element.points, space.mesh).join(space.unrolled(), "cell")
    each = found.select(F.explode(F.arrays_zip(F.col("dofs").alias("i"), F.col("v").alias("v"))).alias("e"))
    return Function(space, each.groupBy("e.i").agg(F.max("e.v").alias("v")))


def solve(a: Form, rhs: Form, bc: DataFrame, rtol: float = 1e-10, symmetric: bool = True) -> tuple[Function, int]:
    """The field u with a(u, v) = rhs(v) and u = g at constrained dofs: assemble, lift, set, iterate."""
    from meshwright.operators import assembly, solvers
    from meshwright.operators.numbering import reliable

    full = reliable(assemble(a))
    b = assembly.apply_lifting(assemble(rhs), full, bc)
    b = reliable(assembly.set_bc(b, bc))
    matrix = reliable(assembly.assemble_matrix(full, bc))
    method = solvers.conjugate_gradients if symmetric else solvers.stabilised_bicg
    x, n = method(matrix, b, rtol)
    return Function(a.function_spaces[1], x), n


def solve_nonlinear(residual: Form, u: Function, bc: DataFrame, rtol: float = 1e-9, atol: float = 1e-10, most: int = 50, relaxation: float = 1.0, linear: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[Function, int]:
    """Newton's method for residual(u; v) = 0 with u = g at constrained dofs; (field, steps).

    linear(matrix, b) solves a step; by default restarted least residuals.
    """
    from meshwright.operators import assembly, solvers
    from meshwright.operators.numbering import reliable

    g = bc.select(F.col("dof").alias("i"), F.col("g").alias("v"))
    values = reliable(u.values.join(g.select("i"), "i", "left_anti").unionByName(g))
    zero = bc.select("dof", F.lit(0.0).alias("g"))
    jacobian, first = residual.derivative(u), None
    for n in range(most + 1):
        now = Function(u.space, values)
        b = reliable(assembly.set_bc(assemble(residual.replaced(u, now)), zero))
        size = b.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0
        first = size if first is None else first
        if size < atol or (n and size < rtol * first):
            return now, n
        matrix = reliable(assemble(jacobian.replaced(u, now), zero))
        step = linear(matrix, b) if linear else solvers.gmres(matrix, b, 1e-10)[0]
        values = reliable(values.unionByName(step.select("i", (F.col("v") * -relaxation).alias("v"))).groupBy("i").agg(F.sum("v").alias("v")))
    raise ArithmeticError(f"Newton's method didn't converge in {most} steps")


def assemble_residual(residual: Form, u: Function, bc: DataFrame) -> DataFrame:
    """F(u) with u - g at constrained dofs, so that a Newton step brings these to g."""
    from meshwright.operators import assembly

    at = bc.join(u.values.select(F.col("i").alias("dof"), F.col("v").alias("__u")), "dof", "left")
    return assembly.set_bc(assemble(residual), at.select("dof", (F.coalesce("__u", F.lit(0.0)) - F.col("g")).alias("g")))


def assemble_jacobian(residual: Form, u: Function, bc: DataFrame) -> DataFrame:
    """The derivative of F at u, with rows and columns of constrained dofs cleared but for the diagonal."""
    return assemble(residual.derivative(u), bc)


def assign(x: DataFrame, fields: list[Function]) -> list[Function]:
    """The fields with the values of a vector that holds them one after another."""
    from meshwright.operators.sparse import split_vector

    parts = split_vector(x, [f.space.size for f in fields])
    return [Function(f.space, p) for f, p in zip(fields, parts, strict=True)]


def joined(fields: list[Function]) -> DataFrame:
    """One vector of the fields' values, one after another."""
    from meshwright.operators.sparse import block_vector

    return block_vector([f.values for f in fields], [f.space.size for f in fields])


def assemble_blocks(forms: list[list[Form | None]]) -> list[list[DataFrame | None]]:
    """The matrices of an array of forms, None where there is none."""
    return [[assemble(f) if f is not None else None for f in line] for line in forms]


def solve_blocks(forms: list[list[Form | None]], rhs: list[Form], bcs: list[DataFrame | None], linear: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[Function]:
    """The fields of a system of forms; bcs: conditions (dof, g) of each space by its own numbers, or None."""
    from meshwright.operators import assembly, solvers, sparse
    from meshwright.operators.numbering import reliable

    columns = extract_function_spaces(forms, 1)
    sizes = [s.size for s in extract_function_spaces(forms, 0)]
    full = reliable(sparse.block_system(assemble_blocks(forms), sizes, [s.size for s in columns]))
    b, bc, first = sparse.block_vector([assemble(f) for f in rhs], sizes), None, 0
    for own, s in zip(bcs, columns, strict=True):
        if own is not None:
            moved = own.select((F.col("dof") + first).alias("dof"), "g")
            bc = moved if bc is None else bc.unionByName(moved)
        first += s.size
    if bc is not None:
        b = assembly.set_bc(assembly.apply_lifting(b, full, bc), bc)
        full = assembly.assemble_matrix(full, bc)
    full, b = reliable(full), reliable(b)
    x = linear(full, b) if linear else solvers.gmres(full, b)[0]
    return assign(x, [Function(s, zeros_of(s)) for s in columns])


def zeros_of(space: FunctionSpace) -> DataFrame:
    return sp.zeros(space)
