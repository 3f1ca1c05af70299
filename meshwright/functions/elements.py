"""Reference elements and quadrature, as numpy tables that are made on the driver and go to executors with a plan.

An element's basis is found from its dual points: monomials that span its
space are evaluated there, and the inverse of that matrix gives the basis.
Points of equal distance are used for every degree.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from itertools import permutations, product
from math import factorial

import numpy as np

from meshwright.functions import cells as meta

# Corners of the reference cells.
CORNERS = {
    "point": [()],
    "interval": [(0,), (1,)],
    "triangle": [(0, 0), (1, 0), (0, 1)],
    "quadrilateral": [(0, 0), (1, 0), (0, 1), (1, 1)],
    "tetrahedron": [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)],
    "pyramid": [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1)],
    "prism": [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1)],
    "hexahedron": [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1)],
}
#: The vertices that a cell's axes lead to from its first one.
AXES = {"point": (), "interval": (1,), "triangle": (1, 2), "quadrilateral": (1, 2), "tetrahedron": (1, 2, 3), "prism": (1, 2, 3), "hexahedron": (1, 2, 4), "pyramid": (1, 2, 4)}
FAMILIES = {"Lagrange": "Lagrange", "P": "Lagrange", "CG": "Lagrange", "Q": "Lagrange", "DG": "DG", "DP": "DG", "Discontinuous Lagrange": "DG", "N1curl": "N1curl", "RT": "RT", "Real": "Real", "R": "Real", "Quadrature": "Quadrature"}


def corners(cell: str) -> np.ndarray:
    return np.array(CORNERS[cell], float).reshape(len(CORNERS[cell]), meta.DIM[cell])


@lru_cache(maxsize=None)
def quadrature(cell: str, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, weights) exact for polynomials of a degree; simplices by Gauss-Jacobi points of a collapsed cube, pyramids too."""
    n = degree // 2 + 1
    if cell == "point":
        return np.zeros((1, 0)), np.ones(1)

    def line(alpha: int) -> tuple[np.ndarray, np.ndarray]:
        """Gauss points on [0, 1] for the weight (1 - t)**alpha, from the eigenvalues of the Jacobi matrix."""
        k = np.arange(n, dtype=float)
        total = 2 * k + alpha
        a = np.where(total * (total + 2) == 0, -alpha / 2 if alpha else 0.0, -(alpha**2) / np.where(total * (total + 2) == 0, 1, total * (total + 2)))
        a[0] = -alpha / (alpha + 2)
        k = np.arange(1, n, dtype=float)
        total = 2 * k + alpha
        b = np.sqrt(4 * k * k * (k + alpha) ** 2 / (total**2 * (total + 1) * (total - 1)))
        values, vectors = np.linalg.eigh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
        return (values + 1) / 2, vectors[0] ** 2 / (alpha + 1)

    def tensor(rules: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        points = np.array([p[::-1] for p in product(*(r[0] for r in rules[::-1]))])
        return points, np.array([np.prod(w) for w in product(*(r[1] for r in rules[::-1]))])

    if cell in ("interval", "quadrilateral", "hexahedron"):
        return tensor([line(0)] * meta.DIM[cell])
    if cell == "prism":
        (p, w), (z, v) = quadrature("triangle", degree), line(0)
        return np.array([[*x, t] for t in z for x in p]), np.array([a * b for b in v for a in w])
    if cell == "pyramid":
        points, weights = tensor([line(0), line(0), line(2)])
        rest = 1 - points[:, 2]
        return np.stack([points[:, 0] * rest, points[:, 1] * rest, points[:, 2]], axis=1), weights
    points, weights = tensor([line(meta.DIM[cell] - 1 - k) for k in range(meta.DIM[cell])])
    out, rest = np.empty_like(points), np.ones(len(points))
    for k in range(meta.DIM[cell]):
        out[:, k] = points[:, k] * rest
        rest = rest * (1 - points[:, k])
    return out, weights


def _exponents(cell: str, p: int) -> list[tuple[int, ...]]:
    """Of the monomials that span a cell's polynomials of degree p."""
    every = product(range(p + 1), repeat=meta.DIM[cell])
    if cell in ("triangle", "tetrahedron", "interval", "pyramid"):
        return [e for e in every if sum(e) <= p]
    return [e for e in every if cell != "prism" or e[0] + e[1] <= p]


def _span(cell: str, p: int, x: np.ndarray, d: tuple[int, ...]) -> np.ndarray:
    """A derivative of the spanning functions at points: (points, functions)."""
    out = []
    for e in _exponents(cell, p):
        value = np.ones(len(x))
        for k, (a, b) in enumerate(zip(e, d, strict=True)):
            value = value * (0.0 if b > a else factorial(a) / factorial(a - b) * x[:, k] ** (a - b))
        out.append(value)
    if cell == "pyramid" and p == 1:  # the function that is bilinear on the base
        rest = np.where(x[:, 2] == 1, 1.0, 1 - x[:, 2])
        u, v = x[:, 0], x[:, 1]
        known = {(0, 0, 0): u * v / rest, (1, 0, 0): v / rest, (0, 1, 0): u / rest, (0, 0, 1): u * v / rest**2}
        out.append(known[d])
    return np.stack(out, axis=1)


def lattice(cell: str, p: int) -> np.ndarray:
    """The inner points of a cell's lattice of degree p, in its own coordinates."""
    if cell == "point":
        return np.zeros((1, 0))
    inner = [tuple(e[::-1]) for e in product(range(1, p), repeat=meta.DIM[cell])]
    if cell in ("triangle", "tetrahedron"):
        inner = [e for e in inner if sum(e) < p]
    if cell == "prism":
        inner = [e for e in inner if e[0] + e[1] < p]
    if cell == "pyramid":
        inner = []
    return np.array(inner, float).reshape(-1, meta.DIM[cell]) / p


def orders(cell: str, p: int) -> dict[str, list[int]]:
    """For each order of an entity's vertices (ranks as digits), where its lattice points stand among those seen from the sorted vertices."""
    points, n = lattice(cell, p), meta.N_VERTICES[cell]
    own, out = corners(cell), {}
    for ranks in permutations(range(n)):
        if cell == "quadrilateral":
            least = ranks.index(0)
            beside = sorted(((least ^ 1), (least ^ 2)), key=lambda v: ranks[v])
            place = {least: own[0], beside[0]: own[1], beside[1]: own[2], least ^ 3: own[3]}
        else:
            place = {v: own[r] for v, r in enumerate(ranks)}
        seen = np.stack([place[0] + sum((t * (place[a] - place[0]) for t, a in zip(q, AXES[cell], strict=True)), np.zeros(meta.DIM[cell])) for q in points]) if len(points) else points
        out["".join(map(str, ranks))] = [int(np.argmin(np.abs(points - q).sum(axis=1))) for q in seen]
    return out


@dataclass(frozen=True)
class FiniteElement:
    """A scalar element, blocked by `shape` for vectors and tensors.

    entity_dofs[dim][entity] are its dofs there; symmetric tensors keep the
    components on and above the diagonal.
    """

    family: str
    cell: str
    degree: int
    shape: tuple[int, ...] = ()
    symmetry: bool = False
    points: np.ndarray = field(init=False, compare=False, repr=False)
    entity_dofs: tuple[tuple[tuple[int, ...], ...], ...] = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        if self.family not in ("Lagrange", "DG", "N1curl", "RT", "Real", "Quadrature"):
            raise ValueError(f"unknown family {self.family}")
        if self.family == "Lagrange" and self.degree < 1:
            raise ValueError("continuous elements start at degree 1")
        if self.family in ("N1curl", "RT") and (self.degree != 1 or not meta.is_simplex(self.cell) or meta.DIM[self.cell] < 2):
            raise ValueError(f"{self.family} is there for degree 1 on triangles and tetrahedra")
        if self.cell == "pyramid" and self.degree > 1 and self.family in ("Lagrange", "DG"):
            raise ValueError("pyramids have elements of degree 0 and 1 only")
        if self.symmetry and (len(self.shape) != 2 or self.shape[0] != self.shape[1]):
            raise ValueError("symmetry is for square tensors")
        dim, at, own = meta.DIM[self.cell], [], []
        count = 0
        for d in range(dim + 1):
            level = []
            for i, v in enumerate(meta.entity_vertices(self.cell, d)):
                kind = meta.entity_type(self.cell, d, i)
                if self.family in ("Lagrange", "DG") and self.degree > 0:
                    x = corners(self.cell)[list(v)]
                    found = [x[0] + sum((t * (x[a] - x[0]) for t, a in zip(q, AXES[kind], strict=True)), np.zeros(dim)) for q in lattice(kind, self.degree)]
                elif self.family in ("N1curl", "RT"):
                    found = [corners(self.cell)[list(v)].mean(axis=0)] if d == (1 if self.family == "N1curl" else dim - 1) else []
                elif self.family == "Quadrature":
                    found = list(quadrature(self.cell, self.degree)[0]) if d == dim else []
                else:
                    found = [corners(self.cell).mean(axis=0)] if d == dim else []
                at += found
                level.append(tuple(range(count, count + len(found))))
                count += len(found)
            own.append(tuple(level))
        if self.family == "DG":  # all dofs belong to the cell
            own = [tuple(() for _ in level) for level in own[:-1]] + [(tuple(range(count)),)]
        object.__setattr__(self, "points", np.array(at).reshape(count, dim))
        object.__setattr__(self, "entity_dofs", tuple(own))

    @property
    def size(self) -> int:
        """Of the scalar element."""
        return len(self.points)

    @property
    def block_size(self) -> int:
        if self.symmetry:
            return self.shape[0] * (self.shape[0] + 1) // 2
        return int(np.prod(self.shape, dtype=int))

    @property
    def value_shape(self) -> tuple[int, ...]:
        return (meta.DIM[self.cell],) if self.family in ("N1curl", "RT") else self.shape

    @property
    def space_dimension(self) -> int:
        return self.size * self.block_size

    @property
    def is_cellwise(self) -> bool:
        """Whether it has one value a cell."""
        return self.family == "Real" or (self.family == "DG" and self.degree == 0)

    def entity_closure_dofs(self, dim: int, entity: int) -> list[int]:
        """The dofs of an entity and of all entities in it."""
        if self.family == "DG" and dim < meta.DIM[self.cell]:
            return []
        return sorted(k for d in range(dim + 1) for i in meta.sub_entities(self.cell, dim, d)[entity] for k in self.entity_dofs[d][i])

    def tabulate(self, x: np.ndarray, order: int = 0) -> np.ndarray:
        """Basis values at reference points, then their first derivatives: (1 or 1 + dim, points, dofs)."""
        x = np.asarray(x, float).reshape(-1, meta.DIM[self.cell])
        dim = meta.DIM[self.cell]
        kinds = [(0,) * dim, *(tuple(int(k == j) for k in range(dim)) for j in range(dim if order else 0))]
        if self.family in ("N1curl", "RT"):
            raise ValueError("vector elements are evaluated on a cell, by whitney()")
        if self.family == "Quadrature":
            if len(x) != self.size or not np.allclose(x, self.points):
                raise ValueError("a quadrature element has values at its own points only")
            return np.stack([np.eye(self.size), *([np.zeros((self.size, self.size))] * (len(kinds) - 1))])
        p = 0 if self.family == "Real" else self.degree
        weights = np.linalg.inv(_span(self.cell, p, self.points, kinds[0]))
        return np.stack([_span(self.cell, p, x, d) @ weights for d in kinds])

    def interpolation_matrix(self, source: FiniteElement) -> np.ndarray:
        """The values of another element's basis at this one's points."""
        return source.tabulate(self.points)[0]


@dataclass(frozen=True)
class MixedElement:
    """Elements side by side; its dofs are those of the parts one after another."""

    parts: tuple[FiniteElement, ...]

    @property
    def cell(self) -> str:
        return self.parts[0].cell

    @property
    def space_dimension(self) -> int:
        return sum(e.space_dimension for e in self.parts)


def element(family: str, cell: str, degree: int, shape: tuple[int, ...] = (), symmetry: bool = False) -> FiniteElement:
    """An element by any of the usual names of its family."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    return FiniteElement(FAMILIES[family], cell, degree, tuple(shape), symmetry)


def mixed(*parts: FiniteElement) -> MixedElement:
    if len({e.cell for e in parts}) != 1:
        raise ValueError("the parts of a mixed element are on one cell type")
    return MixedElement(tuple(parts))


class CoordinateElement:
    """The map from a reference cell to a cell given by its nodes."""

    def __init__(self, cell: str, degree: int = 1):
        self.cell, self.degree, self.basis = cell, degree, FiniteElement("Lagrange", cell, degree)

    @property
    def is_affine(self) -> bool:
        return self.degree == 1 and meta.is_simplex(self.cell)

    def tabulate(self, x: np.ndarray, order: int = 0) -> np.ndarray:
        return self.basis.tabulate(x, order)

    def push_forward(self, nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Physical points (cells, points, gdim) of reference points in cells (cells, nodes, gdim)."""
        return np.einsum("qn,cnd->cqd", self.tabulate(x)[0], nodes)

    def jacobian(self, nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(cells, points, gdim, tdim)."""
        return np.einsum("tqn,cnd->cqdt", self.tabulate(x, 1)[1:], nodes)

    @staticmethod
    def inverse(jacobian: np.ndarray) -> np.ndarray:
        """The inverse, or the left pseudo-inverse of a manifold's Jacobian."""
        if jacobian.shape[-1] == jacobian.shape[-2]:
            return np.linalg.inv(jacobian)
        t = np.swapaxes(jacobian, -1, -2)
        return np.linalg.inv(t @ jacobian) @ t

    @staticmethod
    def determinant(jacobian: np.ndarray) -> np.ndarray:
        """The factor from reference to physical size, signed for square Jacobians."""
        if jacobian.shape[-1] == jacobian.shape[-2]:
            return np.linalg.det(jacobian)
        return np.sqrt(np.linalg.det(np.swapaxes(jacobian, -1, -2) @ jacobian))

    def pull_back(self, nodes: np.ndarray, points: np.ndarray, tolerance: float = 1e-6, most: int = 15) -> np.ndarray:
        """Reference points (n, tdim) of physical points (n, gdim), each in a cell of its own (n, nodes, gdim); by Newton's method unless affine."""
        n, tdim = len(points), meta.DIM[self.cell]
        if not n:
            return np.zeros((0, tdim))
        x = np.repeat(corners(self.cell).mean(axis=0)[None], n, axis=0)
        for _ in range(1 if self.is_affine else most):
            table = self.tabulate(x, 1)
            at = np.einsum("qn,qnd->qd", table[0], nodes)
            step = np.einsum("qtd,qd->qt", self.inverse(np.einsum("tqn,qnd->qdt", table[1:], nodes)), points - at)
            x = x + step
            if np.abs(step).max() < tolerance:
                return x
        if self.is_affine:
            return x
        raise ArithmeticError(f"Newton's method didn't find reference points in {most} steps")


def entity_order(cell: str, vertices: np.ndarray) -> np.ndarray:
    """Local positions of an entity's vertices as seen from its canonical side: ascending, quadrilaterals from the least by its lesser neighbour."""
    if cell != "quadrilateral":
        return np.argsort(vertices, axis=1, kind="stable")
    least = vertices.argmin(axis=1)
    a, b = least ^ 1, least ^ 2
    rows = np.arange(len(vertices))
    swap = vertices[rows, a] > vertices[rows, b]
    return np.stack([least, np.where(swap, b, a), np.where(swap, a, b), least ^ 3], axis=1)


def facet_points(cell: str, local: int, order: tuple[int, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a facet's reference cell as points of the cell's, with the facet's axes there (tdim, tdim - 1), from its vertices in an order."""
    dim = meta.DIM[cell]
    kind = meta.facet_type(cell, local)
    v = corners(cell)[[meta.entity_vertices(cell, dim - 1)[local][k] for k in order]]
    axes = np.stack([v[a] - v[0] for a in AXES[kind]], axis=1) if AXES[kind] else np.zeros((dim, 0))
    return v[0] + x @ axes.T, axes


def outward(cell: str, local: int) -> np.ndarray:
    """The unit normal of a reference facet, pointing out of the cell."""
    x = corners(cell)
    if meta.DIM[cell] == 1:
        return np.array([-1.0 if local == 0 else 1.0])
    v = x[list(meta.entity_vertices(cell, meta.DIM[cell] - 1)[local])]
    if meta.DIM[cell] == 2:
        t = v[1] - v[0]
        n = np.array([t[1], -t[0]])
    else:
        n = np.cross(v[1] - v[0], v[2] - v[0])
    n = n if n @ (v.mean(axis=0) - x.mean(axis=0)) > 0 else -n
    return n / np.linalg.norm(n)
