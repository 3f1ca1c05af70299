"""Cell types: dimensions, local incidence, permutations and codes of file formats."""

from __future__ import annotations

from itertools import combinations

# Reference cells. Local vertices of each edge and of each two-dimensional face.
DIM = {"point": 0, "interval": 1, "triangle": 2, "quadrilateral": 2, "tetrahedron": 3, "pyramid": 3, "prism": 3, "hexahedron": 3}
N_VERTICES = {"point": 1, "interval": 2, "triangle": 3, "quadrilateral": 4, "tetrahedron": 4, "pyramid": 5, "prism": 6, "hexahedron": 8}
EDGES = {
    "point": [],
    "interval": [(0, 1)],
    "triangle": [(1, 2), (0, 2), (0, 1)],
    "quadrilateral": [(0, 1), (0, 2), (1, 3), (2, 3)],
    "tetrahedron": [(2, 3), (1, 3), (1, 2), (0, 3), (0, 2), (0, 1)],
    "pyramid": [(0, 1), (0, 2), (0, 4), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)],
    "prism": [(0, 1), (0, 2), (0, 3), (1, 2), (1, 4), (2, 5), (3, 4), (3, 5), (4, 5)],
    "hexahedron": [(0, 1), (0, 2), (0, 4), (1, 3), (1, 5), (2, 3), (2, 6), (3, 7), (4, 5), (4, 6), (5, 7), (6, 7)],
}
FACES = {
    "tetrahedron": [(1, 2, 3), (0, 2, 3), (0, 1, 3), (0, 1, 2)],
    "pyramid": [(0, 1, 2, 3), (0, 1, 4), (0, 2, 4), (1, 3, 4), (2, 3, 4)],
    "prism": [(0, 1, 2), (0, 1, 3, 4), (0, 2, 3, 5), (1, 2, 4, 5), (3, 4, 5)],
    "hexahedron": [(0, 1, 2, 3), (0, 1, 4, 5), (0, 2, 4, 6), (1, 3, 5, 7), (2, 3, 6, 7), (4, 5, 6, 7)],
}
#: Codes of the VTK and Gmsh formats for first-order cells, and where the formats' n-th vertex is in ours.
VTK_CODE = {"point": 1, "interval": 3, "triangle": 5, "quadrilateral": 9, "tetrahedron": 10, "hexahedron": 12, "prism": 13, "pyramid": 14}
GMSH_CODE = {"interval": 1, "triangle": 2, "quadrilateral": 3, "tetrahedron": 4, "hexahedron": 5, "prism": 6, "pyramid": 7, "point": 15}
FORMAT_ORDER = {"quadrilateral": (0, 1, 3, 2), "pyramid": (0, 1, 3, 2, 4), "hexahedron": (0, 1, 3, 2, 4, 5, 7, 6)}
XDMF_NAME = {"polyvertex": "point", "polyline": "interval", "triangle": "triangle", "quadrilateral": "quadrilateral", "tetrahedron": "tetrahedron", "hexahedron": "hexahedron", "wedge": "prism", "pyramid": "pyramid"}


def is_simplex(cell: str) -> bool:
    return N_VERTICES[cell] == DIM[cell] + 1


def entity_vertices(cell: str, dim: int) -> list[tuple[int, ...]]:
    """Local vertices of each sub-entity of a dimension."""
    if dim == 0:
        return [(v,) for v in range(N_VERTICES[cell])]
    if dim == DIM[cell]:
        return [tuple(range(N_VERTICES[cell]))]
    return list(EDGES[cell]) if dim == 1 else list(FACES[cell])


def n_entities(cell: str, dim: int) -> int:
    return len(entity_vertices(cell, dim)) if dim <= DIM[cell] else 0


def entity_type(cell: str, dim: int, index: int = 0) -> str:
    n = len(entity_vertices(cell, dim)[index])
    return cell if dim == DIM[cell] else {0: "point", 1: "interval", 2: "triangle" if n == 3 else "quadrilateral"}[dim]


def facet_type(cell: str, index: int = 0) -> str:
    return entity_type(cell, DIM[cell] - 1, index)


def sub_entities(cell: str, dim0: int, dim1: int) -> list[list[int]]:
    """For each entity of dim0 the local numbers of the entities of dim1 in it."""
    inner = [set(v) for v in entity_vertices(cell, dim1)]
    return [[i for i, v in enumerate(inner) if v <= set(outer)] for outer in entity_vertices(cell, dim0)]


def closure(cell: str) -> dict[tuple[int, int], list[set[int]]]:
    """For each (dim, entity) the entities of every dimension in its closure."""
    return {(d, i): [set(sub_entities(cell, d, k)[i]) for k in range(d + 1)] for d in range(DIM[cell] + 1) for i in range(n_entities(cell, d))}


# The edges and faces of second-order cells in the order of each format, by that format's corners.
FORMAT_EDGES = {
    "vtk": {
        "interval": [(0, 1)], "triangle": [(0, 1), (1, 2), (2, 0)], "quadrilateral": [(0, 1), (1, 2), (2, 3), (3, 0)], "tetrahedron": [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)],
        "hexahedron": [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)],
        "prism": [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)],
    },
    "gmsh": {
        "interval": [(0, 1)], "triangle": [(0, 1), (1, 2), (2, 0)], "quadrilateral": [(0, 1), (1, 2), (2, 3), (3, 0)], "tetrahedron": [(0, 1), (1, 2), (2, 0), (3, 0), (2, 3), (1, 3)],
        "hexahedron": [(0, 1), (0, 3), (0, 4), (1, 2), (1, 5), (2, 3), (2, 6), (3, 7), (4, 5), (4, 7), (5, 6), (6, 7)],
        "prism": [(0, 1), (0, 2), (0, 3), (1, 2), (1, 4), (2, 5), (3, 4), (3, 5), (4, 5)],
    },
}
FORMAT_FACES = {
    "vtk": {"quadrilateral": [(0, 1, 2, 3)], "hexahedron": [(0, 4, 7, 3), (1, 2, 6, 5), (0, 1, 5, 4), (3, 7, 6, 2), (0, 3, 2, 1), (4, 5, 6, 7)], "prism": [(0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)]},
    "gmsh": {"quadrilateral": [(0, 1, 2, 3)], "hexahedron": [(0, 3, 2, 1), (0, 1, 5, 4), (0, 4, 7, 3), (1, 2, 6, 5), (2, 3, 7, 6), (4, 5, 6, 7)], "prism": [(0, 1, 4, 3), (0, 2, 5, 3), (1, 2, 5, 4)]},
}
#: Codes of second-order cells.
VTK_CODE_2 = {"interval": 21, "triangle": 22, "quadrilateral": 28, "tetrahedron": 24, "hexahedron": 29, "prism": 32}
GMSH_CODE_2 = {"interval": 8, "triangle": 9, "quadrilateral": 10, "tetrahedron": 11, "hexahedron": 12, "prism": 13}


def permutation(cell: str, n_nodes: int | None = None, form: str = "vtk") -> tuple[int, ...]:
    """Where the n-th node of a cell of the VTK or Gmsh format is in ours, for cells of degree 1 and 2; others are an error."""
    corner = FORMAT_ORDER.get(cell, tuple(range(N_VERTICES[cell])))
    n = n_nodes or N_VERTICES[cell]
    if n == N_VERTICES[cell]:
        return corner
    if degree(cell, n) != 2 or cell not in FORMAT_EDGES[form]:
        raise ValueError(f"no permutation for a {cell} of {n} nodes")
    edges = [frozenset(e) for e in EDGES[cell]]
    out = list(corner) + [len(corner) + edges.index(frozenset(corner[v] for v in e)) for e in FORMAT_EDGES[form][cell]]
    listed = FORMAT_FACES[form].get(cell, [])
    if DIM[cell] == 2 and listed:
        out.append(len(out))
    elif listed:
        quads = [frozenset(f) for f in FACES[cell] if len(f) == 4]
        first = len(corner) + len(edges)
        out += [first + quads.index(frozenset(corner[v] for v in f)) for f in listed]
        if cell == "hexahedron":
            out.append(len(out))
    return tuple(out)


def from_vtk(code: int) -> tuple[str, int]:
    """(cell type, degree) of a VTK code."""
    for table, p in ((VTK_CODE, 1), (VTK_CODE_2, 2)):
        for cell, c in table.items():
            if c == code:
                return cell, p
    raise ValueError(f"unknown VTK code {code}")


def vtk_code(cell: str, dim: int | None = None, p: int = 1) -> int:
    """The VTK code of a cell, or of its entities of a dimension."""
    kind = cell if dim is None else entity_type(cell, dim)
    return (VTK_CODE if p == 1 else VTK_CODE_2)[kind]


def to_type(name: str) -> str:
    """A cell type by its name; unknown names are an error."""
    if name not in DIM:
        raise ValueError(f"unknown cell type {name}")
    return name


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    out = [0] * len(order)
    for i, j in enumerate(order):
        out[j] = i
    return tuple(out)


def degree(cell: str, n_nodes: int) -> int:
    """The Lagrange degree of a cell with this number of nodes."""
    for p in range(1, 12):
        counts = {"point": 1, "interval": p + 1, "triangle": (p + 1) * (p + 2) // 2, "quadrilateral": (p + 1) ** 2, "tetrahedron": (p + 1) * (p + 2) * (p + 3) // 6, "hexahedron": (p + 1) ** 3, "prism": (p + 1) ** 2 * (p + 2) // 2, "pyramid": (p + 1) * (p + 2) * (2 * p + 3) // 6}
        if counts[cell] == n_nodes:
            return p
    raise ValueError(f"no {cell} has {n_nodes} nodes")


def edge_pairs(n: int) -> list[tuple[int, int]]:
    return list(combinations(range(n), 2))
