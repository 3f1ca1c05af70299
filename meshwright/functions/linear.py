"""Small dense algebra and geometry on columns; matrices are nested lists of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]
Matrix = list[Vector]


def cross(u: Vector, v: Vector) -> Vector:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def dot(u: Vector, v: Vector) -> Column:
    out = u[0] * v[0]
    for a, b in zip(u[1:], v[1:], strict=True):
        out = out + a * b
    return out


def norm(u: Vector) -> Column:
    return F.sqrt(dot(u, u))


def transposed(a: Matrix) -> Matrix:
    return [list(r) for r in zip(*a, strict=True)]


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return [[dot(row, col) for col in transposed(b)] for row in a]


def difference_of_products(a: Column, b: Column, c: Column, d: Column) -> Column:
    """a d - b c. Spark has no fused product, so the last digit may differ from one that has."""
    return a * d - b * c


def det(a: Matrix) -> Column:
    if len(a) == 1:
        return a[0][0]
    if len(a) == 2:
        return a[0][0] * a[1][1] - a[0][1] * a[1][0]
    return dot(a[0], cross(a[1], a[2]))


def inv(a: Matrix) -> Matrix:
    d = det(a)
    if len(a) == 1:
        return [[1 / d]]
    if len(a) == 2:
        return [[a[1][1] / d, -a[0][1] / d], [-a[1][0] / d, a[0][0] / d]]
    columns = [cross(a[1], a[2]), cross(a[2], a[0]), cross(a[0], a[1])]
    return [[columns[j][i] / d for j in range(3)] for i in range(3)]


def pinv(a: Matrix) -> Matrix:
    """The left pseudo-inverse of a matrix with more rows than columns."""
    t = transposed(a)
    return matmul(inv(matmul(t, a)), t)


def measure(jacobian: Matrix) -> Column:
    """The factor from reference to physical volume; also of cells in a space of higher dimension."""
    if len(jacobian) == len(jacobian[0]):
        return F.abs(det(jacobian))
    return F.sqrt(det(matmul(transposed(jacobian), jacobian)))


def coordinates(nodes: str, k: int, gdim: int) -> Vector:
    """Of the k-th point in a column of arrays of structs x, y, z."""
    return [F.col(nodes)[k][c] for c in "xyz"[:gdim]]


def jacobian(nodes: str, tdim: int, gdim: int) -> Matrix:
    """Of an affine cell given by its first tdim + 1 points."""
    origin = coordinates(nodes, 0, gdim)
    points = [coordinates(nodes, k + 1, gdim) for k in range(tdim)]
    return [[points[j][i] - origin[i] for j in range(tdim)] for i in range(gdim)]
