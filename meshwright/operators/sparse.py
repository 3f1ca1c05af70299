"""Sparse matrices (i, j, v) and vectors (i, v) in coordinate form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(entries: DataFrame) -> DataFrame:
    """Entries of equal place added up."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def pattern(entries: DataFrame) -> DataFrame:
    return entries.select("i", "j").distinct()


def outer_pattern(rows: DataFrame, columns: DataFrame, by: str) -> DataFrame:
    """Places (i, j) of every pair of ids that share a cell (`by`)."""
    return rows.select(by, F.col("dof").alias("i")).join(columns.select(by, F.col("dof").alias("j")), by).select("i", "j").distinct()


def with_diagonal(places: DataFrame, rows: DataFrame) -> DataFrame:
    return places.select("i", "j").union(rows.select("i", F.col("i").alias("j"))).distinct()


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    return assembled(a.select("i", "j", "v").union(b.select("i", "j", "v")))


def replaced(a: DataFrame, entries: DataFrame, strict: bool = True) -> DataFrame:
    """Entries set in the matrix; strict: an entry outside its pattern is an error."""
    new = entries.select("i", "j", F.col("v").alias("__new"))
    if strict and not new.join(a, ["i", "j"], "left_anti").isEmpty():
        raise ValueError("Entry not in sparsity")
    return a.join(new, ["i", "j"], "left").select("i", "j", F.coalesce("__new", "v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def mult(a: DataFrame, x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    """y + A x, over rows that A or y has."""
    product = a.join(x.select(F.col("i").alias("j"), F.col("v").alias("__x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("__x")).alias("v"))
    return product if y is None else product.union(y.select("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))


def mult_t(a: DataFrame, x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    return mult(transpose(a), x, y)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B; a place that any product reaches stays, though it sum to zero."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("__j"), F.col("v").alias("__b"))
    left = a.select("i", F.col("j").alias("k"), "v")
    return left.join(right, "k").groupBy("i", F.col("__j").alias("j")).agg(F.sum(F.col("v") * F.col("__b")).alias("v"))


def squared_norm(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("squared_norm"))


def norm(x: DataFrame, kind: str = "l2") -> DataFrame:
    found = {"l1": F.sum(F.abs("v")), "l2": F.sqrt(F.sum(F.col("v") * F.col("v"))), "linf": F.max(F.abs("v"))}
    if kind not in found:
        raise ValueError(f"unknown norm {kind}")
    return x.agg(F.coalesce(found[kind], F.lit(0.0)).alias("norm"))


def inner_product(x: DataFrame, y: DataFrame) -> DataFrame:
    both = x.join(y.select("i", F.col("v").alias("__y")), "i")
    return both.agg(F.coalesce(F.sum(F.col("v") * F.col("__y")), F.lit(0.0)).alias("inner_product"))


def complex_inner_product(x: DataFrame, y: DataFrame) -> DataFrame:
    """Of vectors with re and im, the first one conjugated."""
    both = x.join(y.select("i", F.col("re").alias("c"), F.col("im").alias("d")), "i")
    return both.agg(F.sum(F.expr("re * c + im * d")).alias("re"), F.sum(F.expr("re * d - im * c")).alias("im"))


def orthonormalize(basis: list[DataFrame], eps: float = 1e-14) -> list[DataFrame]:
    """Modified Gram-Schmidt over vectors; a vector that depends on those before it is an error."""
    from meshwright.operators.numbering import reliable

    out: list[DataFrame] = []
    for x in basis:
        for q in out:
            c = inner_product(q, x).first()[0]
            x = x.union(q.select("i", (F.lit(-c) * F.col("v")).alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))
        n = squared_norm(x).first()[0]
        if n < eps:
            raise ValueError("linear dependency in basis")
        out.append(reliable(x.select("i", (F.col("v") / F.lit(n**0.5)).alias("v"))))
    return out


def is_orthonormal(basis: list[DataFrame], eps: float = 1e-10) -> bool:
    return all(abs(inner_product(a, b).first()[0] - (i == j)) <= eps for i, a in enumerate(basis) for j, b in enumerate(basis) if i <= j)


def blocked(a: DataFrame, bs0: int, bs1: int) -> DataFrame:
    """Entries by block (bi, bj, values row by row): the compact form; places that a block lacks are 0."""
    at = a.select(F.floor(F.col("i") / bs0).alias("bi"), F.floor(F.col("j") / bs1).alias("bj"), ((F.col("i") % bs0) * bs1 + F.col("j") % bs1).alias("k"), "v")
    return at.groupBy("bi", "bj").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0)) for k in range(bs0 * bs1))).alias("values"))


def expanded(blocks: DataFrame, bs0: int, bs1: int) -> DataFrame:
    """Blocks as single entries: the expanded form."""
    each = blocks.select("bi", "bj", F.posexplode("values").alias("k", "v"))
    return each.select((F.col("bi") * bs0 + F.floor(F.col("k") / bs1)).alias("i"), (F.col("bj") * bs1 + F.col("k") % bs1).alias("j"), "v")


def zero_matrix(places: DataFrame) -> DataFrame:
    """A matrix of a pattern (i, j), without values yet."""
    return places.select("i", "j", F.lit(0.0).alias("v"))


def block_system(blocks: list[list[DataFrame | None]], row_sizes: list[int], column_sizes: list[int]) -> DataFrame:
    """One matrix of an array of them, None for empty ones, shifted by the sizes before theirs."""
    out, first = None, 0
    for line, size in zip(blocks, row_sizes, strict=True):
        beside = 0
        for a, width in zip(line, column_sizes, strict=True):
            if a is not None:
                moved = a.select((F.col("i") + first).alias("i"), (F.col("j") + beside).alias("j"), "v")
                out = moved if out is None else out.unionByName(moved)
            beside += width
        first += size
    return out


def block_vector(parts: list[DataFrame], sizes: list[int]) -> DataFrame:
    """One vector of several, shifted by the sizes before theirs."""
    out, first = None, 0
    for x, size in zip(parts, sizes, strict=True):
        moved = x.select((F.col("i") + first).alias("i"), "v")
        out, first = moved if out is None else out.unionByName(moved), first + size
    return out


def split_vector(x: DataFrame, sizes: list[int]) -> list[DataFrame]:
    """The vectors that block_vector() put together."""
    out, first = [], 0
    for size in sizes:
        out.append(x.where((F.col("i") >= first) & (F.col("i") < first + size)).select((F.col("i") - first).alias("i"), "v"))
        first += size
    return out


def to_scipy(a: DataFrame, most: int = 10_000_000):
    """(rows, columns, values) as numpy arrays, the form that other libraries take; more than `most` entries are an error."""
    rows = a.select("i", "j", "v").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"the matrix has more than {most} entries")
    return tuple(rows[c].to_numpy() for c in "ijv")


def to_dense(a: DataFrame, shape: tuple[int, int], most: int = 10_000_000):
    """A small matrix as a numpy array; more than `most` places are an error."""
    import numpy as np

    if shape[0] * shape[1] > most:
        raise ValueError(f"the matrix has more than {most} places")
    i, j, v = to_scipy(a, most)
    out = np.zeros(shape)
    np.add.at(out, (i, j), v)
    return out


def nnz_per_row(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.count("*").alias("nnz"))
