"""Krylov, Newton and power iterations: the driver holds scalars, vectors stay DataFrames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators.numbering import reliable
from meshwright.operators.sparse import inner_product, mult, squared_norm


def _sum(x: DataFrame, c: float, y: DataFrame) -> DataFrame:
    """x + c y."""
    moved = y.select("i", (F.lit(c) * F.col("v")).alias("v"))
    return x.select("i", "v").union(moved).groupBy("i").agg(F.sum("v").alias("v"))


def _with_product(a: DataFrame, state: DataFrame, column: str, name: str) -> DataFrame:
    """The state table with the matrix times one of its columns, checkpointed: the one cut of a step."""
    product = mult(a, state.select("i", F.col(column).alias("v"))).withColumnRenamed("v", name)
    return reliable(state.join(product, "i", "left").fillna(0.0, [name]))


def _dots(state: DataFrame, *pairs: tuple[str, str]) -> list[float]:
    """Inner products of columns, all in one aggregate."""
    row = state.agg(*(F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0.0)).alias(f"d{k}") for k, (x, y) in enumerate(pairs))).first()
    return list(row)


def conjugate_gradients(a: DataFrame, b: DataFrame, rtol: float = 1e-10, most: int = 500) -> tuple[DataFrame, int]:
    """x with A x = b for a symmetric positive definite A, and the iterations taken.

    All vectors are columns of one table: a step is a product, a join, one
    checkpoint and one aggregate; the updates are projections.
    """
    state = b.select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("p"))
    stop = None
    for k in range(most + 1):
        state = _with_product(a, state, "p", "ap")
        rr, pap, rap, apap = _dots(state, ("r", "r"), ("p", "ap"), ("r", "ap"), ("ap", "ap"))
        stop = rtol * rtol * rr if stop is None else stop
        if rr <= stop or rr == 0:
            return state.select("i", F.col("x").alias("v")), k
        step = rr / pap
        turn = max(0.0, rr - 2 * step * rap + step * step * apap) / rr
        state = state.selectExpr("i", f"x + {step!r}D * p as x", f"r - {step!r}D * ap as r", f"r - {step!r}D * ap + {turn!r}D * p as p")
    raise RuntimeError(f"no convergence in {most} iterations")


def stabilised_bicg(a: DataFrame, b: DataFrame, rtol: float = 1e-10, most: int = 500) -> tuple[DataFrame, int]:
    """x with A x = b for any regular A by stabilised bi-conjugate gradients; two products a step."""
    state = b.select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("h"), F.col("v").alias("p"))
    stop = None
    for k in range(most + 1):
        state = _with_product(a, state, "p", "ap")
        rr, rho, below = _dots(state, ("r", "r"), ("h", "r"), ("h", "ap"))
        stop = rtol * rtol * rr if stop is None else stop
        if rr <= stop or rr == 0:
            return state.select("i", F.col("x").alias("v")), k
        if not rho or not below:
            raise RuntimeError("breakdown of the iteration")
        step = rho / below
        state = _with_product(a, state.selectExpr("i", "x", "h", "p", "ap", f"r - {step!r}D * ap as s"), "s", "t")
        st, tt, hs, ht = _dots(state, ("s", "t"), ("t", "t"), ("h", "s"), ("h", "t"))
        w = st / tt if tt else 0.0
        turn = (hs - w * ht) / rho * (step / w if w else 0.0)
        state = state.selectExpr("i", f"x + {step!r}D * p + {w!r}D * s as x", f"s - {w!r}D * t as r", "h", f"s - {w!r}D * t + {turn!r}D * (p - {w!r}D * ap) as p")
    raise RuntimeError(f"no convergence in {most} iterations")


def krylov_basis(a: DataFrame, v: DataFrame, steps: int) -> tuple[DataFrame, np.ndarray, float]:
    """(table i, q0, q1, ...; Hessenberg matrix; norm of v): orthonormal vectors that span v, A v, A A v, ...; columns of one table."""
    norm = squared_norm(v).first()[0] ** 0.5
    state = v.select("i", (F.col("v") / F.lit(norm or 1.0)).alias("q0"))
    h = np.zeros((steps + 1, steps))
    for k in range(steps):
        state = _with_product(a, state, f"q{k}", "w")
        for _ in range(2):  # twice, against rounding
            found = _dots(state, *((f"q{m}", "w") for m in range(k + 1)))
            h[: k + 1, k] += found
            state = state.withColumn("w", F.expr("w" + "".join(f" - ({c!r}D) * q{m}" for m, c in enumerate(found))))
        h[k + 1, k] = _dots(state, ("w", "w"))[0] ** 0.5
        if h[k + 1, k] < 1e-12 * max(1.0, np.abs(h).max()):
            return state.drop("w"), h[: k + 1, : k + 1], norm
        state = state.withColumn(f"q{k + 1}", F.col("w") / F.lit(float(h[k + 1, k]))).drop("w")
    return state, h, norm


def gmres(a: DataFrame, b: DataFrame, rtol: float = 1e-10, restart: int = 30, most: int = 20) -> tuple[DataFrame, int]:
    """x with A x = b for any regular A by restarted least residuals; the small problem is solved on the driver."""
    x, r, total, stop = b.select("i", F.lit(0.0).alias("v")), reliable(b.select("i", "v")), 0, None
    for _ in range(most):
        size = squared_norm(r).first()[0] ** 0.5
        stop = rtol * size if stop is None else stop
        if size <= stop or size == 0:
            return x, total
        basis, h, norm = krylov_basis(a, r, restart)
        rows, n = h.shape
        y = np.linalg.lstsq(h, norm * np.eye(rows, 1)[:, 0], rcond=None)[0]
        step = basis.select("i", F.expr(" + ".join(f"({float(c)!r}D) * q{k}" for k, c in enumerate(y))).alias("v"))
        x = reliable(_sum(x, 1.0, step))
        r = reliable(_sum(b, -1.0, mult(a, x)))
        total += n
    size = squared_norm(r).first()[0] ** 0.5
    if size <= stop:
        return x, total
    raise RuntimeError(f"no convergence in {total} iterations")


def lanczos(a: DataFrame, v: DataFrame, n: int, steps: int = 40) -> list[tuple[float, DataFrame]]:
    """The n eigenpairs of greatest size that a Krylov space of a symmetric matrix holds."""
    basis, h, _ = krylov_basis(a, v, steps)
    k = min(h.shape)
    values, vectors = np.linalg.eigh((h[:k, :k] + h[:k, :k].T) / 2)
    order = np.argsort(-np.abs(values))[:n]
    return [(float(values[o]), basis.select("i", F.expr(" + ".join(f"({float(c)!r}D) * q{m}" for m, c in enumerate(vectors[:, o]))).alias("v"))) for o in order]


def _dense(a: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a matrix of at most `most` rows; larger ones are an error."""
    ids = a.select(F.col("i").alias("k")).union(a.select("j")).distinct().orderBy("k").limit(most + 1).toPandas()["k"].to_numpy()
    if len(ids) > most:
        raise ValueError(f"a direct method is for {most} rows at most; use conjugate_gradients(), stabilised_bicg() or gmres()")
    rows = a.toPandas()
    out = np.zeros((len(ids), len(ids)))
    np.add.at(out, (np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])), rows["v"])
    return ids, out


def direct(a: DataFrame, b: DataFrame, transpose: bool = False, most: int = 4000) -> DataFrame:
    """x with A x = b, or with the transpose, by factorisation on the driver; for small systems only, of `most` rows."""
    ids, matrix = _dense(a, most)
    right = np.zeros(len(ids))
    rows = b.where(F.col("i").isin(ids.tolist()) if len(ids) < 1000 else F.lit(True)).toPandas()
    right[np.searchsorted(ids, rows["i"])] = rows["v"]
    x = np.linalg.solve(matrix.T if transpose else matrix, right)
    return a.sparkSession.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "i bigint, v double")


def eigenpairs(a: DataFrame, b: DataFrame | None = None, n: int = 1, most: int = 2000) -> list[tuple[float, DataFrame]]:
    """The n eigenpairs A x = l B x of greatest size of small symmetric matrices, on the driver."""
    ids, matrix = _dense(a, most)
    if b is not None:
        lower = np.linalg.cholesky(_dense(b, most)[1])
        half = np.linalg.solve(lower, np.linalg.solve(lower, matrix).T)
        values, vectors = np.linalg.eigh((half + half.T) / 2)
        vectors = np.linalg.solve(lower.T, vectors)
    else:
        values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-np.abs(values))[:n]
    spark = a.sparkSession
    return [(float(values[k]), spark.createDataFrame(list(zip(ids.tolist(), vectors[:, k].tolist(), strict=True)), "i bigint, v double")) for k in order]


def without_nullspace(x: DataFrame, basis: list[DataFrame]) -> DataFrame:
    """x less its components along orthonormal vectors."""
    for q in basis:
        x = _sum(x, -inner_product(q, x).first()[0], q)
    return x


def newton(residual: Callable[[DataFrame], DataFrame], solve: Callable[[DataFrame, DataFrame], DataFrame], x: DataFrame, rtol: float = 1e-9, atol: float = 1e-10, most: int = 50, relaxation: float = 1.0, update: Callable[[DataFrame, DataFrame], DataFrame] | None = None, converged: Callable[[float, float, int], bool] | None = None) -> tuple[DataFrame, int]:
    """x with F(x) = 0; solve(x, F) gives the step J dx = F.

    Stops on the step's norm, relative to the first, or absolute; or by
    converged(norm, first norm, steps). update(x, dx) may replace x - relaxation dx.
    """
    first = None
    for k in range(most):
        dx = reliable(solve(x, residual(x)))
        size = squared_norm(dx).first()[0] ** 0.5
        first = first or size
        x = reliable(update(x, dx) if update else _sum(x, -relaxation, dx))
        if converged(size, first, k + 1) if converged else size < atol or (k and size / first < rtol):
            return x, k + 1
    raise RuntimeError(f"no convergence in {most} iterations")


def power_iteration(a: DataFrame, x: DataFrame, steps: int = 100, tol: float = 1e-10) -> tuple[float, DataFrame]:
    """The eigenvalue of greatest size and its vector."""
    value = 0.0
    for _ in range(steps):
        y = reliable(mult(a, x))
        size = squared_norm(y).first()[0] ** 0.5
        if size == 0:
            return 0.0, x
        before, value = value, inner_product(x, y).first()[0]
        x = reliable(y.select("i", (F.col("v") / F.lit(size)).alias("v")))
        if abs(value - before) <= tol * abs(value):
            break
    return value, x
