"""Forms: sums of integrals that turn into DataFrame plans when assembled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.operators import assembly, topology
from meshwright.operators.solvers import conjugate_gradients
from meshwright.sources.generate import Mesh

Entries = Callable[[Mesh], DataFrame]


@dataclass(frozen=True)
class Form:
    """rank 2 (matrix), 1 (vector) or 0 (number); terms give entries (i, j, v), (i, v) or (v)."""

    rank: int
    terms: tuple[Entries, ...] = field(default=())

    def __add__(self, other: Form) -> Form:
        if self.rank != other.rank:
            raise ValueError("forms of different rank can't be added")
        return Form(self.rank, self.terms + other.terms)

    def entries(self, mesh: Mesh) -> DataFrame:
        out = self.terms[0](mesh)
        for term in self.terms[1:]:
            out = out.unionByName(term(mesh))
        return out


def stiffness(weight: float | Column = 1.0) -> Form:
    return Form(2, (lambda m: assembly.stiffness_entries(m, F.lit(weight)),))


def mass(weight: float | Column = 1.0) -> Form:
    return Form(2, (lambda m: assembly.mass_entries(m, F.lit(weight)),))


def boundary_mass(weight: float | Column = 1.0) -> Form:
    return Form(2, (lambda m: assembly.boundary_mass_entries(m, weight=F.lit(weight)),))


def load(value: float | Column = 1.0) -> Form:
    return Form(1, (lambda m: assembly.load_entries(m, F.lit(value)),))


def boundary_load(value: float | Column = 1.0) -> Form:
    return Form(1, (lambda m: assembly.boundary_load_entries(m, value=F.lit(value)),))


def nodal_sum(value: Column) -> Form:
    """A vertex integral: the sum of an expression over the nodes."""
    return Form(0, (lambda m: m.nodes.select(value.alias("v")),))


def interior_jumps(values: DataFrame) -> Form:
    """The integral over interior facets of the squared jump of cell values (cell, v)."""

    def term(m: Mesh) -> DataFrame:
        from meshwright.functions import cells as meta

        facets = topology.interior_facets(m)
        sizes = assembly.placed_facets(m, facets).select(F.col("vertices").alias("key"), assembly.volume(meta.DIM[m.cell_type] - 1, m.gdim).alias("size"))
        a, b = (values.select(F.col("cell").alias(f"cell{k}"), F.col("v").alias(f"v{k}")) for k in (0, 1))
        both = facets.join(sizes, "key").join(a, "cell0").join(b, "cell1")
        return both.select((F.col("size") * F.pow(F.col("v0") - F.col("v1"), 2)).alias("v"))

    return Form(0, (term,))


def assemble(form: Form, mesh: Mesh, bc: DataFrame | None = None, diagonal: float = 1.0) -> DataFrame:
    """A matrix, a vector, or a row with the total `v`."""
    entries = form.entries(mesh)
    if form.rank == 2:
        return assembly.assemble_matrix(entries, bc, diagonal)
    return assembly.assemble_vector(entries) if form.rank == 1 else entries.agg(F.sum("v").alias("v"))


def solve_linear(a: Form, rhs: Form, mesh: Mesh, bc: DataFrame, rtol: float = 1e-10) -> tuple[DataFrame, int]:
    """The field with a(u, v) = rhs(v) and u = g at constrained dofs: assemble, lift, set, iterate."""
    from meshwright.operators.numbering import reliable

    full = reliable(assemble(a, mesh))
    b = assembly.apply_lifting(assemble(rhs, mesh), full, bc)
    b = reliable(assembly.set_bc(b, bc))
    return conjugate_gradients(reliable(assembly.assemble_matrix(full, bc)), b, rtol)
