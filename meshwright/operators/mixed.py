"""Meshes of several cell types: one mesh a type over the same nodes, which share facets and dofs by their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import cells as meta
from meshwright.functions.elements import FiniteElement
from meshwright.operators import topology
from meshwright.operators.numbering import dense_ids, reliable
from meshwright.operators.spaces import FunctionSpace, _entity_rows
from meshwright.sources.generate import Mesh


def facets(meshes: list[Mesh]) -> DataFrame:
    """(kind, cell, local, key): facets of the cells of every type, kind being the place in the list."""
    out = None
    for k, m in enumerate(meshes):
        rows = topology.cell_entities(m, meta.DIM[m.cell_type] - 1).select(F.lit(k).alias("kind"), "cell", "local", "key")
        out = rows if out is None else out.unionByName(rows)
    return out


def exterior_facets(meshes: list[Mesh]) -> DataFrame:
    """(key, kind, cell, local) of facets of one cell of any type."""
    first = F.min(F.struct("kind", "cell", "local")).alias("f")
    return facets(meshes).groupBy("key").agg(F.count("*").alias("n"), first).where("n = 1").select("key", "f.*")


def cell_pairs(meshes: list[Mesh], facet: str | None = None) -> DataFrame:
    """(kind0, cell0, local0, kind1, cell1, local1): cells of any types that share a facet, of one type of facet if given."""
    rows = facets(meshes)
    if facet:
        rows = rows.where(F.size("key") == meta.N_VERTICES[facet])
    side = F.struct("kind", "cell", "local")
    both = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(side).alias("a"), F.max(side).alias("b")).where("n = 2")
    return both.selectExpr("a.kind as kind0", "a.cell as cell0", "a.local as local0", "b.kind as kind1", "b.cell as cell1", "b.local as local1")


def functionspaces(meshes: list[Mesh], elements: list[FiniteElement]) -> list[FunctionSpace]:
    """A space for each type whose dofs on shared entities are the same."""
    rows = None
    for k, (m, e) in enumerate(zip(meshes, elements, strict=True)):
        own = _entity_rows(m, e).withColumn("mesh", F.lit(k))
        # dofs inside cells are told apart by type too, for cells of different types may have the same number
        inside = F.col("kind") == 10 * meta.DIM[e.cell]
        own = own.withColumn("kind", F.when(inside, F.col("kind") + 100 * (k + 1)).otherwise(F.col("kind")))
        rows = own if rows is None else rows.unionByName(own)
    rows = reliable(rows)
    each = reliable(rows.join(dense_ids(rows.select("kind", "key", "k").distinct(), "kind", "key", "k", name="dof"), ["kind", "key", "k"]))
    out = []
    for k, (m, e) in enumerate(zip(meshes, elements, strict=True)):
        dofs = F.array(*(F.max(F.when(F.col("pos") == p, F.col("dof"))) for p in range(e.size)))
        out.append(FunctionSpace(m, e, reliable(each.where(F.col("mesh") == k).groupBy("cell").agg(dofs.alias("dofs")))))
    return out


def assemble(forms: list) -> DataFrame:
    """A form of each cell type, over spaces of functionspaces(), as one matrix, vector or number."""
    from meshwright.operators import assembly
    from meshwright.plans import weak

    if len({f.rank for f in forms}) != 1:
        raise ValueError("forms of different rank can't be added")
    rows = None
    for f in forms:
        own = weak.entries(f)
        rows = own if rows is None else rows.unionByName(own)
    if forms[0].rank == 2:
        return assembly.assemble_matrix(rows)
    return assembly.assemble_vector(rows) if forms[0].rank == 1 else rows.agg(F.sum("v").alias("v"))
