import math

import pytest
from pyspark.sql import functions as F

from meshwright.functions import cells as meta
from meshwright.operators import assembly, geometry, numbering, refinement, solvers, sparse, topology
from meshwright.plans import forms
from meshwright.sources import files, generate
from meshwright.streaming import snapshots


def test_counts_of_entities(spark):
    square = generate.rectangle(spark, 3, 2)
    assert square.cells.count() == 12 and square.nodes.count() == 12
    assert topology.entities(square, 1).count() == 3 * 3 + 2 * 4 + 6
    assert topology.exterior_facets(square).count() == 10
    cube = generate.box(spark, 2, 2, 2)
    assert cube.cells.count() == 48
    v, e, f = cube.nodes.count(), topology.entities(cube, 1).count(), topology.entities(cube, 2).count()
    assert v - e + f - 48 == 1  # Euler
    assert topology.exterior_facets(cube).count() == 48


@pytest.mark.parametrize("diagonal", ["left", "right", "crossed", "left_right", "right_left"])
def test_triangles_fill_the_rectangle(spark, diagonal):
    mesh = generate.rectangle(spark, 3, 4, diagonal=diagonal, hi=(2.0, 1.0))
    assert assembly.total(mesh).first()[0] == pytest.approx(2.0)
    assert mesh.cells.count() == (48 if diagonal == "crossed" else 24)


def test_volumes_and_quads(spark):
    assert assembly.total(generate.box(spark, 2, 3, 1)).first()[0] == pytest.approx(1.0)
    assert assembly.total(generate.interval(spark, 7, 1.0, 3.0)).first()[0] == pytest.approx(2.0)
    quads = generate.rectangle(spark, 2, 3, "quadrilateral")
    assert topology.entities(quads, 1).count() == 2 * 4 + 3 * 3
    placed = topology.with_points(quads.cells, "vertices", quads.nodes, ["cell"]).where("cell = 0").first()["points"]
    assert (placed[0].x, placed[0].y) == (0.0, 0.0) and placed[3].x == pytest.approx(0.5) and placed[3].y == pytest.approx(1 / 3)
    assert generate.box(spark, 2, 2, 1, "prism").cells.count() == 8
    with pytest.raises(ValueError):
        generate.box(spark, 1, 1, 1, lo=(0, 0, 1), hi=(1, 1, 1))


def test_matrices(spark):
    mesh = generate.rectangle(spark, 4, 4)
    a, m = forms.assemble(forms.stiffness(), mesh), forms.assemble(forms.mass(), mesh)
    assert m.agg(F.sum("v")).first()[0] == pytest.approx(1.0)
    assert max(abs(r["v"]) for r in sparse.mult(a, assembly.interpolate(mesh, F.lit(1.0))).collect()) < 1e-12
    x = assembly.interpolate(mesh, F.col("x"))
    assert sparse.inner_product(x, sparse.mult(a, x)).first()[0] == pytest.approx(1.0)
    assert forms.assemble(forms.boundary_mass(), mesh).agg(F.sum("v")).first()[0] == pytest.approx(4.0)
    assert forms.assemble(forms.nodal_sum(F.col("x")), mesh).first()[0] == pytest.approx(12.5)


def test_poisson_matches_linear_field(spark):
    mesh = generate.rectangle(spark, 3, 3)
    edge = topology.exterior_facets(mesh).select(F.explode("key").alias("node")).distinct()
    bc = mesh.nodes.join(edge, "node").select(F.col("node").alias("dof"), (1 + F.col("x") + 2 * F.col("y")).alias("g"))
    u, steps = forms.solve_linear(forms.stiffness(), forms.load(0.0), mesh, bc)
    exact = assembly.interpolate(mesh, 1 + F.col("x") + 2 * F.col("y")).withColumnRenamed("v", "e")
    assert u.join(exact, "i").agg(F.max(F.abs(F.col("v") - F.col("e")))).first()[0] < 1e-8
    points = spark.createDataFrame([(0, 0, 0.1, 0.05, 0.0), (1, -1, 0.0, 0.0, 0.0)], "point bigint, cell bigint, x double, y double, z double")
    found = {r["point"]: r["v"] for r in assembly.evaluate(mesh, u, points).collect()}
    assert found[0] == pytest.approx(1.2) and found[1] == 0.0


def test_dual_graph_and_connectivity(spark):
    mesh = generate.rectangle(spark, 2, 1)
    pairs = sorted(map(tuple, topology.dual_graph(mesh).collect()))
    assert len(pairs) == 6 and all((b, a) in pairs for a, b in pairs)
    assert topology.connectivity(mesh, 2, 1).count() == 12
    assert topology.connectivity(mesh, 1, 2).count() == 12
    assert topology.connectivity(mesh, 1, 0).count() == 2 * 9
    assert topology.locate_entities(mesh, 1, F.col("x") == 0).count() == 1
    assert topology.locate_entities_boundary(mesh, 0, F.col("y") == 1).count() == 3


def test_sparse(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 0, -1.0)], "i bigint, j bigint, v double")
    x = spark.createDataFrame([(0, 1.0), (1, 3.0)], "i bigint, v double")
    assert {r["i"]: r["v"] for r in sparse.mult(a, x, x).collect()} == {0: 6.0, 1: 2.0}
    assert {r["i"]: r["v"] for r in sparse.mult_t(a, x).collect()} == {0: -1.0, 1: 1.0}
    c = {(r["i"], r["j"]): r["v"] for r in sparse.matmul(a, sparse.transpose(a)).collect()}
    assert c == {(0, 0): 5.0, (0, 1): -2.0, (1, 0): -2.0, (1, 1): 1.0}
    zero = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0)], "i bigint, j bigint, v double")
    ones = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0)], "i bigint, j bigint, v double")
    assert [r["v"] for r in sparse.matmul(zero, ones).collect()] == [0.0]  # a structural zero stays
    assert sparse.norm(x, "l1").first()[0] == 4.0 and sparse.norm(x, "linf").first()[0] == 3.0
    with pytest.raises(ValueError):
        sparse.norm(x, "l3")
    basis = sparse.orthonormalize([x, spark.createDataFrame([(0, 1.0)], "i bigint, v double")])
    assert sparse.is_orthonormal(basis)
    with pytest.raises(ValueError):
        sparse.orthonormalize([x, x])
    with pytest.raises(ValueError):
        sparse.replaced(a, spark.createDataFrame([(5, 5, 1.0)], "i bigint, j bigint, v double"))


def test_boundary_conditions(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 2.0)], "i bigint, j bigint, v double")
    b = spark.createDataFrame([(0, 1.0), (1, 1.0)], "i bigint, v double")
    bc = spark.createDataFrame([(1, 3.0)], "dof bigint, g double")
    assert {(r["i"], r["j"]): r["v"] for r in assembly.assemble_matrix(a, bc).collect()} == {(0, 0): 2.0, (1, 1): 1.0}
    lifted = assembly.set_bc(assembly.apply_lifting(b, a, bc), bc)
    assert {r["i"]: r["v"] for r in lifted.collect()} == {0: 4.0, 1: 3.0}


def test_geometry(spark):
    mesh = generate.rectangle(spark, 4, 4)
    placed = assembly.placed_cells(mesh)
    corners = placed.select("cell", F.explode("points").alias("p")).select("cell", "p.*")
    frame = geometry.boxes(corners, "cell")
    pairs = {(r["e0"], r["e1"]) for r in geometry.box_collisions(frame, frame).collect()}
    rows = frame.collect()
    meet = lambda a, b: all(a[f"lo_{c}"] <= b[f"hi_{c}"] + 1e-12 and b[f"lo_{c}"] <= a[f"hi_{c}"] + 1e-12 for c in "xyz")
    assert pairs == {(a["entity"], b["entity"]) for a in rows for b in rows if meet(a, b)}
    points = spark.createDataFrame([(0, 0.3, 0.1, 0.0), (1, 5.0, 0.0, 0.0)], "point bigint, x double, y double, z double")
    held = geometry.points_in_boxes(frame, points)
    hits = geometry.colliding_cells(placed, held, points)
    assert {r["point"]: r["cell"] for r in geometry.first_colliding_cell(hits, points).collect()} == {0: 3, 1: -1}
    middles = placed.select("cell", *(F.expr(f"aggregate(points, 0D, (s, p) -> s + p.{c}) / 3").alias(c) for c in "xyz")).withColumnRenamed("cell", "entity")
    near = {r["point"]: (r["entity"], r["d2"]) for r in geometry.closest(middles, points, 0.1).collect()}
    for p in points.collect():
        best = min((sum((r[c] - p[c]) ** 2 for c in "xyz"), r["entity"]) for r in middles.collect())
        assert near[p["point"]][1] == pytest.approx(best[0])
    hulls = spark.createDataFrame([(0, [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], [[1.0, 1.0, 0.0]]), (1, [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]], [[0.5, 0.5, 0.5]])], "id bigint, p array<array<double>>, q array<array<double>>")
    found = {r["id"]: r["d2"] for r in geometry.hull_distances(hulls).collect()}
    assert found[0] == pytest.approx(0.5) and found[1] == pytest.approx(0.0, abs=1e-12)


def test_refinement(spark):
    for mesh, n in ((generate.rectangle(spark, 2, 2), 4), (generate.box(spark, 1, 1, 1), 8), (generate.interval(spark, 3), 2), (generate.rectangle(spark, 2, 2, "quadrilateral"), 4)):
        fine, parents = refinement.uniform(mesh)
        assert fine.cells.count() == n * mesh.cells.count() == parents.count()
        if mesh.cell_type != "quadrilateral":
            assert assembly.total(fine).first()[0] == pytest.approx(1.0)
            inner = topology.facet_counts(fine).where("n > 2").count()
            assert inner == 0
    mesh = generate.rectangle(spark, 2, 2)
    some = topology.cell_entities(mesh, 1).where("cell = 0 and local = 0").select("key")
    fine, parents = refinement.plaza(mesh, some)
    assert fine.cells.count() > mesh.cells.count()
    assert assembly.total(fine).first()[0] == pytest.approx(1.0)
    # conforming: the boundary is as long as before
    assert forms.assemble(forms.boundary_mass(), fine).agg(F.sum("v")).first()[0] == pytest.approx(4.0)
    marks = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "i bigint, v double")
    assert [r["i"] for r in refinement.mark_maximum(marks, 0.5).collect()] == [2]  # strict


def test_numbering(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 as k")
    numbered = numbering.dense_ids(rows, "k").collect()
    assert all(r["id"] == r["k"] for r in numbered)
    parts = spark.range(23).select(numbering.index_owner(F.col("id"), 23, 5).alias("p"), "id").collect()
    first = spark.range(5).select("id", *[c.alias(n) for c, n in zip(numbering.local_range(F.col("id"), 23, 5), "ab")]).collect()
    assert all(first[r["p"]]["a"] <= r["id"] < first[r["p"]]["b"] for r in parts)
    pairs = spark.createDataFrame([(1, 5), (1, 3), (0, 2)], "k bigint, v bigint")
    assert sorted(map(tuple, numbering.sort_unique(pairs, "k", "v").collect())) == [(0, 2), (1, 3)]
    edges = numbering.to_edges(spark.createDataFrame([(0, [2, 1]), (1, [2])], "n bigint, links array<bigint>"), "n", "links")
    assert {(r["src"], r["dst"]) for r in numbering.transposed(edges).collect()} == {(2, 0), (1, 0), (2, 1)}


def test_tags_and_submesh(spark):
    mesh = generate.rectangle(spark, 2, 2)
    numbered = topology.entities(mesh, 1)
    asked = spark.createDataFrame([([1, 0], 4), ([0, 8], 9)], "vertices array<bigint>, value int")
    assert sorted(r["entity"] for r in topology.entities_to_index(numbered, asked).collect()) == [-1, 0]
    assert list(map(tuple, topology.meshtags(numbered, asked).collect())) == [(0, 4)]
    sub, cells, nodes = topology.submesh(mesh, topology.exterior_facets(mesh).select("key"), "interval")
    assert sub.cells.count() == 8 and assembly.total(sub).first()[0] == pytest.approx(4.0)
    assert topology.levels(topology.dual_graph(mesh), spark.createDataFrame([(0,)], "node bigint")).agg(F.max("level")).first()[0] >= 3


def test_curl_of_gradient_is_zero(spark):
    mesh = generate.box(spark, 1, 1, 1)
    edges, faces = topology.entities(mesh, 1), topology.entities(mesh, 2)
    g, c = assembly.discrete_gradient(edges), assembly.discrete_curl(faces, edges)
    assert sparse.matmul(c, g).agg(F.max(F.abs("v"))).first()[0] == 0.0


def test_solvers(spark):
    a = spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 3.0)], "i bigint, j bigint, v double")
    value, _ = solvers.power_iteration(a, spark.createDataFrame([(0, 1.0), (1, 0.0)], "i bigint, v double"))
    assert value == pytest.approx((7 + math.sqrt(5)) / 2, rel=1e-6)
    root, _ = solvers.newton(lambda x: x.select("i", (F.col("v") * F.col("v") - 2).alias("v")), lambda x, f: x.join(f.withColumnRenamed("v", "f"), "i").select("i", (F.col("f") / (2 * F.col("v"))).alias("v")), spark.createDataFrame([(0, 1.0)], "i bigint, v double"))
    assert root.first()["v"] == pytest.approx(math.sqrt(2))


def test_files(spark, tmp_path):
    mesh = generate.rectangle(spark, 2, 2, "quadrilateral")
    path = tmp_path / "m.xdmf"
    path.write_text(files.xdmf_text(mesh, information={"author": "nobody"}))
    again = files.read_xdmf(spark, str(path))
    assert sorted(map(tuple, (r["vertices"] for r in again.cells.collect()))) == sorted(map(tuple, (r["vertices"] for r in mesh.cells.collect())))
    assert files.read_information(spark, str(path)) == {"author": "nobody"}
    assert "UnstructuredGrid" in files.vtu_text(mesh)
    files.write_mesh(mesh, str(tmp_path / "mesh"))
    assert files.read_mesh(spark, str(tmp_path / "mesh")).nodes.count() == 9
    msh = tmp_path / "m.msh"
    msh.write_text('$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$PhysicalNames\n1\n2 7 "all"\n$EndPhysicalNames\n$Nodes\n3\n1 0 0 0\n2 1 0 0\n3 0 1 0\n$EndNodes\n$Elements\n2\n1 1 2 5 1 1 2\n2 2 2 7 1 1 2 3\n$EndElements\n')
    read, tags, groups = files.read_msh(spark, str(msh), 2)
    assert read.cell_type == "triangle" and groups == {"all": (2, 7)} and tags["interval"].first()["value"] == 5


def test_snapshots(spark, tmp_path):
    mesh = generate.interval(spark, 2)
    writer = snapshots.SnapshotWriter(str(tmp_path), mesh)
    for t in (0.0, 0.5):
        writer.write(assembly.interpolate(mesh, F.col("x") + t), t)
    assert snapshots.read(spark, str(tmp_path), 0.5).count() == 3
    stream = snapshots.norms_over_time(spark, str(tmp_path)).writeStream.outputMode("complete").format("memory").queryName("norms").start()
    stream.processAllAvailable()
    stream.stop()
    assert {r["t"]: r["linf"] for r in spark.table("norms").collect()} == {0.0: 1.0, 0.5: 1.5}


def test_cells():
    for cell in meta.DIM:
        if meta.DIM[cell] == 3:
            assert meta.n_entities(cell, 0) - meta.n_entities(cell, 1) + meta.n_entities(cell, 2) == 2
        assert meta.inverse(meta.inverse(meta.permutation(cell))) == meta.permutation(cell)
        assert meta.degree(cell, meta.N_VERTICES[cell]) == 1 or cell == "point"
    assert meta.sub_entities("tetrahedron", 2, 1)[0] == [0, 1, 2]
    assert meta.facet_type("prism", 1) == "quadrilateral"
