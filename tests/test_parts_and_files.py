"""Partitions, orderings, mixed cell types, solvers, refinement, distances, second-order files, stores and timers."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright import queries, timing
from meshwright.functions import cells as meta
from meshwright.functions.elements import element
from meshwright.operators import geometry, mixed, partition, refinement, solvers, sparse, spaces, topology
from meshwright.plans import weak
from meshwright.plans.weak import dx
from meshwright.sources import files, generate
from meshwright.sources.store import Store


def size(mesh):
    return weak.assemble((weak.lift(1.0) * dx).on(mesh)).first()["v"]


def test_parts_and_ghosts(spark):
    mesh = generate.rectangle(spark, 4, 4)
    parts = partition.partition_cells(mesh, 3).withColumnRenamed("cell", "node")
    counts = [r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == 32 and max(counts) - min(counts) <= 1
    graph = partition.cell_graph(mesh)
    where = partition.destinations(graph, parts)
    own = {r["node"]: r["part"] for r in parts.collect()}
    want = {(r["src"], own[r["dst"]]) for r in graph.collect() if own[r["src"]] != own[r["dst"]]}
    assert {(r["node"], r["part"]) for r in where.where("ghost").collect()} == want
    numbered = partition.numbered_by_part(parts)
    rows = sorted((r["id"], r["part"]) for r in numbered.collect())
    assert [i for i, _ in rows] == list(range(32)) and [p for _, p in rows] == sorted(p for _, p in rows)
    assert partition.ghost_ids(where, numbered).count() == len(want)
    assert sum(len(r["destinations"]) for r in partition.shared_ids(where, numbered).collect()) == len(want)
    assert partition.distribute(mesh.cells, "cell", where).count() == 32 + len(want)
    cut = partition.edge_cut(graph, parts)
    assert cut.agg(F.sum("weight")).first()[0] == graph.count() and partition.graph_json(cut).count() == 3
    assert partition.owned(numbered.select("id"), numbered).count() == 32
    assert sorted(r["sub"] for r in partition.sub_numbering(numbered, numbered.where("id % 2 = 0")).collect()) == list(range(16))
    moved = partition.adjusted(numbered.select("id", "part"), spark.createDataFrame([(0, 5), (1, 1), (2, 0)], "part int, n int"))
    assert all(r["moved"] - r["id"] == (0, 5, 6)[r["part"]] for r in moved.collect())
    fine, parents = refinement.uniform(mesh)
    assert refinement.identity_partition(parts.withColumnRenamed("node", "cell"), parents).count() == fine.cells.count()


def test_reverse_cuthill_mckee(spark):
    edges = [(k * 7 % 12, (k + 1) * 7 % 12) for k in range(11)] + [(20, 21)]  # a scrambled path, and a component of its own
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src bigint, dst bigint")
    order = partition.reverse_cuthill_mckee(both)
    assert sorted(r["position"] for r in order.collect()) == list(range(14))
    assert partition.bandwidth(partition.reordered(both, order)).first()[0] == 1 < partition.bandwidth(both).first()[0]
    assert partition.partition_graph(both, 2).groupBy("part").count().count() == 2


def test_mixed_cell_types(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 0.0), (4, 2.0, 0.5, 0.0)], "node bigint, x double, y double, z double")
    one = lambda v: spark.createDataFrame([(0, v)], "cell bigint, vertices array<bigint>")
    meshes = [generate.from_arrays("quadrilateral", 2, one([0, 1, 2, 3]), nodes), generate.from_arrays("triangle", 2, one([1, 3, 4]), nodes)]
    assert [tuple(r) for r in mixed.cell_pairs(meshes).collect()] == [(0, 0, 2, 1, 0, 2)]
    assert mixed.exterior_facets(meshes).count() == 5
    both = mixed.functionspaces(meshes, [element("Q", "quadrilateral", 2), element("P", "triangle", 2)])
    dofs = [set(r["d"] for r in s.dofmap.select(F.explode("dofs").alias("d")).collect()) for s in both]
    assert len(dofs[0] & dofs[1]) == 3 and len(dofs[0] | dofs[1]) == 12
    total = sum(size(m) for m in meshes)
    assert total == pytest.approx(1.5)
    mass = mixed.assemble([weak.TrialFunction(s) * weak.TestFunction(s) * dx for s in both])
    assert mass.agg(F.sum("v")).first()[0] == pytest.approx(1.5) and mass.select("i").distinct().count() == 12


def test_refinement_of_all_cell_types(spark):
    for mesh in (generate.interval(spark, 3), generate.rectangle(spark, 2, 2, "quadrilateral"), generate.box(spark, 1, 1, 1, "hexahedron"), generate.box(spark, 1, 1, 1, "prism"), generate.box(spark, 1, 1, 1)):
        fine, parents = refinement.uniform(mesh)
        n = 2 ** meta.DIM[mesh.cell_type]
        assert fine.cells.count() == n * mesh.cells.count() == parents.count() and size(fine) == pytest.approx(1.0)
        assert topology.exterior_facets(fine).count() == n // 2 * topology.exterior_facets(mesh).count()
    x = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1)]
    pyramid = generate.from_arrays("pyramid", 3, spark.createDataFrame([(0, [0, 1, 2, 3, 4])], "cell bigint, vertices array<bigint>"), spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "node bigint, x double, y double, z double"))
    parts = refinement.uniform_parts(pyramid)
    assert sum(size(m) for m, _ in parts.values()) == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        refinement.uniform(pyramid)


@pytest.mark.parametrize("cell", ["interval", "triangle", "tetrahedron"])
def test_marked_refinement(spark, cell):
    mesh = {"interval": generate.interval(spark, 4), "triangle": generate.rectangle(spark, 3, 3), "tetrahedron": generate.box(spark, 2, 1, 1)}[cell]
    marked = topology.locate_entities(mesh, 1, (F.col("x") <= 0.5) & (F.col("y") <= 0.5))
    fine, parents = refinement.plaza(mesh, marked)
    assert size(fine) == pytest.approx(1.0) and mesh.cells.count() < fine.cells.count() == parents.count()
    assert topology.facet_counts(fine).agg(F.max("n")).first()[0] <= 2
    sides = topology.exterior_facets(mesh).select("key", F.lit(9).alias("value"))
    moved = refinement.transfer_facet_tags(sides, mesh, fine, parents)
    outer = topology.exterior_facets(fine).select("key")
    assert moved.count() == outer.count() == moved.join(outer, "key").count()
    with pytest.raises(ValueError):
        refinement.plaza(generate.rectangle(spark, 1, 1, "quadrilateral"), marked)


def test_affine_formulas_refuse_other_cells(spark):
    from meshwright.operators import assembly

    for cell in ("quadrilateral", "hexahedron"):
        mesh = generate.rectangle(spark, 1, 1, cell) if cell == "quadrilateral" else generate.box(spark, 1, 1, 1, cell)
        with pytest.raises(ValueError):
            assembly.total(mesh)


def test_krylov_methods_and_direct(spark):
    draw = np.random.default_rng(3)
    dense = draw.random((12, 12)) + 12 * np.eye(12)
    a = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(12) for j in range(12)], "i bigint, j bigint, v double")
    want = draw.random(12)
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(dense @ want)], "i bigint, v double")
    for method in (solvers.stabilised_bicg, solvers.gmres):
        x = {r["i"]: r["v"] for r in method(a, b)[0].collect()}
        assert [x[k] for k in range(12)] == pytest.approx(want, rel=1e-6)
    x = {r["i"]: r["v"] for r in solvers.direct(a, b).collect()}
    assert [x[k] for k in range(12)] == pytest.approx(want)
    with pytest.raises(ValueError):
        solvers.direct(a, b, most=5)
    even = (dense + dense.T) / 2
    s = spark.createDataFrame([(i, j, float(even[i, j])) for i in range(12) for j in range(12)], "i bigint, j bigint, v double")
    top = sorted(np.linalg.eigvalsh(even), key=abs)[-1]
    assert solvers.eigenpairs(s)[0][0] == pytest.approx(top)
    assert solvers.lanczos(s, b, 1, 12)[0][0] == pytest.approx(top)
    parts = sparse.split_vector(sparse.block_vector([b, b], [12, 12]), [12, 12])
    assert sorted(map(tuple, parts[1].collect())) == sorted(map(tuple, b.collect()))
    assert sorted(map(tuple, sparse.expanded(sparse.blocked(a, 2, 3), 2, 3).select("i", "j", "v").collect())) == sorted(map(tuple, a.collect()))
    assert np.allclose(sparse.to_dense(a, (12, 12)), dense)


def test_boxes_of_very_different_sizes(spark):
    draw = np.random.default_rng(5)
    rows = [(k, *(float(v) for lo, w in zip(draw.random(3) * 10, draw.random(3) * (0.05 if k % 10 else 20), strict=True) for v in (lo, lo + w))) for k in range(120)]
    names = "entity bigint, " + ", ".join(f"{s}_{c} double" for c in "xyz" for s in ("lo", "hi"))
    frame = spark.createDataFrame(rows, names)
    meet = lambda a, b: all(a[1 + 2 * k] <= b[2 + 2 * k] and b[1 + 2 * k] <= a[2 + 2 * k] for k in range(3))
    found = [(r["e0"], r["e1"]) for r in geometry.box_collisions(frame, frame).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a[0], b[0]) for a in rows for b in rows if meet(a, b)}
    points = spark.createDataFrame([(k, *map(float, draw.random(3) * 12)) for k in range(60)], "point bigint, x double, y double, z double")
    inside = {(r["point"], r["entity"]) for r in geometry.points_in_boxes(frame, points).collect()}
    assert inside == {(p["point"], a[0]) for p in points.collect() for a in rows if all(a[1 + 2 * k] <= p["xyz"[k]] <= a[2 + 2 * k] for k in range(3))}


def test_points_beside_a_box_by_comparison_alone(spark):
    """A point a rounding error outside is held with the tolerance only."""
    frame = spark.createDataFrame([(0, 0.0, 12345.6, 0.0, 12345.6, 0.0, 0.0)], "entity bigint, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")
    points = spark.createDataFrame([(0, 1.0, 12345.6, 0.0), (1, 1.0, np.nextafter(12345.6, 2e4).item(), 0.0)], "point bigint, x double, y double, z double")
    assert {r["point"] for r in geometry.points_in_boxes(frame, points).collect()} == {0, 1}
    assert {r["point"] for r in geometry.points_in_boxes(frame, points, rtol=0.0).collect()} == {0}


def test_points_in_boxes_query_is_exact(spark, tmp_path):
    """1.01 and 4.35 times 10 are no decimals; bounds at these decimals decide as SQL's comparison does."""
    spark.createDataFrame([(3, 4.35), (4, 1.01)], "s_suppkey bigint, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(p, q, e) for p, (a, b) in enumerate([(10.0, np.nextafter(4.35 * 10, 0).item()), (0.0, 10.0), (np.nextafter(1.01 * 10, 99).item(), 20.0), (1.01 * 10, 4.35 * 10)]) for q, e in ((0.0, a), (50.0, b))]
    spark.createDataFrame(lines, "l_partkey bigint, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {3: 1, 4: 2}
    assert {r["point"]: r["n"] for r in queries.QUERIES["points_in_boxes"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_counts_of_boxes_by_comparison(spark, adaptive):
    """Ties on corners, boxes without extent or bounds, equal points and points with the same id, in one range or several of each axis."""
    draw = np.random.default_rng(11)
    boxes = [(k, *(float(v) for lo, w in zip(draw.integers(0, 9, 2), draw.integers(0, 5, 2), strict=True) for v in (lo, lo + w))) for k in range(300)]
    boxes += [(300, 2.0, 1.0, 0.0, 9.0), (301, None, 3.0, 0.0, 9.0), (302, 0.0, float("nan"), 0.0, float("inf")), (303, -0.0, 0.0, 0.0, 0.0)]
    frame = spark.createDataFrame(boxes, "entity bigint, lo_x double, hi_x double, lo_y double, hi_y double")
    rows = [(k // 2, *(float(v) for v in draw.integers(-1, 15, 2) / (1 + k % 2))) for k in range(200)] + [(500, -9.0, 3.0), (501, None, 3.0), (502, float("nan"), 3.0), (503, -0.0, 0.0)]
    points = spark.createDataFrame(rows, "point bigint, x double, y double")
    pairs = points.join(frame, F.expr("x between lo_x and hi_x and y between lo_y and hi_y"))
    want = {r["point"]: r["count"] for r in pairs.groupBy("point").count().collect()}
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        found = geometry.counts_in_boxes(frame, points).collect()
        assert len(found) == len(want) and {r["point"]: r["n"] for r in found} == want and {500, 501}.isdisjoint(want) and want[502] == 1
        assert not geometry.counts_in_boxes(frame.where("false"), points).collect() and not geometry.counts_in_boxes(frame, points.where("false")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_points_in_boxes_query_makes_no_pairs(spark, tmp_path):
    """60,000 points in 60,000 boxes each: 3.6 billion pairs, which a join of them works on for minutes."""
    spark.range(60_000).selectExpr("id as s_suppkey", "5.0D as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(120_000).selectExpr("id div 2 as l_partkey", "id % 2 * 60D as l_quantity", "id % 2 * 100D as l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    began, found = time.monotonic(), queries.QUERIES["points_in_boxes"](spark, str(tmp_path)).agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    assert tuple(found) == (60_000, 60_000, 60_000) and time.monotonic() - began < 60


def test_boundary_query_at_the_middle(spark, tmp_path):
    """49 steps of 1 / 98 are less than 0.5; nodes in the middle aren't left of it."""
    spark.range(98 * 98).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    want = {y * 99 + x for y in range(99) for x in range(49) if y in (0, 98) or x == 0}
    assert {r["node"] for r in queries.QUERIES["locate_entities_boundary"](spark, str(tmp_path)).collect()} == want
    middles = generate.rectangle(spark, 49, 49, diagonal="crossed").nodes.where("node >= 2500").collect()
    assert {r["x"] for r in middles} == {r["y"] for r in middles} == {(k + 0.5) / 49 for k in range(49)}


def test_cells_that_points_only_pass_by(spark):
    """Points 1e-9 beyond the diagonal of a square and of its neighbour: the cell on their side has them, though the lower one is near."""
    mesh = generate.rectangle(spark, 2, 1)
    cells = topology.with_points(mesh.cells, "vertices", mesh.nodes, ["cell"], 3)
    rows = [(0, 0.2, 0.4 + 1e-9, 0.0), (1, 0.2, 0.4 - 1e-9, 0.0), (2, 0.7, 0.4 + 1e-9, 0.0), (3, 0.25, 0.5, 0.0)]
    points = spark.createDataFrame(rows, "point bigint, x double, y double, z double")
    owned = geometry.point_ownership(cells, points, most=geometry.ROUNDING)
    assert {r["point"]: r["cell"] for r in owned.collect()} == {0: 1, 1: 0, 2: 3, 3: 0}
    frame = geometry.boxes(cells.select("cell", F.explode("points").alias("p")).select("cell", "p.x", "p.y", "p.z"), "cell")
    hits = geometry.colliding_cells(cells, geometry.points_in_boxes(frame, points), points, geometry.ROUNDING)
    assert {r["point"]: r["cell"] for r in geometry.first_colliding_cell(hits, points).collect()} == {0: 1, 1: 0, 2: 3, 3: 0}


@pytest.mark.parametrize("name", ["point_ownership", "colliding_cells"])
def test_queries_of_points_beside_a_diagonal(spark, tmp_path, name):
    """Of these keys' points 1462 and 16515 are within 1e-6 of a line of the 122 or 300 cells a side; 15,000 or 90,000 rows set the side."""
    for n, key in ((15_000, 1462), (90_000, 16515)):
        spark.range(n).select(F.col("id").alias("c_custkey")).write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
        s = int(n**0.5)
        x, y = (key * c - np.floor(key * c) for c in (0.618033988749895, 0.754877666246693))
        want = (int(y * s) * s + int(x * s)) * 2 + (0 if x * s - int(x * s) >= y * s - int(y * s) else 1)
        assert queries.QUERIES[name](spark, str(tmp_path)).where(F.col("point") == key).collect()[0]["cell"] == want


def test_closest_in_a_crowd(spark):
    """Hundreds of entities to a bucket of the given radius, many at one place: small buckets come first, and the results are those of brute force."""
    draw = np.random.default_rng(3)
    places = [*np.round(draw.random(300) * 40, 2), 500.0, -2000.0]
    rows = [(k, float(places[k % len(places)]), 0.0, 0.0) for k in range(900)]
    entities = spark.createDataFrame(rows, "entity bigint, x double, y double, z double")
    points = spark.createDataFrame([(k, float(x), 0.0, 0.0) for k, x in enumerate([*draw.random(60) * 60, 100.0, 499.0, -900.0, 9000.0])], "point bigint, x double, y double, z double")
    assert geometry.first_radius(entities.dropDuplicates(["x"]), 100.0) < 10
    want = {p["point"]: min(((x - p["x"]) ** 2, k) for k, x, _, _ in rows)[1] for p in points.collect()}
    assert {r["point"]: r["entity"] for r in geometry.closest(entities, points, 100.0).collect()} == want


def test_nearest_points_agree(spark):
    draw = np.random.default_rng(2)
    for k in (1, 2, 3, 4):
        hulls = draw.normal(size=(60, k, 3))
        a = geometry.nearest_in_simplices(hulls)
        b = np.stack([geometry.nearest_point_of_hull(x) for x in hulls])
        assert np.allclose((a**2).sum(axis=1), (b**2).sum(axis=1), atol=1e-9)


def test_second_order_files(spark, tmp_path):
    for form in ("vtk", "gmsh"):
        for cell, n in (("interval", 3), ("triangle", 6), ("quadrilateral", 9), ("tetrahedron", 10), ("hexahedron", 27), ("prism", 18)):
            assert sorted(meta.permutation(cell, n, form)) == list(range(n))
    assert meta.permutation("triangle", 6) == (0, 1, 2, 5, 3, 4)
    assert meta.from_vtk(22) == ("triangle", 2) and meta.vtk_code("hexahedron", 2) == 9
    with pytest.raises(ValueError):
        meta.permutation("triangle", 10)
    mesh = spaces.interpolate_geometry(generate.rectangle(spark, 2, 1), 2)
    path = tmp_path / "m.xdmf"
    path.write_text(files.xdmf_text(mesh))
    again = files.read_xdmf(spark, str(path))
    assert again.degree == 2 and size(again) == pytest.approx(1.0) and files.read_cell_type(spark, str(path)) == ("triangle", 2)
    files.write_mesh(mesh, str(tmp_path / "p"))
    assert size(files.read_mesh(spark, str(tmp_path / "p"))) == pytest.approx(1.0)
    assert "22" in files.vtu_text(mesh)
    tags = topology.exterior_facets(generate.rectangle(spark, 2, 1)).select(F.col("key").alias("vertices"), F.lit(4).alias("value"))
    (tmp_path / "t.xdmf").write_text(files.tags_text(tags, generate.rectangle(spark, 2, 1).nodes, "interval"))
    assert files.read_xdmf_tags(spark, str(tmp_path / "t.xdmf")).where("value = 4").count() == 6
    cells, nodes = files.lagrange_arrays(spaces.functionspace(generate.rectangle(spark, 1, 1), ("P", 2)))
    assert cells.count() == 2 and nodes.count() == 9
    assert files.vtk_arrays(mesh)[0].first()["type"] == 22


def test_submesh_tags_and_hashes(spark):
    mesh = generate.rectangle(spark, 2, 2)
    half, _, nodes = topology.submesh(mesh, topology.locate_entities(mesh, 2, F.col("x") <= 0.5), "triangle")
    tags = topology.exterior_facets(mesh).select("key", F.lit(2).alias("value"))
    assert topology.tags_to_submesh(tags, nodes, half, 1).count() == 4
    same = generate.Mesh(mesh.cell_type, 2, mesh.cells.repartition(3), mesh.nodes.repartition(2))
    assert topology.fingerprint(same).first() == topology.fingerprint(mesh).first() != topology.fingerprint(half).first()
    assert topology.cell_permutation_info(generate.box(spark, 1, 1, 1)).count() == 6
    assert topology.facet_permutations(mesh).where("code = 1").count() == topology.edge_reflections(mesh).where("reflected").count()
    closure = topology.entity_geometry(spaces.interpolate_geometry(mesh, 2), 1, topology.exterior_facets(mesh).select("key").limit(0))
    assert closure.count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "w")
    assert not store.has_dataset("x")
    store.write_dataset("x", spark.range(10).select("id", (F.col("id") * 2).alias("v")))
    assert store.has_dataset("x") and store.read_dataset("x", "id", 2, 5, {"v": "double"}).agg(F.sum("v")).first()[0] == 18.0
    store.set_attribute("x", "units", [1, "m"])
    assert store.attributes("x") == {"units": [1, "m"]} and store.attributes("y") == {}
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path / "s"), "r").write_dataset("x", spark.range(1))


def test_timers(spark):
    with timing.Timer("work"):
        pass

    @timing.timed("work")
    def work():
        return 3

    assert work() == 3 and timing.timing("work")[0] == 2
    assert timing.timings(spark).where("task = 'work'").first()["reps"] == 2
    with pytest.raises(KeyError):
        timing.timing("nothing")
    timer = timing.Timer()
    assert timer.stop() <= timer.elapsed() and not timing.FEATURES["hdf5"]
