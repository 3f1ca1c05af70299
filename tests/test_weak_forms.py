"""Forms by quadrature on all cell types against known integrals, and spaces against counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import cells as meta
from meshwright.functions.elements import CORNERS, CoordinateElement, corners, element, mixed, quadrature
from meshwright.operators import assembly, solvers, spaces, topology
from meshwright.plans import weak
from meshwright.plans.weak import Curl, Normal, Position, TestFunction, TrialFunction, avg, dP, div, dot, dS, ds, dx, grad, inner, jump
from meshwright.sources import generate


def meshes(spark):
    return {
        "interval": generate.interval(spark, 4), "triangle": generate.rectangle(spark, 3, 2), "quadrilateral": generate.rectangle(spark, 3, 2, "quadrilateral"),
        "tetrahedron": generate.box(spark, 2, 1, 1), "hexahedron": generate.box(spark, 2, 1, 1, "hexahedron"), "prism": generate.box(spark, 2, 1, 1, "prism"),
    }


def number(form):
    return weak.assemble(form).first()["v"]


def test_quadrature_and_elements():
    from math import factorial as f

    for d in range(8):
        p, w = quadrature("tetrahedron", d)
        for a in range(d + 1):
            for b in range(d + 1 - a):
                c = d - a - b
                assert (w * p[:, 0] ** a * p[:, 1] ** b * p[:, 2] ** c).sum() == pytest.approx(f(a) * f(b) * f(c) / f(d + 3))
    for cell in CORNERS:
        if cell == "point":
            continue
        for p in (1,) if cell == "pyramid" else (1, 2, 3):
            e = element("Lagrange", cell, p)
            assert meta.degree(cell, e.size) == p and np.allclose(e.tabulate(e.points)[0], np.eye(e.size), atol=1e-9)
            table = e.tabulate(quadrature(cell, 3)[0], 1)
            assert np.allclose(table[0].sum(axis=1), 1) and np.allclose(table[1:].sum(axis=2), 0, atol=1e-9)
    for bad in (("Lagrange", "triangle", 0), ("RT", "triangle", 2), ("RT", "quadrilateral", 1), ("Lagrange", "pyramid", 2), ("none", "triangle", 1)):
        with pytest.raises(ValueError):
            element(*bad)


def test_pull_back_of_a_bent_cell():
    map_, draw = CoordinateElement("quadrilateral"), np.random.default_rng(1)
    nodes = corners("quadrilateral")[None] + 0.2 * draw.random((5, 4, 2))
    x = draw.random((5, 2))
    at = np.stack([map_.push_forward(nodes[k : k + 1], x[k : k + 1])[0, 0] for k in range(5)])
    assert np.allclose(map_.pull_back(nodes, at, 1e-12, 30), x)
    with pytest.raises(ArithmeticError):
        map_.pull_back(nodes, at, 0.0, 2)


@pytest.mark.parametrize("cell", ["interval", "triangle", "quadrilateral", "tetrahedron", "hexahedron", "prism"])
def test_mass_stiffness_and_functionals(spark, cell):
    mesh = meshes(spark)[cell]
    d = meta.DIM[cell]
    x = Position()
    one = spaces.Constant.of(1.0)
    assert number((weak.lift(one) * dx).on(mesh)) == pytest.approx(1.0)
    assert number((x[0] ** 2 * dx).on(mesh)) == pytest.approx(1 / 3)
    assert number((weak.lift(one) * ds).on(mesh)) == pytest.approx(2.0 * d)
    assert number((dot(x, Normal()) * ds).on(mesh)) == pytest.approx(d)  # the divergence of x
    assert number((x[0] * dP).on(mesh)) == pytest.approx(mesh.nodes.agg(F.sum("x")).first()[0])
    for p in (1, 2):
        space = spaces.functionspace(mesh, ("Lagrange", p))
        n = space.tabulate_dof_coordinates().select("x", "y", "z").distinct().count()
        assert n == space.size == space.tabulate_dof_coordinates().count()
        u, v = TrialFunction(space), TestFunction(space)
        m = weak.assemble(u * v * dx)
        assert m.agg(F.sum("v")).first()[0] == pytest.approx(1.0)
        f = spaces.interpolate(space, 1 + F.col("x") ** p)
        a = weak.assemble(inner(grad(u), grad(v)) * dx)
        energy = a.join(f.values.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").join(f.values.select("i", F.col("v").alias("t")), "i").agg(F.sum(F.expr("v * w * t"))).first()[0]
        assert energy == pytest.approx(1.0 if p == 1 else 4 / 3)
        assert number(weak.Field(f) * dx) == pytest.approx(1.5 if p == 1 else 4 / 3)
        assert number(inner(jump(grad(f)[0]), jump(grad(f)[0])) * dS) == pytest.approx(0.0 if p == 1 or cell in ("quadrilateral", "hexahedron", "prism") else 0.0, abs=1e-9)


def test_p1_forms_agree_with_the_affine_path(spark):
    mesh = generate.rectangle(spark, 4, 3)
    space = spaces.functionspace(mesh, ("P", 1))
    table = space.tabulate_dof_coordinates().join(mesh.nodes.select("node", F.col("x").alias("a"), F.col("y").alias("b")), F.expr("abs(x - a) < 1e-9 and abs(y - b) < 1e-9")).select("dof", "node")
    own = {(r["i"], r["j"]): r["v"] for r in weak.assemble(inner(grad(TrialFunction(space)), grad(TestFunction(space))) * dx).collect()}
    node = {r["dof"]: r["node"] for r in table.collect()}
    other = {(r["i"], r["j"]): r["v"] for r in assembly.assembled(assembly.stiffness_entries(mesh)).collect()}
    assert {(node[i], node[j]): pytest.approx(v, abs=1e-12) for (i, j), v in own.items()} == other


def test_high_degree_dofs_agree_across_facets(spark):
    for cell in ("tetrahedron", "hexahedron"):
        space = spaces.functionspace(meshes(spark)[cell], ("Lagrange", 4 if cell == "tetrahedron" else 3))
        at = space.tabulate_dof_coordinates().select(*(F.round(c, 9).alias(c) for c in "xyz"))
        assert at.distinct().count() == space.size


def test_interior_facets(spark):
    mesh = generate.rectangle(spark, 3, 2)
    space = spaces.functionspace(mesh, ("DG", 1))
    u, v = TrialFunction(space), TestFunction(space)
    f = spaces.interpolate(space, F.col("x"))
    assert number(weak.lift(1.0)("+") * jump(weak.Field(f)) ** 2 * dS) == pytest.approx(0, abs=1e-12)
    length = 2 + 2 * 1 + (3 * 2) * (1 / 9 + 1 / 4) ** 0.5 - 1  # inner lines and diagonals
    assert number((weak.lift(1.0) * dS).on(mesh)) == pytest.approx(length)
    a = weak.assemble(inner(jump(u), jump(v)) * dS)
    b = weak.assemble(jump(v) * avg(weak.Field(f)) * dS)
    both = a.join(f.values.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    assert both.agg(F.max(F.abs("v"))).first()[0] == pytest.approx(0, abs=1e-12)  # no jumps
    assert b.agg(F.sum("v")).first()[0] == pytest.approx(0, abs=1e-12)
    assert weak.sparsity(inner(jump(u), jump(v)) * dS).count() >= a.count()
    with pytest.raises(Exception, match="side"):
        weak.assemble(u * v * dS).count()


def test_vector_elements(spark):
    mesh = generate.box(spark, 2, 1, 1)
    for family, d, field in (("N1curl", 1, [-F.col("y"), F.col("x"), F.lit(0.0)]), ("RT", 2, [F.col("x"), F.col("y"), F.col("z")])):
        space = spaces.functionspace(mesh, (family, 1))
        assert space.size == topology.cell_entities(mesh, d).select("key").distinct().count()
        f = weak.Field(spaces.interpolate(space, field))
        if family == "N1curl":
            assert number(weak.curl(f)[2] * dx) == pytest.approx(2.0)
            assert number(inner(f, f) * dx) == pytest.approx(2 / 3)
        else:
            assert number(div(f) * dx) == pytest.approx(3.0)
            assert number(dot(f, Normal()) * ds) == pytest.approx(3.0)
            normal = weak.dot(f("+"), Normal()("+")) + weak.dot(f("-"), Normal()("-"))
            assert number(normal * normal * dS) == pytest.approx(0, abs=1e-12)  # the flux is continuous
        v = TestFunction(space)
        assert weak.assemble(inner(Curl(v) if family == "N1curl" else div(v), Curl(v) if family == "N1curl" else weak.lift(1.0)) * dx if family == "N1curl" else div(v) * dx).count() == space.size


def test_blocked_and_mixed_spaces(spark):
    mesh = generate.rectangle(spark, 2, 2)
    vector = spaces.functionspace(mesh, ("P", 2, (2,)))
    assert vector.size == 2 * 25
    f = spaces.interpolate(vector, [F.col("x"), 2 * F.col("y")])
    assert number(div(weak.Field(f)) * dx) == pytest.approx(3.0)
    assert number(inner(weak.sym(grad(f)), grad(f)) * dx) == pytest.approx(5.0)
    assert [s.values.count() for s in f.split()] == [25, 25]
    assert number(weak.Field(f.split()[1]) * dx) == pytest.approx(1.0)
    tensor = spaces.functionspace(mesh, ("P", 1, (2, 2), True))
    assert tensor.size == 27
    t = spaces.interpolate(tensor, [F.col("x"), F.lit(3.0), F.col("y")])
    assert number(weak.Field(t)[0, 1] * dx) == pytest.approx(3.0) and number(weak.tr(weak.Field(t)) * dx) == pytest.approx(1.0)
    both = spaces.functionspace(mesh, mixed(element("P", "triangle", 2, (2,)), element("P", "triangle", 1)))
    assert both.size == 50 + 9
    (u, p), (v, q) = weak.TrialFunctions(both), weak.TestFunctions(both)
    stokes = inner(grad(u), grad(v)) * dx - p * div(v) * dx - q * div(u) * dx
    a = weak.assemble(stokes)
    swapped = a.join(a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w")), ["i", "j"], "full")
    assert swapped.agg(F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))))).first()[0] == pytest.approx(0, abs=1e-12)
    _, table = both.sub(1).collapse()
    assert sorted(r["parent"] for r in table.collect()) == list(range(50, 59))
    assert both.contains(both.sub(0)) and not both.contains(vector)


def test_dofs_on_the_boundary(spark):
    mesh = generate.rectangle(spark, 3, 2)
    space = spaces.functionspace(mesh, ("P", 2))
    geometrical = spaces.locate_dofs_geometrical(space, F.col("x") < 1e-9)
    left = topology.locate_entities_boundary(mesh, 1, F.col("x") < 1e-9)
    topological = spaces.locate_dofs_topological(space, 1, left)
    assert {r["dof"] for r in geometrical.collect()} == {r["dof"] for r in topological.collect()} and geometrical.count() == 5
    vector = spaces.functionspace(mesh, ("P", 1, (2,)))
    own = spaces.locate_dofs_topological(vector.sub(1), 1, left)
    bc = spaces.dirichletbc(F.col("y"), own, vector.sub(1))
    assert all(r["dof"] % 2 == 1 for r in bc.collect()) and sorted(round(r["g"], 9) for r in bc.collect()) == [0, 0.5, 1]
    assert spaces.mark_dofs(vector, bc).where("marked").count() == 3
    assert [len(x) for x in spaces.bcs_by_block([space, vector], [(vector.sub(1), bc)])] == [0, 1]


def test_problems(spark):
    mesh = generate.rectangle(spark, 3, 3)
    space = spaces.functionspace(mesh, ("P", 2))
    u, v = TrialFunction(space), TestFunction(space)
    exact = 1 + F.col("x") ** 2 + 2 * F.col("y") ** 2
    edge = spaces.locate_dofs_topological(space, 1, topology.exterior_facets(mesh).select("key"))
    bc = spaces.dirichletbc(exact, edge, space)
    found, _ = weak.solve(inner(grad(u), grad(v)) * dx, weak.lift(-6.0) * v * dx, bc)
    want = spaces.interpolate(space, exact).values.withColumnRenamed("v", "w")
    assert found.values.join(want, "i").agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] < 1e-7
    points = spark.createDataFrame([(0, 0, 0.3, 0.02, 0.0), (1, -1, 9.0, 9.0, 0.0)], "point int, cell bigint, x double, y double, z double")
    assert {r["point"]: r["v"] for r in found.eval(points).collect()} == {0: [pytest.approx(1.0908, abs=1e-6)], 1: [0.0]}
    # -div((1 + w^2) grad w) = f with w = 1 + x + 2y, for which f = -10 w
    small = spaces.functionspace(generate.rectangle(spark, 2, 2), ("P", 1))
    w = spaces.Function(small, spaces.zeros(small))
    x = Position()
    linear = 1 + x[0] + 2 * x[1]
    t = TestFunction(small)
    field = weak.Field(w)
    residual = (1 + field * field) * inner(grad(field), grad(t)) * dx + 10 * linear * t * dx
    edge = spaces.locate_dofs_topological(small, 1, topology.exterior_facets(small.mesh).select("key"))
    bc = spaces.dirichletbc(1 + F.col("x") + 2 * F.col("y"), edge, small)
    solved, steps = weak.solve_nonlinear(residual, w, bc, linear=solvers.direct)
    assert 1 < steps < 12
    middle = {r["i"]: r["v"] for r in solved.values.collect()}
    assert max(middle.values()) == pytest.approx(4.0)
    blocks = weak.derivative_block([residual], [w])
    assert blocks[0][0].rank == 2 and weak.extract_function_spaces(blocks) == [small]


def test_tags_and_domains(spark):
    mesh = generate.rectangle(spark, 4, 4)
    space = spaces.functionspace(mesh, ("P", 1))
    half = topology.locate_entities(mesh, 2, F.col("x") <= 0.5)
    cells = topology.cell_entities(mesh, 2).join(half, "key").select("cell", F.lit(7).alias("value"))
    v = TestFunction(space)
    assert weak.assemble(v * dx(7, cells)).agg(F.sum("v")).first()[0] == pytest.approx(0.5)
    top = topology.locate_entities(mesh, 1, F.col("y") > 0.999).select("key", F.lit(3).alias("value"))
    inside = topology.locate_entities(mesh, 1, F.col("y") == 0.5).select("key", F.lit(3).alias("value"))
    facets = top.union(inside)
    assert weak.assemble(v * ds(3, facets)).agg(F.sum("v")).first()[0] == pytest.approx(1.0)  # those inside don't count
    assert number((weak.lift(1.0) * dS(3, facets)).on(mesh)) == pytest.approx(1.0)
    assert number((weak.lift(1.0) * ds((3, 4), facets)).on(mesh)) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        weak.assemble(v * dx(7))


def test_interpolation_between_spaces(spark):
    mesh = generate.rectangle(spark, 2, 2, "quadrilateral")
    one, two = spaces.functionspace(mesh, ("Q", 1)), spaces.functionspace(mesh, ("Q", 2))
    f = spaces.interpolate(one, F.col("x") * F.col("y"))
    g = spaces.interpolate_function(two, f)
    assert g.values.count() == 25 and number(weak.Field(g) * dx) == pytest.approx(0.25)
    m = spaces.interpolation_matrix(two, one)
    again = m.join(f.values.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    assert again.join(g.values.withColumnRenamed("v", "t"), "i").agg(F.max(F.abs(F.col("v") - F.col("t")))).first()[0] < 1e-12
    x = Position()
    h = weak.interpolate_expression(two, x[0] * x[0] + weak.Field(f))
    assert number(weak.Field(h) * dx) == pytest.approx(1 / 3 + 0.25)
    dg = spaces.functionspace(mesh, ("DG", 0))
    assert dg.element.is_cellwise and weak.interpolate_expression(dg, grad(f)[0]).values.count() == 4
    curved = spaces.interpolate_geometry(generate.rectangle(spark, 2, 2), 2)
    assert curved.nodes.count() == 25 and number((x[0] * dx).on(curved)) == pytest.approx(0.5)


def test_blocks(spark):
    """Two fields that know of each other: u = x y projected, and p = u + 1 by a second equation."""
    mesh = generate.rectangle(spark, 2, 2)
    one, two = spaces.functionspace(mesh, ("P", 2)), spaces.functionspace(mesh, ("P", 2))
    u, v, p, q = TrialFunction(one), TestFunction(one), TrialFunction(two), TestFunction(two)
    x = Position()
    found = weak.solve_blocks([[u * v * dx, None], [-u * q * dx, p * q * dx]], [x[0] * x[1] * v * dx, weak.lift(1.0) * q * dx], [None, None], linear=solvers.direct)
    want = spaces.interpolate(one, F.col("x") * F.col("y") + 1).values.withColumnRenamed("v", "w")
    assert found[1].values.join(want, "i").agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] < 1e-9
    again = weak.assign(weak.joined(found), found)
    assert sorted(map(tuple, again[1].values.collect())) == sorted(map(tuple, found[1].values.collect()))
    field = spaces.Function(one, spaces.zeros(one))
    residual = (weak.Field(field) * v - x[0] * x[1] * v) * dx
    none = spark.createDataFrame([], "dof bigint, g double")
    step = solvers.direct(weak.assemble_jacobian(residual, field, none), weak.assemble_residual(residual, field, none))
    exact = spaces.interpolate(one, -F.col("x") * F.col("y")).values.withColumnRenamed("v", "w")
    assert step.join(exact, "i").agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] < 1e-9


@pytest.mark.parametrize("cell", ["triangle", "quadrilateral"])
def test_meshes_and_dofs_stay_off_the_driver(spark, cell):
    """No join sends a table of a mesh or of dofs through the driver, however small Spark takes it for."""
    mesh = generate.rectangle(spark, 5, 4, cell)
    space = spaces.functionspace(mesh, ("P" if cell == "triangle" else "Q", 2))
    keys = topology.cell_entities(mesh, 1).select("key").distinct()
    f = spaces.interpolate(space, F.col("x"))
    made = [topology.midpoints(keys, mesh.nodes), topology.diameters(keys, mesh.nodes), topology.locate_entities(mesh, 1, F.col("x") < 0.5), space.tabulate_dof_coordinates(), f.packed()]
    made += [weak.assemble(TrialFunction(space) * TestFunction(space) * dx), weak.assemble(weak.lift(1.0) * TestFunction(space) * ds)]
    for df in made:
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["evaluate_field", "point_ownership", "colliding_cells"])
def test_points_from_files_stay_off_the_driver(spark, sf_dir, name):
    """Points of a small file may be millions of rows; no join sends them through the driver."""
    from meshwright.queries import QUERIES

    assert "Broadcast" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
