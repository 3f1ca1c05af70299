"""Mesh files: XDMF with inline numbers, Gmsh text files, VTU output, and Parquet snapshots.

Files are read through Spark, so they may be in any store that it reaches.
The text formats hold small meshes as one file; Parquet is the format of large ones.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import cells as meta
from meshwright.sources.generate import Mesh, from_arrays

#: Rows of a mesh that the text formats write or read; they are one file, made on the driver.
TEXT_MOST = 1_000_000
CELLS, NODES = "cell bigint, vertices array<bigint>", "node bigint, x double, y double, z double"


def _whole(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _mesh(spark: SparkSession, cell_type: str, gdim: int, cells: list[list[int]], nodes: list[tuple[int, list[float]]]) -> Mesh:
    rows = [(k, *(p + [0.0] * (3 - len(p)))) for k, p in nodes]
    degree = meta.degree(cell_type, len(cells[0])) if cells else 1
    return from_arrays(cell_type, gdim, spark.createDataFrame(list(enumerate(cells)), CELLS), spark.createDataFrame(rows, NODES), degree)


def _small(rows: DataFrame, order: str) -> list:
    """All rows in order, for a text file; more than TEXT_MOST are an error."""
    found = rows.orderBy(order).limit(TEXT_MOST + 1).collect()
    if len(found) > TEXT_MOST:
        raise ValueError(f"text files are for {TEXT_MOST} rows at most; use write_mesh()")
    return found


def _grid(root: ET.Element, name: str | None) -> ET.Element:
    for grid in root.iter("Grid"):
        if grid.find("Topology") is not None and name in (None, grid.get("Name")):
            return grid
    raise ValueError(f"no grid named {name}" if name else "no grid")


def _numbers(item: ET.Element, kind: type) -> list[list]:
    if item.get("Format", "XML") != "XML":
        raise ValueError("only inline numbers are read; there is no HDF5 library here")
    width = int(item.get("Dimensions", "1").split()[-1]) if " " in item.get("Dimensions", "") else 1
    flat = [kind(x) for x in (item.text or "").split()]
    return [flat[k : k + width] for k in range(0, len(flat), width)]


#: Names of second-order cells in XDMF, such as Tri_6, by their first part.
XDMF_SHORT = {"edge": "polyline", "tri": "triangle", "quad": "quadrilateral", "tet": "tetrahedron", "hex": "hexahedron"}


def read_cell_type(spark: SparkSession, path: str, name: str | None = None) -> tuple[str, int]:
    """(cell type, degree) of a grid."""
    topology = _grid(ET.fromstring(_whole(spark, path)), name).find("Topology")
    kind = topology.get("TopologyType", "").lower().split("_")
    cell = meta.XDMF_NAME[XDMF_SHORT.get(kind[0], kind[0])]
    return cell, meta.degree(cell, int(kind[1])) if len(kind) > 1 else 1


def read_xdmf(spark: SparkSession, path: str, name: str | None = None) -> Mesh:
    """The mesh of a grid with inline topology and geometry."""
    grid = _grid(ET.fromstring(_whole(spark, path)), name)
    topology, geometry = grid.find("Topology"), grid.find("Geometry")
    kind = topology.get("TopologyType", "").lower().split("_")[0]
    cell_type = meta.XDMF_NAME[XDMF_SHORT.get(kind, kind)]
    listed = _numbers(topology.find("DataItem"), int)
    order = meta.inverse(meta.permutation(cell_type, len(listed[0]))) if listed else ()
    rows = [[row[k] for k in order] for row in listed]
    points = _numbers(geometry.find("DataItem"), float)
    return _mesh(spark, cell_type, len(points[0]) if points else 0, rows, list(enumerate(points)))


def read_xdmf_tags(spark: SparkSession, path: str, attribute: str | None = None) -> DataFrame:
    """(vertices, value) of a grid's attribute, by the vertices of its cells."""
    root = ET.fromstring(_whole(spark, path))
    for grid in root.iter("Grid"):
        for a in grid.findall("Attribute"):
            if attribute in (None, a.get("Name")) and grid.find("Topology") is not None:
                cells = _numbers(grid.find("Topology").find("DataItem"), int)
                values = [r[0] for r in _numbers(a.find("DataItem"), float)]
                return spark.createDataFrame([(c, v) for c, v in zip(cells, values, strict=True)], "vertices array<bigint>, value double")
    raise ValueError("no such attribute")


def read_information(spark: SparkSession, path: str) -> dict[str, str]:
    return {i.get("Name", ""): i.get("Value", "") for i in ET.fromstring(_whole(spark, path)).iter("Information")}


def xdmf_text(mesh: Mesh, name: str = "mesh", field: DataFrame | None = None, information: dict[str, str] | None = None) -> str:
    """A small mesh, and a nodal field, as XDMF with inline numbers."""
    nodes = _small(mesh.nodes, "node")
    at = {r["node"]: k for k, r in enumerate(nodes)}
    listed = [r[mesh.geometry] for r in _small(mesh.cells, "cell")]
    order = meta.permutation(mesh.cell_type, len(listed[0]) if listed else None)
    cells = [[at[c[k]] for k in order] for c in listed]
    root = ET.Element("Xdmf", Version="3.0")
    domain = ET.SubElement(root, "Domain")
    for key, value in (information or {}).items():
        ET.SubElement(domain, "Information", Name=key, Value=value)
    grid = ET.SubElement(domain, "Grid", Name=name, GridType="Uniform")
    kind = next(k for k, v in meta.XDMF_NAME.items() if v == mesh.cell_type)
    if mesh.degree > 1:
        kind = f"{next((k for k, v in XDMF_SHORT.items() if v == kind), kind)}_{len(order)}"
    topology = ET.SubElement(grid, "Topology", TopologyType=kind.capitalize(), NumberOfElements=str(len(cells)), NodesPerElement=str(len(order)))
    ET.SubElement(topology, "DataItem", Dimensions=f"{len(cells)} {len(order)}", NumberType="Int", Format="XML").text = "\n".join(" ".join(map(str, c)) for c in cells)
    geometry = ET.SubElement(grid, "Geometry", GeometryType="XYZ" if mesh.gdim == 3 else "XY")
    gdim = max(2, mesh.gdim)
    ET.SubElement(geometry, "DataItem", Dimensions=f"{len(nodes)} {gdim}", Format="XML").text = "\n".join(" ".join(repr(r[c]) for c in "xyz"[:gdim]) for r in nodes)
    if field is not None:
        values = {r["i"]: r["v"] for r in _small(field, "i")}
        attribute = ET.SubElement(grid, "Attribute", Name="f", AttributeType="Scalar", Center="Node")
        ET.SubElement(attribute, "DataItem", Dimensions=f"{len(nodes)} 1", Format="XML").text = "\n".join(repr(values[r["node"]]) for r in nodes)
    return ET.tostring(root, encoding="unicode")


def vtu_text(mesh: Mesh, field: DataFrame | None = None) -> str:
    """A small mesh, and a nodal field, as VTU with inline numbers."""
    nodes = _small(mesh.nodes, "node")
    at = {r["node"]: k for k, r in enumerate(nodes)}
    listed = [r[mesh.geometry] for r in _small(mesh.cells, "cell")]
    order = meta.permutation(mesh.cell_type, len(listed[0]) if listed else None)
    cells = [[at[c[k]] for k in order] for c in listed]
    root = ET.Element("VTKFile", type="UnstructuredGrid", version="0.1")
    piece = ET.SubElement(ET.SubElement(root, "UnstructuredGrid"), "Piece", NumberOfPoints=str(len(nodes)), NumberOfCells=str(len(cells)))

    def array(parent: ET.Element, kind: str, name: str, values: list, **more: str) -> None:
        ET.SubElement(parent, "DataArray", type=kind, Name=name, format="ascii", **more).text = " ".join(map(str, values))

    array(ET.SubElement(piece, "Points"), "Float64", "Points", [r[c] for r in nodes for c in "xyz"], NumberOfComponents="3")
    body = ET.SubElement(piece, "Cells")
    array(body, "Int64", "connectivity", [v for c in cells for v in c])
    array(body, "Int64", "offsets", [len(order) * (k + 1) for k in range(len(cells))])
    array(body, "UInt8", "types", [meta.vtk_code(mesh.cell_type, None, mesh.degree)] * len(cells))
    if field is not None:
        values = {r["i"]: r["v"] for r in _small(field, "i")}
        array(ET.SubElement(piece, "PointData"), "Float64", "f", [values[r["node"]] for r in nodes])
    return ET.tostring(root, encoding="unicode")


def read_msh(spark: SparkSession, path: str, gdim: int = 3) -> tuple[Mesh, dict[str, DataFrame], dict[str, tuple[int, int]]]:
    """From a Gmsh text file (format 4 or 2): the mesh of the highest dimension, tags (vertices, value) by cell type, and physical groups by name."""
    lines = _whole(spark, path).splitlines()
    parts: dict[str, list[list[str]]] = {}
    at = 0
    while at < len(lines):
        if lines[at].startswith("$") and not lines[at].startswith("$End"):
            name, start = lines[at][1:].strip(), at + 1
            while not lines[at].startswith("$End"):
                at += 1
            parts[name] = [x.split() for x in lines[start:at] if x.strip()]
        at += 1
    groups = {" ".join(g[2:]).strip('"'): (int(g[0]), int(g[1])) for g in parts.get("PhysicalNames", [])[1:]}
    nodes, elements = (_msh4 if float(parts["MeshFormat"][0][0]) >= 4 else _msh2)(parts)
    names = {code: cell for table in (meta.GMSH_CODE, meta.GMSH_CODE_2) for cell, code in table.items()}
    number = {tag: k for k, tag in enumerate(sorted(nodes))}
    by_type: dict[str, list[tuple[list[int], int]]] = {}
    for code, tag, vertices in elements:
        cell = names[code]
        order = meta.inverse(meta.permutation(cell, len(vertices), "gmsh"))
        by_type.setdefault(cell, []).append(([number[vertices[k]] for k in order], tag))
    top = max(by_type, key=lambda c: meta.DIM[c])
    mesh = _mesh(spark, top, gdim, [v for v, _ in by_type[top]], [(number[t], p) for t, p in sorted(nodes.items())])
    tags = {cell: spark.createDataFrame(rows, "vertices array<bigint>, value int") for cell, rows in by_type.items()}
    return mesh, tags, groups


def _msh2(parts: dict) -> tuple[dict, list]:
    nodes = {int(r[0]): [float(x) for x in r[1:4]] for r in parts["Nodes"][1:]}
    elements = []
    for r in parts["Elements"][1:]:
        n = int(r[2])
        elements.append((int(r[1]), int(r[3]) if n else 0, [int(x) for x in r[3 + n :]]))
    return nodes, elements


def _msh4(parts: dict) -> tuple[dict, list]:
    nodes: dict[int, list[float]] = {}
    rows = parts["Nodes"]
    at = 1
    for _ in range(int(rows[0][0])):
        n = int(rows[at][3])
        for k in range(n):
            nodes[int(rows[at + 1 + k][0])] = [float(x) for x in rows[at + 1 + n + k][:3]]
        at += 1 + 2 * n
    physical: dict[tuple[int, int], int] = {}
    if rows := parts.get("Entities"):
        counts, at = [int(x) for x in rows[0]], 1
        for dim, count in enumerate(counts):
            for _ in range(count):
                k = 4 if dim == 0 else 7
                if int(rows[at][k]):
                    physical[(dim, int(rows[at][0]))] = int(rows[at][k + 1])
                at += 1
    elements, rows, at = [], parts["Elements"], 1
    for _ in range(int(rows[0][0])):
        dim, tag, code, n = (int(x) for x in rows[at][:4])
        for k in range(n):
            elements.append((code, physical.get((dim, tag), 0), [int(x) for x in rows[at + 1 + k][1:]]))
        at += 1 + n
    return nodes, elements


def tags_text(tags: DataFrame, nodes: DataFrame, cell_type: str, name: str = "tags") -> str:
    """Small tags (vertices, value) with their nodes as an XDMF grid whose cells are the tagged entities; read_xdmf_tags() reads it."""
    placed = _small(nodes, "node")
    at = {r["node"]: k for k, r in enumerate(placed)}
    rows = _small(tags.select("vertices", "value"), "vertices")
    order = meta.permutation(cell_type)
    root = ET.Element("Xdmf", Version="3.0")
    grid = ET.SubElement(ET.SubElement(root, "Domain"), "Grid", Name=name, GridType="Uniform")
    kind = next(k for k, v in meta.XDMF_NAME.items() if v == cell_type)
    topology = ET.SubElement(grid, "Topology", TopologyType=kind.capitalize(), NumberOfElements=str(len(rows)), NodesPerElement=str(len(order)))
    ET.SubElement(topology, "DataItem", Dimensions=f"{len(rows)} {len(order)}", NumberType="Int", Format="XML").text = "\n".join(" ".join(str(at[r["vertices"][k]]) for k in order) for r in rows)
    _geometry(grid, placed, 3)
    attribute = ET.SubElement(grid, "Attribute", Name=name, AttributeType="Scalar", Center="Cell")
    ET.SubElement(attribute, "DataItem", Dimensions=f"{len(rows)} 1", Format="XML").text = "\n".join(str(r["value"]) for r in rows)
    return ET.tostring(root, encoding="unicode")


def _geometry(grid: ET.Element, placed: list, gdim: int) -> None:
    geometry = ET.SubElement(grid, "Geometry", GeometryType="XYZ" if gdim == 3 else "XY")
    ET.SubElement(geometry, "DataItem", Dimensions=f"{len(placed)} {gdim}", Format="XML").text = "\n".join(" ".join(repr(r[c]) for c in "xyz"[:gdim]) for r in placed)


def geometry_text(nodes: DataFrame, name: str = "geometry") -> str:
    """Small nodes alone as an XDMF grid without cells."""
    root = ET.Element("Xdmf", Version="3.0")
    grid = ET.SubElement(ET.SubElement(root, "Domain"), "Grid", Name=name, GridType="Uniform")
    _geometry(grid, _small(nodes, "node"), 3)
    return ET.tostring(root, encoding="unicode")


def collection_text(pieces: dict[float, str]) -> str:
    """A PVD collection of VTU files by time."""
    root = ET.Element("VTKFile", type="Collection", version="0.1")
    body = ET.SubElement(root, "Collection")
    for t, file in sorted(pieces.items()):
        ET.SubElement(body, "DataSet", timestep=repr(t), part="0", file=file)
    return ET.tostring(root, encoding="unicode")


def write_mesh(mesh: Mesh, path: str) -> None:
    """Both tables as Parquet; any size, any degree."""
    mesh.cells.write.mode("overwrite").parquet(f"{path}/cells")
    mesh.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    about = mesh.cells.sparkSession.createDataFrame([(mesh.cell_type, mesh.gdim, mesh.degree)], "cell_type string, gdim int, degree int")
    about.write.mode("overwrite").parquet(f"{path}/about")


def read_mesh(spark: SparkSession, path: str) -> Mesh:
    about = spark.read.parquet(f"{path}/about").first()
    return Mesh(about["cell_type"], about["gdim"], spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/nodes"), about["degree"])


def write_mixed(meshes: list[Mesh], path: str) -> None:
    """Meshes of several cell types over the same nodes, in folders by type."""
    for m in meshes:
        write_mesh(m, f"{path}/{m.cell_type}")


def read_mixed(spark: SparkSession, path: str, cell_types: list[str]) -> list[Mesh]:
    return [read_mesh(spark, f"{path}/{c}") for c in cell_types]


def write_tags(tags: DataFrame, path: str) -> None:
    """Tags (vertices or entity or cell, value) of any size as Parquet."""
    tags.write.mode("overwrite").parquet(path)


def vtk_arrays(mesh: Mesh, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cell, type, nodes in the order of VTK) and (node, x, y, z): what plotting tools take; of some cells only, if given."""
    rows = mesh.cells if cells is None else mesh.cells.join(cells.select("cell"), "cell", "left_semi")
    n = sum(1 for _ in meta.permutation(mesh.cell_type)) if mesh.degree == 1 else None
    order = meta.permutation(mesh.cell_type, n or _nodes_of(mesh))
    return rows.select("cell", F.lit(meta.vtk_code(mesh.cell_type, None, mesh.degree)).alias("type"), F.array(*(F.col(mesh.geometry)[k] for k in order)).alias("nodes")), mesh.nodes


def _nodes_of(mesh: Mesh) -> int:
    from meshwright.functions.elements import FiniteElement

    return FiniteElement("Lagrange", mesh.cell_type, mesh.degree).size


def lagrange_arrays(space) -> tuple[DataFrame, DataFrame]:
    """(cell, type, nodes) and (node, x, y, z) of a Lagrange space of degree 1 or 2: its dofs as nodes, for output at its own points."""
    order = meta.permutation(space.mesh.cell_type, space.element.size)
    rows = space.dofmap.select("cell", F.lit(meta.vtk_code(space.mesh.cell_type, None, space.element.degree)).alias("type"), F.array(*(F.col("dofs")[k] for k in order)).alias("nodes"))
    return rows, space.tabulate_dof_coordinates().withColumnRenamed("dof", "node")


def distribute_entity_data(numbered: DataFrame, data: DataFrame) -> DataFrame:
    """(entity, value) of rows keyed by the vertices in any order; those of no entity go."""
    return data.select(F.array_sort("vertices").alias("key"), "value").join(numbered, "key").select("entity", "value")
