"""Text formats: particles (.ptl), partitions (.ptn, .cpn), Gmsh meshes, and a VTK sink."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.operators.mesh import Mesh
from tesselark.operators.particles import distribute, per_element
from tesselark.storage import carried_forward, cut, fetched, numbered


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """at (a line's number among those that are not blank, from 0) and its fields. A folder of part files is read in the order of their names."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    fields = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    return numbered(rows.select(fields.alias("f"), "name", "block", "row").where(F.size("f") > 0), ["name", "block", "row"], "at").select("at", "f")


def write_lines(lines: DataFrame, order: list[str], path: str, one_file: bool = False) -> None:
    """The column value as text in order: range-partitioned part files whose names follow the order, or one file if that is asked for."""
    dealt = lines.coalesce(1).sortWithinPartitions(*order) if one_file else lines.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order)
    dealt.select("value").write.mode("overwrite").text(path)


# particles


def read_particles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """elements (elem_id, gid, n) and particles (pid, elem_id, x, y, z, flag, val): first line ne np, then gid and count of each
    element, then elem id x y z flag val of each particle."""
    rows = _lines(spark, path)
    head = rows.where("at = 0").first()
    n = int(head["f"][0]) if head else 0
    elements = rows.where(f"at between 1 and {n}").select((F.col("at") - 1).alias("elem_id"), F.col("f")[0].cast("long").alias("gid"), F.col("f")[1].cast("long").alias("n"))
    fields = [("elem_id", "long"), ("pid", "long"), ("x", "double"), ("y", "double"), ("z", "double"), ("flag", "short"), ("val", "int")]
    parts = rows.where(f"at > {n}").select(*(F.col("f")[i].cast(t).alias(c) for i, (c, t) in enumerate(fields)))
    return elements, parts.select("pid", *(c for c, _ in fields if c != "pid"))


def write_particles(elements: DataFrame, particles: DataFrame, path: str, one_file: bool = False) -> None:
    """The same format, by write_lines."""
    n, m = elements.count(), particles.count()
    line = lambda k, order, *c: F.struct(F.lit(k).alias("part"), F.col(order).cast("long").alias("at"), F.concat_ws(" ", *(F.col(x).cast("string") for x in c)).alias("value"))
    head = elements.sparkSession.createDataFrame([(0, 0, f"{n} {m}"), (2, 0, "")], "part int, at long, value string")
    body = elements.select(line(1, "elem_id", "gid", "n").alias("l")).select("l.*").unionByName(particles.select(line(3, "pid", "elem_id", "pid", "x", "y", "z", "flag", "val").alias("l")).select("l.*"))
    write_lines(head.unionByName(body), ["part", "at"], path, one_file)


def generate_particles(spark: SparkSession, n_elems: int, n_particles: int, strategy: int, prefix: str, rank: int = 0, **how) -> str:
    """A particle file <prefix>_<rank>.ptl: particles distributed over elements 0, 1, .. by a strategy, with zeros for all values."""
    particles = distribute(spark, n_elems, n_particles, strategy, **how)
    zero = {"x": 0.0, "y": 0.0, "z": 0.0, "flag": 0, "val": 0}
    particles = cut(particles.select("pid", "elem_id", *(F.lit(v).alias(c) for c, v in zero.items())))
    elements = spark.range(n_elems).select(F.col("id").alias("elem_id"), F.col("id").alias("gid")).join(per_element(particles), "elem_id", "left").na.fill(0, ["n"])
    path = f"{prefix}_{rank}.ptl"
    write_particles(elements, particles, path)
    return path


# partitions


def read_element_partition(spark: SparkSession, path: str) -> DataFrame:
    """eid, owner: the i-th number is the owner of element i (.ptn)."""
    numbers = _lines(spark, path).select("at", F.posexplode("f").alias("i", "owner"))
    return numbered(numbers, ["at", "i"], "eid").select("eid", F.col("owner").cast("int").alias("owner"))


def read_class_partition(spark: SparkSession, path: str) -> DataFrame:
    """class_id, owner pairs after a line with the greatest class (.cpn)."""
    return _lines(spark, path).where(F.size("f") == 2).select(F.col("f")[0].cast("int").alias("class_id"), F.col("f")[1].cast("int").alias("owner"))


def read_partition(spark: SparkSession, path: str, n_ranks: int, elem: DataFrame) -> DataFrame:
    """(eid, owner) by the file's extension. With one rank the file is not read."""
    if n_ranks == 1:
        return elem.select("eid", F.lit(0).alias("owner"))
    kind = os.path.splitext(path)[1]
    if kind == ".ptn":
        return read_element_partition(spark, path)
    if kind == ".cpn":
        from tesselark.operators.partition import owners_by_class

        return owners_by_class(elem, read_class_partition(spark, path))
    raise ValueError(f"a partition file ends in .ptn or .cpn, not {kind!r}")


def write_element_partition(owners: DataFrame, path: str, one_file: bool = False) -> None:
    """Owners in order of elements; holders of one element (gid, owner, 0 elsewhere) are summed first."""
    owners = owners.groupBy("eid").agg(F.sum("owner").alias("owner"))
    write_lines(owners.select("eid", F.col("owner").cast("string").alias("value")), ["eid"], path, one_file)


def write_class_partition(spark: SparkSession, owners: dict[int, int], path: str) -> None:
    rows = [(-1, str(max(owners, default=0)))] + [(c, f"{c} {r}") for c, r in sorted(owners.items())]
    write_lines(spark.createDataFrame(rows, "at int, value string"), ["at"], path, one_file=True)  # one row a class, from the driver


# meshes


def read_gmsh(spark: SparkSession, path: str) -> Mesh:
    """A Gmsh ASCII mesh (version 2 or 4.1) of triangles, or of tetrahedra if it has any. Lines are told apart by the section markers before
    them. Of version 4 an element's class is its geometric entity's tag, a vertex has its entity's tag and dimension; tags may have gaps."""
    rows = _lines(spark, path)
    wanted = [f"${x}" for x in ("MeshFormat", "Nodes", "EndNodes", "Elements", "EndElements")]
    marks = fetched(rows.where(F.col("f")[0].isin(wanted)), "section markers")
    spans = {r["f"][0][1:]: r["at"] for r in marks}
    if not {"Nodes", "EndNodes", "Elements", "EndElements"} <= set(spans):
        raise ValueError("not a Gmsh file")
    if "MeshFormat" in spans:
        version = rows.where(F.col("at") == spans["MeshFormat"] + 1).first()["f"]
        if len(version) > 1 and version[1] != "0":
            raise ValueError("binary Gmsh files are not read")
        if version[0].startswith("4"):
            return _read_gmsh_blocks(rows, spans)
    nodes = rows.where((F.col("at") > spans["Nodes"]) & (F.col("at") < spans["EndNodes"]) & (F.size("f") == 4))
    elements = rows.where((F.col("at") > spans["Elements"]) & (F.col("at") < spans["EndElements"]) & (F.size("f") > 4))
    dim = 3 if not elements.where("int(f[1]) = 4").isEmpty() else 2
    kind, n = (4, 4) if dim == 3 else (2, 3)
    vertex = nodes.select(F.col("f")[0].cast("long").alias("vid"), *(F.col("f")[i + 1].cast("double").alias(a) for i, a in enumerate("xyz"[:dim])), F.lit(0).alias("class_id"), F.lit(dim).cast("tinyint").alias("class_dim"))
    own = numbered(elements.where(F.col("f")[1].cast("int") == kind), ["at"], "eid")
    tags = F.col("f")[2].cast("int")
    elem = own.select("eid", *(F.get("f", 3 + tags + i).cast("long").alias(f"v{i}") for i in range(n)), F.when(tags > 0, F.col("f")[3].cast("int")).otherwise(0).alias("class_id"))
    return Mesh(dim, vertex, elem)


def _blocks(rows: DataFrame, start: int, end: int, lines_each: int) -> DataFrame:
    """at, f of the lines of a section's blocks with head, an array of the block's header: line, dimension, tag, kind, count. Only lines that
    look like a header (four whole numbers, the first a dimension) come to the driver; from the first, each leads to the next by its count."""
    body = rows.where((F.col("at") > start + 1) & (F.col("at") < end))
    looks = (F.size("f") == 4) & F.forall("f", lambda x: x.rlike("^[0-9]{1,18}$")) & F.col("f")[0].isin("0", "1", "2", "3")
    known = {r["at"]: [int(x) for x in r["f"]] for r in fetched(body.where(looks), "lines like block headers")}
    at, heads = start + 2, []
    while at < end:
        if at not in known:
            raise ValueError(f"line {at} is no header of a block")
        heads.append((at, *known[at]))
        at += 1 + lines_each * known[at][3]
    if at != end:
        raise ValueError("the last block goes on beyond its section")
    found = body.sparkSession.createDataFrame([(h[0], list(h)) for h in heads], "at long, _head array<long>")
    return carried_forward(body.join(found, "at", "left"), ["at"], "_head", "head").where(F.col("at") > F.col("head")[0]).drop("_head")


def _read_gmsh_blocks(rows: DataFrame, spans: dict[str, int]) -> Mesh:
    nodes = cut(_blocks(rows, spans["Nodes"], spans["EndNodes"], 2))
    place, n = F.col("at") - F.col("head")[0] - 1, F.col("head")[4]
    tags = nodes.where(place < n).select((F.col("at") + n).alias("at"), F.col("f")[0].cast("long").alias("vid"), F.col("head")[2].cast("int").alias("class_id"), F.col("head")[1].cast("tinyint").alias("class_dim"))
    coords = nodes.where(place >= n).select("at", *(F.col("f")[i].cast("double").alias(a) for i, a in enumerate("xyz")))
    elements = cut(_blocks(rows, spans["Elements"], spans["EndElements"], 1))
    dim = 3 if not elements.where(F.col("head")[3] == 4).isEmpty() else 2
    kind, corners = (4, 4) if dim == 3 else (2, 3)
    vertex = tags.join(coords, "at").select("vid", *"xyz"[:dim], "class_id", "class_dim")
    own = numbered(elements.where(F.col("head")[3] == kind), ["at"], "eid")
    elem = own.select("eid", *(F.col("f")[1 + i].cast("long").alias(f"v{i}") for i in range(corners)), F.col("head")[2].cast("int").alias("class_id"))
    return Mesh(dim, vertex, elem)


def read_mesh(spark: SparkSession, path: str) -> Mesh:
    """By extension: .msh (Gmsh), else a folder written by write_mesh."""
    kind = os.path.splitext(path)[1]
    if kind == ".msh":
        return read_gmsh(spark, path)
    if kind in ("", ".mesh"):
        from tesselark.sources.picparts import read_mesh_tables

        return read_mesh_tables(spark, path)
    raise ValueError(f"no mesh reader for {kind!r}")


def vtk_lines(mesh: Mesh, tags: list[str]) -> DataFrame:
    """part, at, value: the lines of a legacy VTK file of a mesh with consecutive vertex and element numbers."""
    spark, n, m, k = mesh.elem.sparkSession, mesh.vertex.count(), mesh.elem.count(), mesh.dim + 1
    coords = [F.col(a).cast("double").cast("string") for a in mesh.axes] + [F.lit("0.0")] * (3 - mesh.dim)
    head = [(0, "# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET UNSTRUCTURED_GRID"), (1, f"POINTS {n} double"), (3, f"CELLS {m} {m * (k + 1)}"), (5, f"CELL_TYPES {m}"), (7, f"CELL_DATA {m}")]
    head += [(8 + 2 * i, f"SCALARS {t} double 1\nLOOKUP_TABLE default") for i, t in enumerate(tags)]
    out = spark.createDataFrame([(p, -1, v) for p, v in head], "part int, at long, value string")
    add = lambda df, part, at, value: df.select(F.lit(part).alias("part"), F.col(at).alias("at"), value.alias("value"))
    out = out.unionByName(add(mesh.vertex, 2, "vid", F.concat_ws(" ", *coords)))
    out = out.unionByName(add(mesh.elem, 4, "eid", F.concat_ws(" ", F.lit(str(k)), *(F.col(v).cast("string") for v in mesh.verts))))
    out = out.unionByName(add(mesh.elem, 6, "eid", F.lit("5" if mesh.dim == 2 else "10")))
    for i, t in enumerate(tags):
        out = out.unionByName(add(mesh.elem, 9 + 2 * i, "eid", F.col(t).cast("double").cast("string")))
    return out


def write_vtk(mesh: Mesh, path: str, tags: list[str] | None = None, one_file: bool = True) -> None:
    """vtk_lines as one file, which viewers want, or as part files to be joined in order of their names."""
    write_lines(vtk_lines(mesh, tags or []), ["part", "at"], path, one_file)
