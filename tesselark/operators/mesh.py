"""Simplex meshes as tables: generators, topology, measures, classification.

vertex(vid, x, y[, z], class_id, class_dim), elem(eid, v0, v1, v2[, v3], class_id). Everything else is derived.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselark.functions.geometry import TET_FACES, TRIANGLE_EDGES, barycentric_2d, barycentric_3d, centroid, is_flipped, tet_volume6, triangle_area2
from tesselark.storage import numbered, place_within

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Mesh:
    """dim 2 (triangles) or 3 (tetrahedra)."""

    dim: int
    vertex: DataFrame
    elem: DataFrame

    @property
    def local_sides(self) -> tuple[tuple[int, ...], ...]:
        return TRIANGLE_EDGES if self.dim == 2 else TET_FACES

    @property
    def verts(self) -> list[str]:
        return [f"v{i}" for i in range(self.dim + 1)]

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: self.dim]

    # tags

    def with_tag(self, dim: int, name: str, values: DataFrame, key: str) -> Mesh:
        """values (key, name) as a column of the vertices (dim 0) or elements."""
        if dim == 0:
            return Mesh(self.dim, self.vertex.drop(name).join(values.select(F.col(key).alias("vid"), name), "vid", "left"), self.elem)
        return Mesh(self.dim, self.vertex, self.elem.drop(name).join(values.select(F.col(key).alias("eid"), name), "eid", "left"))

    def has_tag(self, dim: int, name: str) -> bool:
        return name in (self.vertex if dim == 0 else self.elem).columns

    def n_tags(self, dim: int) -> int:
        return len((self.vertex if dim == 0 else self.elem).columns) - 1


# generators


def tri_lattice(spark: SparkSession, n: int, length: int) -> Mesh:
    """n x n quads of two triangles each on [0, length]^2 with whole-numbered vertices; class_id is the ring of the quad."""
    h, m = length // n, n + 1
    v = spark.range(m * m).select(F.col("id").alias("vid"), F.expr(f"id div {m}").alias("i"), (F.col("id") % m).alias("j"))
    ring = lambda k: F.least("i", "j", F.lit(k) - F.col("i"), F.lit(k) - F.col("j")).cast("int")
    border = ((F.col("i") % n == 0).cast("int") + (F.col("j") % n == 0).cast("int")).alias("b")
    vertex = v.select("vid", (F.col("i") * h).alias("x"), (F.col("j") * h).alias("y"), ring(n).alias("class_id"), (2 - border).cast("tinyint").alias("class_dim"))
    e = spark.range(2 * n * n).select(F.col("id").alias("eid"), F.expr(f"id div 2 div {n}").alias("i"), F.expr(f"id div 2 % {n}").alias("j"), (F.col("id") % 2).alias("k"))
    vid = lambda di, dj: (F.col("i") + di) * m + F.col("j") + dj
    lower = F.col("k") == 0
    corners = (vid(0, 0), F.when(lower, vid(1, 0)).otherwise(vid(1, 1)), F.when(lower, vid(1, 1)).otherwise(vid(0, 1)))
    elem = e.select("eid", *(c.alias(f"v{i}") for i, c in enumerate(corners)), ring(n - 1).alias("class_id"))
    return Mesh(2, vertex, elem)


#: The six tetrahedra of a cube along its main diagonal, by corner number (bit 0 is x, bit 1 y, bit 2 z).
CUBE_TETS = ((0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7))


def tet_lattice(spark: SparkSession, n: int, length: int) -> Mesh:
    """n^3 cubes of six positively oriented tetrahedra each on [0, length]^3; class_id is 1."""
    h, m = length // n, n + 1
    v = spark.range(m**3).select(F.col("id").alias("vid"), F.expr(f"id div {m * m}").alias("i"), F.expr(f"id div {m} % {m}").alias("j"), (F.col("id") % m).alias("k"))
    border = sum(((F.col(c) % n == 0).cast("int") for c in ("j", "k")), (F.col("i") % n == 0).cast("int"))
    vertex = v.select("vid", *((F.col(c) * h).alias(a) for c, a in zip("ijk", AXES, strict=True)), F.lit(1).alias("class_id"), (3 - border).cast("tinyint").alias("class_dim"))
    e = spark.range(6 * n**3).select(F.col("id").alias("eid"), F.expr("id div 6").alias("q"), (F.col("id") % 6).cast("int").alias("t"))
    e = e.select("eid", "t", F.expr(f"q div {n * n}").alias("i"), F.expr(f"q div {n} % {n}").alias("j"), (F.col("q") % n).alias("k"))
    corner = lambda c: (F.col("i") + (c & 1)) * m * m + (F.col("j") + (c >> 1 & 1)) * m + F.col("k") + (c >> 2 & 1)
    pick = lambda at: reduce(lambda rest, t: F.when(F.col("t") == t, corner(CUBE_TETS[t][at])).otherwise(rest), range(4, -1, -1), corner(CUBE_TETS[5][at]))
    return Mesh(3, vertex, e.select("eid", *(pick(i).alias(f"v{i}") for i in range(4)), F.lit(1).alias("class_id")))


# adjacency


def elem_vert(mesh: Mesh) -> DataFrame:
    """eid, li, vid."""
    return mesh.elem.select("eid", F.posexplode(F.array(*mesh.verts)).alias("li", "vid"))


def elem_side_keys(mesh: Mesh) -> DataFrame:
    """eid, li, a0.. (local order), k0.. (sorted): a row for each element and local side."""
    sides = F.array(*(F.struct(*(F.col(f"v{i}").alias(f"a{n}") for n, i in enumerate(s))) for s in mesh.local_sides))
    rows = mesh.elem.select("eid", F.posexplode(sides).alias("li", "s")).select("eid", "li", "s.*")
    ordered = F.array_sort(F.array(*(f"a{i}" for i in range(mesh.dim))))
    return rows.withColumn("_k", ordered).select("*", *(F.col("_k")[i].alias(f"k{i}") for i in range(mesh.dim))).drop("_k")


def sides(mesh: Mesh) -> DataFrame:
    """sid, v0.. (sorted), n_elem, exposed: numbered by their sorted vertices."""
    keys = [f"k{i}" for i in range(mesh.dim)]
    rows = elem_side_keys(mesh).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_elem"))
    rows = numbered(rows, keys, "sid")
    return rows.select("sid", *(F.col(k).alias(f"v{i}") for i, k in enumerate(keys)), F.col("n_elem").cast("int").alias("n_elem"), (F.col("n_elem") == 1).alias("exposed"))


def elem_side(mesh: Mesh, side: DataFrame | None = None) -> DataFrame:
    """eid, li, sid, flip, nbr: the walk table; nbr is null where the side is exposed."""
    side = sides(mesh) if side is None else side
    keys = [f"k{i}" for i in range(mesh.dim)]
    rows = elem_side_keys(mesh)
    both = rows.groupBy(*keys).agg(F.min("eid").alias("e0"), F.max("eid").alias("e1"))
    named = side.select("sid", *(F.col(f"v{i}").alias(k) for i, k in enumerate(keys)))
    flip = is_flipped([F.col(f"a{i}") for i in range(mesh.dim)], [F.col(k) for k in keys])
    nbr = F.when(F.col("e0") != F.col("e1"), F.col("e0") + F.col("e1") - F.col("eid"))
    # rows holds several for each element, whose size Spark guesses as that of the elements: neither it nor the sides are ever broadcast
    return rows.hint("merge").join(both, keys).join(named.hint("merge"), keys).select("eid", "li", "sid", flip.alias("flip"), nbr.alias("nbr"))


def dual(mesh: Mesh, walk: DataFrame | None = None) -> DataFrame:
    """eid, nbr, sid through interior sides."""
    return (elem_side(mesh) if walk is None else walk).where("nbr is not null").select("eid", "nbr", "sid")


def edges(mesh: Mesh) -> DataFrame:
    """edge id (by sorted vertices), a, b: of triangles the sides, of tetrahedra their six edges."""
    pairs = [(i, j) for i in range(mesh.dim + 1) for j in range(i + 1, mesh.dim + 1)]
    rows = mesh.elem.select(F.explode(F.array(*(F.struct(F.least(f"v{i}", f"v{j}").alias("a"), F.greatest(f"v{i}", f"v{j}").alias("b")) for i, j in pairs))).alias("p"))
    return numbered(rows.select("p.*").distinct(), ["a", "b"], "edge")


def reflect_down(mesh: Mesh, side: DataFrame) -> DataFrame:
    """eid, li, sid, flip: sides of elements of which only their vertices are known, found in side (sid, v0..) by sorted vertices. A side that
    is not there has no sid; flip tells whether it is stored against the element's order."""
    keys = [f"k{i}" for i in range(mesh.dim)]
    stored = F.array(*(f"v{i}" for i in range(mesh.dim)))
    named = side.select("sid", *(F.array_sort(stored)[i].alias(k) for i, k in enumerate(keys)), *(F.col(f"v{i}").alias(f"_s{i}") for i in range(mesh.dim)))
    rows = elem_side_keys(mesh).join(named, keys, "left")
    flip = F.when(F.col("sid").isNotNull(), is_flipped([F.col(f"a{i}") for i in range(mesh.dim)], [F.col(f"_s{i}") for i in range(mesh.dim)]))
    return rows.select("eid", "li", "sid", flip.alias("flip"))


def up(down: DataFrame, low: str, high: str) -> DataFrame:
    """From a down adjacency (high, low): low, its degree, and the sorted list of high entities (few, as a mesh's degrees are bounded)."""
    return down.groupBy(low).agg(F.count(F.lit(1)).alias("degree"), F.array_sort(F.collect_list(high)).alias(high))


def first_adjacent(mesh: Mesh) -> DataFrame:
    """vid, eid: the least element around each vertex."""
    return elem_vert(mesh).groupBy("vid").agg(F.min("eid").alias("eid"))


def mark_up(down: DataFrame, flagged: DataFrame, low: str, high: str) -> DataFrame:
    """Distinct high entities that have a flagged low entity."""
    return down.join(flagged.select(low).distinct(), low, "left_semi").select(high).distinct()


def elem_geometry(mesh: Mesh) -> DataFrame:
    """elem with the coordinates of its vertices as x0, y0[, z0], x1, ...: one row an element."""
    out = mesh.elem
    for i in range(mesh.dim + 1):
        out = out.join(mesh.vertex.select(F.col("vid").alias(f"v{i}"), *(F.col(a).alias(f"{a}{i}") for a in mesh.axes)), f"v{i}")
    return out


def points(mesh: Mesh, prefix: str = "") -> list[list[Column]]:
    """The vertices of a row of elem_geometry."""
    return [[F.col(f"{prefix}{a}{i}") for a in mesh.axes] for i in range(mesh.dim + 1)]


def walk_table(mesh: Mesh) -> DataFrame:
    """elem_geometry with n0.. (neighbour behind each local side, null if exposed) and s0.. (side ids)."""
    n = mesh.dim + 1
    side = elem_side(mesh)
    wide = side.groupBy("eid").agg(*(F.max(F.when(F.col("li") == i, F.col(c))).alias(f"{c[0]}{i}") for i in range(n) for c in ("nbr", "sid")))
    return elem_geometry(mesh).join(wide, "eid")


# measures


def measure_expr(mesh: Mesh) -> Column:
    p = points(mesh)
    return triangle_area2(*p) / 2 if mesh.dim == 2 else tet_volume6(p) / 6


def measures(mesh: Mesh) -> DataFrame:
    return elem_geometry(mesh).select("eid", measure_expr(mesh).cast("double").alias("measure"))


def centroids(mesh: Mesh) -> DataFrame:
    return elem_geometry(mesh).select("eid", *(c.cast("double").alias(a) for c, a in zip(centroid(points(mesh)), mesh.axes, strict=True)))


def bounding_box(mesh: Mesh) -> DataFrame:
    return mesh.vertex.agg(*(f(a).alias(f"{k}_{a}") for a in mesh.axes for k, f in (("min", F.min), ("max", F.max))))


def walk_tolerance(mesh: Mesh) -> DataFrame:
    """tol = max(1e-15 / least measure, 1e-8)."""
    return measures(mesh).agg(F.greatest(F.lit(1e-15) / F.min("measure"), F.lit(1e-8)).alias("tol"))


def barycentric(mesh: Mesh, p: list[Column], by_vertex: bool = False) -> list[Column]:
    """Coordinates of p in the element of the same row of elem_geometry."""
    return (barycentric_2d if mesh.dim == 2 else barycentric_3d)(points(mesh), p, by_vertex=by_vertex)


# classification


def class_histogram(entities: DataFrame, by: str = "class_dim") -> DataFrame:
    return entities.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def reverse_classification(entities: DataFrame, key: str, by: str = "class_id") -> DataFrame:
    """class, pos, entity: each class's entities in order, a row each, as a class may be as large as the mesh."""
    return place_within(entities.select(by, key), [by], [key], "pos")


def class_statistics(elem: DataFrame) -> DataFrame:
    """Least, greatest and total class size, and how many classes there are."""
    return class_histogram(elem, "class_id").agg(F.max("n").alias("max_n"), F.min("n").alias("min_n"), F.sum("n").alias("sum_n"), F.count(F.lit(1)).alias("n_classes"))


def near_pairs(mesh: Mesh, depth: float) -> DataFrame:
    """Pairs of elements with vertices within depth of each other. Vertices meet by grid cell of that width, not all with all."""
    v = elem_vert(mesh).join(mesh.vertex.select("vid", *mesh.axes), "vid")
    cell = lambda a, d: (F.floor(F.col(a) / depth) + d).alias(f"c_{a}")
    own = v.select(F.col("eid").alias("e"), *(F.col(a).alias(f"o_{a}") for a in mesh.axes), *(cell(a, 0) for a in mesh.axes)).distinct()
    shifts = F.array(*(F.struct(*(F.lit(d).alias(a) for d, a in zip(ds, mesh.axes, strict=True))) for ds in _grid(mesh.dim)))
    other = v.select("eid", *mesh.axes, F.explode(shifts).alias("d")).select("eid", *mesh.axes, *((F.floor(F.col(a) / depth) + F.col(f"d.{a}")).alias(f"c_{a}") for a in mesh.axes)).distinct()
    far = sum(((F.col(a) - F.col(f"o_{a}")) ** 2 for a in mesh.axes[1:]), (F.col(mesh.axes[0]) - F.col(f"o_{mesh.axes[0]}")) ** 2)
    return own.join(other, [f"c_{a}" for a in mesh.axes]).where((far <= depth * depth) & (F.col("e") < F.col("eid"))).select(F.col("e").alias("a"), F.col("eid").alias("b")).distinct()


def _grid(dim: int) -> list[tuple[int, ...]]:
    return [(i, *rest) for i in (-1, 0, 1) for rest in (_grid(dim - 1) if dim > 1 else [()])]


def exposed_faces(walk: DataFrame) -> DataFrame:
    """eid, exposed and interior local sides of each element, from elem_side()."""
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("li"))))
    return walk.groupBy("eid").agg(pick(F.col("nbr").isNull()).alias("exposed"), pick(F.col("nbr").isNotNull()).alias("interior"))


def boundary_elements(walk: DataFrame) -> DataFrame:
    """sid, eid: the only element of each exposed side."""
    return walk.where("nbr is null").select("sid", "eid")


def locate(particles: DataFrame, mesh: Mesh, cell: float) -> DataFrame:
    """particles (pid, x, y[, z]) with eid of an element that contains them (the least), null outside. Elements are listed under the grid
    cells that their box touches, so each point meets only its cell's elements."""
    geo = elem_geometry(mesh)
    low = [F.floor(F.least(*(f"{a}{i}" for i in range(mesh.dim + 1))) / cell) for a in mesh.axes]
    high = [F.floor(F.greatest(*(f"{a}{i}" for i in range(mesh.dim + 1))) / cell) for a in mesh.axes]
    for k, a in enumerate(mesh.axes):
        geo = geo.withColumn(f"c_{a}", F.explode(F.sequence(low[k], high[k])))
    own = particles.select("*", *(F.floor(F.col(a) / cell).alias(f"c_{a}") for a in mesh.axes))
    inside = F.least(*barycentric(mesh, [F.col(a) for a in mesh.axes])) >= -1e-10
    found = own.join(geo, [f"c_{a}" for a in mesh.axes]).where(inside).groupBy("pid").agg(F.min("eid").alias("eid"))
    return particles.join(found, "pid", "left")


__all__ = [name for name in dir() if not name.startswith("_") and name not in ("Window",)]
