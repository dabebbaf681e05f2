"""Point location and proximity over a hierarchy of grids.

Level l is a grid of cells of width 2^l. An entity is filed at the level of its own size, the least whose cells are at least as wide as its box, so
it touches at most two cells along each axis whatever the spread of sizes. A point is looked up once on each level that exists; of two
entities the smaller is looked up on the larger one's level. Only the levels that exist come to the driver, one number each, at most LEVELS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.operators.mesh import AXES, Mesh, barycentric, elem_geometry
from tesselark.storage import cut, small

#: Boxes narrower than 2^LEAST are filed as if they were that wide; more than LEVELS levels cannot occur between it and the greatest double.
LEAST, LEVELS = -60, 1100


def level_of(extent: Column) -> Column:
    """The least level whose cells are at least as wide as extent."""
    level = F.greatest(F.lit(LEAST), F.ceil(F.log2(F.when(extent > 0, extent))).cast("int"))  # log2 may be a little low
    return F.coalesce(level + F.when(F.pow(F.lit(2.0), level) < extent, 1).otherwise(0), F.lit(LEAST))


def _cells(rows: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """rows (level, low_x, high_x, ..) once for each cell c_x, .. that they touch."""
    width = F.pow(F.lit(2.0), F.col("level"))
    for a in axes:
        rows = rows.withColumn(f"c_{a}", F.explode(F.sequence(F.floor(F.col(f"low_{a}") / width), F.floor(F.col(f"high_{a}") / width))))
    return rows


def _levels(filed: DataFrame) -> list[int]:
    return sorted(r["level"] for r in filed.select("level").distinct().limit(LEVELS).collect())


def filed_elements(mesh: Mesh) -> DataFrame:
    """elem_geometry with level and the cells of that level that an element touches: at most 2^dim rows an element."""
    geo, corners = elem_geometry(mesh), range(mesh.dim + 1)
    if mesh.dim == 3:  # products of three whole coordinates would overflow
        geo = geo.withColumns({f"{a}{i}": F.col(f"{a}{i}").cast("double") for a in mesh.axes for i in corners})
    low = {f"low_{a}": F.least(*(F.col(f"{a}{i}").cast("double") for i in corners)) for a in mesh.axes}
    geo = geo.withColumns(low | {f"high_{a}": F.greatest(*(F.col(f"{a}{i}").cast("double") for i in corners)) for a in mesh.axes})
    extent = F.greatest(*(F.col(f"high_{a}") - F.col(f"low_{a}") for a in mesh.axes))
    return _cells(geo.withColumn("level", level_of(extent)), mesh.axes).drop(*(f"{k}_{a}" for k in ("low", "high") for a in mesh.axes))


def locate_levels(particles: DataFrame, mesh: Mesh, tol: float = 1e-10) -> DataFrame:
    """particles (pid, x, y[, z]) with eid of an element that contains them (the least), null outside or where a coordinate is null."""
    filed = cut(filed_elements(mesh))
    levels = _levels(filed)
    if not levels:
        return particles.withColumn("eid", F.lit(None).cast(mesh.elem.schema["eid"].dataType))
    at = particles.select("pid", *mesh.axes, F.explode(F.array(*map(F.lit, levels))).alias("level"))
    at = at.select("*", *(F.floor(F.col(a) / F.pow(F.lit(2.0), F.col("level"))).alias(f"c_{a}") for a in mesh.axes))
    inside = F.least(*barycentric(mesh, [F.col(a) for a in mesh.axes])) >= -tol
    # a look-up a level makes many rows of few bytes, whose size Spark guesses as that of the points: they must never be broadcast
    found = at.hint("merge").join(small(filed), ["level", *(f"c_{a}" for a in mesh.axes)]).where(inside).groupBy("pid").agg(F.min("eid").alias("eid"))
    return particles.hint("merge").join(found, "pid", "left")


def element_points(mesh: Mesh, sides: bool = False) -> DataFrame:
    """id, points: the corners of each element, or (id is eid * sides + local side) of each of its sides."""
    geo = elem_geometry(mesh)
    corner = lambda i: F.struct(*(F.col(f"{a}{i}").cast("double").alias(a) for a in mesh.axes))
    if not sides:
        return geo.select(F.col("eid").alias("id"), F.array(*(corner(i) for i in range(mesh.dim + 1))).alias("points"))
    n = len(mesh.local_sides)
    each = F.array(*(F.struct((F.col("eid") * n + k).alias("id"), F.array(*map(corner, s)).alias("points")) for k, s in enumerate(mesh.local_sides)))
    return geo.select(F.explode(each).alias("x")).select("x.*")


def _boxed(rows: DataFrame, axes: tuple[str, ...], depth: float) -> DataFrame:
    """rows with their box, grown by half the depth on each side, and its level."""
    of = lambda f, a: f(F.transform("points", lambda p: p[a]))
    rows = rows.withColumns({f"low_{a}": of(F.array_min, a) - depth / 2 for a in axes} | {f"high_{a}": of(F.array_max, a) + depth / 2 for a in axes})
    return rows.withColumn("level", level_of(F.greatest(*(F.col(f"high_{a}") - F.col(f"low_{a}") for a in axes))))


def near_entities(left: DataFrame, right: DataFrame, depth: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """a, b: ids of left and right (id, points) of which two points are within depth of each other."""
    a, b = cut(_boxed(left, axes, depth)), cut(_boxed(right, axes, depth))
    levels = sorted({*_levels(a), *_levels(b)})
    if not levels:
        return left.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    keys = ["level", *(f"c_{x}" for x in axes)]
    far = lambda p, q: reduce(lambda s, x: s + (p[x] - q[x]) * (p[x] - q[x]), axes[1:], (p[axes[0]] - q[axes[0]]) * (p[axes[0]] - q[axes[0]]))

    def met(small: DataFrame, large: DataFrame, same_level: bool) -> DataFrame:
        """The smaller, looked up on each level from its own (or the next) on, with the larger, at home on its level."""
        above = F.filter(F.array(*map(F.lit, levels)), lambda x: (x >= F.col("own")) if same_level else (x > F.col("own")))
        probes = small.withColumnRenamed("level", "own").withColumn("level", F.explode(above))
        probes, homes = _cells(probes, axes).select(*keys, F.col("id").alias("i"), F.col("points").alias("p")), _cells(large, axes).select(*keys, F.col("id").alias("j"), F.col("points").alias("q"))
        near = F.exists("p", lambda x: F.exists("q", lambda y: far(x, y) <= depth * depth))
        return probes.hint("merge").join(homes, keys).where(near).select("i", "j")

    return met(a, b, True).unionByName(met(b, a, False).select(F.col("j").alias("i"), F.col("i").alias("j"))).select(F.col("i").alias("a"), F.col("j").alias("b")).distinct()
