"""Location and proximity over a hierarchy of grids, on meshes whose sizes spread over three decades, against all pairs in numpy."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tesselark.operators import grid, mesh as M
from tesselark.plans import tables as T

TOP = 10**8


def graded(mesh, n: int, length: int):
    """The lattice's lines moved to the fourth powers: the last cell is some 4 n^3 times as wide as the first."""
    moved = {a: F.expr(f"pow({a} / {length // n}, 4) * {TOP // n**4}").cast("long") for a in mesh.axes}
    return M.Mesh(mesh.dim, mesh.vertex.withColumns(moved), mesh.elem)


@pytest.fixture(scope="module")
def block(spark):
    return graded(M.tet_lattice(spark, 7, 70), 7, 70)


def corners(mesh):
    rows = sorted(tuple(r) for r in grid.element_points(mesh).select("id", "points").collect())
    return np.array([[tuple(p) for p in r[1]] for r in rows], dtype=float)


def test_rows_per_element_are_bounded(block):
    filed = grid.filed_elements(block)
    per = filed.groupBy("eid").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("level"))
    assert per.agg(F.max("n")).first()[0] <= 8
    low, high = per.agg(F.min("level"), F.max("level")).first()
    assert high - low >= 9  # three decades


def test_location_equals_all_pairs(spark, block):
    v = corners(block)
    draw = np.random.default_rng(4)
    pts = np.concatenate([v[draw.integers(0, len(v), 60)].mean(axis=1), draw.uniform(-TOP / 10, TOP * 1.05, (60, 3)), v[:20, 0]])
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pts)] + [(999, None, 1.0, 1.0)], "pid long, x double, y double, z double")
    got = {r["pid"]: r["eid"] for r in grid.locate_levels(p, block, tol=1e-9).collect()}
    assert got[999] is None
    sides = np.linalg.inv(np.stack([v[:, i] - v[:, 0] for i in (1, 2, 3)], axis=2))
    for i, x in enumerate(pts):
        b = np.einsum("eij,ej->ei", sides, x - v[:, 0])
        inside = np.flatnonzero((b.min(axis=1) >= -1e-9) & (b.sum(axis=1) <= 1 + 1e-9))
        assert got[i] == (inside[0] if len(inside) else None) or (got[i] in inside)
    assert sum(x is not None for x in got.values()) >= 80


@pytest.mark.parametrize("depth", [0.0, 50_000.0, 5_000_000.0])
def test_proximity_equals_all_pairs(spark, depth):
    m = graded(M.tet_lattice(spark, 4, 40), 4, 40)
    v = corners(m)
    far = lambda a, b: ((a[:, None, :, None] - b[None, :, None, :]) ** 2).sum(axis=-1).min(axis=(2, 3))
    tets = {tuple(map(int, x)) for x in np.argwhere(far(v, v) <= depth * depth)}
    points = grid.element_points(m)
    assert {tuple(r) for r in grid.near_entities(points, points, depth).collect()} == tets
    faces = np.stack([v[:, list(s)] for s in m.local_sides], axis=1).reshape(-1, 3, 3)
    want = {tuple(map(int, x)) for x in np.argwhere(far(faces, v) <= depth * depth)}
    assert {tuple(r) for r in grid.near_entities(grid.element_points(m, sides=True), points, depth).collect()} == want


def test_levels_hold_their_boxes(spark):
    sizes = [0.0, 1.0, 1.0000001, 2.0, 3.0, 1e-30, 7e200, 2.0**40]
    for x, level in spark.createDataFrame([(x,) for x in sizes], "x double").select("x", grid.level_of(F.col("x"))).collect():
        assert 2.0**level >= x and (level == grid.LEAST or 2.0 ** (level - 1) < x)


def test_empty_tables(spark, block):
    p = spark.createDataFrame([], "pid long, x double, y double, z double")
    assert grid.locate_levels(p, block).count() == 0
    none = M.Mesh(3, block.vertex, block.elem.where("false"))
    one = spark.createDataFrame([(1, 1.0, 1.0, 1.0)], "pid long, x double, y double, z double")
    assert grid.locate_levels(one, none).first()["eid"] is None
    assert grid.near_entities(grid.element_points(none), grid.element_points(none), 1.0).count() == 0


def test_looked_up_points_are_not_broadcast(spark):
    """Points from a small file, once for each level, go to no other machine as a whole: Spark takes them for as small as the file."""
    from tesselark.plans import catalogue

    plan = catalogue.QUERIES["locate_on_graded_mesh"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "SortMergeJoin" in plan
