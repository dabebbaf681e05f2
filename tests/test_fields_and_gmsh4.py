"""Tiled fields against literal ones and numpy; Gmsh 4 files against the same mesh read from Gmsh 2."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tesselark.functions import interp
from tesselark.functions.interp import Axis
from tesselark.operators.field_tiles import interpolated, tiled
from tesselark.plans import files
from tesselark.plans import tables as T
from tesselark.sources import text
from tesselark.storage import carried_forward

AXES2 = (Axis(0.0, 100_000.0, 11, True), Axis(-5_000.0, 62_500.0, 18))


def places(spark):
    return T.particles(spark, DATA).select("pid", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("val").alias("z"))


@pytest.mark.parametrize("tile", [1, 7])
def test_plane_equals_the_literal_form(spark, tile):
    f = [[(i * 37 + j * 11) % 23 + 0.25 for i in range(11)] for j in range(18)]
    nodes = spark.createDataFrame([(i, j, f[j][i]) for i in range(11) for j in range(18)], "i0 int, i1 int, f double")
    pos = [F.col("x"), F.col("y")]
    literal = interp.n_linear(F.array(*(F.lit(v) for row in f for v in row)), AXES2, pos)
    got = interpolated(places(spark), tiled(nodes, AXES2, tile=tile), pos).select("pid", "value")
    want = {r["pid"]: r["v"] for r in places(spark).select("pid", literal.alias("v")).collect()}
    assert {r["pid"]: r["value"] for r in got.collect()} == want and len(want) > 500


def test_space_equals_the_literal_form(spark):
    axes = (Axis(0.0, 250_000.0, 5), Axis(0.0, 200_000.0, 6), Axis(0.0, 1_000.0, 1))
    f = [((i * 7 + j * 5) % 17) / 3 for j in range(6) for i in range(5)]
    nodes = spark.createDataFrame([(i, j, 0, f[i + 5 * j]) for i in range(5) for j in range(6)], "i0 int, i1 int, i2 int, f double")
    pos = [F.col("x"), F.col("y"), F.col("z")]
    got = {r["pid"]: r["value"] for r in interpolated(places(spark), tiled(nodes, axes, tile=3), pos).collect()}
    assert got == {r["pid"]: r["v"] for r in places(spark).select("pid", interp.n_linear(F.array(*map(F.lit, f)), axes, pos).alias("v")).collect()}


def test_ten_million_nodes(spark):
    """Values that follow from the events' number and the node's place; every point against numpy."""
    n, k = 3_200, T.size(spark, DATA).events
    nodes = spark.range(n * n).select(F.expr(f"id % {n}").alias("i0"), F.expr(f"id div {n}").alias("i1"), F.expr(f"cast((id % {n}) * {k} % 1009 + (id div {n}) % 97 as double)").alias("f"))
    step = T.LENGTH / (n - 1)
    axes = (Axis(0.0, step, n, True), Axis(0.0, step, n, True))
    p = places(spark).where(f"x between 0 and {T.LENGTH} and y between 0 and {T.LENGTH}")
    rows = interpolated(p, tiled(nodes, axes), [F.col("x"), F.col("y")]).collect()
    for r in rows:
        wx, wy = r["x"] / step, r["y"] / step
        i, j = min(int(np.floor(wx)), n - 2), min(int(np.floor(wy)), n - 2)
        f = lambda a, b: a * k % 1009 + b % 97
        s, t = min(wx - i, 1.0), min(wy - j, 1.0)
        assert r["value"] == pytest.approx(f(i, j) * (1 - s) * (1 - t) + f(i + 1, j) * s * (1 - t) + f(i, j + 1) * (1 - s) * t + f(i + 1, j + 1) * s * t)
    assert len(rows) > 300


def test_missing_nodes_and_null_places(spark):
    nodes = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0), (5, 5, 9.0)], "i0 int, i1 int, f double")
    field = tiled(nodes, (Axis(0.0, 1.0, 6), Axis(0.0, 1.0, 6)), tile=2)
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5), (3, 3.5, 0.5)], "pid long, x double, y double")
    assert {r["pid"]: r["value"] for r in interpolated(p, field, [F.col("x"), F.col("y")]).collect()} == {1: None, 2: None, 3: None}
    assert interpolated(p, tiled(nodes.limit(0), field.axes), [F.col("x"), F.col("y")]).count() == 3


def test_values_are_carried_forward(spark):
    rows = [(i, i if i % 37 == 5 else None) for i in range(500)]
    got = carried_forward(spark.createDataFrame(rows, "at long, v long").repartition(5), ["at"], "v", "last").collect()
    assert {r["at"]: r["last"] for r in got} == {i: max((k for k in range(i + 1) if k % 37 == 5), default=None) for i in range(500)}


GMSH4 = """$MeshFormat
4.1 0 8
$EndMeshFormat
$Entities
0 1 2 0
1 0 0 0 1 0 0 0 0
$EndEntities
$Nodes
3 5 2 900
0 1 0 1
2
0 0 0
2 7 0 3
30
4
900
1 0 0
1 1 0
0 1 0.5
1 3 0 1
31
0.5 -1 0
$EndNodes
$Elements
3 4 1 77
1 3 1 1
1 2 30
2 7 2 2
2 2 30 4
3 2 4 900
2 8 2 1
77 30 2 31
$EndElements
"""


def test_gmsh4_by_hand(spark, tmp_path):
    """Several entities, tags with gaps, an element line that looks like a header, lines of other kinds."""
    path = tmp_path / "plate.msh"
    path.write_text(GMSH4)
    m = text.read_mesh(spark, f"file://{path}")
    assert sorted(tuple(r) for r in m.elem.select("eid", "v0", "v1", "v2", "class_id").collect()) == [(0, 2, 30, 4, 7), (1, 2, 4, 900, 7), (2, 30, 2, 31, 8)]
    assert sorted(tuple(r) for r in m.vertex.select("vid", "x", "y", "class_id", "class_dim").collect()) == [(2, 0.0, 0.0, 1, 0), (4, 1.0, 1.0, 7, 2), (30, 1.0, 0.0, 7, 2), (31, 0.5, -1.0, 3, 1), (900, 0.0, 1.0, 7, 2)]


@pytest.mark.parametrize("bad", [GMSH4.replace("2 7 2 2", "2 7 2 3"), GMSH4.replace("4.1 0 8", "4.1 1 8"), GMSH4.replace("$EndNodes\n", ""), GMSH4.replace("1 3 0 1\n31", "x 3 0 1\n31")])
def test_broken_gmsh4_is_an_error(spark, tmp_path, bad):
    path = tmp_path / "bad.msh"
    path.write_text(bad)
    with pytest.raises(ValueError):
        text.read_mesh(spark, f"file://{path}").elem.count()


def test_gmsh4_equals_gmsh2(spark):
    m = T.tets(spark, DATA)
    two, four = files._path(spark, "two.msh"), files._path(spark, "four.msh")
    files._gmsh(spark, m, 4, two)
    files._gmsh4(spark, m, 4, four, lambda vid: vid)
    rows = lambda df: sorted(map(str, df.collect()))
    a, b = text.read_mesh(spark, two), text.read_mesh(spark, four)
    assert rows(a.elem.select("eid", *a.verts, "class_id")) == rows(b.elem.select("eid", *b.verts, "class_id"))
    assert rows(a.vertex.select("vid", "x", "y", "z")) == rows(b.vertex.select("vid", "x", "y", "z"))
