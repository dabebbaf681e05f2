"""Hand-made cases with known answers, and agreement of the ways to walk on awkward particles."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tesselark.functions import geometry, scalar
from tesselark.operators import mesh as M, partition as PA, scatter as SC, walk as W
from tesselark.plans import tables as T

# The 8-triangle plate. Quads by (row, column): the numbers of their lower and upper triangle.
QUADS = {(0, 0): (0, 2), (0, 1): (7, 6), (1, 0): (1, 4), (1, 1): (3, 5)}
CORNERS = {(0, 0): 0, (0, 1): 1, (0, 2): 8, (1, 0): 4, (1, 1): 3, (1, 2): 5, (2, 0): 2, (2, 1): 6, (2, 2): 7}
# Start, end, parent, and the elements that may be the end's.
TRAJECTORIES = [
    (0.60, 0.80, 0.60, 0.99, 5, {5}), (0.60, 0.80, 0.94, 0.95, 5, {5}), (0.60, 0.80, 0.51, 0.91, 5, {5}), (0.40, 0.20, 0.495, 0.47, 0, {0}), (0.40, 0.20, 0.11, 0.10, 0, {0}),
    (0.40, 0.20, 0.40, 0.01, 0, {0}), (0.60, 0.80, 0.40, 0.73, 5, {1}), (0.50, 0.50, 0.80, 0.80, 0, {3, 5}), (0.50, 0.50, 0.80, 0.00, 0, {7}), (0.25, 0.25, 0.40, 0.40, 0, {0, 2}),
    (0.75, 0.25, 0.75, 0.60, 6, {3}), (0.80, 0.80, 0.40, 0.40, 5, {0, 2}), (0.75, 0.25, 0.40, 0.60, 6, {1}), (0.60, 0.40, 0.20, 0.80, 6, {4}),
]


@pytest.fixture(scope="module")
def plate(spark):
    vertices = [(v, c / 2, r / 2, 0, 2) for (r, c), v in CORNERS.items()]
    elems = []
    for (r, c), (low, high) in QUADS.items():
        a, b, d, e = (CORNERS[k] for k in ((r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c)))
        elems += [(low, a, b, d, 0), (high, a, d, e, 0)]
    vertex = spark.createDataFrame(vertices, "vid long, x double, y double, class_id int, class_dim int")
    return M.Mesh(2, vertex, spark.createDataFrame(elems, "eid long, v0 long, v1 long, v2 long, class_id int"))


def test_fourteen_trajectories(spark, plate):
    rows = [(k, t[4], *t[:4]) for k, t in enumerate(TRAJECTORIES)]
    p = spark.createDataFrame(rows, "pid long, elem_id long, ox double, oy double, tx double, ty double")
    got = {r["pid"]: r["elem_id"] for r in W.search_2d(p, M.walk_table(plate)).collect()}
    for k, t in enumerate(TRAJECTORIES):
        assert got[k] in t[5], (k, got[k])


def test_gyro_scatter_of_one_particle(spark, plate):
    """Every vertex but the centre sends its ring points to vertex 2: 2 at the centre, 12 there, 0 at vertex 8, two thirds elsewhere."""
    gyro = SC.Gyro(rmax=0.2, rings=2, points=6, theta=15.0)
    pts = SC.ring_points(plate, gyro)
    mapped = SC.ring_map(plate, pts)
    sent = pts.where("vid <> 3").select("vid", "ring", "pt", F.explode(F.array_repeat(F.lit(2).cast("long"), 3)).alias("to"))
    mapping = mapped.where("vid = 3").select("vid", "ring", "pt", "to").unionByName(sent)
    one = spark.createDataFrame([(0, 0)], "pid long, elem_id long")
    got = {r["vid"]: r["w"] for r in SC.gyro_scatter(one, plate, mapping, gyro).collect()}
    assert got[3] == pytest.approx(2) and got[2] == pytest.approx(12) and got[8] == 0
    assert all(got[v] == pytest.approx(2 / 3) for v in CORNERS.values() if v not in (2, 3, 8))


def test_barycentric_of_a_tetrahedron(spark):
    v = [[F.lit(float(x)) for x in p] for p in ((0, 0, 0), (1, 0, 0), (0.5, 0.5, 0), (0.5, 0.25, 1))]
    b = geometry.barycentric_3d(v, [F.lit(0.2), F.lit(0.1), F.lit(0.1)])
    assert list(spark.range(1).select(*(x.alias(f"b{i}") for i, x in enumerate(b))).first()) == pytest.approx([0.1, 0.15, 0.675, 0.075])


def test_ray_goes_on_where_the_segment_ends(spark):
    face = [[F.lit(float(x)) for x in p] for p in ((-1, -1, 1), (1, -1, 1), (0, 1, 1))]
    o, t = [F.lit(0.0), F.lit(-0.2), F.lit(-0.5)], [F.lit(0.0), F.lit(-0.2), F.lit(0.9)]
    r = spark.range(1).select(geometry.ray_triangle(face, o, t).alias("r"), geometry.segment_triangle(face, o, t).alias("s")).first()
    assert r["r"]["hit"] and r["r"]["z"] == pytest.approx(1.0) and not r["s"]["hit"]


def test_nulls_and_parallels_are_neither_hits_nor_angles(spark):
    """A zero vector has no angle, a null coordinate lies nowhere, and a ray along a face does not come close to it."""
    zero, null, one = [F.lit(0.0)] * 3, [F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)], [F.lit(1.0)] * 3
    angles = spark.range(1).select(scalar.angle_between(zero, one), scalar.angle_between(null, one), scalar.angle_between(one, one)).first()
    assert angles[0] is None and angles[1] is None and angles[2] == pytest.approx(0.0, abs=1e-6)
    v = [[F.lit(float(x)) for x in p] for p in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))]
    inside = spark.range(1).select(geometry.in_tet(v, null), geometry.in_tet(v, [F.lit(0.1)] * 3), scalar.all_positive([F.lit(1.0), F.lit(None).cast("double")])).first()
    assert list(inside) == [False, True, False]
    face = [[F.lit(float(x)) for x in p] for p in ((0, 0, 0), (1, 0, 0), (0, 1, 0))]
    along = spark.range(1).select(geometry.ray_triangle(face, [F.lit(0.2), F.lit(0.2), F.lit(1.0)], [F.lit(0.7), F.lit(0.2), F.lit(1.0)]).alias("r")).first()["r"]
    assert not along["hit"] and along["closeness"] is None


def test_a_way_along_the_floor_leaves_through_the_face_it_misses_by_least(spark):
    """One tetrahedron; the way is parallel to its floor and above its top, so it meets no face."""
    vertex = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1, 3), (1, 1.0, 0.0, 0.0, 1, 3), (2, 0.0, 1.0, 0.0, 1, 3), (3, 0.0, 0.0, 1.0, 1, 3)], "vid long, x double, y double, z double, class_id int, class_dim int")
    mesh = M.Mesh(3, vertex, spark.createDataFrame([(0, 0, 1, 2, 3, 1)], "eid long, v0 long, v1 long, v2 long, v3 long, class_id int"))
    p = spark.createDataFrame([(1, 0, 0.2, 0.2, 0.7, 0.9, 0.3, 0.7)], "pid long, elem_id long, ox double, oy double, oz double, tx double, ty double, tz double")
    out = W.trace(p, M.walk_table(mesh), 3, crossing=True, check_parents=False).first()
    floor = M.elem_side(mesh).where("li = 0").first()["sid"]
    assert out["face"] is not None and out["face"] != floor and out["px"] is not None


AWKWARD = [(1, 0, 5, 5, 5, 5), (2, 180, 5, 5, 5, 5), (3, 180, 5, 5, 900_000, 400_000), (4, 999_999, 1, 2, 3, 4), (5, -1, 0, 0, 9, 9), (6, 0, 50_000, 20_000, 2_000_000, 7), (7, -7, 0, 0, 9, 9)]


def test_fused_walk_equals_the_loop(spark):
    """Particles that do not move, name a wrong parent, an element that is not there or none, or leave the domain."""
    p = spark.createDataFrame(AWKWARD, "pid long, elem_id long, ox long, oy long, tx long, ty long")
    walk = M.walk_table(T.mesh(spark, DATA))
    one, two = (sorted(tuple(r) for r in x.select("pid", "elem_id", "hops").collect()) for x in (W.search_fused_2d(p, walk), W.search_2d(p, walk, tol=0.0)))
    assert one == two
    assert sorted(tuple(r) for r in W.search_fused_2d(p, walk, limit_bytes=80).collect()) == two  # a mesh above the limit


def test_recursive_walk_fails_rather_than_stops(spark):
    M.walk_table(T.mesh(spark, DATA)).createOrReplaceTempView("walk_g")
    spark.createDataFrame([(1, 0, 999_000, 999_000)], "pid long, elem_id long, tx long, ty long").createOrReplaceTempView("particles_g")
    assert spark.sql(W.recursive_walk_sql("particles_g", "walk_g")).first()["elem_id"] in (198, 199)
    with pytest.raises(Exception, match="on its way"):
        spark.sql(W.recursive_walk_sql("particles_g", "walk_g", limit=5)).collect()


def test_methods_are_parsed_and_checked(spark):
    assert PA.Method.parse(" bfs ") is PA.Method.BFS and PA.Method.parse("nothing") is PA.Method.INVALID
    with pytest.raises(ValueError):
        PA.Input(T.mesh(spark, DATA), T.owners(spark, DATA), 4, buffer_method=PA.Method.INVALID)
    with pytest.raises(ValueError):
        PA.build(PA.Input(T.mesh(spark, DATA), T.owners(spark, DATA), 4, buffer_method=PA.Method.BFS, safe_method=PA.Method.BFS, buffer_layers=1, safe_layers=2))
    assert PA.Input(T.mesh(spark, DATA), T.owners(spark, DATA), 4, buffer_method=PA.Method.NONE).buffer_method is PA.Method.MINIMUM


def test_unknown_distribution_is_an_error(spark):
    from tesselark.operators import particles as PT

    with pytest.raises(ValueError):
        PT.distribute(spark, 10, 10, 5)
    with pytest.raises(ValueError):
        PT.redistribute(spark.createDataFrame([(1, 1)], "pid long, elem_id long"), 10, 7, 1.0)


def test_no_task_sees_all_rows(spark):
    """Numbering within groups and layout metrics have no window over all rows or a whole group."""
    from tesselark.operators import particles as PT
    from tesselark.storage import place_within

    p = spark.range(1000).select(F.col("id").alias("pid"), (F.col("id") % 3).alias("elem_id"))
    for df in (place_within(p, ["elem_id"], ["pid"], "at"), PT.slots(p)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window [row_number" not in plan
    got = {(r["elem_id"], r["pid"]): r["at"] for r in place_within(p, ["elem_id"], ["pid"], "at").collect()}
    assert all(at == pid // 3 for (_, pid), at in got.items())
