"""Queries of geometry, scalar and interpolation kernels, and of mesh and partition helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.functions import geometry as G, interp, scalar
from tesselark.operators import balance, mesh as M, particles as PT, partition as PA
from tesselark.operators.field_tiles import interpolated, tiled
from tesselark.plans import tables as T
from tesselark.plans.catalogue import HALO1, HALO2, NUM3, P3, QUERIES, SQL, TET_GEO, WEIGHTS, _held, _parts, _particles_3d, HELD, query
from tesselark.plans.tables import E, ES, EV, HALF, O, P, RANKS, SIDE, V

VOLUME6 = "(SELECT CAST(h3 AS DOUBLE) * h3 * h3 FROM dims)"
ROUND = lambda cols, digits=9: [F.round(c, digits).alias(n) for n, c in cols.items()]


# points in tetrahedra


def _in_tets(spark: SparkSession, d: str, point: str):
    """Particles with the corners of their tetrahedra, and a point of theirs."""
    m = T.tets(spark, d)
    q = _particles_3d(spark, d).join(M.elem_geometry(m), F.col("elem_id") == F.col("eid"))
    return q, [[c.cast("double") for c in v] for v in M.points(m)], [F.col(f"{point}{a}").cast("double") for a in "xyz"]


IN_TETS = f"WITH {TET_GEO}, {P3}, qt AS (SELECT p3.*, tg.* FROM p3 JOIN tg ON eid = elem_id)"
_vec = lambda a, b: [f"({b}{k} - {a}{k})" for k in "xyz"]
_sub = lambda a, b: [f"({x} - {y})" for x, y in zip(b, a, strict=True)]
_at = lambda p: [f"CAST({p}{k} AS DOUBLE)" for k in "xyz"]
_cross = lambda a, b: [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
_dot = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"
_norm = lambda a: f"sqrt{_dot(a, a)}"


@query("tet_barycentric", f"{IN_TETS} SELECT pid, {', '.join(f'round(({x}) / {VOLUME6}, 9) AS b{i}' for i, x in enumerate(NUM3))} FROM qt")
def _(spark, d):
    q, v, p = _in_tets(spark, d, "t")
    return q.select("pid", *ROUND({f"b{i}": b for i, b in enumerate(G.barycentric_3d(v, p))}))


@query("tet_barycentric_unscaled", f"{IN_TETS} SELECT pid, {', '.join(f'({x}) AS b{i}' for i, x in enumerate(NUM3))} FROM qt")
def _(spark, d):
    m = T.tets(spark, d)
    q = _particles_3d(spark, d).join(M.elem_geometry(m), F.col("elem_id") == F.col("eid"))
    return q.select("pid", *(b.alias(f"b{i}") for i, b in enumerate(G.barycentric_numerators_3d(M.points(m), [F.col(f"t{a}") for a in "xyz"]))))


@query("tet_barycentric_by_vertex", f"{IN_TETS} SELECT pid, {', '.join(f'round(({NUM3[G.TET_OPPOSITE.index(i)]}) / {VOLUME6}, 9) AS b{i}' for i in range(4))} FROM qt")
def _(spark, d):
    q, v, p = _in_tets(spark, d, "t")
    return q.select("pid", *ROUND({f"b{i}": b for i, b in enumerate(G.barycentric_3d(v, p, by_vertex=True))}))


@query("point_in_tet", f"{IN_TETS} SELECT pid, least({', '.join(NUM3)}) >= -1e-10 * {VOLUME6} AS inside FROM qt")
def _(spark, d):
    q, v, p = _in_tets(spark, d, "t")
    return q.select("pid", G.in_tet(v, p).alias("inside"))


@query("triangle_barycentric_of_area", f"WITH {V}, {E}, {P}, q AS (SELECT pid, tx, ty, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2 FROM p JOIN e ON eid = elem_id JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v c ON c.vid = v2) SELECT pid, {', '.join(f'round(((x{j} - x{i}) * (ty - y{i}) - (y{j} - y{i}) * (tx - x{i})) / 1e10, 9) AS b{k}' for k, (i, j) in enumerate(((1, 2), (2, 0), (0, 1))))} FROM q")
def _(spark, d):
    m = T.mesh(spark, d)
    q = T.particles(spark, d).join(M.elem_geometry(m), F.col("elem_id") == F.col("eid"))
    return q.select("pid", *ROUND({f"b{i}": b for i, b in enumerate(G.barycentric_2d(M.points(m), [F.col("tx"), F.col("ty")], F.lit(5e9), by_vertex=True))}))


FACE = ((0.0, 0.0, 0.0), (800000.0, 0.0, 400000.0), (0.0, 800000.0, 400000.0))
_lit = lambda face: [[F.lit(v) for v in p] for p in face]
_num = lambda p: [f"CAST({v} AS DOUBLE)" for v in p]
F0, F1, F2 = map(_num, FACE)
NRM = _cross(_sub(F0, F1), _sub(F0, F2))
ON = ["CAST(ox AS DOUBLE)", "CAST(oy AS DOUBLE)", "((ox + oy) / 2.0)"]  # a point of the face's plane


@query("barycentric_in_plane", f"WITH {P} SELECT pid, " + ", ".join(f"round({_dot(_cross(_sub(a, b), _sub(a, ON)), NRM)} / {_dot(NRM, NRM)}, 9) AS b{i}" for i, (a, b) in enumerate(((F1, F2), (F2, F0), (F0, F1)))) + " FROM p")
def _(spark, d):
    p = [F.col("ox").cast("double"), F.col("oy").cast("double"), (F.col("ox") + F.col("oy")) / 2.0]
    return T.particles(spark, d).select("pid", *ROUND({f"b{i}": b for i, b in enumerate(G.barycentric_in_plane(_lit(FACE), p))}))


SEG = f"""{P}, s AS (SELECT pid, CAST(ox AS DOUBLE) AS ax, CAST(oy AS DOUBLE) AS ay, -50000.0::DOUBLE AS az, CAST(tx AS DOUBLE) AS bx, CAST(ty AS DOUBLE) AS "by", val * 90.0 AS bz FROM p),
  g AS (SELECT *, {_dot(NRM, _sub(["ax", "ay", "az"], F0))} AS before, {_dot(NRM, _sub(F0, ["bx", '"by"', "bz"]))} AS after FROM s),
  h AS (SELECT *, CASE WHEN before + after <> 0 THEN before / (before + after) END AS t FROM g), x AS (SELECT *, ax + (bx - ax) * t AS x, ay + ("by" - ay) * t AS y, az + (bz - az) * t AS z FROM h)"""
XYZ = ["x", "y", "z"]
BIN = [f"{_dot(_cross(_sub(a, b), _sub(a, XYZ)), NRM)} / {_dot(NRM, NRM)}" for a, b in ((F1, F2), (F2, F0), (F0, F1))]
SEG_HIT = f"coalesce(before >= 0 AND after >= 0 AND before + after > 0 AND least({', '.join(BIN)}) >= -1e-10 AND greatest({', '.join(BIN)}) <= 1 + 1e-10, false)"


@query("segment_triangle_by_projection", f"WITH {SEG} SELECT pid, {SEG_HIT} AS hit, CASE WHEN {SEG_HIT} THEN round(x, 3) END AS x, CASE WHEN {SEG_HIT} THEN round(z, 3) END AS z FROM x")
def _(spark, d):
    o, t = [F.col("ox").cast("double"), F.col("oy").cast("double"), F.lit(-50000.0)], [F.col("tx").cast("double"), F.col("ty").cast("double"), F.col("val") * 90.0]
    r = G.segment_triangle_projected(_lit(FACE), o, t)
    return T.particles(spark, d).select("pid", r["hit"].alias("hit"), *(F.when(r["hit"], F.round(r[a], 3)).alias(a) for a in "xz"))


# the nearest point of a triangle in space: of its plane's point where that lies within, else the nearest of the three edges' nearest points
TRI = ((300000.0, 300000.0, 0.0), (700000.0, 300000.0, 0.0), (300000.0, 700000.0, 0.0))
_edge = lambda a, b, n: f"greatest(0.0, least(1.0, ((px - {a[0]}) * ({b[0]} - {a[0]}) + (py - {a[1]}) * ({b[1]} - {a[1]})) / (({b[0]} - {a[0]}) * ({b[0]} - {a[0]}) + ({b[1]} - {a[1]}) * ({b[1]} - {a[1]})))) AS t{n}"
NEAR = f"""{P}, q AS (SELECT pid, CAST(tx AS DOUBLE) AS px, CAST(ty AS DOUBLE) AS py FROM p), w AS (SELECT *, {", ".join(_edge(TRI[i], TRI[j], n) for n, (i, j) in enumerate(((0, 1), (1, 2), (2, 0))))} FROM q),
  c AS (SELECT *, {", ".join(f"{TRI[i][k]} + t{n} * ({TRI[j][k]} - {TRI[i][k]}) AS c{'xy'[k]}{n}" for n, (i, j) in enumerate(((0, 1), (1, 2), (2, 0))) for k in (0, 1))} FROM w),
  r AS (SELECT *, {", ".join(f"(px - cx{n}) * (px - cx{n}) + (py - cy{n}) * (py - cy{n}) AS d{n}" for n in range(3))}, px >= 300000 AND py >= 300000 AND px + py <= 1000000 AS inside FROM c)"""
_nearest = lambda k: f"CASE WHEN inside THEN p{k} WHEN d0 <= d1 AND d0 <= d2 THEN c{k}0 WHEN d1 <= d2 THEN c{k}1 ELSE c{k}2 END"


@query("closest_point_on_triangle", f"""WITH {NEAR}, o AS (SELECT pid, {_nearest('x')} AS x, {_nearest('y')} AS y, inside FROM r) SELECT pid, round(x, 3) AS x, round(y, 3) AS y, 0.0::DOUBLE AS z,
  CASE WHEN x = 300000 AND y = 300000 THEN 'VTXA' WHEN x = 700000 AND y = 300000 THEN 'VTXB' WHEN x = 300000 AND y = 700000 THEN 'VTXC' WHEN y = 300000 THEN 'EDGEAB' WHEN x = 300000 THEN 'EDGEAC' WHEN inside AND x + y < 1000000 THEN 'TRIFACE' ELSE 'EDGEBC' END AS region FROM o""")
def _(spark, d):
    c = G.closest_point_on_triangle(_lit(TRI), [F.col("tx").cast("double"), F.col("ty").cast("double"), F.lit(50.0)])
    return T.particles(spark, d).select("pid", F.round(c["x"], 3).alias("x"), F.round(c["y"], 3).alias("y"), (F.round(c["z"], 3) + 0.0).alias("z"), c["region"].alias("region"))


FACES = {0: "c0 c2 c1 c3", 1: "c0 c1 c3 c2", 2: "c1 c2 c3 c0", 3: "c2 c0 c3 c1"}


def _outward(face: int) -> list[str]:
    a, b, c, far = FACES[face].split()
    n = _cross(_sub(_at(a), _at(b)), _sub(_at(a), _at(c)))
    return [f"{x} / {_norm(n)} * CASE WHEN {_dot(n, _sub(_at(a), _at(far)))} > 0 THEN -1 ELSE 1 END" for x in n]


@query("tet_face_normals", f"WITH {TET_GEO} " + " UNION ALL ".join(f"SELECT eid, {f} AS li, " + ", ".join(f"round({x}, 9) + 0.0 AS n{a}" for a, x in zip("xyz", _outward(f), strict=True)) + " FROM tg" for f in range(4)))
def _(spark, d):
    m = T.tets(spark, d)
    v = [[c.cast("double") for c in p] for p in M.points(m)]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("li"), *((F.round(x, 9) + 0.0).alias(f"n{a}") for a, x in zip("xyz", G.face_normal_of_tet(v, f), strict=True))) for f in range(4)))).alias("x")
    return M.elem_geometry(m).select("eid", each).select("eid", "x.*")


@query("tet_face_centroids", f"WITH {TET_GEO} " + " UNION ALL ".join(f"SELECT eid, {f} AS li, " + ", ".join(f"round(({' + '.join(f'{c}{a}' for c in FACES[f].split()[:3])}) / 3.0, 6) AS {a}" for a in "xyz") + " FROM tg" for f in range(4)))
def _(spark, d):
    m = T.tets(spark, d)
    v = [[c.cast("double") for c in p] for p in M.points(m)]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("li"), *(F.round(x, 6).alias(a) for a, x in zip("xyz", G.face_centroid_of_tet(v, f), strict=True))) for f in range(4)))).alias("x")
    return M.elem_geometry(m).select("eid", each).select("eid", "x.*")


@query("tet_centroids", f"WITH {TET_GEO} SELECT eid, {', '.join(f'round((c0{a} + c1{a} + c2{a} + c3{a}) / 4.0, 6) AS {a}' for a in 'xyz')} FROM tg")
def _(spark, d):
    return M.centroids(T.tets(spark, d)).select("eid", *(F.round(a, 6).alias(a) for a in "xyz"))


@query("tet_face_corners", f"WITH {TET_GEO} " + " UNION ALL ".join(f"SELECT eid, {f} AS li, {k} AS corner, {', '.join(f'{FACES[f].split()[k]}{a} AS {a}' for a in 'xyz')} FROM tg" for f in range(4) for k in range(3)))
def _(spark, d):
    m = T.tets(spark, d)
    rows = [F.struct(F.lit(f).alias("li"), F.lit(k).alias("corner"), *(c.alias(a) for a, c in zip("xyz", p, strict=True))) for f in range(4) for k, p in enumerate(G.face_of_tet(M.points(m), f))]
    return M.elem_geometry(m).select("eid", F.explode(F.array(*rows)).alias("x")).select("eid", "x.*")


@query("tet_side_orientation", f"WITH {TET_GEO}, s AS (SELECT s, row_number() OVER (ORDER BY s[1], s[2], s[3]) - 1 AS sid FROM (SELECT DISTINCT s FROM tf)), f AS (SELECT eid, 0 AS li, [v0, v2, v1] AS l FROM e UNION ALL SELECT eid, 1, [v0, v1, v3] FROM e UNION ALL SELECT eid, 2, [v1, v2, v3] FROM e UNION ALL SELECT eid, 3, [v2, v0, v3] FROM e) SELECT eid, li, sid, NOT (l = s OR [l[2], l[3], l[1]] = s OR [l[3], l[1], l[2]] = s) AS flip FROM f JOIN s ON list_sort(l) = s")
def _(spark, d):
    """Sides found by their vertices alone."""
    m = T.tets(spark, d)
    return M.reflect_down(m, M.sides(m).select("sid", "v0", "v1", "v2"))


@query("side_reflection", f"WITH {E}, {HALF}, {SIDE}, {ES} SELECT eid, CAST(li AS INTEGER) AS li, CASE WHEN sid % 5 <> 0 THEN sid END AS sid, CASE WHEN sid % 5 <> 0 THEN flip END AS flip FROM es")
def _(spark, d):
    m = T.mesh(spark, d)
    return M.reflect_down(m, M.sides(m).where("sid % 5 <> 0"))


@query("vertices_within", f"{IN_TETS} SELECT pid, least({', '.join(f'(c{i}x - ox) * (c{i}x - ox) + (c{i}y - oy) * (c{i}y - oy) + (c{i}z - oz) * (c{i}z - oz)' for i in range(4))}) <= 22500000000 AS near FROM qt")
def _(spark, d):
    q, v, p = _in_tets(spark, d, "o")
    return q.select("pid", G.any_within([p], v, 150_000.0).alias("near"))


# starts and pushes


@query("positions_in_tet", f"{IN_TETS}, u AS (SELECT *, {', '.join(f'-ln(1 - ((pid * {m} + {k}) % 1000) / 1000.0) AS e{k}' for k, m in enumerate((7, 11, 13, 17)))} FROM qt) SELECT pid, {', '.join(f'round((e0 * c0{a} + e1 * c1{a} + e2 * c2{a} + e3 * c3{a}) / (e0 + e1 + e2 + e3), 3) AS {a}' for a in 'xyz')} FROM u")
def _(spark, d):
    draws = [((F.col("pid") * m + k) % 1000) / 1000.0 for k, m in enumerate((7, 11, 13, 17))]
    return PT.uniform_in_tet(_particles_3d(spark, d).select("pid", "elem_id"), T.tets(spark, d), draws=draws).select("pid", *(F.round(a, 3).alias(a) for a in "xyz"))


@query("positions_near_vertex", f"{IN_TETS} SELECT pid, {', '.join(f'round(c2{a} * 0.999 + (c0{a} + c1{a} + c2{a} + c3{a}) / 4.0 * 0.001, 4) AS {a}' for a in 'xyz')} FROM qt")
def _(spark, d):
    return PT.near_vertices(_particles_3d(spark, d).select("pid", "elem_id"), T.tets(spark, d), [2]).select("pid", *(F.round(a, 4).alias(a) for a in "xyz"))


@query("positions_near_edge", f"{IN_TETS} SELECT pid, {', '.join(f'round((c0{a} + c3{a}) / 2.0 * 0.999 + (c0{a} + c1{a} + c2{a} + c3{a}) / 4.0 * 0.001, 4) AS {a}' for a in 'xyz')} FROM qt")
def _(spark, d):
    return PT.near_vertices(_particles_3d(spark, d).select("pid", "elem_id"), T.tets(spark, d), [0, 3]).select("pid", *(F.round(a, 4).alias(a) for a in "xyz"))


@query("particle_push_along", f"WITH {P3} SELECT pid, {', '.join(f'o{a} + (t{a} - o{a}) * 3 AS t{a}' for a in 'xyz')} FROM p3")
def _(spark, d):
    p = _particles_3d(spark, d)
    return PT.push_along(p.withColumns({f"d{a}": F.col(f"t{a}") - F.col(f"o{a}") for a in "xyz"}), 3).select("pid", "tx", "ty", "tz")


@query("particle_push_boris_field", f"""WITH {P}, a AS (SELECT pid, tx - ox + 0.25 AS mx, ty - oy - 0.5 AS my, 0.5 + 0.125 AS mz FROM p),
  r AS (SELECT *, mx + my * 0.1 - mz * 0.0 AS px, my + mz * 0.05 - mx * 0.1 AS py, mz + mx * 0.0 - my * 0.05 AS pz, 2 / (1 + 0.05 * 0.05 + 0.1 * 0.1) AS s FROM a)
  SELECT pid, round(mx + s * (py * 0.1 - pz * 0.0) + 0.25, 6) AS vx, round(my + s * (pz * 0.05 - px * 0.1) - 0.5, 6) AS vy, round(mz + s * (px * 0.0 - py * 0.05) + 0.125, 6) AS vz FROM r""")
def _(spark, d):
    p = T.particles(spark, d).withColumns({"oz": F.lit(0.0), "vx": F.col("tx") - F.col("ox"), "vy": F.col("ty") - F.col("oy"), "vz": F.lit(0.5)})
    p = p.withColumns({"ex": F.lit(0.25), "ey": F.lit(-0.5), "ez": F.lit(0.125), "bx": F.lit(0.05), "by": F.lit(0.0), "bz": F.lit(0.1)})
    return PT.push_boris(p, 1.0, 2.0).select("pid", *(F.round(f"v{a}", 6).alias(f"v{a}") for a in "xyz"))


@query("particle_map", f"WITH {P} SELECT pid, val * 2 + elem_id AS doubled FROM p")
def _(spark, d):
    import pyarrow as pa
    import pyarrow.compute as pc

    double = lambda b: pa.RecordBatch.from_arrays([b["pid"], pc.add(pc.multiply(b["val"], 2), b["elem_id"])], ["pid", "doubled"])
    return PT.particle_map(T.particles(spark, d).select("pid", "elem_id", "val"), double, "pid long, doubled long")


@query("particle_total", "SELECT CAST(7 AS INTEGER) AS iteration, count(*) AS n FROM events")
def _(spark, d):
    return PT.total_particles(T.particles(spark, d), 7)


# scalars and arrays

def _columns():
    return [F.col(c) for c in "abc"]


def _abc(spark, d):
    return T.particles(spark, d).select("pid", *((F.col(c) % m - m // 2).cast("double").alias(n) for n, c, m in (("a", "ox", 11), ("b", "oy", 13), ("c", "val", 17))))


ABC_SQL = f"{P}, q AS (SELECT pid, CAST(ox % 11 - 5 AS DOUBLE) AS a, CAST(oy % 13 - 6 AS DOUBLE) AS b, CAST(val % 17 - 8 AS DOUBLE) AS c FROM p)"


@query("almost_equal", f"WITH {ABC_SQL} SELECT pid, abs(a - b) < 1.5 OR (abs(a) <= 2 AND abs(b) <= 2) AS near, abs(a - b) < 1.5 AND abs(b - c) < 1.5 AS arrays FROM q")
def _(spark, d):
    a, b, c = _columns()
    return _abc(spark, d).select("pid", scalar.almost_equal(a, b, 1.5, 2.0).alias("near"), scalar.almost_equal_arrays(F.array(a, b), F.array(b, c), 1.5, -1.0).alias("arrays"))


@query("greatest_index", f"WITH {ABC_SQL} SELECT pid, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS at FROM q")
def _(spark, d):
    return _abc(spark, d).select("pid", scalar.max_index(_columns()).alias("at"))


@query("least_index_among_allowed", f"""WITH {ABC_SQL}, k AS (SELECT *, least(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END, CASE WHEN c > 0 THEN c END) AS m FROM q)
  SELECT pid, CAST(CASE WHEN a > 0 AND a = m THEN 0 WHEN b > 0 AND b = m THEN CAST(a > 0 AS INTEGER) WHEN c > 0 AND c = m THEN CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER) END AS INTEGER) AS at FROM k""")
def _(spark, d):
    return _abc(spark, d).select("pid", scalar.min_index_where(_columns(), [x > 0 for x in _columns()]).alias("at"))


@query("vector_angles", f"WITH {ABC_SQL}, n AS (SELECT *, sqrt(a * a + b * b + c * c) AS r FROM q) SELECT pid, CASE WHEN r > 0 THEN round(acos(greatest(-1.0, least(1.0, (a + 2 * b + 3 * c) / (r * sqrt(14.0))))), 6) END AS angle, abs((a + 2 * b + 3 * c) - r * sqrt(14.0)) < 1e-10 AS same FROM n")
def _(spark, d):
    one = [F.lit(v) for v in (1.0, 2.0, 3.0)]
    return _abc(spark, d).select("pid", F.round(scalar.angle_between(_columns(), one), 6).alias("angle"), scalar.same_direction(_columns(), one).alias("same"))


@query("spherical_coordinates", f"WITH {ABC_SQL}, n AS (SELECT *, sqrt(a * a + b * b + c * c) AS r FROM q) SELECT pid, round(r, 9) AS r, CASE WHEN a <> 0 THEN round(atan(b / a), 9) END AS theta, CASE WHEN r > 0 THEN round(acos(c / r), 9) END AS phi FROM n")
def _(spark, d):
    s = scalar.cartesian_to_spherical(*_columns())
    return _abc(spark, d).select("pid", *(F.round(s[k], 9).alias(k) for k in ("r", "theta", "phi")))


@query("array_helpers", f"WITH {ABC_SQL} SELECT pid, b AS second, a AS first, CASE WHEN pid % 2 = 0 THEN c ELSE 0 END AS last, CAST(a + b AS BIGINT) AS sum2, CAST(a + b + c AS BIGINT) AS total FROM q")
def _(spark, d):
    flat, some = F.array(*_columns()), F.when(F.col("pid") % 2 == 0, F.array(*_columns())).otherwise(F.array().cast("array<double>"))
    whole = F.transform(flat, lambda x: x.cast("long"))
    return _abc(spark, d).select("pid", scalar.vector(flat, 1, 1)[0].alias("second"), scalar.first_value(flat).alias("first"), scalar.last_value(some).alias("last"), scalar.inclusive_scan(whole)[1].alias("sum2"), scalar.exclusive_scan(whole)[3].alias("total"))


@query("sum_positives", f"WITH {ABC_SQL} SELECT count(*) AS n FROM q WHERE a > 0")
def _(spark, d):
    return PA.sum_positives(_abc(spark, d), "a")


# fields

VEC = [float((i * 7 + c * 5) % 19) for i in range(12) for c in range(3)]


def _at_grid(c: int, cyl: bool) -> str:
    """A component of the field on 4 x 3 nodes, 300000 and 400000 apart, as SQL."""
    r = "sqrt(CAST(ox AS DOUBLE) * ox + CAST(oy AS DOUBLE) * oy)" if cyl else "CAST(ox AS DOUBLE)"
    u, w = f"({r} / 300000.0)", "(val * 100 / 400000.0)"
    i, j = f"least(CAST(floor({u}) AS BIGINT), 2)", f"least(CAST(floor({w}) AS BIGINT), 1)"
    a, b = f"least({u} - {i}, 1.0)", f"least({w} - {j}, 1.0)"
    f = lambda di, dj: f"CAST(((({i} + {di}) + ({j} + {dj}) * 4) * 7 + {c * 5}) % 19 AS DOUBLE)"
    return f"({f(0, 0)} * (1 - {a}) * (1 - {b}) + {f(1, 0)} * {a} * (1 - {b}) + {f(0, 1)} * (1 - {a}) * {b} + {f(1, 1)} * {a} * {b})"


POS = lambda: [F.col("ox").cast("double"), F.col("oy").cast("double"), F.col("val") * 100.0]
_turned = ", ".join(("round(cos(th) * f0 - sin(th) * f1, 6) AS vx", "round(sin(th) * f0 + cos(th) * f1, 6) AS vy", "round(f2, 6) AS vz"))


@query("vector_field", f"WITH {P} SELECT pid, {', '.join(f'round({_at_grid(c, False)}, 6) AS v{a}' for c, a in enumerate('xyz'))} FROM p")
def _(spark, d):
    v = interp.vector_2d(F.array(*map(F.lit, VEC)), 0.0, 0.0, 300000.0, 400000.0, 4, 3, POS())
    return T.particles(spark, d).select("pid", *(F.round(x, 6).alias(f"v{a}") for a, x in zip("xyz", v, strict=True)))


@query("vector_field_cylindrical", f"WITH {P}, f AS (SELECT pid, atan2(CAST(oy AS DOUBLE), CAST(ox AS DOUBLE)) AS th, {', '.join(f'{_at_grid(c, True)} AS f{c}' for c in range(3))} FROM p) SELECT pid, {_turned} FROM f")
def _(spark, d):
    v = interp.vector_on_grid(F.array(*map(F.lit, VEC)), [0.0, 300000.0, 600000.0, 900000.0], [0.0, 400000.0, 800000.0], POS(), cylindrical=True)
    return T.particles(spark, d).select("pid", *(F.round(x, 6).alias(f"v{a}") for a, x in zip("xyz", v, strict=True)))


@query("field_on_grid", f"WITH {P} SELECT pid, round({_at_grid(1, False)}, 6) AS f FROM p")
def _(spark, d):
    f = interp.bilinear_on_grid(F.array(*map(F.lit, VEC)), [0.0, 300000.0, 600000.0, 900000.0], [0.0, 400000.0, 800000.0], POS(), cylindrical=False, n_comp=3, comp=1)
    return T.particles(spark, d).select("pid", F.round(f, 6).alias("f"))


@query("line_interpolation", f"WITH {P} SELECT pid, round(10.0 + (val - 100) / 250.0 * 20.0, 6) AS a, round(5.0 + (val - 100) / 250.0 * 2.0, 6) AS b FROM p")
def _(spark, d):
    a = interp.lerp(F.lit(10.0), F.lit(30.0), F.lit(100.0), F.lit(350.0), F.col("val"), F.lit(250.0))
    b = interp.lerp_grid(F.array(*map(F.lit, (1.0, 5.0, 7.0))), F.lit(1), F.array(*map(F.lit, (0.0, 50.0, 100.0, 350.0))), F.lit(2), F.col("val"), F.lit(250.0))
    return T.particles(spark, d).select("pid", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


@query("vector_in_tet", f"{IN_TETS}, b AS (SELECT pid, {', '.join(f'({NUM3[G.TET_OPPOSITE.index(i)]}) / {VOLUME6} AS b{i}' for i in range(4))}, {', '.join(f'c{i}x, c{i}y' for i in range(4))} FROM qt) SELECT pid, round({' + '.join(f'b{i} * c{i}x' for i in range(4))}, 3) AS fx, round({' + '.join(f'b{i} * c{i}y' for i in range(4))}, 3) AS fy FROM b")
def _(spark, d):
    q, v, p = _in_tets(spark, d, "t")
    f = interp.vector_in_element([F.array(x[0], x[1]) for x in v], G.barycentric_3d(v, p, by_vertex=True), 2)
    return q.select("pid", F.round(f[0], 3).alias("fx"), F.round(f[1], 3).alias("fy"))


TILES = f"""step AS (SELECT h / 4.0 AS w, n * 4 AS m FROM dims), fn AS (SELECT i, j, coalesce(f, 0) AS f FROM (SELECT i, j FROM range((SELECT m + 1 FROM step)) a(i), range((SELECT m + 1 FROM step)) b(j))
  LEFT JOIN (SELECT CAST(floor(ox / w) AS BIGINT) AS i, CAST(floor(oy / w) AS BIGINT) AS j, CAST(sum(val) AS DOUBLE) AS f FROM p, step GROUP BY 1, 2) USING (i, j))"""


@query("field_tiles", f"""WITH {P}, {TILES}, q AS (SELECT pid, tx / w AS x, ty / w AS y, m FROM p, step), c AS (SELECT pid, greatest(0, least(CAST(floor(x) AS BIGINT), m - 1)) AS i, greatest(0, least(CAST(floor(y) AS BIGINT), m - 1)) AS j, x, y FROM q),
  s AS (SELECT pid, i, j, least(x - i, 1.0) AS s, least(y - j, 1.0) AS t FROM c)
  SELECT pid, round(a.f * (1 - s) * (1 - t) + b.f * s * (1 - t) + k.f * (1 - s) * t + l.f * s * t, 3) AS f FROM s JOIN fn a ON a.i = s.i AND a.j = s.j JOIN fn b ON b.i = s.i + 1 AND b.j = s.j JOIN fn k ON k.i = s.i AND k.j = s.j + 1 JOIN fn l ON l.i = s.i + 1 AND l.j = s.j + 1""")
def _(spark, d):
    """A field of the events' values on a grid that grows with them, stored as tiles; each particle's target joins its tile."""
    at, p = T.size(spark, d), T.particles(spark, d)
    w, m = at.h / 4.0, at.n * 4
    sums = p.groupBy(F.floor(F.col("ox") / w).alias("i0"), F.floor(F.col("oy") / w).alias("i1")).agg(F.sum("val").alias("f"))
    nodes = spark.range((m + 1) * (m + 1)).select(F.expr(f"id div {m + 1}").alias("i0"), F.expr(f"id % {m + 1}").alias("i1")).join(sums, ["i0", "i1"], "left").fillna(0, ["f"])
    field = tiled(nodes, [interp.Axis(0.0, w, m + 1, True)] * 2, tile=16)
    return interpolated(p.select("pid", "tx", "ty"), field, [F.col("tx"), F.col("ty")]).select("pid", F.round("value", 3).alias("f"))


# partitions

OWNERS = f"{E}, {EV}, {O}"


def halo_facts(buffer: str, safe: str) -> str:
    """SQL of a row of the method matrix with 2 buffer and 1 safe layers: FULL, BFS, MINIMUM or NONE each."""
    held = {"FULL": f"SELECT CAST(k AS INTEGER) AS rank, eid FROM o, range({RANKS}) x(k)", "BFS": "SELECT b.rank, o.eid FROM (SELECT DISTINCT l2.rank, owner FROM l2 JOIN o USING (eid)) b JOIN o ON o.owner = b.owner"}
    held = held.get(buffer, "SELECT owner AS rank, eid FROM o")
    inward = """SELECT rank, eid FROM held h WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT un.rank, y.eid FROM (SELECT x.rank, o.eid FROM (SELECT DISTINCT owner AS rank FROM o) x, o WHERE NOT EXISTS (SELECT 1 FROM held k WHERE k.rank = x.rank AND k.eid = o.eid)) un JOIN ev x ON x.eid = un.eid JOIN ev y ON y.vid = x.vid) r WHERE r.rank = h.rank AND r.eid = h.eid) UNION SELECT owner, eid FROM o"""
    safes = {"FULL": inward if buffer == "BFS" else "SELECT rank, eid FROM held", "BFS": "SELECT rank, eid FROM l1", "MINIMUM": "SELECT rank, eid FROM l0", "NONE": "SELECT rank, eid FROM held WHERE false"}[safe]
    return f"WITH {HALO2}, held AS ({held}), sf AS ({safes}) SELECT h.rank, h.eid, o.owner = h.rank AS is_core, EXISTS (SELECT 1 FROM sf WHERE sf.rank = h.rank AND sf.eid = h.eid) AS is_safe FROM held h JOIN o USING (eid)"


def _matrix(buffer: str, safe: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        spec = PA.Input(T.mesh(spark, d), T.owners(spark, d), RANKS, buffer_method=PA.Method.parse(buffer.lower()), safe_method=PA.Method.parse(safe), buffer_layers=2, safe_layers=1)
        return PA.build(spec).halo

    return run


for _b in ("FULL", "BFS", "MINIMUM", "NONE"):
    for _s in ("FULL", "BFS", "MINIMUM", "NONE"):
        QUERIES[f"halo_{_b.lower()}_{_s.lower()}"] = _matrix(_b, _s)
        SQL[f"halo_{_b.lower()}_{_s.lower()}"] = halo_facts(_b, _s)


@query("buffer_counts", f"WITH {HALO2} SELECT l2.rank, count(DISTINCT owner) AS n FROM l2 JOIN o USING (eid) GROUP BY l2.rank")
def _(spark, d):
    return _parts(spark, d).buffers()


@query("part_consistency", f"WITH {HELD}, h AS (SELECT vid, sum(rank * 1000 + vid) AS w FROM held GROUP BY vid) SELECT vid FROM h WHERE vid % 3 = 0")
def _(spark, d):
    """Vertices whose sums differ after every third was raised."""
    held, _vo = _held(spark, d)
    sums = held.groupBy("vid").agg(F.sum("w").cast("double").alias("w"))
    return PA.consistency(sums, sums.withColumn("w", F.col("w") + F.when(F.col("vid") % 3 == 0, 1e-3).otherwise(0.0)), "vid", ["w"]).select("vid")


@query("migrate_allowed", f"WITH {HALO1}, {WEIGHTS} SELECT new_rank AS rank, count(*) AS n FROM m WHERE new_elem >= 0 GROUP BY new_rank")
def _(spark, d):
    """Moves to any neighbour are allowed; all moves are checked against the list."""
    parts = _parts(spark, d)
    allowed = spark.createDataFrame([(a, b) for a in range(RANKS) for b in range(RANKS)], "rank int, to int")
    moved = PT.migrate(PT.unsafe_ranks(T.ranked(spark, d), parts.halo, parts.owners), RANKS, allowed=allowed)
    return moved.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query("balance_weights_of_counts", f"WITH {HALO1}, s AS (SELECT eid, list_sort(list(rank)) AS ranks FROM l1 GROUP BY eid), si AS (SELECT ranks, CAST(row_number() OVER (ORDER BY ranks) - 1 AS INTEGER) AS sbar FROM (SELECT DISTINCT ranks FROM s)), c AS (SELECT rank, elem_id, count(*) AS n FROM r GROUP BY rank, elem_id) SELECT rank, sbar, CAST(sum(n) AS BIGINT) AS n FROM c JOIN s ON s.eid = elem_id JOIN si ON si.ranks = s.ranks GROUP BY rank, sbar")
def _(spark, d):
    counts = T.ranked(spark, d).groupBy("rank", F.col("elem_id").alias("eid")).agg(F.count(F.lit(1)).alias("n"))
    return balance.weights_from_counts(counts, balance.safe_sets(_parts(spark, d).halo))


@query("balance_of_counts", "SELECT count(*) AS n, count(*) AS pids FROM events")
def _(spark, d):
    parts = _parts(spark, d)
    counts = T.ranked(spark, d).groupBy("rank", F.col("elem_id").alias("eid")).agg(F.count(F.lit(1)).alias("n"))
    return balance.partition_counts(counts, parts.halo, parts.owners, RANKS).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pid").alias("pids"))


@query("tagged_elements", f"WITH {E}, {P}, c AS (SELECT elem_id, count(*) AS n FROM p GROUP BY elem_id) SELECT eid, n AS load, true AS has_load, CAST(5 AS INTEGER) AS tags FROM e LEFT JOIN c ON elem_id = eid")
def _(spark, d):
    m = T.mesh(spark, d)
    m = m.with_tag(2, "load", PT.per_element(T.particles(spark, d)).withColumnRenamed("n", "load"), "elem_id")
    return m.elem.select("eid", "load", F.lit(m.has_tag(2, "load")).alias("has_load"), F.lit(m.n_tags(2)).alias("tags"))
