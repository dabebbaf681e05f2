"""Named queries over the test tables and the SQL they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.functions import geometry, interp, scalar
from tesselark.operators import balance, diffusion as DF, grid, mesh as M, particles as PT, partition as PA, rank_bits as RB, scatter as SC, walk as W
from tesselark.operators.part_walk import walk_in_parts
from tesselark.operators.pic_parts import pic_parts
from tesselark.operators.scatter import Gyro
from tesselark.operators.tile_walk import ELEMENTS_AT_ONCE, deposits_in_tiles, tiles
from tesselark.plans import tables as T
from tesselark.plans.tables import CLASSES, E, ES, EV, EVENTS, G, H3, HALF, LENGTH, N, O, P, R, RANKS, SIDE, V
from tesselark.storage import cut
from tesselark.timing import Timing, across_ranks, summary

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = T.whole_sql(sql)
        return f

    return add


def joined(column: str, order: bool = True):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


# meshes


@query("mesh_vertices", f"WITH {V} SELECT vid, x, y, class_id, class_dim FROM v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.mesh(spark, d).vertex


@query("mesh_elements", f"WITH {E} SELECT eid, v0, v1, v2, class_id FROM e")
def _(spark, d):
    return T.mesh(spark, d).elem


@query("elem_vert_long", f"WITH {E}, {EV} SELECT eid, li, vid FROM ev")
def _(spark, d):
    return M.elem_vert(T.mesh(spark, d))


@query("mesh_sides", f"WITH {E}, {HALF}, {SIDE} SELECT sid, k0 AS v0, k1 AS v1, CAST(n AS INTEGER) AS n_elem, n = 1 AS exposed FROM side")
def _(spark, d):
    return M.sides(T.mesh(spark, d))


@query("exposed_sides", f"WITH {E}, {HALF}, {SIDE} SELECT sid, e0 AS eid FROM side WHERE n = 1")
def _(spark, d):
    return M.boundary_elements(M.elem_side(T.mesh(spark, d)))


@query("elem_sides", f"WITH {E}, {HALF}, {SIDE}, {ES} SELECT eid, CAST(li AS INTEGER) AS li, sid, flip, nbr FROM es")
def _(spark, d):
    return M.elem_side(T.mesh(spark, d))


@query("dual_graph", f"WITH {E}, {HALF}, {SIDE}, {ES} SELECT eid, nbr, sid FROM es WHERE nbr IS NOT NULL")
def _(spark, d):
    return M.dual(T.mesh(spark, d))


@query("vertex_star", f"WITH {E}, {EV} SELECT vid, count(*) AS degree, string_agg(CAST(eid AS VARCHAR), ',' ORDER BY eid) AS elems FROM ev GROUP BY vid")
def _(spark, d):
    return M.up(M.elem_vert(T.mesh(spark, d)), "vid", "eid").select("vid", "degree", joined("eid").alias("elems"))


@query("first_adjacent_element", f"WITH {E}, {EV} SELECT vid, min(eid) AS eid FROM ev GROUP BY vid")
def _(spark, d):
    return M.first_adjacent(T.mesh(spark, d))


@query("elem_measure", f"WITH {E} SELECT eid, CAST({T.H} AS DOUBLE) * {T.H} / 2 AS measure FROM e")
def _(spark, d):
    return M.measures(T.mesh(spark, d))


@query("elem_centroid", f"WITH {V}, {E}, {EV} SELECT eid, round(sum(x) / 3.0, 4) AS x, round(sum(y) / 3.0, 4) AS y FROM ev JOIN v USING (vid) GROUP BY eid")
def _(spark, d):
    return M.centroids(T.mesh(spark, d)).select("eid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("mesh_bbox", f"WITH {V} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM v")
def _(spark, d):
    return M.bounding_box(T.mesh(spark, d))


@query("walk_tolerance", f"SELECT greatest(1e-15 / (CAST({T.H} AS DOUBLE) * {T.H} / 2), 1e-8) AS tol")
def _(spark, d):
    return M.walk_tolerance(T.mesh(spark, d))


@query("class_histogram", f"WITH {V} SELECT class_dim, count(*) AS n FROM v GROUP BY class_dim")
def _(spark, d):
    return M.class_histogram(T.mesh(spark, d).vertex)


@query("reverse_classification", f"WITH {E} SELECT class_id, row_number() OVER (PARTITION BY class_id ORDER BY eid) - 1 AS pos, eid FROM e")
def _(spark, d):
    return M.reverse_classification(T.mesh(spark, d).elem, "eid")


@query("class_statistics", f"WITH {E}, c AS (SELECT class_id, count(*) AS n FROM e GROUP BY class_id) SELECT max(n) AS max_n, min(n) AS min_n, CAST(sum(n) AS BIGINT) AS sum_n, count(*) AS n_classes FROM c")
def _(spark, d):
    return M.class_statistics(T.mesh(spark, d).elem)


@query("exposed_faces", f"""WITH {E}, {HALF}, {SIDE}, {ES} SELECT eid, coalesce(string_agg(CAST(li AS VARCHAR), ',' ORDER BY li) FILTER (WHERE nbr IS NULL), '') AS exposed,
  coalesce(string_agg(CAST(li AS VARCHAR), ',' ORDER BY li) FILTER (WHERE nbr IS NOT NULL), '') AS interior FROM es GROUP BY eid""")
def _(spark, d):
    return M.exposed_faces(M.elem_side(T.mesh(spark, d))).select("eid", joined("exposed").alias("exposed"), joined("interior").alias("interior"))


@query("elements_at_flagged_sides", f"WITH {E}, {HALF}, {SIDE}, {ES} SELECT DISTINCT eid FROM es WHERE sid % 7 = 0")
def _(spark, d):
    side = M.elem_side(T.mesh(spark, d))
    return M.mark_up(side.select("sid", "eid"), side.where("sid % 7 = 0"), "sid", "eid")


@query("near_element_pairs", f"""WITH {V}, {E}, {EV}, q AS (SELECT eid, x, y FROM ev JOIN v USING (vid))
  SELECT DISTINCT a.eid AS a, b.eid AS b FROM q a JOIN q b ON a.eid < b.eid AND CAST(a.x - b.x AS BIGINT) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= CAST({T.H} AS BIGINT) * {T.H}""")
def _(spark, d):
    return M.near_pairs(T.mesh(spark, d), float(T.size(spark, d).h))


TET_SQL = f"""q AS (SELECT i, j, k FROM range({T.TET_N}) a(i), range({T.TET_N}) b(j), range({T.TET_N}) c(k)),
t AS (SELECT * FROM (VALUES {", ".join(f"({n}, {', '.join(map(str, c))})" for n, c in enumerate(M.CUBE_TETS))}) x(t, c0, c1, c2, c3)),
e AS (SELECT ((i * {T.TET_N} + j) * {T.TET_N} + k) * 6 + t AS eid, {", ".join(f"(i + c{n} % 2) * {(T.TET_N + 1) ** 2} + (j + c{n} // 2 % 2) * {T.TET_N + 1} + k + c{n} // 4 AS v{n}" for n in range(4))} FROM q, t)"""


@query("tet_elements", f"WITH {TET_SQL} SELECT eid, v0, v1, v2, v3, 1 AS class_id FROM e")
def _(spark, d):
    return T.tets(spark, d).elem


@query("tet_volumes", f"WITH {TET_SQL} SELECT eid, CAST({H3} AS DOUBLE) * {H3} * {H3} / 6 AS measure FROM e")
def _(spark, d):
    return M.measures(T.tets(spark, d))


@query("tet_faces", f"""WITH {TET_SQL}, f AS (SELECT list_sort([v0, v2, v1]) AS s FROM e UNION ALL SELECT list_sort([v0, v1, v3]) FROM e UNION ALL SELECT list_sort([v1, v2, v3]) FROM e UNION ALL SELECT list_sort([v2, v0, v3]) FROM e)
  SELECT row_number() OVER (ORDER BY s[1], s[2], s[3]) - 1 AS sid, s[1] AS v0, s[2] AS v1, s[3] AS v2, CAST(count(*) AS INTEGER) AS n_elem, count(*) = 1 AS exposed FROM f GROUP BY s""")
def _(spark, d):
    return M.sides(T.tets(spark, d))


@query("tet_edges", f"""WITH {TET_SQL}, p AS (SELECT v0 AS a, v1 AS b FROM e UNION SELECT v0, v2 FROM e UNION SELECT v0, v3 FROM e UNION SELECT v1, v2 FROM e UNION SELECT v1, v3 FROM e UNION SELECT v2, v3 FROM e),
  s AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM p) SELECT row_number() OVER (ORDER BY a, b) - 1 AS edge, a, b FROM s""")
def _(spark, d):
    return M.edges(T.tets(spark, d)).select("edge", "a", "b")


# particles: creation, push


@query("particle_even_distribution", f"SELECT i AS elem_id, CAST({EVENTS} // {2 * N * N} + CASE WHEN i < {EVENTS} % {2 * N * N} THEN 1 ELSE 0 END AS BIGINT) AS n FROM range({2 * N * N}) x(i)")
def _(spark, d):
    at = T.size(spark, d)
    return PT.per_element(PT.even_distribution(spark, at.elements, at.events))


def _uniform(i, k: int):
    """A number in [0, 1) made from a whole number, which SQL makes as well."""
    return ((i * (2654435761, 1597334677)[k] + (12345, 678901)[k]) % 4294967296 + 0.5) / 4294967296.0


DRAW_SQL = "((i * 2654435761 + 12345) % 4294967296 + 0.5) / 4294967296.0 AS u, ((i * 1597334677 + 678901) % 4294967296 + 0.5) / 4294967296.0 AS v"


def drawn_sql(n: int, even: str) -> list[str]:
    """The element of each strategy from u and v."""
    clamp = lambda x: f"CAST(greatest(0, least({x}, {n - 1})) AS BIGINT)"
    first = f"CAST(floor({n} * 0.4) AS BIGINT)"
    return [
        even, clamp(f"floor(u * {n})"), clamp(f"floor(sqrt(-2 * ln(1 - u)) * cos(2 * 3.141592653589793 * v) * ({n} / 8.0) + {n} / 2.0)"),
        clamp(f"floor(-ln(1 - u * (1 - exp(-4.0))) / 4.0 * {n})"), clamp(f"CASE WHEN u < 0.85 THEN floor(v * {first}) ELSE {first} + floor(v * ({n} - {first})) END"),
    ]


def _distributed(spark, at, k: int) -> DataFrame:
    """As many particles as there are events, dealt to the elements."""
    return PT.per_element(PT.distribute(spark, at.elements, at.events, k, draws=(_uniform(F.col("pid"), 0), _uniform(F.col("pid"), 1))))


for _k, _name in enumerate(PT.STRATEGIES[1:], 1):
    SQL[f"particle_{_name}_distribution"] = f"WITH q AS (SELECT i, {DRAW_SQL} FROM range({EVENTS}) x(i)) SELECT {drawn_sql(2 * N * N, '0')[_k]} AS elem_id, count(*) AS n FROM q GROUP BY 1"
    QUERIES[f"particle_{_name}_distribution"] = lambda spark, d, k=_k: _distributed(spark, T.size(spark, d), k)

for _k, _name in enumerate(PT.STRATEGIES):
    _even = f"CASE WHEN i < (t // {2 * N * N} + 1) * (t % {2 * N * N}) THEN i // (t // {2 * N * N} + 1) ELSE t % {2 * N * N} + (i - (t // {2 * N * N} + 1) * (t % {2 * N * N})) // greatest(t // {2 * N * N}, 1) END"
    SQL[f"particle_redistribute_{_name}"] = f"""WITH {P}, m AS (SELECT pid, elem_id, row_number() OVER (ORDER BY pid) - 1 AS i, count(*) OVER () AS t FROM p WHERE val % 100 < 40), q AS (SELECT *, {DRAW_SQL} FROM m)
      SELECT p.pid, coalesce(i, -1) AS mover, CASE WHEN i IS NULL THEN p.elem_id ELSE {drawn_sql(2 * N * N, _even)[_k]} END AS new_elem FROM p LEFT JOIN q ON q.pid = p.pid"""
    QUERIES[f"particle_redistribute_{_name}"] = lambda spark, d, k=_k: PT.redistribute(
        T.particles(spark, d), T.size(spark, d).elements, k, 0.395, chance=(F.col("val") % 100) / 100.0, draws=(_uniform(F.col("mover"), 0), _uniform(F.col("mover"), 1))
    ).select("pid", "mover", "new_elem")


@query("particles_from_counts", f"WITH {P}, c AS (SELECT elem_id, count(*) AS n FROM p GROUP BY elem_id) SELECT elem_id, unnest(range(n)) AS slot FROM c")
def _(spark, d):
    return PT.from_counts(PT.per_element(T.particles(spark, d)))


@query("source_elements_by_face", f"""WITH {E}, {HALF}, {SIDE}, {V}, m AS (SELECT DISTINCT e0 AS eid FROM side JOIN v ON vid = k0 WHERE n = 1 AND y = 0 AND k0 % {N + 1} = 0 AND k1 % {N + 1} = 0)
  SELECT eid AS elem_id, {EVENTS} // (SELECT count(*) FROM m) + CASE WHEN eid = (SELECT max(eid) FROM m) THEN {EVENTS} % (SELECT count(*) FROM m) ELSE 0 END AS n FROM m""")
def _(spark, d):
    m, at = T.mesh(spark, d), T.size(spark, d)
    flagged = M.sides(m).where(f"v0 % {at.n + 1} = 0 and v1 % {at.n + 1} = 0")
    return PT.source_elements_by_face(M.elem_side(m), flagged, at.events)


@query("source_elements_capped", f"""WITH {P}, c AS (SELECT elem_id AS eid, count(*) FILTER (WHERE species = 'purchase') AS n FROM p GROUP BY elem_id), w AS (SELECT eid, n, sum(n) OVER (ORDER BY eid) - n AS before FROM c)
  SELECT eid AS elem_id, CAST(greatest(0, least(n, {EVENTS} // 20 - before)) + CASE WHEN eid = (SELECT max(eid) FROM w) THEN greatest({EVENTS} // 20 - (SELECT sum(n) FROM w), 0) ELSE 0 END AS BIGINT) AS n FROM w""")
def _(spark, d):
    wanted = T.particles(spark, d).groupBy("elem_id").agg(F.count_if(F.col("species") == "purchase").alias("n"))
    return PT.capped_counts(wanted, T.size(spark, d).events // 20)


@query("source_elements_normal")
def _(spark, d):
    """As many particles as events on rank 2's elements of classes 0 to 3, by normal draws."""
    elem = T.mesh(spark, d).elem.join(T.owners(spark, d), "eid")
    return PT.source_elements_by_class(elem, 2, 3, T.size(spark, d).events, seed=7)


@query("particle_push_constant", f"WITH {P} SELECT pid, ox + 3000 AS tx, oy - 1500 AS ty FROM p")
def _(spark, d):
    return PT.push_constant(T.particles(spark, d), F.lit(500), [6, -3]).select("pid", "tx", "ty")


@query("particle_push_elliptical", f"""WITH {E}, {P}, q AS (SELECT p.pid, class_id, atan2(2.0 * (oy - 500000), ox - 400000) AS phi, oy - 500000 AS z, ox - 400000 AS w FROM p JOIN e ON eid = elem_id),
  b AS (SELECT *, CASE WHEN sin(phi) = 0 THEN abs(w) / 2.0 ELSE z / sin(phi) END AS b, phi + radians(10) * CASE WHEN class_id = 1 THEN 0.01 ELSE 1.0 / greatest(class_id, 1) END AS f FROM q)
  SELECT pid, round(400000 + 2.0 * b * cos(f), 3) AS tx, round(500000 + b * sin(f), 3) AS ty FROM b""")
def _(spark, d):
    p = PT.elliptical_setup(T.particles(spark, d), 400000.0, 500000.0, 2.0)
    return PT.elliptical_push(p, T.mesh(spark, d).elem, 400000.0, 500000.0, 2.0, 10.0).select("pid", F.round("tx", 3).alias("tx"), F.round("ty", 3).alias("ty"))


@query("particle_push_boris", f"""WITH {P}, a AS (SELECT pid, ox, oy, tx - ox AS mx, ty - oy AS my, 0.5 AS mz FROM p),
  r AS (SELECT *, mx + my * 0.1 - mz * 0.0 AS px, my + mz * 0.05 - mx * 0.1 AS py, mz + mx * 0.0 - my * 0.05 AS pz, 2 / (1 + 0.05 * 0.05 + 0.1 * 0.1) AS s FROM a)
  SELECT pid, round(mx + s * (py * 0.1 - pz * 0.0), 6) AS vx, round(my + s * (pz * 0.05 - px * 0.1), 6) AS vy, round(mz + s * (px * 0.0 - py * 0.05), 6) AS vz FROM r""")
def _(spark, d):
    p = T.particles(spark, d).withColumns({"oz": F.lit(0.0), "vx": F.col("tx") - F.col("ox"), "vy": F.col("ty") - F.col("oy"), "vz": F.lit(0.5)})
    p = p.withColumns({f"e{a}": F.lit(0.0) for a in "xyz"} | {"bx": F.lit(0.05), "by": F.lit(0.0), "bz": F.lit(0.1)})
    return PT.push_boris(p, 1.0, 2.0).select("pid", *(F.round(f"v{a}", 6).alias(f"v{a}") for a in "xyz"))


@query("particle_commit", f"WITH {P} SELECT pid, tx AS ox, ty AS oy, 0 * tx AS tx, 0 * ty AS ty FROM p")
def _(spark, d):
    return PT.commit_positions(T.particles(spark, d)).select("pid", "ox", "oy", "tx", "ty")


@query("particle_displacements", f"WITH {P} SELECT pid, elem_id, tx - ox AS dx, ty - oy AS dy FROM p")
def _(spark, d):
    return PT.displacements(T.particles(spark, d))


@query("pseudo_push", f"WITH {P} SELECT pid, round(17 * 1.0 * 0 + sum(sqrt(val + elem_id + i)), 4) AS total FROM p, range(17) x(i) GROUP BY pid")
def _(spark, d):
    p = T.particles(spark, d).select("pid", "elem_id", F.array_repeat(F.col("val").cast("double"), 17).alias("d"), F.array_repeat(F.lit(0), 4).alias("n"), F.lit(0).cast("long").alias("l"))
    return PT.pseudo_push(p).select("pid", F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("centroid_positions", f"WITH {V}, {E}, {EV}, {P}, c AS (SELECT eid, sum(x) / 3.0 AS x, sum(y) / 3.0 AS y FROM ev JOIN v USING (vid) GROUP BY eid) SELECT pid, round(x, 4) AS x, round(y, 4) AS y FROM p JOIN c ON eid = elem_id")
def _(spark, d):
    return PT.at_centroid(T.particles(spark, d).select("pid", "elem_id"), T.mesh(spark, d)).select("pid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("positions_in_triangle", f"""WITH {V}, {E}, {P}, q AS (SELECT pid, elem_id, (val % 100) / 100.0 AS r1, (val // 100 % 100) / 100.0 AS r2 FROM p),
  w AS (SELECT *, CASE WHEN r1 + r2 > 1 THEN 1 - r1 ELSE r1 END AS a, CASE WHEN r1 + r2 > 1 THEN 1 - r2 ELSE r2 END AS b FROM q)
  SELECT pid, round(CAST(c0.x + a * (c1.x - c0.x) + b * (c2.x - c0.x) AS DOUBLE), 3) AS x, round(CAST(c0.y + a * (c1.y - c0.y) + b * (c2.y - c0.y) AS DOUBLE), 3) AS y
  FROM w JOIN e ON eid = elem_id JOIN v c0 ON c0.vid = v0 JOIN v c1 ON c1.vid = v1 JOIN v c2 ON c2.vid = v2""")
def _(spark, d):
    p = T.particles(spark, d)
    out = PT.uniform_in_triangle(p, T.mesh(spark, d), (F.col("val") % 100) / 100.0, F.expr("val div 100 % 100") / 100.0)
    return out.select("pid", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("sunflower_targets", f"WITH {P} SELECT pid, round(500000 + 1000 * CASE WHEN pid >= 999968 THEN 1.0 ELSE sqrt(pid + 0.5) / sqrt(1000000 - 1001 / 2.0) END * cos(pid * (2 * 3.141592653589793 / pow((sqrt(5.0) + 1) / 2, 2))), 2) AS x FROM p")
def _(spark, d):
    x, _y = PT.sunflower(F.col("pid"), 1_000_000, 1000.0, (500000.0, 500000.0))
    return T.particles(spark, d).select("pid", F.round(x, 2).alias("x"))


@query("linear_targets", f"WITH {P} SELECT pid, round(10 + pid / 99999.0 * 980, 6) AS x, round(20 + pid / 99999.0 * 480, 6) AS y FROM p")
def _(spark, d):
    x, y = PT.linear(F.col("pid"), 100_000, (10.0, 20.0), (990.0, 500.0))
    return T.particles(spark, d).select("pid", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


# geometry

NUM = ["(x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)", "(x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)", "(x0 - x2) * (py - y2) - (y0 - y2) * (px - x2)"]
GEO = f"{V}, {E}, {HALF}, {SIDE}, {ES}, {G}"


@query("particle_barycentric", f"WITH {GEO}, {P} SELECT pid, {', '.join(f'{x} AS b{i}' for i, x in enumerate(NUM))} FROM (SELECT p.pid, tx AS px, ty AS py, g.* FROM p JOIN g ON eid = elem_id)")
def _(spark, d):
    m = T.mesh(spark, d)
    q = T.particles(spark, d).join(M.elem_geometry(m), F.col("elem_id") == F.col("eid"))
    return q.select("pid", *(b.alias(f"b{i}") for i, b in enumerate(geometry.barycentric_numerators_2d(M.points(m), [F.col("tx"), F.col("ty")]))))


@query("in_parent_check", f"WITH {GEO}, {P} SELECT pid, least({', '.join(NUM)}) >= 0 AS ok FROM (SELECT p.pid, ox AS px, oy AS py, g.* FROM p JOIN g ON eid = (elem_id + pid % 3) % {2 * N * N})")
def _(spark, d):
    p = T.particles(spark, d).withColumn("elem_id", (F.col("elem_id") + F.col("pid") % 3) % T.size(spark, d).elements)
    return W.check_initial_parents(p, M.walk_table(T.mesh(spark, d)), 2, 0.0).select("pid", "ok")


@query("segment_edge_hits", f"""WITH {P}, s AS (SELECT *, (tx - ox) * 1000000 - 0 * (ty - oy) AS det, (500000 - ox) * 1000000 - (0 - oy) * 0 AS s, (500000 - ox) * (ty - oy) - (0 - oy) * (tx - ox) AS t FROM p)
  SELECT pid, det > 0 AND s BETWEEN 0 AND det AND t BETWEEN 0 AND det AS hit FROM s""")
def _(spark, d):
    a, b = [F.lit(500000), F.lit(0)], [F.lit(500000), F.lit(1000000)]
    r = geometry.line_edge_2d(a, b, [F.col("ox"), F.col("oy")], [F.col("tx"), F.col("ty")])
    return T.particles(spark, d).select("pid", r["hit"].alias("hit"))


FACE3 = ((200000, 0, 0), (900000, 200000, 100000), (300000, 900000, 50000))
RAY = f"""{P}, q AS (SELECT pid, CAST(ox AS DOUBLE) AS ax, CAST(oy AS DOUBLE) AS ay, -200000.0::DOUBLE AS az, CAST(tx - ox AS DOUBLE) AS dx, CAST(ty - oy AS DOUBLE) AS dy, CAST(val * 20 AS DOUBLE) AS dz FROM p),
  n AS (SELECT *, -8e10 AS nx, -2.5e10 AS ny, 6.1e11 AS nz FROM q),
  h AS (SELECT *, nx * dx + ny * dy + nz * dz AS dproj FROM n), i AS (SELECT *, -(nx * (ax - 200000) + ny * ay + nz * az) / nullif(dproj, 0) AS t FROM h),
  x AS (SELECT *, ax + dx * t - 200000 AS rx, ay + dy * t AS ry, az + dz * t AS rz, nx * nx + ny * ny + nz * nz AS nn FROM i),
  w AS (SELECT *, ((ry * 50000 - rz * 900000) * nx + (rz * 100000 - rx * 50000) * ny + (rx * 900000 - ry * 100000) * nz) / nn AS u,
    ((200000 * rz - 100000 * ry) * nx + (100000 * rx - 700000 * rz) * ny + (700000 * ry - 200000 * rx) * nz) / nn AS vv FROM x)"""
RAY_HIT = "coalesce(dproj >= 1e-10 AND t >= -1e-10 AND u >= -1e-10 AND vv >= -1e-10 AND u + vv <= 1 + 2e-10, false)"


def _rays(spark, d, test):
    p = T.particles(spark, d)
    o = [F.col("ox").cast("double"), F.col("oy").cast("double"), F.lit(-200000.0)]
    t = [F.col("tx").cast("double"), F.col("ty").cast("double"), F.lit(-200000.0) + F.col("val") * 20]
    r = test([[F.lit(float(v)) for v in p] for p in FACE3], o, t)
    return p.select("pid", r["hit"].alias("hit"), F.when(r["hit"], F.round(r["z"], 3)).alias("z"))


@query("ray_triangle_hits", f"WITH {RAY} SELECT pid, {RAY_HIT} AS hit, CASE WHEN {RAY_HIT} THEN round(az + dz * t, 3) END AS z FROM w")
def _(spark, d):
    return _rays(spark, d, geometry.ray_triangle)


@query("segment_triangle_hits", f"WITH {RAY} SELECT pid, {RAY_HIT} AND coalesce(t <= 1 + 1e-10, false) AS hit, CASE WHEN {RAY_HIT} AND t <= 1 + 1e-10 THEN round(az + dz * t, 3) END AS z FROM w")
def _(spark, d):
    return _rays(spark, d, geometry.segment_triangle)


@query("argmin_ties", f"WITH {P}, q AS (SELECT pid, pid % 4 AS a, pid // 4 % 4 AS b, pid // 16 % 4 AS c FROM p) SELECT pid, CASE WHEN least(a, b) < c THEN CASE WHEN a < b THEN 0 ELSE 1 END ELSE 2 END AS later, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS first FROM q")
def _(spark, d):
    q = T.particles(spark, d).select("pid", (F.col("pid") % 4).alias("a"), F.expr("pid div 4 % 4").alias("b"), F.expr("pid div 16 % 4").alias("c"))
    v = [F.col(x) for x in "abc"]
    return q.select("pid", scalar.min3(*v).alias("later"), scalar.min_index(v).alias("first"))


@query("exclusive_scan", f"WITH {P}, c AS (SELECT elem_id, count(*) AS n FROM p GROUP BY elem_id) SELECT elem_id, n, CAST(coalesce(sum(n) OVER (ORDER BY elem_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM c")
def _(spark, d):
    from tesselark.storage import running_sum

    return running_sum(PT.per_element(T.particles(spark, d)), ["elem_id"], "n", "before").select("elem_id", "n", "before")


# walks

WALK = f"WITH RECURSIVE {GEO}, {P}, {T.walk_sql()}"


def _walk(spark, d):
    return W.search_2d(T.particles(spark, d), M.walk_table(T.mesh(spark, d)), tol=0.0)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Particles and their mean value in each element after one push."""
    found = W.search_fused_2d(T.particles(spark, d), M.walk_table(T.mesh(spark, d))).where("elem_id >= 0")
    values = T.particles(spark, d).select("pid", "val")
    return found.join(values, "pid").groupBy("elem_id").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("sum_val"), F.max("hops").alias("max_hops"))


@query("walk2d_final_element", f"{WALK} SELECT pid, elem_id, hops FROM last")
def _(spark, d):
    return _walk(spark, d).select("pid", "elem_id", "hops")


@query("walk2d_fused", SQL["walk2d_final_element"])
def _(spark, d):
    return W.search_fused_2d(T.particles(spark, d), M.walk_table(T.mesh(spark, d)))


@query("walk2d_recursive", SQL["walk2d_final_element"])
def _(spark, d):
    """A recursive query for as many hops as Spark's limits of a recursion leave room for; the rest of the ways inside tiles."""
    return W.search_recursive_2d(T.particles(spark, d), M.walk_table(T.mesh(spark, d)))


@query("walk2d_hops", f"{WALK} SELECT hops, count(*) AS n FROM last GROUP BY hops")
def _(spark, d):
    return _walk(spark, d).groupBy("hops").agg(F.count(F.lit(1)).alias("n"))


@query("walk2d_exited", f"{WALK} SELECT p.pid FROM p JOIN last ON last.pid = p.pid WHERE last.elem_id = -1")
def _(spark, d):
    return _walk(spark, d).where("elem_id = -1").select("pid")


@query("walk2d_looplimit", f"{WALK} SELECT p.pid, CASE WHEN hops > 3 OR (hops = 3 AND last.elem_id >= 0 AND NOT EXISTS (SELECT 1 FROM hop h WHERE h.pid = last.pid AND h.hops = 3 AND h.moves = false AND h.elem_id >= 0 AND false)) THEN -1 ELSE last.elem_id END AS elem_id FROM p JOIN last ON last.pid = p.pid")
def _(spark, d):
    return W.search_2d(T.particles(spark, d), M.walk_table(T.mesh(spark, d)), looplimit=3, tol=0.0).select("pid", "elem_id")


@query("walk2d_particles_per_element", f"{WALK} SELECT elem_id, count(*) AS n, CAST(sum(val) AS BIGINT) AS sum_val, max(hops) AS max_hops FROM last JOIN p USING (pid) WHERE last.elem_id >= 0 GROUP BY last.elem_id".replace("SELECT elem_id, count", "SELECT last.elem_id AS elem_id, count"))
def _(spark, d):
    return flagship(spark, d)


LARGE = T.sql_of(N * T.LARGE)


@query("walk2d_large_mesh", f"WITH RECURSIVE {LARGE.V}, {LARGE.E}, {LARGE.HALF}, {LARGE.SIDE}, {LARGE.ES}, {LARGE.G}, {LARGE.P}, {T.walk_sql()} SELECT pid, elem_id, hops FROM last")
def _(spark, d):
    """A mesh of 25 times as many triangles, joined by shuffle: no mesh is broadcast."""
    n = T.size(spark, d).n * T.LARGE
    return W.trace(T.particles(spark, d, n), M.walk_table(T.mesh(spark, d, n)), 2, tol=0.0, check_parents=False).select("pid", "elem_id", "hops")


@query("walk2d_in_parts", SQL["walk2d_large_mesh"])
def _(spark, d):
    """The same mesh in sixteen parts or more, of about equally many elements and at most ELEMENTS_AT_ONCE, each with two layers of its neighbours' elements: a round a part crossed."""
    n = T.size(spark, d).n * T.LARGE
    m = T.mesh(spark, d, n)
    walk = cut(M.walk_table(m))
    owners = tiles(walk, 2, min(ELEMENTS_AT_ONCE, n * n // 8))[0].withColumnRenamed("tile", "owner")
    held = PA.bfs_layers(owners, PA.bridge(m), 2).select("rank", "eid")
    return walk_in_parts(T.particles(spark, d, n), walk, owners, held, particles_at_once=2 * ELEMENTS_AT_ONCE).select("pid", "elem_id", "hops")


INSIDE = f"tx BETWEEN 0 AND {LENGTH - 1} AND ty BETWEEN 0 AND {LENGTH - 1}"
#: Where the way of a particle leaves the square: the least share of the way at which a coordinate passes a border.
BOX2 = f"""{P}, b AS (SELECT *, least(CASE WHEN tx > {LENGTH} THEN ({LENGTH}.0 - ox) / (tx - ox) WHEN tx < 0 THEN ox / (ox - tx + 0.0) ELSE 2 END, CASE WHEN ty > {LENGTH} THEN ({LENGTH}.0 - oy) / (ty - oy) WHEN ty < 0 THEN oy / (oy - ty + 0.0) ELSE 2 END) AS t FROM p)"""


@query("walk2d_intersections", f"WITH {BOX2} SELECT pid, t <= 1 AS hit, CASE WHEN t <= 1 THEN round(ox + (tx - ox) * t, 2) END AS px, CASE WHEN t <= 1 THEN round(oy + (ty - oy) * t, 2) END AS py FROM b")
def _(spark, d):
    out = W.trace(T.particles(spark, d), M.walk_table(T.mesh(spark, d)), 2, crossing=True, tol=0.0)
    hit = F.col("face").isNotNull()
    return out.select("pid", hit.alias("hit"), *(F.when(hit, F.round(p, 2)).alias(p) for p in ("px", "py")))


def _particles_3d(spark, d):
    """Whole-numbered starts and targets in the cube and around it."""
    p, at = T.particles(spark, d), T.size(spark, d)
    h, n3 = at.h3, at.n3
    place = {"ox": F.expr("ox * 9 div 10"), "oy": F.expr("oy * 9 div 10"), "oz": F.col("val") * 7919 % 900_000}
    p = p.withColumns(place).withColumns({"tx": F.expr("ox + (tx - oy) div 7"), "ty": F.col("oy") + F.col("val") * 3 - 9000, "tz": F.col("oz") - F.col("val") * 2 + 7001})
    i, j, k = (F.floor(F.col(f"o{a}") / h) for a in "xyz")
    x, y, z = (F.col(f"o{a}") % h for a in "xyz")
    t = F.when((x >= y) & (y >= z), 0).when((y >= x) & (x >= z), 1).when((y >= z) & (z >= x), 2).when((z >= y) & (y >= x), 3).when((z >= x) & (x >= y), 4).otherwise(5)
    return p.withColumn("elem_id", (((i * n3 + j) * n3 + k) * 6 + t).cast("long"))


def _tet_of(p: str) -> str:
    """The element of the lattice that holds a point."""
    x, y, z = (f"({p}{a} % {H3})" for a in "xyz")
    return f"""((({p}x // {H3}) * {T.TET_N} + {p}y // {H3}) * {T.TET_N} + {p}z // {H3}) * 6 + CASE WHEN {x} >= {y} AND {y} >= {z} THEN 0 WHEN {y} >= {x} AND {x} >= {z} THEN 1 WHEN {y} >= {z} AND {z} >= {x} THEN 2 WHEN {z} >= {y} AND {y} >= {x} THEN 3 WHEN {z} >= {x} AND {x} >= {y} THEN 4 ELSE 5 END"""


P3 = f"""{P}, p3a AS (SELECT pid, ox * 9 // 10 AS ox, oy * 9 // 10 AS oy, val * 7919 % 900000 AS oz, tx AS wx, val FROM p),
  p3b AS (SELECT pid, val, ox, oy, oz, ox + CAST(trunc((wx - oy) / 7.0) AS BIGINT) AS tx, oy + val * 3 - 9000 AS ty, oz - val * 2 + 7001 AS tz FROM p3a), p3 AS (SELECT *, {_tet_of("o")} AS elem_id FROM p3b)"""
_dot = lambda a, b, c, q: (
    f"-((({b}y - {a}y) * ({c}z - {a}z) - ({b}z - {a}z) * ({c}y - {a}y)) * ({q}x - {a}x) + (({b}z - {a}z) * ({c}x - {a}x) - ({b}x - {a}x) * ({c}z - {a}z)) * ({q}y - {a}y) + (({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x)) * ({q}z - {a}z))"
)
NUM3 = [_dot(*(f"c{i}" for i in face), "t") for face in geometry.TET_FACES]
TET_GEO = f"""{TET_SQL}, tv AS (SELECT i * {(T.TET_N + 1) ** 2} + j * {T.TET_N + 1} + k AS vid, i * {H3} AS x, j * {H3} AS y, k * {H3} AS z FROM range({T.TET_N + 1}) a(i), range({T.TET_N + 1}) b(j), range({T.TET_N + 1}) c(k)),
  tf AS (SELECT eid, 0 AS li, list_sort([v0, v2, v1]) AS s FROM e UNION ALL SELECT eid, 1, list_sort([v0, v1, v3]) FROM e UNION ALL SELECT eid, 2, list_sort([v1, v2, v3]) FROM e UNION ALL SELECT eid, 3, list_sort([v2, v0, v3]) FROM e),
  tn AS (SELECT a.eid, a.li, b.eid AS nbr FROM tf a LEFT JOIN tf b ON a.s = b.s AND a.eid <> b.eid),
  tg AS (SELECT e.eid, {", ".join(f"w{i}.x AS c{i}x, w{i}.y AS c{i}y, w{i}.z AS c{i}z" for i in range(4))}, {", ".join(f"n{i}.nbr AS n{i}" for i in range(4))} FROM e {" ".join(f"JOIN tv w{i} ON w{i}.vid = v{i}" for i in range(4))} {" ".join(f"JOIN tn n{i} ON n{i}.eid = e.eid AND n{i}.li = {i}" for i in range(4))})"""
WALK3 = f"""WITH RECURSIVE {TET_GEO}, {P3}, hop(pid, elem_id, tx, ty, tz, hops, moves) AS (
    SELECT pid, elem_id, tx, ty, tz, 0, true FROM p3
    UNION ALL
    SELECT pid, CASE WHEN lo >= 0 THEN elem_id ELSE coalesce(CASE lo WHEN b0 THEN n0 WHEN b1 THEN n1 WHEN b2 THEN n2 ELSE n3 END, -1) END, tx, ty, tz, hops + CASE WHEN lo >= 0 THEN 0 ELSE 1 END, lo < 0
    FROM (SELECT *, least(b0, b1, b2, b3) AS lo FROM (SELECT h.*, g.n0, g.n1, g.n2, g.n3, {", ".join(f"{x} AS b{i}" for i, x in enumerate(NUM3))} FROM hop h JOIN tg g ON h.elem_id = g.eid WHERE h.moves))
  ), last AS (SELECT pid, arg_max(elem_id, hops * 2 + CASE WHEN moves THEN 0 ELSE 1 END) AS elem_id, CAST(max(hops) AS INTEGER) AS hops FROM hop GROUP BY pid)"""


@query("walk3d_final_element", f"{WALK3} SELECT pid, elem_id, hops FROM last")
def _(spark, d):
    return W.trace(_particles_3d(spark, d), M.walk_table(T.tets(spark, d)), 3, tol=0.0).select("pid", "elem_id", "hops")


_ahead = lambda a: f"CASE WHEN t{a} > o{a} THEN (900000.0 - o{a}) / (t{a} - o{a}) WHEN t{a} < o{a} THEN o{a} / (o{a} - t{a} + 0.0) ELSE 1e30 END"


@query("walk3d_ray_to_wall", f"WITH {P3}, r AS (SELECT *, least({', '.join(map(_ahead, 'xyz'))}) AS t FROM p3) SELECT pid, {', '.join(f'round(o{a} + (t{a} - o{a}) * t, 1) AS p{a}' for a in 'xyz')} FROM r")
def _(spark, d):
    out = W.trace(_particles_3d(spark, d), M.walk_table(T.tets(spark, d)), 3, crossing=True)
    return out.select("pid", *(F.round(f"p{a}", 1).alias(f"p{a}") for a in "xyz"))


INSIDE3 = " AND ".join(f"t{a} BETWEEN 0 AND 899999" for a in "xyz")


@query("walk3d_segment", f"WITH {P3} SELECT pid, CASE WHEN {INSIDE3} THEN {_tet_of('t')} ELSE -1 END AS elem_id FROM p3")
def _(spark, d):
    return W.search_3d(_particles_3d(spark, d), M.walk_table(T.tets(spark, d)), tol=1e-9).select("pid", "elem_id")


@query("walk3d_first_face", f"WITH {P3}, r AS (SELECT *, least({', '.join(map(_ahead, 'xyz'))}) AS t FROM p3) SELECT pid, CASE WHEN {INSIDE3} THEN {_tet_of('t')} ELSE -1 END AS elem_id, {', '.join(f'CASE WHEN NOT ({INSIDE3}) THEN round(o{a} + (t{a} - o{a}) * t, 1) END AS p{a}' for a in 'xyz')} FROM r")
def _(spark, d):
    out = W.search_first_face_3d(_particles_3d(spark, d), M.walk_table(T.tets(spark, d)))
    return out.select("pid", "elem_id", *(F.when(F.col("elem_id") == -1, F.round(f"p{a}", 1)).alias(f"p{a}") for a in "xyz"))


@query("locate_particles", f"WITH {GEO}, {P}, c AS (SELECT pid, ox AS px, oy AS py, g.* FROM p JOIN g ON ox BETWEEN least(x0, x1, x2) AND greatest(x0, x1, x2) AND oy BETWEEN least(y0, y1, y2) AND greatest(y0, y1, y2)) SELECT pid, min(eid) AS eid FROM c WHERE least({', '.join(NUM)}) >= 0 GROUP BY pid")
def _(spark, d):
    """Every particle lies in an element; of several that hold it (on a side) the least."""
    return M.locate(T.particles(spark, d).select("pid", F.col("ox").alias("x"), F.col("oy").alias("y")), T.mesh(spark, d), float(T.size(spark, d).h)).select("pid", "eid")


GRADED_TOP = 10**8
GN = T.Term("(SELECT least(n, 100) FROM dims)")
_graded = lambda c: f"({c} * {c} * {c} * {c} * {GRADED_TOP} // {GN ** 4})"
#: The plate with its lines at fourth powers, so that sizes spread over three decades, and each event at a place of it.
GRADED = f"""gv AS (SELECT i * {GN + 1} + j AS vid, {_graded('i')} AS x, {_graded('j')} AS y FROM range({GN + 1}) a(i), range({GN + 1}) b(j)),
  ge AS (SELECT 2 * (i * {GN} + j) + k AS eid, i * {GN + 1} + j AS v0, (i + 1) * {GN + 1} + j + k AS v1, (i + 1 - k) * {GN + 1} + j + 1 AS v2 FROM range({GN}) a(i), range({GN}) b(j), range(2) c(k)),
  g AS (SELECT eid, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2 FROM ge JOIN gv a ON a.vid = v0 JOIN gv b ON b.vid = v1 JOIN gv c ON c.vid = v2)"""


def _graded_mesh(spark, d) -> M.Mesh:
    n = min(T.size(spark, d).n, 100)
    m = M.tri_lattice(spark, n, n)
    return M.Mesh(2, m.vertex.withColumns({a: F.expr(f"{a} * {a} * {a} * {a} * {GRADED_TOP} div {n**4}") for a in "xy"}), m.elem)


@query("locate_on_graded_mesh", f"""WITH {GRADED}, {P}, q AS (SELECT pid, ox * 100 + pid % 100 AS px, oy * 100 + pid % 89 AS py FROM p),
  c AS (SELECT q.*, g.* FROM q JOIN g ON px BETWEEN least(x0, x1, x2) AND greatest(x0, x1, x2) AND py BETWEEN least(y0, y1, y2) AND greatest(y0, y1, y2)) SELECT pid, min(eid) AS eid FROM c WHERE least({', '.join(NUM)}) >= 0 GROUP BY pid""")
def _(spark, d):
    """A mesh whose elements differ a thousandfold in width; each is filed at the grid level of its own size."""
    p = T.particles(spark, d).select("pid", (F.col("ox") * 100 + F.col("pid") % 100).alias("x"), (F.col("oy") * 100 + F.col("pid") % 89).alias("y"))
    return grid.locate_levels(p, _graded_mesh(spark, d), tol=0.0).select("pid", "eid")


@query("near_on_graded_mesh", f"""WITH {GRADED}, {P}, load AS (SELECT elem_id, count(*) AS n FROM p GROUP BY elem_id), q AS (SELECT eid, unnest([x0, x1, x2]) AS x, unnest([y0, y1, y2]) AS y FROM g)
  SELECT DISTINCT a.eid AS a, b.eid AS b FROM q a JOIN load ON elem_id = a.eid AND load.n % 3 = 0 JOIN q b ON abs(a.x - b.x) <= 40000 AND abs(a.y - b.y) <= 40000 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600000000""")
def _(spark, d):
    """Elements near those whose number of events is a multiple of three."""
    points = grid.element_points(_graded_mesh(spark, d))
    wanted = PT.per_element(T.particles(spark, d)).where("n % 3 = 0").select(F.col("elem_id").alias("id"))
    return grid.near_entities(points.join(wanted, "id", "left_semi"), points, 40_000.0, ("x", "y"))


_ends = lambda q: [x.replace("px", f"{q}x").replace("py", f"{q}y") for x in NUM]
_b = list(enumerate(zip(_ends("o"), _ends("t"), strict=True)))
CLIPPED = f"""{GEO}, {P}, w AS (SELECT pid, val, eid, {', '.join(f'CAST({o} AS DOUBLE) AS o{i}, CAST({t} AS DOUBLE) AS t{i}' for i, (o, t) in _b)} FROM p JOIN g ON greatest(x0, x1, x2) >= least(ox, tx) AND least(x0, x1, x2) <= greatest(ox, tx) AND greatest(y0, y1, y2) >= least(oy, ty) AND least(y0, y1, y2) <= greatest(oy, ty)),
  cl AS (SELECT pid, val, eid, greatest(0.0, {', '.join(f'CASE WHEN t{i} > o{i} THEN o{i} / (o{i} - t{i}) ELSE 0.0 END' for i in range(3))}) AS lo, least(1.0, {', '.join(f'CASE WHEN t{i} < o{i} THEN o{i} / (o{i} - t{i}) ELSE 1.0 END' for i in range(3))}) AS hi FROM w
    WHERE {' AND '.join(f'(t{i} <> o{i} OR o{i} >= 0)' for i in range(3))})"""


@query("path_deposits", f"WITH {CLIPPED} SELECT eid AS elem_id, round(sum(val * (hi - lo)), 3) AS val FROM cl WHERE hi - lo > 1e-12 GROUP BY eid")
def _(spark, d):
    """Each event's value spread over the elements that its way crosses, by the length within each."""
    p = T.particles(spark, d)
    return deposits_in_tiles(p, cut(M.walk_table(T.mesh(spark, d))), "val", least=1e-12).select("elem_id", F.round("val", 3).alias("val"))


@query("reflect_and_remove_at_wall", f"WITH {BOX2} SELECT pid, t <= 1 AS removed, round(CASE WHEN t <= 1 THEN ox + (tx - ox) * t ELSE tx END, 2) AS tx, CAST(CASE WHEN t <= 1 THEN ox - tx ELSE tx - ox END AS DOUBLE) AS dx FROM b")
def _(spark, d):
    p = T.particles(spark, d).withColumns({"dx": F.col("tx") - F.col("ox"), "dy": F.col("ty") - F.col("oy")})
    hit = W.trace(p, M.walk_table(T.mesh(spark, d)), 2, crossing=True, tol=0.0).select("pid", F.col("elem_id").alias("at"), "face", "px", "py")
    met = p.join(hit, "pid").withColumn("elem_id", F.col("at"))
    back = PT.reflect_at_wall(met.withColumns({c: F.col(c).cast("double") for c in ("tx", "ty", "dx", "dy")}), 2)
    return PT.remove_at_wall(back).select("pid", (F.col("elem_id") == -1).alias("removed"), F.round("tx", 2).alias("tx"), "dx")


# counts, rebuild, migration


@query("particles_per_element", f"WITH {P} SELECT elem_id, count(*) AS n FROM p GROUP BY elem_id")
def _(spark, d):
    return PT.per_element(T.particles(spark, d))


@query("particle_lists", f"WITH {E}, {P}, c AS (SELECT eid AS elem_id, count(pid) AS n FROM e LEFT JOIN p ON eid = p.elem_id GROUP BY eid) SELECT elem_id, n, CAST(coalesce(sum(n) OVER (ORDER BY elem_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c")
def _(spark, d):
    return PT.particle_lists(T.particles(spark, d), T.mesh(spark, d).elem).select("elem_id", "n", "offset")


@query("particle_slots", f"WITH {P} SELECT pid, elem_id, row_number() OVER (PARTITION BY elem_id ORDER BY pid) - 1 AS slot FROM p")
def _(spark, d):
    return PT.slots(T.particles(spark, d)).select("pid", "elem_id", "slot")


@query("has_particles", f"WITH {E}, {P} SELECT eid, CASE WHEN eid IN (SELECT elem_id FROM p WHERE species = 'click') THEN 5 ELSE -1 END AS has_particles FROM e")
def _(spark, d):
    return SC.has_particles(T.mesh(spark, d).elem, T.particles(spark, d).where("species = 'click'"), 5).select("eid", "has_particles")


@query("class_deposits", f"WITH {E}, {P} SELECT class_id, count(*) AS n, CAST(sum(val) AS BIGINT) AS sum_val FROM p JOIN e ON eid = elem_id GROUP BY class_id")
def _(spark, d):
    p = T.particles(spark, d).join(T.mesh(spark, d).elem.select(F.col("eid").alias("elem_id"), "class_id"), "elem_id")
    return p.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("sum_val"))


@query("sigma_sort", f"""WITH {P}, c AS (SELECT elem_id, count(*) AS n FROM p GROUP BY elem_id) SELECT elem_id, n, elem_id // 32 AS chunk, elem_id // 32 * 32 + row_number() OVER (PARTITION BY elem_id // 32 ORDER BY n DESC, elem_id) - 1 AS "row" FROM c""")
def _(spark, d):
    return PT.sigma_sort(PT.per_element(T.particles(spark, d)), 32)


@query("layout_metrics", f"""WITH {E}, {P}, c AS (SELECT eid, count(pid) AS n FROM e LEFT JOIN p ON eid = p.elem_id GROUP BY eid), s AS (SELECT *, (row_number() OVER (ORDER BY n DESC, eid) - 1) // 32 AS s FROM c),
  w AS (SELECT s, max(n) AS width, sum(n) AS n, count(*) AS r, count(*) FILTER (WHERE n = 0) AS z FROM s GROUP BY s)
  SELECT CAST(sum(r) AS BIGINT) AS elements, CAST(sum(z) AS BIGINT) AS empty_elements, CAST(sum(n) AS BIGINT) AS particles, CAST(sum(width * r) AS BIGINT) AS cells, CAST(sum(width * r) - sum(n) AS BIGINT) AS padded_cells FROM w""")
def _(spark, d):
    return PT.layout_metrics(T.particles(spark, d), T.mesh(spark, d).elem)


@query("rebuild_move", f"WITH {P} SELECT (elem_id * 3 + pid) % {2 * N * N} AS elem_id, count(*) AS n, CAST(sum(pid) AS BIGINT) AS sum_pid FROM p GROUP BY 1")
def _(spark, d):
    moved = PT.rebuild(T.particles(spark, d).withColumn("new_elem", (F.col("elem_id") * 3 + F.col("pid")) % T.size(spark, d).elements))
    return moved.groupBy("elem_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("sum_pid"))


@query("rebuild_delete", f"WITH {P} SELECT pid, elem_id FROM p WHERE pid % 7 <> 0")
def _(spark, d):
    return PT.rebuild(T.particles(spark, d).withColumn("new_elem", F.when(F.col("pid") % 7 == 0, -1).otherwise(F.col("elem_id")))).select("pid", "elem_id")


@query("rebuild_insert", f"WITH {P} SELECT pid, elem_id FROM p UNION ALL SELECT 1000000000 + o_orderkey, o_orderkey % {2 * N * N} FROM orders")
def _(spark, d):
    added = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") + 1_000_000_000).alias("pid"), (F.col("o_orderkey") % T.size(spark, d).elements).alias("elem_id"))
    return PT.rebuild(T.particles(spark, d).select("pid", "elem_id", F.col("elem_id").alias("new_elem")), added=added)


@query("rebuild_mixed", f"WITH {P} SELECT pid, (elem_id + 1) % {2 * N * N} AS elem_id FROM p WHERE pid % 5 <> 0 UNION ALL SELECT 1000000000 + o_orderkey, o_orderkey % {2 * N * N} FROM orders")
def _(spark, d):
    added = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") + 1_000_000_000).alias("pid"), (F.col("o_orderkey") % T.size(spark, d).elements).alias("elem_id"))
    p = T.particles(spark, d).select("pid", "elem_id", F.when(F.col("pid") % 5 == 0, -1).otherwise((F.col("elem_id") + 1) % T.size(spark, d).elements).alias("new_elem"))
    return PT.rebuild(p, added=added)


HALO1 = f"{E}, {EV}, {O}, {P}, {R}, {T.halo_sql(1)}"


def _parts(spark, d, ghost=2, safe=1):
    m = T.mesh(spark, d)
    return PA.layered_mesh(m, T.owners(spark, d), RANKS, ghost, safe)


@query("unsafe_ranks", f"""WITH {HALO1} SELECT pid, rank, CASE WHEN new_elem < 0 OR EXISTS (SELECT 1 FROM l1 WHERE l1.rank = r.rank AND l1.eid = r.new_elem) THEN rank ELSE (SELECT owner FROM cols WHERE cols.i = new_elem // 2 // {N}) END AS new_rank FROM r""")
def _(spark, d):
    parts = _parts(spark, d)
    return PT.unsafe_ranks(T.ranked(spark, d), parts.halo, parts.owners).select("pid", "rank", "new_rank")


@query("migrate_counts", f"""WITH {HALO1}, m AS (SELECT new_elem, CASE WHEN EXISTS (SELECT 1 FROM l1 WHERE l1.rank = r.rank AND l1.eid = r.new_elem) THEN rank ELSE (SELECT owner FROM cols WHERE cols.i = new_elem // 2 // {N}) END AS nr FROM r WHERE new_elem >= 0)
  SELECT nr AS rank, new_elem AS elem_id, count(*) AS n FROM m GROUP BY 1, 2""")
def _(spark, d):
    parts = _parts(spark, d)
    return PT.migrate_particles(T.ranked(spark, d), parts.halo, parts.owners, RANKS, place=True).groupBy("rank", "elem_id").agg(F.count(F.lit(1)).alias("n"))


@query("imbalance", f"WITH {E}, {P}, {R}, c AS (SELECT rank, count(*) AS n FROM r GROUP BY rank) SELECT max(n) AS max_n, min(n) AS min_n, sum(n) / count(*) AS avg_n, CAST(sum(n) // count(*) AS BIGINT) AS avg_int, max(n) * count(*) / sum(n) AS imbalance FROM c")
def _(spark, d):
    return PT.imbalance(T.ranked(spark, d))


# partitions


@query("owners_by_class", f"WITH {E} SELECT eid, CAST(class_id % 2 AS INTEGER) AS owner FROM e")
def _(spark, d):
    return PA.owners_by_class(T.mesh(spark, d).elem, spark.range(5).select(F.col("id").cast("int").alias("class_id"), (F.col("id") % 2).cast("int").alias("owner")))


@query("owners_lower_dim", f"WITH {E}, {EV}, {O} SELECT vid, min(owner) AS owner FROM ev JOIN o USING (eid) GROUP BY vid")
def _(spark, d):
    return PA.lower_owners(M.elem_vert(T.mesh(spark, d)), T.owners(spark, d), "vid")


@query("rank_offsets", f"WITH {E}, {O}, c AS (SELECT owner AS rank, count(*) AS n FROM o GROUP BY owner UNION ALL SELECT 4, 0) SELECT rank, n, CAST(coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c")
def _(spark, d):
    return PA.rank_offsets(spark, T.owners(spark, d), RANKS + 1)


@query("global_numbers", f"WITH {E}, {EV}, {O}, w AS (SELECT vid, min(owner) AS owner FROM ev JOIN o USING (eid) GROUP BY vid) SELECT vid, owner, row_number() OVER (ORDER BY owner, vid) - 1 AS gid, row_number() OVER (PARTITION BY owner ORDER BY vid) - 1 AS rank_lid FROM w")
def _(spark, d):
    return PA.global_numbers(spark, PA.lower_owners(M.elem_vert(T.mesh(spark, d)), T.owners(spark, d), "vid"), "vid", RANKS)


HALO2 = f"{E}, {EV}, {O}, {T.halo_sql(2)}"


@query("halo_layers", f"WITH {HALO2} SELECT rank, eid, CASE WHEN EXISTS (SELECT 1 FROM l0 WHERE l0.rank = l2.rank AND l0.eid = l2.eid) THEN 0 WHEN EXISTS (SELECT 1 FROM l1 WHERE l1.rank = l2.rank AND l1.eid = l2.eid) THEN 1 ELSE 2 END AS layer FROM l2")
def _(spark, d):
    return PA.bfs_layers(T.owners(spark, d), PA.bridge(T.mesh(spark, d)), 2)


@query("halo_parts", f"WITH {HALO2}, b AS (SELECT DISTINCT l2.rank, owner FROM l2 JOIN o USING (eid)) SELECT b.rank, b.owner, count(*) AS n, count(*) AS total, 2 AS complete FROM b JOIN o ON o.owner = b.owner GROUP BY b.rank, b.owner")
def _(spark, d):
    parts = _parts(spark, d)
    return PA.buffered_parts(parts.halo, parts.owners)


@query("halo_build", f"""WITH {HALO2}, b AS (SELECT DISTINCT l2.rank, owner FROM l2 JOIN o USING (eid))
  SELECT b.rank, o.eid, o.owner = b.rank AS is_core, EXISTS (SELECT 1 FROM l1 WHERE l1.rank = b.rank AND l1.eid = o.eid) AS is_safe FROM b JOIN o ON o.owner = b.owner""")
def _(spark, d):
    return _parts(spark, d).halo


@query("safe_inward", f"""WITH {HALO2}, b AS (SELECT DISTINCT l2.rank, owner FROM l2 JOIN o USING (eid)), held AS (SELECT b.rank, o.eid FROM b JOIN o ON o.owner = b.owner),
  un AS (SELECT x.rank, o.eid FROM (SELECT DISTINCT owner AS rank FROM o) x, o WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.rank = x.rank AND h.eid = o.eid)),
  reach AS (SELECT DISTINCT un.rank, y.eid FROM un JOIN ev x ON x.eid = un.eid JOIN ev y ON y.vid = x.vid)
  SELECT rank, eid FROM held WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.rank = held.rank AND r.eid = held.eid) UNION SELECT owner, eid FROM o""")
def _(spark, d):
    o, links = T.owners(spark, d), PA.bridge(T.mesh(spark, d))
    parts = PA.parts_in_reach(PA.bfs_layers(o, links, 2), o, 2)
    return PA.safe_inward(parts, o, links, 1)


BIT_RANKS = 96
BITS = f"{E}, {EV}, {P}, {T.weighted_sql(BIT_RANKS)}, {T.halo_sql(2)}, b AS (SELECT DISTINCT l2.rank, owner FROM l2 JOIN o USING (eid)), hs AS (SELECT b.rank, o.eid FROM b JOIN o ON o.owner = b.owner)"


def _bits(spark, d, safe: str):
    return RB.build_bits(PA.Input(T.mesh(spark, d), T.weighted_owners(spark, d, BIT_RANKS), BIT_RANKS, buffer_method=PA.Method.BFS, safe_method=PA.Method.parse(safe), buffer_layers=2, safe_layers=1))


@query("rank_bitmaps", f"""WITH {BITS}, h AS (SELECT eid, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS held FROM hs GROUP BY eid), s AS (SELECT eid, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS safe FROM l1 GROUP BY eid)
  SELECT o.eid, owner, held, coalesce(safe, '') AS safe FROM o JOIN h ON h.eid = o.eid LEFT JOIN s ON s.eid = o.eid""")
def _(spark, d):
    """The ranks, of 96 that own about equally many events, that hold each element and on which it is safe."""
    return _bits(spark, d, "BFS").select("eid", "owner", *(F.array_join(F.transform(RB.ranks_of(p, BIT_RANKS), lambda r: r.cast("string")), ",").alias(n) for p, n in (("h", "held"), ("s", "safe"))))


@query("rank_bitmaps_inward", f"""WITH {BITS}, un AS (SELECT x.rank, o.eid FROM (SELECT DISTINCT owner AS rank FROM o) x, o WHERE NOT EXISTS (SELECT 1 FROM hs h WHERE h.rank = x.rank AND h.eid = o.eid)),
  reach AS (SELECT DISTINCT un.rank, y.eid FROM un JOIN ev x ON x.eid = un.eid JOIN ev y ON y.vid = x.vid)
  SELECT h.rank, h.eid, o.owner = h.rank AS is_core, o.owner = h.rank OR NOT EXISTS (SELECT 1 FROM reach r WHERE r.rank = h.rank AND r.eid = h.eid) AS is_safe FROM hs h JOIN o ON o.eid = h.eid""")
def _(spark, d):
    """Safe is what lies more than a layer away from all that a rank lacks."""
    return RB.halo_of(_bits(spark, d, "FULL"), BIT_RANKS)


@query("rank_bitmap_sets", f"""WITH {BITS}, s AS (SELECT eid, list_sort(list(rank)) AS ranks FROM l1 GROUP BY eid) SELECT array_to_string(ranks, ',') AS ranks, count(*) AS n, min(eid) AS first FROM s GROUP BY ranks""")
def _(spark, d):
    """Safe sets as distinct bitmaps."""
    sets = RB.safe_sets_of(_bits(spark, d, "BFS"), BIT_RANKS)
    return sets.groupBy("sbar").agg(F.first(joined("ranks")).alias("ranks"), F.count(F.lit(1)).alias("n"), F.min("eid").alias("first")).select("ranks", "n", "first")


@query("full_mesh_halo", f"WITH {E}, {O} SELECT CAST(k AS INTEGER) AS rank, eid, owner = k AS is_core, true AS is_safe FROM o, range({RANKS}) x(k)")
def _(spark, d):
    return PA.full_mesh(T.mesh(spark, d), T.owners(spark, d), RANKS).halo


@query("pic_part", f"""WITH {HALO2}, b AS (SELECT DISTINCT l2.rank, owner FROM l2 JOIN o USING (eid)), k AS (SELECT b.rank, e.* FROM e JOIN o USING (eid) JOIN b USING (owner)),
  u AS (SELECT rank, vid, row_number() OVER (PARTITION BY rank ORDER BY vid) - 1 AS new FROM (SELECT rank, v0 AS vid FROM k UNION SELECT rank, v1 FROM k UNION SELECT rank, v2 FROM k))
  SELECT k.rank, row_number() OVER (PARTITION BY k.rank ORDER BY eid) - 1 AS eid, eid AS eid_global, a.new AS v0, b2.new AS v1, c.new AS v2 FROM k JOIN u a ON a.vid = v0 AND a.rank = k.rank JOIN u b2 ON b2.vid = v1 AND b2.rank = k.rank JOIN u c ON c.vid = v2 AND c.rank = k.rank""")
def _(spark, d):
    parts, out = _parts(spark, d), []
    for rank in range(RANKS):
        out.append(parts.local(rank).elem.select(F.lit(rank).alias("rank"), "eid", "eid_global", "v0", "v1", "v2"))
    return reduce(DataFrame.unionByName, out)


PARTS = f"""{HALO2}, {V}, {HALF}, {SIDE}, {P}, ld AS (SELECT elem_id AS eid, count(*) AS load FROM p GROUP BY elem_id), b AS (SELECT DISTINCT l2.rank, owner FROM l2 JOIN o USING (eid)), k AS (SELECT b.rank, e.*, load, o.owner = b.rank AS is_core FROM e JOIN o USING (eid) JOIN b USING (owner) LEFT JOIN ld USING (eid)),
  u AS (SELECT rank, vid, row_number() OVER (PARTITION BY rank ORDER BY vid) - 1 AS new FROM (SELECT rank, v0 AS vid FROM k UNION SELECT rank, v1 FROM k UNION SELECT rank, v2 FROM k))"""


def _pic_parts(spark, d):
    m = T.mesh(spark, d).with_tag(2, "load", PT.per_element(T.particles(spark, d)).withColumnRenamed("n", "load"), "elem_id")
    return pic_parts(m, _parts(spark, d).halo)


@query("pic_parts_elements", f"""WITH {PARTS} SELECT k.rank, row_number() OVER (PARTITION BY k.rank ORDER BY eid) - 1 AS eid, eid AS eid_global, a.new AS v0, b2.new AS v1, c.new AS v2, class_id, load, is_core
  FROM k JOIN u a ON a.vid = v0 AND a.rank = k.rank JOIN u b2 ON b2.vid = v1 AND b2.rank = k.rank JOIN u c ON c.vid = v2 AND c.rank = k.rank""")
def _(spark, d):
    """All ranks' elements in one pass, with classes and loads from the events."""
    return _pic_parts(spark, d).elem.select("rank", "eid", "eid_global", "v0", "v1", "v2", "class_id", "load", "is_core")


@query("pic_parts_vertices", f"WITH {PARTS} SELECT rank, u.new AS vid, u.vid AS vid_global, x, y, class_dim FROM u JOIN v ON v.vid = u.vid")
def _(spark, d):
    return _pic_parts(spark, d).vertex.select("rank", "vid", "vid_global", "x", "y", "class_dim")


@query("pic_parts_sides", f"""WITH {PARTS}, w AS (SELECT h.k0, h.k1, min(class_id) AS class_id, CASE WHEN count(*) = 2 AND min(class_id) = max(class_id) THEN 2 ELSE 1 END AS class_dim FROM half h JOIN e USING (eid) GROUP BY 1, 2),
  m AS (SELECT k.rank, s.sid, s.k0, s.k1, count(*) = 1 AS exposed FROM k JOIN half h USING (eid) JOIN side s ON s.k0 = h.k0 AND s.k1 = h.k1 GROUP BY 1, 2, 3, 4)
  SELECT m.rank, row_number() OVER (PARTITION BY m.rank ORDER BY sid) - 1 AS sid, sid AS sid_global, a.new AS v0, b2.new AS v1, exposed, class_id, CAST(class_dim AS TINYINT) AS class_dim
  FROM m JOIN w ON w.k0 = m.k0 AND w.k1 = m.k1 JOIN u a ON a.vid = m.k0 AND a.rank = m.rank JOIN u b2 ON b2.vid = m.k1 AND b2.rank = m.rank""")
def _(spark, d):
    """All ranks' sides with their classification."""
    return _pic_parts(spark, d).side.select("rank", "sid", "sid_global", "v0", "v1", "exposed", "class_id", "class_dim")


#: held: a rank's vertices, each with the values of the rank's own particles in the elements around it.
HELD = f"{HALO2}, {P}, {R}, b AS (SELECT DISTINCT l2.rank, owner FROM l2 JOIN o USING (eid)), hv AS (SELECT DISTINCT b.rank, vid FROM b JOIN o ON o.owner = b.owner JOIN ev ON ev.eid = o.eid), rv AS (SELECT rank, vid, CAST(sum(val) AS BIGINT) AS w FROM r JOIN ev ON ev.eid = elem_id GROUP BY rank, vid), held AS (SELECT hv.rank, hv.vid, coalesce(w, 0) AS w FROM hv LEFT JOIN rv ON rv.rank = hv.rank AND rv.vid = hv.vid), vo AS (SELECT vid, min(owner) AS owner FROM ev JOIN o USING (eid) GROUP BY vid)"


def _held(spark, d):
    """rank, vid, w: the vertices that a rank holds, with the values of its own particles around them; and the vertices' owners."""
    m, parts = T.mesh(spark, d), _parts(spark, d)
    down = M.elem_vert(m)
    held = PA.held_entities(parts.halo, down, "vid")
    own = T.ranked(spark, d).groupBy("rank", F.col("elem_id").alias("eid")).agg(F.sum("val").alias("w")).join(down, "eid").groupBy("rank", "vid").agg(F.sum("w").alias("w"))
    return held.join(own, ["rank", "vid"], "left").select("rank", "vid", F.coalesce("w", F.lit(0)).alias("w")), PA.lower_owners(down, parts.owners, "vid")


for _op in ("SUM", "MAX", "MIN"):
    SQL[f"reduce_{_op.lower()}"] = f"WITH {HELD} SELECT rank, vid, CAST({_op}(w) OVER (PARTITION BY vid) AS BIGINT) AS w FROM held"
    QUERIES[f"reduce_{_op.lower()}"] = lambda spark, d, op=_op: PA.reduce_comm_array(_held(spark, d)[0], "vid", op, ["w"])


@query("reduce_bcast", f"WITH {HELD} SELECT h.rank, h.vid, x.w FROM held h JOIN vo ON vo.vid = h.vid JOIN held x ON x.vid = h.vid AND x.rank = vo.owner")
def _(spark, d):
    held, vo = _held(spark, d)
    return PA.reduce_comm_array(held, "vid", "BCAST", ["w"], vo)


@query("comm_index", f"WITH {HELD}, g AS (SELECT vid, owner, row_number() OVER (PARTITION BY owner ORDER BY vid) - 1 AS lid FROM vo) SELECT h.rank, h.vid, owner, row_number() OVER (PARTITION BY h.rank ORDER BY owner, lid) - 1 AS index FROM held h JOIN g ON g.vid = h.vid")
def _(spark, d):
    held, vo = _held(spark, d)
    return PA.comm_index(held.select("rank", "vid"), PA.global_numbers(spark, vo, "vid", RANKS), "vid")


@query("shared_unit_sums", f"WITH {HELD}, c AS (SELECT vid, count(*) AS n FROM held GROUP BY vid) SELECT h.rank, h.vid, round(sum(1.0 / n) OVER (PARTITION BY h.vid), 9) AS w FROM held h JOIN c ON c.vid = h.vid")
def _(spark, d):
    held, _vo = _held(spark, d)
    n = PA.reduce_comm_array(PA.comm_array(held, "vid", {"w": 1}), "vid", "SUM", ["w"])
    return PA.reduce_comm_array(n.withColumn("w", 1.0 / F.col("w")), "vid", "SUM", ["w"]).withColumn("w", F.round("w", 9))


# scatter and interpolation


@query("vertex_density", f"WITH {E}, {EV}, {P}, c AS (SELECT elem_id, count(*) AS n FROM p GROUP BY elem_id) SELECT vid, round(sum(coalesce(n, 0)) / count(*), 6) AS density FROM ev LEFT JOIN c ON elem_id = eid GROUP BY vid")
def _(spark, d):
    return SC.vertex_density(T.particles(spark, d), T.mesh(spark, d)).withColumn("density", F.round("density", 6))


GYRO = Gyro(rmax=60000.0, rings=3, points=8, theta=7.0)


@query("gyro_ring_points", f"WITH {V} SELECT vid, CAST(ring AS INTEGER) AS ring, CAST(pt AS INTEGER) AS pt, round(x + 20000.0 * (ring + 1) * cos(radians(7 + pt / 8.0 * 360)), 3) AS x, round(y + 20000.0 * (ring + 1) * sin(radians(7 + pt / 8.0 * 360)), 3) AS y FROM v, range(3) a(ring), range(8) b(pt)")
def _(spark, d):
    return SC.ring_points(T.mesh(spark, d), GYRO).select("vid", "ring", "pt", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


RINGS = f"""{V}, {E}, {EV}, {P}, rp AS (SELECT vid, ring, pt, x + 20000.0 * (ring + 1) * cos(radians(7 + pt / 8.0 * 360)) AS x, y + 20000.0 * (ring + 1) * sin(radians(7 + pt / 8.0 * 360)) AS y FROM v, range(3) a(ring), range(8) b(pt)),
  le AS (SELECT vid, ring, pt, CAST(2 * (floor(x / {T.H}) * {N} + floor(y / {T.H})) + CASE WHEN y - floor(y / {T.H}) * {T.H} > x - floor(x / {T.H}) * {T.H} THEN 1 ELSE 0 END AS BIGINT) AS eid FROM rp WHERE x > 0 AND y > 0 AND x < {LENGTH} AND y < {LENGTH}),
  mp AS (SELECT le.vid, ring, pt, ev.vid AS "to" FROM le JOIN ev ON ev.eid = le.eid)"""


@query("gyro_ring_map", f'WITH {RINGS} SELECT vid, CAST(ring AS INTEGER) AS ring, CAST(pt AS INTEGER) AS pt, "to" FROM mp')
def _(spark, d):
    m = T.mesh(spark, d)
    return SC.ring_map(m, SC.ring_points(m, GYRO))


@query("gyro_scatter", f"""WITH {RINGS}, c AS (SELECT elem_id, count(*) AS n FROM p GROUP BY elem_id), w AS (SELECT vid, ring, sum(n) AS w FROM ev JOIN c ON elem_id = eid, (VALUES (0), (1)) r(ring) GROUP BY vid, ring),
  s AS (SELECT "to" AS vid, sum(w.w) / 8 AS w FROM mp JOIN w ON w.vid = mp.vid AND w.ring = mp.ring GROUP BY 1) SELECT v.vid, round(coalesce(s.w, 0), 6) AS w FROM v LEFT JOIN s ON s.vid = v.vid""")
def _(spark, d):
    m = T.mesh(spark, d)
    mapping = SC.ring_map(m, SC.ring_points(m, GYRO))
    return SC.gyro_scatter(T.particles(spark, d), m, mapping, GYRO).withColumn("w", F.round("w", 6))


@query("gyro_sync", f"WITH {HELD} SELECT vid, CAST(sum(w) AS BIGINT) AS fwd, CAST(sum(2 * w) AS BIGINT) AS bkwd FROM held GROUP BY vid")
def _(spark, d):
    held, _vo = _held(spark, d)
    return SC.gyro_sync(held, held.withColumn("w", F.col("w") * 2))


FIELD = [float((i * 37 + j * 11) % 23) for j in range(5) for i in range(6)]
FIELD_SQL = "f AS (SELECT i, j, CAST((i * 37 + j * 11) % 23 AS DOUBLE) AS f FROM range(6) a(i), range(5) b(j))"


@query("interpolate_bilinear", f"""WITH {P}, {FIELD_SQL}, q AS (SELECT pid, CAST(tx AS DOUBLE) AS x, CAST(ty AS DOUBLE) AS z, greatest(CAST(floor((tx - 0.0) / 200000) AS BIGINT), 0) AS i, greatest(CAST(floor((ty - 0.0) / 250000) AS BIGINT), 0) AS j FROM p),
  c AS (SELECT q.*, least(i, 5) AS i0, least(j, 4) AS j0 FROM q),
  g AS (SELECT c.*, a.f AS f00, b.f AS f10, k.f AS f01, l.f AS f11 FROM c JOIN f a ON a.i = i0 AND a.j = j0 LEFT JOIN f b ON b.i = i0 + 1 AND b.j = j0 LEFT JOIN f k ON k.i = i0 AND k.j = j0 + 1 LEFT JOIN f l ON l.i = i0 + 1 AND l.j = j0 + 1)
  SELECT pid, round(CASE WHEN i0 >= 5 AND j0 >= 4 THEN f00 WHEN i0 >= 5 THEN (f00 * (250000.0 * (j0 + 1) - z) + f01 * (z - 250000.0 * j0)) / 250000 WHEN j0 >= 4 THEN (f00 * (200000.0 * (i0 + 1) - x) + f10 * (x - 200000.0 * i0)) / 200000
    ELSE ((f00 * (200000.0 * (i0 + 1) - x) + f10 * (x - 200000.0 * i0)) / 200000 * (250000.0 * (j0 + 1) - z) + (f01 * (200000.0 * (i0 + 1) - x) + f11 * (x - 200000.0 * i0)) / 200000 * (z - 250000.0 * j0)) / 250000 END, 11) AS f FROM g""")
def _(spark, d):
    pos = [F.col("tx").cast("double"), F.lit(0.0), F.col("ty").cast("double")]
    data = F.array(*map(F.lit, FIELD))
    return T.particles(spark, d).select("pid", F.round(interp.bilinear(data, 0.0, 0.0, 200000.0, 250000.0, 6, 5, pos, cylindrical=False), 11).alias("f"))


@query("interpolate_trilinear", f"""WITH {P}, q AS (SELECT pid, ox / 250000.0 AS x, oy / 250000.0 AS y, val / 10000.0 AS z FROM p),
  c AS (SELECT *, least(greatest(CAST(floor(x) AS BIGINT), 0), 3) AS i, least(greatest(CAST(floor(y) AS BIGINT), 0), 3) AS j, least(greatest(CAST(floor(z) AS BIGINT), 0), 3) AS k FROM q),
  s AS (SELECT pid, sum(CAST(((i + a) * 7 + (j + b) * 5 + (k + e) * 3) % 17 AS DOUBLE) * CASE WHEN a = 1 THEN x - i ELSE i + 1 - x END * CASE WHEN b = 1 THEN y - j ELSE j + 1 - y END * CASE WHEN e = 1 THEN z - k ELSE k + 1 - z END) AS f
    FROM c, range(2) r(a), range(2) t(b), range(2) u(e) GROUP BY pid) SELECT pid, round(f, 5) AS f FROM s""")
def _(spark, d):
    data = F.array(*(F.lit(float((i * 7 + j * 5 + k * 3) % 17)) for k in range(5) for j in range(5) for i in range(5)))
    grid = [0.0, 1.0, 2.0, 3.0, 4.0]
    pos = [F.col("ox") / 250000.0, F.col("oy") / 250000.0, F.col("val") / 10000.0]
    return T.particles(spark, d).select("pid", F.round(interp.trilinear(data, grid, grid, grid, pos), 5).alias("f"))


@query("interpolate_in_element", f"""WITH {GEO}, {P}, q AS (SELECT p.pid, ox AS px, oy AS py, g.*, v0, v1, v2 FROM p JOIN g ON g.eid = elem_id JOIN e ON e.eid = elem_id)
  SELECT pid, round((v0 * ({NUM[1]}) + v1 * ({NUM[2]}) + v2 * ({NUM[0]})) / 1e10, 5) AS f FROM q""")
def _(spark, d):
    m = T.mesh(spark, d)
    q = T.particles(spark, d).join(M.elem_geometry(m), F.col("elem_id") == F.col("eid"))
    b = M.barycentric(m, [F.col("ox"), F.col("oy")], by_vertex=True)
    return q.select("pid", F.round(interp.in_element([F.col(v) for v in m.verts], b), 5).alias("f"))


# balance

SETS = f"{HALO1}, s AS (SELECT eid, list_sort(list(rank)) AS ranks FROM l1 GROUP BY eid), si AS (SELECT ranks, CAST(row_number() OVER (ORDER BY ranks) - 1 AS INTEGER) AS sbar FROM (SELECT DISTINCT ranks FROM s)), st AS (SELECT eid, s.ranks, sbar FROM s JOIN si ON si.ranks = s.ranks)"


@query("safe_sets", f"WITH {SETS} SELECT eid, array_to_string(ranks, ',') AS ranks, sbar FROM st")
def _(spark, d):
    return balance.safe_sets(_parts(spark, d).halo).select("eid", joined("ranks").alias("ranks"), "sbar")


WEIGHTS = f"m AS (SELECT pid, rank, new_elem, CASE WHEN new_elem < 0 OR EXISTS (SELECT 1 FROM l1 WHERE l1.rank = r.rank AND l1.eid = r.new_elem) THEN rank ELSE (SELECT owner FROM cols WHERE cols.i = new_elem // 2 // {N}) END AS new_rank FROM r)"


@query("balance_weights", f"WITH {SETS}, {WEIGHTS} SELECT new_rank AS rank, sbar, count(*) AS n FROM m JOIN st ON eid = new_elem GROUP BY 1, 2")
def _(spark, d):
    parts = _parts(spark, d)
    return balance.weights(PT.unsafe_ranks(T.ranked(spark, d), parts.halo, parts.owners), balance.safe_sets(parts.halo))


@query("balance_select", f"""WITH {SETS}, {WEIGHTS}, c AS (SELECT m.*, sbar, array_to_string(ranks, ',') AS ranks, o.owner, new_rank = m.rank AND sbar IS NOT NULL AS stays FROM m LEFT JOIN st ON st.eid = new_elem LEFT JOIN o ON o.eid = new_elem),
  pl AS (SELECT *, row_number() OVER (PARTITION BY new_rank, sbar, stays ORDER BY CASE WHEN owner = rank THEN 1 ELSE 0 END, pid) AS place FROM c)
  SELECT pid, CASE WHEN stays AND ranks = '0,1' AND rank = 0 AND place <= 40 THEN 1 WHEN stays AND ranks = '1,2' AND rank = 2 AND place <= 25 THEN 1 ELSE new_rank END AS new_rank FROM pl""")
def _(spark, d):
    parts = _parts(spark, d)
    sets = balance.safe_sets(parts.halo)
    p = PT.unsafe_ranks(T.ranked(spark, d), parts.halo, parts.owners)
    named = sets.select(joined("ranks").alias("names"), "sbar").distinct()
    quotas = spark.createDataFrame([("0,1", 0, 1, 40), ("1,2", 2, 1, 25)], "names string, rank int, target int, quota long").join(named, "names").select("rank", "sbar", "target", "quota")
    return balance.select_particles(p, sets, quotas, parts.owners).select("pid", "new_rank")


def _moved_counts(spark, d):
    """rank, eid, n after forced moves, with the parts."""
    parts = _parts(spark, d)
    forced = PT.unsafe_ranks(T.ranked(spark, d), parts.halo, parts.owners).where("new_elem >= 0")
    return parts, forced.groupBy(F.col("new_rank").alias("rank"), F.col("new_elem").alias("eid")).agg(F.count(F.lit(1)).alias("n"))


@query("balance_diffusion_round", f"""WITH {SETS}, {WEIGHTS}, hv AS (SELECT new_rank AS rank, sbar, count(*) AS n FROM m JOIN st ON eid = new_elem GROUP BY 1, 2), mem AS (SELECT DISTINCT sbar, array_to_string(ranks, ',') AS ranks, unnest(ranks) AS rank FROM st),
  ld AS (SELECT rank, sum(n) AS load FROM hv GROUP BY rank), ways AS (SELECT hv.rank, hv.sbar, hv.n, l.load, mem.ranks, mem.rank AS target, coalesce(k.load, 0) AS low FROM hv JOIN ld l ON l.rank = hv.rank AND l.load > (SELECT sum(n) / {RANKS}.0 FROM hv) JOIN mem ON mem.sbar = hv.sbar LEFT JOIN ld k ON k.rank = mem.rank WHERE coalesce(k.load, 0) < l.load),
  pr AS (SELECT rank, target, sum(n) AS shared, max(load) AS load, max(low) AS low FROM ways GROUP BY 1, 2), dg AS (SELECT *, count(*) OVER (PARTITION BY rank) AS o, count(*) OVER (PARTITION BY target) AS i FROM pr),
  fl AS (SELECT rank, target, shared, least((load - low) // (greatest(o, i) + 1), shared // o) AS flow FROM dg)
  SELECT w.rank, w.ranks, w.target, CAST(flow * n // shared AS BIGINT) AS quota FROM ways w JOIN fl ON fl.rank = w.rank AND fl.target = w.target WHERE flow * n // shared > 0""")
def _(spark, d):
    """The plan of one round of diffusion, flow by flow."""
    parts, counts = _moved_counts(spark, d)
    sets = cut(balance.safe_sets(parts.halo))
    members = sets.select("sbar", F.explode("ranks").alias("rank")).distinct()
    moves, _ = DF.diffusion_plan(balance.weights_from_counts(counts, sets), members, RANKS, tol=1.0, rounds=1)
    return moves.join(sets.select("sbar", joined("ranks").alias("ranks")).distinct(), "sbar").select("rank", "ranks", "target", "quota")


@query("balance_counts_by_target", f"""WITH {SETS}, {WEIGHTS}, c AS (SELECT m.new_rank AS rank, sbar, array_to_string(st.ranks, ',') AS ranks, m.new_elem AS eid, o.owner = m.new_rank AS core, count(*) AS n FROM m JOIN st ON st.eid = m.new_elem JOIN o ON o.eid = m.new_elem GROUP BY 1, 2, 3, 4, 5),
  lay AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rank, sbar ORDER BY core, eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0 FROM c), q(ranks, rank, target, q0, q1) AS (VALUES ('0,1', 0, 1, 0, {EVENTS} // 50), ('1,2', 2, 1, 0, {EVENTS} // 80), ('1,2,3', 2, 1, 0, {EVENTS} // 90), ('1,2,3', 2, 3, {EVENTS} // 90, {EVENTS} // 90 + {EVENTS} // 70)),
  gone AS (SELECT lay.rank, lay.ranks, lay.eid, target, least(p0 + n, q1) - greatest(p0, q0) AS n FROM lay JOIN q ON q.rank = lay.rank AND q.ranks = lay.ranks WHERE p0 < q1 AND q0 < p0 + n),
  rest AS (SELECT lay.rank, lay.ranks, lay.eid, lay.rank AS target, lay.n - coalesce((SELECT sum(g.n) FROM gone g WHERE g.rank = lay.rank AND g.eid = lay.eid), 0) AS n FROM lay)
  SELECT rank, ranks, eid, target, CAST(n AS BIGINT) AS n FROM gone UNION ALL SELECT rank, ranks, eid, target, CAST(n AS BIGINT) FROM rest WHERE n > 0""")
def _(spark, d):
    """Counts that meet a plan's quotas by place: what goes to each target, element by element."""
    parts, counts = _moved_counts(spark, d)
    sets, k = cut(balance.safe_sets(parts.halo)), T.size(spark, d).events
    named = sets.select("sbar", joined("ranks").alias("ranks")).distinct()
    wanted = [("0,1", 0, 1, k // 50), ("1,2", 2, 1, k // 80), ("1,2,3", 2, 1, k // 90), ("1,2,3", 2, 3, k // 70)]
    quotas = spark.createDataFrame(wanted, "ranks string, rank int, target int, quota long").join(named, "ranks").select("rank", "sbar", "target", "quota")
    rows = counts.join(sets.select("eid", "sbar"), "eid").join(parts.owners, "eid").select("rank", "sbar", "eid", "n", (F.col("owner") == F.col("rank")).alias("is_core"))
    return DF.split_counts(rows, quotas).join(named, "sbar").select("rank", "ranks", "eid", "target", "n")


def _balance_facts(spark, d, moved: DataFrame, tol: float) -> DataFrame:
    """What must hold of a balanced assignment whatever the plan: every particle once, none on a rank where its element is not safe, and no rank above
    the greater of tolerance times the mean and what it had after forced moves."""
    parts = _parts(spark, d)
    forced = PT.unsafe_ranks(T.ranked(spark, d), parts.halo, parts.owners).where("new_elem >= 0")
    inside = moved.where("new_elem >= 0")
    safe = inside.join(parts.halo.where("is_safe").select(F.col("rank").alias("new_rank"), F.col("eid").alias("new_elem")), ["new_rank", "new_elem"], "left_anti")
    most = lambda df: df.groupBy("new_rank").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    before, after = most(forced).select(F.col("m").alias("m0")), most(inside)
    counts = moved.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pid").alias("pids")).crossJoin(safe.agg(F.count(F.lit(1)).alias("unsafe"))).crossJoin(before).crossJoin(after)
    return counts.select("n", "pids", "unsafe", (F.col("m") <= F.col("m0")).alias("not_worse"), ((F.col("m") <= F.col("m0") * 0.999) | (F.col("m") * RANKS <= tol * F.col("t") + RANKS)).alias("better_or_even"))


@query("balance_repartition", "SELECT count(*) AS n, count(*) AS pids, CAST(0 AS BIGINT) AS unsafe, true AS not_worse, true AS better_or_even FROM events")
def _(spark, d):
    parts = _parts(spark, d)
    return _balance_facts(spark, d, cut(balance.repartition(T.ranked(spark, d), parts.halo, parts.owners, RANKS, tol=1.05)), 1.05)


@query("migrate_balanced", f"WITH {P}, {R} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(pid) AS BIGINT) AS sum_pid, CAST(sum(new_elem) AS BIGINT) AS sum_elem FROM r WHERE new_elem >= 0")
def _(spark, d):
    parts = _parts(spark, d)
    out = balance.migrate_balanced(T.ranked(spark, d), parts.halo, parts.owners, RANKS)
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("sum_pid"), F.sum("elem_id").alias("sum_elem"))


@query("class_partition", f"""WITH RECURSIVE {E}, c AS (SELECT class_id, count(*) AS n, sum(count(*)) OVER (ORDER BY class_id) AS upto, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY class_id) AS k FROM e GROUP BY class_id),
  cut(k, turn) AS (
    SELECT greatest(1, least((SELECT count(*) - 1 FROM c), (SELECT count(*) FROM c WHERE upto - n / 2.0 <= total / 2.0))), 0
    UNION ALL SELECT cut.k - 1, turn + 1 FROM cut JOIN c ON c.k = cut.k WHERE turn < 10 AND cut.k > 1 AND upto * 2 > 1.05 * total AND upto > total - upto AND total - upto + n < upto)
  SELECT class_id, CAST(CASE WHEN k <= (SELECT min(k) FROM cut) THEN 0 ELSE 1 END AS INTEGER) AS owner FROM c""")
def _(spark, d):
    out = PA.class_partition(T.mesh(spark, d).elem, 2)
    return spark.createDataFrame(sorted(out.items()), "class_id int, owner int")


# timing


def _records(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("at"), F.col("user_id").cast("int").alias("rank"), F.col("event_type").alias("op"), F.round(F.col("value") * 100).alias("seconds"), F.lit(0.0).alias("prebarrier"))


@query("timing_summary", 'SELECT event_type AS op, sum(round(value * 100)) AS total, min(round(value * 100)) AS min, max(round(value * 100)) AS max, round(avg(round(value * 100)), 6) AS avg, round(avg(round(value * 100) * round(value * 100)), 3) AS mean_square, count(*) AS "count", 0.0::DOUBLE AS prebarrier, CAST(row_number() OVER (ORDER BY sum(round(value * 100)) DESC, event_type) AS INTEGER) AS place FROM events GROUP BY event_type')
def _(spark, d):
    ordered = summary(_records(spark, d), "LONGEST")
    # the order is the result's own, so its places are read off the sorted rows
    places = {r["op"]: k + 1 for k, r in enumerate(ordered.select("op").collect())}
    place = reduce(lambda rest, x: F.when(F.col("op") == x[0], x[1]).otherwise(rest), places.items(), F.lit(None).cast("int"))
    return ordered.withColumn("place", place).withColumns({"avg": F.round("avg", 6), "mean_square": F.round("mean_square", 3)})


@query("timing_across_ranks", "WITH b AS (SELECT event_type AS op, user_id, sum(round(value * 100)) AS t FROM events GROUP BY 1, 2) SELECT op, max(t) AS max, min(t) AS min, round(avg(t), 6) AS avg FROM b GROUP BY op")
def _(spark, d):
    return across_ranks(_records(spark, d)).select("op", "max", "min", F.round("avg", 6).alias("avg"))


@query("timing_records")
def _(spark, d):
    t = Timing()
    with t.timed("count"):
        T.particles(spark, d).count()
    return t.frame(spark)


# the whole loop


@query("mini_app_2d")
def _(spark, d):
    """Five elliptical pushes with search, rebuild and a scatter at the end."""
    from tesselark.plans.apps import gyro_app

    return gyro_app(T.particles(spark, d), T.mesh(spark, d), steps=5, gyro=GYRO)


@query("mini_app_3d")
def _(spark, d):
    """Two pushes along a direction with ray tracing; particles stop at the wall and turn round, then are removed there."""
    from tesselark.plans.apps import push_and_search_app

    return push_and_search_app(_particles_3d(spark, d), T.tets(spark, d), steps=2)


from tesselark.plans import files, kernels  # noqa: E402, F401  these add their queries

SQL.update({name: T.whole_sql(sql) for name, sql in SQL.items()})
