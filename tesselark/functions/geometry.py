"""Geometry kernels on triangles and tetrahedra as Column expressions.

Points are lists of Columns. Coordinates may be whole numbers: products then stay exact, and signs are decided without a tolerance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselark.functions.scalar import all_positive, cross, cross2, dot, min_index, minus, norm, plus

Point = Sequence[Column]

# Local vertices of each side, and the vertex that a tetrahedron's side leaves out.
TRIANGLE_EDGES = ((0, 1), (1, 2), (2, 0))
TET_FACES = ((0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3))
TET_OPPOSITE = (3, 2, 0, 1)


# measures, centroids, normals


def triangle_area2(a: Point, b: Point, c: Point) -> Column:
    """Twice the signed area in the plane."""
    return cross2(b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1])


def tet_volume6(v: Sequence[Point]) -> Column:
    """Six times the signed volume."""
    a, b, c = (minus(v[i], v[0]) for i in (1, 2, 3))
    return dot(cross(a, b), c)


def centroid(points: Sequence[Point]) -> list[Column]:
    n = len(points)
    return [sum((p[k] for p in points[1:]), points[0][k]) / n for k in range(len(points[0]))]


def normal(a: Point, b: Point, c: Point) -> list[Column]:
    """(b - a) x (c - a), not normalised."""
    return cross(minus(b, a), minus(c, a))


def unit(v: Point) -> list[Column]:
    length = F.nullif(norm(v), F.lit(0.0))
    return [x / length for x in v]


def face_of_tet(v: Sequence[Point], face: int) -> list[Point]:
    return [v[i] for i in TET_FACES[face]]


def face_centroid_of_tet(v: Sequence[Point], face: int) -> list[Column]:
    return centroid(face_of_tet(v, face))


def face_normal_of_tet(v: Sequence[Point], face: int) -> list[Column]:
    """Unit normal out of the element, whatever the orientation of its vertices."""
    a, b, c = face_of_tet(v, face)
    n = normal(a, b, c)
    inward = dot(n, minus(v[TET_OPPOSITE[face]], a)) > 0
    return [F.when(inward, -x).otherwise(x) for x in unit(n)]


# barycentric coordinates


def barycentric_numerators_2d(v: Sequence[Point], p: Point) -> list[Column]:
    """Twice the signed area towards each edge (v_k, v_k+1): not negative within a counter-clockwise triangle."""
    return [cross2(v[j][0] - v[i][0], v[j][1] - v[i][1], p[0] - v[i][0], p[1] - v[i][1]) for i, j in TRIANGLE_EDGES]


def barycentric_2d(v: Sequence[Point], p: Point, area: Column | None = None, by_vertex: bool = False) -> list[Column]:
    """Coordinates by edge, or by vertex (each vertex's is its opposite edge's)."""
    whole = 2 * area if area is not None else triangle_area2(*v)
    b = [x / F.nullif(whole, F.lit(0.0)) for x in barycentric_numerators_2d(v, p)]
    return [b[1], b[2], b[0]] if by_vertex else b


def barycentric_numerators_3d(v: Sequence[Point], p: Point) -> list[Column]:
    """Six times the signed volume towards each face; not negative within a positively oriented tetrahedron."""
    out = []
    for face in TET_FACES:
        a, b, c = (v[i] for i in face)
        out.append(-dot(normal(a, b, c), minus(p, a)))
    return out


def barycentric_3d(v: Sequence[Point], p: Point, least_volume: float = 1e-20, by_vertex: bool = False) -> list[Column]:
    """Coordinates by face (or by vertex) that sum to 1; -1 where six times the volume is at most least_volume."""
    whole = tet_volume6(v)
    b = [F.when(whole > least_volume, x / whole).otherwise(F.lit(-1.0)) for x in barycentric_numerators_3d(v, p)]
    return [b[TET_OPPOSITE.index(i)] for i in range(4)] if by_vertex else b


def barycentric_in_plane(v: Sequence[Point], p: Point, least_area: float = 1e-20) -> list[Column]:
    """Coordinates of a point of the plane of a triangle in space, by vertex; null for a degenerate triangle."""
    n = normal(*v)
    whole = dot(n, n)
    part = lambda a, b: dot(normal(a, b, p), n) / whole
    b = [part(v[1], v[2]), part(v[2], v[0]), part(v[0], v[1])]
    return [F.when(norm(n) >= least_area, x) for x in b]


def in_triangle(v: Sequence[Point], p: Point, tol: float = 1e-10) -> Column:
    return all_positive(barycentric_2d(v, p), tol)


def in_tet(v: Sequence[Point], p: Point, tol: float = 1e-10) -> Column:
    return all_positive(barycentric_3d(v, p), tol)


# lines against sides


def line_edge_2d(a: Point, b: Point, orig: Point, dest: Point, tol: float = 0.0, flip: Column | bool = False) -> Column:
    """struct(hit, x, y, t): the segment leaves through edge a-b, seen from the left of a to b (of b to a if flipped)."""
    sign = F.when(F.lit(flip) if isinstance(flip, bool) else flip, -1).otherwise(1)
    ex, ey, px, py = b[0] - a[0], b[1] - a[1], dest[0] - orig[0], dest[1] - orig[1]
    det = cross2(px, py, ex, ey) * sign
    s = cross2(a[0] - orig[0], a[1] - orig[1], ex, ey) * sign
    t = cross2(a[0] - orig[0], a[1] - orig[1], px, py) * sign
    hit = (det > tol if tol == 0 else det >= tol) & (s >= -tol) & (s <= det + tol) & (t >= -tol) & (t <= det + tol)
    where = s / F.nullif(det, F.lit(0))
    return F.struct(hit.alias("hit"), (orig[0] + px * where).alias("x"), (orig[1] + py * where).alias("y"), where.alias("t"))


def ray_triangle(face: Sequence[Point], orig: Point, dest: Point, tol: float = 1e-10, flip: Column | bool = False) -> Column:
    """struct(hit, x, y, z, dproj, closeness, t): the ray through orig and dest, without an end, meets the face on its way out.

    dproj is positive when the ray goes along the face's normal (out of the element); flip turns the face. t is 1 at dest.
    closeness is how far outside the face the point is in face coordinates (0 within; null where the ray meets the face's plane nowhere).
    """
    turned = F.lit(flip) if isinstance(flip, bool) else flip
    a = face[0]
    b = [F.when(turned, y).otherwise(x) for x, y in zip(face[1], face[2], strict=True)]
    c = [F.when(turned, x).otherwise(y) for x, y in zip(face[1], face[2], strict=True)]
    e1, e2, d, o = minus(b, a), minus(c, a), minus(dest, orig), minus(orig, a)
    n = cross(e1, e2)
    dproj = dot(n, d)
    safe = F.nullif(dproj, F.lit(0.0))
    t = -dot(n, o) / safe
    x = plus(orig, d, t)
    at = minus(x, a)
    nn = F.nullif(dot(n, n), F.lit(0.0))
    u, v = dot(cross(at, e2), n) / nn, dot(cross(e1, at), n) / nn
    hit = (dproj >= tol) & (t >= -tol) & (u >= -tol) & (v >= -tol) & (u + v <= 1 + 2 * tol)
    closeness = F.when(u.isNotNull() & v.isNotNull(), F.greatest(F.lit(0.0), -u, -v, u + v - 1))
    named = zip(("x", "y", "z"), x, strict=True)
    return F.struct(F.coalesce(hit, F.lit(False)).alias("hit"), *(c.alias(k) for k, c in named), dproj.alias("dproj"), closeness.alias("closeness"), t.alias("t"))


moller_trumbore_line_triangle = ray_triangle


def segment_triangle(face: Sequence[Point], orig: Point, dest: Point, tol: float = 1e-10, flip: Column | bool = False) -> Column:
    """As ray_triangle, but the meeting point lies between orig and dest."""
    r = ray_triangle(face, orig, dest, tol, flip)
    return F.struct((r["hit"] & F.coalesce(r["t"] <= 1 + tol, F.lit(False))).alias("hit"), *(r[k].alias(k) for k in ("x", "y", "z", "dproj", "closeness", "t")))


def segment_triangle_projected(face: Sequence[Point], orig: Point, dest: Point, tol: float = 1e-10) -> Column:
    """struct(hit, x, y, z, dproj) by signed distances of both ends from the face's plane."""
    n = unit(normal(*face))
    before, after = dot(n, minus(face[0], orig)), dot(n, minus(dest, face[0]))
    dproj = dot(n, minus(dest, orig))
    x = plus(orig, minus(dest, orig), before / F.nullif(dproj, F.lit(0.0)))
    b = barycentric_in_plane(face, x)
    inside = F.greatest(*b) <= 1 + tol
    hit = (before >= -tol) & (after >= -tol) & (dproj > 0) & all_positive(b, tol) & inside
    return F.struct(F.coalesce(hit, F.lit(False)).alias("hit"), *(c.alias(k) for k, c in zip(("x", "y", "z"), x, strict=True)), dproj.alias("dproj"))


# closest point


REGIONS = ("VTXA", "VTXB", "VTXC", "EDGEAB", "EDGEAC", "EDGEBC", "TRIFACE")


def closest_point_on_triangle(v: Sequence[Point], p: Point) -> Column:
    """struct(x, y, z, region): the point of the triangle nearest to p, and which of REGIONS it lies in."""
    a, b, c = v
    ab, ac, ap, bp, cp = minus(b, a), minus(c, a), minus(p, a), minus(p, b), minus(p, c)
    d1, d2, d3, d4, d5, d6 = dot(ab, ap), dot(ac, ap), dot(ab, bp), dot(ac, bp), dot(ab, cp), dot(ac, cp)
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2

    def at(point: Point, region: str) -> Column:
        return F.struct(*(x.cast("double").alias(k) for k, x in zip(("x", "y", "z"), point, strict=True)), F.lit(region).alias("region"))

    ratio = lambda x, y: x / F.nullif(y, F.lit(0.0))
    bc = ratio(d4 - d3, (d4 - d3) + (d5 - d6))
    whole = va + vb + vc
    return (
        F.when((d1 <= 0) & (d2 <= 0), at(a, "VTXA"))
        .when((d3 >= 0) & (d4 <= d3), at(b, "VTXB"))
        .when((d6 >= 0) & (d5 <= d6), at(c, "VTXC"))
        .when((vc <= 0) & (d1 >= 0) & (d3 <= 0), at(plus(a, ab, ratio(d1, d1 - d3)), "EDGEAB"))
        .when((vb <= 0) & (d2 >= 0) & (d6 <= 0), at(plus(a, ac, ratio(d2, d2 - d6)), "EDGEAC"))
        .when((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), at(plus(b, minus(c, b), bc), "EDGEBC"))
        .otherwise(at(plus(plus(a, ab, ratio(vb, whole)), ac, ratio(vc, whole)), "TRIFACE"))
    )


closest_point_on_triangle_wnormal = closest_point_on_triangle


# proximity and orientation


def distance(a: Point, b: Point) -> Column:
    return norm(minus(a, b))


def any_within(points: Sequence[Point], others: Sequence[Point], depth: float) -> Column:
    """Some vertex of one is within depth of some vertex of the other (face against tet, tet against tet)."""
    return F.least(*(distance(a, b) for a in points for b in others)) <= depth


def is_flipped(local: Sequence[Column], side: Sequence[Column]) -> Column:
    """Whether a side's vertices run against its element's local order (any cyclic shift counts as along)."""
    n = len(local)
    along = F.lit(False)
    if n == 2:
        return ~((local[0] == side[0]) & (local[1] == side[1]))
    for k in range(n):
        same = F.lit(True)
        for i in range(n):
            same = same & (local[(i + k) % n] == side[i])
        along = along | same
    return ~along


def exit_by_barycentric_3d(b: Sequence[Column]) -> Column:
    """The face with the least coordinate (first of equals)."""
    return min_index(b)
