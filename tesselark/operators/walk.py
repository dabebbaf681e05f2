"""Point location and trajectory tracing: particles walk from element to element through mesh sides.

trace walks within tiles of the mesh (tile_walk.py). trace_by_hops gives the same hop by hop: one hop is one equi-join of the particles with the walk
table (an element's vertices, neighbours and sides in one row), no aggregate and no window. Several hops are planned together, then the particles still on
their way are checkpointed; finished ones are set aside. A stored walk table of few bytes is broadcast, a larger one is joined by shuffle.

particles: pid, elem_id, ox, oy[, oz] (origin), tx, ty[, tz] (target). Result: pid, elem_id (-1: removed or left the domain),
hops, face (side of the wall that was hit, else null), px, py[, pz] (last crossing in intersection mode, else null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.functions.geometry import TET_FACES, TRIANGLE_EDGES, barycentric_numerators_2d, barycentric_numerators_3d, line_edge_2d, tet_volume6, triangle_area2
from tesselark.functions.scalar import cross, dot, min3, min_index, minus, plus
from tesselark.operators import tile_walk as TW
from tesselark.storage import cut, small

AXES = ("x", "y", "z")
REMOVED = -1
Handler = Callable[[DataFrame], DataFrame]


def leave_at_wall(step: DataFrame) -> DataFrame:
    """A particle that meets an exposed side has left the domain."""
    return step.withColumn("elem", F.when(F.col("exposed"), F.lit(REMOVED)).otherwise(F.col("elem"))).withColumn("done", F.col("done") | F.col("exposed"))


def stop_at_wall(step: DataFrame) -> DataFrame:
    """A particle that meets an exposed side stays in its element; the side is recorded in face."""
    return step.withColumn("face", F.when(F.col("exposed"), F.col("exit_sid")).otherwise(F.col("face"))).withColumn("done", F.col("done") | F.col("exposed"))


def _vertices(dim: int) -> list[list[Column]]:
    return [[F.col(f"{a}{i}") for a in AXES[:dim]] for i in range(dim + 1)]


def _point(prefix: str, dim: int) -> list[Column]:
    return [F.col(f"{prefix}{a}") for a in AXES[:dim]]


def inside(dim: int, p: list[Column], tol: float) -> Column:
    """Every coordinate of p in the row's element is at least -tol; exact for whole numbers and tol 0."""
    v = _vertices(dim)
    b, whole = (barycentric_numerators_2d(v, p), triangle_area2(*v)) if dim == 2 else (barycentric_numerators_3d(v, p), tet_volume6(v))
    return F.least(*b) >= (0 if tol == 0 else -tol * whole)


def _by_coordinates(rows: DataFrame, dim: int, tol: float) -> DataFrame:
    """rows with way (li; no crossing): the side with the least coordinate of the target, null if the target is inside."""
    v, t = _vertices(dim), _point("t", dim)
    b = barycentric_numerators_2d(v, t) if dim == 2 else barycentric_numerators_3d(v, t)
    rows = rows.withColumns({f"_b{i}": x for i, x in enumerate(b)} | {"_whole": triangle_area2(*v) if dim == 2 else tet_volume6(v)})
    b = [F.col(f"_b{i}") for i in range(dim + 1)]
    ok = F.least(*b) >= (F.lit(0) if tol == 0 else -tol * F.col("_whole"))
    li = F.when(~ok, min3(*b) if dim == 2 else min_index(b))
    return rows.withColumn("way", F.struct(li.alias("li"), *(F.lit(None).cast("double").alias(a) for a in AXES[:dim])))


def _by_crossing_2d(rows: DataFrame, tol: float) -> DataFrame:
    """rows with way (li, x, y): the last side that the segment crosses, the side it came through left out."""
    v, o, t = _vertices(2), _point("o", 2), _point("t", 2)
    for li, side in enumerate(TRIANGLE_EDGES):
        rows = rows.withColumn(f"_r{li}", line_edge_2d(*(v[i] for i in side), o, t, tol))
    way = F.lit(None)
    for li in range(3):
        fresh = ~F.col(f"s{li}").eqNullSafe(F.col("last"))
        way = F.when(fresh & F.col(f"_r{li}.hit"), F.struct(F.lit(li).alias("li"), *(F.col(f"_r{li}.{a}").cast("double").alias(a) for a in AXES[:2]))).otherwise(way)
    return rows.withColumn("way", way)


def _meet_faces(rows: DataFrame, real) -> DataFrame:
    """rows with, for each face li: _nn (square of its normal), _dproj (normal times way), _t (share of the way at which its plane is met), _a (from the
    face's first corner to there) and _u, _v (that point in the face's coordinates). In steps: what several later steps read is a
    column of its own, so that no expression is written out once for each of its uses."""
    v, faces = list(map(real, _vertices(3))), range(4)
    vec = lambda name, li="": [F.col(f"_{name}{li}{a}") for a in AXES]
    put = lambda name, li, xs: {f"_{name}{li}{a}": x for a, x in zip(AXES, xs, strict=True)}
    corner = lambda li, k: v[TET_FACES[li][k]]
    cols: dict[str, Column] = put("d", "", minus(real(_point("t", 3)), real(_point("o", 3))))
    for li in faces:
        cols |= put("e", li, minus(corner(li, 1), corner(li, 0))) | put("f", li, minus(corner(li, 2), corner(li, 0))) | put("g", li, minus(real(_point("o", 3)), corner(li, 0)))
    rows = rows.withColumns(cols)
    rows = rows.withColumns({k: c for li in faces for k, c in put("n", li, cross(vec("e", li), vec("f", li))).items()})
    rows = rows.withColumns({f"_dproj{li}": dot(vec("n", li), vec("d")) for li in faces} | {f"_nn{li}": F.nullif(dot(vec("n", li), vec("n", li)), F.lit(0.0)) for li in faces})
    rows = rows.withColumns({f"_t{li}": -dot(vec("n", li), vec("g", li)) / F.nullif(F.col(f"_dproj{li}"), F.lit(0.0)) for li in faces})
    rows = rows.withColumns({k: c for li in faces for k, c in put("a", li, plus(vec("g", li), vec("d"), F.col(f"_t{li}"))).items()})
    u = {f"_u{li}": dot(cross(vec("a", li), vec("f", li)), vec("n", li)) / F.col(f"_nn{li}") for li in faces}
    return rows.withColumns(u | {f"_v{li}": dot(cross(vec("e", li), vec("a", li)), vec("n", li)) / F.col(f"_nn{li}") for li in faces})


def _met(li: int, real) -> list[Column]:
    """li and where its plane is met."""
    corner = real(_vertices(3)[TET_FACES[li][0]])
    return [F.lit(li).alias("li"), *(x.alias(a) for a, x in zip(AXES, plus(corner, [F.col(f"_a{li}{a}") for a in AXES], F.lit(1.0)), strict=True))]


def _real(p: list[Column]) -> list[Column]:
    """Products of four whole coordinates would overflow."""
    return [c.cast("double") for c in p]


def _by_crossing_3d(rows: DataFrame, tol: float, bounded: bool) -> DataFrame:
    """rows with way (li, x, y, z): the last side crossed; if the way has no end and crosses none, the one ahead that it misses by least. As
    ray_triangle() and segment_triangle()."""
    rows, way, misses = _meet_faces(rows, _real), F.lit(None), []
    for li in range(4):
        dproj, at, uu, vv = (F.col(f"_{k}{li}") for k in ("dproj", "t", "u", "v"))
        hit = (dproj >= tol) & (at >= -tol) & (uu >= -tol) & (vv >= -tol) & (uu + vv <= 1 + 2 * tol)
        hit = F.coalesce(hit & (at <= 1 + tol) if bounded else hit, F.lit(False))
        fresh = ~F.col(f"s{li}").eqNullSafe(F.col("last"))
        way = F.when(fresh & hit, F.struct(*_met(li, _real))).otherwise(way)
        # a face along the way is met nowhere, so its coordinates are null and it is missed by no amount
        misses.append(F.when(fresh & (dproj > -tol) & uu.isNotNull() & vv.isNotNull(), F.struct(F.greatest(F.lit(0.0), -uu, -vv, uu + vv - 1).alias("c"), *_met(li, _real))))
    if bounded:
        return rows.withColumn("way", way)
    rows = rows.withColumns({"_hit": way, "_miss": F.least(*misses)})
    return rows.withColumn("way", F.coalesce("_hit", F.when(F.col("_miss").isNotNull(), F.struct(*(F.col(f"_miss.{k}").alias(k) for k in ("li", *AXES))))))


def _by_first_crossing_3d(rows: DataFrame, tol: float) -> DataFrame:
    """rows with way (li, x, y, z) and leak: nothing where the target is inside; else the first side that the segment meets by signed distances, as
    segment_triangle_projected(); if there is none, the one whose normal goes along most (first of equals); leak where it goes against all."""
    rows = _meet_faces(rows, _real)
    rows = rows.withColumns({f"_p{li}": F.col(f"_dproj{li}") / F.sqrt(f"_nn{li}") for li in range(4)} | {"_out": ~inside(3, _point("t", 3), tol)})
    along = F.greatest(*(F.col(f"_p{li}") for li in range(4)))
    met, most = F.lit(None), F.lit(None)
    for li in (3, 2, 1, 0):
        p, at, u, v = (F.col(f"_{k}{li}") for k in ("p", "t", "u", "v"))
        within = (F.least(u, v, 1 - u - v) >= -tol) & (F.greatest(u, v, 1 - u - v) <= 1 + tol)
        met = F.when((p > 0) & (at * p >= -tol) & ((1 - at) * p >= -tol) & within, F.struct(*_met(li, _real))).otherwise(met)
        most = F.when(F.col(f"_p{li}") == F.col("_along"), F.struct(*_met(li, _real))).otherwise(most)
    rows = rows.withColumn("_along", along).withColumns({"_met": met, "_most": most})
    way = F.when(F.col("_out"), F.coalesce("_met", F.when(F.col("_along") >= 0, F.col("_most"))))
    return rows.withColumns({"way": way, "leak": F.coalesce(F.col("_out") & F.col("_met").isNull() & (F.col("_along") < 0), F.lit(False))})


def _hop(state: DataFrame, walk: DataFrame, dim: int, crossing: bool | str, tol: float, bounded: bool, handler: Handler) -> DataFrame:
    keep = state.columns
    joined = state.join(walk, F.when(~F.col("done"), F.col("elem")) == F.col("eid"), "left")
    if crossing == "first":
        joined = _by_first_crossing_3d(joined, tol)
    elif crossing:
        joined = _by_crossing_2d(joined, tol) if dim == 2 else _by_crossing_3d(joined, tol, bounded)
    else:
        joined = _by_coordinates(joined, dim, tol)
    joined = joined.withColumn("way", F.when(~F.col("done"), F.col("way"))).withColumn("li", F.col("way.li"))
    moves = ~F.col("done") & F.col("li").isNotNull()
    pick = lambda c: reduce(lambda rest, i: F.when(F.col("li") == i, F.col(f"{c}{i}")).otherwise(rest), range(dim - 1, -1, -1), F.col(f"{c}{dim}"))
    joined = joined.withColumns({"exit_sid": F.when(moves, pick("s")), "next": F.when(moves, pick("n"))})
    joined = joined.withColumns({"exposed": moves & F.col("next").isNull(), "hops": F.col("hops") + F.when(moves, 1).otherwise(0), "done": F.col("done") | F.col("li").isNull()})
    if crossing:
        joined = joined.withColumns({f"p{a}": F.when(moves, F.col(f"way.{a}")).otherwise(F.col(f"p{a}")) for a in AXES[:dim]})
    joined = handler(joined)
    goes_on = ~F.col("done")
    return joined.withColumns({"elem": F.when(goes_on, F.col("next")).otherwise(F.col("elem")), "last": F.when(goes_on, F.col("exit_sid")).otherwise(F.col("last"))}).select(*keep)


def check_initial_parents(particles: DataFrame, walk: DataFrame, dim: int, tol: float = 1e-10) -> DataFrame:
    """particles with ok: whether the origin lies in the parent element."""
    out = particles.join(walk, F.col("elem_id") == F.col("eid"), "left")
    return out.select(*(F.col(c) for c in particles.columns), F.coalesce(inside(dim, _point("o", dim), tol), F.lit(False)).alias("ok"))


def trace_by_hops(
    particles: DataFrame, walk: DataFrame, dim: int, *, crossing: bool | str = False, bounded: bool = False, tol: float = 1e-10, still: float = 0.0,
    handler: Handler | None = None, looplimit: int = 0, remove_at_limit: bool = True, strict: bool = False, check_parents: bool = True, hops_at_once: int | None = None, broadcast_bytes: int | None = None,
) -> DataFrame:
    """trace hop by hop, with any handler: a hop of all particles is one join, so a step takes as many joins as the longest way crosses sides. crossing: find exits by intersecting the way (a bounded segment in the plane; in space a ray without
    an end, or a segment if ``bounded``, or if "first" by the older rule, see _by_first_crossing_3d), else by the target's coordinates. Particles that move at most ``still`` are done before
    anything is checked. strict: an origin outside its parent is an error rather than a removal. looplimit 0: no
    limit, but more hops than twice the elements are an error, as rounding then sends a particle to and fro."""
    hops_at_once = hops_at_once or (4 if dim == 2 and not crossing else 2 if dim == 2 else 1)
    walk = small(cut(walk), broadcast_bytes)
    handler = handler or (stop_at_wall if crossing else leave_at_wall)
    o, t = _point("o", dim), _point("t", dim)
    start = particles.select("pid", F.col("elem_id").cast("long").alias("elem_id"), *o, *t)
    moved = dot(minus(t, o), minus(t, o)) > still * still
    start = check_initial_parents(start, walk, dim, tol) if check_parents or strict else start.withColumn("ok", F.lit(True))
    lost = moved & ~F.col("ok") & (F.col("elem_id") != REMOVED)
    nothing = F.lit(None).cast("double")
    state = start.select(
        "pid", F.when(lost, F.lit(REMOVED)).otherwise(F.col("elem_id")).cast("long").alias("elem"), *o, *t,
        ((F.col("elem_id") == REMOVED) | ~moved | lost).alias("done"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("face"),
        *(nothing.alias(f"p{a}") for a in AXES[:dim]), F.lit(0).alias("hops"),
    )
    if strict and not start.where(lost).isEmpty():
        raise ValueError("some particles do not start in their parent element")
    finished, hops, bound = [], 0, None
    while True:
        if not looplimit and hops > 256:
            bound = bound or walk.count()
            if hops > 2 * bound:
                raise ValueError(f"some particles are still on their way after {hops} hops in a mesh of {bound} elements")
        n = hops_at_once if not looplimit else min(hops_at_once, looplimit - hops)
        for _ in range(n):
            state = _hop(state, walk, dim, crossing, tol, bounded, handler)
        hops += n
        state = cut(state)
        finished.append(state.where("done"))
        state = state.where("not done")
        if state.isEmpty():
            break
        if looplimit and hops >= looplimit:
            finished.append(state.withColumn("elem", F.lit(REMOVED).cast("long")) if remove_at_limit else state)
            break
    out = reduce(DataFrame.unionByName, finished)
    return out.select("pid", F.col("elem").alias("elem_id"), "hops", "face", *(f"p{a}" for a in AXES[:dim]))


def trace(
    particles: DataFrame, walk: DataFrame, dim: int, *, crossing: bool | str = False, bounded: bool = False, tol: float = 1e-10, still: float = 0.0,
    handler: Handler | None = None, looplimit: int = 0, remove_at_limit: bool = True, strict: bool = False, check_parents: bool = True, short: bool = False, **by_hops,
) -> DataFrame:
    """The walk, within tiles of the mesh (tile_walk.py). The arguments are those of trace_by_hops, which takes over where the handler is not one of this module's. short: who
    meets its target before the crossing stops in its element. hops_at_once and broadcast_bytes are for trace_by_hops and change no result."""
    handler = handler or (stop_at_wall if crossing else leave_at_wall)
    how = dict(tol=tol, still=still, looplimit=looplimit, remove_at_limit=remove_at_limit, strict=strict, check_parents=check_parents)
    if handler not in WALLS:
        return trace_by_hops(particles, walk, dim, crossing=crossing, bounded=bounded, handler=handler, **how, **by_hops)
    way = TW.FIRST if crossing == "first" else TW.COORDINATES if not crossing else TW.SEGMENT if bounded and dim == 3 else TW.CROSSING
    return TW.trace_in_tiles(particles, cut(walk), dim, way, WALLS[handler], short=short, **how)


def search_2d(particles: DataFrame, walk: DataFrame, looplimit: int = 0, tol: float = 1e-10) -> DataFrame:
    """Elements of the targets, by coordinates."""
    return trace(particles, walk, 2, looplimit=looplimit, tol=tol, check_parents=False)


def search_3d(particles: DataFrame, walk: DataFrame, looplimit: int = 0, tol: float = 1e-20) -> DataFrame:
    """Walk along the segment in space; a wrong parent is an error and the limit removes nothing."""
    return trace(particles, walk, 3, crossing=True, bounded=True, tol=tol, strict=True, looplimit=looplimit, remove_at_limit=False, handler=leave_at_wall)


def remove_at_wall_or_leak(step: DataFrame) -> DataFrame:
    """A particle that meets an exposed side is removed and the side recorded; so is one that no side lets out, without a side."""
    step = step.withColumn("face", F.when(F.col("exposed"), F.col("exit_sid")).otherwise(F.col("face")))
    gone = F.col("exposed") | F.col("leak")
    return step.withColumns({"elem": F.when(gone, F.lit(REMOVED)).otherwise(F.col("elem")), "done": F.col("done") | gone})


def search_first_face_3d(particles: DataFrame, walk: DataFrame, looplimit: int = 0, tol: float = 1e-10) -> DataFrame:
    """The older walk in space: the first side that the segment meets is taken. An origin outside its parent is an error, and the walk
    ends after looplimit + 1 hops without removing anybody."""
    return trace(particles, walk, 3, crossing="first", tol=tol, strict=True, looplimit=looplimit + 1 if looplimit else 0, remove_at_limit=False, handler=remove_at_wall_or_leak)


WALLS = {leave_at_wall: TW.LEAVE, stop_at_wall: TW.STOP, remove_at_wall_or_leak: TW.REMOVE}

#: A mesh of at most so many bytes may go to every executor as arrays (80 a triangle).
FUSED_BYTES = 160 << 20


def search_fused_2d(particles: DataFrame, walk: DataFrame, limit_bytes: int = FUSED_BYTES, looplimit: int = 0) -> DataFrame:
    """pid, elem_id, hops as search_2d with tol 0, for meshes of at most limit_bytes (checked): the walk table goes to
    every executor as arrays, and each batch of particles walks to its end within one task, without a shuffle. Larger meshes go to search_2d."""
    columns, limit_rows = ["eid", *(f"{a}{i}" for i in range(3) for a in "xy"), *(f"n{i}" for i in range(3))], limit_bytes // 80
    rows = walk.select(*columns).limit(limit_rows + 1).toArrow()
    if rows.num_rows > limit_rows:
        return search_2d(particles, walk, looplimit, 0.0).select("pid", "elem_id", "hops")
    rows = rows.sort_by("eid")
    numbers = rows["eid"].to_numpy()
    xy = np.stack([rows[c].to_numpy().astype(np.float64 if pa.types.is_floating(rows[c].type) else np.int64) for c in columns[1:7]], axis=1).reshape(-1, 3, 2)
    near = np.stack([rows[c].combine_chunks().fill_null(REMOVED).to_numpy() for c in columns[7:]], axis=1)
    mesh = particles.sparkSession.sparkContext.broadcast((numbers, xy, near))

    def walk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, xy, near = mesh.value
        for b in batches:
            elem, p = b["elem_id"].to_numpy(zero_copy_only=False).copy(), np.stack([b["tx"].to_numpy(), b["ty"].to_numpy()], axis=1)
            # who does not move, or is in no element of this mesh, stays where it is, as in search_2d
            moves = (b["ox"].to_numpy() != p[:, 0]) | (b["oy"].to_numpy() != p[:, 1])
            known = numbers[np.minimum(np.searchsorted(numbers, elem), len(numbers) - 1)] == elem if len(numbers) else np.zeros(len(elem), bool)
            hops, at, turn = np.zeros(len(elem), np.int32), np.flatnonzero(known & moves), 0
            while len(at) and not (looplimit and turn >= looplimit):
                row = np.searchsorted(numbers, elem[at])
                v, q = xy[row], p[at]
                side = [(v[:, j, 0] - v[:, i, 0]) * (q[:, 1] - v[:, i, 1]) - (v[:, j, 1] - v[:, i, 1]) * (q[:, 0] - v[:, i, 0]) for i, j in TRIANGLE_EDGES]
                low = np.where(side[0] < side[1], side[0], side[1])
                out = np.where(low < side[2], np.where(side[0] < side[1], 0, 1), 2)
                go = np.minimum(low, side[2]) < 0
                at, row, out = at[go], row[go], out[go]
                elem[at] = near[row, out]
                hops[at] += 1
                at, turn = at[elem[at] != REMOVED], turn + 1
            elem[at] = REMOVED
            yield pa.RecordBatch.from_arrays([b["pid"], pa.array(elem), pa.array(hops)], ["pid", "elem_id", "hops"])

    slim = particles.select("pid", F.col("elem_id").cast("long").alias("elem_id"), "ox", "oy", "tx", "ty")
    return slim.mapInArrow(walk_batches, "pid long, elem_id long, hops int")


def recursive_walk_sql(particles: str, walk: str, limit: int = 100, rest: bool = False) -> str:
    """The exact 2-D walk as one recursive query over the views ``particles`` and ``walk``: pid, elem_id, hops. A particle still on its way after limit hops
    is an error, or, with rest, marked: tx, ty and goes_on follow. Each hop of each particle is a row of the recursion."""
    on = f"NOT m.ends AND m.elem_id >= 0 AND m.hops >= {limit}"
    found = f"m.elem_id, m.hops, m.tx, m.ty, {on} AS goes_on" if rest else f"CASE WHEN {on} THEN CAST(raise_error('a particle is on its way after {limit} hops') AS BIGINT) ELSE m.elem_id END AS elem_id, m.hops AS hops"
    b = [f"(x{j} - x{i}) * (ty - y{i}) - (y{j} - y{i}) * (tx - x{i})" for i, j in TRIANGLE_EDGES]
    return f"""
    WITH RECURSIVE hop(pid, elem_id, tx, ty, hops, moves) AS (
      SELECT pid, elem_id, tx, ty, 0, true FROM {particles}
      UNION ALL
      SELECT pid, CASE WHEN least(b0, b1, b2) >= 0 THEN elem_id ELSE coalesce(CASE WHEN (CASE WHEN b0 < b1 THEN b0 ELSE b1 END) < b2 THEN (CASE WHEN b0 < b1 THEN n0 ELSE n1 END) ELSE n2 END, -1) END,
        tx, ty, hops + CASE WHEN least(b0, b1, b2) >= 0 THEN 0 ELSE 1 END, least(b0, b1, b2) < 0
      FROM (SELECT h.*, w.n0, w.n1, w.n2, {b[0]} AS b0, {b[1]} AS b1, {b[2]} AS b2 FROM hop h JOIN {walk} w ON h.elem_id = w.eid WHERE h.moves AND h.hops < {limit})
    ), last AS (SELECT pid, max(named_struct('hops', hops, 'ends', NOT moves, 'elem_id', elem_id, 'tx', tx, 'ty', ty)) AS m FROM hop GROUP BY pid)
    SELECT pid, {found} FROM last
    """


def search_recursive_2d(particles: DataFrame, walk: DataFrame) -> DataFrame:
    """pid (unique), elem_id, hops as search_2d with tol 0. The first hops are one recursive query, as many as spark.sql.cteRecursionRowLimit and
    cteRecursionLevelLimit leave room for whatever the ways are; who is still on its way then walks on inside tiles, and where not one hop fits, all do."""
    spark, walk = particles.sparkSession, cut(walk)
    rows, levels = (int(spark.conf.get(f"spark.sql.cteRecursion{k}Limit", v)) for k, v in (("Row", "1000000"), ("Level", "100")))
    n = particles.count()
    limit = min(98 if levels < 0 else levels - 2, 98 if rows < 0 else rows // max(n, 1) - 2)
    if limit < 1:
        return search_2d(particles, walk, tol=0.0).select("pid", "elem_id", "hops")
    particles.select("pid", F.col("elem_id").cast("long").alias("elem_id"), "tx", "ty").createOrReplaceTempView("tesselark_particles")
    walk.createOrReplaceTempView("tesselark_walk")
    out = cut(spark.sql(recursive_walk_sql("tesselark_particles", "tesselark_walk", limit, rest=True)))
    ended, rest = out.where("not goes_on").select("pid", "elem_id", "hops"), out.where("goes_on")
    if rest.isEmpty():
        return ended
    # a walk by coordinates asks of the origin only whether it is another point than the target
    more = search_2d(rest.select("pid", "elem_id", (F.col("tx") - 1).alias("ox"), F.col("ty").alias("oy"), "tx", "ty"), walk, tol=0.0)
    return ended.unionByName(more.select("pid", "elem_id", (F.col("hops") + limit).alias("hops")))
