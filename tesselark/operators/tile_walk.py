"""Walks inside tiles: the mesh is cut into tiles of neighbouring elements, particles meet the tile that they are in, walk within it to their end or to
its edge, and only those that left are exchanged. There are as many rounds as a way crosses tiles, not as it crosses sides.

A tile holds ELEMENTS_AT_ONCE elements that follow each other along a curve through the mesh (in a mesh of fewer there is one tile). A tile's particles are
dealt into groups of at least PARTICLES_AT_ONCE, each of which meets its own copy of the tile, so a task holds one tile and one group whatever the sizes.
No mesh and no particle comes to the driver; of each round it learns whether some particle is still on its way.

The rules by which a particle leaves its element are those of walk.py (one hop a join) on arrays, operation by operation, so both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselark.functions.geometry import TET_FACES, TRIANGLE_EDGES
from tesselark.storage import cut, numbered, small

AXES, REMOVED = ("x", "y", "z"), -1
ELEMENTS_AT_ONCE, PARTICLES_AT_ONCE, BLOCK = 1 << 17, 1 << 16, 1 << 14
#: A tile also holds its neighbours' elements within so many sides: who walks along the edge of two tiles is not handed to and fro at every side.
LAYERS = 4
#: What a particle does at a wall.
LEAVE, STOP, REMOVE = "leave", "stop", "remove"
#: By what it finds its way: the target's coordinates, the last side crossed (in space by a ray or by a segment), or the first.
COORDINATES, CROSSING, SEGMENT, FIRST = "coordinates", "crossing", "segment", "first"
Points = list[np.ndarray]


# ways: v holds the corners, one array of (rows, corners, axes); a way is the side to leave by, -1 for none


def _minus(a: Points, b: Points) -> Points:
    return [x - y for x, y in zip(a, b, strict=True)]


def _dot(a: Points, b: Points) -> np.ndarray:
    return reduce(lambda s, xy: s + xy[0] * xy[1], zip(a[1:], b[1:], strict=True), a[0] * b[0])


def _cross(a: Points, b: Points) -> Points:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _axes(p: np.ndarray) -> Points:
    return [p[..., a] for a in range(p.shape[-1])]


def numerators(v: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """Twice the area, or six times the volume, towards each side."""
    c, p = [_axes(v[:, i]) for i in range(v.shape[1])], _axes(p)
    if len(p) == 2:
        return [(c[j][0] - c[i][0]) * (p[1] - c[i][1]) - (c[j][1] - c[i][1]) * (p[0] - c[i][0]) for i, j in TRIANGLE_EDGES]
    return [-_dot(_cross(_minus(c[j], c[i]), _minus(c[k], c[i])), _minus(p, c[i])) for i, j, k in TET_FACES]


def holds(v: np.ndarray, p: np.ndarray, tol: float) -> np.ndarray:
    """Whether every coordinate is at least -tol; exact for whole numbers and tol 0. A coordinate that is not a number is no hit."""
    least = reduce(np.minimum, numerators(v, p))
    return least >= (0 if tol == 0 else -tol * numerators(v, v[:, -1])[0])


def by_coordinates(v, o, t, sides, last, tol):
    b = numerators(v, t)
    least = reduce(np.minimum, b)
    out = least < (0 if tol == 0 else -tol * numerators(v, v[:, -1])[0])
    if len(b) == 4:
        return np.where(out, np.argmin(np.stack(b), axis=0), -1), None, None
    first = b[0] < b[1]
    return np.where(out, np.where(np.where(first, b[0], b[1]) < b[2], np.where(first, 0, 1), 2), -1), None, None


def edge_crossings(v: np.ndarray, o: np.ndarray, t: np.ndarray, tol: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each edge: whether the segment leaves through it, and at which share of its length."""
    px, py, found = t[:, 0] - o[:, 0], t[:, 1] - o[:, 1], []
    for i, j in TRIANGLE_EDGES:
        ex, ey, gx, gy = v[:, j, 0] - v[:, i, 0], v[:, j, 1] - v[:, i, 1], v[:, i, 0] - o[:, 0], v[:, i, 1] - o[:, 1]
        det, s, u = px * ey - py * ex, gx * ey - gy * ex, gx * py - gy * px
        if tol == 0:
            hit = (det > 0) & (s >= 0) & (s <= det) & (u >= 0) & (u <= det)
        else:
            hit = (det >= tol) & (s >= -tol) & (s <= det + tol) & (u >= -tol) & (u <= det + tol)
        found.append((hit, s / np.where(det == 0, np.nan, det)))
    return found


def by_crossing_2d(v, o, t, sides, last, tol):
    li, share = np.full(len(v), -1), np.full(len(v), np.nan)
    for k, (hit, at) in enumerate(edge_crossings(v, o, t, tol)):
        take = hit & (sides[:, k] != last)
        li, share = np.where(take, k, li), np.where(take, at, share)
    return li, o + (t - o) * share[:, None], None


def _face_meetings(v: np.ndarray, o: np.ndarray, t: np.ndarray):
    """Of each face: normal times way, square of the normal, share of the way, the point's two coordinates, the point."""
    v, o, t = v.astype(np.float64), _axes(o.astype(np.float64)), _axes(t.astype(np.float64))
    d = _minus(t, o)
    for face in TET_FACES:
        a, b, c = (_axes(v[:, i]) for i in face)
        e, f, g = _minus(b, a), _minus(c, a), _minus(o, a)
        n = _cross(e, f)
        dproj, nn = _dot(n, d), _dot(n, n)
        nn = np.where(nn == 0, np.nan, nn)
        at = -_dot(n, g) / np.where(dproj == 0, np.nan, dproj)
        x = [p + q * at for p, q in zip(g, d, strict=True)]
        yield dproj, nn, at, _dot(_cross(x, f), n) / nn, _dot(_cross(e, x), n) / nn, np.stack([p + q for p, q in zip(a, x, strict=True)], axis=1)


def by_crossing_3d(v, o, t, sides, last, tol, bounded: bool = False):
    n = len(v)
    li, point = np.full(n, -1), np.full((n, 3), np.nan)
    near, miss, missed = np.full(n, np.inf), np.full(n, -1), np.full((n, 3), np.nan)
    for k, (dproj, _, at, u, w, x) in enumerate(_face_meetings(v, o, t)):
        fresh = sides[:, k] != last
        hit = fresh & (dproj >= tol) & (at >= -tol) & (u >= -tol) & (w >= -tol) & (u + w <= 1 + 2 * tol)
        if bounded:
            hit &= at <= 1 + tol
        li, point = np.where(hit, k, li), np.where(hit[:, None], x, point)
        if not bounded:
            by = np.maximum(np.maximum(0.0, -u), np.maximum(-w, u + w - 1))
            less = fresh & (dproj > -tol) & ~np.isnan(by) & ((by < near) | (miss < 0))
            near, miss, missed = np.where(less, by, near), np.where(less, k, miss), np.where(less[:, None], x, missed)
    if bounded:
        return li, point, None
    none = li < 0
    return np.where(none, miss, li), np.where(none[:, None], missed, point), None


def by_segment_3d(v, o, t, sides, last, tol):
    return by_crossing_3d(v, o, t, sides, last, tol, True)


def by_first_crossing_3d(v, o, t, sides, last, tol):
    n = len(v)
    out, met, most = ~holds(v, t, tol), np.full(n, -1), np.full(n, -1)
    point, points, along = np.full((n, 3), np.nan), np.full((n, 3), np.nan), np.full(n, np.nan)
    for k, (dproj, nn, at, u, w, x) in enumerate(_face_meetings(v, o, t)):
        p = dproj / np.sqrt(nn)
        rest = 1 - u - w
        within = (np.minimum(np.minimum(u, w), rest) >= -tol) & (np.maximum(np.maximum(u, w), rest) <= 1 + tol)
        hit = (met < 0) & (p > 0) & (at * p >= -tol) & ((1 - at) * p >= -tol) & within
        met, point = np.where(hit, k, met), np.where(hit[:, None], x, point)
        more = ~np.isnan(p) & (np.isnan(along) | (p > along))
        along, most, points = np.where(more, p, along), np.where(more, k, most), np.where(more[:, None], x, points)
    none = met < 0
    li = np.where(none, np.where(along >= 0, most, -1), met)
    return np.where(out, li, -1), np.where(none[:, None], points, point), out & none & (along < 0)


def way_of(dim: int, way: str) -> Callable:
    if way == COORDINATES:
        return by_coordinates
    if dim == 2:
        return by_crossing_2d
    return {CROSSING: by_crossing_3d, SEGMENT: by_segment_3d, FIRST: by_first_crossing_3d}[way]


# tiles


def matrix(rows: pa.Table, columns: list[str], missing: int | None = None) -> np.ndarray:
    """Columns side by side; whole numbers stay whole. A null is ``missing``, without that it is no number."""
    out = []
    for c in columns:
        cells = rows[c].combine_chunks()
        if missing is not None:
            cells = cells.fill_null(missing)
        out.append(cells.to_numpy(zero_copy_only=False))
    out = np.stack(out, axis=1)
    return out.astype(np.float64 if np.issubdtype(out.dtype, np.floating) else np.int64, copy=False)


class Tile:
    """One tile's elements by place, in order of eid."""

    def __init__(self, rows: pa.Table, dim: int):
        rows, k = rows.sort_by("m_eid"), range(dim + 1)
        self.dim, self.eid = dim, rows["m_eid"].to_numpy().astype(np.int64)
        self.corners = matrix(rows, [f"m_{a}{i}" for i in k for a in AXES[:dim]]).reshape(-1, dim + 1, dim)
        self.near, self.side, self.owner = (matrix(rows, [f"m_{c}{i}" for i in k], -1) for c in "nso")
        self.place = self.places(self.near)

    def places(self, eid: np.ndarray) -> np.ndarray:
        """Where the elements are, -1 for those that are not here."""
        if not len(self.eid):
            return np.full(eid.shape, -1)
        at = np.minimum(np.searchsorted(self.eid, eid), len(self.eid) - 1)
        return np.where(self.eid[at] == eid, at, -1)

    def check_range(self, *points: np.ndarray, ways: bool = True) -> None:
        """Products of whole coordinates that could leave 64 bits are an error, as in a Column. ways: ways are multiplied with each other."""
        whole = [p for p in (self.corners, *points) if not np.issubdtype(p.dtype, np.floating) and p.size]
        if len(whole) > 1:
            span = int(max(p.max() for p in whole)) - int(min(p.min() for p in whole))
            edge = int((self.corners.max(axis=1) - self.corners.min(axis=1)).max()) if self.dim == 3 or not ways else span
            if (2 if self.dim == 2 else 6 * edge) * edge * span >= 1 << 63:
                raise OverflowError("products of whole coordinates need more than 64 bits; give them as double")


class Rule:
    """How particles walk: way, tol, wall, the hops after which one that goes on is over, and short: stop where the target is nearer than the crossing."""

    def __init__(self, dim: int, way: str, wall: str, tol: float, limit: int, short: bool = False):
        self.dim, self.kind, self.wall, self.tol, self.limit, self.short, self.way = dim, way, wall, tol, limit, short, way_of(dim, way)

    def walk(self, tile: Tile, q: dict[str, np.ndarray]) -> np.ndarray:
        """Moves the particles q (arrays elem, o, t, last, face, p, hops, over; changed in place); the tile that each goes on to, -1 for none."""
        to = np.full(len(q["elem"]), -1, np.int64)
        for start in range(0, len(to), BLOCK):
            block = {k: x[start : start + BLOCK] for k, x in q.items()}
            self._walk(tile, block, to[start : start + BLOCK])
        return to

    def _walk(self, tile: Tile, q: dict[str, np.ndarray], to: np.ndarray) -> None:
        at = tile.places(q["elem"])
        active = np.flatnonzero(at >= 0)
        while len(active):
            here = at[active]
            o, t, sides = q["o"][active], q["t"][active], tile.side[here]
            li, point, leak = self.way(tile.corners[here], o, t, sides, q["last"][active], self.tol)
            if leak is not None and self.wall == REMOVE:
                q["elem"][active[leak]] = REMOVED
            goes = li >= 0
            active, here, li = active[goes], here[goes], li[goes]
            q["hops"][active] += 1
            if point is not None:
                q["p"][active] = point[goes]
            near, sid = tile.near[here, li], sides[goes, li]
            over, exposed = np.zeros(len(active), bool), near == REMOVED
            if self.short:
                o, t = _axes(o[goes]), _axes(t[goes])
                d = _minus(t, o)
                over = _dot(_minus(_axes(q["p"][active]), o), d) > _dot(d, d)
            wall = active[exposed & ~over]
            if self.wall != LEAVE:
                q["face"][wall] = sid[exposed & ~over]
            if self.wall != STOP:
                q["elem"][wall] = REMOVED
            go = ~exposed & ~over
            active, here, li = active[go], here[go], li[go]
            q["elem"][active], q["last"][active], at[active] = near[go], sid[go], tile.place[here, li]
            over = q["hops"][active] >= self.limit
            q["over"][active[over]] = True
            leaves = ~over & (at[active] < 0)
            to[active[leaves]] = tile.owner[here[leaves], li[leaves]]
            active = active[~over & ~leaves]


def _spread(c: Column, dim: int) -> Column:
    """The ten bits of c, dim places apart."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.shiftright(c, b).bitwiseAND(1), b * dim) for b in range(10)))


def tiles(walk: DataFrame, dim: int, elements_at_once: int | None = None) -> tuple[DataFrame | None, int]:
    """eid, tile (None where the mesh is one tile), and how many elements there are. Elements are numbered along a curve that
    interleaves the bits of their places, and as many as fit make up a tile."""
    at_once = elements_at_once or ELEMENTS_AT_ONCE
    middle = {a: sum((F.col(f"{a}{i}").cast("double") for i in range(1, dim + 1)), F.col(f"{a}0").cast("double")) for a in AXES[:dim]}
    at = walk.select("eid", *(m.alias(a) for a, m in middle.items()))
    box = at.agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{k}_{a}") for a in AXES[:dim] for k, f in (("min", F.min), ("max", F.max)))).first()
    if box["n"] <= at_once:
        return None, box["n"]
    cell = lambda a: F.least(F.lit(1023), F.floor((F.col(a) - box[f"min_{a}"]) / max(box[f"max_{a}"] - box[f"min_{a}"], 1e-300) * 1024)).cast("long")
    key = reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(_spread(cell(a), dim), k) for k, a in enumerate(AXES[:dim])))
    placed = numbered(at.select("eid", F.coalesce(key, F.lit(0)).cast("long").alias("_key")), ["_key", "eid"], "_number")
    return cut(placed.select("eid", F.expr(f"cast(_number div {at_once} as int)").alias("tile"))), box["n"]


class Tiles:
    """A mesh (its walk table, stored) in tiles: tile of an element, and for each tile the m_ columns that its tasks read."""

    def __init__(self, walk: DataFrame, dim: int, elements_at_once: int | None = None):
        self.of, self.elements = tiles(walk, dim, elements_at_once)
        k = range(dim + 1)
        self.at_once = max(PARTICLES_AT_ONCE, 2 * min(self.elements, elements_at_once or ELEMENTS_AT_ONCE))
        near = [F.col(c).alias(f"m_{c}") for c in ("eid", *(f"{a}{i}" for i in k for a in AXES[:dim]), *(f"{c}{i}" for c in "ns" for i in k))]
        if self.of is None:
            self.mesh = walk.select(F.lit(0).alias("m_tile"), *near, *(F.lit(None).cast("int").alias(f"m_o{i}") for i in k))
            self.of = walk.select("eid", F.lit(0).alias("tile"))
            return
        ends = walk.select("eid", F.posexplode(F.array(*(f"n{i}" for i in k))).alias("li", "n")).where("n is not null")
        ends = cut(ends.join(self.of.select(F.col("eid").alias("n"), "tile"), "n"))
        owners = ends.groupBy(F.col("eid").alias("m_eid")).agg(*(F.max(F.when(F.col("li") == i, F.col("tile"))).alias(f"m_o{i}") for i in k))
        held = self.of.unionByName(self._rim(ends)).select(F.col("eid").alias("m_eid"), F.col("tile").alias("m_tile"))
        self.mesh = cut(walk.select(*near).join(held, "m_eid").join(owners, "m_eid", "left"))

    def _rim(self, ends: DataFrame) -> DataFrame:
        """eid, tile: the elements within LAYERS sides of a tile that are not its own."""
        others = lambda df: df.join(self.of.withColumnRenamed("tile", "_own"), "eid").where(F.col("tile") != F.col("_own")).select("eid", "tile")
        rim = others(ends).distinct()
        for _ in range(LAYERS - 1):
            rim = cut(rim)
            grown = ends.select("eid", "n").join(small(rim.withColumnRenamed("eid", "n")), "n").select("eid", "tile")
            rim = rim.unionByName(others(grown)).distinct()
        return rim if LAYERS else rim.where("false")

    def meet(self, state: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, sizes: DataFrame) -> DataFrame:
        """run(tile, group) of each group of the particles (column tile) and its tile. sizes: tile, groups."""
        left = self.mesh.join(F.broadcast(sizes.withColumnsRenamed({"tile": "m_tile", "groups": "m_groups"})), "m_tile").withColumn("m_group", F.explode(F.sequence(F.lit(0), F.col("m_groups") - 1)))
        right = state.select(*(F.col(c).alias(f"q_{c}") for c in state.columns)).join(F.broadcast(sizes.withColumnsRenamed({"tile": "q_tile", "groups": "q_groups"})), "q_tile")
        right = right.withColumn("q_group", F.pmod(F.xxhash64("q_pid"), F.col("q_groups")).cast("int"))
        return left.groupBy("m_tile", "m_group").cogroup(right.groupBy("q_tile", "q_group")).applyInArrow(run, schema)

    def rounds(self, state: DataFrame, run, schema: T.StructType, max_rounds: int = 100_000) -> list[DataFrame]:
        """Rounds until no particle has a tile; what each leaves without one."""
        state, left = cut(state), []
        for _ in range(max_rounds):
            left.append(state.where("tile is null"))
            state = state.where("tile is not null")
            sizes = cut(state.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / self.at_once).cast("int").alias("groups")))
            if sizes.isEmpty():
                return left
            state = cut(self.meet(state, run, schema, sizes))
        raise ValueError(f"some particles have met {max_rounds} tiles and are still on their way")


def _column(values: np.ndarray) -> pa.Array:
    """An Arrow array; -1, or what is not a number, is null."""
    return pa.array(values, mask=np.isnan(values) if np.issubdtype(values.dtype, np.floating) else values == -1)


def _whole(rows: pa.Table, name: str) -> np.ndarray:
    return matrix(rows, [name], -1)[:, 0]


def _flags(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].to_numpy().astype(bool)


def _schema(state: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])


def _started(particles: DataFrame, mesh: Tiles, dim: int, still: float, *more: str) -> DataFrame:
    """pid, elem, coordinates and ``more`` with _tile (null where the mesh has no such element) and _moves: neither at rest, nor removed, nor without a place."""
    o, t = ([F.col(f"{p}{a}") for a in AXES[:dim]] for p in "ot")
    moved = sum(((x - y) * (x - y) for x, y in zip(t[1:], o[1:], strict=True)), (t[0] - o[0]) * (t[0] - o[0])) > still * still
    rows = particles.select("pid", F.col("elem_id").cast("long").alias("elem"), *o, *t, *more).withColumn("_moves", F.coalesce(moved & (F.col("elem") != REMOVED), F.lit(False)))
    return rows.join(small(mesh.of.withColumnsRenamed({"eid": "elem", "tile": "_tile"})), "elem", "left")


def trace_in_tiles(
    particles: DataFrame, walk: DataFrame, dim: int, way: str = COORDINATES, wall: str = LEAVE, *, tol: float = 1e-10, still: float = 0.0, looplimit: int = 0,
    remove_at_limit: bool = True, strict: bool = False, check_parents: bool = True, short: bool = False, elements_at_once: int | None = None,
) -> DataFrame:
    """The walk of walk.trace: pid, elem_id, hops, face, px, py[, pz]. walk: the walk table, stored."""
    mesh, axes, crossing, check = Tiles(walk, dim, elements_at_once), AXES[:dim], way != COORDINATES or wall != LEAVE, check_parents or strict
    rule = Rule(dim, way, wall, tol, looplimit or max(256, 2 * mesh.elements), short)
    ends, places = ("ot" if crossing or check else "t"), [f"p{a}" for a in axes]
    rows = _started(particles, mesh, dim, still)
    lost = (F.col("_moves") & F.col("_tile").isNull()) if check else F.lit(False)
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    state = rows.select(
        "pid", F.when(lost, F.lit(REMOVED)).otherwise(F.col("elem")).cast("long").alias("elem"), *(f"{p}{a}" for p in ends for a in axes), F.when(F.col("_moves"), F.col("_tile")).cast("int").alias("tile"),
        F.lit(0).alias("hops"), F.lit(False).alias("over"), lost.alias("lost"), *(nothing("long", "last", "face") + nothing("double", *places) if crossing else []),
    )
    schema = _schema(state)

    def run(elements: pa.Table, rows: pa.Table) -> pa.Table:
        tile, n = Tile(elements, dim), rows.num_rows
        q = {p: matrix(rows, [f"q_{p}{a}" for a in axes]) for p in ends} | {"elem": _whole(rows, "q_elem"), "hops": _whole(rows, "q_hops").astype(np.int32), "over": np.zeros(n, bool)}
        q.setdefault("o", q["t"])
        tile.check_range(q["o"], q["t"], ways=crossing)
        q |= {c: _whole(rows, f"q_{c}") if crossing else np.full(n, -1) for c in ("last", "face")}
        q["p"] = matrix(rows, [f"q_{p}" for p in places]).astype(np.float64) if crossing else np.empty((n, 0))
        lost = np.zeros(n, bool)
        if check:  # who has not moved yet and starts outside its element is removed; what is no number is not judged
            at = tile.places(q["elem"])
            judged = (q["hops"] == 0) & (at >= 0) & ~np.isnan(q["o"].sum(axis=1, dtype=np.float64))
            lost[judged] = ~holds(tile.corners[at[judged]], q["o"][judged], tol)
            q["elem"][lost] = REMOVED
        to = rule.walk(tile, q)
        columns = {f.name: rows[f"q_{f.name}"] for f in schema} | {"elem": pa.array(q["elem"]), "tile": _column(to.astype(np.int32)), "hops": pa.array(q["hops"]), "over": pa.array(q["over"]), "lost": pa.array(lost)}
        if crossing:
            columns |= {c: _column(q[c]) for c in ("last", "face")} | {p: _column(q["p"][:, k]) for k, p in enumerate(places)}
        return pa.table(columns)

    out = reduce(DataFrame.unionByName, mesh.rounds(state, run, schema))
    if strict and not out.where("lost").isEmpty():
        raise ValueError("some particles do not start in their parent element")
    if not looplimit and not out.where("over").isEmpty():
        raise ValueError(f"some particles are still on their way after {rule.limit} hops in a mesh of {mesh.elements} elements")
    elem = F.when(F.col("over"), F.lit(REMOVED)).otherwise(F.col("elem")) if remove_at_limit else F.col("elem")
    return out.select("pid", elem.cast("long").alias("elem_id"), "hops", *([F.col("face"), *places] if crossing else nothing("long", "face") + nothing("double", *places)))


def deposits_in_tiles(particles: DataFrame, walk: DataFrame, value: str, tol: float = 0.0, least: float = 0.0, elements_at_once: int | None = None) -> DataFrame:
    """elem_id and the sum of value over the ways through it (in a mesh of triangles), each weighted by the share of the way that lies there, of
    stretches longer than ``least``. As crossings.path_deposits of the log, which is never written: a task adds up within its tile."""
    mesh = Tiles(walk, 2, elements_at_once)
    limit = max(256, 2 * mesh.elements)
    # who is at rest has one stretch, the whole way; who is in no element of the mesh, or has no place, has none
    rows = _started(particles, mesh, 2, 0.0, F.col(value).cast("double").alias("value"))
    placed = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ("ox", "oy", "tx", "ty")), F.col("elem") != REMOVED)
    state = rows.select("pid", "elem", "ox", "oy", "tx", "ty", F.when(placed, F.col("_tile")).cast("int").alias("tile"), "value", F.lit(0.0).alias("at"), F.lit(None).cast("long").alias("last"), F.lit(0).alias("hops"), F.lit(False).alias("sums"))
    schema = _schema(state)

    def run(elements: pa.Table, rows: pa.Table) -> pa.Table:
        tile, n = Tile(elements, 2), rows.num_rows
        elem, last, hops = _whole(rows, "q_elem"), _whole(rows, "q_last"), _whole(rows, "q_hops")
        o, t = (matrix(rows, [f"q_{p}x", f"q_{p}y"]) for p in "ot")
        tile.check_range(o, t)
        share, worth = matrix(rows, ["q_at"])[:, 0].copy(), rows["q_value"].combine_chunks()
        counts = np.array(worth.is_valid().to_numpy(zero_copy_only=False), bool)
        worth = worth.fill_null(0.0).to_numpy(zero_copy_only=False)
        sums, met, counted = np.zeros(len(tile.eid)), np.zeros(len(tile.eid), bool), np.zeros(len(tile.eid), bool)
        to, at = np.full(n, -1, np.int32), tile.places(elem)
        for start in range(0, n, BLOCK):
            active = start + np.flatnonzero(at[start : start + BLOCK] >= 0)
            while len(active):
                here = at[active]
                sides = tile.side[here]
                li, way = np.full(len(active), -1), np.full(len(active), np.nan)
                for k, (hit, x) in enumerate(edge_crossings(tile.corners[here], o[active], t[active], tol)):
                    take = hit & (sides[:, k] != last[active])
                    li, way = np.where(take, k, li), np.where(take, x, way)
                leaves = li >= 0
                end = np.where(leaves, np.minimum(1.0, np.fmax(share[active], way)), 1.0)
                length = end - share[active]
                long = length > least
                sums += np.bincount(here[long], worth[active[long]] * length[long], len(sums))
                met[here[long]] = True
                counted[here[long & counts[active]]] = True
                share[active] = end
                active, here, li, sides = active[leaves], here[leaves], li[leaves], sides[leaves]
                last[active], near, hops[active] = sides[np.arange(len(li)), li], tile.near[here, li], hops[active] + 1
                go = near != REMOVED
                active, here, li = active[go], here[go], li[go]
                elem[active], at[active] = near[go], tile.place[here, li]
                if len(active) and hops[active].max() >= limit:
                    raise ValueError(f"some ways are not over after {limit} sides in a mesh of {mesh_elements} elements")
                out = at[active] < 0
                to[active[out]] = tile.owner[here[out], li[out]]
                active = active[~out]
        going, some = np.flatnonzero(to >= 0), np.flatnonzero(met)
        moved = {"elem": elem, "tile": to, "at": share, "last": last, "hops": hops.astype(np.int32), "sums": np.zeros(n, bool)}
        left = pa.table({f.name: _column(moved[f.name][going]) if f.name == "last" else pa.array(moved[f.name][going]) if f.name in moved else rows[f"q_{f.name}"].take(pa.array(going)) for f in schema})
        added = {"elem": pa.array(tile.eid[some]), "value": pa.array(sums[some], mask=~counted[some]), "at": pa.array(np.zeros(len(some))), "hops": pa.array(np.zeros(len(some), np.int32)), "sums": pa.array(np.ones(len(some), bool))}
        return pa.concat_tables([left, pa.table({f.name: added.get(f.name, pa.nulls(len(some), left.schema.field(f.name).type)) for f in schema})])

    mesh_elements = mesh.elements
    out = reduce(DataFrame.unionByName, mesh.rounds(state, run, schema))
    return out.where("sums").groupBy(F.col("elem").alias("elem_id")).agg(F.sum("value").alias(value))
