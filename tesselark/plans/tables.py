"""Meshes and particles of the named queries, derived from the test tables by whole-number arithmetic, and the same in SQL.

The lattices grow with ``events``: about a hundred events a quad of triangles, three hundred a cube of tetrahedra. An element's class is the number of events in
its quad modulo CLASSES, and ranks own stripes of quads that hold about equally many events.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselark.operators.mesh import Mesh, tet_lattice, tri_lattice
from tesselark.storage import running_sum

LENGTH, TET_LENGTH, RANKS, CLASSES = 1_000_000, 900_000, 4, 5
#: Quads along a side: divisors of LENGTH whose fivefold divides it too; cubes along a side: divisors of TET_LENGTH. The largest that the events fill.
QUADS = (10, 16, 20, 25, 32, 40, 50, 64, 80, 100, 125, 160, 200, 250, 320, 400, 500, 625, 800, 1000, 2000, 2500, 4000)
CUBES = (3, 4, 5, 6, 8, 9, 10, 12, 15, 16, 18, 20, 24, 25, 30, 36, 40, 45, 50, 60, 72, 75, 80, 90, 100)
PER_QUAD, PER_CUBE, LARGE = 97, 300, 5


def size(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """n quads of width h along a side of the plate, n3 cubes of width h3 along a side of the block, and how many events there are."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    n = max((x for x in QUADS if x * x * PER_QUAD <= events), default=QUADS[0])
    n3 = max((x for x in CUBES if x**3 * PER_CUBE <= events), default=CUBES[0])
    return SimpleNamespace(n=n, h=LENGTH // n, n3=n3, h3=TET_LENGTH // n3, events=events, elements=2 * n * n)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("*", ((F.col("event_id") * 7919 + F.col("user_id") * 104729) % LENGTH).alias("ox"), ((F.col("event_id") * 15485863 + F.col("user_id") * 32452843) % LENGTH).alias("oy"))


def mesh(spark: SparkSession, sf_dir: str, n: int | None = None) -> Mesh:
    """The plate; an element's class comes from the events in its quad."""
    n = n or size(spark, sf_dir).n
    m, h = tri_lattice(spark, n, LENGTH), LENGTH // n
    quad = F.expr("eid div 2")
    load = _places(spark, sf_dir).groupBy(F.expr(f"(ox div {h}) * {n} + oy div {h}").alias("_quad")).agg((F.count(F.lit(1)) % CLASSES).cast("int").alias("_class"))
    elem = m.elem.drop("class_id").join(load, quad == F.col("_quad"), "left").select("eid", *m.verts, F.coalesce("_class", F.lit(0)).alias("class_id"))
    return Mesh(2, m.vertex, elem)


def tets(spark: SparkSession, sf_dir: str) -> Mesh:
    return tet_lattice(spark, size(spark, sf_dir).n3, TET_LENGTH)


def particles(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """pid, elem_id, ox, oy, tx, ty, species, step, val: each event in the element that contains it."""
    n = n or size(spark, sf_dir).n
    c = F.round(F.col("value") * 100).cast("long")
    p = _places(spark, sf_dir).select(F.col("event_id").alias("pid"), "ox", "oy", c.alias("val"), F.col("event_type").alias("species"), F.dayofmonth("ts").alias("step"))
    h = LENGTH // n
    elem = F.expr(f"2 * ((ox div {h}) * {n} + (oy div {h})) + CASE WHEN oy % {h} > ox % {h} THEN 1 ELSE 0 END")
    moved = [(F.col(f"o{a}") + (F.col("val") * k) % 400001 - 200000).alias(f"t{a}") for a, k in (("x", 37), ("y", 101))]
    return p.select("pid", elem.cast("long").alias("elem_id"), "ox", "oy", *moved, "species", "step", "val")


def stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, owner: columns of quads, dealt to ranks by the events before them. One row a column."""
    at = size(spark, sf_dir)
    load = _places(spark, sf_dir).groupBy(F.expr(f"ox div {at.h}").alias("i")).agg(F.count(F.lit(1)).alias("c"))
    load = spark.range(at.n).select(F.col("id").alias("i")).join(load, "i", "left").select("i", F.coalesce("c", F.lit(0)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return load.select("i", before.alias("before")).select("i", F.least(F.lit(RANKS - 1), F.expr(f"before * {RANKS} div {max(at.events, 1)}")).cast("int").alias("owner"))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, owner."""
    n = size(spark, sf_dir).n
    return tri_lattice(spark, n, LENGTH).elem.select("eid", F.expr(f"eid div 2 div {n}").alias("i")).join(F.broadcast(stripes(spark, sf_dir)), "i").select("eid", "owner")


def weighted_owners(spark: SparkSession, sf_dir: str, n_ranks: int) -> DataFrame:
    """eid, owner: runs of elements with about equally many events for each of n_ranks."""
    load = particles(spark, sf_dir).groupBy(F.col("elem_id").alias("eid")).agg(F.count(F.lit(1)).alias("n"))
    at = size(spark, sf_dir)
    load = spark.range(at.elements).select(F.col("id").alias("eid")).join(load, "eid", "left").select("eid", F.coalesce("n", F.lit(0)).alias("n"))
    return running_sum(load, ["eid"], "n", "before").select("eid", F.least(F.lit(n_ranks - 1), F.expr(f"before * {n_ranks} div {max(at.events, 1)}")).cast("int").alias("owner"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """particles with the rank that owns their element, and new_elem (wanted element by the lattice, -1 outside)."""
    at, p = size(spark, sf_dir), particles(spark, sf_dir)
    inside = F.col("tx").between(0, LENGTH - 1) & F.col("ty").between(0, LENGTH - 1)
    new = F.expr(f"2 * ((tx div {at.h}) * {at.n} + (ty div {at.h})) + CASE WHEN ty % {at.h} > tx % {at.h} THEN 1 ELSE 0 END")
    own = F.broadcast(stripes(spark, sf_dir).withColumnsRenamed({"i": "_i", "owner": "rank"}))
    return p.join(own, F.expr(f"elem_id div 2 div {at.n}") == F.col("_i")).select(*p.columns, "rank", F.when(inside, new).otherwise(-1).cast("long").alias("new_elem"))


# the same as SQL; each string is a list of common table expressions


class Term(str):
    """A number that SQL computes: arithmetic gives further SQL."""

    def __add__(self, other):
        return Term(f"({self:s} + {other})")

    def __sub__(self, other):
        return Term(f"({self:s} - {other})")

    def __mul__(self, other):
        return Term(f"({self:s} * {other})")

    def __rmul__(self, other):
        return Term(f"({other} * {self:s})")

    def __truediv__(self, other):
        return Term(f"({self:s} / {other})")

    def __floordiv__(self, other):
        return Term(f"({self:s} // {other})")

    def __rfloordiv__(self, other):
        return Term(f"({other} // {self:s})")

    def __pow__(self, k: int):
        return Term("(" + " * ".join([f"{self:s}"] * k) + ")")


N, H, TET_N, H3 = (Term(f"(SELECT {c} FROM dims)") for c in ("n", "h", "n3", "h3"))
EVENTS = Term("(SELECT count(*) FROM events)")
#: The events' places on the plate.
PLACES = f"(SELECT (event_id * 7919 + user_id * 104729) % {LENGTH} AS ox, (event_id * 15485863 + user_id * 32452843) % {LENGTH} AS oy FROM events)"
_largest = lambda known, power, per: f"(SELECT coalesce(max(x), {known[0]}) FROM (VALUES {', '.join(f'({x})' for x in known)}) t(x) WHERE x ** {power} * {per} <= {EVENTS})"
DIMS = f"dims AS (SELECT n, {LENGTH} // n AS h, n3, {TET_LENGTH} // n3 AS h3 FROM (SELECT {_largest(QUADS, 2, PER_QUAD)} AS n, {_largest(CUBES, 3, PER_CUBE)} AS n3))"
COLS = f"""cols AS (SELECT i, CAST(least({RANKS - 1}, coalesce(sum(c) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {RANKS} // greatest({EVENTS}, 1)) AS INTEGER) AS owner
      FROM (SELECT x.i, coalesce(c, 0) AS c FROM range({N}) x(i) LEFT JOIN (SELECT ox // {H} AS i, count(*) AS c FROM {PLACES} GROUP BY 1) y ON y.i = x.i))"""


def whole_sql(sql: str) -> str:
    """sql with the sizes and stripes that it reads put before its own expressions."""
    first = [DIMS] * ("dims" in sql or "cols" in sql) + [COLS] * ("cols" in sql)
    if not first or "dims AS" in sql:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().startswith(start):
            return start + ", ".join(first) + ", " + sql.lstrip()[len(start) :]
    return f"WITH {', '.join(first)} {sql}"


def sql_of(n: Term) -> SimpleNamespace:
    """Vertices V, elements E, their vertices EV, sides HALF, SIDE and ES, geometry G, particles P, owners O and wanted elements R of the n x n mesh."""
    h = LENGTH // n
    V = f"""v AS (SELECT i * {n + 1} + j AS vid, i * {h} AS x, j * {h} AS y, i, j,
      CAST(least(i, j, {n} - i, {n} - j) AS INTEGER) AS class_id, CAST(2 - CAST(i % {n} = 0 AS INTEGER) - CAST(j % {n} = 0 AS INTEGER) AS TINYINT) AS class_dim
      FROM range({n + 1}) a(i), range({n + 1}) b(j))"""
    E = f"""e AS (SELECT 2 * (i * {n} + j) + k AS eid, i, j, k, i * {n + 1} + j AS v0,
      CASE WHEN k = 0 THEN (i + 1) * {n + 1} + j ELSE (i + 1) * {n + 1} + j + 1 END AS v1, CASE WHEN k = 0 THEN (i + 1) * {n + 1} + j + 1 ELSE i * {n + 1} + j + 1 END AS v2,
      CAST(coalesce(c, 0) % {CLASSES} AS INTEGER) AS class_id FROM (SELECT i, j, k FROM range({n}) a(i), range({n}) b(j), range(2) r(k))
      LEFT JOIN (SELECT ox // {h} AS i, oy // {h} AS j, count(*) AS c FROM {PLACES} GROUP BY 1, 2) USING (i, j))"""
    EV = "ev AS (SELECT eid, 0 AS li, v0 AS vid FROM e UNION ALL SELECT eid, 1, v1 FROM e UNION ALL SELECT eid, 2, v2 FROM e)"
    HALF = """half AS (SELECT eid, li, least(a, b) AS k0, greatest(a, b) AS k1, a > b AS flip FROM (
      SELECT eid, 0 AS li, v0 AS a, v1 AS b FROM e UNION ALL SELECT eid, 1, v1, v2 FROM e UNION ALL SELECT eid, 2, v2, v0 FROM e))"""
    SIDE = "side AS (SELECT row_number() OVER (ORDER BY k0, k1) - 1 AS sid, k0, k1, count(*) AS n, min(eid) AS e0, max(eid) AS e1 FROM half GROUP BY k0, k1)"
    ES = "es AS (SELECT h.eid, h.li, s.sid, h.flip, CASE WHEN s.n = 2 THEN s.e0 + s.e1 - h.eid END AS nbr FROM half h JOIN side s ON h.k0 = s.k0 AND h.k1 = s.k1)"
    G = """g AS (SELECT e.eid, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2, s0.nbr AS n0, s1.nbr AS n1, s2.nbr AS n2
      FROM e JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v c ON c.vid = v2 JOIN es s0 ON s0.eid = e.eid AND s0.li = 0 JOIN es s1 ON s1.eid = e.eid AND s1.li = 1 JOIN es s2 ON s2.eid = e.eid AND s2.li = 2)"""
    P = f"""p AS (SELECT pid, 2 * ((ox // {h}) * {n} + (oy // {h})) + CASE WHEN oy % {h} > ox % {h} THEN 1 ELSE 0 END AS elem_id, ox, oy,
      ox + (val * 37) % 400001 - 200000 AS tx, oy + (val * 101) % 400001 - 200000 AS ty, species, step, val FROM (
      SELECT event_id AS pid, (event_id * 7919 + user_id * 104729) % {LENGTH} AS ox, (event_id * 15485863 + user_id * 32452843) % {LENGTH} AS oy,
        CAST(round(value * 100) AS BIGINT) AS val, event_type AS species, CAST(day(ts) AS INTEGER) AS step FROM events))"""
    O = "o AS (SELECT eid, owner FROM e JOIN cols USING (i))"
    R = f"""r AS (SELECT p.*, cols.owner AS rank, CASE WHEN tx BETWEEN 0 AND {LENGTH - 1} AND ty BETWEEN 0 AND {LENGTH - 1}
      THEN 2 * ((tx // {h}) * {n} + (ty // {h})) + CASE WHEN ty % {h} > tx % {h} THEN 1 ELSE 0 END ELSE -1 END AS new_elem FROM p JOIN cols ON cols.i = elem_id // 2 // {n})"""
    return SimpleNamespace(V=V, E=E, EV=EV, HALF=HALF, SIDE=SIDE, ES=ES, G=G, P=P, O=O, R=R)


SQL = sql_of(N)
V, E, EV, HALF, SIDE, ES, G, P, O, R = (getattr(SQL, k) for k in ("V", "E", "EV", "HALF", "SIDE", "ES", "G", "P", "O", "R"))


def weighted_sql(n_ranks: int) -> str:
    """o: owners as weighted_owners(), from e and p."""
    return f"""o AS (SELECT eid, CAST(least({n_ranks - 1}, coalesce(sum(n) OVER (ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {n_ranks} // greatest({EVENTS}, 1)) AS INTEGER) AS owner
      FROM (SELECT eid, count(pid) AS n FROM e LEFT JOIN p ON p.elem_id = e.eid GROUP BY eid))"""


def halo_sql(layers: int) -> str:
    """l0.. : (rank, eid) within 0, 1, .. layers of a rank's own elements."""
    out = ["l0 AS (SELECT owner AS rank, eid FROM o)"]
    for k in range(1, layers + 1):
        out.append(f"l{k} AS (SELECT DISTINCT l.rank, y.eid FROM l{k - 1} l JOIN ev x ON x.eid = l.eid JOIN ev y ON y.vid = x.vid)")
    return ", ".join(out)


def walk_sql() -> str:
    """last: pid, elem_id, hops of the exact walk."""
    b = ["(x1 - x0) * (ty - y0) - (y1 - y0) * (tx - x0)", "(x2 - x1) * (ty - y1) - (y2 - y1) * (tx - x1)", "(x0 - x2) * (ty - y2) - (y0 - y2) * (tx - x2)"]
    return f"""hop(pid, elem_id, tx, ty, hops, moves) AS (
      SELECT pid, elem_id, tx, ty, 0, true FROM p
      UNION ALL
      SELECT pid, CASE WHEN least(b0, b1, b2) >= 0 THEN elem_id ELSE coalesce(CASE WHEN (CASE WHEN b0 < b1 THEN b0 ELSE b1 END) < b2 THEN (CASE WHEN b0 < b1 THEN n0 ELSE n1 END) ELSE n2 END, -1) END,
        tx, ty, hops + CASE WHEN least(b0, b1, b2) >= 0 THEN 0 ELSE 1 END, least(b0, b1, b2) < 0
      FROM (SELECT h.*, g.n0, g.n1, g.n2, {b[0]} AS b0, {b[1]} AS b1, {b[2]} AS b2 FROM hop h JOIN g ON h.elem_id = g.eid WHERE h.moves)
    ), last AS (SELECT pid, arg_max(elem_id, hops * 2 + CASE WHEN moves THEN 0 ELSE 1 END) AS elem_id, CAST(max(hops) AS INTEGER) AS hops FROM hop GROUP BY pid)"""
