"""Queries of sources and sinks: what is written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.operators import mesh as M, particles as PT
from tesselark.plans import tables as T
from tesselark.plans.catalogue import HALO2, TET_SQL, _parts, query
from tesselark.plans.tables import CLASSES, E, ES, EVENTS, G, H, H3, HALF, N, O, P, RANKS, SIDE, V
from tesselark.sources import picparts, text
from tesselark.storage import checkpoint_dir, cut


def _path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tesselark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


PTL = f"WITH {P} SELECT pid, elem_id, CAST(ox AS DOUBLE) AS x, CAST(oy AS DOUBLE) AS y, CAST(0.5 AS DOUBLE) AS z, CAST(val % 7 AS SMALLINT) AS flag, CAST(val AS INTEGER) AS val FROM p"


def _written_particles(spark: SparkSession, d: str) -> str:
    p = T.particles(spark, d).select("pid", "elem_id", F.col("ox").cast("double").alias("x"), F.col("oy").cast("double").alias("y"), F.lit(0.5).alias("z"), (F.col("val") % 7).cast("short").alias("flag"), F.col("val").cast("int").alias("val"))
    elements = PT.particle_lists(p, T.mesh(spark, d).elem).select("elem_id", (F.col("elem_id") + 1000).alias("gid"), "n")
    path = _path(spark, "particles.ptl")
    text.write_particles(elements, p, path)
    return path


@query("source_particles", PTL)
def _(spark: SparkSession, d: str) -> DataFrame:
    return text.read_particles(spark, _written_particles(spark, d))[1]


@query("source_particle_elements", f"WITH {E}, {P} SELECT eid AS elem_id, eid + 1000 AS gid, count(pid) AS n FROM e LEFT JOIN p ON eid = elem_id GROUP BY eid")
def _(spark, d):
    return text.read_particles(spark, _written_particles(spark, d))[0]


@query("source_particle_generator", f"SELECT i AS elem_id, i AS gid, CAST({EVENTS} // {2 * N * N} + CASE WHEN i < {EVENTS} % {2 * N * N} THEN 1 ELSE 0 END AS BIGINT) AS n FROM range({2 * N * N}) x(i)")
def _(spark, d):
    at = T.size(spark, d)
    path = text.generate_particles(spark, at.elements, at.events, 0, _path(spark, "generated"), rank=3)
    return text.read_particles(spark, path)[0]


@query("source_element_partition", f"WITH {E}, {O} SELECT eid, owner FROM o")
def _(spark, d):
    path = _path(spark, "owners.ptn")
    text.write_element_partition(T.owners(spark, d), path)
    return text.read_partition(spark, path, RANKS, T.mesh(spark, d).elem)


@query("source_class_partition", f"WITH {E} SELECT eid, CAST(class_id % 3 AS INTEGER) AS owner FROM e")
def _(spark, d):
    path = _path(spark, "classes.cpn")
    text.write_class_partition(spark, {c: c % 3 for c in range(CLASSES)}, path)
    return text.read_partition(spark, path, RANKS, T.mesh(spark, d).elem)


@query("source_partition_of_one_rank", f"WITH {E} SELECT eid, 0 AS owner FROM e")
def _(spark, d):
    return text.read_partition(spark, "no such file.xyz", 1, T.mesh(spark, d).elem)


def _gmsh(spark: SparkSession, mesh: M.Mesh, kind: int, path: str) -> None:
    n, m = mesh.vertex.count(), mesh.elem.count()
    coords = [F.col(a).cast("double").cast("string") for a in mesh.axes] + [F.lit("0")] * (3 - mesh.dim)
    head = [(0, "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n" + str(n)), (2, f"$EndNodes\n$Elements\n{m}"), (4, "$EndElements")]
    lines = spark.createDataFrame([(p, 0, v) for p, v in head], "part int, at long, value string")
    lines = lines.unionByName(mesh.vertex.select(F.lit(1).alias("part"), F.col("vid").alias("at"), F.concat_ws(" ", F.col("vid").cast("string"), *coords).alias("value")))
    own = F.concat_ws(" ", F.col("eid").cast("string"), F.lit(str(kind)), F.lit("2"), F.col("class_id").cast("string"), F.lit("0"), *(F.col(v).cast("string") for v in mesh.verts))
    text.write_lines(lines.unionByName(mesh.elem.select(F.lit(3).alias("part"), F.col("eid").alias("at"), own.alias("value"))), ["part", "at"], path)


def _gmsh4(spark: SparkSession, mesh: M.Mesh, kind: int, path: str, tag) -> None:
    """The mesh as Gmsh 4.1 blocks: nodes and elements of each class are a block of their own. tag gives the node tag of a vertex number."""
    coords = [F.col(a).cast("double").cast("string") for a in mesh.axes] + [F.lit("0")] * (3 - mesh.dim)
    lines = [(0, 0, 0, 0, "$MeshFormat\n4.1 0 8\n$EndMeshFormat\n$Nodes"), (2, 0, 0, 0, "$EndNodes\n$Elements"), (4, 0, 0, 0, "$EndElements")]
    out = spark.createDataFrame(lines, "part int, block int, sub int, at long, value string")
    number = lambda c: tag(F.col(c)).cast("string")
    for part, rows, key, types, body in (
        (1, mesh.vertex, "vid", "0", [(1, number("vid")), (2, F.concat_ws(" ", *coords))]), (3, mesh.elem, "eid", str(kind), [(1, F.concat_ws(" ", F.col("eid").cast("string"), *map(number, mesh.verts)))]),
    ):
        blocks = cut(rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")))
        total = blocks.agg(F.count(F.lit(1)).alias("b"), F.sum("n").alias("n"))
        out = out.unionByName(total.select(F.lit(part).alias("part"), F.lit(-1).alias("block"), F.lit(0).alias("sub"), F.lit(0).cast("long").alias("at"), F.concat_ws(" ", F.col("b").cast("string"), F.col("n").cast("string"), F.lit("1"), F.col("n").cast("string")).alias("value")))
        head = F.concat_ws(" ", F.lit(str(mesh.dim)), F.col("class_id").cast("string"), F.lit(types), F.col("n").cast("string"))
        out = out.unionByName(blocks.select(F.lit(part).alias("part"), F.col("class_id").alias("block"), F.lit(0).alias("sub"), F.lit(0).cast("long").alias("at"), head.alias("value")))
        for sub, value in body:
            out = out.unionByName(rows.select(F.lit(part).alias("part"), F.col("class_id").alias("block"), F.lit(sub).alias("sub"), F.col(key).alias("at"), value.alias("value")))
    text.write_lines(out, ["part", "block", "sub", "at"], path)


@query("source_gmsh4_triangles", f"WITH {E} SELECT row_number() OVER (ORDER BY class_id, eid) - 1 AS eid, v0 * 3 + 7 AS v0, v1 * 3 + 7 AS v1, v2 * 3 + 7 AS v2, class_id FROM e")
def _(spark, d):
    """Gmsh 4.1 with a block for each class of the events and gaps between the node tags."""
    path = _path(spark, "plate4.msh")
    _gmsh4(spark, T.mesh(spark, d), 2, path, lambda vid: vid * 3 + 7)
    return text.read_mesh(spark, path).elem


@query("source_gmsh_triangles", f"WITH {E} SELECT eid, v0, v1, v2, class_id FROM e")
def _(spark, d):
    path = _path(spark, "plate.msh")
    _gmsh(spark, T.mesh(spark, d), 2, path)
    return text.read_mesh(spark, path).elem


@query("source_gmsh_tetrahedra", f"WITH {TET_SQL} SELECT eid, v0, v1, v2, v3, 1 AS class_id FROM e")
def _(spark, d):
    path = _path(spark, "cube.msh")
    _gmsh(spark, T.tets(spark, d), 4, path)
    return text.read_mesh(spark, path).elem


@query("source_gmsh_vertices", f"SELECT i * {(T.TET_N + 1) ** 2} + j * {T.TET_N + 1} + k AS vid, CAST(i * {H3} AS DOUBLE) AS x, CAST(j * {H3} AS DOUBLE) AS y, CAST(k * {H3} AS DOUBLE) AS z FROM range({T.TET_N + 1}) a(i), range({T.TET_N + 1}) b(j), range({T.TET_N + 1}) c(k)")
def _(spark, d):
    path = _path(spark, "cube.msh")
    _gmsh(spark, T.tets(spark, d), 4, path)
    return text.read_mesh(spark, path).vertex.select("vid", "x", "y", "z")


@query("source_picparts", f"""WITH {HALO2}, b AS (SELECT DISTINCT l2.rank, owner FROM l2 JOIN o USING (eid))
  SELECT b.rank, o.eid, o.owner = b.rank AS is_core, EXISTS (SELECT 1 FROM l1 WHERE l1.rank = b.rank AND l1.eid = o.eid) AS is_safe FROM b JOIN o ON o.owner = b.owner""")
def _(spark, d):
    path = _path(spark, "parts")
    picparts.write_picparts(_parts(spark, d), path)
    return picparts.read_picparts(spark, path, RANKS).halo


@query("source_picpart_of_a_rank", f"""WITH {HALO2}, b AS (SELECT DISTINCT owner FROM l2 JOIN o USING (eid) WHERE l2.rank = 2) SELECT o.eid, o.owner = 2 AS is_core FROM b JOIN o ON o.owner = b.owner""")
def _(spark, d):
    path = _path(spark, "parts")
    picparts.write_picparts(_parts(spark, d), path)
    return picparts.rank_halo(spark, path, RANKS, 2).select("eid", "is_core")


@query("source_mesh_check", f"WITH {V}, {E} SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS elements, CAST(2 AS INTEGER) AS dim")
def _(spark, d):
    path = _path(spark, "plate")
    picparts.write_mesh_tables(T.mesh(spark, d), path)
    m = text.read_mesh(spark, path)
    return m.vertex.agg(F.count(F.lit(1)).alias("vertices")).crossJoin(m.elem.agg(F.count(F.lit(1)).alias("elements"))).withColumn("dim", F.lit(m.dim))


@query("sink_vtk", f"""WITH {V}, {E} SELECT line FROM (SELECT CAST(CAST(x AS DOUBLE) AS VARCHAR) || ' ' || CAST(CAST(y AS DOUBLE) AS VARCHAR) || ' 0.0' AS line FROM v
  UNION ALL SELECT '3 ' || v0 || ' ' || v1 || ' ' || v2 FROM e UNION ALL SELECT '5' FROM e UNION ALL SELECT CAST(CAST(class_id AS DOUBLE) AS VARCHAR) FROM e
  UNION ALL SELECT unnest(['# vtk DataFile Version 3.0', 'mesh', 'ASCII', 'DATASET UNSTRUCTURED_GRID', 'POINTS ' || {(N + 1) ** 2} || ' double', 'CELLS ' || {2 * N * N} || ' ' || {8 * N * N}, 'CELL_TYPES ' || {2 * N * N}, 'CELL_DATA ' || {2 * N * N}, 'SCALARS class_id double 1', 'LOOKUP_TABLE default']))""")
def _(spark, d):
    path = _path(spark, "plate.vtk")
    text.write_vtk(T.mesh(spark, d), path, ["class_id"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("stream_deposits", f"WITH {P} SELECT elem_id, count(*) AS n FROM p GROUP BY elem_id")
def _(spark, d):
    """Particles arrive as a stream of files; each micro-batch is rebuilt and appended once."""
    from tesselark.streaming import steps

    source, out, state = (_path(spark, x) for x in ("source", "out", "state"))
    p = cut(T.particles(spark, d).select("pid", "elem_id"))
    for k in range(3):
        p.where(F.col("pid") % 3 == k).write.mode("append").parquet(source)
    stream = steps.particle_stream(spark, source, "pid long, elem_id long")
    steps.stream_steps(stream, lambda batch, number: PT.rebuild(batch.withColumn("new_elem", F.col("elem_id"))), out, state).awaitTermination()
    return PT.per_element(spark.read.parquet(out))


#: Each user is a particle and each of its events the next position, at most 2 mm from a place on the plate; phase turns by the value.
TRACK = f"""t AS (SELECT user_id AS pid, event_id AS step, ox + (val * 37) % 4001 - 2000 AS x, oy + (val * 101) % 4001 - 2000 AS y, val % 90 AS turn
    FROM (SELECT *, (event_id * 7919 + user_id * 104729) % {T.LENGTH} AS ox, (event_id * 15485863 + user_id * 32452843) % {T.LENGTH} AS oy, CAST(round(value * 100) AS BIGINT) AS val FROM events))"""
TRACKED = f"""WITH {V}, {E}, {HALF}, {SIDE}, {ES}, {G}, {TRACK},
  near AS (SELECT DISTINCT pid, step, x, y, turn, g.* FROM t, range(2) a(p), range(2) b(q), range(2) c(k), g
    WHERE g.eid = 2 * ((x // {H} - p) * {N} + (y // {H} - q)) + k AND x BETWEEN 0 AND {T.LENGTH} AND y BETWEEN 0 AND {T.LENGTH} AND x // {H} - p BETWEEN 0 AND {N} - 1 AND y // {H} - q BETWEEN 0 AND {N} - 1),
  hit AS (SELECT * FROM near WHERE least((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0), (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1), (x0 - x2) * (y - y2) - (y0 - y2) * (x - x2)) >= 0
    QUALIFY row_number() OVER (PARTITION BY step ORDER BY eid) = 1),
  way AS (SELECT t.pid, t.step, t.x, t.y, t.turn, h.* EXCLUDE (pid, step, x, y, turn), max(h.eid IS NULL) OVER w AS gone, lag(h.eid) OVER w AS was, lag(t.x) OVER w AS px, lag(t.y) OVER w AS py
    FROM t LEFT JOIN hit h ON h.step = t.step WINDOW w AS (PARTITION BY t.pid ORDER BY t.step)),
  f AS (SELECT *, NOT gone AND was IS NOT NULL AND was <> eid AS moved,
    (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0) AS a0, (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) AS a1, (x0 - x2) * (py - y2) - (y0 - y2) * (px - x2) AS a2,
    (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) AS b0, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) AS b1, (x0 - x2) * (y - y2) - (y0 - y2) * (x - x2) AS b2 FROM way),
  c AS (SELECT *, CASE WHEN moved AND a0 < 0 THEN a0 / (a0 - b0) ELSE -1 END AS c0, CASE WHEN moved AND a1 < 0 THEN a1 / (a1 - b1) ELSE -1 END AS c1, CASE WHEN moved AND a2 < 0 THEN a2 / (a2 - b2) ELSE -1 END AS c2 FROM f),
  m AS (SELECT *, greatest(c0, c1, c2) AS share, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS li FROM c),
  n AS (SELECT m.*, CASE WHEN share >= 0 THEN es.sid END AS via, CASE WHEN share >= 0 THEN px + (x - px) * share END AS vx, CASE WHEN share >= 0 THEN py + (y - py) * share END AS vy FROM m LEFT JOIN es ON es.eid = m.eid AND es.li = m.li)
  SELECT pid, step, CASE WHEN gone THEN -1 ELSE eid END AS elem_id, CAST(sum(turn) OVER w % 360 AS BIGINT) AS phase, CAST(sum(CAST(moved AS INTEGER)) OVER w AS BIGINT) AS moves,
    last_value(via IGNORE NULLS) OVER w AS side, round(last_value(vx IGNORE NULLS) OVER w, 2) AS cx, round(last_value(vy IGNORE NULLS) OVER w, 2) AS cy, false AS late
  FROM n WINDOW w AS (PARTITION BY pid ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def tracked_rows(spark: SparkSession, d: str) -> DataFrame:
    p = T._places(spark, d).withColumn("val", F.round(F.col("value") * 100).cast("long"))
    place = [(F.col(f"o{a}") + (F.col("val") * k) % 4001 - 2000).alias(a) for a, k in (("x", 37), ("y", 101))]
    return p.select(F.col("user_id").alias("pid"), F.col("event_id").alias("step"), *place, (F.col("val") % 90).alias("turn"))


def _rounded(out: DataFrame) -> DataFrame:
    return out.withColumns({c: F.round(c, 2) for c in ("cx", "cy")})


@query("stream_particle_state", TRACKED)
def _(spark, d):
    """The events come in three parts; the stream is restarted for each, and its keyed state goes on from the checkpoint."""
    from tesselark.streaming.tracking import track_files

    out, state, source = (_path(spark, x) for x in ("out", "state", "source"))
    rows, third = tracked_rows(spark, d), max(1, -(-T.size(spark, d).events // 3))
    parts = [rows.where((F.col("step") >= k * third) & (F.col("step") < (k + 1) * third) if k < 2 else F.col("step") >= k * third) for k in range(3)]
    return _rounded(track_files(parts, T.mesh(spark, d), out, state, source))


@query("track_positions", TRACKED)
def _(spark, d):
    """The same of the whole table at once, by windows."""
    from tesselark.streaming.tracking import tracked

    return _rounded(tracked(tracked_rows(spark, d), T.mesh(spark, d)))


#: Vertices (dimension 0), sides (1) and elements (2) with their owners, and which of them each rank holds.
PPM = f"""WITH {HALO2}, {HALF}, {SIDE}, {ES}, b AS (SELECT DISTINCT l2.rank, owner FROM l2 JOIN o USING (eid)), held AS (SELECT b.rank, o.eid FROM b JOIN o ON o.owner = b.owner),
  part AS (SELECT 0 AS dim, eid, vid AS k FROM ev UNION ALL SELECT 1, eid, sid FROM es UNION ALL SELECT 2, eid, eid FROM e),
  own AS (SELECT dim, k, min(owner) AS owner FROM part JOIN o USING (eid) GROUP BY dim, k), ranked AS (SELECT *, row_number() OVER (PARTITION BY dim, owner ORDER BY k) - 1 AS rl FROM own),
  has AS (SELECT DISTINCT dim, rank, k FROM part JOIN held USING (eid)), num AS (SELECT h.*, owner, rl, row_number() OVER (PARTITION BY dim, rank ORDER BY k) - 1 AS lid FROM has h JOIN ranked USING (dim, k))"""


def _stored_parts(spark: SparkSession, d: str) -> str:
    from tesselark.operators.pic_parts import pic_parts
    from tesselark.sources import ppm

    ppm.register(spark)
    parts, path = _parts(spark, d), _path(spark, "plate")
    ppm.ppm_rows(spark, parts, pic_parts(parts.mesh, parts.halo)).write.format("ppm").option("ranks", RANKS).mode("overwrite").save(path)
    return path


@query("source_ppm_entities", f"""{PPM}, i AS (SELECT *, row_number() OVER (PARTITION BY dim, rank ORDER BY owner, rl) - 1 AS spot FROM num)
  SELECT CAST(rank AS INTEGER) AS rank, CAST(dim AS INTEGER) AS dim, CAST(lid AS INTEGER) AS lid, CAST(spot AS INTEGER) AS comm_index FROM i""")
def _(spark, d):
    """Binary files of all ranks written and read back: each entity's place in the arrays that ranks exchange."""
    back = spark.read.format("ppm").option("ranks", RANKS).load(_stored_parts(spark, d))
    return back.select("rank", "dim", F.posexplode("comm_index").alias("lid", "comm_index"))


@query("source_ppm_of_a_rank", f"""{PPM}, r AS (SELECT range AS q FROM range({RANKS})), c AS (SELECT dim, q, count(*) FILTER (WHERE rank = 2 AND owner = q) AS n, count(DISTINCT k) FILTER (WHERE owner = q) AS total, count(*) FILTER (WHERE owner = 2 AND rank = q AND q <> 2) AS n_some, count(DISTINCT k) FILTER (WHERE owner = 2) AS mine FROM num, r GROUP BY dim, q),
  s AS (SELECT *, CASE WHEN n_some < mine THEN n_some ELSE 0 END AS sent FROM c)
  SELECT CAST(dim AS INTEGER) AS dim, CAST(q AS INTEGER) AS part, CAST(sum(n) OVER w - n AS INTEGER) AS first, CAST(n = total AS INTEGER) + CAST(n <> 0 AS INTEGER) AS complete, CASE WHEN dim < 2 THEN CAST(sum(sent) OVER w - sent AS INTEGER) END AS bounded_first FROM s WINDOW w AS (PARTITION BY dim ORDER BY q)""")
def _(spark, d):
    """Only one rank's file is opened: where each part's entities begin, whether all of the part is there, and where those begin that the other holds of this rank's."""
    back = spark.read.format("ppm").option("ranks", RANKS).option("only", "2").load(_stored_parts(spark, d)).where("dim < 3")
    return back.select("dim", F.posexplode("complete").alias("part", "complete"), "offsets", "bounded_offsets").select("dim", "part", F.get("offsets", "part").alias("first"), "complete", F.get("bounded_offsets", "part").alias("bounded_first"))
