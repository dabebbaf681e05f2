"""A log of all sides that ways cross: a row for each stretch of a way within an element, not only the last crossing.

A hop is one equi-join with the walk table, as in walk.trace. Stretches are kept with the particle for a few hops and written when those are
stored, so the log is written hop by hop and a particle carries at most ``hops_at_once`` of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.functions.geometry import TRIANGLE_EDGES, line_edge_2d
from tesselark.operators.walk import _point, _vertices
from tesselark.storage import cut, small

LOG = "array<struct<hop:int,elem:long,side:long,t0:double,t1:double,exposed:boolean>>"


def _hop(state: DataFrame, walk: DataFrame, tol: float) -> DataFrame:
    keep = state.columns
    rows = state.join(walk, F.when(~F.col("done"), F.col("elem")) == F.col("eid"), "left")
    v, o, t = _vertices(2), _point("o", 2), _point("t", 2)
    way = F.lit(None)
    for li, (i, j) in enumerate(TRIANGLE_EDGES):
        met = line_edge_2d(v[i], v[j], o, t, tol)
        rows = rows.withColumn(f"_r{li}", F.struct(met["hit"].alias("hit"), met["t"].cast("double").alias("t")))
    for li in range(3):
        fresh = ~F.col(f"s{li}").eqNullSafe(F.col("last"))
        out = F.struct(F.col(f"s{li}").alias("side"), F.col(f"n{li}").alias("next"), F.least(F.lit(1.0), F.greatest("at", f"_r{li}.t")).alias("t"))
        way = F.when(fresh & F.col(f"_r{li}.hit"), out).otherwise(way)
    rows = rows.withColumn("_way", way).withColumn("_known", ~F.col("done") & F.col("eid").isNotNull())
    leaves = F.col("_known") & F.col("_way").isNotNull()
    exposed = leaves & F.col("_way.next").isNull()
    entry = F.struct(F.col("hops").alias("hop"), F.col("elem").alias("elem"), F.col("_way.side").alias("side"), F.col("at").alias("t0"), F.when(leaves, F.col("_way.t")).otherwise(F.lit(1.0)).alias("t1"), exposed.alias("exposed"))
    return rows.withColumns({
        "log": F.when(F.col("_known"), F.array_append("log", entry)).otherwise(F.col("log")), "done": F.col("done") | ~leaves | exposed, "elem": F.when(leaves & ~exposed, F.col("_way.next")).otherwise(F.col("elem")),
        "last": F.when(leaves, F.col("_way.side")).otherwise(F.col("last")), "at": F.when(leaves, F.col("_way.t")).otherwise(F.col("at")), "hops": F.col("hops") + F.when(leaves, 1).otherwise(0),
    }).select(*keep)


def crossing_log(particles: DataFrame, walk: DataFrame, tol: float = 0.0, hops_at_once: int = 4, broadcast_bytes: int | None = None) -> DataFrame:
    """pid, hop (from 0), elem, side, t0, t1, exposed: the stretches of each way through a mesh of triangles, as shares of the way from origin to target. side is
    the one crossed at t1, null where the way ends; a way ends at an exposed side. particles: pid, elem_id, ox, oy, tx, ty. Who does not move
    has one stretch; who starts in no element of the mesh has none. Raises ValueError if a way does not end."""
    walk = small(cut(walk), broadcast_bytes)
    empty = F.array().cast(LOG)
    state = particles.select("pid", F.col("elem_id").cast("long").alias("elem"), "ox", "oy", "tx", "ty", F.lit(False).alias("done"), F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("at"), F.lit(0).alias("hops"), empty.alias("log"))
    written, hops, bound = [], 0, None
    while True:
        if hops > 256:
            bound = bound or walk.count()
            if hops > 2 * bound:
                raise ValueError(f"some ways are not over after {hops} sides in a mesh of {bound} elements")
        for _ in range(hops_at_once):
            state = _hop(state, walk, tol)
        hops += hops_at_once
        state = cut(state)
        written.append(state.select("pid", F.explode("log").alias("x")).select("pid", "x.*"))
        state = state.where("not done").withColumn("log", empty)
        if state.isEmpty():
            return reduce(DataFrame.unionByName, written)


def path_deposits(log: DataFrame, particles: DataFrame, value: str) -> DataFrame:
    """elem_id and the sum of value over the ways through it, each weighted by the share of the way that lies there; added up before the shuffle."""
    share = log.groupBy("pid", "elem").agg(F.sum(F.col("t1") - F.col("t0")).alias("share")).where("share > 0")
    return share.join(particles.select("pid", value), "pid").groupBy(F.col("elem").alias("elem_id")).agg(F.sum(F.col(value) * F.col("share")).alias(value))
