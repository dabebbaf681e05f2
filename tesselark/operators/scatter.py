"""From particles to mesh fields: counts, densities, gyro-averaged rings, and their sum over ranks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.operators.mesh import Mesh, centroids, elem_vert, first_adjacent, walk_table
from tesselark.operators.particles import per_element
from tesselark.operators.partition import reduce_comm_array
from tesselark.operators.walk import search_2d


@dataclass(frozen=True)
class Gyro:
    """Rings around each vertex: greatest radius, rings, points a ring, and the angle of the first point in degrees."""

    rmax: float = 0.038
    rings: int = 3
    points: int = 8
    theta: float = 0.0


def vertex_density(particles: DataFrame, mesh: Mesh) -> DataFrame:
    """vid, density: mean particles of the elements around each vertex."""
    n = elem_vert(mesh).join(per_element(particles).select(F.col("elem_id").alias("eid"), "n"), "eid", "left")
    return n.groupBy("vid").agg((F.sum(F.coalesce("n", F.lit(0))) / F.count(F.lit(1))).alias("density"))


def has_particles(elem: DataFrame, particles: DataFrame, iteration: int, before: str | None = None) -> DataFrame:
    """elem with has_particles: the iteration if it holds some now, else what it was (-1)."""
    now = particles.select(F.col("elem_id").alias("eid")).distinct().withColumn("_now", F.lit(iteration))
    old = F.col(before) if before else F.lit(-1)
    out = elem.join(now, "eid", "left").withColumn("_value", F.coalesce("_now", old)).drop("_now", "has_particles")
    return out.withColumnRenamed("_value", "has_particles")


def ring_points(mesh: Mesh, gyro: Gyro) -> DataFrame:
    """vid, ring, pt, x, y: vertices times a fixed number of points."""
    rings = F.explode(F.sequence(F.lit(0), F.lit(gyro.rings - 1))).alias("ring")
    pts = mesh.vertex.select("vid", "x", "y", rings).select("*", F.explode(F.sequence(F.lit(0), F.lit(gyro.points - 1))).alias("pt"))
    radius = gyro.rmax * (F.col("ring") + 1) / gyro.rings
    angle = F.radians(gyro.theta + F.col("pt") / gyro.points * 360)
    return pts.select("vid", "ring", "pt", (F.col("x") + radius * F.cos(angle)).alias("x"), (F.col("y") + radius * F.sin(angle)).alias("y"))


def ring_map(mesh: Mesh, pts: DataFrame, looplimit: int = 0, walk: DataFrame | None = None) -> DataFrame:
    """vid, ring, pt, to: the vertices of the element that each ring point lies in (one row a vertex; none outside). The walk starts
    at the centroid of an element around the point's vertex. walk: the mesh's walk table where it is at hand."""
    start = first_adjacent(mesh).join(centroids(mesh).select("eid", F.col("x").alias("ox"), F.col("y").alias("oy")), "eid")
    # ring points are many rows for each vertex, and elem_vert several for each element, whose size Spark guesses as that of the vertices and elements: they must never be broadcast
    named = pts.hint("merge").join(start, "vid").select(F.struct("vid", "ring", "pt").alias("pid"), F.col("eid").alias("elem_id"), "ox", "oy", F.col("x").alias("tx"), F.col("y").alias("ty"))
    found = search_2d(named, walk_table(mesh) if walk is None else walk, looplimit=looplimit).where("elem_id >= 0")
    return found.select("pid.*", F.col("elem_id").alias("eid")).join(elem_vert(mesh).select("eid", F.col("vid").alias("to")).hint("merge"), "eid").select("vid", "ring", "pt", "to")


def gyro_mappings(mesh: Mesh, gyro: Gyro, forward=lambda pts: pts, backward=lambda pts: pts) -> tuple[DataFrame, DataFrame]:
    """Maps of the ring points projected to the next and the previous plane (by default they stay where they are)."""
    pts = ring_points(mesh, gyro)
    return ring_map(mesh, forward(pts)), ring_map(mesh, backward(pts))


def ring_weights(particles: DataFrame, mesh: Mesh, gyro: Gyro, radius: Column | None = None) -> DataFrame:
    """vid, ring, w: every particle counts on the two rings next to its gyro radius, at each vertex of its element."""
    width = gyro.rmax / gyro.rings
    down = F.greatest(F.lit(0), F.least(F.floor((radius if radius is not None else F.lit(width * 1.125)) / width).cast("int") - 1, F.lit(gyro.rings - 2)))
    counted = particles.select("elem_id", down.alias("down")).groupBy("elem_id", "down").agg(F.count(F.lit(1)).alias("n"))
    at = elem_vert(mesh).hint("merge").join(counted, F.col("eid") == F.col("elem_id")).select("vid", "n", F.explode(F.array("down", F.col("down") + 1)).alias("ring"))
    return at.groupBy("vid", "ring").agg(F.sum("n").alias("w"))


def gyro_scatter(particles: DataFrame, mesh: Mesh, mapping: DataFrame, gyro: Gyro, name: str = "w", radius: Column | None = None) -> DataFrame:
    """vid, name: rings' weights over their points, added up at the vertices that the points map to; 0 elsewhere."""
    sent = mapping.join(ring_weights(particles, mesh, gyro, radius), ["vid", "ring"])
    got = sent.groupBy("to").agg((F.sum("w") / gyro.points).alias(name))
    return mesh.vertex.select("vid").join(got.withColumnRenamed("to", "vid"), "vid", "left").select("vid", F.coalesce(name, F.lit(0.0)).alias(name))


def gyro_sync(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """vid, fwd, bkwd summed over ranks, from (rank, vid, w) of each direction."""
    both = forward.select("rank", "vid", F.col("w").alias("fwd")).join(backward.select("rank", "vid", F.col("w").alias("bkwd")), ["rank", "vid"], "full").na.fill(0)
    return reduce_comm_array(both, "vid", "SUM", ["fwd", "bkwd"]).select("vid", "fwd", "bkwd").distinct()
