"""Two complete particle loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.operators import mesh as M, particles as PT, scatter as SC, walk as W
from tesselark.operators.scatter import Gyro
from tesselark.storage import cut
from tesselark.streaming.steps import run_steps


def gyro_app(particles: DataFrame, mesh: M.Mesh, steps: int, gyro: Gyro, degrees: float = 5.0) -> DataFrame:
    """vid, w: elliptical pushes, search and rebuild in each step, gyro scatter of the last state."""
    table = cut(M.walk_table(mesh))
    centre = mesh.vertex.agg(*(((F.min(a) + F.max(a)) / 2) for a in mesh.axes)).first()
    h, k = float(centre[0]), float(centre[1])
    state = particles.select("pid", "elem_id", *(F.col(c).cast("double").alias(c) for c in ("ox", "oy", "tx", "ty")))
    state = PT.elliptical_setup(state, h, k, 1.0).select("pid", "elem_id", "ox", "oy", "tx", "ty", "phi", "b")

    def step(now: DataFrame, i: int) -> DataFrame:
        pushed = PT.elliptical_push(now, mesh.elem, h, k, 1.0, degrees).select(*now.columns)
        found = W.search_2d(pushed, table).select("pid", F.col("elem_id").alias("new_elem"))
        return PT.rebuild(PT.commit_positions(pushed).join(found, "pid")).select(*now.columns)

    last = run_steps(state, step, steps)
    mapping = SC.ring_map(mesh, SC.ring_points(mesh, gyro), walk=table)
    return SC.gyro_scatter(last, mesh, mapping, gyro).withColumn("w", F.round("w", 6))


def push_and_search_app(particles: DataFrame, mesh: M.Mesh, steps: int) -> DataFrame:
    """elem_id, n: in each step particles move on, are traced to their target or a wall, turn round there; in the end those at a wall are removed."""
    table = cut(M.walk_table(mesh))
    start = particles.select("pid", "elem_id", *(F.col(f"{p}{a}").cast("double").alias(f"{p}{a}") for p in "ot" for a in "xyz"))
    start = start.select("*", *((F.col(f"t{a}") - F.col(f"o{a}")).alias(f"d{a}") for a in "xyz"), F.lit(None).cast("long").alias("face"))

    def step(now: DataFrame, i: int) -> DataFrame:
        pushed = PT.push_along(now, 1.0)
        found = W.trace(pushed, table, 3, crossing=True, short=True).select("pid", F.col("elem_id").alias("new_elem"), F.col("face").alias("wall"), *(F.col(f"p{a}").alias(f"q{a}") for a in "xyz"))
        met = pushed.join(found, "pid").withColumns({"face": F.col("wall")} | {f"p{a}": F.col(f"q{a}") for a in "xyz"})
        met = PT.reflect_at_wall(met, 3).withColumn("elem_id", F.col("new_elem"))
        return PT.commit_positions(met, 3).where("elem_id >= 0").select(*now.columns)

    last = run_steps(start, step, steps)
    return PT.per_element(PT.remove_at_wall(last).where("elem_id >= 0"))
