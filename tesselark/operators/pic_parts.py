"""The parts of all ranks in one pass: elements, vertices, sides and, in space, edges that each rank holds, renumbered within (rank, entity) from 0
in the order of their numbers in the whole mesh, with classification and all tags.

Every table carries rank; numbers of the whole mesh are in *_global. Each kind of entity is numbered by one range partitioning of all
ranks' entities, so no task sees a whole rank, and no step is done rank by rank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.operators.mesh import Mesh, edges, elem_side, sides
from tesselark.storage import cut, place_within


@dataclass(frozen=True)
class PicParts:
    """elem: rank, eid, eid_global, v0.., tags, is_core, is_safe; vertex: rank, vid, vid_global, coordinates, tags; side: rank, sid, sid_global, v0..,
    exposed (one element of the rank only), class_id, class_dim; elem_side: rank, eid, li, sid; edge: rank, edge, edge_global, a, b (of tetrahedra)."""

    dim: int
    elem: DataFrame
    vertex: DataFrame
    side: DataFrame
    elem_side: DataFrame
    edge: DataFrame | None

    def of(self, rank: int) -> Mesh:
        """One rank's mesh."""
        own = lambda df: df.where(F.col("rank") == rank).drop("rank")
        return Mesh(self.dim, own(self.vertex), own(self.elem))


def classified_sides(mesh: Mesh, side: DataFrame | None = None) -> DataFrame:
    """Sides with class_id and class_dim: a side within a class is of that class and of the mesh's dimension; one between two classes, or
    exposed, is of one dimension less, and of the least class around it."""
    side = sides(mesh) if side is None else side
    around = elem_side(mesh, side).select("eid", "sid").join(mesh.elem.select("eid", "class_id"), "eid")
    found = around.groupBy("sid").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("_most"), F.count(F.lit(1)).alias("_n"))
    within = (F.col("_n") == 2) & (F.col("class_id") == F.col("_most"))
    return side.join(found.select("sid", "class_id", F.when(within, mesh.dim).otherwise(mesh.dim - 1).cast("tinyint").alias("class_dim")), "sid")


def _renumbered(rows: DataFrame, key: list[str], corners: list[str], vertex: DataFrame) -> DataFrame:
    """key and the corners by their new numbers: one join for all corners, brought back to one row."""
    pairs = rows.select(*key, F.posexplode(F.array(*corners)).alias("_li", "vid_global"))
    new = pairs.join(vertex.select("rank", "vid_global", F.col("vid").alias("_new")), ["rank", "vid_global"])
    return new.groupBy(*key).agg(*(F.max(F.when(F.col("_li") == i, F.col("_new"))).alias(c) for i, c in enumerate(corners)))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with key as key_global and its place within the rank as key."""
    return cut(place_within(rows.withColumnRenamed(key, f"{key}_global"), ["rank"], [f"{key}_global"], key))


def pic_parts(mesh: Mesh, halo: DataFrame, side: DataFrame | None = None) -> PicParts:
    """All ranks' parts of the mesh from halo (rank, eid, is_core, is_safe). side: classified sides, see classified_sides(), which is the default."""
    held = cut(halo.select("rank", "eid", "is_core", "is_safe"))
    side = cut(classified_sides(mesh) if side is None else side)
    elem = _numbered(held.join(mesh.elem, "eid"), "eid")
    used = elem.select("rank", F.explode(F.array(*mesh.verts)).alias("vid")).distinct()
    vertex = _numbered(used.join(mesh.vertex, "vid"), "vid")
    corners = _renumbered(elem, ["rank", "eid"], mesh.verts, vertex)
    own = elem.drop(*mesh.verts).join(corners, ["rank", "eid"])

    links = elem_side(mesh, side).select(F.col("eid").alias("eid_global"), "li", F.col("sid").alias("sid_global"))
    down = cut(elem.select("rank", "eid", "eid_global").join(links, "eid_global").select("rank", "eid", "li", "sid_global"))
    around = down.groupBy("rank", "sid_global").agg((F.count(F.lit(1)) == 1).alias("exposed")).withColumnRenamed("sid_global", "sid")
    names = [f"v{i}" for i in range(mesh.dim)]
    sided = _numbered(around.join(side.drop("exposed", "n_elem"), "sid"), "sid")
    sided_out = sided.drop(*names).join(_renumbered(sided, ["rank", "sid"], names, vertex), ["rank", "sid"])
    adjacent = down.join(sided.select("rank", "sid_global", "sid"), ["rank", "sid_global"]).select("rank", "eid", "li", "sid")

    edge = None
    if mesh.dim == 3:
        pairs = F.array(*(F.struct(F.least(f"v{i}", f"v{j}").alias("a"), F.greatest(f"v{i}", f"v{j}").alias("b")) for i in range(4) for j in range(i + 1, 4)))
        ours = elem.select("rank", F.explode(pairs).alias("p")).select("rank", "p.*").distinct()
        numbered_edges = _numbered(ours.join(edges(mesh), ["a", "b"]), "edge")
        edge = numbered_edges.drop("a", "b").join(_renumbered(numbered_edges, ["rank", "edge"], ["a", "b"], vertex), ["rank", "edge"])
    return PicParts(mesh.dim, own, vertex, sided_out, adjacent, edge)
