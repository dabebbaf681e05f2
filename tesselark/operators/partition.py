"""Partitioned meshes: owners, global numbering, halos and safe zones, reductions over entities that ranks share.

part(ent, owner[, gid, rank_lid]); halo(rank, eid, is_core, is_safe): which elements a rank holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselark.operators.mesh import Mesh, elem_vert
from tesselark.storage import cut, fetched, place_within


class Method(Enum):
    """How much of the mesh a rank buffers, or regards as safe."""

    INVALID = -1
    FULL = 0
    BFS = 1
    MINIMUM = 2
    NONE = 3

    @classmethod
    def parse(cls, name: str) -> Method:
        """By name, in any case; INVALID if there is no such method."""
        return cls.__members__.get(name.strip().upper(), cls.INVALID)

    def __str__(self) -> str:
        return self.name


class Ownership(Enum):
    PARTITION = 0
    CLASSIFICATION = 1


@dataclass(frozen=True)
class Input:
    """What a partitioned mesh is made from; partition is (eid, owner) or (class_id, owner)."""

    mesh: Mesh
    partition: DataFrame
    n_ranks: int
    ownership: Ownership = Ownership.PARTITION
    buffer_method: Method = Method.FULL
    safe_method: Method = Method.BFS
    bridge_dim: int = 0
    buffer_layers: int = 3
    safe_layers: int = 1

    def __post_init__(self) -> None:
        if Method.INVALID in (self.buffer_method, self.safe_method):
            raise ValueError("invalid buffer or safe method")
        if self.buffer_method is Method.NONE:  # a rank always has its own elements
            object.__setattr__(self, "buffer_method", Method.MINIMUM)


@dataclass(frozen=True)
class PartMesh:
    """A mesh on ranks: owners (eid, owner), halo, and how the ranks' parts are held."""

    mesh: Mesh
    owners: DataFrame
    halo: DataFrame
    n_ranks: int
    is_full: bool

    def buffers(self) -> DataFrame:
        """rank, n: how many parts (its own too) a rank holds."""
        return buffered_parts(self.halo, self.owners).groupBy("rank").agg(F.countDistinct("owner").alias("n"))

    def local(self, rank: int) -> Mesh:
        return pic_part(self.mesh, self.halo, rank)


# owners and numbers


def owners_by_class(elem: DataFrame, class_owner: DataFrame) -> DataFrame:
    """eid, owner of each element's class; null where a class has no owner."""
    return elem.join(class_owner, "class_id", "left").select("eid", "owner")


def lower_owners(down: DataFrame, owners: DataFrame, low: str) -> DataFrame:
    """low, owner: the least owner of the elements around each lower entity; down(eid, low)."""
    return down.join(owners, "eid").groupBy(low).agg(F.min("owner").alias("owner"))


def rank_offsets(spark: SparkSession, owners: DataFrame, n_ranks: int) -> DataFrame:
    """rank, n, offset for every rank, also those that own nothing."""
    ranks = spark.range(n_ranks).select(F.col("id").cast("int").alias("rank"))
    n = owners.groupBy(F.col("owner").cast("int").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # n_ranks rows
    return ranks.join(n, "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def global_numbers(spark: SparkSession, owners: DataFrame, key: str, n_ranks: int) -> DataFrame:
    """key, owner, gid, rank_lid: numbers that run through one owner after the other, by key within."""
    out = place_within(owners, ["owner"], [key], "rank_lid").join(F.broadcast(rank_offsets(spark, owners, n_ranks).select(F.col("rank").alias("owner"), "offset")), "owner")
    return out.select(key, "owner", (F.col("offset") + F.col("rank_lid")).alias("gid"), "rank_lid")


# halos


def bridge(mesh: Mesh, dim: int = 0) -> DataFrame:
    """eid, ent: the entities of that dimension through which layers grow (vertices, or sides for dim = mesh.dim - 1)."""
    if dim == 0:
        return elem_vert(mesh).select("eid", F.col("vid").alias("ent"))
    from tesselark.operators.mesh import elem_side

    return elem_side(mesh).select("eid", F.col("sid").alias("ent"))


def grow(visited: DataFrame, links: DataFrame) -> DataFrame:
    """rank, eid: visited and all elements that share a bridge entity with them."""
    touched = visited.join(links, "eid").select("rank", "ent").distinct()
    return touched.join(links, "ent").select("rank", "eid").distinct()


def bfs_layers(owners: DataFrame, links: DataFrame, layers: int) -> DataFrame:
    """rank, eid, layer: elements within that many layers of a rank's own (layer 0). The number of steps is fixed, so is the plan."""
    core = owners.select(F.col("owner").alias("rank"), "eid")
    out, seen = core.withColumn("layer", F.lit(0)), core
    for layer in range(1, layers + 1):
        wider = cut(grow(seen, links))
        out = out.unionByName(wider.join(seen, ["rank", "eid"], "left_anti").withColumn("layer", F.lit(layer)))
        seen = wider
    return out


def parts_in_reach(layers: DataFrame, owners: DataFrame, upto: int) -> DataFrame:
    """rank, owner: parts that a rank buffers, those with an element within ``upto`` layers; a part comes as a whole."""
    return layers.where(F.col("layer") <= upto).join(owners, "eid").select("rank", "owner").distinct()


def safe_inward(parts: DataFrame, owners: DataFrame, links: DataFrame, layers: int) -> DataFrame:
    """rank, eid: elements that are safe because they lie more than ``layers`` away from everything the rank lacks, and its own. What a rank
    lacks is met only where parts touch: bridge entities of several owners; from there the unsafe layer grows within what the rank holds."""
    held = cut(parts.join(owners, "owner").select("rank", "eid"))
    own = owners.select(F.col("owner").alias("rank"), "eid")
    around = links.join(owners, "eid").select("ent", "owner").distinct()
    border = around.groupBy("ent").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ent").join(around, "ent")
    touches = held.join(links, "eid").join(border, "ent").join(parts, ["rank", "owner"], "left_anti")
    reached = cut(touches.select("rank", "eid").distinct()) if layers else held.limit(0)
    for _ in range(layers - 1):
        reached = cut(grow(reached, links).join(held, ["rank", "eid"], "left_semi"))
    return held.join(reached, ["rank", "eid"], "left_anti").unionByName(own).distinct()


def build(spec: Input) -> PartMesh:
    """The method matrix: which elements each rank holds and which of them are safe."""
    spark = spec.mesh.elem.sparkSession
    owners = owners_by_class(spec.mesh.elem, spec.partition) if spec.ownership is Ownership.CLASSIFICATION else spec.partition
    owners = cut(owners.select("eid", F.col("owner").cast("int").alias("owner")))
    if not owners.where(f"owner is null or owner < 0 or owner >= {spec.n_ranks}").isEmpty():
        raise ValueError("an element has no owner among the ranks")
    full, links = spec.buffer_method is Method.FULL, bridge(spec.mesh, spec.bridge_dim)
    buffer_layers = spec.buffer_layers if spec.buffer_method is Method.BFS else 0
    safe_layers = spec.safe_layers if spec.safe_method is Method.BFS else 0
    if spec.buffer_method is Method.BFS and safe_layers > buffer_layers:
        raise ValueError("buffer layers must not be fewer than safe layers")
    layers = cut(bfs_layers(owners, links, max(buffer_layers, safe_layers)))
    every = spark.range(spec.n_ranks).select(F.col("id").cast("int").alias("rank"))
    parts = every.crossJoin(every.select(F.col("rank").alias("owner"))) if full else parts_in_reach(layers, owners, buffer_layers)  # ranks x ranks
    held = parts.join(owners, "owner").select("rank", "eid", (F.col("rank") == F.col("owner")).alias("is_core"))
    if spec.safe_method is Method.FULL:
        safe = safe_inward(parts, owners, links, spec.safe_layers) if spec.buffer_method is Method.BFS else held.select("rank", "eid")
    elif spec.safe_method is Method.NONE:
        safe = held.select("rank", "eid").where("false")
    else:
        safe = layers.where(F.col("layer") <= safe_layers).select("rank", "eid")
    halo = held.join(safe.withColumn("is_safe", F.lit(True)), ["rank", "eid"], "left").select("rank", "eid", "is_core", F.coalesce("is_safe", F.lit(False)).alias("is_safe"))
    return PartMesh(spec.mesh, owners, halo, spec.n_ranks, full)


def full_mesh(mesh: Mesh, owners: DataFrame, n_ranks: int) -> PartMesh:
    """Every rank holds everything, and all is safe."""
    return build(Input(mesh, owners, n_ranks, safe_method=Method.FULL))


def layered_mesh(mesh: Mesh, owners: DataFrame, n_ranks: int, ghost_layers: int, safe_layers: int) -> PartMesh:
    if ghost_layers < safe_layers:
        raise ValueError("ghost layers must not be fewer than safe layers")
    return build(Input(mesh, owners, n_ranks, buffer_method=Method.BFS, safe_method=Method.BFS, buffer_layers=ghost_layers, safe_layers=safe_layers))


def buffered_parts(halo: DataFrame, owners: DataFrame) -> DataFrame:
    """rank, owner, n, total, complete: held elements of each part; complete 2 for all of it, 1 for some."""
    held = halo.join(owners, "eid").groupBy("rank", "owner").agg(F.count(F.lit(1)).alias("n"))
    total = owners.groupBy("owner").agg(F.count(F.lit(1)).alias("total"))
    return held.join(total, "owner").select("rank", "owner", "n", "total", F.when(F.col("n") == F.col("total"), 2).otherwise(1).alias("complete"))


def held_entities(halo: DataFrame, down: DataFrame, low: str) -> DataFrame:
    """rank, low: lower entities of the elements a rank holds; down(eid, low)."""
    return halo.join(down, "eid").select("rank", low).distinct()


def comm_index(held: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """rank, key, owner, index: place in the rank's array of shared entities, ordered by owner and the owner's numbering."""
    placed = place_within(held.join(numbers, key).select("rank", key, "owner", "rank_lid"), ["rank"], ["owner", "rank_lid"], "index")
    return placed.select("rank", key, "owner", "index")


def pic_part(mesh: Mesh, halo: DataFrame, rank: int) -> Mesh:
    """The elements and vertices that one rank holds, with new consecutive numbers (old ones in *_global) and all tags."""
    from tesselark.storage import numbered

    elem = mesh.elem.join(halo.where(F.col("rank") == rank).select("eid", "is_safe"), "eid")
    used = elem.select(F.explode(F.array(*mesh.verts)).alias("vid")).distinct()
    vertex = numbered(mesh.vertex.join(used, "vid", "left_semi").withColumnRenamed("vid", "vid_global"), ["vid_global"], "vid")
    renamed = numbered(elem.withColumnRenamed("eid", "eid_global"), ["eid_global"], "eid")
    for v in mesh.verts:
        renamed = renamed.join(vertex.select(F.col("vid_global").alias(v), F.col("vid").alias("_new")), v).drop(v).withColumnRenamed("_new", v)
    return Mesh(mesh.dim, vertex, renamed)


def consistency(a: DataFrame, b: DataFrame, key: str, columns: list[str], tol: float = 1e-12) -> DataFrame:
    """Rows of key on which two tables differ by more than tol in a column, or that only one of them has."""
    joined = a.select(key, *(F.col(c).alias(f"a_{c}") for c in columns)).join(b.select(key, *(F.col(c).alias(f"b_{c}") for c in columns)), key, "full")
    same = [F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tol, F.lit(False)) for c in columns]
    return joined.where(~F.least(*same) if len(same) > 1 else ~same[0])


def sum_positives(values: DataFrame, column: str) -> DataFrame:
    """n: how many values are above 0."""
    return values.agg(F.count_if(F.col(column) > 0).alias("n"))


# reductions over shared entities


def comm_array(held: DataFrame, key: str, values: dict[str, float | int]) -> DataFrame:
    """held (rank, key) with a default for each named component."""
    return held.select("rank", key, *(F.lit(v).alias(k) for k, v in values.items()))


REDUCTIONS = {"SUM": F.sum, "MAX": F.max, "MIN": F.min}


def reduce_comm_array(array: DataFrame, key: str, op: str, components: list[str], owners: DataFrame | None = None) -> DataFrame:
    """array (rank, key, components) with the reduced value on every holder. BCAST takes the owner's value (owners: key, owner). The
    holders' values are aggregated before the shuffle."""
    if op == "BCAST":
        if owners is None:
            raise ValueError("BCAST needs owners")
        own = array.join(owners, key).where("rank = owner").select(key, *components)
    elif op in REDUCTIONS:
        own = array.groupBy(key).agg(*(REDUCTIONS[op](c).alias(c) for c in components))
    else:
        raise ValueError(f"unknown reduction {op}")
    return array.drop(*components).join(own, key, "left")


# classes to ranks


def class_partition(elem: DataFrame, n_ranks: int, tol: float = 1.05, rounds: int = 10) -> dict[int, int]:
    """class_id to owner: consecutive classes for each rank, evened out by moving border classes to the next rank. Runs on
    the driver over one number a class."""
    sizes = sorted((r["class_id"], r["n"]) for r in fetched(elem.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")), "classes"))
    if len(sizes) < n_ranks:
        raise ValueError("fewer classes than ranks")
    total, out, rank, have = sum(n for _, n in sizes), {}, 0, 0
    for i, (c, n) in enumerate(sizes):
        left = len(sizes) - i
        if rank < n_ranks - 1 and have and (have + n / 2 > total / n_ranks * (1 if have else 2) or left <= n_ranks - 1 - rank):
            rank, have = rank + 1, 0
        out[c], have = rank, have + n
    size = dict(sizes)
    for _ in range(rounds):
        load = [sum(size[c] for c, r in out.items() if r == k) for k in range(n_ranks)]
        if max(load) * n_ranks <= tol * total:
            break
        moved = False
        for k in range(n_ranks - 1):
            mine = sorted(c for c, r in out.items() if r == k)
            if load[k] > load[k + 1] and len(mine) > 1 and load[k + 1] + size[mine[-1]] < load[k]:
                out[mine[-1]], moved = k + 1, True
                load[k], load[k + 1] = load[k] - size[mine[-1]], load[k + 1] + size[mine[-1]]
        if not moved:
            break
    return out
