"""Particles: creation, pushes, rebuild and migration. A particle is a row with a stable pid; an inactive slot does not exist."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselark.operators.mesh import Mesh, elem_geometry, mark_up, points
from tesselark.storage import cut, numbered, place_within, running_sum

REMOVED = -1
AXES = ("x", "y", "z")


# distributions over elements


STRATEGIES = ("even", "uniform", "gaussian", "exponential", "clustered")


def element_of(strategy: int, n_elems: int, index: Column, total: int, u: Column, v: Column) -> Column:
    """The element of the index-th of total particles, drawn by two uniform numbers in [0, 1). 0 even: total div n_elems in each, the first
    total % n_elems one more. 1 uniform. 2 normal around the middle element with a deviation of an eighth of them, clamped to the ends. 3 exponential of
    rate 4 over [0, 1), by the inverse of the truncated distribution. 4: 85 % in the first 2/5 of the elements."""
    last = F.lit(n_elems - 1)
    if strategy == 0:
        low, more = divmod(total, max(n_elems, 1))
        border = (low + 1) * more
        return F.when(index < border, F.floor(index / (low + 1))).otherwise(more + F.floor((index - border) / max(low, 1))).cast("long")
    if strategy == 1:
        draw = F.floor(u * n_elems)
    elif strategy == 2:
        normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)
        draw = F.floor(normal * (n_elems / 8) + n_elems / 2)
    elif strategy == 3:
        draw = F.floor(-F.log(1 - u * (1 - 2.718281828459045**-4.0)) / 4.0 * n_elems)
    elif strategy == 4:
        first = max(1, int(n_elems * 0.4))
        draw = F.when(u < 0.85, F.floor(v * first)).otherwise(first + F.floor(v * max(n_elems - first, 1)))
    else:
        raise ValueError(f"unknown distribution {strategy}")
    return F.greatest(F.lit(0), F.least(draw, last)).cast("long")


def distribute(spark: SparkSession, n_elems: int, n_particles: int, strategy: int, seed: int = 0, draws: tuple[Column, Column] | None = None) -> DataFrame:
    """pid, elem_id by one of STRATEGIES; draws: uniform numbers made from pid instead of seeded ones."""
    rows = spark.range(n_particles).select(F.col("id").alias("pid"))
    u, v = draws or (F.rand(seed), F.rand(seed + 1))
    return rows.select("pid", element_of(strategy, n_elems, F.col("pid"), n_particles, u, v).alias("elem_id"))


def even_distribution(spark: SparkSession, n_elems: int, n_particles: int) -> DataFrame:
    return distribute(spark, n_elems, n_particles, 0)


def redistribute(particles: DataFrame, n_elems: int, strategy: int, share: float, seed: int = 0, chance: Column | None = None, draws: tuple[Column, Column] | None = None) -> DataFrame:
    """particles with mover (the place of a mover among all movers by pid, else -1) and new_elem: movers, each with the probability share, are
    distributed over the elements by the strategy, the others keep theirs. chance, draws: as in distribute; draws may use mover."""
    marked = cut(particles.withColumn("_moves", (F.rand(seed) if chance is None else chance) <= share))
    movers = numbered(marked.where("_moves").select("pid"), ["pid"], "mover")
    total = movers.count()
    u, v = draws or (F.rand(seed + 1), F.rand(seed + 2))
    movers = movers.select("pid", "mover", element_of(strategy, n_elems, F.col("mover"), total, u, v).alias("_new"))
    joined = marked.join(movers, "pid", "left")
    return joined.select(*particles.columns, F.coalesce("mover", F.lit(-1)).cast("long").alias("mover"), F.coalesce("_new", "elem_id").cast("long").alias("new_elem"))


def from_counts(counts: DataFrame) -> DataFrame:
    """elem_id, slot: a row for each of an element's n particles, from (elem_id, n)."""
    return counts.where("n > 0").select("elem_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("slot"))


# source elements and first positions


def source_elements_by_face(elem_side: DataFrame, flagged_sides: DataFrame, n_particles: int) -> DataFrame:
    """elem_id, n: particles evenly on the elements at exposed flagged sides, the remainder on the last of them."""
    marked = mark_up(elem_side.where("nbr is null").select("sid", "eid"), flagged_sides, "sid", "eid")
    k, last = marked.agg(F.count(F.lit(1)), F.max("eid")).first()
    per = n_particles // max(k, 1)
    return marked.select(F.col("eid").alias("elem_id"), (F.lit(per) + F.when(F.col("eid") == last, n_particles - per * k).otherwise(0)).cast("long").alias("n"))


def capped_counts(counts: DataFrame, total: int) -> DataFrame:
    """elem_id, n: the given wishes (elem_id, n) in order of elements until the total is used up; what is missing goes to the last element."""
    wished = running_sum(counts.select("elem_id", F.greatest("n", F.lit(0)).cast("long").alias("n")), ["elem_id"], "n", "before")
    given = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(total) - F.col("before")))
    last, wishes = wished.agg(F.max("elem_id"), F.sum("n")).first()
    return wished.select("elem_id", (given + F.when(F.col("elem_id") == last, max(total - (wishes or 0), 0)).otherwise(0)).cast("long").alias("n"))


def normal_draw(seed: int, *key: Column) -> Column:
    """A standard normal number that the key and the seed decide, so that a task that is run again, or another partitioning, draws the same."""
    share = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2.0 * F.ln(share(0))) * F.cos(2.0 * F.pi() * share(1))


def source_elements_by_class(elem: DataFrame, owner: int, model_face: int, n_particles: int, seed: int = 0) -> DataFrame:
    """elem_id, n: about evenly (normal, a quarter's deviation, decided by element and seed) over the owner's elements of class at most
    model_face, in order of elements until n_particles are used up, the rest on the last. No such element: no rows. elem: eid, owner, class_id."""
    own = elem.where((F.col("owner") == owner) & (F.col("class_id") <= model_face)).select(F.col("eid").alias("elem_id"))
    per = n_particles // max(own.count(), 1)
    return capped_counts(own.withColumn("n", F.round(normal_draw(seed, F.col("elem_id")) * (per // 4) + per).cast("long")), n_particles)


def uniform_in_triangle(particles: DataFrame, mesh: Mesh, r1: Column, r2: Column) -> DataFrame:
    """particles with x, y at (r1, r2) of their triangle, reflected into it where r1 + r2 > 1."""
    over = r1 + r2 > 1
    a, b = F.when(over, 1 - r1).otherwise(r1), F.when(over, 1 - r2).otherwise(r2)
    joined = particles.join(elem_geometry(mesh), F.col("elem_id") == F.col("eid"))
    v = points(mesh)
    place = [v[0][k] + a * (v[1][k] - v[0][k]) + b * (v[2][k] - v[0][k]) for k in range(2)]
    return joined.select(*(F.col(c) for c in particles.columns), *(p.alias(x) for p, x in zip(place, AXES, strict=False)))


def uniform_in_tet(particles: DataFrame, mesh: Mesh, seed: int = 0, draws: list[Column] | None = None) -> DataFrame:
    """particles with x, y, z uniform in their tetrahedron: normalised exponential weights of four uniform draws."""
    e = [-F.log(1 - u) for u in (draws or [F.rand(seed + i) for i in range(4)])]
    drawn = particles.withColumns({f"_e{i}": x for i, x in enumerate(e)}).join(elem_geometry(mesh), F.col("elem_id") == F.col("eid"))
    w, v = [F.col(f"_e{i}") for i in range(4)], points(mesh)
    total = reduce(lambda a, b: a + b, w)
    return drawn.select(*(F.col(c) for c in particles.columns), *((sum((w[i] * v[i][k] for i in range(1, 4)), w[0] * v[0][k]) / total).alias(AXES[k]) for k in range(3)))


def near_vertices(particles: DataFrame, mesh: Mesh, local: Sequence[int], inset: float = 1e-3) -> DataFrame:
    """particles with a position just inside the middle of some local vertices of their element: one for a vertex, two for an edge, more for a face."""
    v = points(mesh)
    joined = particles.join(elem_geometry(mesh), F.col("elem_id") == F.col("eid"))
    middle = lambda at, k: sum((v[i][k] for i in at[1:]), v[at[0]][k]) / len(at)
    place = [middle(local, k) * (1 - inset) + middle(range(mesh.dim + 1), k) * inset for k in range(mesh.dim)]
    return joined.select(*(F.col(c) for c in particles.columns), *(p.alias(AXES[k]) for k, p in enumerate(place)))


def near_local_side(particles: DataFrame, mesh: Mesh, side: int, inset: float = 1e-3) -> DataFrame:
    """near_vertices of a local side."""
    return near_vertices(particles, mesh, mesh.local_sides[side], inset)


def at_centroid(particles: DataFrame, mesh: Mesh) -> DataFrame:
    joined = particles.join(elem_geometry(mesh), F.col("elem_id") == F.col("eid"))
    v, n = points(mesh), mesh.dim + 1
    return joined.select(*(F.col(c) for c in particles.columns), *((sum((p[k] for p in v[1:]), v[0][k]) / n).alias(AXES[k]) for k in range(mesh.dim)))


def sunflower(index: Column, total: int, radius: float, centre: tuple[float, float], smooth: float = 1.0) -> list[Column]:
    """x, y of the index-th of total points evenly on a disc (golden angle), the outermost sqrt(total) * smooth on its rim."""
    rim = round(smooth * total**0.5)
    r = F.when(index >= total - rim, 1.0).otherwise(F.sqrt(index + 0.5) / F.sqrt(F.lit(total - (rim + 1) / 2)))
    angle = index * (2 * 3.141592653589793 / ((5**0.5 + 1) / 2) ** 2)
    return [F.lit(centre[0]) + radius * r * F.cos(angle), F.lit(centre[1]) + radius * r * F.sin(angle)]


def linear(index: Column, total: int, start: tuple[float, float], end: tuple[float, float]) -> list[Column]:
    """x, y of the index-th of total points on a line."""
    at = index / max(total - 1, 1)
    return [F.lit(a) + at * (b - a) for a, b in zip(start, end, strict=True)]


# pushes; a particle has ox, oy[, oz] (now) and tx, ty[, tz] (wanted)


def push_constant(particles: DataFrame, distance: Column | float, direction: list[Column | float]) -> DataFrame:
    """Wanted position: a fixed displacement away."""
    return particles.withColumns({f"t{a}": F.col(f"o{a}") + (F.lit(d) if not isinstance(d, Column) else d) * distance for a, d in zip(AXES, direction, strict=False)})


def push_along(particles: DataFrame, distance: Column | float, dim: int = 3) -> DataFrame:
    """Wanted position: distance along the particle's own direction dx, dy[, dz]."""
    return push_constant(particles, distance, [F.col(f"d{a}") for a in AXES[:dim]])


def elliptical_setup(particles: DataFrame, h: float, k: float, d: float) -> DataFrame:
    """phi and b of each particle's ellipse around (h, k) with axis ratio d."""
    w, z = F.col("ox"), F.col("oy")
    phi = F.atan2(d * (z - k), w - h)
    return particles.withColumns({"phi": phi, "b": F.when(F.sin(phi) == 0, F.abs(w - h) / d).otherwise((z - k) / F.sin(phi))})


def elliptical_push(particles: DataFrame, elem: DataFrame, h: float, k: float, d: float, degrees: float) -> DataFrame:
    """One step on the ellipse; the angle shrinks with the element's class (a hundredth in class 1, else one over the class)."""
    joined = particles.join(elem.select("eid", "class_id"), F.col("elem_id") == F.col("eid"), "left")
    share = F.when(F.col("class_id") == 1, 0.01).otherwise(1.0 / F.greatest(F.coalesce("class_id", F.lit(1)), F.lit(1)))
    phi = F.col("phi") + F.lit(degrees * 3.141592653589793 / 180) * share
    return joined.withColumn("phi", phi).select(*(F.col(c) for c in particles.columns if c not in ("tx", "ty")), (h + d * F.col("b") * F.cos("phi")).alias("tx"), (k + F.col("b") * F.sin("phi")).alias("ty"))


def push_boris(particles: DataFrame, dt: float, charge_over_mass: float) -> DataFrame:
    """The published Boris scheme: half a kick by E, the rotation by B, half a kick, then the move. Needs v, e and b per axis (vx.., ex.., bx..)."""
    from tesselark.functions.scalar import cross, dot

    vec = lambda p: [F.col(f"{p}{a}") for a in AXES]
    half = charge_over_mass * dt / 2
    minus_ = [v + half * e for v, e in zip(vec("v"), vec("e"), strict=True)]
    t = [half * b for b in vec("b")]
    prime = [m + c for m, c in zip(minus_, cross(minus_, t), strict=True)]
    s = [2 * x / (1 + dot(t, t)) for x in t]
    plus_ = [m + c for m, c in zip(minus_, cross(prime, s), strict=True)]
    new = [p + half * e for p, e in zip(plus_, vec("e"), strict=True)]
    return particles.withColumns({f"v{a}": x for a, x in zip(AXES, new, strict=True)} | {f"t{a}": F.col(f"o{a}") + x * dt for a, x in zip(AXES, new, strict=True)})


def pseudo_push(particles: DataFrame, n_doubles: int = 17, n_ints: int = 4) -> DataFrame:
    """The benchmark's arithmetic on wide particles (d array of doubles, n array of ints, l long)."""
    d = F.transform(F.slice("d", 1, n_doubles), lambda x, i: F.sqrt(F.abs(x) + F.col("elem_id") + i))
    rest = F.slice("d", n_doubles + 1, F.greatest(F.size("d") - n_doubles, F.lit(0)))
    return particles.withColumns({"d": F.concat(d, rest), "n": F.transform("n", lambda x, i: (F.col("elem_id") + i).cast("int")), "l": F.col("elem_id").cast("long")})


def commit_positions(particles: DataFrame, dim: int = 2) -> DataFrame:
    """Now becomes the wanted position, which becomes 0."""
    zero = {f"t{a}": (F.col(f"t{a}") * 0) for a in AXES[:dim]}
    return particles.withColumns({f"o{a}": F.col(f"t{a}") for a in AXES[:dim]} | zero)


def reflect_at_wall(particles: DataFrame, dim: int) -> DataFrame:
    """Particles that met a wall (face set) stop at the crossing and turn round."""
    hit = F.col("face").isNotNull()
    return particles.withColumns({f"t{a}": F.when(hit, F.col(f"p{a}")).otherwise(F.col(f"t{a}")) for a in AXES[:dim]} | {f"d{a}": F.when(hit, -F.col(f"d{a}")).otherwise(F.col(f"d{a}")) for a in AXES[:dim]})


def remove_at_wall(particles: DataFrame) -> DataFrame:
    return particles.withColumn("elem_id", F.when(F.col("face").isNotNull(), F.lit(REMOVED)).otherwise(F.col("elem_id")).cast("long"))


def displacements(particles: DataFrame, dim: int = 2) -> DataFrame:
    """pid, elem_id and the way wanted."""
    return particles.select("pid", "elem_id", *((F.col(f"t{a}") - F.col(f"o{a}")).alias(f"d{a}") for a in AXES[:dim]))


def particle_map(particles: DataFrame, function, schema: str) -> DataFrame:
    """A user function over Arrow batches of active particles, in parallel (function: RecordBatch to RecordBatch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield function(b)

    return particles.mapInArrow(run, schema)


# rebuild and migration


def rebuild(particles: DataFrame, new_elem: str = "new_elem", added: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """particles in their new elements; those with -1 go, added ones (with elem_id) come. strict: an added one without an element is an error."""
    if added is not None and strict and not added.where(F.col("elem_id") < 0).isEmpty():
        raise ValueError("new particles need an element")
    columns = [c for c in particles.columns if c != new_elem]
    kept = particles.where(F.col(new_elem) >= 0).withColumn("elem_id", F.col(new_elem).cast("long")).select(*columns)
    return kept if added is None else kept.unionByName(added.where(F.col("elem_id") >= 0).select(*columns))


def unsafe_ranks(particles: DataFrame, halo: DataFrame, owners: DataFrame, new_elem: str = "new_elem") -> DataFrame:
    """particles with new_rank: the owner of their new element where that is not safe on their rank, else their rank."""
    joined = particles.join(owners.select(F.col("eid").alias("_e"), "owner"), F.col(new_elem) == F.col("_e"), "left")
    joined = joined.join(halo.select(F.col("rank").alias("_r"), F.col("eid").alias("_h"), "is_safe"), (F.col("rank") == F.col("_r")) & (F.col(new_elem) == F.col("_h")), "left")
    stay = (F.col(new_elem) < 0) | F.coalesce("is_safe", F.lit(False))
    return joined.select(*(F.col(c) for c in particles.columns), F.when(stay, F.col("rank")).otherwise(F.coalesce("owner", F.col("rank"))).cast("int").alias("new_rank"))


def migrate(particles: DataFrame, n_ranks: int, added: DataFrame | None = None, allowed: DataFrame | None = None, place: bool = False) -> DataFrame:
    """particles on their new ranks and in their new elements. allowed (rank, to): which moves may happen, an unlisted one is
    an error. place: also put each rank's particles into partition number rank."""
    if allowed is not None:
        moves = particles.where("rank <> new_rank and new_elem >= 0").select("rank", F.col("new_rank").alias("to")).distinct()
        if not moves.join(allowed, ["rank", "to"], "left_anti").isEmpty():
            raise ValueError("a particle moves to a rank that its own may not send to")
    moved = rebuild(particles.withColumn("rank", F.col("new_rank")).drop("new_rank"), added=added)
    return moved.repartitionById(n_ranks, F.col("rank")) if place else moved


def migrate_particles(particles: DataFrame, halo: DataFrame, owners: DataFrame, n_ranks: int, **how) -> DataFrame:
    """unsafe_ranks and migrate."""
    return migrate(unsafe_ranks(particles, halo, owners), n_ranks, **how)


# counts and metrics


def per_element(particles: DataFrame) -> DataFrame:
    return particles.groupBy("elem_id").agg(F.count(F.lit(1)).alias("n"))


def total_particles(particles: DataFrame, iteration: int) -> DataFrame:
    """iteration, n: particles on all ranks."""
    return particles.agg(F.count(F.lit(1)).alias("n")).select(F.lit(iteration).alias("iteration"), "n")


def particle_lists(particles: DataFrame, elem: DataFrame) -> DataFrame:
    """elem_id, n, offset (exclusive scan by element) of every element, empty ones too; particles(elem_id, pid) ordered by
    (elem_id, pid) then are the lists themselves."""
    counts = elem.select(F.col("eid").alias("elem_id")).join(per_element(particles), "elem_id", "left").select("elem_id", F.coalesce("n", F.lit(0)).alias("n"))
    return running_sum(counts, ["elem_id"], "n", "offset")


def slots(particles: DataFrame) -> DataFrame:
    """particles with slot: place within the element by pid."""
    return place_within(particles, ["elem_id"], ["pid"], "slot")


def sigma_sort(counts: DataFrame, sigma: int) -> DataFrame:
    """counts (elem_id, n) with chunk and row: elements ordered by falling count within chunks of sigma elements."""
    chunk = counts.withColumn("chunk", F.expr(f"elem_id div {sigma}"))
    return chunk.withColumn("row", F.col("chunk") * sigma + F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("n"), "elem_id")) - 1)


def imbalance(particles: DataFrame) -> DataFrame:
    """Greatest, least and mean particles of a rank, whole-numbered mean, and greatest over mean."""
    counts = particles.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    out = counts.agg(F.max("n").alias("max_n"), F.min("n").alias("min_n"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("ranks"))
    return out.select("max_n", "min_n", (F.col("total") / F.col("ranks")).alias("avg_n"), F.expr("total div ranks").alias("avg_int"), (F.col("max_n") * F.col("ranks") / F.col("total")).alias("imbalance"))


def layout_metrics(particles: DataFrame, elem: DataFrame, chunk: int = 32) -> DataFrame:
    """What padding rows of chunks of elements to their longest would cost: elements, empty ones, particles, cells and padded cells."""
    counts = elem.select(F.col("eid").alias("elem_id")).join(per_element(particles), "elem_id", "left").select("elem_id", F.coalesce("n", F.lit(0)).alias("n"))
    rows = numbered(counts.withColumn("fewer", -F.col("n")), ["fewer", "elem_id"], "row").withColumn("slice", F.expr(f"row div {chunk}")).groupBy("slice").agg(F.max("n").alias("width"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("empty"))
    cells = F.sum(F.col("width") * F.col("rows"))
    return rows.agg(F.sum("rows").alias("elements"), F.sum("empty").alias("empty_elements"), F.sum("n").alias("particles"), cells.alias("cells"), (cells - F.sum("n")).alias("padded_cells"))
