"""Particle load balancing: particles may only go where their element is safe.

An element's *safe set* is the set of ranks on which it is safe. Weights are particles by (rank, safe set); a plan says how
many particles of a safe set a rank gives to another; then particles are chosen, those outside the rank's core first.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselark.operators.particles import migrate, unsafe_ranks
from tesselark.storage import cut, fetched, place_within


def safe_sets(halo: DataFrame) -> DataFrame:
    """eid, ranks (sorted) and sbar, one id for equal sets of ranks. Distinct sets are few; only they are numbered in one task."""
    each = halo.where("is_safe").groupBy("eid").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    ids = each.select("ranks").distinct().withColumn("sbar", F.row_number().over(Window.orderBy("ranks")) - 1)
    return each.join(ids, "ranks").select("eid", "ranks", "sbar")


def weights(particles: DataFrame, sets: DataFrame, new_elem: str = "new_elem", new_rank: str = "new_rank") -> DataFrame:
    """rank, sbar, n: particles by the rank they will be on (forced movers count at their receiver) and their element's set."""
    return particles.where(F.col(new_elem) >= 0).join(sets.select("eid", "sbar"), F.col(new_elem) == F.col("eid")).groupBy(F.col(new_rank).alias("rank"), "sbar").agg(F.count(F.lit(1)).alias("n"))


def weights_from_counts(counts: DataFrame, sets: DataFrame) -> DataFrame:
    """The same from (rank, eid, n)."""
    return counts.join(sets.select("eid", "sbar"), "eid").groupBy("rank", "sbar").agg(F.sum("n").alias("n"))


def plan(weight: DataFrame, sets: DataFrame, n_ranks: int, tol: float = 1.05, step: float = 0.5, rounds: int = 100) -> list[tuple[int, int, int, int]]:
    """(rank, sbar, target, quota): repeated diffusion from loaded ranks to less loaded ones of the same set. Runs on the driver over
    one number a (rank, set); deterministic."""
    have: dict[tuple[int, int], int] = {(r["rank"], r["sbar"]): r["n"] for r in fetched(weight, "weights by rank and safe set")}
    members = {r["sbar"]: list(r["ranks"]) for r in fetched(sets.select("sbar", "ranks").distinct(), "safe sets")}
    load = [sum(n for (r, _), n in have.items() if r == k) for k in range(n_ranks)]
    mean = sum(load) / max(n_ranks, 1)
    moves: dict[tuple[int, int, int], int] = defaultdict(int)
    for _ in range(rounds):
        if max(load, default=0) <= tol * mean:
            break
        before = sum(moves.values())
        for r in sorted(range(n_ranks), key=lambda k: (-load[k], k)):
            for (_, s), n in sorted(((k, n) for k, n in have.items() if k[0] == r and n > 0), key=lambda x: (-x[1], x[0])):
                for to in sorted((k for k in members.get(s, []) if load[k] < load[r]), key=lambda k: (load[k], k)):
                    n = min(have[r, s], int((load[r] - load[to]) * step))
                    if load[r] <= mean or n <= 0:
                        continue
                    have[r, s] -= n
                    load[r], load[to] = load[r] - n, load[to] + n
                    moves[r, s, to] += n
        if sum(moves.values()) == before:
            break
    return [(r, s, to, n) for (r, s, to), n in sorted(moves.items())]


def select_particles(particles: DataFrame, sets: DataFrame, quotas: DataFrame, owners: DataFrame, new_elem: str = "new_elem", new_rank: str = "new_rank") -> DataFrame:
    """particles with new_rank as the plan wants: within (rank, set), those of other ranks' elements first, then by pid, fill
    the targets' quotas in order of target. quotas: rank, sbar, target, quota (bounded by ranks x sets)."""
    marked = particles.join(sets.select(F.col("eid").alias("_s"), "sbar"), F.col(new_elem) == F.col("_s"), "left")
    marked = marked.join(owners.select(F.col("eid").alias("_o"), "owner"), F.col(new_elem) == F.col("_o"), "left")
    marked = cut(marked.withColumn("_stays", (F.col(new_rank) == F.col("rank")) & F.col("sbar").isNotNull()))
    staying = marked.where("_stays").withColumn("_core", (F.col("owner") == F.col("rank")).cast("int"))
    placed = place_within(staying.select("pid", new_rank, "sbar", "_core"), [new_rank, "sbar"], ["_core", "pid"], "_place")
    upto = Window.partitionBy("rank", "sbar").orderBy("target")
    spans = quotas.withColumn("last", F.sum("quota").over(upto)).groupBy(F.col("rank").alias("_rank"), F.col("sbar").alias("_sbar")).agg(F.array_sort(F.collect_list(F.struct("last", "target"))).alias("spans"))
    placed = placed.join(spans, (F.col(new_rank) == F.col("_rank")) & (F.col("sbar") == F.col("_sbar")))
    target = F.get(F.filter("spans", lambda x: x["last"] > F.col("_place")), 0)["target"]
    chosen = placed.select("pid", target.alias("_target")).where("_target is not null")
    out = [c for c in particles.columns if c != new_rank]
    return marked.join(chosen, "pid", "left").select(*(F.col(c) for c in out), F.coalesce("_target", F.col(new_rank)).cast("int").alias(new_rank))


def repartition(particles: DataFrame, halo: DataFrame, owners: DataFrame, n_ranks: int, tol: float = 1.05, step: float = 0.5) -> DataFrame:
    """particles with new_rank: where they must go, and beyond that the plan."""
    forced = unsafe_ranks(particles, halo, owners)
    if n_ranks == 1:
        return forced
    sets = safe_sets(halo)
    moves = plan(weights(forced, sets), sets, n_ranks, tol, step)
    if not moves:
        return forced
    quotas = particles.sparkSession.createDataFrame(moves, "rank int, sbar int, target int, quota long")
    return select_particles(forced, sets, quotas, owners)


def migrate_balanced(particles: DataFrame, halo: DataFrame, owners: DataFrame, n_ranks: int, tol: float = 1.05, step: float = 0.5, **how) -> DataFrame:
    """unsafe_ranks, repartition and migrate."""
    return migrate(repartition(particles, halo, owners, n_ranks, tol, step), n_ranks, **how)


def partition_counts(counts: DataFrame, halo: DataFrame, owners: DataFrame, n_ranks: int, **how) -> DataFrame:
    """pid, elem_id, rank, new_rank from (rank, eid, n): one particle a count, balanced."""
    each = counts.where("n > 0").select("rank", F.col("eid").alias("elem_id"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    each = each.select(F.xxhash64("rank", "elem_id", "k").alias("pid"), "elem_id", F.col("elem_id").alias("new_elem"), "rank")
    return repartition(each, halo, owners, n_ranks, **how)
