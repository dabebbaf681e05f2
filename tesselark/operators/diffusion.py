"""Load balance as joins: a diffusion plan found round by round, and quotas met with cumulative weights in interval joins.

Loads flow along pairs of ranks that share a safe set. In a round all pairs flow at once: from the more loaded rank of a pair to the less
loaded one the difference over one more than the larger of their degrees, so no rank overshoots; a rank above the mean sends. What a rank
sends to another is split over the safe sets that they share by what it has there, and is at most its share of that over the ranks it sends to,
so nothing is given twice. One row a round comes to the driver (the greatest load), whatever the number of ranks, sets and weights.

Quotas are met by place: what a (rank, safe set) has is laid end to end, elements of other ranks first, and so are its quotas by target; where the two
overlap, so much goes there. Counts are split at a quota's border and stay counts; weighted particles are whole, and those that lie
across a border are laid out again with the quotas that are left, up to five times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.operators.balance import safe_sets, weights_from_counts
from tesselark.storage import cut, running_sum

FLOW = ["rank", "sbar", "target", "quota"]


def flows(have: DataFrame, members: DataFrame, mean: float) -> DataFrame:
    """FLOW of one round. have: rank, sbar, n; members: sbar, rank."""
    load = have.groupBy("rank").agg(F.sum("n").alias("load"))
    every = members.select("rank").distinct().join(load, "rank", "left").select(F.col("rank").alias("target"), F.coalesce("load", F.lit(0)).alias("low"))
    sending = have.where("n > 0").join(load.where(F.col("load") > mean), "rank")
    ways = sending.join(members.select("sbar", F.col("rank").alias("target")), "sbar").join(every, "target").where("low < load")
    pairs = ways.groupBy("rank", "target").agg(F.sum("n").alias("shared"), F.max("load").alias("load"), F.max("low").alias("low"))
    out_degree, in_degree = pairs.groupBy("rank").agg(F.count(F.lit(1)).alias("out")), pairs.groupBy("target").agg(F.count(F.lit(1)).alias("in"))
    pairs = pairs.join(out_degree, "rank").join(in_degree, "target")
    flow = F.least(F.floor((F.col("load") - F.col("low")) / (F.greatest("out", "in") + 1)), F.floor(F.col("shared") / F.col("out")))
    pairs = pairs.select("rank", "target", "shared", flow.alias("flow")).where("flow > 0")
    split = F.floor(F.col("flow") * F.col("n") / F.col("shared")).cast("long")
    return ways.select("rank", "sbar", "target", "n").join(pairs, ["rank", "target"]).select("rank", "sbar", "target", split.alias("quota")).where("quota > 0")


def after(have: DataFrame, moved: DataFrame) -> DataFrame:
    """have once FLOW has flowed."""
    gone = moved.select("rank", "sbar", (-F.col("quota")).alias("n"))
    come = moved.select(F.col("target").alias("rank"), "sbar", F.col("quota").alias("n"))
    return have.select("rank", "sbar", "n").unionByName(gone).unionByName(come).groupBy("rank", "sbar").agg(F.sum("n").alias("n"))


def netted(moved: DataFrame) -> DataFrame:
    """FLOW with what goes to and fro between two ranks within a set taken off."""
    signed = moved.select("sbar", F.least("rank", "target").alias("a"), F.greatest("rank", "target").alias("b"), F.when(F.col("rank") < F.col("target"), F.col("quota")).otherwise(-F.col("quota")).alias("q"))
    net = signed.groupBy("sbar", "a", "b").agg(F.sum("q").alias("q")).where("q <> 0")
    forth = F.col("q") > 0
    return net.select(F.when(forth, F.col("a")).otherwise(F.col("b")).alias("rank"), "sbar", F.when(forth, F.col("b")).otherwise(F.col("a")).alias("target"), F.abs("q").alias("quota"))


def diffusion_plan(weight: DataFrame, members: DataFrame, n_ranks: int, tol: float = 1.05, rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """FLOW of all rounds, and what ranks have in the end (rank, sbar, n). weight: rank, sbar, n; members: sbar, rank, the ranks where a set is safe. It
    ends when no rank is above tol times the mean, when nothing flows, or after so many rounds. A plan may pass load on: what a rank gives in
    a later round it may have got in an earlier one."""
    have, members = cut(weight.select("rank", "sbar", F.col("n").cast("long").alias("n"))), cut(members.select("sbar", "rank").distinct())
    total = have.agg(F.sum("n")).first()[0] or 0
    mean, moves = total / max(n_ranks, 1), []
    for _ in range(rounds):
        most = have.groupBy("rank").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= tol * mean:
            break
        moved = cut(flows(have, members, mean))
        if moved.isEmpty():
            break
        moves.append(moved)
        have = cut(after(have, moved))
    empty = have.select("rank", "sbar", F.col("rank").alias("target"), F.col("n").alias("quota")).limit(0)
    return netted(reduce(DataFrame.unionByName, moves, empty)), have


def _laid_out(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """rows with first and last: the stretch of their value within their group."""
    placed = running_sum(rows, [*group, *order], value, "_before")
    start = placed.groupBy(*group).agg(F.min("_before").alias("_start"))
    return placed.join(start, group).withColumn("first", F.col("_before") - F.col("_start")).withColumn("last", F.col("first") + F.col(value)).drop("_before", "_start")


def _spans(quotas: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Quotas laid end to end by target within (rank, sbar); names: their first and last places."""
    out = _laid_out(quotas.select(*FLOW).where("quota > 0"), ["rank", "sbar"], ["target"], "quota")
    return out.select("rank", "sbar", "target", "quota", F.col("first").alias(names[0]), F.col("last").alias(names[1]))


def split_counts(counts: DataFrame, quotas: DataFrame) -> DataFrame:
    """rank, sbar, eid, target, n: counts (rank, sbar, eid, n, is_core) with what goes to each target; what stays has the rank itself as target."""
    laid = cut(_laid_out(counts.where("n > 0"), ["rank", "sbar"], ["is_core", "eid"], "n"))
    spans = cut(_spans(quotas, ("q0", "q1")))
    over = F.least("last", "q1") - F.greatest("first", "q0")
    gone = cut(laid.join(spans, ["rank", "sbar"]).where((F.col("first") < F.col("q1")) & (F.col("q0") < F.col("last"))).select("rank", "sbar", "eid", "target", over.alias("n")))
    left = laid.join(gone.groupBy("rank", "sbar", "eid").agg(F.sum("n").alias("_gone")), ["rank", "sbar", "eid"], "left")
    stays = left.select("rank", "sbar", "eid", F.col("rank").alias("target"), (F.col("n") - F.coalesce("_gone", F.lit(0))).alias("n")).where("n > 0")
    return gone.unionByName(stays)


def partition_counts(counts: DataFrame, halo: DataFrame, owners: DataFrame, n_ranks: int, tol: float = 1.05, rounds: int = 40) -> DataFrame:
    """rank, sbar, eid, target, n from (rank, eid, n): counts in balance, without a row a particle. Counts of elements that are safe nowhere stay (sbar null)."""
    sets = cut(safe_sets(halo))
    members = sets.select("sbar", F.explode("ranks").alias("rank")).distinct()
    weight = cut(weights_from_counts(counts, sets))
    quotas, _ = diffusion_plan(weight, members, n_ranks, tol, rounds)
    named = counts.join(sets.select("eid", "sbar"), "eid", "left").join(owners.select("eid", "owner"), "eid", "left")
    rows = named.select("rank", "sbar", "eid", F.col("n").cast("long").alias("n"), F.coalesce(F.col("owner") == F.col("rank"), F.lit(False)).alias("is_core"))
    # a quota may pass on what came from elsewhere; no more is taken than a rank has of its own
    safe, free = rows.where("sbar is not null"), rows.where("sbar is null and n > 0")
    out = split_counts(safe, quotas)
    return out.unionByName(free.select("rank", "sbar", "eid", F.col("rank").alias("target"), "n"))


def select_weighted(particles: DataFrame, quotas: DataFrame, sweeps: int = 5) -> DataFrame:
    """pid, target: particles (pid, rank, sbar, is_core, weight > 0) that fill the quotas by place, those of other ranks' elements first, then by pid. A particle
    is whole: one that lies across a border waits for the next sweep, in which the rest is laid out again with the quotas that are left. What no sweep
    places stays and is not returned."""
    rest, left, out = cut(particles.select("pid", "rank", "sbar", "is_core", F.col("weight").cast("long").alias("weight"))), cut(quotas.select(*FLOW)), []
    for _ in range(sweeps):
        if left.isEmpty():
            break
        laid, spans = _laid_out(rest, ["rank", "sbar"], ["is_core", "pid"], "weight"), _spans(left, ("q0", "q1"))
        fits = cut(laid.join(spans, ["rank", "sbar"]).where((F.col("first") >= F.col("q0")) & (F.col("last") <= F.col("q1"))).select("pid", "rank", "sbar", "target", "weight"))
        if fits.isEmpty():
            break
        out.append(fits.select("pid", "target"))
        rest = cut(rest.join(fits.select("pid"), "pid", "left_anti"))
        used = fits.groupBy("rank", "sbar", "target").agg(F.sum("weight").alias("_used"))
        left = cut(left.join(used, ["rank", "sbar", "target"], "left").select("rank", "sbar", "target", (F.col("quota") - F.coalesce("_used", F.lit(0))).alias("quota")).where("quota > 0"))
    return reduce(DataFrame.unionByName, out, rest.select("pid", F.col("rank").alias("target")).limit(0))
