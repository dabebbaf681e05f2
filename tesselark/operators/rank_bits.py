"""Sets of ranks as bitmaps: one row an element, one bit a rank.

Layers grow over bridge entities by bit_or, and only elements that a rank newly reached go on; what is stored grows with the elements and not with
elements x ranks. Bits lie in 64-bit words b0, b1, ..; rank r is bit r % 64 of word r div 64. Equal bitmaps are equal sets of ranks, so safe sets are
the distinct bitmaps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.operators.partition import Input, Method, Ownership, bridge, owners_by_class
from tesselark.storage import cut, numbered


def n_words(n_ranks: int) -> int:
    return max(1, -(-n_ranks // 64))


def words(prefix: str, n_ranks: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(n_words(n_ranks))]


def bit_of(rank: Column, prefix: str, n_ranks: int) -> list[Column]:
    """The words of the set that holds one rank."""
    return [F.when(F.floor(rank / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (rank % 64).cast("int"))).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(words(prefix, n_ranks))]


def all_ranks(prefix: str, n_ranks: int) -> list[Column]:
    full = [(1 << min(64, n_ranks - 64 * k)) - 1 for k in range(n_words(n_ranks))]
    return [F.lit(x if x < 1 << 63 else x - (1 << 64)).cast("long").alias(w) for x, w in zip(full, words(prefix, n_ranks), strict=True)]


def ranks_of(prefix: str, n_ranks: int) -> Column:
    """The ranks of a row's set, in order."""

    def of_word(k: int, word: str) -> Column:
        places = F.sequence(F.lit(0), F.lit(min(64, n_ranks - 64 * k) - 1))
        return F.transform(F.filter(places, lambda r: F.getbit(F.col(word), r) == 1), lambda r: r + 64 * k)

    return F.concat(*(of_word(k, w) for k, w in enumerate(words(prefix, n_ranks))))


def _any(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(w) != 0 for w in names))


def _union(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(*(F.bit_or(w).alias(w) for w in names))


def spread(sets: DataFrame, links: DataFrame, names: list[str]) -> DataFrame:
    """eid and the union of the sets of all elements that share a bridge entity with it. The words are added up before each of the two shuffles."""
    return _union(_union(sets.join(links, "eid"), "ent", names).join(links, "ent"), "eid", names)


def owner_bits(owners: DataFrame, n_ranks: int, prefix: str = "b") -> DataFrame:
    return owners.select("eid", *bit_of(F.col("owner"), prefix, n_ranks))


def reached(owners: DataFrame, links: DataFrame, layers: int, n_ranks: int) -> list[DataFrame]:
    """For 0, 1, .. layers: eid, b0, ..: the ranks that have an element of their own within that many layers."""
    names = words("b", n_ranks)
    seen = cut(owner_bits(owners, n_ranks))
    out, frontier = [seen], seen
    for _ in range(layers):
        arrived = spread(frontier, links, names).select("eid", *(F.col(w).alias(f"_{w}") for w in names))
        both = cut(seen.join(arrived, "eid", "left").select("eid", *(F.col(w).bitwiseOR(F.coalesce(f"_{w}", F.lit(0).cast("long"))).alias(w) for w in names), *(F.coalesce(f"_{w}", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(w)).alias(f"_{w}") for w in names)))
        seen = both.select("eid", *names)
        frontier = both.where(_any([f"_{w}" for w in names])).select("eid", *(F.col(f"_{w}").alias(w) for w in names))
        out.append(seen)
    return out


def held_bits(layer: DataFrame, owners: DataFrame, n_ranks: int) -> DataFrame:
    """owner, b0, ..: the ranks that hold a part, those that reached an element of it; a part comes as a whole."""
    return _union(layer.join(owners, "eid"), "owner", words("b", n_ranks))


def inward_bits(owners: DataFrame, held: DataFrame, links: DataFrame, layers: int, n_ranks: int) -> DataFrame:
    """eid, b0, ..: the ranks on which an element lies more than ``layers`` away from all that the rank does not hold, and its owner."""
    names = words("b", n_ranks)
    have = cut(owners.join(held, "owner"))
    lacks = have.select("eid", *(F.bitwise_not(w).bitwiseAND(full).alias(w) for w, full in zip(names, all_ranks("x", n_ranks), strict=True))).where(_any(names))
    unsafe, front = None, lacks
    for _ in range(layers):
        near = spread(front, links, names).select("eid", *(F.col(w).alias(f"_{w}") for w in names))
        front = cut(have.join(near, "eid").select("eid", *(F.col(w).bitwiseAND(F.col(f"_{w}")).alias(w) for w in names)).where(_any(names)))
        unsafe = front if unsafe is None else cut(_union(unsafe.unionByName(front), "eid", names))
    own = bit_of(F.col("owner"), "x", n_ranks)
    if unsafe is None:
        return have.select("eid", *names)
    joined = have.join(unsafe.select("eid", *(F.col(w).alias(f"_{w}") for w in names)), "eid", "left")
    return joined.select("eid", *(F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_{w}", F.lit(0).cast("long")))).bitwiseOR(o).alias(w) for w, o in zip(names, own, strict=True)))


def build_bits(spec: Input) -> DataFrame:
    """eid, owner, h0, .. (ranks that hold the element) and s0, .. (ranks on which it is safe): partition.build() with one row an element."""
    n, names = spec.n_ranks, words("b", spec.n_ranks)
    owners = owners_by_class(spec.mesh.elem, spec.partition) if spec.ownership is Ownership.CLASSIFICATION else spec.partition
    owners = cut(owners.select("eid", F.col("owner").cast("int").alias("owner")))
    if not owners.where(f"owner is null or owner < 0 or owner >= {n}").isEmpty():
        raise ValueError("an element has no owner among the ranks")
    links = bridge(spec.mesh, spec.bridge_dim)
    buffer_layers = spec.buffer_layers if spec.buffer_method is Method.BFS else 0
    safe_layers = spec.safe_layers if spec.safe_method is Method.BFS else 0
    if spec.buffer_method is Method.BFS and safe_layers > buffer_layers:
        raise ValueError("buffer layers must not be fewer than safe layers")
    layers = reached(owners, links, max(buffer_layers, safe_layers), n)
    parts = owners.select("owner").distinct().select("owner", *all_ranks("b", n)) if spec.buffer_method is Method.FULL else held_bits(layers[buffer_layers], owners, n)
    held = owners.join(parts, "owner").select("eid", "owner", *(F.col(w).alias(f"h{k}") for k, w in enumerate(names)))
    if spec.safe_method is Method.NONE:
        return held.select("*", *(F.lit(0).cast("long").alias(f"s{k}") for k in range(len(names))))
    if spec.safe_method is Method.FULL:
        safe = inward_bits(owners, parts, links, spec.safe_layers, n) if spec.buffer_method is Method.BFS else held.select("eid", *(F.col(f"h{k}").alias(w) for k, w in enumerate(names)))
    else:
        safe = layers[safe_layers]
    return held.join(safe.select("eid", *(F.col(w).alias(f"s{k}") for k, w in enumerate(names))), "eid")


def halo_of(bits: DataFrame, n_ranks: int) -> DataFrame:
    """rank, eid, is_core, is_safe: the rows that the bitmaps stand for. A rank may only be safe where it holds the element."""
    safe = reduce(lambda a, b: a | b, ((F.floor(F.col("rank") / 64) == k) & (F.getbit(F.col(w), (F.col("rank") % 64)) == 1) for k, w in enumerate(words("s", n_ranks))))
    rows = bits.select("*", F.explode(ranks_of("h", n_ranks)).alias("rank"))
    return rows.select("rank", "eid", (F.col("rank") == F.col("owner")).alias("is_core"), safe.alias("is_safe"))


def safe_sets_of(bits: DataFrame, n_ranks: int) -> DataFrame:
    """eid, ranks and sbar, a number for each distinct set of ranks on which elements are safe, in the order of their words; elements safe nowhere have none."""
    names = words("s", n_ranks)
    some = bits.where(_any(names)).select("eid", *names)
    ids = numbered(some.select(*names).distinct(), names, "sbar")
    return some.join(ids, names).select("eid", ranks_of("s", n_ranks).alias("ranks"), F.col("sbar").cast("int").alias("sbar"))
