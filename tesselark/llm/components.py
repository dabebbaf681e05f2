"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.llm.common import discard, written


def _least(edges: DataFrame) -> DataFrame:
    """u, v in both directions with m, the least of u and all its neighbours. The minimum is aggregated before the shuffle."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u")


def _stars(edges: DataFrame) -> bool:
    """Whether each b has one a and is no a itself, so that every a is the least id of its component. One shuffle, aggregated before it."""
    ends = edges.select(F.col("a").alias("id"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("id"), F.lit(1).alias("up")))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("n"), F.min("up").alias("least"))
    return not nodes.agg(F.expr("bool_or(n > 1 or (n = 1 and least = 0))")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id that is reachable) of every id in edges (a, b long; a differs from b).

    Each round writes its edges to the shared folder, so lineage stays short; the number of rounds grows with the logarithm of
    the longest path, and edges that are stars already take none. One row a round comes to the driver at most.
    """
    state = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not _stars(state):
        large = _least(state).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        near = _least(large)
        small = near.where("v < u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(near.where("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")))
        after_state = written(small.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(state)
        state = after_state
    return state.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).unionByName(state.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
