"""Rank sets as bitmaps against the same as rows (rank, element), for few ranks and for 256 that own equally many events."""

import pytest
from conftest import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselark.operators import balance, partition as PA, rank_bits as B
from tesselark.plans import tables as T
from tesselark.storage import cut


def weighted(spark, n_ranks: int):
    """Owners by the events before each element."""
    load = T.mesh(spark, DATA).elem.select("eid").join(T.particles(spark, DATA).groupBy(F.col("elem_id").alias("eid")).agg(F.count(F.lit(1)).alias("n")), "eid", "left").fillna(0)
    before = F.coalesce(F.sum("n").over(Window.orderBy("eid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut(load.select("eid", F.least(F.lit(n_ranks - 1), (before * n_ranks / T.size(spark, DATA).events).cast("int")).alias("owner")))


def rows(df):
    return sorted(tuple(r) for r in df.select("rank", "eid", "is_core", "is_safe").collect())


@pytest.mark.parametrize("buffer, safe", [("FULL", "BFS"), ("BFS", "FULL"), ("BFS", "BFS"), ("BFS", "NONE"), ("MINIMUM", "FULL"), ("MINIMUM", "MINIMUM")])
def test_method_matrix(spark, buffer, safe):
    spec = PA.Input(T.mesh(spark, DATA), weighted(spark, 4), 4, buffer_method=PA.Method.parse(buffer), safe_method=PA.Method.parse(safe), buffer_layers=2, safe_layers=1)
    assert rows(B.halo_of(B.build_bits(spec), 4)) == rows(PA.build(spec).halo)


@pytest.mark.parametrize("safe, bridge", [("BFS", 0), ("FULL", 1)])
def test_256_ranks(spark, safe, bridge):
    spec = PA.Input(T.mesh(spark, DATA), weighted(spark, 256), 256, buffer_method=PA.Method.BFS, safe_method=PA.Method.parse(safe), buffer_layers=2, safe_layers=1, bridge_dim=bridge)
    bits, plain = cut(B.build_bits(spec)), PA.build(spec)
    assert bits.count() == plain.owners.count() and len(B.words("h", 256)) == 4
    assert rows(B.halo_of(bits, 256)) == rows(plain.halo)
    ours, theirs = B.safe_sets_of(bits, 256), balance.safe_sets(plain.halo)
    sets = lambda df: {r["eid"]: tuple(r["ranks"]) for r in df.collect()}
    assert sets(ours) == sets(theirs)
    assert ours.select("sbar").distinct().count() == theirs.select("sbar").distinct().count() == ours.agg(F.max("sbar")).first()[0] + 1


def test_errors_and_edges(spark):
    m, owners = T.mesh(spark, DATA), T.owners(spark, DATA)
    with pytest.raises(ValueError, match="owner"):
        B.build_bits(PA.Input(m, owners.withColumn("owner", F.lit(9)), 4))
    with pytest.raises(ValueError, match="layers"):
        B.build_bits(PA.Input(m, owners, 4, buffer_method=PA.Method.BFS, buffer_layers=1, safe_layers=2))
    bits = spark.range(1).select(*B.bit_of(F.lit(63), "b", 65), *B.bit_of(F.lit(64), "c", 65), *B.all_ranks("d", 65))
    assert [list(r) for r in bits.select(B.ranks_of("b", 65), B.ranks_of("c", 65), B.ranks_of("d", 65)).first()] == [[63], [64], list(range(65))]
