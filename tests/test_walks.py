"""Walks, sources and loops that SQL does not express."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tesselark.operators import balance, mesh as M, particles, walk as W
from tesselark.plans import catalogue
from tesselark.plans import tables as T


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_walk_3d_ends_in_an_element_that_holds_the_target(spark):
    p, walk = catalogue._particles_3d(spark, DATA), M.walk_table(T.tets(spark, DATA))
    out = W.trace(p, walk, 3).where("elem_id >= 0").select("pid", "elem_id").join(p.drop("elem_id"), "pid")
    ends = out.withColumns({f"o{a}": F.col(f"t{a}") for a in "xyz"})
    assert out.count() > 100
    assert W.check_initial_parents(ends, walk, 3, 1e-9).where("not ok").count() == 0


def test_segment_walk_agrees_with_coordinates(spark):
    p, walk = catalogue._particles_3d(spark, DATA), M.walk_table(T.tets(spark, DATA))
    a = W.trace(p, walk, 3).select("pid", "elem_id")
    b = W.search_3d(p, walk, tol=1e-9).select("pid", F.col("elem_id").alias("other"))
    both = a.join(b, "pid")
    assert both.where("elem_id >= 0 and elem_id <> other").count() <= both.count() // 100


def test_crossings_lie_on_the_wall(spark):
    out = W.trace(T.particles(spark, DATA), M.walk_table(T.mesh(spark, DATA)), 2, crossing=True, tol=0.0).where("face is not null")
    on = F.least(F.abs("px"), F.abs("py"), F.abs(F.col("px") - T.LENGTH), F.abs(F.col("py") - T.LENGTH))
    assert out.count() > 50
    assert out.where(on > 1).count() == 0


def test_balance_keeps_every_particle_and_lowers_the_load(spark):
    """Of particles that stay in the domain, against the load once those have moved whose new element is not safe where they are."""
    parts, ranked = catalogue._parts(spark, DATA), T.ranked(spark, DATA)
    out = balance.repartition(ranked, parts.halo, parts.owners, T.RANKS, tol=1.05)
    assert out.select("pid").distinct().count() == T.particles(spark, DATA).count()
    inside = ranked.where("new_elem >= 0").select("pid")
    most = lambda df: df.join(inside, "pid").groupBy("new_rank").count().agg(F.max("count")).first()[0]
    assert most(out) <= most(particles.unsafe_ranks(ranked, parts.halo, parts.owners))


@pytest.mark.parametrize("name", ["particle_uniform_distribution", "particle_gaussian_distribution", "particle_exponential_distribution", "particle_clustered_distribution"])
def test_distributions_place_every_particle(spark, name):
    out = catalogue.QUERIES[name](spark, DATA)
    assert out.agg(F.sum("n")).first()[0] == T.size(spark, DATA).events


def test_gyro_app_runs(spark):
    out = catalogue.QUERIES["mini_app_2d"](spark, DATA)
    assert out.count() == (T.size(spark, DATA).n + 1) ** 2


@pytest.mark.parametrize("limit", [1500, 3500, 1_000_000])
def test_recursive_walk_is_whole_under_any_row_limit(spark, limit):
    """No hop, a few, or all fit into the recursion; the rest of the ways is walked all the same."""
    name = "spark.sql.cteRecursionRowLimit"
    was = spark.conf.get(name)
    spark.conf.set(name, str(limit))
    try:
        assert rows(catalogue.QUERIES["walk2d_recursive"](spark, DATA)) == rows(catalogue.QUERIES["walk2d_fused"](spark, DATA))
    finally:
        spark.conf.set(name, was)
