"""Ring points, and an element's vertices and sides, go to no machine as a whole."""

import re

from conftest import DATA

from tesselark.operators import mesh as M, scatter as SC
from tesselark.plans import catalogue
from tesselark.plans import tables as T


def joins(df):
    """Kind and first key of the planned joins, the last one first."""
    return re.findall(r"(\w+Join) \[(\w+)#", df._jdf.queryExecution().sparkPlan().toString())


def test_ring_points_are_not_broadcast(spark, monkeypatch):
    """They are many rows a vertex, which Spark takes for as small as the vertices."""
    walked, search = [], SC.search_2d
    monkeypatch.setattr(SC, "search_2d", lambda pts, walk, **how: walked.append(pts) or search(pts, walk, **how))
    m = T.mesh(spark, DATA)
    out = SC.ring_map(m, SC.ring_points(m, catalogue.GYRO))
    assert joins(walked[0])[0] == ("SortMergeJoin", "vid")
    assert joins(out)[0][0] == "SortMergeJoin"
    assert joins(SC.ring_weights(T.particles(spark, DATA), m, catalogue.GYRO).select("vid", "ring", "w"))[0][0] == "SortMergeJoin"


def test_sides_are_not_broadcast(spark):
    """Neither an element's sides, of which there are several a row of the mesh, nor their numbers."""
    found = [kind for kind, key in joins(M.walk_table(T.tri_lattice(spark, 10, T.LENGTH))) if key == "k0"]
    assert found == ["SortMergeJoin"] * 2


def test_ring_map_takes_the_walk_table_at_hand(spark):
    m = T.mesh(spark, DATA)
    pts = SC.ring_points(m, catalogue.GYRO)
    one, two = (sorted(map(tuple, SC.ring_map(m, pts, **how).collect())) for how in ({}, {"walk": M.walk_table(m).cache()}))
    assert one and one == two


def test_app_builds_one_walk_table_and_one_map(spark, monkeypatch):
    built, table = [], M.walk_table
    for module in (M, SC):
        monkeypatch.setattr(module, "walk_table", lambda mesh: built.append(1) or table(mesh))
    maps, ring_map = [], SC.ring_map
    monkeypatch.setattr(SC, "ring_map", lambda *a, **b: maps.append(1) or ring_map(*a, **b))
    catalogue.QUERIES["mini_app_2d"](spark, DATA)
    assert (len(built), len(maps)) == (1, 1)
