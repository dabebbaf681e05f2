"""Walks inside tiles against the same hop by hop: each rule, one tile and many, crowded tiles, limits and awkward particles."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tesselark.operators import mesh as M, tile_walk as TW, walk as W
from tesselark.operators.crossings import crossing_log, path_deposits
from tesselark.plans import catalogue
from tesselark.plans import tables as T

PLANE = "pid long, elem_id long, ox long, oy long, tx long, ty long"


def found(df):
    digits = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(digits, r)) for r in df.collect()), key=str)


def cells(spark, dim):
    """Particles and the stored walk table of a mesh of several tiles of 60 elements."""
    m = T.mesh(spark, DATA) if dim == 2 else T.tets(spark, DATA)
    p = T.particles(spark, DATA) if dim == 2 else catalogue._particles_3d(spark, DATA)
    return W.cut(p.where("pid % 11 = 0").select("pid", "elem_id", *(f"{k}{a}" for k in "ot" for a in "xyz"[:dim]))), W.cut(M.walk_table(m))


RULES = {
    "coordinates": (2, {}, {"tol": 0.0}), "crossing": (2, {"crossing": True}, {"tol": 0.0}), "crossing, tol": (2, {"crossing": True}, {"tol": 1e-8}), "limit": (2, {}, {"looplimit": 3, "tol": 0.0}),
    "limit kept": (2, {"crossing": True}, {"looplimit": 2, "remove_at_limit": False}), "space": (3, {}, {"tol": 0.0}), "ray": (3, {"crossing": True}, {}), "segment": (3, {"crossing": True, "bounded": True, "handler": W.leave_at_wall}, {"tol": 1e-9, "strict": True}),
    "first": (3, {"crossing": "first", "handler": W.remove_at_wall_or_leak}, {"strict": True}), "wall by coordinates": (2, {"handler": W.stop_at_wall}, {}),
}


@pytest.mark.parametrize(("name", "kind"), [*((name, "long") for name in RULES), ("coordinates", "double"), ("crossing", "double")])
def test_equals_the_walk_by_hops(spark, monkeypatch, name, kind):
    dim, rule, how = RULES[name]
    p, walk = cells(spark, dim)
    p = p.select("pid", "elem_id", *(F.col(c).cast(kind).alias(c) for c in p.columns[2:]))
    want = found(W.trace_by_hops(p, walk, dim, **rule, **how))
    monkeypatch.setattr(W, "trace_by_hops", None)
    assert found(W.trace(p, walk, dim, **rule, **how)) == want
    monkeypatch.setattr(TW, "ELEMENTS_AT_ONCE", 60)
    monkeypatch.setattr(TW, "PARTICLES_AT_ONCE", 20)
    assert found(W.trace(p, walk, dim, **rule, **how)) == want


@pytest.mark.parametrize("at_once", [60, None])
def test_deposits_equal_those_of_the_log(spark, at_once):
    p, walk = W.cut(T.particles(spark, DATA)), W.cut(M.walk_table(T.mesh(spark, DATA)))
    want = {r[0]: r[1] for r in path_deposits(crossing_log(p, walk).where("t1 - t0 > 1e-12"), p, "val").collect()}
    got = {r[0]: r[1] for r in TW.deposits_in_tiles(p, walk, "val", least=1e-12, elements_at_once=at_once).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_jobs_do_not_grow_with_the_sides_crossed(spark, monkeypatch):
    """A mesh with four times as many sides along each way takes no more stored steps."""
    stored, cut = [], TW.cut
    monkeypatch.setattr(TW, "cut", lambda df: stored.append(1) or cut(df))
    steps = []
    for n in (10, 40):
        stored.clear()
        out = W.trace(T.particles(spark, DATA, n), M.walk_table(T.tri_lattice(spark, n, T.LENGTH)), 2, crossing=True, tol=0.0)
        steps.append((len(stored), out.agg(F.max("hops")).first()[0]))
    assert steps[0][0] == steps[1][0] and steps[1][1] > 3 * steps[0][1]


@pytest.mark.parametrize("how", [{"tol": 0.0}, {"crossing": True, "bounded": True, "handler": W.leave_at_wall, "tol": 1e-9}])
def test_broadcasts_in_space_do_not_grow_with_the_sides_crossed(spark, monkeypatch, how):
    """By coordinates and by segment: a finer mesh of tetrahedra is stored, and sent through the driver, no more often."""
    done, cut, small = [], TW.cut, TW.small
    monkeypatch.setattr(TW, "cut", lambda df: done.append("cut") or cut(df))
    monkeypatch.setattr(TW, "small", lambda df: done.append("small") or small(df))
    steps, spot = [], lambda k: F.expr(f"(id * {k} + id * id * 13) % 598 + 1")
    for n in (2, 10):
        done.clear()
        mesh = M.tet_lattice(spark, n, 600)
        p = spark.range(100).select("id", *(spot(k).alias(f"o{a}") for a, k in zip("xyz", (31, 57, 83), strict=True)), *(spot(k).alias(f"t{a}") for a, k in zip("xyz", (91, 17, 43), strict=True)))
        found = M.locate(p.select(F.col("id").alias("pid"), *(F.col(f"o{a}").alias(a) for a in "xyz")), mesh, 300.0)
        p = p.join(found.select(F.col("pid").alias("id"), F.col("eid").alias("elem_id")), "id").withColumnRenamed("id", "pid")
        out = W.trace(p, M.walk_table(mesh), 3, **how)
        steps.append((tuple(done), out.agg(F.max("hops")).first()[0]))
    assert steps[0][0] == steps[1][0] and steps[1][1] > 2 * steps[0][1]


def test_rounds_along_the_edge_of_two_tiles(spark, monkeypatch):
    """A tile that also holds its neighbours' nearest elements does not hand a way to and fro: fewer rounds, the same ends."""
    rounds, meet = [], TW.Tiles.meet
    monkeypatch.setattr(TW.Tiles, "meet", lambda *a: rounds.append(1) or meet(*a))
    monkeypatch.setattr(TW, "ELEMENTS_AT_ONCE", 300)
    p, walk, got = T.particles(spark, DATA, 25), W.cut(M.walk_table(T.tri_lattice(spark, 25, T.LENGTH))), []
    for layers in (0, TW.LAYERS):
        monkeypatch.setattr(TW, "LAYERS", layers)
        rounds.clear()
        got.append((found(W.trace(p, walk, 2, tol=0.0, check_parents=False)), len(rounds)))
    assert got[0][0] == got[1][0] and got[1][1] < got[0][1]


@pytest.mark.parametrize("at_once", [20, 1 << 17])
def test_awkward_particles(spark, at_once):
    """At rest, in an unknown element or none, outside the own element, without a place, without a pid."""
    walk = W.cut(M.walk_table(T.tri_lattice(spark, 10, T.LENGTH)))
    rows = [(1, 0, 5, 5, 5, 5), (2, 999_999, 1, 2, 3, 4), (3, -1, 0, 0, 9, 9), (4, 3, 5, 5, 900_000, 5), (5, 0, 5, 4, 2_000_000, 7), (6, 0, 5, 4, None, 7), (None, 0, 5, 4, 600_000, 7), (8, None, 5, 4, 600_000, 7)]
    p = spark.createDataFrame(rows, PLANE)
    for crossing in (False, True):
        for check in (False, True):
            how = dict(tol=0.0, check_parents=check)
            handler = W.stop_at_wall if crossing else W.leave_at_wall
            got = TW.trace_in_tiles(p, walk, 2, TW.CROSSING if crossing else TW.COORDINATES, W.WALLS[handler], elements_at_once=at_once, **how)
            assert found(got) == found(W.trace_by_hops(p, walk, 2, crossing=crossing, **how))
    assert TW.trace_in_tiles(p.limit(0), walk, 2).count() == 0
    assert TW.deposits_in_tiles(p.withColumn("w", F.lit(1)), walk, "w", elements_at_once=at_once).agg(F.sum("w")).first()[0] == pytest.approx(3.6, abs=0.7)


def test_errors(spark):
    walk = W.cut(M.walk_table(T.tri_lattice(spark, 10, T.LENGTH)))
    with pytest.raises(ValueError, match="parent"):
        TW.trace_in_tiles(spark.createDataFrame([(4, 3, 5, 5, 900_000, 5)], PLANE), walk, 2, strict=True)
    with pytest.raises(Exception, match="64 bits"):
        TW.trace_in_tiles(spark.createDataFrame([(4, 0, 5, 4, 2_500_000_000, 5)], PLANE), walk, 2, TW.CROSSING, TW.STOP).count()
