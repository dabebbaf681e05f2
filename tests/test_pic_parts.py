"""All ranks' parts in one pass against one rank at a time, and against plain Python."""

from collections import Counter
from itertools import combinations

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tesselark.operators import mesh as M, particles as PT, partition as PA
from tesselark.operators.pic_parts import classified_sides, pic_parts
from tesselark.plans import catalogue
from tesselark.plans import tables as T
from tesselark.storage import cut


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def plate(spark):
    """The plate with the events of each element as a tag, on four ranks."""
    m = T.mesh(spark, DATA).with_tag(2, "load", PT.per_element(T.particles(spark, DATA)).withColumnRenamed("n", "load"), "elem_id")
    parts = catalogue._parts(spark, DATA)
    return m, cut(parts.halo), pic_parts(m, parts.halo)


def test_each_rank_equals_its_part(spark, plate):
    m, halo, out = plate
    for rank in range(T.RANKS):
        one, of = PA.pic_part(m, halo, rank), out.of(rank)
        columns = ["eid", "eid_global", "v0", "v1", "v2", "class_id", "load", "is_safe"]
        assert [tuple(map(str, r)) for r in rows(of.elem, *columns)] == [tuple(map(str, r)) for r in rows(one.elem, *columns)]
        columns = ["vid", "vid_global", "x", "y", "class_id", "class_dim"]
        assert rows(of.vertex, *columns) == rows(one.vertex, *columns)


def test_sides_of_each_rank(spark, plate):
    """Numbers without gaps, corners and classes as plain Python finds them, exposure by the rank's own elements."""
    m, halo, out = plate
    classes = {r["eid"]: r["class_id"] for r in m.elem.collect()}
    whole = {}
    for r in M.elem_side(m).collect():
        whole.setdefault(r["sid"], []).append(r["eid"])
    held = {}
    for r in halo.collect():
        held.setdefault(r["rank"], set()).add(r["eid"])
    vertex = {(r["rank"], r["vid"]): r["vid_global"] for r in out.vertex.collect()}
    corners = {r["sid"]: (r["v0"], r["v1"]) for r in M.sides(m).collect()}
    seen = Counter()
    for r in out.side.collect():
        around = whole[r["sid_global"]]
        inner = len(around) == 2 and classes[around[0]] == classes[around[1]]
        assert (r["class_id"], r["class_dim"]) == (min(classes[e] for e in around), 2 if inner else 1)
        assert r["exposed"] == (sum(e in held[r["rank"]] for e in around) == 1)
        assert (vertex[r["rank"], r["v0"]], vertex[r["rank"], r["v1"]]) == corners[r["sid_global"]]
        seen[r["rank"]] += 1
    for rank, eids in held.items():
        assert seen[rank] == sum(any(e in eids for e in x) for x in whole.values())
        assert rows(out.side.where(F.col("rank") == rank), "sid") == [(k,) for k in range(seen[rank])]
    assert out.elem_side.count() == 3 * halo.count()


def test_tetrahedra_with_edges(spark):
    m = T.tets(spark, DATA)
    owners = cut(m.elem.select("eid", F.expr("cast(eid div 54 as int)").alias("owner")))
    parts = PA.layered_mesh(m, owners, 3, 1, 1)
    out, halo = pic_parts(m, parts.halo), parts.halo.collect()
    elem = {r["eid"]: [r[f"v{i}"] for i in range(4)] for r in m.elem.collect()}
    vertex = {(r["rank"], r["vid"]): r["vid_global"] for r in out.vertex.collect()}
    want = {(r["rank"], *p) for r in halo for p in combinations(sorted(elem[r["eid"]]), 2)}
    got = [(r["rank"], vertex[r["rank"], r["a"]], vertex[r["rank"], r["b"]]) for r in out.edge.collect()]
    assert len(got) == len(want) and set(got) == want
    faces = {(r["rank"], *t) for r in halo for t in combinations(sorted(elem[r["eid"]]), 3)}
    assert out.side.count() == len(faces)


def test_a_rank_without_elements_and_an_empty_halo(spark, plate):
    m, halo, _ = plate
    out = pic_parts(m, halo.where("false"))
    assert out.elem.count() == out.vertex.count() == out.side.count() == 0
    assert classified_sides(m).count() == M.sides(m).count()
