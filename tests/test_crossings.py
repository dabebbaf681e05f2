"""The log of crossings: lengths add up, sides follow each other, and awkward ways."""

from collections import defaultdict

import pytest
from conftest import DATA

from tesselark.operators import mesh as M, walk as W
from tesselark.operators.crossings import crossing_log
from tesselark.plans import tables as T


@pytest.mark.parametrize("at_once", [1, 5])
def test_stretches_make_up_each_way(spark, at_once):
    m, p = T.mesh(spark, DATA), T.particles(spark, DATA)
    side = {(r["eid"], r["sid"]): r["nbr"] for r in M.elem_side(m).collect()}
    ways = defaultdict(list)
    for r in crossing_log(p, M.walk_table(m), hops_at_once=at_once, broadcast_bytes=0 if at_once == 1 else None).collect():
        ways[r["pid"]].append(r)
    ends = {r["pid"]: r for r in W.trace(p, M.walk_table(m), 2, crossing=True, tol=0.0).collect()}
    start = {r["pid"]: r["elem_id"] for r in p.collect()}
    assert set(ways) == set(start)
    for pid, rows in ways.items():
        rows.sort(key=lambda r: r["hop"])
        assert [r["hop"] for r in rows] == list(range(len(rows)))
        assert rows[0]["elem"] == start[pid] and rows[0]["t0"] == 0.0
        for a, b in zip(rows, rows[1:], strict=False):
            assert a["t1"] == b["t0"] <= b["t1"] and side[a["elem"], a["side"]] == b["elem"]
        last = rows[-1]
        assert last["exposed"] or (last["side"] is None and last["t1"] == 1.0)
        assert last["exposed"] == (ends[pid]["face"] is not None) and (not last["exposed"] or last["side"] == ends[pid]["face"])


def test_awkward_ways(spark):
    """Standing still, along a side, through a corner, in no element of the mesh."""
    h = T.LENGTH // 10
    rows = [(1, 0, 500, 100, 500, 100), (2, 0, 0, 0, 3 * h, 0), (3, 0, 0, 0, 2 * h, 2 * h), (4, 0, h // 2, 1, h // 2 + 2 * h, 1 + 2 * h), (5, 99_999, 0, 0, 9, 9)]
    log = crossing_log(spark.createDataFrame(rows, "pid long, elem_id long, ox long, oy long, tx long, ty long"), M.walk_table(T.tri_lattice(spark, 10, T.LENGTH))).collect()
    share = defaultdict(float)
    for r in log:
        share[r["pid"]] += r["t1"] - r["t0"]
    assert share[1] == share[3] == share[4] == pytest.approx(1.0) and share[2] <= 1.0 and 5 not in share
