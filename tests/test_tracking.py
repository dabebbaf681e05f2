"""Particle state in a stream against the same as a batch (which a query holds against SQL), over restarts, and on awkward rows."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tesselark.operators.mesh import Mesh, tet_lattice, tri_lattice
from tesselark.plans import files, tables as T
from tesselark.streaming import tracking

COLUMNS = ["pid", "step", "elem_id", "phase", "moves", "side", "cx", "cy", "late"]


def found(df, columns=COLUMNS):
    digits = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(str(tuple(map(digits, r))) for r in df.select(*columns).collect())


def streamed(parts, mesh, at, **how):
    return tracking.track_files(parts, mesh, str(at / "out"), str(at / "state"), str(at / "in"), **how)


def test_restarted_stream_equals_the_batch(spark, tmp_path):
    rows, mesh = files.tracked_rows(spark, DATA).where("pid < 6"), T.mesh(spark, DATA)
    parts = [rows.where("step < 300"), rows.where("step >= 300 and step < 301"), rows.where("step >= 301")]
    got, want = streamed(parts, mesh, tmp_path), tracking.tracked(rows, mesh)
    assert found(got) == found(want) and got.count() == rows.count()
    assert got.where("moves > 0 and side is null").count() == 0 and got.where("side is not null").count() > 0


def test_tetrahedra(spark, tmp_path):
    mesh = tet_lattice(spark, 3, 900)
    spot = lambda k: F.expr(f"cast((id * {k} + id * id * 13) % 890 + 1 as double)")
    rows = spark.range(60).select((F.col("id") % 4).alias("pid"), F.col("id").alias("step"), spot(313).alias("x"), spot(177).alias("y"), spot(431).alias("z"), F.lit(7).alias("turn"))
    columns = [*COLUMNS[:-1], "cz", "late"]
    got = streamed([rows.where("step < 25"), rows.where("step >= 25")], mesh, tmp_path, period=50)
    want = tracking.tracked(rows, mesh, period=50)
    assert found(got, columns) == found(want, columns) and got.where("elem_id >= 0 and cz is not null").count() > 40


def test_known_ways(spark, tmp_path):
    """Two triangles; a way over the diagonal, one that stays, one out and back."""
    mesh = tri_lattice(spark, 1, 10)
    schema = "pid long, step long, x double, y double, turn long, found int, _l0 int"
    one = spark.createDataFrame([(1, 0, 6.0, 2.0, 350, 0, 0), (2, 0, 6.0, 2.0, 1, 0, 0), (2, 1, 7.0, 2.0, 1, 0, 0), (3, 0, 1.0, 9.0, None, 0, 0)], schema)
    two = spark.createDataFrame([(1, 1, 2.0, 6.0, 20, 0, 0), (3, 1, 1.0, 11.0, 5, 0, 0)], schema)
    three = spark.createDataFrame([(3, 2, 1.0, 9.0, 5, 0, 0), (1, 1, 9.0, 9.0, 5, 0, 0)], schema)
    got = {(r["pid"], r["step"], r["late"]): r for r in streamed([one, two, three], mesh, tmp_path).collect()}
    assert len(got) == 8
    over = got[1, 1, False]
    assert (over["elem_id"], over["phase"], over["moves"], over["cx"], over["cy"]) == (1, 10, 1, 4.0, 4.0)
    assert (got[2, 1, False]["moves"], got[2, 1, False]["side"], got[2, 1, False]["phase"]) == (0, None, 2)
    assert [got[3, k, False]["elem_id"] for k in range(3)] == [1, -1, -1] and got[3, 2, False]["phase"] == 10
    late = got[1, 1, True]
    assert (late["elem_id"], late["phase"], late["moves"], late["cx"]) == (1, 10, 1, 4.0)


def test_awkward_rows(spark, tmp_path):
    """Nulls in every column, NaN, repeated rows, and nothing at all: each row comes out once."""
    mesh = tri_lattice(spark, 2, 10)
    data = [(None, 0, 1.0, 1.0, 1), (None, 1, 9.0, 9.0, 1), (1, None, 1.0, 1.0, 1), (1, 0, None, 1.0, 1), (1, 1, 1.0, 1.0, 1), (2, 0, 1.0, float("nan"), 1), (3, 0, 5.0, 5.0, 1), (3, 0, 5.0, 5.0, 1), (3, 0, 9.0, 5.0, None)]
    rows = spark.createDataFrame(data, "pid long, step long, x double, y double, turn long")
    got, want = streamed([rows, rows.limit(0)], mesh, tmp_path), tracking.tracked(rows, mesh)
    assert found(got) == found(want) and got.count() == len(data)
    gone = {(r["pid"], r["step"]): r["elem_id"] for r in want.where("not late").collect()}
    assert gone[1, 0] == gone[1, 1] == gone[2, 0] == -1 and gone[None, 1] >= 0
    assert want.where("late").count() == 1 and want.where("pid = 3 and moves = 0").count() >= 2
    assert tracking.tracked(rows.limit(0), mesh).count() == 0


def test_a_mesh_without_elements(spark):
    mesh = tri_lattice(spark, 1, 10)
    rows = spark.createDataFrame([(1, 0, 1.0, 1.0, 1)], "pid long, step long, x double, y double, turn long")
    assert [r["elem_id"] for r in tracking.tracked(rows, Mesh(2, mesh.vertex, mesh.elem.where("false"))).collect()] == [-1]


def test_each_row_is_located_once(spark):
    """On a corner that six elements share, the least is taken and the row is not doubled."""
    mesh = tri_lattice(spark, 4, 8)
    rows = spark.createDataFrame([(k, 0, float(x), float(y), 0) for k, (x, y) in enumerate([(4, 4), (0, 0), (8, 8), (3, 4), (3, 3)])], "pid long, step long, x double, y double, turn long")
    got = {r["pid"]: r["found"]["eid"] for r in tracking.located(rows, mesh).collect()}
    geo = {r["eid"]: [r["v0"], r["v1"], r["v2"]] for r in mesh.elem.collect()}
    at = {r["vid"]: (r["x"], r["y"]) for r in mesh.vertex.collect()}
    for r in rows.collect():
        holds = []
        for eid, vs in geo.items():
            c = [at[v] for v in vs]
            if all((c[(i + 1) % 3][0] - c[i][0]) * (r["y"] - c[i][1]) - (c[(i + 1) % 3][1] - c[i][1]) * (r["x"] - c[i][0]) >= 0 for i in range(3)):
                holds.append(eid)
        assert got[r["pid"]] == min(holds)


def test_the_provider_is_set_back(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    with pytest.raises(Exception):
        streamed([spark.range(1)], tri_lattice(spark, 1, 10), tmp_path)
    assert spark.conf.get(name, None) == was


@pytest.mark.parametrize("buckets", [1, 7])
def test_many_particles_share_a_group_of_the_state(spark, tmp_path, buckets):
    """One call of the processor takes every particle of a bucket: null and huge pids, late rows, ids that come and go."""
    mesh = tri_lattice(spark, 4, 80)
    spot = lambda k: F.expr(f"cast((id * {k} + id * id * 7) % 79 as double)")
    pid = F.when(F.col("id") % 50 != 0, F.col("id") % 50 + (1 << 60))
    rows = spark.range(900).select(pid.alias("pid"), F.expr("id div 50").alias("step"), spot(31).alias("x"), spot(17).alias("y"), (F.col("id") % 90).alias("turn"))
    late = rows.where("step = 3").withColumn("turn", F.lit(1000))
    got = streamed([rows.where("step < 5 and x > 9"), rows.where("step >= 5 and step < 11"), rows.where("step >= 11").union(late)], mesh, tmp_path, buckets=buckets)
    want = tracking.tracked(rows.where("step >= 5 or x > 9"), mesh)
    assert found(got.where("not late")) == found(want) and got.where("late").count() == 50
    assert got.where("pid is null").count() > 10 and got.select("pid").distinct().count() == 50


def test_pids_that_are_text(spark, tmp_path):
    mesh = tri_lattice(spark, 2, 10)
    rows = spark.createDataFrame([("a", 0, 1.0, 2.0, 1), ("", 0, 9.0, 2.0, 1), (None, 0, 2.0, 9.0, 1), ("a", 1, 9.0, 9.0, 2), ("", 1, 1.0, 1.0, 3), (None, 1, 9.0, 1.0, 4)], "pid string, step long, x double, y double, turn long")
    got, want = streamed([rows.where("step = 0"), rows.where("step = 1")], mesh, tmp_path, buckets=1), tracking.tracked(rows, mesh)
    assert found(got) == found(want) and got.where("moves = 1").count() == 3
