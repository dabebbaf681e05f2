"""Binary files of partitioned meshes: the layout byte by byte, both versions, compressed or not, either byte order, one file for one rank, and what must fail."""

import os
import struct
import zlib

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tesselark.operators.partition import layered_mesh
from tesselark.operators.pic_parts import pic_parts
from tesselark.plans import catalogue, tables as T
from tesselark.sources import ppm
from tesselark.storage import cut


def plain(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark):
    """The rows of four ranks whose stripes hold equally many events."""
    ppm.register(spark)
    parts = catalogue._parts(spark, DATA)
    return cut(ppm.ppm_rows(spark, parts, pic_parts(parts.mesh, parts.halo)))


def by_rank(df, ranks):
    return df.repartition(ranks, "rank").sortWithinPartitions("rank", "dim")


def few(spark, ranks=2, lists=((3, -1), ())):
    data = [(r, 2, False, d, 10 * d + 2**33, d, *[list(lists[(r + d) % 2])] * 4, 5, 6, *[list(lists[d % 2])] * 3) for r in range(ranks) for d in range(4)]
    return by_rank(spark.createDataFrame(data, ppm.SCHEMA), ranks)


@pytest.mark.parametrize("compress, byteorder", [("true", "little"), ("false", "little"), ("true", "big"), ("false", "big")])
def test_round_trip(spark, stored, tmp_path, compress, byteorder):
    path, how = str(tmp_path / "plate"), {"ranks": 4, "compress": compress, "byteorder": byteorder}
    by_rank(stored, 4).write.format("ppm").options(**how).mode("overwrite").save(path)
    assert sorted(os.listdir(f"{path}_4.ppm")) == [f"plate_{r}.ppm" for r in range(4)]
    assert plain(spark.read.format("ppm").options(**how).load(path)) == plain(stored)


def test_layout(spark, tmp_path):
    """The bytes, put together here from the layout's description."""
    ppm.register(spark)
    path = str(tmp_path / "a")
    few(spark).write.format("ppm").option("ranks", 2).mode("overwrite").save(path)

    def listed(numbers):
        packed = zlib.compress(struct.pack(f"<{len(numbers)}i", *numbers), 1)
        return struct.pack("<iq", len(numbers), len(packed)) + packed

    lists = ((3, -1), ())
    want = struct.pack("<bb", 2, 0)
    for d in range(4):
        first, second = listed(lists[(1 + d) % 2]), listed(lists[d % 2])
        want += struct.pack("<qi", 10 * d + 2**33, d) + first * 4 + struct.pack("<ii", 5, 6) + second * 3
    with open(f"{path}_2.ppm/a_1.ppm", "rb") as f:
        assert f.read() == want


def test_first_version(spark, tmp_path):
    """Its files have no number of entities in the whole mesh."""
    ppm.register(spark)
    path = str(tmp_path / "old")
    few(spark).write.format("ppm").options(ranks=2, version=1).mode("overwrite").save(path)
    want = few(spark).withColumns({"version": F.lit(1), "n_global": F.lit(None).cast("long")})
    assert plain(spark.read.format("ppm").option("ranks", 2).load(path)) == plain(want)


def test_only_the_wanted_files_are_opened(spark, tmp_path):
    ppm.register(spark)
    path = str(tmp_path / "some")
    few(spark, 5).write.format("ppm").option("ranks", 5).mode("overwrite").save(path)
    for r in (0, 1, 4):
        os.remove(f"{path}_5.ppm/some_{r}.ppm")
    read = lambda only: spark.read.format("ppm").options(ranks=5, only=only).load(path)
    assert read("2").count() == 4 and read("2,3").where("dim = 1").count() == 2 and read("3").rdd.getNumPartitions() == 1
    for only in ("0,2", "7", "x"):
        with pytest.raises(Exception):
            read(only).count()
    whole = spark.read.format("ppm").option("ranks", 5).load(path)
    with pytest.raises(Exception):
        whole.count()


def test_a_filter_does_not_stay(spark, tmp_path):
    ppm.register(spark)
    path = str(tmp_path / "all")
    few(spark, 3).write.format("ppm").option("ranks", 3).mode("overwrite").save(path)
    back = spark.read.format("ppm").option("ranks", 3).load(path)
    assert [back.where(w).count() for w in ("rank = 2", "true", "rank = 1 and dim = 0", "rank = 77", "true")] == [4, 12, 1, 0, 12]


def test_what_must_fail(spark, tmp_path):
    ppm.register(spark)
    path = str(tmp_path / "b")
    write = lambda df, ranks=2, mode="overwrite", **o: df.write.format("ppm").options(ranks=ranks, **o).mode(mode).save(path)
    for bad in (few(spark).where("dim <> 2"), few(spark, 3), few(spark).where("rank = 0"), few(spark).withColumn("rank", F.lit(None).cast("int"))):
        with pytest.raises(Exception):
            write(bad)
        assert not os.path.isdir(f"{path}_2.ppm") or not [x for x in os.listdir(f"{path}_2.ppm") if not x.startswith("_")]
    with pytest.raises(Exception, match="version"):
        write(few(spark), version=3)
    write(few(spark))
    with pytest.raises(Exception):
        write(few(spark), mode="append")
    for o in ({"compress": "false"}, {"byteorder": "big"}, {"byteorder": "middle"}, {"ranks": 0}):
        with pytest.raises(Exception):
            spark.read.format("ppm").options(**({"ranks": 2} | o)).load(path).collect()
    name = f"{path}_2.ppm/b_0.ppm"
    data = open(name, "rb").read()
    for wrong in (data[:-3], data + b"x", b"\x09" + data[1:], b""):
        with open(name, "wb") as f:
            f.write(wrong)
        with pytest.raises(Exception, match="rank 0"):
            spark.read.format("ppm").option("ranks", 2).load(path).collect()


def test_fields_against_plain_python(spark, stored):
    """Who buffers whom, and what lies on whose border, for vertices and elements from the halo alone."""
    parts = catalogue._parts(spark, DATA)
    of = {r["eid"]: r["owner"] for r in parts.owners.collect()}
    corners = {r["eid"]: (r["v0"], r["v1"], r["v2"]) for r in parts.mesh.elem.collect()}
    held = {}
    for r in parts.halo.collect():
        held.setdefault(r["rank"], set()).add(r["eid"])
    for dim in (0, 2):
        owner = of if dim == 2 else {}
        if dim == 0:
            for e, vs in corners.items():
                for v in vs:
                    owner[v] = min(owner.get(v, 99), of[e])
        has = {r: es if dim == 2 else {v for e in es for v in corners[e]} for r, es in held.items()}
        own = {p: sorted(k for k in owner if owner[k] == p) for p in held}
        part = lambda r, p: sorted(k for k in has[r] if owner[k] == p)
        some = lambda r, p: dim == 0 and r != p and 0 < len(part(r, p)) < len(own[p])
        for row in stored.where(F.col("dim") == dim).collect():
            rank, ranks = row["rank"], sorted(held)
            mine = sorted(has[rank])
            assert row["n_global"] == len(owner) and row["offsets"] == [sum(len(part(rank, p)) for p in ranks[:k]) for k in range(5)]
            assert row["buffered_parts"] == [p for p in ranks if p != rank and part(rank, p)] and row["n_cores"] == len(row["buffered_parts"])
            assert row["complete"] == [2 * (part(rank, p) == own[p]) or int(bool(part(rank, p))) for p in ranks]
            order = sorted(mine, key=lambda k: (owner[k], k))
            assert [order[k] for k in row["comm_index"]] == mine
            assert row["n_bounds"] == sum(some(rank, p) for p in ranks)
            sent = {r: part(r, rank) for r in ranks if some(r, rank)}
            assert row["boundary_parts"] == list(sent) and row["n_boundaries"] == len(sent)
            assert [own[rank][k] for k in row["bounded_ids"]] == [k for r in sent for k in sent[r]]
            assert row["bounded_offsets"] == ([sum(len(sent.get(r, [])) for r in ranks[:k]) for k in range(5)] if dim == 0 else [])
    assert stored.where("dim = 3 and size(comm_index) > 0").count() == 0 and stored.where("dim = 0 and n_bounds > 0").count() > 0


def test_tetrahedra_and_a_rank_that_owns_nothing(spark, tmp_path):
    ppm.register(spark)
    mesh = T.tets(spark, DATA)
    owners = cut(mesh.elem.select("eid", F.expr("cast(2 * (eid div 54) as int)").alias("owner")))
    ranks = 2 * (mesh.elem.count() // 54) + 1
    parts = layered_mesh(mesh, owners, ranks, 1, 1)
    rows = ppm.ppm_rows(spark, parts, pic_parts(mesh, parts.halo))
    path = str(tmp_path / "cube")
    rows.write.format("ppm").option("ranks", ranks).mode("overwrite").save(path)
    back = spark.read.format("ppm").option("ranks", ranks).load(path)
    assert plain(back) == plain(rows) and back.count() == 4 * ranks
    nothing = back.where("rank = 1").collect()
    assert all(not r["comm_index"] and set(r["offsets"]) <= {0} and not r["bounded_ids"] for r in nothing)
    assert back.where("dim = 3 and size(comm_index) > 0").count() == mesh.elem.count() // 54
