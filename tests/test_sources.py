"""Sources and sinks: awkward files, the order of part files, and what must fail. Round trips are queries (plans/files.py)."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tesselark.plans import tables as T
from tesselark.sources import picparts, text


def test_part_files_keep_the_order(spark, tmp_path):
    path = str(tmp_path / "owners.ptn")
    owners = spark.range(5000).select(F.col("id").alias("eid"), (F.col("id") % 7).cast("int").alias("owner"))
    text.write_element_partition(owners.repartition(5), path)
    back = text.read_element_partition(spark, path)
    assert back.where("owner <> eid % 7").count() == 0 and back.count() == 5000


def test_one_file_with_free_white_space(spark, tmp_path):
    path = tmp_path / "a.ptn"
    path.write_text("3 1\n\n  2\t0\n1\n")
    assert [r["owner"] for r in text.read_element_partition(spark, str(path)).orderBy("eid").collect()] == [3, 1, 2, 0, 1]
    path = tmp_path / "a.ptl"
    path.write_text("2 3\n10 1\n11 2\n\n0 5 1.5 2 3 7 8\n1 6 0 0 0 0 0\n1 7 0 0 0 0 -1\n")
    elements, particles = text.read_particles(spark, str(path))
    assert sorted(map(tuple, elements.collect())) == [(0, 10, 1), (1, 11, 2)]
    assert sorted(map(tuple, particles.collect())) == [(5, 0, 1.5, 2.0, 3.0, 7, 8), (6, 1, 0.0, 0.0, 0.0, 0, 0), (7, 1, 0.0, 0.0, 0.0, 0, -1)]


def test_empty_particle_file(spark, tmp_path):
    path = tmp_path / "none.ptl"
    path.write_text("0 0\n\n")
    elements, particles = text.read_particles(spark, str(path))
    assert elements.count() == 0 and particles.count() == 0


def test_unknown_files_are_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        text.read_partition(spark, "a.xyz", 4, T.mesh(spark, DATA).elem)
    with pytest.raises(ValueError):
        text.read_mesh(spark, "a.osh")
    path = tmp_path / "a.msh"
    path.write_text("$MeshFormat\n2.2 0 8\n$EndMeshFormat\n")
    with pytest.raises(ValueError):
        text.read_mesh(spark, str(path))
    with pytest.raises(Exception):
        picparts.read_picparts(spark, str(tmp_path / "nothing"), 2)
