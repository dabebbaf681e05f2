"""Meshes and partitioned meshes as Parquet, the partitioned ones by rank, with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.operators.mesh import Mesh
from tesselark.operators.partition import PartMesh

VERSION = 2


def write_mesh_tables(mesh: Mesh, path: str) -> None:
    mesh.vertex.write.mode("overwrite").parquet(f"{path}/vertex")
    mesh.elem.write.mode("overwrite").parquet(f"{path}/elem")


def read_mesh_tables(spark: SparkSession, path: str) -> Mesh:
    elem = spark.read.parquet(f"{path}/elem")
    return Mesh(3 if "v3" in elem.columns else 2, spark.read.parquet(f"{path}/vertex"), elem)


def write_picparts(parts: PartMesh, path: str) -> str:
    """The folder <path>_<ranks>.ppm: mesh, owners, halo by rank, manifest."""
    out = f"{path}_{parts.n_ranks}.ppm"
    write_mesh_tables(parts.mesh, f"{out}/mesh")
    parts.owners.write.mode("overwrite").parquet(f"{out}/owners")
    parts.halo.write.mode("overwrite").partitionBy("rank").parquet(f"{out}/halo")
    manifest = [(VERSION, parts.n_ranks, parts.is_full)]
    parts.halo.sparkSession.createDataFrame(manifest, "version int, n_ranks int, is_full boolean").coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    return out


def read_picparts(spark: SparkSession, path: str, n_ranks: int) -> PartMesh:
    at = f"{path}_{n_ranks}.ppm"
    m = spark.read.schema("version int, n_ranks int, is_full boolean").json(f"{at}/manifest").first()
    if m["version"] != VERSION or m["n_ranks"] != n_ranks:
        raise ValueError(f"written by version {m['version']} for {m['n_ranks']} ranks")
    halo = spark.read.parquet(f"{at}/halo").select(F.col("rank").cast("int").alias("rank"), "eid", "is_core", "is_safe")
    return PartMesh(read_mesh_tables(spark, f"{at}/mesh"), spark.read.parquet(f"{at}/owners"), halo, n_ranks, m["is_full"])


def rank_halo(spark: SparkSession, path: str, n_ranks: int, rank: int) -> DataFrame:
    """One rank's elements; only its folder is read."""
    return spark.read.parquet(f"{path}_{n_ranks}.ppm/halo").where(F.col("rank") == rank)
