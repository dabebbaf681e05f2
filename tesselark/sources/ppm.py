"""The binary files of a partitioned mesh as a Spark data source: one file a rank, one partition a rank.

A file <path>_<ranks>.ppm/<name>_<rank>.ppm holds, all little-endian: version (1 byte), whether every rank holds the full mesh (1 byte), then for each of four
dimensions the fields of FIELDS in their order. A list is its length (4 bytes) and its 4-byte numbers, or, compressed, its length, the
number of compressed bytes (8 bytes) and these (zlib). Version 1 lacks n_global. The files do not say whether lists are compressed.

    register(spark)
    spark.read.format("ppm").option("ranks", 4).option("only", "2").load(path)        # opens one file
    ppm_rows(spark, parts, pic).write.format("ppm").option("ranks", 4).mode("overwrite").save(path)

Rows: rank, version, is_full, dim and the fields. Options: ranks; only (read these ranks' files, comma between; a filter on rank gives the same rows
but opens all files, as Spark keeps a pushed filter for later uses of the same frame); compress (true); version (written, 2); byteorder (little; big for files of
writers that do not normalise). path may be any address that pyarrow.fs knows and all executors reach. A rank's four rows are one task's work and must
come together (ppm_rows does that); its lists are by their format at most 2^31 numbers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tesselark.operators import partition as PA
from tesselark.operators.mesh import elem_side, elem_vert, sides
from tesselark.operators.pic_parts import PicParts
from tesselark.storage import cut

# fixed values of the format: the fields of a dimension in their order; q, i: one number of 8 or 4 bytes, l: a list
FIELDS = [
    ("n_global", "q"), ("n_cores", "i"), ("buffered_parts", "l"), ("offsets", "l"), ("comm_index", "l"), ("complete", "l"),
    ("n_bounds", "i"), ("n_boundaries", "i"), ("boundary_parts", "l"), ("bounded_offsets", "l"), ("bounded_ids", "l"),
]
DIMS, VERSIONS, MAX_INT = 4, (1, 2), 2**31 - 1
SCHEMA = "rank int, version int, is_full boolean, dim int, " + ", ".join(f"{n} {dict(q='long', i='int', l='array<int>')[k]}" for n, k in FIELDS)


class Codec:
    """Files to rows and back."""

    def __init__(self, compress: bool, byteorder: str):
        if byteorder not in ("little", "big"):
            raise ValueError(f"byteorder {byteorder}: little or big")
        self.compress, self.mark = compress, "<" if byteorder == "little" else ">"

    def decode(self, rank: int, data: bytes) -> Iterator[tuple]:
        at = 0

        def take(n: int) -> bytes:
            nonlocal at
            if n < 0 or at + n > len(data):
                raise ValueError(f"the file of rank {rank} ends at byte {len(data)}, within a value")
            at += n
            return data[at - n : at]

        def number(kind: str) -> int:
            return struct.unpack(self.mark + kind, take(struct.calcsize(self.mark + kind)))[0]

        def numbers() -> list[int]:
            n = number("i")
            raw = zlib.decompress(take(number("q"))) if self.compress else take(4 * n)
            if len(raw) != 4 * n:
                raise ValueError(f"a list of rank {rank} has {len(raw)} bytes for {n} numbers; see the options compress and byteorder")
            return np.frombuffer(raw, dtype=self.mark + "i4").tolist()

        version, full = number("b"), bool(number("b"))
        if version not in VERSIONS:
            raise ValueError(f"the file of rank {rank} is of version {version}")
        for dim in range(DIMS):
            values = [None if name == "n_global" and version < 2 else numbers() if kind == "l" else number(kind) for name, kind in FIELDS]
            yield (rank, version, full, dim, *values)
        if at != len(data):
            raise ValueError(f"the file of rank {rank} has {len(data) - at} bytes more than its values")

    def encode(self, rows: list[Row], version: int) -> bytes:
        out = [struct.pack(self.mark + "bb", version, bool(rows[0]["is_full"]))]
        for row in rows:
            for name, kind in FIELDS:
                value = row[name]
                if kind != "l":
                    if not (name == "n_global" and version < 2):
                        out.append(struct.pack(self.mark + kind, value or 0))
                    continue
                raw = np.asarray([] if value is None else value, dtype=self.mark + "i4").tobytes()
                packed = zlib.compress(raw, 1) if self.compress else raw
                out += [struct.pack(self.mark + "i", len(raw) // 4), *([struct.pack(self.mark + "q", len(packed))] if self.compress else []), packed]
        return b"".join(out)


@dataclass(frozen=True)
class Place:
    """Where the files are."""

    path: str
    ranks: int

    @property
    def fs(self) -> tuple[pafs.FileSystem, str]:
        known = "://" in self.path or self.path.startswith("file:")
        fs, at = pafs.FileSystem.from_uri(self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path) if known else (pafs.LocalFileSystem(), self.path)
        return fs, f"{at.rstrip('/')}_{self.ranks}.ppm"

    def file(self, folder: str, rank: int) -> str:
        name = self.path.rstrip("/").rsplit("/", 1)[-1]
        return f"{folder}/{name}_{rank}.ppm"


@dataclass
class RankPartition(InputPartition):
    rank: int


class PpmReader(DataSourceReader):
    def __init__(self, place: Place, codec: Codec, wanted: set[int] | None):
        self.place, self.codec, self.wanted = place, codec, wanted

    def partitions(self) -> list[RankPartition]:
        return [RankPartition(r) for r in (range(self.place.ranks) if self.wanted is None else sorted(self.wanted))]

    def read(self, partition: RankPartition) -> Iterator[tuple]:
        fs, folder = self.place.fs
        with fs.open_input_stream(self.place.file(folder, partition.rank)) as f:
            data = f.read()
        yield from self.codec.decode(partition.rank, data)


@dataclass
class Written(WriterCommitMessage):
    ranks: list[tuple[int, str]]


class PpmWriter(DataSourceWriter):
    """Each task writes its ranks' files under names of its own; they get their names when all have been written, so a task that is
    run again or a job that fails leaves no half file."""

    def __init__(self, place: Place, codec: Codec, version: int, overwrite: bool):
        self.place, self.codec, self.version, self.overwrite = place, codec, version, overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        from uuid import uuid4

        fs, folder = self.place.fs
        fs.create_dir(folder, recursive=True)
        done = []
        for rank, group in groupby(rows, key=lambda r: r["rank"]):
            own = list(group)
            if rank is None or not 0 <= rank < self.place.ranks or [r["dim"] for r in own] != list(range(DIMS)):
                raise ValueError(f"rank {rank} of {self.place.ranks} comes with dimensions {[r['dim'] for r in own]}: each rank's rows must come together, one for each of the dimensions 0 to 3")
            name = f"{folder}/_{rank}_{uuid4().hex}"
            with fs.open_output_stream(name) as f:
                f.write(self.codec.encode(own, self.version))
            done.append((rank, name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = self.place.fs
        files = [x for m in messages if m is not None for x in m.ranks]
        try:
            if sorted(r for r, _ in files) != list(range(self.place.ranks)):
                raise ValueError(f"files of ranks {sorted(r for r, _ in files)[:20]} were written, of {self.place.ranks} ranks each must be written once")
            there = [self.place.file(folder, r) for r, _ in files if fs.get_file_info(self.place.file(folder, r)).type != pafs.FileType.NotFound]
            if there and not self.overwrite:
                raise ValueError(f"{there[0]} exists; write with mode overwrite")
        except ValueError:
            self.abort(messages)
            raise
        for rank, name in files:
            fs.move(name, self.place.file(folder, rank))

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = self.place.fs
        for m in messages:
            for _rank, name in m.ranks if m is not None else []:
                if fs.get_file_info(name).type != pafs.FileType.NotFound:
                    fs.delete_file(name)


class PpmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ppm"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[Place, Codec]:
        o = self.options
        if "path" not in o or int(o.get("ranks", "0")) < 1:
            raise ValueError("a path and the option ranks (1 or more) are needed")
        return Place(o["path"], int(o["ranks"])), Codec(o.get("compress", "true").lower() == "true", o.get("byteorder", "little"))

    def reader(self, schema) -> PpmReader:
        only = self.options.get("only")
        wanted = None if only is None else {int(r) for r in only.split(",")}
        if wanted and not wanted <= set(range(int(self.options.get("ranks", "0")))):
            raise ValueError(f"only {only}: ranks from 0 on, below the option ranks")
        return PpmReader(*self._given(), wanted)

    def writer(self, schema, overwrite: bool) -> PpmWriter:
        version = int(self.options.get("version", "2"))
        if version not in VERSIONS:
            raise ValueError(f"version {version}: one of {VERSIONS}")
        return PpmWriter(*self._given(), version, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(PpmSource)


def _of_dimension(spark: SparkSession, held: DataFrame, numbers: DataFrame, n_ranks: int, dim: int, n_global: int, lower: bool) -> DataFrame:
    """rank, dim and the fields of one dimension. held: rank, key, owner, lid (its number on that rank); numbers: key, owner, rank_lid. offsets: where each part's
    entities begin; comm_index: an entity's place in that order; complete: a part's entities are all (2), some (1) or none (0; 1 if it has none) here. Of
    lower dimensions: n_bounds, parts of which only some are here; boundary_parts, ranks that hold only some of this one's, bounded_offsets and
    bounded_ids, which these are by rank, in the owner's numbers. buffered_parts: parts with an entity here, but for the rank's own."""
    placed = cut(held.join(numbers.select("key", "rank_lid"), "key"))
    of_owner = placed.groupBy("rank", "owner").agg(F.count(F.lit(1)).alias("n"))
    total = numbers.groupBy("owner").agg(F.count(F.lit(1)).alias("total"))
    ranks = spark.range(n_ranks).select(F.col("id").cast("int").alias("rank"))
    every = ranks.crossJoin(ranks.select(F.col("rank").alias("owner")))  # ranks x ranks
    parts = cut(every.join(of_owner, ["rank", "owner"], "left").join(total, "owner", "left").select("rank", "owner", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total")))
    in_order = lambda value, order="owner": F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), value.alias("v")))), lambda x: x["v"].cast("int"))
    whole = (F.col("n") == F.col("total")).cast("int") + (F.col("n") != 0).cast("int")
    sizes = parts.groupBy("rank").agg(in_order(F.col("n")).alias("_n"), in_order(whole).alias("complete"))
    sizes = sizes.withColumn("offsets", F.transform(F.sequence(F.lit(0), F.lit(n_ranks)), lambda k: F.aggregate(F.slice("_n", 1, k), F.lit(0), lambda a, b: a + b)))
    others = parts.where("rank <> owner and n > 0")
    listed = lambda rows, rank, part, name: rows.groupBy(F.col(rank).alias("rank")).agg(F.sort_array(F.collect_list(F.col(part).cast("int"))).alias(name))
    index = PA.comm_index(placed.select("rank", "key"), numbers, "key").join(placed.select("rank", "key", "lid"), ["rank", "key"])
    tables = [sizes.drop("_n"), listed(others, "rank", "owner", "buffered_parts"), index.groupBy("rank").agg(in_order(F.col("index"), "lid").alias("comm_index"))]
    # parts of which a rank holds some entities only: their owners list what they must send, in their own numbers
    some = others.where("n < total") if lower else others.where("false")
    tables.append(some.groupBy("rank").agg(F.count(F.lit(1)).alias("n_bounds")))
    tables.append(listed(some, "owner", "rank", "boundary_parts"))
    sent = placed.join(some.select("rank", "owner"), ["rank", "owner"]).groupBy(F.col("owner").alias("rank"))
    tables.append(sent.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("to"), "rank_lid"))), lambda x: x["rank_lid"].cast("int")).alias("bounded_ids")))
    if lower:
        per = every.join(some, ["rank", "owner"], "left").groupBy(F.col("owner").alias("to")).agg(in_order(F.coalesce("n", F.lit(0)), "rank").alias("_n"))
        tables.append(per.select(F.col("to").alias("rank"), F.transform(F.sequence(F.lit(0), F.lit(n_ranks)), lambda k: F.aggregate(F.slice("_n", 1, k), F.lit(0), lambda a, b: a + b)).alias("bounded_offsets")))
    else:
        tables.append(ranks.select("rank", F.array().cast("array<int>").alias("bounded_offsets")))
    out = ranks
    for table in tables:
        out = out.join(table, "rank", "left")
    none = F.array().cast("array<int>")
    known = {c: F.coalesce(F.col(c), none) for c in ("buffered_parts", "offsets", "comm_index", "complete", "boundary_parts", "bounded_offsets", "bounded_ids")}
    out = out.withColumns(known)
    numbers_of = {"dim": F.lit(dim), "n_global": F.lit(n_global).cast("long"), "n_cores": F.size("buffered_parts"), "n_bounds": F.coalesce("n_bounds", F.lit(0)), "n_boundaries": F.size("boundary_parts")}
    return out.withColumns(numbers_of)


def ppm_rows(spark: SparkSession, parts: PA.PartMesh, pic: PicParts) -> DataFrame:
    """The rows of all ranks' files, in as many partitions as ranks: for vertices, sides (of triangles the edges) and elements of the parts, which
    pic numbers. The edges of tetrahedra are left empty, as are the dimensions that a mesh does not have."""
    mesh, n_ranks = parts.mesh, parts.n_ranks
    side = cut(sides(mesh))
    down = {0: (elem_vert(mesh).select("eid", F.col("vid").alias("key")), pic.vertex, "vid"), mesh.dim - 1: (elem_side(mesh, side).select("eid", F.col("sid").alias("key")), pic.side, "sid")}
    rows = []
    for dim in range(DIMS):
        if dim in down or dim == mesh.dim:
            if dim == mesh.dim:
                owner, entity, key = parts.owners.select(F.col("eid").alias("key"), "owner"), pic.elem, "eid"
            else:
                links, entity, key = down[dim]
                owner = PA.lower_owners(links, parts.owners, "key")
            numbers = cut(PA.global_numbers(spark, owner, "key", n_ranks).select("key", "owner", "rank_lid"))
            held = entity.select(F.col("rank").cast("int").alias("rank"), F.col(f"{key}_global").alias("key"), F.col(key).alias("lid")).join(numbers.select("key", "owner"), "key")
            rows.append(_of_dimension(spark, held, numbers, n_ranks, dim, numbers.count(), dim < mesh.dim))
        else:
            empty = {n: F.array().cast("array<int>") if k == "l" else F.lit(0).cast("long" if k == "q" else "int") for n, k in FIELDS}
            rows.append(spark.range(n_ranks).select(F.col("id").cast("int").alias("rank"), F.lit(dim).alias("dim"), *(v.alias(n) for n, v in empty.items())))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    out = out.withColumns({"version": F.lit(2), "is_full": F.lit(bool(parts.is_full))})
    typed = [F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMA.split(", ")]
    return out.select(*typed).repartition(n_ranks, "rank").sortWithinPartitions("rank", "dim")
