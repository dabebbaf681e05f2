"""Cutting lineage and numbering rows without one task seeing them all."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one is made and set if Spark runs on this machine alone; on
    a cluster no folder of one machine is ever used, and ValueError is raised."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tesselark-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df materialised in the checkpoint folder, which all executors share."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with consecutive numbers by ``order`` (unique together). Rows are range-partitioned and sorted once; a row's number is its
    place in its partition plus the sizes of the partitions before, of which there are as many rows as partitions."""
    ordered = cut(df.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = ordered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + place + start).drop("_part", "_start", "_at")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over the rows before (exclusive scan), by the same two steps as numbered()."""
    ordered = cut(df.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    sizes = ordered.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ordered.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_start", "_within")


def carried_forward(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the last value, by ``order`` (unique together), that is not null up to each row, by the same two steps as numbered(): the last one within
    each range partition, and for rows before a partition's first value the last one of the partitions before."""
    ordered = cut(df.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    struct = F.struct(*(F.col(c) for c in order), F.col(value).alias("_value"))
    ends = ordered.where(F.col(value).isNotNull()).groupBy("_part").agg(F.max(struct)["_value"].alias("_end"))
    ends = ordered.select("_part").distinct().join(ends, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ordered.withColumn("_own", F.last(value, ignorenulls=True).over(within)).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.coalesce("_own", "_start")).drop("_part", "_own", "_start")


def place_within(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with consecutive numbers from 0 within each group, by ``order`` (unique within it). All rows are numbered by (group, order) in range
    partitions, and each group's first number is taken off, so no task sees a whole group."""
    rows = numbered(df, [*group, *order], "_number")
    first = rows.groupBy(*group).agg(F.min("_number").alias("_first"))
    return rows.join(first, group).withColumn(name, F.col("_number") - F.col("_first")).select(*df.columns, name)


#: A stored table of at most so many bytes (rows times the schema's width) may be sent to every executor.
BROADCAST_BYTES = 64 << 20


def small(table: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """A stored table (see cut), marked for broadcast if its rows times the schema's width are at most the limit. Only stored rows are counted."""
    size = table.count() * table._jdf.schema().defaultSize()
    return F.broadcast(table) if size <= (BROADCAST_BYTES if limit_bytes is None else limit_bytes) else table


#: As many rows may come to the driver at once.
DRIVER_ROWS = 1_000_000


def fetched(df: DataFrame, what: str) -> list:
    """All rows of df; raises ValueError beyond DRIVER_ROWS rather than dropping some."""
    rows = df.limit(DRIVER_ROWS + 1).collect()
    if len(rows) > DRIVER_ROWS:
        raise ValueError(f"more than DRIVER_ROWS = {DRIVER_ROWS} {what}")
    return rows
