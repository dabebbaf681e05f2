"""Timing of operations: records as rows, summaries as DataFrames."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDERS = ("ALPHA", "ORDER", "LONGEST", "SHORTEST")


@dataclass
class Timing:
    """Records (rank, op, seconds, prebarrier) in the order they come. verbosity 0 records nothing."""

    verbosity: int = 1
    enabled: bool = True
    rows: list[tuple[int, int, str, float, float]] = field(default_factory=list)

    def record(self, op: str, seconds: float, rank: int = 0, prebarrier: float = 0.0) -> None:
        if self.enabled and self.verbosity > 0:
            self.rows.append((len(self.rows), rank, op, float(seconds), float(prebarrier)))

    @contextmanager
    def timed(self, op: str, rank: int = 0):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record(op, time.perf_counter() - began, rank)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "at long, rank int, op string, seconds double, prebarrier double")


def summary(records: DataFrame, order: str = "ORDER") -> DataFrame:
    """Per op: total, least, greatest, mean, mean of squares, count and time before barriers, in one of ORDERS."""
    if order not in ORDERS:
        raise ValueError(f"order is one of {ORDERS}")
    s = F.col("seconds")
    out = records.groupBy("op").agg(
        F.sum(s).alias("total"), F.min(s).alias("min"), F.max(s).alias("max"), F.avg(s).alias("avg"), F.avg(s * s).alias("mean_square"), F.count(F.lit(1)).alias("count"), F.sum("prebarrier").alias("prebarrier"), F.min("at").alias("first")
    )
    by = {"ALPHA": F.col("op"), "ORDER": F.col("first"), "LONGEST": F.desc("total"), "SHORTEST": F.asc("total")}[order]
    return out.orderBy(by, "op").drop("first")


def across_ranks(records: DataFrame) -> DataFrame:
    """Per op: the greatest and least total of a rank, which rank it was, and the mean over ranks."""
    by = records.groupBy("op", "rank").agg(F.sum("seconds").alias("total"))
    return by.groupBy("op").agg(F.max("total").alias("max"), F.max_by("rank", "total").alias("max_rank"), F.min("total").alias("min"), F.min_by("rank", "total").alias("min_rank"), F.avg("total").alias("avg"))


def running(records: DataFrame) -> DataFrame:
    """records with the op's total so far."""
    return records.withColumn("so_far", F.sum("seconds").over(Window.partitionBy("op").orderBy("at")))
