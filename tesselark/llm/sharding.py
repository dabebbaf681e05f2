"""Operator 3: proportional stratified interleaving into shards.

Rows are put in a seeded random order within their source, each gets its fractional rank
(rank minus a source's own random start in (0, 1), over the source's size), all rows are ordered
by that fraction, and the order is cut into equal runs. Each shard then holds every source's share
within one row or so (law ``rows``: shard sizes differ by one at most).

Both rankings are global but nothing global is sorted in one task: rows fall into hash buckets (first
ranking) or into bands of the fraction (second), bucket counts give each bucket's start, and a row
number is taken within a bucket. A source that holds a third of all rows is thereby spread over all buckets, and so are rows that
are repeated as often: equal rows are counted before the shuffle and go on as blocks of at most COPIES.

Defined cases: null text has size 1 and the CRC of no bytes; null source is a source of its own; repeated rows and
repeated ids are separate rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselark.llm.common import column, documents, text_of, written

N_SHARDS, SEED, ROWS_PER_BUCKET, MAX_BUCKETS, COPIES = 8, 20240611, 2048, 1 << 16, 1024


def _placed(rows: DataFrame, keys: list[str], within: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """rows (each standing for _k of them) with the 0-based rank of its first by (bucket, order) among the rows of equal ``within``; keys = within + [bucket]."""
    sizes = rows.groupBy(*keys).agg(F.sum("_k").alias("_n"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if within:
        starts = starts.join(sizes.groupBy(*within).agg(F.sum("_n").alias("_all")), within)
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_number", F.coalesce(F.sum("_k").over(earlier), F.lit(0))).join(starts, keys).withColumn(out, F.col("_start") + F.col("_number")).drop("_start", "_number")


def stratified_shards(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, source, shard, slot for every row of docs, under the law ``rows``."""
    bytes_ = text_of(text_col).cast("binary")
    slim = docs.select(
        column(id_col).cast("long").alias("doc_id"),
        (F.octet_length(bytes_).cast("long") + 1).alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        column(stratum_col).cast("string").alias("source"),
    )
    # rows equal in all four are counted, then stand as blocks of at most COPIES rows, each with a place of its own in the shuffle
    slim = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("_copies"))
    slim = slim.select("*", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {COPIES})")).alias("_block"))
    slim = slim.select(
        "doc_id", "size", "text_crc32", "source", "_block",
        F.least(F.lit(COPIES).cast("long"), F.col("_copies") - F.col("_block") * COPIES).alias("_k"),
        F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("null")).alias("_stratum"),
        F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "_block").alias("_h"),
    )
    slim = written(slim)
    n = slim.agg(F.coalesce(F.sum("_k"), F.lit(0))).first()[0]
    buckets = min(MAX_BUCKETS, 1 << (n // ROWS_PER_BUCKET).bit_length())
    order = ["_h", "doc_id", "text_crc32", "size", "_block"]
    ranked = _placed(slim.withColumn("_bucket", F.pmod("_h", F.lit(buckets))), ["_stratum", "_bucket"], ["_stratum"], "_bucket", order, "_rank")
    ranked = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))).withColumn("_k", F.lit(1).cast("long"))
    start = (F.pmod(F.xxhash64(F.lit(seed), "_stratum"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    ranked = ranked.withColumn("_fraction", (F.col("_rank") + F.col("_copy") + start) / F.col("_all"))
    ranked = ranked.withColumn("_band", F.least(F.floor(F.col("_fraction") * buckets), F.lit(buckets - 1)))
    placed = _placed(ranked, ["_band"], [], "_band", ["_fraction", "_stratum", *order, "_copy"], "_pos")
    placed = placed.withColumn("shard", F.expr(f"cast(_pos * {n_shards}L div {max(n, 1)}L as int)"))
    placed = placed.withColumn("slot", F.expr(f"_pos - (shard * {n}L + {n_shards - 1}L) div {n_shards}L"))
    return placed.select("doc_id", "size", "text_crc32", "source", "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stratified_shards(documents(spark, sf_dir))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source"
    )
