"""Operator 6 [native]: line deduplication over levelled sorted runs of line hashes.

Documents come in batches by ascending id. A batch's distinct line keys are merge-joined with the runs of
earlier batches: keys found there are lost in this batch; those not found (the anti-join) form a new run. Runs are tables bucketed and sorted by the
128-bit key hash, so no run is shuffled or sorted again; once ``fanout`` runs stand on a level they are merged
into one on the next, so a key is rewritten only log(batches) times. Within a batch a
key's least id keeps its lines. The outcome depends on the ids alone, not on where batches are cut.

Shuffled: hashes and positions of lines, and each text once, to meet its lost positions. A line that a third of all documents
hold is counted by partial aggregation, and the join that marks its places is an ordinary equi-join, which adaptive execution splits.

Defined cases: null text is one empty line (its text becomes empty); rows of equal doc_id are one document; rows
without doc_id together form the last document; an empty table gives no rows; all columns of the input stay, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.llm.common import LOWER, UPPER, WHITE, column, discard, documents, let, own_prefix, scratch_dir, text_of, written

BATCHES, FANOUT, LEAST_LENGTH = 4, 2, 10
LAST_ID = 9223372036854775807
KEY = ["k1", "k2"]


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(docs: DataFrame, id_col: str, text_col: str, least_length: int) -> DataFrame:
    """id, row (a hash of the text), pos and 128-bit key of each line that is long enough."""
    text = text_of(text_col)
    lines = docs.select(F.coalesce(column(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(lowered(text), "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "row", "pos", F.btrim("line", F.lit(WHITE)).alias("line")).where(F.length("line") >= least_length)
    return lines.select("id", "row", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


class LineRuns:
    """Levelled runs of (k1, k2), each a table bucketed and sorted by them. Keys of two runs never meet."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def store(self, keys: DataFrame) -> str:
        name = f"tesselark_lines_{uuid.uuid4().hex}"
        dealt = keys.repartition(self.buckets, *KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{scratch_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        table = self.spark.table(name)
        table._tesselark_path = f"{scratch_dir(self.spark)}/{name}"
        self.spark.sql(f"DROP TABLE {name}")
        discard(table)

    def seen(self, keys: DataFrame) -> DataFrame:
        """keys with a column seen: whether some run holds the key. Each run is joined by merging."""
        found = F.lit(False)
        for i, name in enumerate(x for level in self.levels for x in level):
            run = self.spark.table(name).select(*KEY, F.lit(True).alias(f"in{i}"))
            keys = keys.join(run.hint("merge"), KEY, "left")
            found = found | F.coalesce(F.col(f"in{i}"), F.lit(False))
        return keys.withColumn("seen", found)

    def add(self, keys: DataFrame, last: bool = False) -> None:
        """Add a run; keys must be new. After the last batch nothing would read it."""
        if last:
            return
        name, level = self.store(keys), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for x in old[1:]:
                merged = merged.unionByName(self.spark.table(x))
            name, level = self.store(merged), level + 1
            for x in old:
                self.drop(x)

    def close(self) -> None:
        for name in (x for level in self.levels for x in level):
            self.drop(name)


def lost_lines(docs: DataFrame, id_col: str, text_col: str, batches: int, fanout: int, least_length: int) -> DataFrame:
    """id, row, lost: positions of the lines that each document loses."""
    spark = docs.sparkSession
    keys = line_keys(docs, id_col, text_col, least_length)
    shares = F.array(*(F.lit(i / batches) for i in range(1, batches)))
    cuts = docs.agg(F.percentile_approx(F.coalesce(column(id_col).cast("long"), F.lit(LAST_ID)), shares, F.lit(1000))).first()[0] if batches > 1 else []
    batch = sum((F.when(F.col("id") > cut, 1).otherwise(0) for cut in sorted(set(cuts or []))), F.lit(0))
    keys = written(keys.withColumn("batch", batch), partition_by="batch")
    runs, lost = LineRuns(spark, fanout), []
    for i in range(batches):
        own = keys.where(F.col("batch") == i)
        known = own.groupBy(*KEY).agg(F.min("id").alias("first"), F.max("id").alias("last"))
        known = written(runs.seen(known))
        runs.add(known.where(~F.col("seen")).select(*KEY), last=i == batches - 1)
        doubled = known.where(F.col("seen") | (F.col("last") > F.col("first")))
        gone = own.join(doubled, KEY).where(F.col("seen") | (F.col("id") > F.col("first")))
        lost.append(written(gone.select("id", "row", "pos")))
        discard(known)
    runs.close()
    discard(keys)
    all_lost = lost[0]
    for x in lost[1:]:
        all_lost = all_lost.unionByName(x)
    return all_lost.groupBy("id", "row").agg(F.collect_set("pos").alias("lost"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """docs with the lines that stay as their text and, as last column, <prefix>lines: struct(n_lines (before), n_dropped); the prefix is own_prefix(docs)."""
    p, text = own_prefix(docs), text_of(text_col)
    lost = lost_lines(docs, id_col, text_col, batches, fanout, least_length)
    lost = lost.select(F.col("id").alias(f"{p}id"), F.col("row").alias(f"{p}row"), F.col("lost").alias(f"{p}lost"))
    same = (F.coalesce(column(id_col).cast("long"), F.lit(LAST_ID)) == F.col(f"{p}id")) & (F.xxhash64(text) == F.col(f"{p}row"))
    marked = docs.join(lost, same, "left").withColumn(f"{p}all", F.split(text, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size(f"{p}all") - 1), F.col(f"{p}lost"))
    # the lines go through a one-element array so that they are split once a row, not once a kept line
    rest = let(F.col(f"{p}all"), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n"))
    counts = F.struct(F.size(f"{p}all").cast("long").alias("n_lines"), F.coalesce(F.size(f"{p}lost"), F.lit(0)).cast("long").alias("n_dropped"))
    return marked.select(
        *(F.when(F.col(f"{p}lost").isNull(), text).otherwise(rest).alias(c) if c == text_col else column(c) for c in docs.columns), counts.alias(f"{p}lines")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    x = column(out.columns[-1])
    return out.select("doc_id", x["n_lines"].alias("n_lines"), x["n_dropped"].alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), owner AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (o.first IS NOT NULL AND l.doc_id > o.first) AS gone FROM lines l LEFT JOIN owner o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
